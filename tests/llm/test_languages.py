"""The sample that the language model learns from."""

from faultline.llm import language_id


def test_every_language_is_sampled(spark):
    rows = [(i, f"text {i}", f"l{i // 2}") for i in range(1400)]
    sample = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(sample) == rows
