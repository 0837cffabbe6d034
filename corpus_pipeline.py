"""The corpus pipeline: five stages, each one operator on what the one before kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``.  Verdicts hold for single rows, by id and text: ids may be null or
repeat.  A null id counts as the largest; rows of the id that stays all stay.
``run`` applies the stages in order to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity
from faultline.llm.common import give_back, held_out, materialize, table, without_rows
from faultline.llm.queries import CAPACITY, END_ID, tokenizer_path

#: SQL can't express the toxicity classifier or the tokenizer.
ORACLE_SQL: str | None = None

#: Near copies of the pipeline; op2 has a contract of its own (4 words, 85 percent).
SHINGLE_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5))
    model = toxicity.fit(toxicity.training_sample(docs, labels))
    give_back()  # the driver keeps the model only
    return toxicity.without_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the smallest doc_id stays."""
    gone = exact_dedup.exact_duplicates(docs).where("not kept").withColumn("text_key", F.xxhash64("text_sha256"))
    return without_rows(docs, gone, exact_dedup.text_key(F.col("text")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingle similarity, the smallest doc_id stays.

    Texts link from a Jaccard similarity of 0.8 of their five-word shingles on.
    """
    near = jaccard_join.similar_components(docs, n=SHINGLE_WORDS, percent=NEAR_PERCENT, keyed=True)
    gone = near.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    return without_rows(docs, gone, jaccard_join.text_key(F.col("text")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keyed=True)
    return without_rows(docs, found.where("contaminated"), decontaminate.text_key(F.col("text")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of all that is left, packed into sequences."""
    return packing.pack(docs, tokenizer_path(), END_ID, CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage keeps is checkpointed for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
