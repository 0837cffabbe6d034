"""Components of the Jaccard join against all pairs."""

import os
import random
from urllib.parse import urlparse

from faultline.llm import components, jaccard_join

SCHEMA = "doc_id long, text string, source string"


def shingles(text, n=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 85 * len(a | b):
                parent[find(i)] = find(j)
    top = {}
    for i, (d, _, _) in enumerate(rows):
        top.setdefault(find(i), []).append(d)
    return sorted((d, len(sets[i]), min(top[find(i)])) for i, (d, _, _) in enumerate(rows))


def test_against_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + rng.choice("abcdefghij") + rng.choice("abc")
    texts = [None, "", "  ", "one two", "ONE  two", "one two three", "a b c d", "A b c\nd"]
    for _ in range(6):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(9):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
            base = t if rng.random() < 0.5 else base  # chains, of which only neighbours are similar
    texts += [texts[9]] * 5
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in jaccard_join.similar_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)


def test_no_rows(spark):
    assert jaccard_join.similar_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_pairs_of_a_text_in_many_lanes(spark, monkeypatch):
    """A pivot with most of all pairs, and texts that are in several of them."""
    monkeypatch.setattr(jaccard_join, "_LEAST_SHARE", 4)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((i, " ".join(t), "s"))
    join = jaccard_join._Join(spark.createDataFrame(rows, SCHEMA), 4, 85)
    texts = join.stored(join.single.select(jaccard_join.F.col("_tid").alias("text")))
    ids = {r["_d"]: r["_tid"] for r in join.rows.select("_d", "_tid").collect()}
    pairs = {(ids[a], ids[b]) for a, b in [(0, i) for i in range(1, 120)] + [(i, i + 1) for i in range(1, 40)] if ids[a] != ids[b]}
    got = {(r.a, r.b): (r.linked, r.d) for r in join.tested(spark.createDataFrame(sorted(pairs), "a long, b long"), texts).collect()}
    sets = {ids[i]: shingles(t) for i, t, _ in rows}
    assert got == {(a, b): (100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]), 1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b in pairs}


def test_few_pointers_take_one_task_and_many_take_rounds(spark, monkeypatch):
    """The same roots either way; few pointers need two checkpoints, not rounds of exchanges."""
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(200, 200)]
    frame, made, settled = spark.createDataFrame(links, "a long, b long").repartition(5), [], components.settled
    monkeypatch.setattr(components, "settled", lambda df: made.append(df) or settled(df))
    few = sorted(map(tuple, components.components(frame).collect()))
    assert len(made) == 2
    monkeypatch.setattr(components, "_ONE_TASK", 0)
    assert sorted(map(tuple, components.components(frame).collect())) == few
    assert len(made) > 4


def test_messages_are_deleted_and_texts_not_shuffled(spark, monkeypatch):
    made, settled = [], jaccard_join.settled
    monkeypatch.setattr(jaccard_join, "settled", lambda df: made.append((df, settled(df))) or made[-1][1])
    rows = [(1, "a b c d e", "s"), (2, "a b c d e", "s"), (3, "f g h i", "s")]

    def stored(rows):
        join = jaccard_join._Join(spark.createDataFrame(rows, SCHEMA), 4, 85)
        join.index()
        assert [os.path.exists(urlparse(out.checkpoint_file).path) for _, out in made] == [False, True, True, True]
        texts = join.stored(join.single.select(jaccard_join.F.col("_tid").alias("text")).distinct())
        assert texts.count() == texts.select("text").distinct().count() == 2
        return [df._jdf.queryExecution().optimizedPlan().toString() for df, out in made[4:] if "raw" in out.columns]

    plans = stored(rows)
    assert len(plans) == 1 and "Aggregate" not in plans[0]
    made.clear()
    assert len(stored([*rows, (1, "a b c d e", "s"), (1, "a b c d e", "t")])) == 2  # an id repeats with its text


def test_lists_with_texts_of_many_sizes(spark):
    """Texts of different sizes in one list, whose places decide which are compared."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        t = base[: rng.randint(60, 80)] + [f"x{rng.randrange(12)}" for _ in range(rng.randint(0, 14))]
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice("yz")
        rows.append((i, " ".join(t), "s"))
    got = sorted(tuple(r) for r in jaccard_join.similar_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)
