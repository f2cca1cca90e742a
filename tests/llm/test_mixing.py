import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import mixing

from .fixtures import ROWS, awkward, empty


@given(st.lists(st.floats(0.01, 0.99), min_size=3, max_size=3), st.lists(st.integers(0, 500), min_size=3, max_size=3), st.integers())
def test_step_keeps_the_totals(p, words, seed):
    q = list(p)
    a, b = [2.0] * 3, [2.0 * w for w in words]
    mixing.step(q, a, b, random.Random(seed))
    assert any(x in (0.0, 1.0) for x in q) and all(0 <= x <= 1 for x in q)
    assert sum(q) == pytest.approx(sum(p), abs=1e-6)
    assert sum(x * y for x, y in zip(q, b)) == pytest.approx(sum(x * y for x, y in zip(p, b)), rel=1e-6, abs=1e-3)


def test_step_keeps_the_probabilities():
    p, words = [0.2, 0.5, 0.7], [3, 10, 4]
    rng = random.Random(1)
    total = [0.0] * 3
    for _ in range(20_000):
        q = list(p)
        mixing.step(q, [1.0] * 3, [float(w) for w in words], rng)
        total = [x + y for x, y in zip(total, q)]
    assert [x / 20_000 for x in total] == pytest.approx(p, abs=0.01)


def test_landing_keeps_the_count():
    rng = random.Random(2)
    n = 0
    for _ in range(10_000):
        u = [[0.3], [0.5]]
        mixing.land(u, rng)
        assert all(x[0] in (0.0, 1.0) for x in u) and sum(x[0] for x in u) <= 1
        n += sum(x[0] for x in u)
    assert n / 10_000 == pytest.approx(0.8, abs=0.02)


def test_weights(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 10 < 7, "big").when(F.col("doc_id") % 10 < 9, "mid").otherwise("small"))
    weights = {"big": 0.3, "mid": 0.4, "small": 0.2}
    total = {r.source: (r.w, r.n) for r in docs.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("w"), F.count("*").alias("n")).collect()}
    budget = min(total[s][0] / w for s, w in weights.items())
    got = {r.source: r for r in mixing.selection(docs, weights).groupBy("source").agg(F.sum("n_words").alias("w"), F.count("*").alias("n"), F.first("inclusion").alias("p")).collect()}
    longest = docs.agg(F.max(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    for s, w in weights.items():
        assert abs(got[s].w - w * budget) <= longest  # only the landing is off
        assert abs(got[s].n - got[s].p * total[s][1]) < 2
    assert sum(got[s].w for s in weights) == pytest.approx(0.9 * budget, rel=0.03)
    ids = lambda d: {r.doc_id for r in mixing.sample(d, weights).collect()}
    assert ids(docs) == ids(docs.repartition(5)) == {r.doc_id for r in mixing.selection(docs, weights).collect()}
    assert ids(docs) != {r.doc_id for r in mixing.sample(docs, weights, seed=8).collect()}


def test_missing_weights(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r.source for r in mixing.sample(docs, {"src1": 1.0, "no such": 1.0, "src2": 0.0}).collect()} == {"src1"}


def test_awkward(spark):
    d = awkward(spark)
    out = mixing.sample(d)
    assert out.columns == d.columns
    got = [r.n for r in out.collect()]
    assert len(got) == len(set(got)) and (6 in got) == (7 in got)  # repeated rows stand or fall together
    assert all(ROWS[n][2] is not None for n in got)  # the null source has no words
    assert mixing.sample(empty(spark)).count() == mixing.selection(empty(spark)).count() == 0
    only = d.where("source is null and text is not null or doc_id = 1").withColumn("source", F.lit(None).cast("string"))
    assert {r.doc_id for r in mixing.sample(only).collect()} == {1, 4}


def _words(spark, sizes):
    """Documents of 20 words; ``sizes`` gives how many each source has."""
    rows = [(s, i) for s, n in sizes for i in range(n)]
    return spark.createDataFrame([(k, f"{'w ' * 19}{k}", s) for k, (s, _) in enumerate(rows)], "doc_id long, text string, source string")


def _inclusion(docs, weights=None):
    return {r.source: (r.n, r.p) for r in mixing.selection(docs, weights).groupBy("source").agg(F.count("*").alias("n"), F.first("inclusion").alias("p")).collect()}


def test_tiny_sources_do_not_bind_the_budget(spark):
    big = [("a", 400), ("b", 400), ("c", 1600)]
    got = _inclusion(_words(spark, [*big, ("rare", 1), (None, 1)]))
    assert got["rare"] == got[None] == (1, 1.0)
    assert got["a"] == got["b"] == (400, 1.0) and got["c"][1] == 0.5 and abs(got["c"][0] - 800) < 2
    assert {s: got[s][1] for s in "abc"} == {s: p for s, (_, p) in _inclusion(_words(spark, big)).items()}  # as without the tiny ones
    got = _inclusion(_words(spark, [*big, ("rare", 1)]), {"a": 0.4, "b": 0.396, "rare": 0.004, "c": 0.2})
    assert got["rare"] == (1, 1.0) and got["a"] == (400, 1.0) and abs(got["b"][0] - 396) < 2 and abs(got["c"][0] - 200) < 2


def test_many_small_sources_leave_half_of_the_words(spark):
    got = _inclusion(_words(spark, [("big", 900), ("second", 100), *[(f"s{i}", 1) for i in range(50)]]))
    assert all(got[f"s{i}"] == (1, 1.0) for i in range(50))
    assert got["second"][0] + got["big"][0] == pytest.approx(525 - 50, abs=2)
    assert got["second"] == (100, 1.0) and got["big"][1] == pytest.approx(375 / 900, abs=1e-6)
