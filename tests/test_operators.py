import os
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom import catalog
from textloom.functions import hashing, text
from textloom.operators import attempts, bags, cooc, corpus, vectors
from textloom.streaming import retry


@pytest.mark.parametrize("values", [[0] * 64, [1] * 64, list(range(64))])
def test_duplicate_mask(spark, values):
    d = spark.createDataFrame(list(enumerate(values)), "pos int, h int")
    rows = corpus.duplicate_mask(d, "h", "pos").orderBy("pos").collect()
    assert [r.keep for r in rows] == [v not in values[:i] for i, v in enumerate(values)]


def test_index(spark, tmp_path):
    words = ["a", "hello", "b", "hello", None, "google"]
    index = corpus.index_build(spark.createDataFrame([(w,) for w in words], "s string"), "s")
    corpus.index_write(index, f"{tmp_path}/i")
    back = corpus.index_scan(spark.read.parquet(f"{tmp_path}/i")).select("value", hashing.unsigned_value(F.col("hash")).alias("u")).collect()
    assert sorted(r.value for r in back) == ["a", "b", "google", "hello"]
    assert [int(r.u) for r in back] == sorted(int(r.u) for r in back)
    wanted = index.select("hash").unionByName(spark.createDataFrame([(1,)], "hash long"))
    assert corpus.index_lookup(index, wanted, "none").where("value = 'none'").count() == 1
    with pytest.raises(Exception, match="no such key"):
        corpus.index_lookup(index, wanted, strict=True).collect()
    pos = corpus.index_positions(spark.createDataFrame([(5,), (3,)], "k long"), "k", spark.createDataFrame([(3,), (4,), (5,)], "k long"))
    assert {r.k: r.idx for r in pos.collect()} == {3: 0, 4: -1, 5: 1}


def test_first_run_and_ordinal(spark):
    apps = "a a b b a c b c c d".split()
    d = spark.createDataFrame(list(enumerate(apps)), "pos int, app string")
    assert sorted(r.pos for r in corpus.first_run(d, "app", "pos").collect()) == [0, 1, 2, 3, 5, 9]
    rows = corpus.ordinal(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")), ["x"], "n").collect()
    assert all(r.x == r.n for r in rows) and len(rows) == 1000


def test_bins(spark):
    d = spark.createDataFrame(list(enumerate([3, 4, 5, 20, 1, 1])), "k int, n long")
    assert [r.bin for r in corpus.greedy_bins(d, "k", "n", 10).orderBy("k").collect()] == [0, 0, 1, 2, 3, 3]


def test_clean_corpus(spark):
    d = spark.createDataFrame([("a", "k", "", "Hi!"), ("a", "k", "-de", "Hallo!"), ("a", "j", "-en-rGB", "hi !"), ("a", "j", "-fr", None)], "app string, key string, locale string, value string")
    out = corpus.clean_corpus(d, "app", "key", "locale", "value")
    assert sorted(r.clean for r in out["clean"].collect()) == ["hallo !", "hi !", "hi !"]
    assert out["english"].count() == 1 and out["groups"].select("key_hash").distinct().count() == 2 and out["pairs"].count() == 3


def test_pairs(spark):
    random.seed(1)
    rows = [(random.randrange(12), random.randrange(6)) for _ in range(60)]
    d = spark.createDataFrame(rows, "k int, v int")
    groups = {k: {v for x, v in rows if x == k} for k, _ in rows}
    want: dict = {}
    for g in groups.values():
        for a, b in combinations(sorted(g), 2):
            want[a, b] = want.get((a, b), 0) + 1
            want[b, a] = want.get((b, a), 0) + 1
    got = cooc.pairs(d, "k", "v")
    assert {(r.left, r.right): r["count"] for r in got.collect()} == want
    assert {(r.lo, r.hi): r["count"] for r in cooc.unordered_pairs(d, "k", "v").collect()} == {k: v for k, v in want.items() if k[0] < k[1]}
    var = {r.left: r.variance for r in cooc.ambiguity(got).collect()}
    for left in var:
        assert var[left] == pytest.approx(np.var([v for k, v in want.items() if k[0] == left]), abs=1e-8)


def test_partitions_of_pairs_follow_the_rows(spark, monkeypatch):
    d = spark.createDataFrame([(i // 4, i % 7) for i in range(400)], "k int, v int")
    monkeypatch.setattr(cooc, "ROWS", 10)
    for found in (cooc.pairs(d, "k", "v"), cooc.occurrence_pairs(d, "k", "v"), cooc.unordered_pairs(d, "k", "v")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(left" in plan and ", 40), REPARTITION_BY_NUM" in plan and "Join" not in plan
    merged = cooc.merge_counts(cooc.pairs(d, "k", "v"), cooc.pairs(d, "k", "v"), partitions=40)
    assert {(r.left, r.right): r["count"] for r in merged.collect()} == {(r.left, r.right): 2 * r["count"] for r in cooc.pairs(d, "k", "v").collect()}
    looked = cooc.lookup_translations(cooc.translations(cooc.pairs(d, "k", "v")), spark.createDataFrame([(1,), (9,)], "k int"), "k")
    assert "rangepartitioning" not in looked._jdf.queryExecution().executedPlan().toString()
    rows = [(r.left, r["count"]) for r in looked.collect()]
    assert [c for k, c in rows if k == 1] == sorted((c for k, c in rows if k == 1), reverse=True) and (9, None) in rows


@pytest.mark.parametrize("name", ["ambiguity_score", "ambiguity_var", "score_ambiguity", "translation_index", "translation_prob"])
def test_scores_stay_in_the_partitions_of_their_pairs(spark, sf, monkeypatch, name):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(cooc, "ROWS", 500)
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count(f", {-(-rows // 500)}), REPARTITION_BY_NUM") == 2 and "Join" not in plan


def test_variances(spark):
    d = spark.createDataFrame([(1, i, c) for i, c in enumerate((2, 3, 7))], "left long, right long, count long")
    assert cooc.ambiguity(d).first().variance == pytest.approx(14 / 3, abs=1e-8) and cooc.ambiguity_floor(d).first().variance == 4


def test_word_counts_of_texts_cross_the_network_as_sums(spark, monkeypatch):
    texts = ["a b a", "", " ", None, "\ta\u00e9 a,b \u00e9\n", "x" * 3000 + " y" * 2000, "e\u0301 e", "Tail ", " tail", "1 2 2 3 3 3"]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(None, "a a b")], "id long, text string")
    w = lambda d: d.where("id is not null").select(F.col("id").alias("left"), F.explode(text.words(F.col("text"))).alias("term")).groupBy("left", "term").agg(F.count(F.lit(1)).alias("count"))
    for most in (1, 1 << 20):
        monkeypatch.setattr(text.strips, "__defaults__", (most,))
        sums = text._word_counts(pa.array(texts)).to_pylist()
        assert sums[0] == {"n": 2, "total": 3, "squares": 5} and [x["n"] for x in sums[1:4]] == [0, 0, 0] and sums[-1] == {"n": 3, "total": 6, "squares": 14}
        assert text._word_counts(pa.array([None, ""])).to_pylist() == [{"n": 0, "total": 0, "squares": 0}] * 2 and len(text._word_counts(pa.array([], pa.string()))) == 0
        assert text._word_counts(pa.array(texts)[4:8]).to_pylist() == sums[4:8]
    several = d.unionByName(spark.createDataFrame([(0, "a c"), (1, "q"), (2, ""), (3, None), (None, "b")], "id long, text string"))
    for x in (d, several):
        got = cooc.text_ambiguity(x, "id", "text")
        assert sorted(got.collect()) == sorted(cooc.ambiguity(w(x)).collect())
    monkeypatch.setattr(cooc, "TEXTS", 1)
    plan = lambda x: cooc.text_ambiguity(x, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan(d) and "REPARTITION_BY_NUM" not in plan(d) and ", 14), REPARTITION_BY_NUM" in plan(several)


def test_bags(spark, tmp_path):
    from textloom.sources import files

    d = spark.createDataFrame([(5, 1), (5, 1), (5, 0), (9, 2), (None, 1)], "d int, t int")
    b = bags.bag(d, "d", "t")
    assert {(r.doc, r.line) for r in bags.topic_lines(b).collect()} == {(5, "| 0:1 1:2"), (9, "| 2:1")}
    files.write_topic_lines(bags.topic_lines(b), f"{tmp_path}/l")
    assert spark.read.text(f"{tmp_path}/l").count() == 2
    assert {r.d: r.n for r in bags.dense_ids(d.dropna(), "d", "n").collect()} == {5: 0, 9: 1}
    f = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x"), (3, "a")], "pos int, v string")
    assert {r.v: r.n for r in bags.first_seen_ids(f, "v", "pos", "n").collect()} == {"x": 0, "y": 1, "a": 2}
    s = spark.createDataFrame([(-5,), (3,), (150,), (203,)], "i int")
    assert sorted(r.i for r in bags.residue_sample(s, "i", 10).collect()) == [-5, 3, 203]
    assert [tuple(r) for r in bags.heavy_hitters(f, "v", 1).collect()] == [("x", 2)]
    assert bags.approximate_heavy_hitters(f, "v", 1).first()["value"] == "x"
    m = bags.topics(b, 3, k=2, passes=2)
    assert m.topicsMatrix().numRows == 3


def test_neighbours(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = e.collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(x @ x.T, 9)
    np.fill_diagonal(sim, -9)
    ids = np.array([r.vec_id for r in rows])
    want = {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in np.lexsort((ids, -sim[i]))[:10]}
    got = {(r["query"], r.neighbour) for r in vectors.neighbours(e, e, "vec_id", "embedding", 10).collect()}
    assert got == want
    near = {(r["query"], r.neighbour) for r in vectors.approximate_neighbours(e, e, "vec_id", "embedding", 10).collect()}
    assert len(near & want) >= 0.9 * len(want)


def test_neighbours_are_compared_in_bounded_groups(spark, sf, monkeypatch):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.where("vec_id % 100 = 0")
    for search in (vectors.neighbours, vectors.approximate_neighbours):
        plan = search(e, q, "vec_id", "embedding", 10)._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan and "CartesianProduct" not in plan
    whole = vectors.neighbours(e, q, "vec_id", "embedding", 10).collect()
    monkeypatch.setattr(vectors, "BLOCK", 7)
    assert sorted(vectors.neighbours(e, q, "vec_id", "embedding", 10).collect()) == sorted(whole)
    assert {r["query"] for r in catalog.queries()["knn_lsh"](spark, sf).collect()} == {r.vec_id for r in q.collect()}


def test_recall_of_hashing(spark):
    big = "/root/testdata/sf0.1"
    if not os.path.exists(big):
        pytest.skip("no test data")
    near = {k: {(r["query"], r.neighbour) for r in catalog.queries()[k](spark, big).collect()} for k in ("knn_lsh", "knn_angular")}
    assert len(near["knn_lsh"] & near["knn_angular"]) >= 0.9 * len(near["knn_angular"])


def test_neighbours_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [0.0, 2.0])]
    e = spark.createDataFrame(rows, "i long, v array<float>")
    got = [(r["query"], r.neighbour, r.distance) for r in vectors.neighbours(e, e, "i", "v", 1).orderBy("query").collect()]
    assert got == [(1, 4, 0.0), (4, 1, 0.0), (5, 1, pytest.approx(2**0.5, abs=1e-5))]


def tries():
    random.seed(2)
    return [(i, random.randrange(5), random.random() < 0.05) for i in range(150)]


def test_attempts_batch_and_stream(spark, tmp_path):
    rows = tries()
    want, state = set(), {}
    for _, job, ok in rows:
        n, over = state.get(job, (0, False))
        if over or n > 20:
            continue
        want.add((job, n + 1, ok, 20 - n))
        state[job] = (n + 1, ok)
    d = spark.createDataFrame(rows, "o int, job long, ok boolean")
    assert {(r.job, r.attempt, r.ok, r.left) for r in attempts.fold(d, "job", "o", "ok").collect()} == want
    for i in range(3):
        d.where(f"o >= {50 * i} and o < {50 * i + 50}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = retry.fold_stream(s, "job", "o", "ok").writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {(r.job, r.attempt, r.done, r.left) for r in spark.table("folded").collect()} == want


def test_stream_that_forgets(spark, tmp_path):
    from time import monotonic, sleep

    schema = "o int, job long, ok boolean"
    spark.createDataFrame([(1, 7, True)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = retry.fold_stream(s, "job", "o", "ok", forget="1 second").writeStream.format("memory").queryName("forgetful").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    end, sent = monotonic() + 60, False
    while monotonic() < end and spark.table("forgetful").count() < 2:
        sleep(3)
        if not sent and spark.table("forgetful").count():
            sleep(5)
            spark.createDataFrame([(2, 7, False)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
            sent = True
    q.stop()
    assert sorted((r.attempt, r.done) for r in spark.table("forgetful").collect()) == [(1, False), (1, True)]


def test_streams(spark, tmp_path):
    d = spark.createDataFrame([("2024-01-01 00:00:00", "a"), ("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "b"), ("2024-01-02 00:00:00", None)], "t string, n string").select(F.to_timestamp("t").alias("t"), "n")
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    q = retry.unseen_stream(s, "n", "t").writeStream.format("memory").queryName("unseen").option("checkpointLocation", f"{tmp_path}/a").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("unseen").collect()) == ["a", "b"]
    q = retry.histogram_stream(s, "n", "t").writeStream.format("memory").queryName("hist").outputMode("update").option("checkpointLocation", f"{tmp_path}/b").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.n, r["count"]) for r in spark.table("hist").collect()} == {("a", 2), ("b", 1)}


def test_logs(spark):
    items = spark.createDataFrame([("a",), (None,), ("b",)], "n string")
    assert [r.n for r in attempts.unseen(items, spark.createDataFrame([(" a ",)], "n string"), "n").collect()] == ["b"]
    d = spark.createDataFrame([(0, "x"), (1, "m"), (2, "y")], "o int, k string")
    assert sorted(r.k for r in attempts.after_marker(d, "k", "o", "m").collect()) == ["m", "y"]
    tied = spark.createDataFrame([(0, 2, "x"), (0, 3, "m"), (0, 4, "y"), (0, 1, "z")], "o int, n int, k string")
    assert sorted(r.k for r in attempts.after_marker(tied, "k", ["o", "n"], "m").collect()) == ["m", "y"]


def test_suggestions_with_raws_and_translations(spark):
    near = spark.createDataFrame([(9, i, i, 0.1 * i) for i in (1, 2, 3)], "query long, neighbour long, rank int, distance double")
    amb = spark.createDataFrame([(1, 5.0), (3, 1.0)], "id long, score double")
    strings = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, "four")], "id long, text string")
    raw = spark.createDataFrame([(2, "Two!"), (2, "TWO"), (4, "Four")], "id long, raw string")
    index = cooc.translations(spark.createDataFrame([(2, 4, 3), (2, 1, 1), (3, 2, 7)], "left long, right long, count long"))
    got = [r for r in vectors.suggest(near, amb, strings, 2, raw, index).orderBy("place").collect()]
    assert [(r.neighbour, r.text, r.raws) for r in got] == [(2, "two", ["TWO", "Two!"]), (3, "three", None)]
    assert [(x.text, x.raws, x.share) for x in got[0].translations] == [("four", ["Four"], 0.75), ("one", None, 0.25)]
    assert [(x.id, x.share) for x in got[1].translations] == [(2, 1.0)]


def test_sentence_vectors(spark):
    d = spark.createDataFrame([(["a", "b", "c"],), (["a", "c"],)] * 5, "t array<string>")
    assert {len(r.vector) for r in vectors.sentence_vectors(d, "t", size=8, min_count=1).collect()} == {8}
