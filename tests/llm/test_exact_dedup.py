import random
from collections import Counter

import numpy as np

from textloom.llm import exact_dedup

from .fixtures import ROWS, awkward, empty


def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    least: dict = {}
    for r in rows:
        least[r.text] = min(least.get(r.text, r.doc_id), r.doc_id)
    for fan, parts in ((2, 7), (8, 3)):
        got = exact_dedup.copies(docs.repartition(parts), fan=fan).collect()
        assert {(r.doc_id, r.keep_id) for r in got} == {(r.doc_id, least[r.text]) for r in rows}
    assert {r.doc_id for r in exact_dedup.dedup(docs).collect()} == set(least.values())


def test_awkward(spark):
    d = awkward(spark)
    got = Counter((r.doc_id, r.text) for r in exact_dedup.dedup(d).collect())
    assert got == Counter([(i, t) for i, t in dict.fromkeys((i, t) for i, t, _ in ROWS) if (i, t) not in ((2, ROWS[0][1]), (5, ""))])
    assert exact_dedup.dedup(d).columns == d.columns
    assert {(r.doc_id, r.keep_id, r.n_rows) for r in exact_dedup.copies(d).where("doc_id in (2, 5, 7)").collect()} == {(2, 1, 1), (5, 4, 1), (7, 7, 2)}
    assert exact_dedup.copies(empty(spark)).count() == exact_dedup.dedup(empty(spark)).count() == 0


def test_columns_without_an_order(spark):
    rows = [(1, "a", {"x": 2}, '{"a": 1}'), (1, "a", {"x": 1}, '{"a": 1}'), (2, "a", {"x": 0}, "1"), (3, "b", None, None), (3, "b", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, j string").selectExpr("doc_id", "text", "m", "array(m) as ms", "parse_json(j) as v")
    got = exact_dedup.dedup(d)
    assert got.columns == d.columns
    assert sorted((r.doc_id, r.m and r.m["x"]) for r in got.select("doc_id", "m").collect()) == [(1, 1), (3, None)]


def test_merge_verifies_equal_digests():
    random.seed(3)
    rows = [(random.randrange(4), random.randrange(2), random.randrange(2), random.randrange(100)) for _ in range(300)]
    runs = [sorted(rows[i : i + 60]) for i in range(0, 300, 60)]
    d, s, n, keep = (np.array([r[k] for run in runs for r in run]) for k in range(4))
    sha = np.stack([np.zeros_like(s), s, s, s], 1).astype(np.uint64)
    got = exact_dedup.merge(d.astype(np.uint64), sha, n, keep)
    least: dict = {}
    for a, b, c, i in rows:
        least[a, b, c] = min(least.get((a, b, c), i), i)
    assert {(int(a), int(b[1]), int(c)): int(i) for a, b, c, i in zip(*got)} == least
    assert len(got[0]) == len(least) and (np.diff(got[0].astype(np.int64)) >= 0).all()
