import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import quality

from .fixtures import awkward, empty


def test_held_out(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/labels.parquet")
    rows = docs.join(labels, "doc_id").orderBy("doc_id").collect()
    x, y = quality.features(pa.array([r.text for r in rows])), np.array([r.quality for r in rows], float)
    half = np.arange(len(y)) % 2 == 0
    p = quality.fit(x[half], y[half]).score(x[~half]) >= 0.5
    assert (p == y[~half]).mean() > 0.95 and p[y[~half] == 1].mean() > 0.98
    got = {r.doc_id: r.keep for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count() and np.mean([got[r.doc_id] == bool(r.quality) for r in rows]) > 0.97
    few = quality.train(docs, labels, max_train=50)
    assert few.tables


def test_tables_are_additive():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair tells
    flat = quality.fit(x, y, n_pairs=0)
    both = quality.fit(x, y, n_pairs=1)
    assert ((flat.score(x) > 0.5) == y).mean() < 0.7 < 0.9 < ((both.score(x) > 0.5) == y).mean()
    assert {both.pairs[0][0], both.pairs[0][1]} == {0, 1}
    b = both.bins(x[:5])
    for r in range(5):
        want = both.base + sum(t[b[r, j]] for j, t in enumerate(both.tables)) + sum(t[b[r, i], b[r, j]] for i, j, t in both.pairs)
        assert both.margin(x[:5])[r] == pytest.approx(want)


def test_features_by_hand():
    t = "The the THE cat.\nA $$$ day\nA $$$ day"
    f = dict(zip(quality.NAMES, quality.features(pa.array([t, None, "", " "]))[0]))
    w = t.split()
    assert f["words"] == pytest.approx(np.log1p(len(w))) and f["word_len"] == pytest.approx(np.mean([len(x) for x in w]))
    assert f["line_distinct"] == pytest.approx(2 / 3) and f["top_word"] == pytest.approx(2 / len(w)) and f["bare_marks"] == pytest.approx(2 / len(w))
    assert f["word_distinct"] == pytest.approx(len(set(w)) / len(w)) and f["symbols"] == pytest.approx(6 / len(t))
    assert quality.features(pa.array([None, "", "a b"], pa.string())).shape == (3, len(quality.NAMES))


def test_awkward(spark):
    d = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 0), (7, None), (99, 0), (None, 1)], "doc_id long, quality int")
    out = quality.classify(d, labels).collect()
    assert len(out) == d.count() and all(r.score == 0 and not r.keep for r in out if r.doc_id in (3, 4, 5, 6))
    none = labels.limit(0)
    assert {r.keep for r in quality.classify(d, none).where("doc_id in (1, 7, 8)").collect()} == {True}
    assert quality.keep_good(d, none).columns == d.columns and quality.keep_good(d, none).count() == 7
    assert quality.classify(empty(spark), labels).count() == 0
