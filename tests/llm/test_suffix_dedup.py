import random
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from textloom.llm import common, suffix_dedup

from .fixtures import awkward, empty


def brute(rows, n):
    occ, win = defaultdict(list), defaultdict(set)
    for i, t in sorted(set(rows)):
        w = t.split()
        for k in range(len(w) - n + 1):
            occ[tuple(w[k : k + n])].append((i, k))
    for v in occ.values():
        if len(v) > 1:
            for c, (i, k) in enumerate(sorted(v)):
                win[i, c > 0].add(k)
    out = set()
    for (i, c), ks in win.items():
        s = e = None
        for k in sorted(ks):
            if s is None or k > e + n:
                if s is not None:
                    out.add((i, s, e + n, c))
                s = k
            e = k
        out.add((i, s, e + n, c))
    return out


def spans(df, n):
    return {(r.doc_id, r.start_word, r.end_word, r.is_copy) for r in suffix_dedup.repeats(df, n).collect()}


def test_brute_force(spark):
    random.seed(3)
    for vocab, n in ((2, 6), (5, 7), (40, 6)):
        texts = [" ".join(random.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRST"[:vocab]) for _ in range(random.randrange(0, 60))) for _ in range(25)]
        texts += [texts[0], texts[1] + " x y " + texts[2], texts[3] + " " + texts[3]]
        rows = list(enumerate(texts))
        assert spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n) == brute(rows, n)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert spans(docs, 50) == brute([(r.doc_id, r.text) for r in docs.collect()], 50)


def test_anchors_are_in_every_window():
    random.seed(4)
    h, first, _, _ = common.tokens(*common.flat(pa.array([" ".join(random.choice("ab") for _ in range(80)), "a b", " ".join("abcdefghij" * 4)])))
    doc, pos, _ = suffix_dedup.anchors(h, first, 12)
    for d in (0, 2):
        own = set(pos[doc == d].tolist())
        for s in range(first[d + 1] - first[d] - 12 + 1):
            assert any(s <= p <= s + 6 for p in own)
    assert not (doc == 1).any()


def test_awkward(spark):
    t = "alpha beta gamma delta epsilon zeta"
    assert spans(awkward(spark), 6) == brute([(1, t), (2, t)], 6)
    assert spans(empty(spark), 6) == set()
    d = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert spans(d, 6) == {(1, 0, 6, False), (None, 0, 6, True)}


def test_texts_whose_hashes_agree(spark, monkeypatch):
    random.seed(6)
    texts = [" ".join(random.choice("abc") for _ in range(random.randrange(0, 25))) for _ in range(12)]
    rows = list(enumerate(texts + texts[:3]))
    monkeypatch.setattr(suffix_dedup, "_key", lambda: F.pmod(F.length(suffix_dedup.TEXT), F.lit(2)).cast("long"))
    assert spans(spark.createDataFrame(rows, "doc_id long, text string"), 6) == brute(rows, 6)
