import random
import re
from collections import defaultdict
from itertools import combinations

import pytest

from textloom.llm import near_dedup as nd

from .fixtures import awkward, empty


def gram_sets(rows, n):
    out = {}
    for i, t in rows:
        w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())
        if w:
            out[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])
    return out


def brute(rows, n, t):
    """All pairs of different rows, and the class and number of links of each."""
    sets, pairs = gram_sets(enumerate(x[1] or "" for x in rows), n), {}
    for a, b in combinations(sets, 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= t - 1e-12:
            pairs[a, b] = j
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    count = [0] * len(rows)
    for a, b in pairs:
        count[a], count[b] = count[a] + 1, count[b] + 1
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return pairs, [(rows[i][0], rows[find(i)][0], count[i]) for i in range(len(rows))]


def wanted(rows, n, t):
    """Of rows in order of their identifiers the links as ``links`` tells them, and the pairs of representatives as ``join`` tells them."""
    pairs, out = brute(rows, n, t)
    sets = gram_sets(enumerate(x[1] or "" for x in rows), n)
    rep = {}
    for i, s in sets.items():
        rep.setdefault(s, i)
    near = {(rows[a][0], rows[b][0], round(j, 6)) for (a, b), j in pairs.items() if sets[a] != sets[b] and rep[sets[a]] == a and rep[sets[b]] == b}
    return sorted(out, key=str), near


def links(df, *a):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in nd.links(df, *a).collect()), key=str)


def pairs(df, *a):
    return {(r.left_id, r.right_id, r.jaccard) for r in nd.join(df, *a).collect()}


@pytest.mark.parametrize(("n", "t"), [(1, 0.3), (2, 0.7)])
def test_brute_force(spark, n, t, monkeypatch):
    monkeypatch.setattr(nd, "HEAVY", 3)
    random.seed(n)
    base = [[random.choice("abcdefghij") for _ in range(random.randrange(1, 30))] for _ in range(12)]
    rows = []
    for i in range(60):
        w = list(random.choice(base))
        for _ in range(random.randrange(4)):
            w[random.randrange(len(w))] = random.choice("abcdefghijKLM")
        rows.append((i, random.choice((" ", ", ", "! ")).join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, near = wanted(rows, n, t)
    assert links(docs, n, t) == want
    assert pairs(docs, n, t) == near


def test_large_families_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(nd, "HEAVY", 6)
    random.seed(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(3):  # sizes are equal: only the order of arrival tells the sides of a pair apart
            w[random.randrange(60)] = f"x{random.randrange(40)}"
        rows.append((i, " ".join(w)))
    want, near = wanted(rows, 3, 0.6)
    for parts in (5,):
        random.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert links(docs, 3, 0.6) == want
        assert pairs(docs, 3, 0.6) == near


def family(seed, n):
    """Near copies of a text, cut or edited a little or much, with exact copies among them, and a family close to it."""
    r = random.Random(seed)
    base, rows = [f"w{r.randrange(5000)}" for _ in range(120)], []
    for i in range(n):
        w = list(base)
        if i % 7 == 0:
            w = w[: r.randrange(60, 120)]
        for _ in range(r.choice((0, 1, 1, 2, 3, 5, 9, 14))):
            w[r.randrange(len(w))] = f"x{r.randrange(5000)}"
        rows.append((i, " ".join(w + [f"y{k}" for k in range(40)] * (i % 11 == 3))))
    return rows


@pytest.mark.parametrize("t", [0.5, 1.0])
def test_crowds(spark, t, monkeypatch):
    monkeypatch.setattr(nd, "SALT", 16)
    monkeypatch.setattr(nd, "BLOCK", 100)
    monkeypatch.setattr(nd, "BROADCAST_ROWS", 0 if t == 0.5 else 1_000_000)
    rows = family(1, 90) + [(i + 100, x) for i, x in family(2, 40)] + [(200, "a b c d e"), (201, None), (202, "...")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, _ = wanted(rows, 3, t)
    assert links(docs, 3, t) == want
    assert sorted(r.doc_id for r in nd.dedup(docs, 3, t).collect()) == sorted({c for _, c, _ in want})


def test_crowds_leave_few_pairs(spark):
    rows = [(i, x) for i, x in family(3, 200) if i % 7 and i % 11 != 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = {use: nd._found(docs, 3, 0.5, "doc_id", "text", use)[2].count() for use in ("pairs", "links", "classes")}
    assert made["classes"] <= len(rows) and made["links"] < 0.5 * made["pairs"]


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows.sort()
    want, near = wanted(rows, nd.N, nd.THRESHOLD)
    assert links(docs) == want and pairs(docs) == near
    assert {r.doc_id for r in nd.dedup(docs).collect()} == {c for _, c, _ in want}


def test_a_small_frequent_list_loses_nothing(spark, sf, monkeypatch):
    monkeypatch.setattr(nd, "FREQUENT", 1)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert links(docs) == wanted(sorted((r.doc_id, r.text) for r in docs.collect()), nd.N, nd.THRESHOLD)[0]


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr(nd, "BROADCAST_ROWS", few)
    random.seed(5)
    edges = [(random.randrange(80), random.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(20)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for x in sorted(near):
        if x not in want:
            todo = [x]
            while todo:
                y = todo.pop()
                if y not in want:
                    want[y] = x
                    todo += near[y]
    got = {r.k: r.comp for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if near[k] - {k}}


def test_awkward(spark):
    d = awkward(spark)
    assert links(d) == sorted([(1, 1, 1), (2, 1, 1), *[(i, i, 0) for i in (3, 4, 5, 6, 7, 8, 8, None, None)]], key=str)
    assert pairs(d) == set()
    left = nd.dedup(d)
    assert left.columns == d.columns and sorted(r.n for r in left.collect()) == [0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert pairs(empty(spark)) == set() and links(empty(spark)) == [] and nd.dedup(empty(spark)).count() == 0
