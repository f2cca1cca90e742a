import random
from collections import Counter, defaultdict

from textloom.llm.packing import pack, plan

from .fixtures import ROWS, awkward, empty


def best_fit(lengths, capacity):
    packs = []
    for n in sorted(lengths, reverse=True):
        fits = [p for p in packs if p[0] >= n]
        if fits:
            min(fits)[0] -= n
        else:
            packs.append([capacity - n])
    return len(packs)


def test_plan_is_best_fit():
    random.seed(1)
    for capacity in (5, 16, 64):
        for _ in range(50):
            lengths = [random.randint(1, capacity) for _ in range(random.randrange(200))]
            rows = plan(Counter(lengths), capacity)
            used = defaultdict(list)
            for n, lo, hi, p, at in rows:
                for k in range(hi - lo):
                    used[p + k].append((at, n))
            assert Counter(n for v in used.values() for _, n in v) == Counter(lengths)
            for v in used.values():
                end = 0
                for at, n in sorted(v):
                    assert at == end
                    end += n
                assert end <= capacity
            assert len(used) == best_fit(lengths, capacity)


def placed(rows, words, capacity):
    """Every word once, no pack beyond its capacity."""
    got, packs = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.start_word, r.n_words))
        packs[r.pack_id].append((r.pack_offset, r.n_words))
    for v in packs.values():
        end = 0
        for at, n in sorted(v):
            assert at == end
            end += n
        assert end <= capacity
    for i, n in words.items():
        assert sorted(got[i]) == [(s, min(capacity, n - s)) for s in range(0, n, capacity)]
    return len(packs)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    n = placed(pack(docs, 512).collect(), words, 512)
    assert n == best_fit([min(512, w - s) for w in words.values() for s in range(0, w, 512)], 512)


def test_awkward(spark):
    rows = pack(awkward(spark), 1000).collect()
    assert sum(r.n_words for r in rows) == sum(len((t or "").split()) for _, t, _ in ROWS)
    assert Counter(r.doc_id for r in rows) == Counter({1: 1, 2: 1, 7: 60, None: 1, 8: 2})
    assert len({(r.pack_id, r.pack_offset) for r in rows}) == len(rows)
    assert pack(empty(spark)).count() == 0
