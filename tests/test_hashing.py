import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import hashing, tokens

GOLDEN = {"": 12703781685092141186, "a": 13524422541435837562, "hello": 10977463744054854246, "hello world": 8553903937312089103, "the rain in spain": 10059510146312041869, "新建总结": 10534685784323000732, "services": 2846155479254818450, ".": 6642555327136464369, "play": 13220479503003472749, "google": 15125316033552873056}


def murmur(b, seed=hashing.SEED):
    m, mask = 0xC6A4A7935BD1E995, 2**64 - 1
    h = seed ^ (len(b) * m & mask)
    for i in range(0, len(b) - len(b) % 8, 8):
        k = int.from_bytes(b[i : i + 8], "little") * m & mask
        k = (k ^ k >> 47) * m & mask
        h = (h ^ k) * m & mask
    if len(b) % 8:
        h = (h ^ int.from_bytes(b[len(b) - len(b) % 8 :], "little")) * m & mask
    h = (h ^ h >> 47) * m & mask
    return h ^ h >> 47


def test_golden():
    assert dict(zip(GOLDEN, hashing.murmur64a_array(pa.array(list(GOLDEN))).tolist())) == GOLDEN


@given(st.lists(st.binary(max_size=40), max_size=20))
def test_property(xs):
    assert hashing.murmur64a_array(pa.array(xs, pa.binary())).tolist() == [murmur(x) for x in xs]


def test_columns(spark):
    d = spark.createDataFrame([("a",), (None,), ("services",)], "s string").select("s", hashing.murmur64a(F.col("s")).alias("h"))
    rows = d.select("s", "h", hashing.unsigned_value(F.col("h")).alias("u")).orderBy(hashing.unsigned_order(F.col("h"))).collect()
    assert [(r.s, None if r.u is None else int(r.u)) for r in rows] == [(None, None), ("services", GOLDEN["services"]), ("a", GOLDEN["a"])]


def test_z_order(spark):
    points = {(1, 0): 1, (0, 1): 2, (3, 5): 39, (65535, 65535): 4294967295, (65536, 0): 0}
    d = spark.createDataFrame(list(points), "x long, y long")
    assert {(r.x, r.y): r.z for r in d.select("x", "y", hashing.z_order(F.col("x"), F.col("y")).alias("z")).collect()} == points


def test_combine(spark):
    f = lambda *x: spark.range(1).select(hashing.combine(F.array(*map(F.lit, x))).alias("h")).first()["h"]
    assert f(1, 2, 3) == f(1, 2, 3) != f(3, 2, 1)


def test_split_tokens():
    def s(x):
        b = x.encode()
        got = tokens._hash_tokens(pa.array(["before\ta b", x, None, "after"])).to_pylist()[1]
        _, at, size = tokens.split_tokens(np.frombuffer(b + b"\0" * 16, np.uint8), np.array([0]), np.array([len(b)]))
        out = [(b[i : i + n].decode(), t["offset"], t["length"]) for i, n, t in zip(at.tolist(), size.tolist(), got, strict=True)]
        assert [t["hash"] for t in got] == hashing.murmur64a_array(pa.array([t for t, _, _ in out], pa.string())).view(np.int64).tolist()
        return out

    assert s("a b c") == [("a b c", 0, 0)]
    assert s("-rgb\ta b c") == [("-rgb", 0, 4), ("a", 5, 1), ("b", 7, 1), ("c", 0, 0)]
    assert s("\tfoo bar") == [("\tfoo", 0, 4), ("bar", 0, 0)]
    assert s("k\ta  b") == [("k", 0, 1), ("a", 2, 1), (" b", 0, 0)]
    assert s("") == []


def test_hash_tokens(spark):
    r = spark.createDataFrame([("k\ta b",), (None,)], "s string").select(tokens.hash_tokens(F.col("s")).alias("t")).collect()
    assert [np.int64(np.uint64(murmur(x))) for x in (b"k", b"a", b"b")] == [t["hash"] for t in r[0].t] and r[1].t is None


def test_names(spark):
    rows = [(1, i, f"{x} google play services {y} end") for i, (x, y) in enumerate([("use", "now"), ("nutzt", "jetzt"), ("usa", "ya")])]
    rows += [(2, 0, "only one row")] + [(3, i, x) for i, x in enumerate(("foo", "bar"))]
    got = {r.g: r.texts for r in tokens.substitute_names(spark.createDataFrame(rows, "g int, n int, t string"), ["g"], ["n"], "t", drop_verbatim="tokens").collect()}
    names = [t for t in got[1][0].split() if t.startswith("$$")]
    order = sorted(["google", "play", "services", "end"], key=lambda x: GOLDEN.get(x, murmur(x.encode())))
    assert names == [f"$$propername{order.index(x)}$$" for x in ("google", "play", "services")]
    assert got[1][0].endswith("now end") and got[2] == ["only one row"] and got[3] == ["foo", "bar"]


def test_murmur3(spark):
    assert hashing.murmur3_array(pa.array(["", "test", None, "Hello, world!"])).tolist() == [0, 0xBA6BD213, 0, 0xC0363E43]
    a, b = hashing.murmur3_x64_128_array(pa.array(["", "The quick brown fox jumps over the lazy dog", "hello"]))
    assert [f"{int(x):016x}{int(y):016x}" for x, y in zip(a, b)] == ["0" * 32, "e34bbc7bbc071b6c7a433ca9c49a9347", "cbd8a7b341bd9b025b1e906a48ae1d19"]

    assert [r.h for r in spark.createDataFrame([("test",), (None,)], "s string").select(hashing.murmur3(F.col("s")).alias("h")).collect()] == [0xBA6BD213, None]


def slow_x86_128(data, seed=0):
    """The published algorithm, a step at a time."""
    m = 0xFFFFFFFF
    rot = lambda x, r: (x << r | x >> 32 - r) & m
    c, turn, after, add = (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93), (15, 16, 17, 18), (19, 17, 15, 13), (0x561CCD1B, 0x0BCAA747, 0x96CD1C35, 0x32AC3B17)
    h = [seed] * 4
    word = lambda i, k: int.from_bytes(data[16 * i + 4 * k : min(16 * i + 4 * k + 4, 16 * i + 16)], "little")
    scramble = lambda x, k: rot(x * c[k] & m, turn[k]) * c[(k + 1) % 4] & m
    for i in range(len(data) // 16):
        for k in range(4):
            h[k] ^= scramble(word(i, k), k)
            h[k] = ((rot(h[k], after[k]) + h[(k + 1) % 4]) * 5 + add[k]) & m
    for k in range(4):
        h[k] ^= scramble(word(len(data) // 16, k), k)
        h[k] ^= len(data)
    h[0] = sum(h) & m
    h = [h[0], *[(x + h[0]) & m for x in h[1:]]]
    for k in range(4):
        x = (h[k] ^ h[k] >> 16) * 0x85EBCA6B & m
        x = (x ^ x >> 13) * 0xC2B2AE35 & m
        h[k] = x ^ x >> 16
    h[0] = sum(h) & m
    return [h[0], *[(x + h[0]) & m for x in h[1:]]]


def test_murmur3_x86_128():
    texts = ["", *["abcdefghij klmnopq rstuvwxyz 0123456789"[:n] for n in range(1, 40)]]
    assert hashing.murmur3_x86_128_array(pa.array(texts)).tolist() == [slow_x86_128(t.encode()) for t in texts]


def test_tokens_are_hashed_in_strips(monkeypatch):
    rows = pa.array(["k\ta b", None, "", "x" * 3000 + "\tabc  d", "\u00e9\tq"] * 3)
    whole, seen = tokens._hash_tokens(rows).to_pylist(), []
    split = tokens.split_tokens
    monkeypatch.setattr(tokens, "split_tokens", lambda v, s, n: seen.append(len(v)) or split(v, s, n))
    monkeypatch.setattr(tokens.strips, "__defaults__", (100,))
    assert tokens._hash_tokens(rows).to_pylist() == whole and len(seen) > 5 and max(seen) < 3100


def test_long_texts_are_hashed_by_themselves(monkeypatch):
    rows = pa.array(["a" * n for n in (0, 7, 511, 512, 520, 4001)])
    one = hashing.murmur64a_array(rows)
    monkeypatch.setattr(hashing, "LONG", 10**9)
    assert (hashing.murmur64a_array(rows) == one).all()
