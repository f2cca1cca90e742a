import random

import pytest

from textloom.llm import matroska as M

from .fixtures import ROWS, awkward, empty


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    media = {r.doc_id: bytes(r.media) for r in M.as_media(docs).collect()}
    lines: dict = {}
    for r in M.packets(M.as_media(docs)).collect():
        if r.track == 1:
            assert r.codec == "S_TEXT/UTF8" and r.track_type == "subtitle"
            lines.setdefault(r.doc_id, []).append((r.timestamp_ns, media[r.doc_id][r.byte_start : r.byte_end].decode()))
    for r in docs.collect():
        assert lines[r.doc_id] == [(i * 10**9, x) for i, x in enumerate(r.text.split("\n"))]


@pytest.mark.parametrize("kind", [0, 1, 2, 3])
def test_lacing(kind):
    random.seed(kind)
    for _ in range(200):
        n = 1 if kind == 0 else random.randint(1, 9)
        size = random.randrange(400)
        frames = [random.randbytes(size if kind == 2 else random.choice((0, 1, 60, 64, 127, 255, 256, 510, 70_000))) for _ in range(n)]
        b = M.laced(frames, kind)
        assert [b[s:e] for s, e in M.lace(b, 0, len(b), kind)] == frames


def test_unknown_sizes_and_groups():
    cluster = lambda t: M.element(M.CLUSTER, M.number(M.TIME, t) + M.element(M.SIMPLE, M.block(3, -2, [b"ab"], 0, True)) + M.element(M.GROUP, M.element(M.BLOCK, M.block(1, 5, [b"x", b"yz"], 1)) + M.number(M.BLOCK_DURATION, 8) + M.element(M.REFERENCE, b"\xff")), unknown=True)
    tracks = M.element(M.TRACKS, M.element(M.ENTRY, M.number(M.NUMBER, 3) + M.number(M.TYPE, 1) + M.element(M.CODEC, b"V_X")))
    b = M.element(M.EBML, b"") + M.element(M.SEGMENT, M.element(M.INFO, M.number(M.SCALE, 1000)) + tracks + cluster(10) + cluster(20), unknown=True)
    m = M.parse(b)
    assert m.fault is None and m.scale == 1000 and m.tracks[3]["type"] == "video"
    assert [(p.track, p.time, p.duration, p.key, b[p.start : p.end]) for p in m.packets] == [(3, 8000, None, True, b"ab"), (1, 15000, 4000, False, b"x"), (1, 19000, 4000, False, b"yz"), (3, 18000, None, True, b"ab"), (1, 25000, 4000, False, b"x"), (1, 29000, 4000, False, b"yz")]


def test_cues():
    b = M.timed_text("\n".join(f"line {i}" for i in range(70)))
    rows = M.rows_of(1, b)
    assert [(r[1], r[5] // 10**9) for r in rows if r[12]] == [(1, 0), (2, 0), (1, 32), (2, 32), (1, 64), (2, 64)]


def test_damage():
    b = M.timed_text("a b\nc d\n" * 20)
    whole = M.rows_of(1, b)
    for n in range(len(b)):
        rows = M.rows_of(1, b[:n])
        assert [r[:11] for r in rows] == [r[:11] for r in whole[: len(rows)]]
    random.seed(1)
    for _ in range(500):
        x = bytearray(b)
        x[random.randrange(len(x))] = random.randrange(256)
        M.rows_of(1, bytes(x))
    assert M.rows_of(1, b"") == M.rows_of(1, b"no media") == []


def packets_of(*files):
    """The packet tables as the executors make them."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(files)), pa.int64()), pa.array(files, pa.binary())], names=["id", "b"])
    return [r for out in M._run(iter([batch])) for r in out.to_pylist()]


def test_numbers_of_any_size():
    """Whatever a file claims, it is read to its fault and no other file suffers."""
    good = M.timed_text("a b\nc d")
    one = M.element(M.SIMPLE, M.block(1, 1, [b"x"], 0))
    file = lambda *parts: M.element(M.EBML, b"") + M.element(M.SEGMENT, b"".join(parts))
    cluster = lambda *parts: M.element(M.CLUSTER, b"".join(parts))
    huge, long = b"\xff" * 8, b"\1" * 20
    bad = [
        file(cluster(M.element(M.TIME, huge), one)),
        file(M.element(M.INFO, M.element(M.SCALE, huge)), cluster(M.number(M.TIME, 5), one)),
        file(cluster(M.number(M.TIME, 5), M.element(M.GROUP, M.element(M.BLOCK, M.block(1, 0, [b"x"], 0)) + M.element(M.BLOCK_DURATION, huge)))),
        file(cluster(M.element(M.TIME, long), one)),
        file(cluster(M.element(M.SIMPLE, M.block(2**40, 1, [b"x"], 0)))),
        file(M.element(M.TRACKS, M.element(M.ENTRY, M.element(M.NUMBER, huge) + M.element(M.DEFAULT, huge))), cluster(one)),
        file(cluster(one)) + M.element(M.SEGMENT, M.element(M.INFO, M.element(M.DURATION, b"\0" * 8)))[:-3],
        file(cluster(one), M.element(M.CUES, M.element(M.POINT, M.element(M.CUE_TIME, long)))),
    ]
    rows = packets_of(*bad, good)
    assert [r for r in rows if r["doc_id"] == len(bad)] == [{**r, "doc_id": len(bad)} for r in packets_of(good)]
    by = {i: [r for r in rows if r["doc_id"] == i] for i in range(len(bad))}
    assert [len(x) for x in by.values()] == [1, 1, 1, 0, 1, 1, 1, 1]
    assert [by[i][0]["timestamp_ns"] for i in (0, 1, 2)] == [None, None, 5_000_000] and by[2][0]["duration_ns"] is None and by[4][0]["track"] == 2**40


def test_info_and_tracks_after_the_clusters():
    cluster = M.element(M.CLUSTER, M.number(M.TIME, 10) + M.element(M.SIMPLE, M.block(1, 0, [b"ab", b"cd"], 2)))
    late = M.element(M.INFO, M.number(M.SCALE, 1000)) + M.element(M.TRACKS, M.element(M.ENTRY, M.number(M.NUMBER, 1) + M.number(M.TYPE, 2) + M.number(M.DEFAULT, 7)))
    head = M.element(M.EBML, b"")
    (a, b), (c, d) = packets_of(head + M.element(M.SEGMENT, cluster + late)), packets_of(head + M.element(M.SEGMENT, late + cluster))
    assert (a["timestamp_ns"], b["timestamp_ns"], a["duration_ns"], a["track_type"]) == (10_000, 10_007, 7, "audio")
    assert [{**x, "byte_start": 0, "byte_end": 0} for x in (a, b)] == [{**x, "byte_start": 0, "byte_end": 0} for x in (c, d)]
    # a second segment has a scale of its own
    assert [r["timestamp_ns"] for r in packets_of(head + M.element(M.SEGMENT, cluster + late) + M.element(M.SEGMENT, cluster))] == [10_000, 10_007, 10_000_000, 10_000_000]


def test_random_bytes():
    random.seed(2)
    b = M.timed_text("a b\nc d\n" * 12)
    files = []
    for _ in range(1500):
        x = bytearray(b)
        for _ in range(random.randrange(1, 6)):
            x[random.randrange(len(x))] = random.choice((0, 1, 8, 127, 128, 255, random.randrange(256)))
        files.append(bytes(x))
    assert packets_of(*files)


def test_awkward(spark):
    got = M.packets(M.as_media(awkward(spark)))
    texts = [t for _, t, _ in ROWS if t is not None]
    assert got.where("track = 1").count() == sum(len(t.split("\n")) for t in texts)
    assert M.packets(M.as_media(empty(spark))).count() == 0
