import gzip
import io
import lzma
import struct
import tarfile
import zipfile

from pyspark.sql import functions as F

from textloom.functions.dom import parse, select
from textloom.operators import html
from textloom.sources import files, resources


def test_tsv_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a", "k", "-en", "x\ty\nz"), ("a", "abc_k", "", "v")], files.TSV)
    for c in ("none", "gzip"):
        files.write_tsv(d, f"{tmp_path}/{c}", c)
        assert [tuple(r) for r in files.read_tsv(spark, f"{tmp_path}/{c}").collect()] == [("a", "k", "-en", "x&#09;y&#10;z")]
    (tmp_path / "x.gz").write_bytes(gzip.compress(b"bad row\n\na\tk\tl\tv\tw\n"))
    assert [r.value for r in files.read_tsv(spark, f"{tmp_path}/x.gz").collect()] == ["v\tw"]


def test_pages(spark, tmp_path):
    (tmp_path / "p").write_text("<a></html><b></html>rest")
    assert [r.html for r in files.read_pages(spark, f"{tmp_path}/p").collect()] == ["<a></html>", "<b></html>", "rest</html>"]


def test_small_text_files(spark, tmp_path):
    (tmp_path / "seen").write_text(" a \nb\na\n")
    assert sorted(r.name for r in files.read_seen(spark, f"{tmp_path}/seen").collect()) == ["a", "b"]
    (tmp_path / "x.properties").write_text("# no\na = 1\nb=c = d\n")
    r = files.read_properties(spark, f"{tmp_path}/x.properties").first()
    assert (r.file, r.properties) == ("x.properties", {"a": "1", "b": "c = d"})
    (tmp_path / "v").write_text("2 3\nfoo 1 2 3\nbar 0.5 0 1 \n")
    assert {r.word: r.vector for r in files.read_word_vectors(spark, f"{tmp_path}/v").collect()} == {"foo": [1, 2, 3], "bar": [0.5, 0, 1]}


def test_records(spark, tmp_path):
    rows = [(1, 2, 3), (4, 5, -6)]
    d = spark.createDataFrame(rows, "doc int, term int, cnt int").coalesce(1)
    data = files.record_bytes(d, "bag").first()["bytes"]
    assert data == b"".join(struct.pack("<3i", *r) for r in rows)
    (tmp_path / "b.bin").write_bytes(data + b"xx")
    assert [tuple(r) for r in files.read_records(spark, f"{tmp_path}/b.bin", "bag").collect()] == rows


def test_archives(spark, tmp_path):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:xz") as t:
        t.addfile(tarfile.TarInfo("d"), None)
        i = tarfile.TarInfo("a.apk")
        i.size = 3
        t.addfile(i, io.BytesIO(b"abc"))
        x = tarfile.TarInfo("dir")
        x.type = tarfile.DIRTYPE
        t.addfile(x)
    (tmp_path / "p.tpxz").write_bytes(tar.getvalue())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/q.apk").write_bytes(b"q")
    got = {(r.name, bytes(r.data)) for r in files.read_packages(spark, str(tmp_path)).collect()}
    assert got == {("d", b""), ("a.apk", b"abc"), ("q.apk", b"q")}
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("m", "Main: 1\n\nName: x\nA: b\n c\n")
    d = spark.createDataFrame([(bytearray(z.getvalue()),), (bytearray(b"no zip"),)], "b binary")
    rows = d.select(files.zip_entry(F.col("b"), "m").alias("e")).collect()
    assert rows[0].e is not None and rows[1].e is None
    m = d.select(files.manifest(files.zip_entry(F.col("b"), "m").cast("string")).alias("m")).first()["m"]
    assert m == {"": {"Main": "1"}, "x": {"Name": "x", "A": "bc"}}
    assert bytes(spark.createDataFrame([(bytearray(lzma.compress(b"hi")),)], "b binary").select(files.unxz(F.col("b")).alias("x")).first()["x"]) == b"hi"


def pool(items, utf8=True):
    data, offs = b"", []
    for s in items:
        offs.append(len(data))
        e = s.encode() if utf8 else s.encode("utf-16-le")
        data += bytes([len(s), len(e)]) + e + b"\0" if utf8 else struct.pack("<H", len(s)) + e + b"\0\0"
    data += b"\0" * (-len(data) % 4)
    start = 28 + 4 * len(items)
    return struct.pack("<HHI5I", 1, 28, start + len(data), len(items), 0, 0x100 if utf8 else 0, start, 0) + struct.pack(f"<{len(items)}I", *offs) + data


def table(strings, locale=b"\0\0\0\0", keys=("title",)):
    config = struct.pack("<I", 64) + b"\0" * 4 + locale + b"\0" * 52
    types, names = pool(["string"], False), pool(list(keys))
    head = 20 + 64
    entries = b"".join(struct.pack("<HHIHBBI", 8, 0, i, 8, 0, 3, i) for i in range(len(strings)))
    offs = struct.pack(f"<{len(strings)}I", *[16 * i for i in range(len(strings))])
    start = head + len(offs)
    kind = struct.pack("<HHI", 0x201, head, start + len(entries)) + bytes([1, 0, 0, 0]) + struct.pack("<II", len(strings), start) + config + offs + entries
    body = types + names + kind
    package = struct.pack("<HHII", 0x200, 288, 288 + len(body), 127) + b"\0" * 256 + struct.pack("<5I", 288, 1, 288 + len(types), len(keys), 0) + body
    values = pool(strings)
    return struct.pack("<HHII", 2, 12, 12 + len(values) + len(package), 1) + values + package


def test_resource_strings(spark):
    t = table(["Hallo", "Welt"], b"deAT", ("hello", "world"))
    d = spark.createDataFrame([(bytearray(t),), (bytearray(b"junk"),), (None,)], "b binary")
    rows = d.select(resources.resource_strings(F.col("b")).alias("s")).collect()
    assert [tuple(x) for x in rows[0].s] == [("hello", "Hallo", "-de-rAT"), ("world", "Welt", "-de-rAT")]
    assert rows[1].s == [] and rows[2].s is None


def test_qualifiers():
    c = bytearray(64)
    struct.pack_into("<HH", c, 4, 310, 4)
    c[8:12] = b"enUS"
    c[12] = 2
    struct.pack_into("<H", c, 14, 480)
    struct.pack_into("<H", c, 24, 21)
    struct.pack_into("<H", c, 30, 600)
    assert resources.qualifiers(bytes(c)) == "-mcc310-mnc04-en-rUS-sw600dp-land-xxhdpi-v21"


PAGE = '<div id=a class="x y"><p>one<p>two<ul><li><a href="/1?h=800">L1</a><li>b<li>c</ul><script>var k=1</script></div><div>t</div>'


def test_selectors():
    root = parse(PAGE)
    tags = lambda s: [e.text() or e.tag for e in select(root, s)]
    assert tags(["tag", "p"]) == ["one", "two"]
    assert tags(["and", ["tag", "li"], ["nth", 0, 2]]) == ["b"]
    assert tags(["and", ["tag", "li"], ["nth", 2, 1]]) == ["L1", "c"]
    assert tags(["path", ["class", "Y"], ["tag", "ul"], ["tag", "li"], ["tag", "a"]]) == ["L1"]
    assert tags(["path", ["class", "y"], ["tag", "a"]]) == []
    assert tags(["any-path", ["id", "a"], ["tag", "a"]]) == ["L1"]
    assert tags(["and", ["tag", "li"], ["next", ["has", ["tag", "a"]]]]) == ["b"]
    assert tags(["and", ["tag", "li"], ["after", ["has", ["tag", "a"]]]]) == ["b", "c"]
    assert len(select(root, ["any-pos", ["tag", "ul"]])) == 5
    assert tags(["and", ["tag", "div"], ["not", ["attr", "id"]]]) == ["t"]
    assert len(select(root, ["data", "k=1"])) == 2
    for op, v in (("attr^", "/1"), ("attr$", "=800"), ("attr*", "h="), ("attr~", r"h=\d+"), ("attr=", "/1?h=800")):
        assert tags([op, "href", v]) == ["L1"]
    assert tags(["and", ["tag", "a"], ["attr!=", "href", "x"]]) == ["L1"]
    assert tags(["or", ["own-text", "two"], ["attr-starts", "hre"]]) == ["two", "L1"]
    assert [e.tag for e in select(root, ["root"])] == ["div", "div"]
    assert tags(["parent", ["tag", "li"]]) == ["L1"]


def store_page():
    """A page with the parts that records are read from, each beside a part that looks like it."""
    shot = lambda i: f'<a target="_blank" href="/s{i}.jpg?h=800"><img src="/s{i}.jpg?h=355"></a>'
    row = lambda k, v: f"<p><strong>{k}</strong> {v}</p>"
    version = lambda n, *rows: f'<li><a href="/download/{n}">get</a><div class="ver-info"><div class="ver-info-m">{"".join(rows)}<p><a href="/x"><strong>Signature:</strong></a> no</p></div></div></li>'
    return (
        '<html><head><meta property="og:url" content="https://store.example/keep/com.keep.app"><meta property="og:title" content="no"></head><body>'
        '<div class="title-like"><h1>Not this</h1></div><div class="box"><dl class="ny-dl"><dt><div class="icon"><img src="/icon.png"></div></dt>'
        '<dd><div class="title-like"><h1> Keep </h1></div><div class="ny-down"><a class="da" href="/keep/download">Get</a></div></dd></dl></div>'
        '<div itemtype="http://schema.org/Organization"><a href="/developer/Keep%20Studio"><span>Keep Studio</span></a></div>'
        '<div id="describe"><div><div>All of it.<br>More.</div></div></div>'
        '<div class="additional"><p>Category:</p></div>'
        '<ul class="list"><li><div class="additional"><ul><li><p>x</p></li></ul></div></li></ul>'
        '<div class="additional"><ul><li><div><a title="Download more apps" href="/tools"><span>Free</span><span>Tools</span></a></div></li></ul></div>'
        '<a ga="get_it_on_play" href="https://play.example/keep"></a><a target="_blank" href="/no"><img src="/no?h=350"></a>'
        f'<div class="describe"><div class="describe-img">{shot(0)}{shot(1)}</div></div>'
        f'<ul class="ver-wrap">{version(24, row("Signature:", "ea1d"), row("File SHA1:", "5083"), row("Update on:", "December 11, 2017"), row("Requires Android:", "Android 4.0.3+"), row("File Size:", "11.3 MB"), row("Odd:", "x"))}{version(18)}</ul>'
        "</body></html>"
    )


def test_records_of_pages(spark):
    d = spark.createDataFrame([(store_page(),), (None,)], "h string")
    r = d.select(html.record(F.col("h"), html.STORE_PAGE).alias("r"), html.versions(F.col("h"), *html.STORE_VERSIONS).alias("v"), html.bullet_map(F.lit("• a: 1\n• a: 2\n• b: c")).alias("m")).collect()
    assert r[0].r.asDict() == {
        "thumbnail_url": "/icon.png", "url": "https://store.example/keep/com.keep.app", "artifact_name": "com.keep.app", "title": "Keep", "author_name": "Keep Studio", "author_url": "/developer/Keep%20Studio",
        "download_url": "/keep/download", "description": "All of it. More.", "category_url": "/tools", "category_tags": ["Free", "Tools"], "appstore_links": ["https://play.example/keep"],
        "snapshot_image_urls_800": ["/s0.jpg?h=800", "/s1.jpg?h=800"], "screenshot_image_urls_350": ["/s0.jpg?h=355", "/s1.jpg?h=355"],
    }
    assert r[1].r is None
    v = r[0].v[0]
    assert (v.url, v.signature, v.file_sha1, v.android_version, v.file_size, str(v.updated_on), v.extra) == ("/download/24", "ea1d", "5083", "Android 4.0.3+", "11.3 MB", "2017-12-11 00:00:00", {"Odd": "x"})
    assert r[0].v[1].url == "/download/18" and r[0].v[1].updated_on is None
    assert r[0].m == {"a": "2", "b": "c"}
    p = spark.range(1).select(html.proxies(F.lit("x 1.2.3.4:80 y 5.6.7.8:3128")).alias("p")).first()["p"]
    assert [(x.host, x.port) for x in p] == [("1.2.3.4", 80), ("5.6.7.8", 3128)]


def test_styles():
    assert resources.styled("a < b c", [("b", 0, 0), ("i", 0, 4), ("a;href=x", 6, 6)]) == '<i><b>a</b> &lt; b</i> <a href="x">c</a>'
    data = b"\x03\x03abc\0" + b"\x01\x01b\0" + b"\0\0"
    start = 28 + 4 * 3
    spans = struct.pack("<4I", 1, 0, 1, 0xFFFFFFFF)
    chunk = struct.pack("<HHI5I", 1, 28, start + len(data) + len(spans), 2, 1, 0x100, start, start + len(data)) + struct.pack("<3I", 0, 6, 0) + data + spans
    assert resources.string_pool(chunk, 0) == ["abc", "b"] and resources.string_styles(chunk, 0) == [[("b", 0, 1)]]


def test_points_and_logs(spark, tmp_path):
    files.write_points(spark.createDataFrame([(5, 9), (4, 8), (6, 8)], "x long, y long"), f"{tmp_path}/p")
    assert [(r.x, r.y) for r in spark.read.parquet(f"{tmp_path}/p/points").orderBy("z").collect()] == [(4, 8), (5, 9), (6, 8)]
    assert tuple(spark.read.parquet(f"{tmp_path}/p/extent").first()) == (6, 4, 9, 8)
    for _ in range(2):
        files.append_log(spark.range(1), f"{tmp_path}/l")
    assert spark.read.parquet(f"{tmp_path}/l").count() == 2
    assert spark.range(1).select(F.lit(None).cast(resources.SIGNATURE), F.lit(None).cast(resources.CODE_CLASS)).count() == 1
