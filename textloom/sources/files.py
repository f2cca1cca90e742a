"""Readers and writers for the corpus's file kinds."""

from __future__ import annotations

import io
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import bad_key, sanitize

TSV = "app string, key string, locale string, value string"


# --------------------------------------------------------------------------- text files


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Rows app, key, locale, value of a TSV, plain or gzipped; rows with fewer fields are skipped, and tabs after the
    third belong to the value."""
    p = F.split("value", "\t", 4)
    return spark.read.text(path).where(F.size(p) == 4).select(*[p[i].alias(n) for i, n in enumerate(("app", "key", "locale", "value"))])


def write_tsv(df: DataFrame, path: str, compression: str = "none", drop_common: bool = True) -> None:
    """Write app, key, locale, value rows, values sanitised, without the keys of common libraries."""
    d = df.where(~bad_key(F.col("key"))) if drop_common else df
    d.select(F.concat_ws("\t", "app", "key", "locale", sanitize(F.col("value"))).alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(html): the pages of an archive of concatenated pages. Each ends with ``</html>``; what follows the last is a page too."""
    return spark.read.option("lineSep", "</html>").text(path).select(F.concat("value", F.lit("</html>")).alias("html"))


def split_pages(archive: Column) -> Column:
    """The pages in an archive held in a column."""
    parts = F.split(archive, "</html>")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.concat(x, F.lit("</html>")))


def read_seen(spark: SparkSession, path: str) -> DataFrame:
    """(name): the distinct trimmed lines of a log."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """(file, properties): each file's ``key = value`` lines as a map."""
    lines = spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value").where("value rlike '^\\\\s*[^#\\\\s][^=]*='")
    kv = F.struct(F.trim(F.substring_index("value", "=", 1)).alias("key"), F.trim(F.substr("value", F.locate("=", F.col("value")) + 1)).alias("value"))
    return lines.groupBy("file").agg(F.map_from_entries(F.sort_array(F.collect_set(kv))).alias("properties"))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of a text file of word vectors with one header line."""
    p = F.split(F.rtrim("value"), " ")
    d = spark.read.text(path).where(~F.col("value").rlike(r"^\d+ \d+\s*$")).where(F.size(p) > 1)
    return d.select(p[0].alias("word"), F.slice(p, 2, 1_000_000).cast("array<float>").alias("vector"))


def write_topic_lines(lines: DataFrame, path: str) -> None:
    """Write a topic-model trainer's input."""
    lines.orderBy("doc").select("line").write.mode("overwrite").text(path)


# --------------------------------------------------------------------------- fixed-width records

RECORDS = {"pairs": [("a", "<i8"), ("b", "<i8")], "counts": [("left", "<i8"), ("right", "<i8"), ("count", "<i8")], "bag": [("doc", "<i4"), ("term", "<i4"), ("cnt", "<i4")], "scores": [("x", "<u4"), ("y", "<u4"), ("n", "<u8")], "points": [("x", "<u4"), ("y", "<u4")]}
_SQL = {"<i8": "long", "<i4": "int", "<u4": "long", "<u8": "long"}


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The records of little-endian files: ``pairs``, ``counts`` (64-bit), ``bag`` (32-bit), ``scores`` or ``points``.
    Bytes after the last whole record are ignored."""
    fields = RECORDS[kind]
    dtype = np.dtype(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                r = np.frombuffer(x, dtype, len(x) // dtype.itemsize)
                for i in range(0, len(r), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r[n][i : i + (1 << 16)]).astype(np.int32 if t == "<i4" else np.int64)) for n, t in fields], names=[n for n, _ in fields])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, ", ".join(f"{n} {_SQL[t]}" for n, t in fields))


def record_bytes(df: DataFrame, kind: str) -> DataFrame:
    """(bytes): the rows as little-endian records, a batch at a time, in their order."""
    fields = RECORDS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, np.dtype(fields))
            for i, (n, t) in enumerate(fields):
                out[n] = b.column(i).to_numpy(zero_copy_only=False).astype(t)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["bytes"])

    return df.select(*[n for n, _ in fields]).mapInArrow(run, "bytes binary")


# --------------------------------------------------------------------------- archives

_MEMBERS = "path string, name string, data binary"


def _members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    if name.endswith((".tpxz", ".tar.xz")):
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:xz") as t:
            for m in t:
                if m.isreg():
                    yield m.name, t.extractfile(m).read()
    else:
        yield name.rsplit("/", 1)[-1], data


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, data) of every file below a folder; ``.tpxz`` archives give their regular members."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for n, d in _members(p, data):  # one member at a time
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([n]), pa.array([d], pa.binary())], names=["path", "name", "data"])

    return files.mapInArrow(run, _MEMBERS)


def unpack_tar_xz(data: bytes) -> list[tuple[str, bytes]]:
    return list(_members("x.tpxz", data))


def _unxz(col: pa.Array) -> pa.Array:
    out = []
    for x in col.to_pylist():
        try:
            out.append(None if x is None else lzma.decompress(x))
        except lzma.LZMAError:
            out.append(None)
    return pa.array(out, pa.binary())


def unxz(data: Column) -> Column:
    """Decompressed bytes, null where they are no xz stream."""
    return F.arrow_udf(_unxz, "binary")(data)


def _entry(data: bytes, name: str) -> bytes | None:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                if i.filename == name:
                    try:
                        return z.read(i)
                    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError):
                        continue  # a later entry of the name may be whole
    except (zipfile.BadZipFile, OSError):
        pass
    return None


def zip_entry(data: Column, name: str) -> Column:
    """The bytes of the first readable entry of a name in a zip, null if there is none."""

    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _entry(x, name) for x in col.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(data)


def manifest(text: Column) -> Column:
    """The sections of a manifest: section name (empty for the main one) -> attribute -> value."""

    def run(col: pa.Array) -> pa.Array:
        out = []
        for x in col.to_pylist():
            sections: dict[str, dict[str, str]] = {}
            for i, part in enumerate((x or "").replace("\r\n", "\n").replace("\n ", "").split("\n\n")):
                attrs = dict(line.split(": ", 1) for line in part.split("\n") if ": " in line)
                if attrs:
                    sections[attrs.get("Name", "") if i else ""] = attrs
            out.append(None if x is None else [(k, list(v.items())) for k, v in sections.items()])
        return pa.array(out, pa.map_(pa.string(), pa.map_(pa.string(), pa.string())))

    return F.arrow_udf(run, "map<string,map<string,string>>")(text)


def write_points(points: DataFrame, path: str) -> None:
    """Write points (x, y) in z-order of their distances from the least, and their extent beside them."""
    from textloom.functions.hashing import z_order

    extent = points.agg(F.max("x").alias("max_x"), F.min("x").alias("min_x"), F.max("y").alias("max_y"), F.min("y").alias("min_y"))
    extent.write.mode("overwrite").parquet(f"{path}/extent")
    e = points.sparkSession.read.parquet(f"{path}/extent")
    z = points.crossJoin(F.broadcast(e)).select("x", "y", z_order(F.col("x") - F.col("min_x"), F.col("y") - F.col("min_y")).alias("z"))
    z.repartitionByRange("z").sortWithinPartitions("z").write.mode("overwrite").parquet(f"{path}/points")


def append_log(rows: DataFrame, path: str) -> None:
    """Append to a manifest of what has been stored where."""
    rows.write.mode("append").parquet(path)
