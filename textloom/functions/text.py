"""Text functions as native column expressions; the cleaner works on the bytes of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = r"[ \t\n\x0b\r\x00]"
BAD_KEYS = ("common_", "abc_", "com_facebook_", "mr_controller_")
MAX_LINE = 100_000


def strips(size: np.ndarray, most: int = 1 << 20):
    """(first, past the last) of rows that follow each other and have ``most`` bytes together, or one row that has more."""
    end = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD, _BLANK, _SINGLE, _REST = range(4)  # kinds of bytes; _REST: those after the first of a character
_KIND = bytes(_REST if 0x80 <= b < 0xC0 else _BLANK if b in b" \t\n\x0b\r\x00" else _WORD if b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789',&#;" else _SINGLE for b in range(256))


def clean_bytes(values: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cleaner over rows that follow each other and have ``size`` bytes each: their bytes and sizes."""
    raw = values.tobytes()
    v, k = np.frombuffer(raw.translate(_LOW), np.uint8).copy(), np.frombuffer(raw.translate(_KIND), np.uint8)
    first = np.concatenate(([0], np.cumsum(size)))
    starts = np.zeros(len(v) + 1, bool)
    starts[first] = True
    blank = k == _BLANK
    v[blank] = 32
    gone = np.zeros(len(v), bool)
    gone[:-1] = blank[:-1] & blank[1:] & ~starts[1:-1]  # of a run of blanks the last one stays
    more = np.zeros(len(v), bool)
    more[1:] = ((k[1:] == _SINGLE) & ~blank[:-1] | (k[1:] == _WORD) & (k[:-1] >= _SINGLE)) & ~starts[1:-1]
    at, drop = np.flatnonzero(more), np.flatnonzero(gone)
    out = np.insert(v, at, 32)[np.insert(~gone, at, True)] if len(drop) else np.insert(v, at, 32)
    return out, np.diff(first + np.searchsorted(at, first) - np.searchsorted(drop, first))


def _cleaned(texts: pa.Array):
    """The bytes and sizes of cleaned rows, by strips; nulls as empty rows."""
    t = texts.cast(pa.large_binary())
    if t.null_count:
        t = t.fill_null(b"")
    _, off, val = t.buffers()
    offsets = np.frombuffer(off, np.int64)[t.offset : t.offset + len(t) + 1] if len(t) else np.zeros(1, np.int64)
    values, size = np.frombuffer(val, np.uint8) if val is not None else np.zeros(0, np.uint8), np.diff(offsets)
    for i, j in strips(size):
        yield clean_bytes(values[offsets[i] : offsets[j]], size[i:j])


def _clean(texts: pa.Array) -> pa.Array:
    parts, sizes = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)]
    for out, n in _cleaned(texts):
        parts.append(out)
        sizes.append(n)
    ends = np.cumsum(np.concatenate(sizes))
    a = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(np.concatenate(parts)))
    out = a.cast(pa.string())
    return pc.if_else(texts.is_null(), pa.scalar(None, pa.string()), out) if texts.null_count else out


def clean_tokens(text: Column) -> Column:
    """Lower ASCII letters, make every other character than ``0-9 a-z ' , & # ;`` a token of its own, and put single spaces
    between tokens. A single space at either end stays. Not for use within lambda functions."""
    return F.arrow_udf(_clean, "string")(text)


def has_tokens(text: Column) -> Column:
    """Whether anything but blanks is left of a text when it is cleaned, told without cleaning it."""
    return text.rlike(BLANK.replace("[", "[^"))


def words(text: Column) -> Column:
    """The tokens of a text."""
    return F.filter(F.split(clean_tokens(text), " "), lambda x: x != "")


def _word_counts(texts: pa.Array) -> pa.Array:
    sums = [np.zeros((3, 0), np.int64)]
    for out, size in _cleaned(texts):
        row, word = np.repeat(np.arange(len(size)), size), out != 32
        head = word.copy()
        head[1:] &= ~word[:-1] | (row[1:] != row[:-1])
        at = np.concatenate((np.flatnonzero(head[word]), [np.count_nonzero(word)]))  # within the bytes of the words alone
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(out[word])]).dictionary_encode()
        kinds = max(1, len(words.dictionary))
        own, count = np.unique(row[head] * kinds + words.indices.to_numpy(), return_counts=True)
        total, squares = np.zeros((2, len(size)), np.int64)
        np.add.at(total, own // kinds, count)
        np.add.at(squares, own // kinds, count * count)
        sums.append(np.stack([np.bincount(own // kinds, minlength=len(size)), total, squares]))
    return pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(sums, axis=1)], ["n", "total", "squares"])


def word_counts(text: Column) -> Column:
    """(n, total, squares) of how often a text's different tokens occur: how many they are, the sum and the sum of squares."""
    return F.arrow_udf(_word_counts, "struct<n:long,total:long,squares:long>")(text)


def clean_last(row: Column, columns: int) -> Column:
    """Clean what follows the first ``columns`` tab-separated fields of a row; the fields stay as they are, and so does a
    row with nothing after them."""
    if columns == 0:
        return clean_tokens(row)
    head = F.substring_index(row, "\t", columns)
    tail = F.substr(row, F.length(head) + 2)
    return F.when(F.length(head) == F.length(row), row).otherwise(F.concat(head, F.lit("\t"), clean_tokens(tail)))


def tab_split_point(row: Column, n: int) -> Column:
    """Bytes before the n-th tab (the first is 1), or the bytes of a row that has fewer."""
    return F.octet_length(F.substring_index(row, "\t", n))


def sanitize(text: Column) -> Column:
    """Tabs and line feeds as character references, so that a text fits a field of a TSV row."""
    return F.replace(F.replace(text, F.lit("\t"), F.lit("&#09;")), F.lit("\n"), F.lit("&#10;"))


def xml_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def bad_key(key: Column) -> Column:
    """Whether a resource name comes from a common library."""
    out = F.lit(False)
    for k in BAD_KEYS:
        out = out | F.contains(key, F.lit(k))
    return out


def ascii_only(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def latin_only(text: Column) -> Column:
    """Whether all letters are of the Latin script."""
    return ~text.rlike(r"[\p{L}&&[^\p{IsLatin}]]")


def english_locale(locale: Column) -> Column:
    """Whether a qualifier is the default or an English one."""
    t = F.trim(locale)
    return (t == "") | t.startswith("-en")


def line_fits(line: Column) -> Column:
    """Whether a line without its end has 1 to 100,000 bytes with it."""
    return F.octet_length(line) + 1 <= MAX_LINE


def fix_rows(text: Column, fields: int = 4) -> Column:
    """The rows of a TSV text whose values may contain line feeds: a line feed ends a row only after
    ``fields`` - 1 tabs; any other becomes the two characters ``\\n``."""
    row = r"(?:[^\t]*\t){%d}[^\t\n]*\n" % (fields - 1)
    found = F.regexp_extract_all(F.concat(F.regexp_replace(text, r"\n\z", ""), F.lit("\n")), F.lit(f"({row})"), 1)
    return F.transform(found, lambda x: F.replace(F.substr(x, F.lit(1), F.length(x) - 1), F.lit("\n"), F.lit("\\n")))


def url_parameter(url: Column, name: str) -> Column:
    """A decoded parameter of a URL's query, null if missing."""
    return F.url_decode(F.parse_url(url, F.lit("QUERY"), F.lit(name)))


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def host_port(line: Column) -> Column:
    """``host:port`` as a struct, null if the port is no number."""
    p = F.split(line, ":")
    port = F.try_element_at(p, F.lit(2)).try_cast("int")
    return F.when(port.isNotNull(), F.struct(F.element_at(p, 1).alias("host"), port.alias("port")))


def xor_fold(expression: Column) -> Column:
    """The value of ``a^b^c``."""
    return F.aggregate(F.split(expression, r"\^"), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x.cast("long")))


def xor_value(expression: Column, constants: Column) -> Column:
    """The value of ``a^b^3``, names being looked up in a map of constants."""
    return F.aggregate(F.split(expression, r"\^"), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(F.coalesce(constants[F.trim(x)], F.trim(x).try_cast("long"))))


def xor_constants(script: Column) -> Column:
    """The constants of a script ``a=1;b=a^2;``, each of which may use those before it."""

    def add(known: Column, line: Column) -> Column:
        name = F.trim(F.substring_index(line, "=", 1))
        value = xor_value(F.substr(line, F.locate("=", line) + 1), known)
        return F.map_concat(F.map_filter(known, lambda k, _: k != name), F.create_map(name, value))

    lines = F.filter(F.split(script, ";"), lambda x: F.contains(x, F.lit("=")))
    return F.aggregate(lines, F.expr("cast(map() as map<string,bigint>)"), add)


def xor_digits(expressions: Column, constants: Column) -> Column:
    """The number whose decimal digits are the values of ``+(a^b)+(c^d)``."""
    parts = F.filter(F.split(F.regexp_replace(expressions, r"[()\s]", ""), r"\+"), lambda x: x != "")
    # the constants are a list's only item, so that they are found once for a row and not at every name
    number = lambda known: F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n * 10 + xor_value(x, known))
    return F.element_at(F.transform(F.array(constants), number), 1)


def flag_names(flags: Column, names: list[tuple[int, str]]) -> Column:
    """The names of the bits that are set, in order of their masks; a bit may have several."""
    every = F.array(*[F.when(flags.bitwiseAND(F.lit(m)) != 0, F.lit(n)) for m, n in names])
    return F.array_compact(every)


#: Access flags; what the bits 0x40 and 0x80 mean depends on whether they are a field's or a method's.
ACCESS = [(0x1, "public"), (0x2, "private"), (0x4, "protected"), (0x8, "static"), (0x10, "final"), (0x20, "synchronized"), (0x40, "volatile"), (0x40, "bridge"), (0x80, "transient"), (0x80, "varargs"), (0x100, "native"), (0x200, "interface"), (0x400, "abstract"), (0x800, "strictfp"), (0x1000, "synthetic"), (0x2000, "annotation"), (0x4000, "enum"), (0x10000, "constructor"), (0x20000, "declared-synchronized")]
VISIBILITY = {0: "build", 1: "runtime", 2: "system"}
VALUE_TYPES = {0x00: "byte", 0x02: "short", 0x03: "char", 0x04: "int", 0x06: "long", 0x10: "float", 0x11: "double", 0x17: "string", 0x18: "type", 0x19: "field", 0x1A: "method", 0x1B: "enum", 0x1C: "array", 0x1D: "annotation", 0x1E: "null", 0x1F: "boolean"}


def enum_name(value: Column, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def size_bytes(size: Column) -> Column:
    """``"11.3 MB"`` as bytes, null if it is no size."""
    n = F.regexp_extract(size, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*[KMGT]?B\s*$", 1)
    unit = F.regexp_extract(size, r"([KMGT]?)B\s*$", 1)
    scale = F.when(unit == "K", 1024.0).when(unit == "M", 1024.0**2).when(unit == "G", 1024.0**3).when(unit == "T", 1024.0**4).otherwise(1.0)
    return F.when(n != "", F.round(n.try_cast("double") * scale)).cast("long")


DATE_FORMATS = ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "MM/dd/yyyy", "yyyy/MM/dd")
_DATE = r"(?i)(\d{4}[-/]\d{1,2}[-/]\d{1,2}|[a-z]{3,9} \d{1,2}, \d{4}|\d{1,2} [a-z]{3,9} \d{4}|\d{1,2}/\d{1,2}/\d{4})"


def first_date(text: Column) -> Column:
    """The first date in a text, in one of the known formats."""
    found = F.regexp_extract(text, _DATE, 1)
    return F.coalesce(*[F.try_to_timestamp(found, F.lit(f)) for f in DATE_FORMATS])


def locale_parts(qualifier: Column) -> Column:
    """Language, script, region and variant of ``-ll``, ``-ll-rRR`` or ``-b+ll+Script+RR+VARIANT``."""
    b = F.split(F.regexp_extract(qualifier, r"^-b\+([A-Za-z0-9+]+)", 1), r"\+")
    is_b = qualifier.startswith("-b+")
    pick = lambda p: F.try_element_at(F.filter(F.slice(b, 2, 8), lambda x: x.rlike(p)), F.lit(1))
    empty = lambda c: F.when(c != "", c)
    return F.struct(
        F.when(is_b, F.element_at(b, 1)).otherwise(empty(F.regexp_extract(qualifier, r"^-([a-z]{2,3})(?:-|$)", 1))).alias("language"),
        F.when(is_b, pick("^[A-Za-z]{4}$")).alias("script"),
        F.when(is_b, pick("^(?:[A-Za-z]{2}|[0-9]{3})$")).otherwise(empty(F.regexp_extract(qualifier, r"^-[a-z]{2,3}-r([A-Z]{2})", 1))).alias("region"),
        F.when(is_b, pick("^[A-Za-z0-9]{5,8}$")).alias("variant"),
    )


def locale_string(language: Column, region: Column, script: Column, variant: Column) -> Column:
    """The qualifier of a locale: nothing, ``-ll``, ``-ll-rRR``, or the ``-b+`` form where script or variant call for it."""
    e = lambda c: F.coalesce(c, F.lit(""))
    plus = F.concat(F.lit("-b+"), e(language), F.when(e(script) != "", F.concat(F.lit("+"), script)).otherwise(F.lit("")), F.when(e(region) != "", F.concat(F.lit("+"), region)).otherwise(F.lit("")), F.when(e(variant) != "", F.concat(F.lit("+"), variant)).otherwise(F.lit("")))
    plain = F.when(e(language) == "", F.lit("")).otherwise(F.concat(F.lit("-"), language, F.when(e(region) != "", F.concat(F.lit("-r"), region)).otherwise(F.lit(""))))
    return F.when((e(script) != "") | (e(variant) != ""), plus).otherwise(plain)


def xml_value(text: Column) -> Column:
    """A resource value as it stands in an XML file: backslashes, quotes and leading ``# @ ?`` escaped, unprintable characters
    as ``\\uXXXX``, and quotes around values with apostrophes, line feeds or outer or double blanks."""
    x = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    x = F.when(text.rlike(r"^[#@?]"), F.concat(F.lit("\\"), x)).otherwise(x)
    for code in [*range(0, 9), 11, 12, *range(14, 32), 127]:
        x = F.replace(x, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    quote = text.rlike(r"'|\n|^ | \z|  ")
    return xml_escape(F.when(quote, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x))


def xml_attributes(xml: Column, name: str) -> Column:
    """All values of an attribute in an XML text, in document order."""
    return F.xpath(xml, F.lit(f"//@{name}"))


def merge_maps(*maps: Column) -> Column:
    """One map of several; of equal keys the last wins, whatever the session's policy."""
    entries = F.concat(*[F.coalesce(F.map_entries(m), F.expr("cast(array() as array<struct<key:string,value:string>>)")) for m in maps])
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i, F.lit(0))), lambda f: f["key"] == e["key"]))
    return F.map_from_entries(last)
