"""Records from web pages, by selectors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.dom import Element, parse, select
from textloom.functions.text import first_date

ELEMENTS = "array<struct<tag:string,text:string,own_text:string,attrs:map<string,string>>>"
_KIND = pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string()), ("own_text", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))]))


def html_select(html: Column, selector: list, loose: bool = True) -> Column:
    """All elements that a selector matches, in document order, with text and attributes; ``loose`` as for ``dom.parse``."""

    def run(pages: pa.Array) -> pa.Array:
        out = []
        for p in pages.to_pylist():
            out.append(None if p is None else [{"tag": e.tag, "text": e.text(), "own_text": e.own_text(), "attrs": list(e.attrs.items())} for e in select(parse(p, loose), selector)])
        return pa.array(out, _KIND)

    return F.arrow_udf(run, ELEMENTS)(html)


def first_text(html: Column, selector: list, loose: bool = True) -> Column:
    """The trimmed text of the first match, null if there is none."""
    return F.try_element_at(html_select(html, selector, loose), F.lit(1))["text"]


def attributes(html: Column, selector: list, name: str) -> Column:
    """An attribute of all matches that have it."""
    return F.array_compact(F.transform(html_select(html, selector), lambda e: e["attrs"][name]))


class Plan(dict):
    """A record's fields: name -> (selector, what), what being ``text``, ``texts``, ``attr:<name>``,
    ``attrs:<name>`` or ``last:<name>``, the last part of an attribute that is a path."""

    def schema(self) -> str:
        return "struct<" + ",".join(f"`{k}`:" + ("array<string>" if w.split(":")[0] in ("texts", "attrs") else "string") for k, (_, w) in self.items()) + ">"

    def read(self, root: Element) -> dict:
        out: dict = {}
        for k, (s, what) in self.items():
            found = select(root, s)
            kind, _, name = what.partition(":")
            values = [e.text() for e in found] if kind in ("text", "texts") else [e.attrs[name] for e in found if name in e.attrs]
            one = values[0] if values else None
            out[k] = values if kind in ("texts", "attrs") else one.rstrip("/").rpartition("/")[2] if one and kind == "last" else one
        return out


def record(html: Column, plan: Plan, loose: bool = True) -> Column:
    """One typed record per page; the page is parsed once, ``loose`` as for ``dom.parse``."""
    kind = pa.struct([(k, pa.list_(pa.string()) if w.split(":")[0] in ("texts", "attrs") else pa.string()) for k, (_, w) in plan.items()])

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else plan.read(parse(p, loose)) for p in pages.to_pylist()], kind)

    return F.arrow_udf(run, plan.schema())(html)


_MAKER = ["attr=", "itemtype", "http://schema.org/Organization"]
_CATEGORY = ["any-path", ["parent", ["parent", ["any-pos", ["class", "additional"]]]], ["and", ["tag", "a"], ["attr*", "title", "Download more"]]]
_SHOT = ["any-path", ["path", ["and", ["tag", "div"], ["class", "describe"]], ["and", ["tag", "div"], ["class", "describe-img"]]], ["and", ["tag", "a"], ["attr=", "target", "_blank"]]]
#: A store page: its fields, versions apart (``STORE_VERSIONS``).
STORE_PAGE = Plan(
    thumbnail_url=(["path", ["and", ["tag", "div"], ["class", "icon"]], ["tag", "img"]], "attr:src"),
    url=(["and", ["tag", "meta"], ["attr=", "property", "og:url"]], "attr:content"),
    artifact_name=(["and", ["tag", "meta"], ["attr=", "property", "og:url"]], "last:content"),
    title=(["and", ["path", ["and", ["tag", "div"], ["class", "title-like"]], ["tag", "h1"]], ["any-pos", ["path", ["and", ["tag", "div"], ["class", "box"]], ["and", ["tag", "dl"], ["class", "ny-dl"]]]]], "text"),
    author_name=(["any-path", _MAKER, ["tag", "span"]], "text"),
    author_url=(["path", _MAKER, ["tag", "a"]], "attr:href"),
    download_url=(["any-pos", ["path", ["and", ["tag", "div"], ["class", "ny-down"]], ["and", ["tag", "a"], ["class", "da"]]]], "attr:href"),
    description=(["path", ["id", "describe"], ["tag", "div"], ["tag", "div"]], "text"),
    category_url=(_CATEGORY, "attr:href"),
    category_tags=(["path", _CATEGORY, ["tag", "span"]], "texts"),
    appstore_links=(["any-pos", ["and", ["tag", "a"], ["attr*", "ga", "get_it_on"]]], "attrs:href"),
    snapshot_image_urls_800=(_SHOT, "attrs:href"),
    screenshot_image_urls_350=(["path", _SHOT, ["tag", "img"]], "attrs:src"),
)
#: Where a store page lists versions, and their ``name: value`` rows.
STORE_VERSIONS = (["path", ["and", ["tag", "ul"], ["class", "ver-wrap"]], ["tag", "li"]], ["and", ["path", ["class", "ver-info-m"], ["tag", "p"]], ["not", ["has", ["tag", "a"]]]])

_VERSION = {"signature": "signature", "sha1": "file_sha1", "file sha1": "file_sha1", "requires android": "android_version", "file size": "file_size", "update on": "updated_on", "updated on": "updated_on"}
VERSIONS = "array<struct<url:string,signature:string,file_sha1:string,android_version:string,file_size:string,updated_on:string,extra:map<string,string>>>"


def versions(html: Column, item: list, label: list) -> Column:
    """The versions listed on a page: of each element that ``item`` matches its link, and of the elements in it that
    ``label`` matches their ``name: value`` texts, the date as a timestamp. Names that are not known go to ``extra``."""
    names = ["url", "signature", "file_sha1", "android_version", "file_size", "updated_on"]
    kind = pa.list_(pa.struct([*[(n, pa.string()) for n in names], ("extra", pa.map_(pa.string(), pa.string()))]))

    def one(e: Element) -> dict:
        out: dict = dict.fromkeys(names)
        extra = {}
        link = [x for x in e.walk() if x.tag == "a" and "href" in x.attrs]
        out["url"] = link[0].attrs["href"] if link else None
        for x in select(e, label):
            k, sep, v = x.text().partition(":")
            if sep:
                known = _VERSION.get(k.strip().lower())
                if known:
                    out[known] = v.strip()
                else:
                    extra[k.strip()] = v.strip()
        return {**out, "extra": list(extra.items())}

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else [one(e) for e in select(parse(p), item)] for p in pages.to_pylist()], kind)

    return F.transform(F.arrow_udf(run, VERSIONS)(html), lambda v: v.withField("updated_on", first_date(v["updated_on"])))


def bullet_map(text: Column) -> Column:
    """The ``• key: value`` lines of a text as a map; of equal keys the last wins."""
    keys = F.transform(F.regexp_extract_all(text, F.lit("• ([^:\n]+):([^•\n]*)"), 1), lambda x: F.trim(x))
    values = F.transform(F.regexp_extract_all(text, F.lit("• ([^:\n]+):([^•\n]*)"), 2), lambda x: F.trim(x))
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


#: Where download links stand on file hosts' pages.
DOWNLOAD_LINKS = {
    "form": (["and", ["tag", "form"], ["attr", "action"]], "action"),
    "frame": (["and", ["tag", "iframe"], ["attr", "src"]], "src"),
    "anchor": (["and", ["tag", "a"], ["attr*", "href", "download"]], "href"),
    "button": (["any-path", ["class", "button"], ["and", ["tag", "a"], ["attr", "href"]]], "href"),
}


def download_links(html: Column, where: str) -> Column:
    """The download links of a page, by where they stand."""
    selector, name = DOWNLOAD_LINKS[where]
    return attributes(html, selector, name)


def proxies(text: Column) -> Column:
    """``host:port`` pairs of IPv4 addresses in a text."""
    found = F.regexp_extract_all(text, F.lit(r"(\d{1,3}(?:\.\d{1,3}){3}:\d{2,5})"), 1)
    return F.transform(found, lambda x: F.struct(F.substring_index(x, ":", 1).alias("host"), F.substring_index(x, ":", -1).cast("int").alias("port")))
