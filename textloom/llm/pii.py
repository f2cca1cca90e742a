"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Kinds: ``email``, ``card`` (Luhn, and an issuer's prefix with a length it uses; also between other numbers), ``iban`` (mod-97), ``phone``, ``ssn``, ``ip`` (octets), ``secret`` (keys and
tokens named as such). A proposal that fails its validator is dropped; one that overlaps a stronger span gives
way. A span's score is its kind's base, raised by words nearby that go with the kind and lowered by words that
speak against it; spans from ``threshold`` on are reported, with code point offsets into the whole text. Digits and letters of
these kinds are those of ASCII.

Defined results: null and empty texts have no spans; of overlapping spans of one score the kind named first above, then the one
that begins first stays; texts of any length are searched whole; repeated rows report their spans again; an empty
table gives none; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ID, TEXT, narrow

THRESHOLD = 0.5
WINDOW = 48
_PRINTED = re.compile(r"[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{4}([ \-])[0-9]{6}\2[0-9]{4,5}|[0-9]{4}([ \-])[0-9]{3}\3[0-9]{3}\3[0-9]{3}")
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    d = [int(c) for c in digits]
    return (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number (without blanks) passes the ISO 7064 mod-97 check."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


#: Issuers' prefixes with the lengths of their numbers.
_ISSUED = re.compile(r"4(?:.{12}|.{15}|.{18})|(?:5[1-5]..|222[1-9]|22[3-9].|2[3-6]..|27[01].|2720|220[0-4]).{12}|3[47].{13}|3(?:0[0-5]|[689].).{11,16}|35(?:2[89]|[3-8].).{12,15}|(?:50|5[6-8]|6.).{11,17}")


def _card(s: str) -> bool:
    d = re.sub(r"[^0-9]", "", s)
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and luhn(d) and bool(_ISSUED.fullmatch(d))


def _cards(run: str) -> list[tuple[int, int]]:
    """Where cards stand in a run of digit groups: the whole run, or windows of whole groups, those printed as cards are before others."""
    groups = [m.span() for m in re.finditer(r"[0-9]+", run)]
    got = []
    for i, (a, _) in enumerate(groups):
        n = 0
        for j in range(i, len(groups)):
            z = groups[j][1]
            n += z - groups[j][0]
            if n > 19:
                break
            if n >= 13 and _card(run[a:z]):
                got.append((z - a < len(run), not _PRINTED.fullmatch(run[a:z]), -n, a, z))
    kept: list[tuple[int, int]] = []
    taken = bytearray(len(run))
    for *_, a, z in sorted(got):
        if not any(taken[a:z]):
            taken[a:z] = b"\1" * (z - a)
            kept.append((a, z))
    return kept


def _iban(s: str) -> bool:
    c = s.replace(" ", "").upper()
    return 15 <= len(c) <= 34 and mod97(c)


def _ssn(s: str) -> bool:
    a, b, c = re.split(r"[- ]", s)
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


def _phone(s: str) -> bool:
    return 8 <= sum(c.isdigit() for c in s) <= 15


def _ip(s: str) -> bool:
    return all(int(x) < 256 and (x == "0" or x[0] != "0") for x in s.split("."))


def _secret(s: str) -> bool:
    return len(set(s)) >= 6 and any(c.isdigit() for c in s)


@dataclass(frozen=True)
class Kind:
    """``find`` proposes spans (its group 1, if any); ``check`` confirms; ``base`` is the score without context."""

    name: str
    need: str  # texts without a match of this (RE2) are not searched
    find: re.Pattern
    check: object
    base: float
    near: re.Pattern
    against: re.Pattern = re.compile(r"(?!)")


_W = lambda *words: re.compile(r"(?i)(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])")
KINDS = [
    Kind("email", "@", re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62})\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])"), None, 0.9, _W("e-?mails?", "mail", "contact", "write", "kontakt", "correo")),
    Kind("secret", r"(?i)(?:token|key|secret|passw|credential|bearer)", re.compile(r"""(?i)(?:token|key|secret|passw(?:or)?d|credentials?|bearer)["']?\s*(?:[:=]\s*|\s)["']?([A-Za-z0-9_\-+/=.]{16,})"""), _secret, 0.8, _W("token", "api", "secret", "password", "auth", "private")),
    Kind("iban", r"[A-Za-z]{2}[0-9]{2}[ 0-9A-Za-z]", re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])"), _iban, 0.85, _W("iban", "bank", "account", "konto", "cuenta", "compte")),
    Kind("card", r"[0-9][ \-]?[0-9]", re.compile(r"(?<![\w.\-])[0-9](?:[ \-]?[0-9]){12,}(?![\w\-]|\.[0-9])"), _card, 0.75, _W("card", "credit", "visa", "mastercard", "amex", "debit", "payment", "karte", "carte", "tarjeta"), _W("isbn", "serial", "order", "invoice")),
    Kind("ip", r"[0-9]\.[0-9]", re.compile(r"(?<![\w.\-])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w\-]|\.[0-9])"), _ip, 0.65, _W("ip", "address", "host", "server", "client", "login"), _W("version", "release", "section", "chapter")),
    Kind("ssn", r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}", re.compile(r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])|(?<![\w\-])[0-9]{3} [0-9]{2} [0-9]{4}(?![\w\-])"), _ssn, 0.6, _W("ssn", "social", "security", "tax", "tin"), _W("part", "order", "serial", "isbn")),
    Kind("phone", r"[0-9]", re.compile(r"(?<![\w.\-+(])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{1,4}(?:[ .\-]?[0-9]{2,4}){1,4}|\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}|[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4})(?![\w\-]|\.[0-9])"), _phone, 0.65, _W("phones?", "telephone", "tel", "mobile", "cell", "call", "fax", "telefon", "whatsapp", "sms"), _W("isbn", "order", "serial", "version")),
]


def find(text: str, kinds: list[Kind] = KINDS, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the spans in a text, by position; of overlapping spans the stronger stays."""
    got = []
    for order, k in enumerate(kinds):
        at = 0
        while m := k.find.search(text, at):
            g = 1 if k.find.groups else 0
            s, e = m.span(g)
            if k.name == "secret":
                e = s + len(m.group(g).rstrip(".=" if m.group(g).endswith(".") else ""))
            at = max(e, m.start() + 1)
            if k.name == "iban" and not _iban(text[s:e]):  # words after the number may look like more of it
                while " " in text[s:e] and not _iban(text[s:e]):
                    e = s + text[s:e].rindex(" ")
                at = max(e, m.start() + 4) if _iban(text[s:e]) else m.start() + 4
            for s, e in [(m.start() + a, m.start() + z) for a, z in _cards(m.group())] if k.name == "card" else [(s, e)]:
                if k.check is not None and not k.check(text[s:e]):
                    continue
                near = text[max(0, s - WINDOW) : s] + " \0 " + text[e : e + WINDOW]
                score = k.base + 0.15 * bool(k.near.search(near)) - 0.35 * bool(k.against.search(near))
                if score >= threshold:
                    got.append((round(min(score, 1.0), 2), order, s, e, k.name))
    got.sort(key=lambda x: (-x[0], x[1], x[2]))
    kept: list[tuple[str, int, int, float]] = []
    if len(got) > 1:
        import bisect

        taken: list[tuple[int, int]] = []
        for sc, _, s, e, name in got:
            i = bisect.bisect(taken, (s, e))
            if (i and taken[i - 1][1] > s) or (i < len(taken) and taken[i][0] < e):
                continue
            taken.insert(i, (s, e))
            kept.append((name, s, e, sc))
    else:
        kept = [(name, s, e, sc) for sc, _, s, e, name in got]
    return sorted(kept, key=lambda x: x[1])


def _batch(texts: pa.Array, threshold: float) -> list[list]:
    # one vectorised search per kind leaves the texts worth a closer look
    which: dict[int, list[Kind]] = {}
    some = pc.fill_null(pc.match_substring_regex(texts, r"[0-9@]|(?i:token|key|secret|passw|credential|bearer)"), False)
    rows = pc.indices_nonzero(some)
    sub = texts.take(rows)
    at = rows.to_pylist()
    for k in KINDS:
        for i in pc.indices_nonzero(pc.match_substring_regex(sub, k.need)).to_pylist():
            which.setdefault(i, []).append(k)
    out: list[list] = [[] for _ in range(len(texts))]
    for i, kinds in which.items():
        out[at[i]] = [{"kind": n, "start": s, "end": e, "score": sc} for n, s, e, sc in find(sub[i].as_py(), kinds, threshold)]
    return out


def spans_of(threshold: float = THRESHOLD):
    """Column function: text -> its spans."""

    @F.arrow_udf(SPAN)
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return pa.array(_batch(texts, threshold), kind)

    return spans


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per span: (doc_id, kind, span_start, span_end, score)."""
    d = narrow(docs, id_col, text_col).select(F.col(ID).alias("doc_id"), F.explode(spans_of(threshold)(F.col(TEXT))).alias("s"))
    return d.select("doc_id", F.col("s.kind").alias("kind"), F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.score").alias("score"))


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, s, e, _ in spans:
        out += [text[at:s], f"<{kind.upper()}>"]
        at = e
    return "".join([*out, text[at:]])
