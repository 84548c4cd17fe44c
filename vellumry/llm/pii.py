"""Operator 8: private data by anchor expansion.

One Aho-Corasick automaton finds anchors in the lower-cased text: at-signs, schemes, identifier cues, beginnings of keys,
digits and colons before hexadecimal digits. At each anchor a deterministic local parser expands to both sides as far as
the thing goes, without an upper length, validates what it found (domain shape, octet range, Luhn, mod 97, area numbers)
and fixes its boundaries. Nothing but the neighbourhood of anchors is looked at a second time.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import portions

#: Words before a secret value, in lower case; they also end longer names such as clientSecret.
CUES = (
    "password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "api-key", "apikey", "api key", "access_key", "access-key",
    "accesskey", "private_key", "privatekey", "secret_key", "secretkey", "encryption_key", "client_secret", "authorization",
)
#: Beginnings of keys as issued, with the shape of the rest; letter case counts.
KEYS = {
    "AKIA": r"[A-Z0-9]{16}(?!\w)", "ASIA": r"[A-Z0-9]{16}(?!\w)", "AIza": r"[\w-]{35}(?![\w-])", "github_pat_": r"[A-Za-z0-9_]{22,}",
    "xoxb-": r"[A-Za-z0-9-]{10,}", "xoxp-": r"[A-Za-z0-9-]{10,}", "xoxa-": r"[A-Za-z0-9-]{10,}", "eyJ": r"[\w-]{10,}\.eyJ[\w-]{8,}\.[\w-]+",
    **{f"gh{c}_": r"[A-Za-z0-9]{36,}" for c in "pousr"}, **{f"{k}_{m}_": r"[A-Za-z0-9]{16,}" for k in ("sk", "rk") for m in ("live", "test")},
}
_KEYS = {k.lower(): (k, re.compile(v)) for k, v in KEYS.items()}
_PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY(?: BLOCK)?)-----")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)(?:[A-Za-z0-9-]{1,63}\.)*[A-Za-z]{2,24}|[A-Za-z0-9]+\.[A-Za-z]{2,24}")
_USERINFO = re.compile(r"[^\s/@:\"'<>]+:[^\s/@\"'<>]+@")
_CUE_END = re.compile(r"""[\w-]*["'\]]?[ \t]{0,3}(=>|:=|[:=])[ \t]{0,3}(?:(?:bearer|basic)[ \t]+)?""", re.IGNORECASE)
_QUOTED = re.compile(r""""([^"\n]+)"|'([^'\n]+)'|`([^`\n]+)`""")
_BARE = re.compile(r"""["'`]?([^\s"'`,;]+)""")
_IPV4 = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?!\.?\d)(?!\w)")
_HEXES = frozenset("0123456789abcdefABCDEF:")
_IPV6 = re.compile(r"[0-9A-Fa-f:]+")
_SSN = re.compile(r"(\d{3})-(\d{2})-(\d{4})(?![-\w])")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![-\w])")
_INTERNATIONAL = re.compile(r"\+\d(?:[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d){7,13}(?![-\w])")
_DIGITS = re.compile(r"\d+(?:[ -]\d+)*")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    for d in "0123456789abcdef:":
        a.add_word(f":{d}", ("colon", 2))
    a.add_word("@", ("at", 1))
    a.add_word("://", ("scheme", 3))
    a.add_word("-----begin ", ("pem", 11))
    for k in _KEYS:
        a.add_word(k, ("key", len(k)))
    for c in CUES:
        a.add_word(c, ("cue", len(c)))
    a.make_automaton()
    return a


_anchors = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def lowered(text: str) -> str:
    """The lower case of ``text``, each character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _local(c: str) -> bool:
    """ASCII characters of a local part, and letters of alphabets (not ideographs, which need no space before it)."""
    return c in _LOCAL or ("\x80" < c < "\u2e80" and c.isalnum())


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    i = at
    while i > floor and _local(text[i - 1]):
        i -= 1
    while i < at and text[i] in ".-%+":
        i += 1
    if i == at or text[at - 1] == "." or ".." in text[i:at]:
        return None
    m = _DOMAIN.match(text, at + 1)
    if not m:
        return None
    return i, m.end()


def _card(text: str, p: int) -> int:
    """Where a card number that begins at p ends, or 0: 13 to 19 digits that end with a group and pass Luhn. Where more
    digits follow, such as an expiry date, the number must begin as cards do."""
    m = _DIGITS.match(text, p, p + 64)
    if not m or (m.end() < len(text) and m.end() < p + 64 and (text[m.end()].isalpha() or text[m.end()] == "_")):
        return 0
    groups = [(g.end(), len(g.group())) for g in re.finditer(r"\d+", m.group())]
    total, ends = 0, []
    for end, n in groups:
        total += n
        if 13 <= total <= 19:
            ends.append((p + end, total))
        if total > 19:
            break
    digits = re.sub(r"\D", "", m.group())
    for end, n in reversed(ends):
        if (n == len(digits) or digits[0] in "3456") and luhn(digits[:n]):
            return end
    return 0


def _number(text: str, p: int, floor: int) -> tuple[str, int, int] | int:
    """(kind, start, end) of what begins at or just before the digit at p; else where to go on."""
    before = text[p - 1] if p > floor else " "
    if p - 2 >= floor and text[p - 2 : p].isupper() and text[p - 2 : p].isascii() and text[p - 2 : p].isalpha() and (p - 2 == 0 or not _word(text[p - 3])):
        m = _IBAN.match(text, p - 2)
        if m and iban_valid(m.group()):
            return "iban", p - 2, m.end()
    if not _word(before):
        m = _IPV4.match(text, p)
        if m and before != "." and all(int(x) < 256 and (x == "0" or x[0] != "0") for x in m.groups()):
            return "ip", p, m.end()
        if before not in "-." and (end := _card(text, p)):
            return "card", p, end
        m = _SSN.match(text, p)
        if m and before != "-" and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            return "ssn", p, m.end()
        start = p - 1 if before in "+(" else p
        if start > floor and before == "(" and text[start - 1] == "+":
            start -= 1
        m = _PHONE.match(text, start) or (_INTERNATIONAL.match(text, start) if before == "+" else None)
        if m and (start == p or start == floor or not _word(text[start - 1])) and 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            return "phone", start, m.end()
    end = p + 1
    while end < len(text) and text[end].isdigit():
        end += 1
    return end


def _ipv6(text: str, p: int, floor: int) -> tuple[int, int] | int:
    """The IPv6 address around the colon at p, of three groups or more with a digit; else where to go on."""
    i = p
    while i > floor and p - i < 40 and text[i - 1] in _HEXES:
        i -= 1
    m = _IPV6.match(text, i)
    end = m.end()
    got = m.group().rstrip(":") if not m.group().endswith("::") else m.group()
    stop = i + len(got)
    if got.count(":") < 2 or len(got) > 39 or len(got.replace(":", "")) < 5 or not any(c.isdigit() for c in got):
        return end
    if (i > 0 and (_word(text[i - 1]) or text[i - 1] in ".:")) or (stop < len(text) and (_word(text[stop]))):
        return end
    try:
        address = ipaddress.IPv6Address(got)
    except ValueError:
        return end
    return (i, stop) if sum(bool(g) for g in got.split(":")) >= 3 and not address.is_loopback else end


def _secret(text: str, end: int) -> tuple[int, int] | None:
    """The value after a cue: quoted, or up to white space, quote, comma or semicolon. A bare value after a colon must have
    six characters or a digit, so that prose stays."""
    m = _CUE_END.match(text, end)
    if not m:
        return None
    q = _QUOTED.match(text, m.end())
    if q:
        return q.span(q.lastindex)
    v = _BARE.match(text, m.end())
    if not v or (m[1] == ":" and len(v[1]) < 6 and not any(c.isdigit() for c in v[1])):
        return None
    return v.span(1)


def _pem(text: str, start: int) -> tuple[int, int] | None:
    """A private key block to its end mark, or to the text's end where that is missing."""
    m = _PEM.match(text, start)
    if not m:
        return None
    mark = f"-----END {m[1]}-----"
    end = text.find(mark, m.end())
    return start, len(text) if end < 0 else end + len(mark)


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the private data in a text, in order and without overlaps."""
    out: list[tuple[str, int, int]] = []
    done = skip = passed = 0
    for last, (kind, n) in _anchors.iter(lowered(text)):
        start = last + 1 - n
        if start < done:
            continue
        if kind == "digit":
            if start < skip:
                continue
            got = _number(text, start, done)
            if isinstance(got, int):
                skip = got
                continue
            out.append(got)
        elif kind == "colon":
            if start < passed:
                continue
            got = _ipv6(text, start, done)
            if isinstance(got, int):
                passed = got
                continue
            while out and out[-1][1] >= got[0]:  # digits of the first group, taken for something else
                out.pop()
            out.append(("ip", *got))
        else:
            if kind == "at":
                span = _email(text, start, done)
            elif kind == "scheme":
                m = _USERINFO.match(text, last + 1)
                kind, span = "credentials", m and (last + 1, m.end() - 1)
            elif kind == "key":
                begin, rest = _KEYS[text[start : last + 1].lower()]
                m = text.startswith(begin, start) and (start == 0 or not _word(text[start - 1])) and rest.match(text, last + 1)
                span = m and (start, m.end())
            elif kind == "pem":
                kind, span = "key", _pem(text, start)
            else:
                kind, span = "secret", _secret(text, last + 1)
            if not span:
                continue
            out.append((("email" if kind == "at" else kind), *span))
        done = out[-1][2]
    return out


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    parts, at = [], 0
    for kind, start, end in found:
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(parts) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text, found): every row with its private data replaced by the kind in brackets, and where it stood.

    found is an array of (kind, start, end) in characters of the original text, end exclusive, in order; empty for clean,
    null and empty texts, whose text is unchanged. Repeated rows are each returned; other columns are not read. One pass
    over whole texts without a shuffle, linear in their length.
    """

    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts = batch.column("text").to_pylist()
            found = [find(t) if t else [] for t in texts]
            clean = [redact(t, f) if f else t for t, f in zip(texts, found)]
            rows = [[dict(zip(("kind", "start", "end"), x)) for x in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(clean, pa.string()), pa.array(rows, pa.list_(kind))], ["doc_id", "text", "found"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, text string, found array<struct<kind: string, start: int, end: int>>")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with private data replaced in ``text`` and n_chars, if there, set anew; all other columns as they were."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            clean = [redact(t, f) if t and (f := find(t)) else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out


def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table with private data redacted, and where it was found."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
