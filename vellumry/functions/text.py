"""Column functions on text: normal form, tokens, prices, quality bands, small classifiers of a line.

All are built-in expressions, but for Unicode normalisation, which is done on Arrow batches. White space is the six
ASCII characters; a null argument gives null.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

WS = " \t\n\r\x0b\f"
#: Dollars for a million input tokens.
PRICES = {
    "claude-haiku-4": 0.80, "claude-opus-4": 15.00, "claude-sonnet-4": 3.00, "gemini-1.5-flash": 0.075,
    "gemini-1.5-pro": 3.50, "gpt-4o": 2.50, "gpt-4o-mini": 0.15,
}
DEFAULT_MODEL = "gpt-4o"
#: Models of a savings line, in the order shown.
SHOWN_MODELS = ("gpt-4o", "claude-sonnet-4", "gpt-4o-mini", "claude-haiku-4")
CJK = "[一-鿿぀-ヿ가-힯]"
_INVISIBLE = "[\u200b\u200c\u200d\ufeff\u00ad]"
PAGE_NUMBER = r"^(?i)(?:[0-9]+|page[ \t]+[0-9]+(?:[ \t]+of[ \t]+[0-9]+)?)$"
NUMBERED_SECTION = r"^(?:(?:Section|Appendix|Chapter|Article)\s+)?(?:[0-9]+(?:\.[0-9]+)*\.?\s|[IVXivx]+\.?\s|[A-Z]\.[0-9])"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WS))


#: Texts that Python holds at once beside their Arrow array, of which Spark bounds the bytes.
_SLICE = 256


def _nfc(text: pa.Array) -> pa.Array:
    """Composed texts; slices in which none changes are passed on as they are."""
    # Arrow's own normalisation leaves combining accents apart
    out, same = [], True
    for at in range(0, len(text), _SLICE):
        part = text.slice(at, _SLICE)
        if not pc.all(pc.string_is_ascii(part), min_count=0).as_py():
            old = part.to_pylist()
            if not all(t is None or unicodedata.is_normalized("NFC", t) for t in old):
                part, same = pa.array([t if t is None else unicodedata.normalize("NFC", t) for t in old], pa.string()), False
        out.append(part)
    return text if same else pa.concat_arrays(out)


def nfc(c: Column) -> Column:
    """Canonical composition, which Spark lacks: one call for each Arrow batch."""
    return F.arrow_udf(_nfc, "string")(c)


def _nfc_all(texts: pa.Array) -> pa.Array:
    flat = _nfc(texts.flatten())
    sizes = pc.fill_null(pc.list_value_length(texts), 0)
    ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
    return pa.ListArray.from_arrays(ends, flat, mask=texts.is_null())


def nfc_all(c: Column) -> Column:
    """``nfc`` of every string of an array."""
    return F.arrow_udf(_nfc_all, "array<string>")(c)


def normalize_text(c: Column) -> Column:
    """Composed, without invisible characters, runs of blanks as one, at most one empty line in a row, stripped."""
    return tidy(nfc(c))


def tidy(c: Column) -> Column:
    """``normalize_text`` of what is composed already."""
    c = F.regexp_replace(c, _INVISIBLE, "")
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n"))


def is_page_number(c: Column) -> Column:
    return strip(c).rlike(PAGE_NUMBER)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[^\s]+"))


def count_tokens(c: Column) -> Column:
    """Words between white space plus one for each CJK character, at least 1."""
    return F.greatest(F.lit(1), word_count(c) + F.regexp_count(c, F.lit(CJK)))


def dollars(tokens: Column, model: str) -> Column:
    return tokens * PRICES.get(model, PRICES[DEFAULT_MODEL]) / 1_000_000


def savings_line(saved: Column) -> Column:
    parts = [F.format_string(f"$%.3f ({m})", dollars(saved, m).cast("double")) for m in SHOWN_MODELS]
    return F.concat_ws("  |  ", *parts)


def quality_band(score: Column) -> Column:
    return F.when(score >= 85, "HIGH").when(score >= 70, "OK").when(score >= 50, "RISKY").otherwise("POOR")


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


_CHAPTERS = "appendix|book|chapter|epilogue|introduction|part|preface|prologue|section"


def is_prose_heading(paragraph: Column) -> Column:
    """Whether a paragraph's first line looks like a heading of a plain-text book: chapter words, capitals, a rule."""
    line = strip(F.regexp_extract(paragraph, r"^[^\n]*", 0))
    named = line.rlike(rf"^(?i)(?:{_CHAPTERS})\s+[^\s]")
    capitals = line.rlike(r"^[A-Z][A-Z0-9\s\-'.,:]{3,}$")
    rule = line.rlike(r"^(?:\*{3,}.*\*{3,}|-{5,}|={5,})$")
    return F.length(line).between(3, 100) & (named | capitals | rule)


def md_heading_level(line: Column) -> Column:
    """1 to 6 for a markdown heading, else 0."""
    return F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))


def glyph_codes(c: Column) -> Column:
    """How many unmapped glyphs, written (cid:n), a text holds."""
    return F.regexp_count(c, F.lit(r"\(cid:[0-9]+\)"))


def email_paragraphs(body: Column) -> Column:
    """Array of a mail body's own paragraphs: nothing after a forwarding banner, no quoted lines, none under 4 characters."""
    body = unix_lines(body)
    body = F.split(body, r"(?im)^(?:-{5,}Original Message-{5,}|_{20,})", 2)[0]
    own = F.transform(F.split(body, "\n\n"), lambda p: F.array_join(
        F.filter(F.transform(F.split(p, "\n"), strip), lambda x: (x != "") & ~x.startswith(">") & ~x.rlike(r"^On .{10,}wrote:\s*$")), " "
    ))
    return F.filter(own, lambda p: F.length(p) >= 4)


def member_name(c: Column) -> Column:
    """A safe relative name for an archive member or address: no drive, no leading slashes, no dot steps, no control characters."""
    c = F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"[\x00-\x1f\x7f]", "")
    parts = F.filter(F.split(F.regexp_replace(c, r"^[A-Za-z]:", ""), "/"), lambda p: ~p.isin("", ".", ".."))
    return F.coalesce(F.nullif(F.array_join(parts, "/"), F.lit("")), F.lit("unnamed"))


def media_type(data: Column) -> Column:
    """Media type of an image by its first bytes; application/octet-stream when unknown."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.rlike("^474946383[79]61"), "image/gif").when(head.rlike("^52494646.{8}57454250"), "image/webp")
        .when(head.startswith("424D"), "image/bmp").when(head.rlike("^(?:49492A00|4D4D002A)"), "image/tiff")
        .otherwise("application/octet-stream")
    )
