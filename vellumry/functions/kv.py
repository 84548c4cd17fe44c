"""`Key: value` lines: recognising them, the type of a value, the normal form of a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, word_count

#: Labels that introduce prose.
RHETORICAL = (
    "background", "caution", "conclusion", "context", "example", "however", "important", "note", "objective", "overview",
    "purpose", "reason", "result", "see", "summary", "therefore", "tip", "warning",
)
PROSE_START = r"^(?:an?|at|by|for|in|on|the) "
LABEL_WORDS, VALUE_CHARS = 5, 80

#: In the order tried; the first that matches names the type.
VALUE_TYPES = (
    ("time", r"^(?i)[0-9]{1,2}:[0-9]{2}(?:\s*[ap]m?)?$"),
    ("email", r"^[^\s@]+@[^\s@]+\.[^\s@]+$"),
    ("url", r"^(?i)https?://"),
    ("phone", r"^[+(]?[0-9\s\-()]{7,20}$"),
    ("currency", r"^[$£€¥][0-9,.]+$"),
    ("percentage", r"^-?[0-9]+(?:\.[0-9]+)?%$"),
    ("number", r"^-?[0-9]+(?:[,.][0-9]+)*$"),
    ("date", r"^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}$"),
)
STRONG_TYPES = ("currency", "date", "email", "percentage", "phone", "time", "url")
SYNONYMS = {
    "e mail": "email", "e-mail": "email", "fri": "friday", "mob": "mobile", "mon": "monday", "ph": "phone",
    "sat": "saturday", "sun": "sunday", "tel": "telephone", "thu": "thursday", "tue": "tuesday", "wed": "wednesday",
}

SCHEMAS = {
    "contact": "address city company contact country department email fax mobile name organisation organization phone postal telephone url website zip",
    "schedule": "closing date day friday location monday opening organizer registration saturday service sunday thursday time tuesday venue wednesday",
    "event": "booked_by booking check-in check-out date duration event location organizer time venue",
    "metadata": "author category copyright created description doi isbn issn journal license modified owner package project publisher status subject title version year",
    "specification": "capacity color colour connectivity current depth dimensions frequency height interface length manufacturer material model operating_range power pressure serial size temperature voltage warranty weight width",
    "form": "address amount client customer date due id invoice issued name number received reference signature ticket total",
}
SCHEMA_KEYS = {k: tuple(x.replace("_", " ") for x in v.split()) for k, v in SCHEMAS.items()}


def parse(line: Column) -> Column:
    """struct(key, value) of a stripped line, or null when it is no field: no separator, a long or rhetorical label, a
    label that begins like prose, a value that is empty or long."""
    key = strip(F.regexp_extract(line, r"^([^:]*):", 1))
    value = strip(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1))
    low = F.lower(key)
    field = (
        line.rlike(r": |:$") & (key != "") & (word_count(key) <= LABEL_WORDS) & ~low.isin(*RHETORICAL) & ~low.rlike(PROSE_START)
        & (value != "") & (F.length(value) <= VALUE_CHARS)
    )
    return F.when(field, F.struct(key.alias("key"), value.alias("value")))


def value_type(value: Column) -> Column:
    v, out = strip(value), None
    for name, pattern in VALUE_TYPES:
        test = v.rlike(pattern)
        if name == "date":
            test &= F.length(v) >= 8
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("text")


def normal_key(key: Column) -> Column:
    k = F.rtrim(strip(F.lower(key)), F.lit("."))
    table = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    return F.coalesce(table[k], k)
