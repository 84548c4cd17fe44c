"""Operator 9: licences named in documents.

One Aho-Corasick pass over a normal form of the text (lower case; white space, commas, brackets, quotes and the comment
marks that begin lines are one blank) finds identifier tags, notice phrases and names of licence families. What follows
a tag is read as a licence expression: a shunting-yard parser brings it to postfix, with WITH binding closest, then AND,
then OR, and the postfix is evaluated to the most permissive class that its choices allow. What follows a family's name
is read as its version.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import portions
from .pii import lowered

#: Obligations of a licence, in rising order.
CLASSES = ("permissive", "weak-copyleft", "strong-copyleft", "noncommercial", "unknown")
#: Classes of listed identifiers by how they begin, first match first; others are unknown.
_BEGINS = (
    ("noncommercial", r"cc-by-nc|cc-by-nd|polyform-noncommercial|prosperity|bsd-3-clause-no-nuclear-license$"),
    ("strong-copyleft", r"a?gpl-|sspl|rpl-|gfdl|osl-|eupl|sleepycat|qpl-"),
    ("weak-copyleft", r"lgpl|cc-by-sa|mpl-|epl-|cddl|cpl-1|cecill|ms-rl|ofl-|lppl|artistic|apsl|npl-|ipl-|odbl|spl-1|eclipse|oclc|nokia|mulanpubl"),
    ("permissive", r"mit|apache|bsd-|isc|zlib|unlicense|0bsd|cc0|cc-by-[1-4]|cc-pddc|bsl-1\.0|python-|psf|postgresql|wtfpl|x11|ncsa|afl-|ms-pl|curl|libpng|openssl|php-|w3c|"
     r"ruby|tcl|unicode|upl|vim|zpl|blueoak|fair|ftl|hpnd|icu|ijg|ntp|boehm|beerware|mulanpsl|ecl-|efl-|pddl|odc-by|fsf|xnet|zlib"),
)
_OLD = {
    "gpl-1.0": "GPL-1.0-only", "gpl-1.0+": "GPL-1.0-or-later", "gpl-2.0": "GPL-2.0-only", "gpl-2.0+": "GPL-2.0-or-later", "gpl-3.0": "GPL-3.0-only", "gpl-3.0+": "GPL-3.0-or-later",
    "lgpl-2.0": "LGPL-2.0-only", "lgpl-2.0+": "LGPL-2.0-or-later", "lgpl-2.1": "LGPL-2.1-only", "lgpl-2.1+": "LGPL-2.1-or-later", "lgpl-3.0": "LGPL-3.0-only",
    "lgpl-3.0+": "LGPL-3.0-or-later", "agpl-3.0": "AGPL-3.0-only", "agpl-3.0+": "AGPL-3.0-or-later",
}


def _listed() -> tuple[dict[str, str], set[str]]:
    """Spelling of each listed identifier by its lower case, and the exceptions."""
    with open(os.path.join(os.path.dirname(__file__), "spdx_ids.txt")) as f:
        ids, exceptions = [line.split() for line in f if not line.startswith("#")]
    return {i.lower(): i for i in ids}, {i.lower() for i in exceptions}


_SPELLED, _EXCEPTIONS = _listed()


def class_of(licence: str) -> str:
    low = licence.lower()
    return next((kind for kind, begin in _BEGINS if re.match(begin, low)), "unknown") if low in _SPELLED else "unknown"


CLASS_OF = {i: class_of(i) for i in _SPELLED}
#: Exceptions that lift a copyleft for what merely links or is compiled.
LIFTING = {"classpath-exception-2.0", "gcc-exception-3.1", "gcc-exception-2.0", "llvm-exception", "linux-syscall-note", "autoconf-exception-3.0", "autoconf-exception-2.0", "bison-exception-2.2", "font-exception-2.0"}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Notice phrases in the normal form and what they grant.
PHRASES = {
    "apache-2.0": "Apache-2.0", "apache 2.0": "Apache-2.0", "mit license": "MIT", "permission is hereby granted free of charge to any person obtaining a copy": "MIT", "isc license": "ISC",
    "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted": "ISC",
    "redistribution and use in source and binary forms with or without modification": "BSD-3-Clause", "bsd 3-clause": "BSD-3-Clause", "3-clause bsd": "BSD-3-Clause", "new bsd license": "BSD-3-Clause",
    "modified bsd license": "BSD-3-Clause", "bsd 2-clause": "BSD-2-Clause", "2-clause bsd": "BSD-2-Clause", "simplified bsd license": "BSD-2-Clause", "zero-clause bsd": "0BSD",
    "cc0 1.0": "CC0-1.0", "creative commons zero": "CC0-1.0", "boost software license": "BSL-1.0", "zlib license": "Zlib", "the unlicense": "Unlicense",
    "this is free and unencumbered software released into the public domain": "Unlicense", "do what the fuck you want to public license": "WTFPL", "postgresql license": "PostgreSQL",
    "python software foundation license": "PSF-2.0", "artistic license 2.0": "Artistic-2.0", "sil open font license": "OFL-1.1", "server side public license": "SSPL-1.0",
}
_VERSION = re.compile(
    r"(?: [al]?gpl)?(?: as published by the free software foundation)?;? ?(?:either )?(?:v|version|v\.|-)? ?(\d(?:\.\d)?)(?: of the license)?"
    r"(\+| or at your option any later version| or any later version| or later|-or-later)?"
)
#: Families whose version follows the name: the versions known, and the spelling; {v} is the version.
FAMILIES = {
    **dict.fromkeys(("gnu general public license", "gnu gpl", "gpl", "gplv"), "GPL"),
    **dict.fromkeys(("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl", "lgplv"), "LGPL"),
    **dict.fromkeys(("gnu affero general public license", "affero general public license", "gnu agpl", "agpl", "agplv"), "AGPL"),
    **dict.fromkeys(("apache license", "apache software license"), "Apache"), **dict.fromkeys(("mozilla public license", "mpl"), "MPL"),
    **dict.fromkeys(("eclipse public license", "epl"), "EPL"), **dict.fromkeys(("common development and distribution license", "cddl"), "CDDL"),
    **dict.fromkeys(("european union public licence", "european union public license", "eupl"), "EUPL"), "gnu free documentation license": "GFDL", "academic free license": "AFL",
    **{f"cc by{x}": f"CC-BY{x.upper()}" for x in ("", "-sa", "-nd", "-nc", "-nc-sa", "-nc-nd")}, **{f"cc-by{x}": f"CC-BY{x.upper()}" for x in ("", "-sa", "-nd", "-nc", "-nc-sa", "-nc-nd")},
    **{f"creative commons attribution{x}": f"CC-BY{y}" for x, y in (
        ("", ""), ("-sharealike", "-SA"), ("-noderivatives", "-ND"), ("-noderivs", "-ND"), ("-noncommercial", "-NC"), ("-noncommercial-sharealike", "-NC-SA"), ("-noncommercial-noderivatives", "-NC-ND"), ("-noncommercial-noderivs", "-NC-ND"))},
}
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?(?::LicenseRef-[A-Za-z0-9.-]*[A-Za-z0-9])?)")
_BINDS = {"or": 1, "and": 2, "with": 3}
_FOLD = re.compile(r"""(?:\n[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|!+|>+|dnl\b|rem\b)|[\s,()"'])+""")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t in TAGS:
        a.add_word(t, ("tag", len(t), ""))
    for f, name in FAMILIES.items():
        a.add_word(f, ("family", len(f), name))
    for p, i in PHRASES.items():
        a.add_word(p, ("phrase", len(p), i))
    a.make_automaton()
    return a


_anchors = _automaton()


def versioned(family: str, version: str, later: bool) -> str:
    """The identifier of a family's version, if it is listed."""
    v = version if "." in version else f"{version}.0"
    names = ([f"{family}-{v}-or-later"] if later else []) + [f"{family}-{v}-only", f"{family}-{v}"]
    return next((_SPELLED[i.lower()] for i in names if i.lower() in _SPELLED), "")


def _known(operand: str) -> bool:
    low = operand.lower()
    return low in _SPELLED or low.rstrip("+") in _SPELLED or low in _OLD or low in _EXCEPTIONS or low.startswith(("licenseref-", "documentref-"))


def expression(text: str, at: int = 0) -> tuple[list[str], int]:
    """The longest run from ``at`` on, in its line, that can be an expression, and where it ends: operands and operators
    in turn, brackets balanced. An operand after an operator must be a listed name or look like an identifier, so that
    prose ends the expression."""
    out, depth, operand, good, done = [], 0, False, 0, at
    end = text.find("\n", at)
    end = len(text) if end < 0 else end
    while m := _TOKEN.match(text, at, end):
        t = m[1]
        low = t.lower()
        if t == "(":
            if operand:
                break
            depth += 1
        elif t == ")":
            if not operand or not depth:
                break
            depth -= 1
        elif low in _BINDS:
            if not operand:
                break
            operand = False
        else:
            if operand or (out and out[-1].lower() in _BINDS and not _known(t) and not re.search(r"[\d-]", t)):
                break
            operand = True
        out.append(t)
        at = m.end()
        if operand and not depth:
            good, done = len(out), at
    return out[:good], done


def postfix(expression: list[str]) -> list[str]:
    """Shunting-yard: operands in order, each operator after its two operands."""
    out: list[str] = []
    stack: list[str] = []
    for t in expression:
        low = t.lower()
        if t == "(":
            stack.append(t)
        elif t == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif low in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
        else:
            out.append(_SPELLED.get(_OLD.get(low, low).lower(), t))
    return out + stack[::-1]


def evaluate(rpn: list[str]) -> str:
    """The class of an expression: OR takes the lighter side, AND the heavier, WITH lifts copyleft by known exceptions."""
    stack: list[tuple[int, str]] = []
    for t in rpn:
        if t not in _BINDS:
            stack.append((CLASSES.index(CLASS_OF.get(t.lower(), "unknown")), t))
            continue
        (right, exception), (left, name) = stack.pop(), stack.pop()
        if t == "or":
            stack.append((min(left, right), ""))
        elif t == "and":
            stack.append((max(left, right), ""))
        else:
            stack.append((0 if exception.lower() in LIFTING and left <= 2 else left, name))
    return CLASSES[stack[0][0]]


def _places(low: str) -> tuple[np.ndarray, np.ndarray]:
    """Places in the normal form behind each blank, and how much further the text is there."""
    got = np.array([m.span() for m in _FOLD.finditer(low)], np.int64).reshape(-1, 2)
    lost = np.cumsum(got[:, 1] - got[:, 0] - 1)
    return got[:, 1] - lost, lost


def find(text: str) -> list[tuple[str, str, int]]:
    """(expression in postfix, class, start) of every tag and every longest phrase or family, in order."""
    whole = lowered(text)
    low = _FOLD.sub(" ", whole)
    hits = sorted((end + 1 - n, -n, kind, i) for end, (kind, n, i) in _anchors.iter(low) if end + 1 - n == 0 or not low[end - n].isalnum())
    if not hits:
        return []
    behind, lost = _places(whole)

    def place(at: int) -> int:
        k = int(np.searchsorted(behind, at, "right"))
        return at + (int(lost[k - 1]) if k else 0)

    out, done = [], 0
    for start, n, kind, licence in hits:
        at = place(start)
        if at < done:
            continue
        end = start - n
        if kind == "tag":
            got, done = expression(text, place(end - 1) + 1)
            if rpn := postfix(got):
                out.append((" ".join(rpn), evaluate(rpn), at))
        elif kind == "phrase":
            if not low[end : end + 1].isalnum():
                out.append((licence, CLASS_OF[licence.lower()], at))
                done = place(end - 1) + 1
        else:
            m = _VERSION.match(low, end)
            got = m and not low[m.end() : m.end() + 1].isalnum() and versioned(licence, m[1], bool(m[2]))
            if got:
                out.append((got, CLASS_OF[got.lower()], at))
                done = place(m.end() - 1) + 1
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, found, strictest): a row for every document that names a licence.

    found lists (expression, class, start) in order of their place, in characters of the text; expressions are in
    postfix. strictest is the heaviest class found. A tag without a well-formed expression after it, on its line, is
    ignored; phrases must match word for word, however they are wrapped or commented; a family's name without a listed
    version says nothing. Null and empty texts, and texts
    that name none, give no row; repeated rows are each reported; a null doc_id is carried. Other columns are not read.
    One pass over whole texts, no shuffle.
    """
    kind = pa.struct([("expression", pa.string()), ("class", pa.string()), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            at, found, strict = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                got = find(text) if text else []
                if got:
                    at.append(i)
                    found.append([dict(zip(("expression", "class", "start"), g)) for g in got])
                    strict.append(max((g[1] for g in got), key=CLASSES.index))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(found, pa.list_(kind)), pa.array(strict, pa.string())], ["doc_id", "found", "strictest"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, found array<struct<expression: string, class: string, start: int>>, strictest string")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table that names a licence."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
