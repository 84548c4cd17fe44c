"""Markdown as blocks: one pass over the lines."""

from __future__ import annotations

import re

from .html import NOTE

_HEAD = re.compile(r"^ {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*(\S*)")
_ITEM = re.compile(r"^(\s*)(?:[-*+]|(\d{1,9})[.)])\s+(.*)$")
_LINK = re.compile(r"\[([^\]]+)\]\([^)]+\)")
_CALLOUT = re.compile(r"^[!?]{3}\s+(note|warning|tip|important|caution|danger|error)\b", re.I)
_RULE = re.compile(r"^ {0,3}\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_UNDER = re.compile(r"^ {0,3}(=+|-+)\s*$")


def _block(kind: str, content: str, level: int | None = None, note: str | None = None) -> dict:
    return {"type": kind, "content": content, "level": level, "note": note}


def blocks(text: str) -> list[dict]:
    """Headings, fences, pipe tables as drawn, lists with two blanks a level, quotes, callouts, paragraphs without links."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out: list[dict] = []
    para: list[str] = []

    def flush() -> None:
        if para:
            t = _LINK.sub(r"\1", "\n".join(para)).strip()
            if m := _CALLOUT.match(t):
                out.append(_block("admonition", t[m.end() :].strip(), note=m[1].lower()))
            elif t:
                out.append(_block("paragraph", t))
            para.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        if m := _FENCE.match(line):
            flush()
            end = i + 1
            close = re.compile(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$")
            while end < len(lines) and not close.match(lines[end]):
                end += 1
            out.append(_block("code_block", "".join(x + "\n" for x in lines[i + 1 : end]), note=m[2] or None))
            i = end + 1
        elif m := _HEAD.match(line):
            flush()
            out.append(_block("heading", m[2] or "", len(m[1])))
            i += 1
        elif para and (m := _UNDER.match(line)) and "|" not in line:
            t = "\n".join(para).strip()
            para.clear()
            out.append(_block("heading", t, 1 if m[1][0] == "=" else 2))
            i += 1
        elif "|" in line and i + 1 < len(lines) and "|" in lines[i + 1] and _RULE.match(lines[i + 1]):
            flush()
            end = i + 2
            while end < len(lines) and lines[end].strip() and "|" in lines[end]:
                end += 1
            out.append(_block("table", "\n".join(lines[i:end]).strip()))
            i = end
        elif line.lstrip().startswith(">"):
            flush()
            quoted = []
            while i < len(lines) and lines[i].lstrip().startswith(">"):
                quoted.append(lines[i].lstrip()[1:].strip())
                i += 1
            body = "\n".join(quoted).strip()
            m = NOTE.match(body)
            out.append(_block("admonition", body[m.end() :].strip(), note=m[1].lower()) if m else _block("blockquote", body))
        elif not para and _ITEM.match(line):
            items, indents = [], []
            count: dict[int, int] = {}
            while i < len(lines) and (_ITEM.match(lines[i]) or (lines[i].strip() and lines[i][:1] in " \t")):
                if m := _ITEM.match(lines[i]):
                    width = len(m[1].expandtabs(4))
                    while indents and indents[-1] > width:
                        count.pop(len(indents) - 1, None)
                        indents.pop()
                    if not indents or indents[-1] < width:
                        indents.append(width)
                    depth = len(indents) - 1
                    count[depth] = count.get(depth, 0) + 1
                    items.append("  " * depth + (f"{count[depth]}. " if m[2] else "- ") + m[3])
                elif items:
                    items[-1] += " " + lines[i].strip()
                i += 1
            out.append(_block("list", "\n".join(items)))
        elif not line.strip():
            flush()
            i += 1
        else:
            para.append(line.strip())
            i += 1
    flush()
    return out
