"""reStructuredText as blocks: sections by the order of their adornments, lists, literal blocks, directives, paragraphs. Tables of
either form stay paragraphs."""

from __future__ import annotations

import re
import textwrap

from . import files

_RULE = re.compile(r"^([!-/:-@\[-`{-~])\1{2,}\s*$")
_BULLET = re.compile(r"^(\s*)[-*+•]\s+(.*)$")
_NUMBER = re.compile(r"^(\s*)(?:\d+|#|[A-Za-z])[.)]\s+(.*)$")
_DIRECTIVE = re.compile(r"^\.\. ([\w-]+)::\s*(.*)$")
NOTES = frozenset("admonition attention caution danger error hint important note tip warning".split())
_INLINE = [
    (re.compile(r"`([^`<]+?)\s*<[^`>]+>`__?"), r"\1"), (re.compile(r":[\w:+.-]+:`([^`]+)`"), r"\1"), (re.compile(r"``(.+?)``"), r"\1"),
    (re.compile(r"\*\*(.+?)\*\*"), r"\1"), (re.compile(r"(?<![\w*])\*([^*\s](?:[^*]*[^*\s])?)\*"), r"\1"), (re.compile(r"`([^`]+)`_{0,2}"), r"\1"), (re.compile(r"\b(\w+)_(?!\w)"), r"\1"),
]


def inline(t: str) -> str:
    for pattern, kept in _INLINE:
        t = pattern.sub(kept, t)
    return t


def blocks(text: str) -> list[dict]:
    lines = [x.rstrip() for x in text.expandtabs(8).split("\n")]
    out: list[dict] = []
    styles: list[tuple[str, bool]] = []
    i, n = 0, len(lines)

    def indented(at: int) -> tuple[list[str], int]:
        """The indented lines from ``at`` on, blank ones between them included, and the line after them."""
        end = at
        while end < n and (not lines[end] or lines[end][0] == " "):
            end += 1
        part = lines[at:end]
        while part and not part[-1]:
            part.pop()
        return textwrap.dedent("\n".join(part)).strip("\n").split("\n") if part else [], end

    def heading(title: str, style: tuple[str, bool]) -> None:
        if style not in styles:
            styles.append(style)
        out.append(files._block("heading", inline(title.strip()), min(6, styles.index(style) + 1)))

    while i < n:
        line = lines[i]
        if not line:
            i += 1
        elif (m := _RULE.match(line)) and i + 2 < n and lines[i + 1] and (u := _RULE.match(lines[i + 2])) and u[1] == m[1]:
            heading(lines[i + 1], (m[1], True))
            i += 3
        elif line[0] != " " and i + 1 < n and (u := _RULE.match(lines[i + 1])) and len(lines[i + 1]) >= len(line):
            heading(line, (u[1], False))
            i += 2
        elif _RULE.match(line):  # a transition
            i += 1
        elif m := _DIRECTIVE.match(line):
            body, i = indented(i + 1)
            body = [x for x in body if not re.match(r"^:[\w-]+:", x)]
            content = "\n".join(([m[2]] if m[2] and m[1] in NOTES else []) + body).strip("\n")
            if m[1] in ("code", "code-block", "sourcecode", "math"):
                out.append(files._block("code_block", content, note=m[2] or None))
            elif m[1] in NOTES and content:
                out.append(files._block("admonition", inline(" ".join(content.split())), note=m[1]))
            elif m[1] in ("image", "figure") and m[2]:
                out.append(files._block("image", m[2]))
        elif line.startswith(".. ") or line == "..":
            _, i = indented(i + 1)
        elif (pattern := next((p for p in (_BULLET, _NUMBER) if p.match(line)), None)) and line[0] != " ":
            items: list[str] = []
            count: dict[int, int] = {}
            while i < n:
                m = _BULLET.match(lines[i]) or _NUMBER.match(lines[i])
                if m and (lines[i][0] == " " or pattern.match(lines[i])):
                    depth = len(m[1]) // 2
                    count = {k: v for k, v in count.items() if k <= depth}
                    count[depth] = count.get(depth, 0) + 1
                    items.append("  " * depth + (f"{count[depth]}. " if _NUMBER.match(lines[i]) and not _BULLET.match(lines[i]) else "- ") + inline(m[2]))
                elif lines[i].startswith(" "):
                    items[-1] += " " + inline(lines[i].strip())
                elif lines[i] or not (i + 1 < n and (lines[i + 1].startswith(" ") or pattern.match(lines[i + 1]))):
                    break
                i += 1
            out.append(files._block("list", "\n".join(items)))
        elif line[0] == " ":
            body, i = indented(i)
            out.append(files._block("blockquote", inline(" ".join(" ".join(body).split()))))
        else:
            para = []
            while i < n and lines[i]:
                para.append(lines[i].strip())
                i += 1
            t = "\n".join(para)
            if t.endswith("::"):
                shown = t[:-2].rstrip() + (":" if len(t) > 2 and t[-3] != " " else "")
                if shown:
                    out.append(files._block("paragraph", inline(shown)))
                body, i = indented(i)
                if body:
                    out.append(files._block("code_block", "\n".join(body)))
            else:
                out.append(files._block("paragraph", inline(t)))
    return [b for b in out if b["content"]]


@files.register("rst")
def _rst(data: bytes) -> list[dict]:
    return blocks(files._decode(data))
