"""Block grammar of Markdown: containers, leaves, definitions and tables, with exact source positions.

Offsets are characters here; :mod:`inkgraph.functions.document` turns them into bytes. A line is taken through the open
containers, then through what it may start; what is left joins a paragraph, lazily if need be.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

LINE = re.compile(r"[^\r\n]*(\r\n|\r|\n|$)")
FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$", re.S)
CLOSING = re.compile(r"(`{3,}|~{3,})[ \t]*$")
ATX = re.compile(r"(#{1,6})(?=[ \t]|$)")
SETEXT = re.compile(r"(=+|-+)[ \t]*$")
BULLET = re.compile(r"([-*+])(?=[ \t]|$)")
ORDERED = re.compile(r"([0-9]{1,9})([.)])(?=[ \t]|$)")
FRONT = re.compile(r"---[ \t]*(?:\r\n|\r|\n|$)")
TASK = re.compile(r"\[([ xX])\](?=\s|$)")
FOOTNOTE = re.compile(r"\[\^([^\s\[\]]+)\]:(?=[ \t])[ \t]*")


@dataclass
class Block:
    """kind: document, quote, list, item, paragraph, heading, break, code, table, row, cell or footnote.

    fragments: (start, end) of the inline text, one for each source line."""

    kind: str
    start: int
    end: int
    children: list[Block] = field(default_factory=list)
    fragments: list[tuple[int, int]] = field(default_factory=list)
    attrs: dict = field(default_factory=dict)
    column: int = 0

    def below(self) -> Iterator[Block]:
        """The block and all that it holds, in document order."""
        todo = [self]
        while todo:
            block = todo.pop()
            yield block
            todo += reversed(block.children)


class Joined:
    """The text of fragments joined by newlines, and where its characters are in the source."""

    def __init__(self, text: str, fragments: list[tuple[int, int]]):
        self.fragments, self.text = fragments, join(text, fragments)
        self.starts = [0, *accumulate(b - a + 1 for a, b in fragments)]

    def line(self, at: int) -> int:
        return min(bisect_right(self.starts, at) - 1, len(self.fragments) - 1)

    def source(self, at: int) -> int:
        k = self.line(at)
        return min(self.fragments[k][0] + at - self.starts[k], self.fragments[k][1])


@dataclass
class Definition:
    label: str
    dest: str
    title: str | None
    start: int
    end: int


def front_matter(text: str) -> tuple[int, bool] | None:
    """(length, terminated) of the front matter at the text's start, after a byte order mark if there is one."""
    at = 1 if text.startswith("﻿") else 0
    opening = FRONT.match(text, at)
    if not opening:
        return None
    at = opening.end()
    while at < len(text):
        closing = FRONT.match(text, at)
        if closing:
            return closing.end(), True
        at = LINE.match(text, at).end()
    return len(text), False


class _Cursor:
    """Position in a line, with the column that tabs to fours lead to. No tab is split."""

    def __init__(self, text: str, at: int, end: int):
        self.text, self.at, self.end, self.column = text, at, end, 0
        # where the white space that was measured last ends
        self.stop, self.stop_column = -1, 0

    def _measure(self) -> None:
        if self.at > self.stop:
            column, at = self.column, self.at
            while at < self.end and self.text[at] in " \t":
                column += 4 - column % 4 if self.text[at] == "\t" else 1
                at += 1
            self.stop, self.stop_column = at, column

    def indent(self) -> int:
        self._measure()
        return self.stop_column - self.column

    def skip(self, columns: int) -> None:
        """White space of at most so many columns."""
        target = self.column + columns
        while self.at < self.end and self.text[self.at] in " \t":
            width = 4 - self.column % 4 if self.text[self.at] == "\t" else 1
            if self.column + width > target:
                return
            self.column += width
            self.at += 1

    def take(self, n: int) -> None:
        self.at += n
        self.column += n

    def solid(self) -> int:
        """Offset of what follows the white space here."""
        self._measure()
        return self.stop

    def blank(self) -> bool:
        return self.solid() == self.end


class BlockParser:
    def __init__(self, text: str, start: int = 0):
        self.text, self.root = text, Block("document", start, start)
        self.open: list[Block] = [self.root]
        self.diagnostics: list[tuple[str, int, int]] = []
        at = start
        while at < len(text):
            found = LINE.match(text, at)
            self._line(at, found.start(1))
            at = found.end()
        self._close(1)

    def _add(self, block: Block) -> None:
        parent = self.open[-1]
        if parent.kind == "item":
            if parent.attrs.get("blank") and parent.children:
                self.open[-2].attrs["tight"] = False
            parent.attrs["blank"] = False
        parent.children.append(block)
        self.open.append(block)

    def _close(self, depth: int) -> None:
        """Close what is open from ``depth`` on; a container reaches as far as what it holds."""
        while len(self.open) > depth:
            block = self.open.pop()
            if self.open[-1] is not self.root:
                self.open[-1].end = max(self.open[-1].end, block.end)
            if block.kind == "code" and block.attrs.get("fence") and not block.attrs.get("closed"):
                self.diagnostics.append(("UnclosedCodeFence", block.start, block.end))
            if block.kind == "code" and not block.attrs.get("fence"):
                block.fragments = block.fragments[: block.attrs["filled"]]

    def _line(self, start: int, end: int) -> None:
        cur, text = _Cursor(self.text, start, end), self.text
        #: Of each character of thematic breaks: where a run of it ends that isn't one.
        broken: dict[str, int] = {}
        matched = 1
        for block in self.open[1:]:
            if block.kind == "quote":
                if not (cur.indent() <= 3 and text.startswith(">", cur.solid(), end)):
                    break
                self._quote_marker(cur)
                block.end = max(block.end, end)
            elif block.kind == "item":
                if cur.blank():
                    if not block.children:
                        break
                elif cur.indent() + cur.column >= block.column:
                    cur.skip(block.column - cur.column)
                else:
                    break
            elif block.kind != "list":
                break
            matched += 1
        # a list goes on only with an item of it
        if self.open[matched - 1].kind == "list" and matched > 1:
            in_list = True
            matched -= 1
        else:
            in_list = False
        leaf = self.open[-1] if self.open[-1].kind in ("paragraph", "code", "heading") else None
        holds = leaf is not None and not in_list and len(self.open) - 1 == matched
        blank = cur.blank()
        if holds and leaf.kind == "code":
            if self._code_line(leaf, cur, end):
                return
            leaf, holds = None, False
            self._close(matched)
        if blank:
            if leaf is not None and leaf.kind != "code":
                self._close(len(self.open) - 1)
            keep = matched + (1 if in_list else 0)
            for block in self.open[1:keep]:
                if block.kind == "item":
                    block.attrs["blank"] = True
            self._close(keep)
            if in_list and self.open[-1].kind == "list":
                self.open[-1].attrs["blank"] = True
            return
        fresh = False
        while True:
            paragraph = self.open[-1] if not fresh and holds and leaf is not None and leaf.kind == "paragraph" else None
            lazy = not fresh and leaf is not None and leaf.kind == "paragraph"
            indent = cur.indent()
            if indent >= 4:
                if lazy:
                    break
                self._start(matched, fresh)
                cur.skip(4)
                self._add(Block("code", cur.at, end, fragments=[(cur.at, end)], attrs={"filled": 1}))
                return
            at = cur.solid()
            if text.startswith(">", at, end):
                self._start(matched, fresh)
                self._quote_marker(cur)
                self._add(Block("quote", at, end))
                matched, fresh, in_list = len(self.open), True, False
                if cur.blank():
                    return
                continue
            if found := ATX.match(text, at, end):
                self._start(matched, fresh)
                self._atx(found, at, end)
                return
            if found := FENCE.match(text, at, end):
                run = found[1] or found[3]
                self._start(matched, fresh)
                info = (found[2] if found[1] else found[4]).strip()
                self._add(Block("code", at, end, attrs={"fence": run, "indent": indent, "info": info}))
                return
            if paragraph is not None and SETEXT.match(text, at, end):
                paragraph.kind, paragraph.end = "heading", end
                paragraph.attrs |= {"level": 1 if text[at] == "=" else 2, "style": "setext", "underline": at}
                self._close(len(self.open) - 1)
                return
            if self._breaks(at, end, broken):
                self._start(matched, fresh)
                self._add(Block("break", at, end))
                self._close(len(self.open) - 1)
                return
            item = self._list_marker(at, end, lazy, in_list, matched)
            if item is None:
                break
            family, number, width = item
            cur.skip(3)
            cur.take(width)
            marker_end = cur.column
            room, empty = cur.indent(), cur.blank()
            if empty or room == 0:
                column = marker_end + 1
                cur.skip(room)
            elif room <= 4:
                cur.skip(room)
                column = cur.column
            else:
                cur.skip(1)
                column = marker_end + 1
            if in_list and not fresh and self.open[matched].attrs["family"] == family:
                lst = self.open[matched]
                self._close(matched + 1)
                if lst.attrs.get("blank") or (lst.children and lst.children[-1].attrs.get("blank")):
                    lst.attrs["tight"] = False
                lst.attrs["blank"] = False
            else:
                self._start(matched, fresh)
                lst = Block("list", at, end, attrs={"family": family, "tight": True, "number": number})
                self._add(lst)
            lst.children.append(made := Block("item", at, end, column=column))
            self.open.append(made)
            matched, fresh, in_list = len(self.open), True, False
            if empty:
                return
        if lazy and leaf is not None:
            leaf.fragments.append((cur.solid(), end))
            leaf.end = end
            return
        self._start(matched, fresh)
        at = cur.solid()
        self._add(Block("paragraph", at, end, fragments=[(at, end)]))

    def _start(self, matched: int, fresh: bool) -> None:
        """Close what the line didn't continue, before it starts a block."""
        if not fresh:
            self._close(matched)

    @staticmethod
    def _quote_marker(cur: _Cursor) -> None:
        cur.skip(cur.indent())
        cur.take(1)
        if cur.at < cur.end and cur.text[cur.at] in " \t":
            cur.skip(4 if cur.text[cur.at] == "\t" else 1)

    def _breaks(self, at: int, end: int, broken: dict[str, int]) -> bool:
        """Whether the line from ``at`` on is a thematic break: three or more of one character, white space between."""
        char = self.text[at]
        if char not in "*-_" or broken.get(char, -1) > at:
            return False
        stop, n = at, 0
        while stop < end and self.text[stop] in (char, " ", "\t"):
            n += self.text[stop] == char
            stop += 1
        if stop < end:
            broken[char] = stop
        return stop == end and n >= 3

    def _list_marker(self, at: int, end: int, interrupts: bool, in_list: bool, matched: int) -> tuple[str, int, int] | None:
        """(family, number, width) of a list marker that may start an item here."""
        found = BULLET.match(self.text, at, end) or ORDERED.match(self.text, at, end)
        if not found:
            return None
        ordered = found.re is ORDERED
        family, number = (found[2], int(found[1])) if ordered else (found[1], 0)
        if interrupts and not (in_list and self.open[matched].attrs["family"] == family):
            if _Cursor(self.text, found.end(), end).blank() or (ordered and number != 1):
                return None
        return family, number, found.end() - at

    def _atx(self, found: re.Match, at: int, end: int) -> None:
        content = self.text[found.end() : end]
        lead = len(content) - len(content.lstrip(" \t"))
        start, content = found.end() + lead, content.strip(" \t")
        closed = content.rstrip("#")
        if not closed or (closed != content and closed[-1] in " \t"):
            content = closed.rstrip(" \t")
        self._add(Block("heading", at, end, fragments=[(start, start + len(content))] if content else [], attrs={"level": len(found[1]), "style": "atx"}))
        self._close(len(self.open) - 1)

    def _code_line(self, leaf: Block, cur: _Cursor, end: int) -> bool:
        """True if the line belongs to the open code block."""
        if fence := leaf.attrs.get("fence"):
            closing = CLOSING.match(self.text, cur.solid(), end) if cur.indent() <= 3 else None
            leaf.end = end
            if closing and closing[1][0] == fence[0] and len(closing[1]) >= len(fence):
                leaf.attrs["closed"] = True
                self._close(len(self.open) - 1)
            else:
                cur.skip(min(cur.indent(), leaf.attrs["indent"]))
                leaf.fragments.append((cur.at, end))
            return True
        if cur.blank():
            cur.skip(4)
            leaf.fragments.append((cur.at, end))
            return True
        if cur.indent() >= 4:
            cur.skip(4)
            leaf.fragments.append((cur.at, end))
            leaf.end, leaf.attrs["filled"] = end, len(leaf.fragments)
            return True
        return False


def split_row(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Cells of a table row, trimmed; a pipe after an odd run of backslashes is text."""

    def trim(a: int, b: int) -> tuple[int, int]:
        while a < b and text[a] in " \t":
            a += 1
        while a < b and text[b - 1] in " \t":
            b -= 1
        return a, b

    start, end = trim(start, end)
    bars = []
    if start < end and text[start] == "|":
        start += 1
    slashes = 0
    for at in range(start, end):
        if text[at] == "|" and slashes % 2 == 0:
            bars.append(at)
        slashes = slashes + 1 if text[at] == "\\" else 0
    if bars and bars[-1] == end - 1:
        end = bars.pop()
    edges = [start - 1, *bars, end]
    return [trim(a + 1, b) for a, b in zip(edges, edges[1:], strict=False)]


DELIMITER = re.compile(r"(:?)-+(:?)")


def tables(text: str, root: Block) -> None:
    """Cut paragraphs below ``root`` where a header line and a delimiter line of as many cells meet."""
    for block in root.below():
        if block.children:
            block.children = _cut(text, block.children)


def _cut(text: str, blocks: list[Block]) -> list[Block]:
    out = []
    for block in blocks:
        if block.kind != "paragraph":
            out.append(block)
            continue
        lines = block.fragments
        for k in range(1, len(lines)):
            marks = [DELIMITER.fullmatch(text, a, b) for a, b in split_row(text, *lines[k])]
            if all(marks) and len(split_row(text, *lines[k - 1])) == len(marks):
                break
        else:
            out.append(block)
            continue
        if k > 1:
            out.append(Block("paragraph", lines[0][0], lines[k - 2][1], fragments=lines[: k - 1]))
        align = [{"": "none", "l": "left", "r": "right", "lr": "center"}["l" * bool(m[1]) + "r" * bool(m[2])] for m in marks]
        table = Block("table", lines[k - 1][0], lines[-1][1], attrs={"align": ",".join(align)})
        for a, b in [lines[k - 1], *lines[k + 1 :]]:
            cells = (split_row(text, a, b) + [(b, b)] * len(marks))[: len(marks)]
            table.children.append(Block("row", a, b, [Block("cell", *c, fragments=[c] if c[0] < c[1] else []) for c in cells]))
        out.append(table)
    return out


# ---- definitions

LABEL = re.compile(r"\[((?:[^\\\[\]]|\\.){0,999})\]", re.S)
ANGLE = re.compile(r"<((?:[^<>\\\n]|\\.)*)>")
TITLE = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)", re.S)
GAP = re.compile(r"[ \t]*\n?[ \t]*")


def normal_label(label: str) -> str:
    """White space trimmed and collapsed, each character lower-cased."""
    return " ".join("".join(c.lower() for c in word) for word in label.split())


def bare_destination(text: str, at: int) -> int | None:
    """End of an unbracketed destination: no white space or controls, parentheses balanced; None if empty."""
    depth, start = 0, at
    while at < len(text) and text[at] > " " and text[at] != "\x7f":
        if text[at] == "\\" and at + 1 < len(text) and text[at + 1] > " ":
            at += 1
        elif text[at] == "(":
            depth += 1
        elif text[at] == ")":
            if not depth:
                break
            depth -= 1
        at += 1
    return at if at > start and not depth else None


END = re.compile(r"[ \t]*(\n|$)")


def link_definition(text: str, start: int = 0) -> tuple[str, str, str | None, int] | None:
    """(label, destination, title, end) of the definition at ``start``, a line's beginning, of the paragraph ``text``."""
    found = LABEL.match(text, start)
    if not found or not found[1].strip() or found[1].startswith("^") or not text.startswith(":", found.end()):
        return None
    at = GAP.match(text, found.end() + 1).end()
    if angle := ANGLE.match(text, at):
        dest, at = angle[1], angle.end()
    elif text.startswith("<", at) or (end := bare_destination(text, at)) is None:
        return None
    else:
        dest, at = text[at:end], end
    gap = GAP.match(text, at).end()
    title = TITLE.match(text, gap) if gap > at else None
    if title:
        if line := END.match(text, title.end()):
            return found[1], dest, next(g for g in title.groups() if g is not None), line.end()
    line = END.match(text, at)
    return (found[1], dest, None, line.end()) if line else None


def join(text: str, fragments: list[tuple[int, int]]) -> str:
    return "\n".join(text[a:b] for a, b in fragments)


def drop_front(fragments: list[tuple[int, int]], count: int) -> list[tuple[int, int]]:
    """The fragments without the first ``count`` characters of their joined text."""
    out = []
    for a, b in fragments:
        if count > b - a:
            count -= b - a + 1
            continue
        if count < b - a or not count:
            out.append((a + max(count, 0), b))
        count = 0
    return out


def definitions(text: str, root: Block, found: list[Definition], notes: set[str]) -> None:
    """Take link definitions out of what is below ``root``, which join ``found``; footnotes become blocks, their labels
    join ``notes``. A heading all of whose text was definitions leaves its underline: a paragraph or a break."""
    for block in reversed([b for b in root.below() if b.children]):
        block.children = _defined(text, block.children, found, notes)


def _defined(text: str, blocks: list[Block], found: list[Definition], notes: set[str]) -> list[Block]:
    out: list[Block] = []
    for block in blocks:
        if block.kind == "item" and block.children and block.children[0].kind == "paragraph":
            first = block.children[0]
            if first.fragments and (mark := TASK.match(text[slice(*first.fragments[0])])):
                block.attrs["task"] = mark[1] != " "
                rest = text[first.fragments[0][0] + mark.end() : first.fragments[0][1]]
                first.fragments = drop_front(first.fragments, mark.end() + len(rest) - len(rest.lstrip(" \t")))
        if block.kind not in ("paragraph", "heading") or block.attrs.get("style") == "atx" or not block.fragments:
            out.append(block)
            continue
        if block.kind == "paragraph" and (note := FOOTNOTE.match(text[slice(*block.fragments[0])])):
            notes.add(normal_label(note[1]))
            block.attrs["label"] = note[1]
            inner = Block("paragraph", block.start + note.end(), block.end, fragments=drop_front(block.fragments, note.end()))
            out.append(Block("footnote", block.start, block.end, [inner], attrs={"label": note[1]}))
            continue
        joined, at = Joined(text, block.fragments), 0
        while joined.text.startswith("[", at) and (one := link_definition(joined.text, at)):
            label, dest, title, after = one
            last = len(block.fragments) if after >= len(joined.text) else joined.line(after)
            found.append(Definition(label, dest, title, joined.source(at), block.fragments[last - 1][1]))
            at = after
        block.fragments = drop_front(block.fragments, at) if at else block.fragments
        if not at:
            if out and block.kind == "paragraph" and out[-1].attrs.pop("underlined", None) and text[out[-1].end : block.start].count("\n") + text[out[-1].end : block.start].count("\r") - text[out[-1].end : block.start].count("\r\n") == 1:
                out[-1].end = block.end
                out[-1].fragments += block.fragments
            else:
                out.append(block)
        elif block.fragments:
            block.start = block.fragments[0][0]
            out.append(block)
        elif block.kind == "heading":
            under = (block.attrs["underline"], block.end)
            if block.attrs["level"] == 1:
                out.append(Block("paragraph", *under, fragments=[under], attrs={"underlined": True}))
            else:
                out.append(Block("break", *under))
    return out
