"""Inline grammar of Markdown with wiki links, math, highlights, strikethrough, footnotes and bare addresses.

The text of a block is its source lines joined by newlines; nodes have offsets into that text. Emphasis is resolved
on a linked list of delimiter runs, with the least opener that is worth looking at kept for each kind of closer.
"""

from __future__ import annotations

import html.entities
import re
import unicodedata
from dataclasses import dataclass, field

from inkgraph.functions.blocks import ANGLE, LABEL, TITLE, bare_destination, normal_label

#: The ASCII punctuation that a backslash escapes.
ESCAPABLE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
REFERENCE = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]{0,31}));")
URI = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>\x00-\x20\x7f]*)>")
EMAIL = re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)>")
BARE = re.compile(r"(?:https?://|www\.)[^\s<>]*")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@")
DOMAIN = re.compile(r"[A-Za-z0-9._-]*")
NOTE = re.compile(r"\[\^([^\s\[\]]+)\]")


@dataclass
class Inline:
    kind: str
    start: int
    end: int
    text: str = ""
    children: list[Inline] = field(default_factory=list)
    attrs: dict = field(default_factory=dict)


class _Run:
    """A delimiter run: text that may open or close emphasis."""

    def __init__(self, char: str, node: Inline, opens: bool, closes: bool):
        self.char, self.node, self.opens, self.closes = char, node, opens, closes
        self.length = self.whole = node.end - node.start


def decode_reference(text: str) -> str | None:
    """The characters that ``text``, which must be exactly one character reference, stands for."""
    found = REFERENCE.fullmatch(text)
    if not found:
        return None
    if found[3]:
        return html.entities.html5.get(found[3] + ";")
    code = int(found[1]) if found[1] else int(found[2], 16)
    return "�" if not code or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)


def _valid_domain(domain: str) -> bool:
    parts = domain.split(".")
    return len(parts) > 1 and all(p and p[0] not in "-_" and p[-1] not in "-_" for p in parts) and not any("_" in p for p in parts[-2:])


def _trimmed(text: str, start: int, end: int) -> int:
    surplus = text.count(")", start, end) - text.count("(", start, end)
    while end > start:
        if text[end - 1] == ")" and surplus > 0:
            surplus -= 1
        elif text[end - 1] not in "?!.,:*_~":
            break
        end -= 1
    return end


def bare_address(text: str, at: int, stop: int) -> int | None:
    """End of the web or mail address that starts at ``at``, if one does."""
    if found := BARE.match(text, at, stop):
        end = _trimmed(text, at, found.end())
        host = at + (0 if text.startswith("www.", at) else text.index("//", at) + 2 - at)
        domain = DOMAIN.match(text, host, end).end() if host <= end else host
        return end if _valid_domain(text[host:domain]) and (domain == end or text[domain] in "/?#") else None
    if found := LOCAL.match(text, at, stop):
        end = _trimmed(text, at, DOMAIN.match(text, found.end(), stop).end())
        domain = text[found.end() : end]
        return end if domain and _valid_domain(domain) and domain[-1].isascii() and domain[-1].isalpha() else None
    return None


class InlineParser:
    def __init__(self, text: str, definitions: dict[str, tuple[str, str | None]], notes: set[str]):
        self.text, self.definitions, self.notes = text, definitions, notes
        self.no_code: set[int] = set()
        # the end of the line that was last asked for, and up to where no wiki link closes
        self.line_end, self.no_wiki = -1, -1
        # openers from the start of the stack that are known not to begin links any more
        self.inactive = 0

    def _line_end(self, at: int, end: int) -> int:
        if self.line_end < at:
            found = self.text.find("\n", at)
            self.line_end = found if found >= 0 else max(end, at)
        return self.line_end

    def parse(self) -> list[Inline]:
        text, out, runs, brackets = self.text, [], [], []
        end = len(text.rstrip(" \t"))
        at = 0
        while at < end:
            before = text[at - 1] if at else "\n"
            char = text[at]
            if (before.isspace() or before in "*_~(") and char.isascii() and (char.isalnum() or char in "._%+-"):
                stop = bare_address(text, at, self._line_end(at, end))
                if stop:
                    uri = text[at:stop]
                    out.append(Inline("autolink", at, stop, uri, attrs={"email": not BARE.match(uri)}))
                    at = stop
                    continue
            found = self._construct(char, at, end, out, runs, brackets)
            if found:
                at = found
                continue
            start = at
            at += 1
            if char.isspace() or char.isalnum() or ord(char) > 127:
                while at < end and (text[at].isalnum() or ord(text[at]) > 127) and not (text[at - 1].isspace() and text[at].isascii()):
                    at += 1
            if out and out[-1].kind == "text" and out[-1].end == start and not out[-1].attrs:
                out[-1].end = at
            else:
                out.append(Inline("text", start, at))
        self._emphasis(out, runs, 0)
        return self._finish(out)

    def _finish(self, nodes: list[Inline]) -> list[Inline]:
        """Texts that touch as one, with their characters, at all depths."""
        whole = Inline("root", 0, 0, children=nodes)
        todo = [whole]
        while todo:
            node = todo.pop()
            if node.children:
                node.children = self._merged(node.children)
                todo += node.children
        return whole.children

    def _merged(self, nodes: list[Inline]) -> list[Inline]:
        out: list[Inline] = []
        for node in nodes:
            if node.kind != "text":
                out.append(node)
            elif node.start < node.end:
                if out and out[-1].kind == "text" and out[-1].end == node.start:
                    out[-1].end = node.end
                else:
                    out.append(Inline("text", node.start, node.end))
                out[-1].text = self.text[out[-1].start : out[-1].end]
        return out

    def _construct(self, char: str, at: int, end: int, out: list, runs: list, brackets: list) -> int | None:
        """Parse what begins with ``char``; the offset after it, or None if it is text."""
        text = self.text
        if char == "\\":
            if at + 1 < end and text[at + 1] in ESCAPABLE:
                out.append(Inline("escaped", at, at + 2, text[at + 1]))
                return at + 2
            if text.startswith("\n", at + 1):
                return self._break(at, at + 1, out)
        elif char == "\n":
            return self._break(at, at, out)
        elif char == "&":
            if (found := REFERENCE.match(text, at)) and (value := decode_reference(found[0])) is not None:
                out.append(Inline("reference", at, found.end(), value))
                return found.end()
        elif char == "`":
            return self._code(at, end, out)
        elif char == "$":
            return self._math(at, end, out)
        elif char == "<":
            if found := URI.match(text, at) or EMAIL.match(text, at):
                out.append(Inline("autolink", at, found.end(), found[1], attrs={"email": found.re is EMAIL}))
                return found.end()
        elif char == "!" and text.startswith("[", at + 1):
            out.append(node := Inline("text", at, at + 2, attrs={"mark": True}))
            brackets.append([node, len(out) - 1, len(runs), True, True])
            return at + 2
        elif char == "[":
            if (found := NOTE.match(text, at)) and normal_label(found[1]) in self.notes:
                out.append(Inline("note", at, found.end(), found[1]))
                return found.end()
            if wiki := self._wiki(at, end, out):
                return wiki
            out.append(node := Inline("text", at, at + 1, attrs={"mark": True}))
            brackets.append([node, len(out) - 1, len(runs), False, True])
            return at + 1
        elif char == "]":
            return self._close_bracket(at, end, out, runs, brackets)
        elif char in "*_~=":
            stop = at
            while stop < end and text[stop] == char:
                stop += 1
            length = stop - at
            if (char == "=" and length != 2) or (char == "~" and length > 2):
                out.append(Inline("text", at, stop, attrs={"mark": True}))
                return stop
            opens, closes = self._flanking(char, at, stop)
            out.append(node := Inline("text", at, stop, attrs={"mark": True}))
            if opens or closes:
                runs.append(_Run(char, node, opens, closes))
            return stop
        return None

    def _break(self, at: int, newline: int, out: list) -> int:
        """A hard break after a backslash or two spaces, else a soft one; spaces at the line's end go."""
        hard = newline > at
        if not hard and out and out[-1].kind == "text":
            kept = self.text[out[-1].start : out[-1].end].rstrip(" \t")
            spaces = out[-1].end - out[-1].start - len(kept)
            hard = self.text[out[-1].end - spaces : out[-1].end].endswith("  ")
            out[-1].end -= spaces
        out.append(Inline("hard" if hard else "soft", at, newline + 1))
        return newline + 1

    def _code(self, at: int, end: int, out: list) -> int:
        text, stop = self.text, at
        while stop < end and text[stop] == "`":
            stop += 1
        length = stop - at
        if length not in self.no_code:
            look = stop
            while (look := text.find("`", look, end)) >= 0:
                after = look
                while after < end and text[after] == "`":
                    after += 1
                if after - look == length:
                    body = text[stop:look].replace("\n", " ")
                    literal = text[stop:look].replace("\n", "")
                    if len(body) > 1 and body[0] == body[-1] == " " and body.strip(" "):
                        literal = literal[text[stop] == " " : len(literal) - (text[look - 1] == " ")]
                    out.append(Inline("code", at, after, literal))
                    return after
                look = after
            self.no_code.add(length)
        out.append(Inline("text", at, stop, attrs={"mark": True}))
        return stop

    def _math(self, at: int, end: int, out: list) -> int | None:
        text, stop = self.text, at
        while stop < end and text[stop] == "$":
            stop += 1
        length = stop - at
        if length > 2 or (length == 1 and (stop >= end or text[stop].isspace())):
            return None if length <= 1 else self._plain(at, stop, out)
        look = stop
        while (look := text.find("$", look, end)) >= 0:
            after = look
            while after < end and text[after] == "$":
                after += 1
            if length == 2 and after - look >= 2:
                break
            if length == 1 and after - look == 1 and look > at + 1 and not text[look - 1].isspace() and not ("0" <= text[after : after + 1] <= "9"):
                break
            look = after
        if look < 0 or look == stop:
            return self._plain(at, stop, out)
        out.append(Inline("math", at, look + length, text[stop:look].replace("\n", ""), attrs={"display": length == 2}))
        return look + length

    @staticmethod
    def _plain(at: int, stop: int, out: list) -> int:
        out.append(Inline("text", at, stop, attrs={"mark": True}))
        return stop

    def _wiki(self, at: int, end: int, out: list) -> int | None:
        """[[target]] or [[target|label]] within one line; the target isn't trimmed."""
        text = self.text
        if not text.startswith("[[", at):
            return None
        if at < self.no_wiki:
            return None
        line_end = self._line_end(at, end)
        close = text.find("]]", at + 2, line_end)
        if close < 0:
            self.no_wiki = line_end
            return None
        target, bar, label = text[at + 2 : close].partition("|")
        if not target:
            return None
        out.append(Inline("wikilink", at, close + 2, label if bar else target, attrs={"target": target, "label": label if bar else None}))
        return close + 2

    def _flanking(self, char: str, start: int, stop: int) -> tuple[bool, bool]:
        before = self.text[start - 1] if start else "\n"
        after = self.text[stop] if stop < len(self.text) else "\n"
        punct = lambda c: unicodedata.category(c).startswith("P")
        left = not after.isspace() and (not punct(after) or before.isspace() or punct(before))
        right = not before.isspace() and (not punct(before) or after.isspace() or punct(after))
        if char == "_":
            return left and (not right or punct(before)), right and (not left or punct(after))
        return left, right

    def _target(self, at: int, end: int) -> tuple[str, str | None, int] | None:
        """(destination, title, offset after) of an inline link's parentheses at ``at``."""
        text = self.text
        space = re.compile(r"\s*")
        at = space.match(text, at + 1).end()
        if text.startswith(")", at):
            return "", None, at + 1
        if angle := ANGLE.match(text, at):
            dest, at = angle[1], angle.end()
        elif text.startswith("<", at) or (stop := bare_destination(text, at)) is None:
            return None
        else:
            dest, at = text[at:stop], stop
        gap = space.match(text, at).end()
        title = TITLE.match(text, gap) if gap > at else None
        if title:
            gap = space.match(text, title.end()).end()
        if not text.startswith(")", gap):
            return None
        return dest, next((g for g in title.groups() if g is not None), "") if title else None, gap + 1

    def _close_bracket(self, at: int, end: int, out: list, runs: list, brackets: list) -> int | None:
        if not brackets:
            return None
        opener, index, first_run, image, active = brackets.pop()
        self.inactive = min(self.inactive, len(brackets))
        if not active:
            return None
        found = self._target(at + 1, end) if self.text.startswith("(", at + 1) else None
        if found is None:
            label, after = None, at + 1
            if reference := LABEL.match(self.text, at + 1):
                label, after = reference[1], reference.end()
            if not label:
                label = self.text[opener.end : at]
            known = self.definitions.get(normal_label(label)) if label.strip() and "[" not in label.replace("\\[", "") else None
            if known is None:
                return None
            found = known[0], known[1], after
        dest, title, after = found
        inner = out[index + 1 :]
        del out[index:]
        self._emphasis(inner, runs, first_run)
        del runs[first_run:]
        out.append(Inline("image" if image else "link", opener.start, after, children=inner, attrs={"dest": dest, "title": title}))
        if not image:
            for other in brackets[self.inactive :]:
                if not other[3]:
                    other[4] = False
            self.inactive = len(brackets)
        return after

    def _emphasis(self, nodes: list[Inline], runs: list[_Run], first: int) -> None:
        """Resolve the runs from ``first`` on, whose nodes are all in ``nodes``, which is rebuilt."""
        live = runs[first:]
        if not live:
            return
        place = {id(n): i for i, n in enumerate(nodes)}
        # a doubly linked list over the nodes, by index; new nodes are put at the end
        after = [*range(1, len(nodes)), -1]
        before = [*range(-1, len(nodes) - 1)]
        items = list(nodes)
        head = 0
        stack: list[_Run] = []
        lowest: dict[tuple, int] = {}
        serial = 0
        numbers: list[int] = []
        for run in live:
            while run.closes and run.length:
                key = (run.char, run.opens, run.whole % 3 if run.char in "*_" else run.length)
                floor = lowest.get(key, -1)
                k = len(stack) - 1
                while k >= 0 and numbers[k] > floor:
                    other = stack[k]
                    if other.char == run.char and (
                        other.length == run.length
                        if run.char in "~="
                        else not ((other.closes or run.opens) and (other.whole + run.whole) % 3 == 0 and (other.whole % 3 or run.whole % 3))
                    ):
                        break
                    k -= 1
                else:
                    lowest[key] = numbers[-1] if numbers else -1
                    break
                opener = stack[k]
                del stack[k + 1 :], numbers[k + 1 :]
                size = run.length if run.char in "~=" else 2 if opener.length > 1 and run.length > 1 else 1
                kind = {"~": "strike", "=": "highlight"}.get(run.char) or ("strong" if size == 2 else "emphasis")
                a, b = place[id(opener.node)], place[id(run.node)]
                children, i = [], after[a]
                while i != b:
                    children.append(items[i])
                    i = after[i]
                made = Inline(kind, opener.node.end - size, run.node.start + size, children=[c for c in children if c.kind != "text" or c.start < c.end])
                opener.node.end -= size
                run.node.start += size
                opener.length -= size
                run.length -= size
                items.append(made)
                at = len(items) - 1
                after.append(b)
                before.append(a)
                after[a], before[b] = at, at
                if not opener.length:
                    stack.pop()
                    numbers.pop()
            if run.length and run.opens:
                serial += 1
                stack.append(run)
                numbers.append(serial)
        out, i = [], head
        while i != -1:
            if items[i].kind != "text" or items[i].start < items[i].end:
                out.append(items[i])
            i = after[i]
        nodes[:] = out


def flatten(nodes: list[Inline]) -> str:
    """Plain text: marks dropped, references decoded, breaks as spaces."""
    out, todo = [], [*reversed(nodes)]
    while todo:
        node = todo.pop()
        if node.children or node.kind in ("emphasis", "strong", "strike", "highlight", "link", "image"):
            todo += reversed(node.children)
        else:
            out.append(" " if node.kind in ("soft", "hard") else node.text)
    return "".join(out)


def wikilinks(nodes: list[Inline]) -> list[Inline]:
    """All wiki links in document order."""
    out, todo = [], [*reversed(nodes)]
    while todo:
        node = todo.pop()
        if node.kind == "wikilink":
            out.append(node)
        todo += reversed(node.children)
    return out
