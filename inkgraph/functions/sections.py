"""The section tree of one document, flat and in document order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from inkgraph.functions.blake3 import blake3_many
from inkgraph.functions.document import Document, heading_text, line_of, links

PREAMBLE = "Preamble"
SEPARATOR = " > "


def sha256_many(inputs: Sequence[bytes]) -> list[str]:
    return [hashlib.sha256(data).hexdigest() for data in inputs]


DIGESTS: dict[str, Callable[[Sequence[bytes]], list[str]]] = {"sha256": sha256_many, "blake3": blake3_many}


@dataclass
class Section:
    ord: int
    parent_ord: int | None
    level: int
    heading: str | None
    heading_path: str
    start: int
    end: int
    heading_start: int | None
    heading_end: int | None
    line_start: int = 0
    line_end: int = 0
    content_hash: str = ""

    def row(self) -> tuple:
        return tuple(self.__dict__.values())


def section_tree(doc: Document, digest: str = "sha256") -> list[Section]:
    """Sections of the top-level headings; blocks before the first are a preamble of level 0.

    A section's parent is the nearest section before it of a smaller level. Of siblings of one text the n-th is
    called ``text[n]``; a preamble counts as the first ``Preamble``."""
    out: list[Section] = []
    stack: list[Section] = []
    seen: dict[tuple[int | None, str], int] = {}
    at = doc.offsets
    for block in doc.blocks:
        start, end = at(block.start), at(block.end)
        if block.kind == "heading":
            level, text = block.attrs["level"], heading_text(doc, block)
            while stack and stack[-1].level >= level:
                stack.pop()
            if stack and stack[0].level == 0:
                stack.pop(0)
            parent = stack[-1] if stack else None
            key = (parent.ord if parent else None, text)
            seen[key] = seen.get(key, 0) + 1
            name = text if seen[key] == 1 else f"{text}[{seen[key]}]"
            path = parent.heading_path + SEPARATOR + name if parent and parent.heading_path else name
            stack.append(Section(len(out), parent.ord if parent else None, level, text, path, start, end, start, end))
            out.append(stack[-1])
        elif not stack:
            stack.append(Section(0, None, 0, None, PREAMBLE, start, end, None, None))
            out.append(stack[-1])
            seen[(None, PREAMBLE)] = 1
        for section in stack:
            section.end = max(section.end, end)
    data = doc.text.encode("utf-8", "surrogatepass")
    newlines = [i for i, b in enumerate(data) if b == 10] if out else []
    for section, hashed in zip(out, DIGESTS[digest]([data[s.start : s.end] for s in out]), strict=True):
        section.line_start = line_of(newlines, section.start)
        section.line_end = line_of(newlines, max(section.end - 1, section.start))
        section.content_hash = hashed
    return out


def owned_links(doc: Document, sections: list[Section]) -> list[tuple]:
    """(link_ord, start, end, target, label, section_ord) of each wiki link; its section is the deepest that holds
    its start. Links in no section are left out."""
    out, around, following = [], [], 0
    for block in doc.blocks:
        for start, end, target, label in links(doc, block):
            # links and sections both come in document order; those that hold the link nest
            while following < len(sections) and sections[following].start <= start:
                around.append(sections[following])
                following += 1
            while around and around[-1].end <= start:
                around.pop()
            if around:
                out.append((len(out), start, end, target, label, around[-1].ord))
    return out
