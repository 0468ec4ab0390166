"""Section edits: validation, splice and skeleton check, for one document or a table of edits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.functions.document import WHITE, heading_text, parse
from inkgraph.functions.sections import Section, section_tree


#: What each rejection says.
SAID = {
    "not_found": "heading path '{path}' was not found in file '{file}'",
    "invalid_target": "the preamble of '{file}' has no heading and cannot be edited with edit_section",
    "conflict": "section '{path}' in '{file}' changed since it was read: expected hash {expected}, current hash {current}",
    "escape": "new body contains heading '{heading}' at level {found}, which would escape section '{path}' at level {level}; "
    "use headings deeper than level {level} or edit a higher-level section",
    "restructure": "the edit would change sections outside '{path}' (for example by merging into an adjacent section); edit rejected, file unmodified",
}


class EditRejected(ValueError):
    """kind: not_found, invalid_target, conflict, escape, restructure or io."""

    def __init__(self, kind: str, message: str, current_hash: str | None = None):
        super().__init__(message)
        self.kind, self.message, self.current_hash = kind, message, current_hash


def escaping_heading(body: str, level: int) -> tuple[str, int] | None:
    """The first top-level heading of ``body`` that would end a section of ``level``."""
    doc = parse("\n" + body)
    for block in doc.blocks:
        if block.kind == "heading" and block.attrs["level"] <= level:
            return heading_text(doc, block), block.attrs["level"]
    return None


def splice(source: bytes, heading_end: int, end: int, body: str) -> bytes:
    """Source with the bytes between the heading and the section's end replaced."""
    body = body.rstrip(WHITE)
    if not body:
        return source[:heading_end] + source[end:]
    line = b"\r\n" if source.startswith(b"\r\n", heading_end) else b"\n"
    return source[:heading_end] + line + body.encode("utf-8", "surrogatepass") + source[end:]


def skeleton(sections: list[Section], edited: str) -> list[tuple[str, int]]:
    """(path, level) of all sections but those below the edited path."""
    hidden: set[int] = set()
    out = []
    for section in sections:
        if section.parent_ord in hidden:
            hidden.add(section.ord)
            continue
        out.append((section.heading_path, section.level))
        if section.heading_path == edited:
            hidden.add(section.ord)
    return out


def apply_edit(file: str, source: str, heading_path: str, body: str, expected_hash: str, digest: str = "sha256") -> str:
    """The edited source; raises EditRejected."""
    old = section_tree(parse(source), digest)
    section = next((s for s in old if s.heading_path == heading_path), None)

    def rejected(kind: str, current: str | None = None, **more) -> EditRejected:
        return EditRejected(kind, SAID[kind].format(file=file, path=heading_path, expected=expected_hash, current=current, **more), current)

    if section is None:
        raise rejected("not_found")
    if section.heading_end is None:
        raise rejected("invalid_target")
    if section.content_hash != expected_hash:
        raise rejected("conflict", section.content_hash)
    if found := escaping_heading(body, section.level):
        raise rejected("escape", heading=found[0], found=found[1], level=section.level)
    edited = splice(source.encode("utf-8", "surrogatepass"), section.heading_end, section.end, body).decode("utf-8", "surrogatepass")
    if skeleton(section_tree(parse(edited), digest), heading_path) != skeleton(old, heading_path):
        raise rejected("restructure")
    return edited


def edit_many(docs: DataFrame, edits: DataFrame, digest: str = "sha256") -> DataFrame:
    """``edits`` (file, heading_path, body, expected_hash; at most one a file) with status, message, current_hash and
    the edited text, null unless status is ok. Edits of unknown files are not_found."""

    @F.pandas_udf("status string, message string, current_hash string, edited string")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            out = []
            for file, source, path, body, wanted in zip(*columns, strict=True):
                if source is None:
                    out.append(("not_found", f"file '{file}' could not be read", None, None))
                    continue
                try:
                    out.append(("ok", None, None, apply_edit(file, source, path, body or "", wanted, digest)))
                except EditRejected as error:
                    out.append((error.kind, error.message, error.current_hash, None))
            yield pd.DataFrame(out, columns=["status", "message", "current_hash", "edited"])

    rows = edits.join(docs.select("file", "text"), "file", "left")
    rows = rows.withColumn("_r", run("file", "text", "heading_path", "body", "expected_hash"))
    return rows.select("file", "heading_path", "_r.*")
