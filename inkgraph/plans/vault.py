"""A vault as a bundle of tables, with the six verbs: outline, get_section, search, backlinks, reindex, edit_section."""

from __future__ import annotations

import os
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.functions import text as X
from inkgraph.operators import diff, edit, links, parse, retrieve
from inkgraph.operators import search as ranked
from inkgraph.sources import vault as source


#: What failing requests say.
NOT_INDEXED, NO_PATH = "file '{file}' is not indexed", "heading path '{path}' was not found in file '{file}'"
NOT_RELATIVE, NOT_READ, NOT_WRITTEN = "file '{file}' is not a vault-relative path", "file '{file}' could not be read: {error}", "failed to write '{file}': {error}"


class NotFound(LookupError):
    """Nothing by that name; ``suggestions`` holds the nearest names."""

    def __init__(self, message: str, suggestions: list[str]):
        super().__init__(message)
        self.message, self.suggestions = message, suggestions


#: Replaced files after which a snapshot's tables are written anew, which ends their lineage.
REPLACED = 16


class Snapshot:
    """Tables of one state of the vault. The parser runs once for all of them."""

    def __init__(self, parsed: DataFrame, said: DataFrame, base: DataFrame | None):
        """Of parsed documents (file, text, parsed) and the diagnostics (file, message) of reading and parsing them;
        ``base`` is the cached table that ``parsed`` rests on."""
        self.parsed, self.said, self.base = parsed, said, base
        self.docs = self.parsed.select("file", "text")
        self.files = self.parsed.select("file")
        self.sections = parse.sections(self.parsed)
        # the link index: built when it is first asked for, and gone with the snapshot
        self.resolved = links.resolve(parse.raw_links(self.parsed), self.sections, self.files).persist()
        self.backlinks = links.backlinks(self.resolved)
        self.diagnostics = self.said.union(links.link_diagnostics(self.resolved)).orderBy(F.asc_nulls_first("file"), "message")

    @classmethod
    def build(cls, docs: DataFrame, said: DataFrame | None, digest: str) -> Snapshot:
        parsed = parse.parse_documents(docs.select("file", "text"), digest).persist()
        own = parse.document_diagnostics(parsed)
        return cls(parsed, own if said is None else own.union(said), parsed)

    def close(self, base: bool = True) -> None:
        """Let go of what is cached; not of the parsed documents if another snapshot rests on them."""
        self.resolved.unpersist()
        if base and self.base is not None:
            self.base.unpersist()


class Vault:
    def __init__(self, spark: SparkSession, root: str | None = None, docs: DataFrame | None = None, digest: str = "sha256"):
        """Of a folder (``root``) or of a table (``docs``: file, text); only a folder can be edited."""
        self.spark, self.root, self.digest, self._lock = spark, root, digest, threading.RLock()
        self.snapshot, self._replaced = self._load(docs), 0

    def _load(self, docs: DataFrame | None = None) -> Snapshot:
        if docs is not None:
            return Snapshot.build(docs, None, self.digest)
        return Snapshot.build(*source.read_folder(self.spark, self.root), self.digest)

    def files(self) -> DataFrame:
        return self.snapshot.files.orderBy("file")

    def diagnostics(self) -> DataFrame:
        return self.snapshot.diagnostics

    def _nearest(self, needle: str, candidates: DataFrame) -> list[str]:
        distance = X.nearest_distance(F.lit(needle), F.col("c"))
        return [r["c"] for r in candidates.toDF("c").orderBy(distance, "c").limit(3).collect()]

    def _file(self, file: str) -> str:
        """The indexed file that a request names; raises NotFound."""
        asked = self.spark.range(1).select(F.coalesce(X.normalize_path(F.lit(file)), F.translate(F.lit(file), "\\", "/"))).first()[0]
        if self.snapshot.files.where(F.col("file") == asked).isEmpty():
            raise NotFound(NOT_INDEXED.format(file=file), self._nearest(asked, self.snapshot.files))
        return asked

    def outline(self, file: str) -> DataFrame:
        return retrieve.outline(self.snapshot.sections.where(F.col("file") == self._file(file))).orderBy("ord")

    def get_section(self, file: str, heading_path: str) -> dict:
        key = self._file(file)
        own = self.snapshot.sections.where(F.col("file") == key)
        asked = self.spark.createDataFrame([(key, heading_path)], "file string, heading_path string")
        row = retrieve.get_sections(self.snapshot.docs, own, asked).first()
        if row is None:
            raise NotFound(NO_PATH.format(path=heading_path, file=key), self._nearest(heading_path, own.select("heading_path")))
        out = row.asDict()
        return {
            "content": out["content"],
            "provenance": {
                "file": key, "heading_path": heading_path, "byte_range": {"start": out["start"], "end": out["end"]},
                "line_range": {"start": out["line_start"], "end": out["line_end"]}, "content_hash": out["content_hash"],
            },
        }

    def search(self, query: str) -> DataFrame:
        return ranked.search(self.snapshot.sections, query)

    def backlinks(self, file: str, heading_path: str | None = None) -> DataFrame:
        rows = self.snapshot.backlinks.where(F.col("target_file") == self._file(file))
        if heading_path is not None:
            rows = rows.where(F.col("target_heading_path") == heading_path)
        return rows.orderBy("from_file", "from_heading_path", "link_ord")

    def reindex(self, docs: DataFrame | None = None) -> dict[str, list]:
        """Load the vault anew, tell what changed and take the new state; on failure the old state stays."""
        with self._lock:
            fresh = self._load(docs)
            old = self.snapshot
            changes = self.difference(old, fresh)
            self.snapshot, self._replaced = fresh, 0
            old.close()
            return changes

    @staticmethod
    def changes(old: Snapshot, new: Snapshot) -> DataFrame:
        """(file, change, heading_path) of all that changed between the states' files and sections; the path is null for
        files that only one side has."""
        files = diff.diff_files(old.files, new.files).select("file", "change", F.lit(None).cast("string").alias("heading_path"))
        return files.union(diff.diff_sections(old.sections, new.sections, old.files, new.files))

    @staticmethod
    def difference(old: Snapshot, new: Snapshot) -> dict[str, list]:
        """What :meth:`changes` tells as one nested result."""
        out: dict[str, list] = {"files_added": [], "files_removed": [], "files_changed": []}
        for file, change, path in Vault.changes(old, new).orderBy("file", "heading_path").collect():
            if path is None:
                out[f"files_{change}"].append(file)
                continue
            if not out["files_changed"] or out["files_changed"][-1]["file"] != file:
                out["files_changed"].append({"file": file, "sections_added": [], "sections_removed": [], "sections_modified": []})
            out["files_changed"][-1][f"sections_{change}"].append(path)
        return out

    def reindex_file(self, file: str) -> None:
        """Read one file again, of any extension, and resolve all links anew."""
        with self._lock:
            self._replace(*self._read(file))

    def _read(self, file: str) -> tuple[str, str]:
        """(key, text on disk) of the file that a request names; raises NotFound."""
        key = self.spark.range(1).select(X.normalize_path(F.lit(file))).first()[0]
        if key is None:
            raise NotFound(NOT_RELATIVE.format(file=file), [])
        try:
            with open(os.path.join(self.root, key), encoding="utf-8", newline="") as handle:
                return key, handle.read()
        except (OSError, UnicodeDecodeError) as error:
            raise NotFound(NOT_READ.format(file=file, error=error), self._nearest(key, self.snapshot.files)) from error

    def _replace(self, file: str, text: str) -> None:
        """Take ``text`` for a file; only it is parsed. Diagnostics of reading and parsing stay those of the last
        whole load."""
        old = self.snapshot
        one = parse.parse_documents(self.spark.createDataFrame([(file, text)], "file string, text string"), self.digest)
        parsed = old.parsed.where(F.col("file") != file).unionByName(one)
        self._replaced += 1
        base = old.base
        if self._replaced % REPLACED == 0:
            parsed, base = source.hold(parsed), None
        old.close(base is None)
        self.snapshot = Snapshot(parsed, old.said, base)

    def edit_section(self, file: str, heading_path: str, body: str, expected_hash: str) -> DataFrame:
        """Replace a section's body if its hash is ``expected_hash``; the file's outline with hashes. The file on disk,
        not the index, is what is edited."""
        with self._lock:
            key, text = self._read(file)
            try:
                edited = edit.apply_edit(key, text, heading_path, body, expected_hash, self.digest)
            except edit.EditRejected as error:
                if error.kind != "not_found":
                    raise
                own = parse.sections(parse.parse_documents(self.spark.createDataFrame([(key, text)], "file string, text string")))
                raise NotFound(error.message, self._nearest(heading_path, own.select("heading_path"))) from error
            try:
                source.write_file(self.root, key, edited)
            except OSError as error:
                raise edit.EditRejected("io", NOT_WRITTEN.format(file=key, error=error)) from error
            self._replace(key, edited)
            own = self.snapshot.sections.where(F.col("file") == key)
            return retrieve.outline(own).join(own.select("ord", "content_hash"), "ord").orderBy("ord")
