"""Vaults: folders of Markdown files, or tables of (file, text)."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders that wait when the driver leaves them to tasks.
FOLDERS = 256


class VaultError(ValueError):
    """The folder isn't there or isn't a folder."""


def _check(root: str) -> None:
    if not os.path.exists(root):
        raise VaultError(f"vault path '{root}' does not exist")
    if not os.path.isdir(root):
        raise VaultError(f"vault path '{root}' is not a directory")


def _entries(root: str, folder: str) -> tuple[list[str], list[str], list[tuple[str | None, str]]]:
    """(.md files in any case, relative to ``root``; folders; diagnostics) directly in ``folder``; links are left out."""
    found, folders, said = [], [], []
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError as error:
        return [], [], [(None, f"failed to read directory: {error}")]
    for entry in entries:
        try:
            if entry.is_dir(follow_symlinks=False):
                folders.append(entry.path)
            elif entry.is_file(follow_symlinks=False) and entry.name.lower().endswith(".md") and len(entry.name) > 3:
                relative = os.path.relpath(entry.path, root).replace(os.sep, "/")
                try:
                    relative.encode("utf-8")
                    found.append(relative)
                except UnicodeEncodeError:
                    said.append((None, f"path is not valid Unicode: {relative!r}"))
        except OSError as error:
            said.append((None, f"failed to inspect path: {error}"))
    return found, folders, said


def list_markdown(root: str, most: int | None = None) -> tuple[list[str], list[str], list[tuple[str | None, str]]]:
    """(paths relative to ``root`` in order, folders that weren't entered, diagnostics): all folders are entered, or as
    many as it takes until ``most`` wait."""
    _check(root)
    found, waiting, said = [], [root], []
    while waiting and (most is None or len(waiting) < most):
        files, folders, errors = _entries(root, waiting.pop(0))
        found += files
        waiting += folders
        said += errors
    return sorted(found), waiting, said


def hold(df: DataFrame) -> DataFrame:
    """``df`` as it is now, in the checkpoint folder that all executors share: later changes of its source, or lost
    executors, don't alter it. Where ``spark.checkpoint.dir`` is unset: a temporary folder under a local master, else
    one beside the warehouse's tables, if those aren't on one machine's disk."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and spark.sparkContext.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="vault-")
        elif not folder:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_vault"
            if folder.startswith(("file:", "/")):
                raise VaultError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def read_folder(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(documents (file, text), diagnostics (file, message)) of a folder that executors can read.

    The driver enters folders until FOLDERS wait, which tasks enter; tasks read the files, at once, so that the tables are
    the folder's state at this moment. What isn't UTF-8 or can't be read becomes a diagnostic."""
    known, waiting, said = list_markdown(root, FOLDERS)
    base, top = os.path.abspath(root), root

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["folder"]:
                todo = [folder]
                while todo:
                    files, folders, errors = _entries(top, todo.pop())
                    todo += folders
                    if files or errors:
                        yield pd.DataFrame([(f, None) for f in files] + errors, columns=["file", "message"], dtype=object)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, message in zip(batch["file"], batch["message"], strict=True):
                if name is None:
                    rows.append((None, None, message))
                    continue
                try:
                    with open(os.path.join(base, name), "rb") as file:
                        rows.append((name, file.read().decode("utf-8"), None))
                except (OSError, UnicodeDecodeError) as error:
                    rows.append((name, None, f"failed to read Markdown file: {error}"))
            if rows:
                yield pd.DataFrame(rows, columns=["file", "text", "message"])

    tasks = 4 * spark.sparkContext.defaultParallelism
    listing = spark.createDataFrame([(n, None) for n in known] + said, "file string, message string")
    if waiting:
        folders = spark.createDataFrame([(f,) for f in waiting], "folder string").repartition(min(len(waiting), tasks))
        listing = listing.union(folders.mapInPandas(walk, "file string, message string"))
    rows = hold(listing.repartition(tasks, "file").mapInPandas(read, "file string, text string, message string"))
    return rows.where("message IS NULL").select("file", "text"), rows.where("message IS NOT NULL").select("file", "message")


def read_store(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """As :func:`read_folder`, for any store that Spark reads. Names that begin with a dot or an underscore are
    skipped there, and links are followed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(root)
    at = F.length(F.lit(root.rstrip("/"))) + 2
    bare = F.regexp_replace("path", r"^file:/+", "/") if root.startswith("/") else F.col("path")
    rows = files.select(F.substr(bare, at).alias("file"), F.col("content").cast("string").alias("text"))
    sound = F.is_valid_utf8("text")
    bad = rows.where(~sound).select("file", F.lit("failed to read Markdown file: stream did not contain valid UTF-8").alias("message"))
    return rows.where(sound), bad


def write_file(root: str, file: str, text: str) -> None:
    """Write beside the file, then rename over it; nothing is left behind on failure."""
    path = os.path.join(root, file)
    beside = path + ".edit-tmp"
    try:
        with open(beside, "wb") as out:
            out.write(text.encode("utf-8"))
        os.replace(beside, path)
    except OSError:
        if os.path.exists(beside):
            os.unlink(beside)
        raise
