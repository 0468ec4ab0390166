"""Differences of two snapshots of a vault."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.functions import text as X


def diff_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, file) of files only one side has."""
    old, new = before.select("file").distinct(), after.select("file").distinct()
    added = new.join(old, "file", "left_anti").select(F.lit("added").alias("change"), "file")
    return added.union(old.join(new, "file", "left_anti").select(F.lit("removed").alias("change"), "file"))


def diff_sections(before: DataFrame, after: DataFrame, old_files: DataFrame, new_files: DataFrame) -> DataFrame:
    """(file, change, heading_path) within files that both sides have: added, removed and modified sections.

    Of added and of removed sections only the topmost are told, of modified ones only those without a change below.
    A path's ancestors are the texts before its separators, so both tests are equi-joins on these. Of sections that
    share a path the last counts."""
    common = old_files.select("file").distinct().join(new_files.select("file").distinct(), "file", "left_semi")
    last = lambda rows, name: rows.groupBy("file", "heading_path").agg(F.max_by("content_hash", "ord").alias(name))
    both = last(before, "old").join(last(after, "new"), ["file", "heading_path"], "full_outer").join(common, "file", "left_semi")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    changed = both.select("file", "heading_path", change.alias("change")).where("change IS NOT NULL")
    above = changed.select("file", "change", F.col("heading_path").alias("below"), F.explode(F.array_distinct(X.prefixes(F.col("heading_path")))).alias("heading_path"))
    told = changed.select("file", "heading_path", "change")
    covered = above.join(told, ["file", "change", "heading_path"], "left_semi").where("change <> 'modified'")
    covered = covered.select("file", "change", F.col("below").alias("heading_path")).distinct()
    parents = above.select("file", F.lit("modified").alias("change"), "heading_path").distinct()
    return told.join(covered.union(parents), ["file", "change", "heading_path"], "left_anti").select("file", "change", "heading_path")
