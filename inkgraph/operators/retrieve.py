"""Outlines, exact sections and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.functions import text as X


def outline(sections: DataFrame) -> DataFrame:
    """(file, ord, parent_ord, heading, level, heading_path, line_start, line_end) without bodies and hashes; the
    preamble has its name."""
    heading = F.coalesce("heading", F.lit("Preamble")).alias("heading")
    return sections.select("file", "ord", "parent_ord", heading, "level", "heading_path", "line_start", "line_end")


def get_sections(docs: DataFrame, sections: DataFrame, lookups: DataFrame) -> DataFrame:
    """``lookups`` (file, heading_path) with the section's content and provenance: exact, the first in document order.

    Only sections that are asked for meet their text, whose bytes are sliced."""
    wanted = lookups.select("file", "heading_path").distinct()
    first = F.row_number().over(Window.partitionBy("file", "heading_path").orderBy("ord"))
    found = sections.join(wanted, ["file", "heading_path"], "left_semi").withColumn("_n", first).where("_n = 1").drop("_n")
    sliced = F.expr("CAST(substring(CAST(text AS BINARY), start + 1, end - start) AS STRING)")
    rows = found.join(docs.select("file", "text"), "file")
    return rows.select("file", "heading_path", sliced.alias("content"), "level", "start", "end", "line_start", "line_end", "content_hash")


def nearest(candidates: DataFrame, needles: DataFrame, k: int = 3) -> DataFrame:
    """(needle_id, rank, candidate): the ``k`` candidates (key, candidate) of each needle (needle_id, key, needle) of
    its key, by edit distance of lower-cased strings, then by themselves."""
    pairs = needles.join(candidates, "key")
    order = Window.partitionBy("needle_id").orderBy(X.nearest_distance(F.col("needle"), F.col("candidate")), "candidate")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("needle_id", "rank", "candidate")
