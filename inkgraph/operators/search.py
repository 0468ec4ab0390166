"""Ranked heading search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.functions import text as X


def with_tokens(sections: DataFrame) -> DataFrame:
    """Sections under a heading, with the tokens of heading and path."""
    named = sections.where(F.col("heading").isNotNull())
    return named.withColumns({"heading_tokens": X.tokens(F.col("heading")), "path_tokens": X.tokens(F.col("heading_path"))})


def search(sections: DataFrame, query: str) -> DataFrame:
    """Sections that match, best first; then the shallower, then by file and path. A query without tokens finds none."""
    asked = X.tokens(F.lit(query))
    rows = with_tokens(sections).withColumn("score", X.match_score(asked, F.col("heading_tokens"), F.col("path_tokens")))
    return rows.where("score IS NOT NULL").drop("heading_tokens", "path_tokens").orderBy(F.desc("score"), X.path_depth(F.col("heading_path")), "file", "heading_path")


def search_many(sections: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rank, score, file, heading_path) of every match of each of ``queries`` (query_id, query).

    A token matches another if one begins with the other, so that of a match the shorter token is a beginning of the
    longer. Sections and queries meet by equal texts: a section's tokens cut to the lengths that query tokens have with
    these tokens, and a query's tokens cut short with a section's whole ones. Only pairs that match are scored."""
    own = with_tokens(sections).withColumn("tokens", F.array_distinct(F.concat("heading_tokens", "path_tokens")))
    asked = queries.select("query_id", X.tokens(F.col("query")).alias("asked"))
    words = asked.select("query_id", F.explode("asked").alias("word")).distinct()
    lengths = sorted(r[0] for r in words.select(F.length("word")).distinct().collect())
    cut = lambda t: F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(t)), lambda n: F.substr(t, F.lit(1), n))
    begins = F.flatten(F.transform("tokens", cut)) if lengths else F.array().cast("array<string>")
    longer = own.select("file", "ord", F.explode(F.array_distinct(begins)).alias("word")).join(words, "word")
    shorter = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda n: F.substr("word", F.lit(1), n))
    starts = words.where(F.length("word") > 1).select("query_id", F.explode(shorter).alias("word")).distinct()
    whole = own.select("file", "ord", F.explode("tokens").alias("word")).join(starts, "word")
    pairs = longer.select("query_id", "file", "ord").union(whole.select("query_id", "file", "ord")).distinct()
    rows = pairs.join(own, ["file", "ord"]).join(asked, "query_id")
    scored = rows.withColumn("score", X.match_score(F.col("asked"), F.col("heading_tokens"), F.col("path_tokens"))).where("score IS NOT NULL")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), X.path_depth(F.col("heading_path")), "file", "heading_path", "ord")
    return scored.select("query_id", F.row_number().over(order).alias("rank"), "score", "file", "heading_path")
