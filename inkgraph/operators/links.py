"""Wiki links: resolution to files and headings, backlinks, and diagnostics of what doesn't resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.functions import text as X

PROVENANCE = ["from_file", "from_heading_path", "from_start", "from_end", "from_line_start", "from_line_end", "from_content_hash"]


#: Why a link doesn't resolve, and how that is told.
NO_PATH, NO_STEM, MANY_FILES = "no file matches path '%s'", "no file matches '%s'", "'%s' matches multiple files: %s"
NO_HEADING, MANY_HEADINGS = "no heading named '%s'", "heading '%s' is ambiguous: %s"
UNRESOLVED = "wikilink '[[%s]]' in section '%s' of '%s' does not resolve: %s"


def resolve(links: DataFrame, sections: DataFrame, files: DataFrame) -> DataFrame:
    """Every link with target_file, target_heading_path and reason (null where it resolves).

    A target without a file part is the link's own file; one with a slash is a path, with or without .md; any other
    must be the stem of exactly one file. The heading part must be the text of exactly one heading there. Keys are
    counted before they are joined, so each link finds at most one row and hot targets cost no extra rows; all that
    an ambiguous key names is gathered only where a link has that key."""
    owner = sections.select(
        F.col("file").alias("from_file"), F.col("ord").alias("section_ord"), F.col("heading_path").alias("from_heading_path"),
        F.col("start").alias("from_start"), F.col("end").alias("from_end"), F.col("line_start").alias("from_line_start"),
        F.col("line_end").alias("from_line_end"), F.col("content_hash").alias("from_content_hash"),
    )
    target = F.col("target")
    rows = links.select(F.col("file").alias("from_file"), "section_ord", "link_ord", target.alias("raw_target"), X.target_file(target).alias("file_part"), X.target_heading(target).alias("heading_part"))
    rows = rows.join(owner, ["from_file", "section_ord"])
    paths = files.select(F.col("file").alias("key"))
    named = files.select("file", X.file_stem(F.col("file")).alias("stem")).distinct()
    stems = named.groupBy("stem").agg(F.count("*").alias("n"), F.min("file").alias("stem_file"))
    asked = rows.where(~F.col("file_part").contains("/") & (F.col("file_part") != "")).select(F.col("file_part").alias("stem")).distinct()
    unclear = stems.where("n > 1").join(asked, "stem", "left_semi").select("stem")
    listed = named.join(unclear, "stem", "left_semi").groupBy("stem").agg(F.array_sort(F.collect_list("file")).alias("stem_files"))
    stems = stems.join(listed, "stem", "left")
    slashed = F.col("file_part").contains("/")
    rows = rows.withColumn("with_md", F.when(slashed, F.concat(F.regexp_replace("file_part", r"\.md\z", ""), F.lit(".md"))))
    rows = rows.join(paths.select(F.col("key").alias("with_md"), F.lit(True).alias("md_known")), "with_md", "left")
    rows = rows.withColumn("exact", F.when(slashed, F.col("file_part")))
    rows = rows.join(paths.select(F.col("key").alias("exact"), F.lit(True).alias("exact_known")), "exact", "left")
    rows = rows.withColumn("stem", F.when(~slashed & (F.col("file_part") != ""), F.col("file_part"))).join(stems, "stem", "left")
    n = F.coalesce("n", F.lit(0))
    file = (
        F.when(F.col("file_part") == "", F.col("from_file"))
        .when(F.col("md_known"), F.col("with_md"))
        .when(F.col("exact_known"), F.col("exact"))
        .when(n == 1, F.col("stem_file"))
    )
    many = F.format_string(MANY_FILES, "file_part", F.array_join("stem_files", ", "))
    no_file = (
        F.when(slashed, F.format_string(NO_PATH, "file_part"))
        .when(n > 1, many)
        .otherwise(F.format_string(NO_STEM, "file_part"))
    )
    rows = rows.withColumns({"target_file": file, "no_file": F.when(file.isNull(), no_file)})
    named = sections.where(F.col("heading").isNotNull()).select(F.col("file").alias("target_file"), F.col("heading").alias("heading_part"), "ord", "heading_path")
    key = ["target_file", "heading_part"]
    heads = named.groupBy(*key).agg(F.count("*").alias("m"), F.min_by("heading_path", "ord").alias("path"))
    unclear = heads.where("m > 1").join(rows.select(*key).distinct(), key, "left_semi").select(*key)
    listed = named.join(unclear, key, "left_semi").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "heading_path"))), lambda s: s["heading_path"]).alias("paths"))
    rows = rows.join(heads.join(listed, key, "left"), key, "left")
    m = F.coalesce("m", F.lit(0))
    wants = F.col("heading_part").isNotNull() & F.col("target_file").isNotNull()
    no_heading = (
        F.when(wants & (m == 0), F.format_string(NO_HEADING, "heading_part"))
        .when(wants & (m > 1), F.format_string(MANY_HEADINGS, "heading_part", F.array_join("paths", ", ")))
    )
    found = F.when(m == 1, F.col("path"))
    return rows.select(*PROVENANCE, "link_ord", "raw_target", "target_file", found.alias("target_heading_path"), F.coalesce("no_file", no_heading).alias("reason"))


def backlinks(resolved: DataFrame) -> DataFrame:
    """The resolved links as edges."""
    return resolved.where("reason IS NULL").drop("reason")


def link_diagnostics(resolved: DataFrame) -> DataFrame:
    """(file, message) of each link that doesn't resolve."""
    said = F.format_string(UNRESOLVED, "raw_target", "from_heading_path", "from_file", "reason")
    return resolved.where("reason IS NOT NULL").select(F.col("from_file").alias("file"), said.alias("message"))
