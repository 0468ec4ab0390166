"""Corpus pipeline: toxicity, language, repeated lines, near-duplicates, then packing into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.llm import langid, linededup, nearsets, packing, pieces, toxicity
from inkgraph.llm.queries import TOKENIZER
from inkgraph.llm.shared import discard, fold, materialize, only


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model doesn't predict; it learns as op10 does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 4) != 2)
    model = toxicity.fit(docs, labels)
    return docs.where(toxicity.predict(model, F.col("text"))["predicted"] == 0)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told by more than a narrow margin; learned as in op2."""
    learned = docs.where(F.coalesce(fold("doc_id", 3) != 1, F.lit(False)))
    return docs.where(~langid.predict(langid.fit(learned), F.col("text"))["rejected"])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the lines that other rows repeat; n_chars follows the text."""
    columns = docs.columns
    out = linededup.dedup_lines(docs)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each group of near-duplicates: texts whose five-word shingles have a Jaccard
    likeness of 0.8 or more, directly or by others; found by SimHash tries first, as :mod:`inkgraph.llm.nearsets` says."""
    return nearsets.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in bins of permitted lengths."""
    import public_tokenizers

    return packing.pack(pieces.with_lengths(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Compressed lengths and links by others cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each but the last is written and read again, and what else a stage has
    written is deleted then, with the table that it read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with only(spark) as keep:
            docs = materialize(stage(spark, before, sf_dir), f"pipeline-{name}")
            keep(docs)
        if number:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
