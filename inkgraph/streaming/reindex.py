"""Vault changes as a stream: documents that arrive in a folder of tables, version by version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.operators import diff, parse

ARRIVING = "version long, file string, text string"


def stream_sections(spark: SparkSession, folder: str, digest: str = "sha256") -> DataFrame:
    """Streaming sections of Parquet files of (file, text) that appear in ``folder``."""
    docs = spark.readStream.schema("file string, text string").parquet(folder)
    return parse.sections(parse.parse_documents(docs, digest))


def stream_changes(spark: SparkSession, folder: str, store: str, tell: Callable[[DataFrame, DataFrame, int], None], digest: str = "sha256"):
    """Start a query over Parquet files of (version, file, text) that appear in ``folder``, versions being whole
    snapshots of a vault in rising order, each in any number of files. A version is whole once a later one has begun to
    arrive; then ``tell`` gets its file and section changes against the version before it (against nothing, for the
    first) and its number.

    ``store`` is a folder that the driver and executors share. It keeps the stream's position, the files and sections of
    what has arrived, and which version was told last, so that a restart goes on from there. A batch that is taken again
    replaces what it wrote; a version is told again only if the stream ended between telling it and noting that."""

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # one row a file, as a file without sections counts too
        parsed = parse.parse_documents(batch, digest).select("version", "file", F.col("parsed.sections").alias("sections"))
        parsed.write.mode("overwrite").parquet(f"{store}/arrived/batch={number}")
        held = session.read.parquet(f"{store}/arrived").drop("batch")
        versions = sorted(r[0] for r in held.select("version").distinct().collect())
        told = _last(session)
        for version in versions[:-1]:
            if told is not None and version <= told:
                continue
            before, after = (held.where(F.col("version") == v) if v is not None else held.limit(0) for v in (told, version))
            sections = lambda rows: rows.select("file", F.inline("sections"))
            tell(diff.diff_files(before, after), diff.diff_sections(sections(before), sections(after), before, after), version)
            session.createDataFrame([(version,)], "version long").write.mode("append").parquet(f"{store}/told")
            told = version

    def _last(session: SparkSession) -> int | None:
        path = session._jvm.org.apache.hadoop.fs.Path(f"{store}/told")
        if not path.getFileSystem(session._jsc.hadoopConfiguration()).exists(path):
            return None
        return session.read.schema("version long").parquet(f"{store}/told").agg(F.max("version")).first()[0]

    docs = spark.readStream.schema(ARRIVING).parquet(folder)
    return docs.writeStream.option("checkpointLocation", f"{store}/position").foreachBatch(step).start()
