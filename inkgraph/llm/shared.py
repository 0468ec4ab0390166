"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import itertools
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges of hashes in which a sample is ordered.
SLICES = 64
#: Bytes of an Arrow batch of texts, in place of Spark's default.
BATCH_BYTES = 1 << 20
#: Rows of one key from which a join broadcasts what the key meets; a table has at most its rows by this of such keys.
HOT = 100_000
#: Bits a key of a bitmap of keys, bits that a key sets, and words of 64 bits that a bitmap has at most.
KEY_BITS, KEY_SPOTS, KEY_WORDS = 16, 3, 1 << 22
_SPOT_FACTORS = np.random.default_rng(7).integers(0, 2**63, KEY_SPOTS, np.uint64) * np.uint64(2) + np.uint64(1)

_roots: dict[str, tuple[SparkSession, str]] = {}
_serial = itertools.count()
_open: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """URI of this application's folder below ``spark.checkpoint.dir``, resolved as Spark resolves paths.

    Where that setting is absent: a temporary folder under a local master, else a folder beside the warehouse's
    tables, if those aren't on one machine's disk.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base:
            base = _qualified(spark, base)
        elif spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="scratch-")
        else:
            base = _qualified(spark, spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch")
            if base.startswith("file:"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        _roots[app] = (spark, f"{base.rstrip('/')}/work-{uuid.uuid4().hex}")
    return _roots[app][1]


def _qualified(spark: SparkSession, path: str) -> str:
    """The URI of ``path``: one without a scheme is of the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + uri[len("file:") :] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{next(_serial):05d}-{name}"
    _open.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, root in _roots.values():
        if root.startswith("file://"):
            import shutil

            shutil.rmtree(root[len("file://") :], ignore_errors=True)
            continue
        try:
            delete_path(spark, root)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and the planner knows its size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for ``df``, once nothing reads it any more."""
    delete_path(df.sparkSession, df._scratch_path)
    _open.remove(df._scratch_path)


@contextmanager
def only(spark: SparkSession):
    """Deletes what is written to the shared folder meanwhile, but for the tables given to what it yields."""
    before, kept = set(_open), set()
    yield lambda df: kept.add(df._scratch_path)
    for path in [p for p in _open if p not in before and p not in kept]:
        delete_path(spark, path)
        _open.remove(path)


def open_filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI below the shared folder; usable on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col) % modulus


def text_key(text: Column) -> Column:
    """Hash that tells texts from each other; a null text has that of an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan, dealt out anew where it has fewer tasks than there are cores; large tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def hashed_sample(df: DataFrame, class_col: str, id_col: str, per_class: int) -> DataFrame:
    """At most ``per_class`` ids of each class, those of the smallest hash.

    Hashes are uniform, so a limit on them that lets half as many again through, by each class's count, leaves the
    ordering of ids a bounded number of rows whatever the table's size. They are ordered within SLICES ranges of
    hashes, whose sizes tell what goes before each."""
    rows = df.select(F.col(class_col).alias("_class"), F.col(id_col).alias("_id")).where("_class IS NOT NULL AND _id IS NOT NULL")
    rows = rows.withColumn("_hash", F.xxhash64("_id"))
    counts = {r[0]: r[1] for r in rows.groupBy("_class").count().collect()}
    kind = rows.schema["_class"].dataType
    schema = T.StructType([T.StructField("_class", kind), T.StructField("_limit", T.DoubleType())])
    limits = F.broadcast(df.sparkSession.createDataFrame([(value, min(1.0, (1.5 * per_class + 100) / n)) for value, n in counts.items()], schema))
    at, limit = F.col("_hash") / 2.0**64 + 0.5, F.col("_limit")
    few = rows.join(limits, "_class").where(at <= limit).withColumn("_slice", F.floor(at / limit * SLICES))
    before, seen = [], {}
    for value, number, n in sorted(map(tuple, few.groupBy("_class", "_slice").count().collect())):
        before.append((value, number, seen.get(value, 0)))
        seen[value] = seen.get(value, 0) + n
    schema = T.StructType([T.StructField("_class", kind), T.StructField("_slice", T.LongType()), T.StructField("_before", T.LongType())])
    wanted = F.broadcast(df.sparkSession.createDataFrame([b for b in before if b[2] < per_class], schema))
    order = Window.partitionBy("_class", "_slice").orderBy("_hash", "_id")
    ranked = few.join(wanted, ["_class", "_slice"]).withColumn("_rank", F.col("_before") + F.row_number().over(order))
    return ranked.where(F.col("_rank") <= per_class).select(F.col("_class").alias(class_col), F.col("_id").alias(id_col))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES from now on, unless the session has its own limit: what Python workers
    hold follows the batch, and a batch of long texts is large."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None and spark.conf.isModifiable(name):
        spark.conf.set(name, str(BATCH_BYTES))


def tidy() -> None:
    """Give a worker's free memory back to its machine; a task calls this when it ends, as workers are used again."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` hasn't."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def with_struct(df: DataFrame, value: Column, names: list[str]) -> DataFrame:
    """``df`` with the fields ``names`` of the struct ``value`` as columns, which is evaluated once. Own columns of
    these names are replaced, all others stay."""
    own = fresh(df, "_struct")
    return df.withColumn(own, value).withColumns({n: F.col(f"{own}.{n}") for n in names}).drop(own)


def join_hot(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", count: str = "n") -> DataFrame:
    """Inner or left join of ``rows`` with ``table``, which has a row for each key at most and, in ``count``, how many
    rows the key has. Keys of HOT rows or more, of which there are few, are broadcast, so that no task gathers their
    rows."""
    hot = F.broadcast(table.where(F.col(count) >= HOT).drop(count))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(table.where(F.col(count) < HOT).drop(count), key, how))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where ``body`` names it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spots(keys: np.ndarray, words: int) -> np.ndarray:
    """Bits of ``words`` words of 64, a power of two, that each of ``keys`` sets: a row for each of its spots."""
    keys = keys.astype(np.int64).view(np.uint64)
    keys = keys ^ (keys >> np.uint64(32))
    return (keys * _SPOT_FACTORS[:, None]) >> np.uint64(64 - (64 * words - 1).bit_length())


def maybe_among(key: Column, keys: DataFrame) -> Column:
    """Whether ``keys``, a table of one column of longs that aren't null, may have ``key``, a long that isn't null: true
    for all that it has and up to 5 in 1,000 others.

    Tasks get a bitmap of the keys (a Bloom filter), so that rows which a join would drop needn't be sent to it whatever
    the sizes of both. It has two to four bytes a key and 32 MiB at most; beyond 17 million keys more others pass."""
    name = keys.columns[0]
    words = min(KEY_WORDS, 1 << max(0, (keys.count() * KEY_BITS // 64).bit_length()))

    def spots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.unique(_spots(batch[name].to_numpy(), words))
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bits": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    bitmap = np.zeros(words, np.int64)
    filled = keys.mapInPandas(spots, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap[filled["word"].to_numpy()] = filled["bits"].to_numpy()
    bitmap = bitmap.view(np.uint64)

    @F.pandas_udf("boolean")
    def held(values: pd.Series) -> pd.Series:
        out = np.ones(len(values), bool)
        for at in _spots(values.to_numpy(), words):
            out &= (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return pd.Series(out)

    return held(key)
