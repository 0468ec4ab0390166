"""Line deduplication by probing a sharded minimal perfect hash instead of joining lines."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgraph.llm.shared import bound_batches, discard, fresh, materialize, open_filesystem, scratch_path, tidy

SPACE = " \t\n\x0b\x0c\r"
#: Line hashes in a shard of the index; a task holds one shard at a time.
SHARD_KEYS = 500_000
#: Bits per key on each level of the hash.
GAMMA = 2.0


def line_key(line: str) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(SPACE).encode("utf-8", "surrogatepass").lower()


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A splitmix64 step of ``keys``, another one for each level."""
    z = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: on each level a bit array marks the slots that a single key
    hit, keys of shared slots go on to the next level, and a key's number is the rank of its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(total + np.cumsum(bits, dtype=np.int64) - bits)
            total += int(bits.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            width = max(64, int(GAMMA * len(left)))
            slot = (_mix(left, len(levels)) % np.uint64(width)).astype(np.int64)
            bits = np.bincount(slot, minlength=width) == 1
            levels.append(bits.astype(np.uint8))
            left = left[~bits[slot]]
        return cls(levels)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for some of the keys that aren't members."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(rest):
                break
            slot = (_mix(keys[rest], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[slot] == 1
            out[rest[hit]] = self.ranks[level][slot[hit]]
            rest = rest[~hit]
        return out


def pack_shard(h1: np.ndarray, h2: np.ndarray, count: np.ndarray, keeper: np.ndarray) -> bytes:
    """Perfect hash of h1 with arrays of fingerprints (h2), document counts and keepers, in the order of its numbers.
    Of keys with one h1 the first is there; the others, which are few, follow in arrays of their own."""
    order = np.lexsort((h2, h1))
    h1, h2, count, keeper = h1[order], h2[order], count.astype(np.int64)[order], keeper[order]
    again = np.concatenate(([False], h1[1:] == h1[:-1])) if len(h1) else np.zeros(0, bool)
    more = {"more_h1": h1[again], "more_h2": h2[again], "more_count": count[again], "more_keeper": keeper[again]}
    h1, h2, count, keeper = h1[~again], h2[~again], count[~again], keeper[~again]
    mph = PerfectHash.build(h1)
    place = mph.lookup(h1)
    arrays = {}
    for name, values in (("fingerprint", h2), ("count", count), ("keeper", keeper)):
        arrays[name] = np.empty(len(h1), values.dtype)
        arrays[name][place] = values
    packed = {f"level{i}": np.packbits(bits) for i, bits in enumerate(mph.levels)}
    out = io.BytesIO()
    np.savez(out, widths=np.array([len(b) for b in mph.levels], np.int64), **arrays, **more, **packed)
    return out.getvalue()


class Shard:
    def __init__(self, data: bytes):
        with np.load(io.BytesIO(data)) as stored:
            widths = stored["widths"]
            self.mph = PerfectHash([np.unpackbits(stored[f"level{i}"], count=int(w)) for i, w in enumerate(widths)])
            self.fingerprint, self.count, self.keeper = stored["fingerprint"], stored["count"], stored["keeper"]
            self.more = [stored[f"more_{name}"] for name in ("h1", "h2", "count", "keeper")]

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document count, keeper); a count of 0 for lines that aren't in the index."""
        number = self.mph.lookup(h1)
        number[number >= 0] = np.where(self.fingerprint[number[number >= 0]] == h2[number >= 0], number[number >= 0], -1)
        found = number >= 0
        count, keeper = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        count[found], keeper[found] = self.count[number[found]], self.keeper[number[found]]
        for a, b, n, k in zip(*self.more, strict=True):
            same = (h1 == a) & (h2 == b)
            count[same], keeper[same] = n, k
        return count, keeper


#: Names a line key in 16 bytes.
digest = xxhash.xxh3_128_digest


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(digest, keys)), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


class LineIndex:
    """Files of shards in the shared folder, one each; a line's shard is h1 modulo their number."""

    def __init__(self, path: str, shards: int):
        self.path, self.shards = path, shards

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> LineIndex:
        """Index of the lines that at least ``min_docs`` documents hold; only these decide anything.

        Lines travel as 128-bit hashes, one per document and line, and are counted before and after the shuffle."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ids, keys = [], []
                for doc, text in zip(batch["_i"], batch["_t"], strict=True):
                    own = {line_key(line) for line in text.split("\n") if len(line) >= min_chars and len(line.strip(SPACE)) >= min_chars}
                    keys += own
                    ids += [doc] * len(own)
                h1, h2 = _hashes(keys)
                yield pd.DataFrame({"h1": h1.view(np.int64), "h2": h2.view(np.int64), "doc": np.array(ids, np.int64)})

        spark = docs.sparkSession
        # an id beside a null would come as a float
        lines = docs.select(F.col(id_col).cast("long").alias("_i"), F.col(text_col).alias("_t")).where("_i IS NOT NULL AND _t IS NOT NULL")
        lines = lines.mapInPandas(run, "h1 long, h2 long, doc long")
        known = lines.groupBy("h1", "h2").agg(F.countDistinct("doc").alias("count"), F.max("doc").alias("keeper"))
        known = materialize(known.where(F.col("count") >= min_docs), "line-counts")
        shards = max(1, -(-known.count() // SHARD_KEYS))

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            data = pack_shard(rows["h1"].to_numpy().view(np.uint64), rows["h2"].to_numpy().view(np.uint64), rows["count"].to_numpy(), rows["keeper"].to_numpy())
            return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "data": [data]})

        path = scratch_path(spark, "line-index")
        modulus = F.lit(shards)
        # unsigned remainder of h1: that of its upper 63 bits and of its lowest bit
        shard = ((F.shiftrightunsigned("h1", 1) % modulus) * 2 + F.col("h1").bitwiseAND(1)) % modulus
        dealt = known.withColumn("shard", shard.cast("int"))
        dealt.groupBy("shard").applyInPandas(build, "shard int, data binary").write.partitionBy("shard").parquet(path)
        discard(known)
        return cls(path, shards)


    def shard(self, fs, root: str, number: int) -> Shard | None:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector

        for info in fs.get_file_info(FileSelector(f"{root}/shard={number}", allow_not_found=True)):
            if info.path.endswith(".parquet"):
                with fs.open_input_file(info.path) as file:
                    return Shard(pq.ParquetFile(file).read(["data"])["data"][0].as_py())
        return None

    def probe(self, h1: np.ndarray, h2: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """On an executor: (document count, keeper) of each line. Every shard that has to be read is read once, and held
        alone, beginning with ``first``, so that tasks don't all ask for the same."""
        count, keeper = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        where = (h1 % np.uint64(self.shards)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        numbers, starts = np.unique(where[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        fs, root = open_filesystem(self.path)
        for turn in np.roll(np.arange(len(numbers)), -first % max(1, len(numbers))):
            part = order[starts[turn] : ends[turn]]
            if shard := self.shard(fs, root, int(numbers[turn])):
                count[part], keeper[part] = shard.probe(h1[part], h2[part])
        return count, keeper


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and columns n_lines (before) and n_dropped.

    A line whose key has ``min_chars`` code points or more and is found in ``min_docs`` documents (distinct ids) or
    more goes everywhere but in the largest id that holds it, where all its copies stay. Null and empty texts are one
    empty line, and their text is then empty. A row without an id counts as no document, and keeps no line that
    others repeat. Other columns pass through; an own n_lines or n_dropped is replaced. An empty table gives none.

    Of a task's texts only the hashes of long lines are held at once, to probe the index; what stays is told as a flag
    for each line, and Spark, which keeps a task's rows meanwhile, takes the lines out.
    """
    bound_batches(docs.sparkSession)
    index = LineIndex.build(docs, id_col, text_col, min_chars, min_docs)

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def stays(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        widths, named, ids, owner, number, hashed = [], [], [], [], [], []
        sizes = []
        for own, known, texts in batches:
            base, keys = sum(map(len, widths)), []
            rows, lines = [], []
            counts = np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                split = text.split("\n")
                counts[i] = len(split)
                for k, line in enumerate(split):
                    if len(line) >= min_chars and len(line.strip(SPACE)) >= min_chars:
                        rows.append(base + i)
                        lines.append(k)
                        keys.append(line_key(line))
            sizes.append(len(texts))
            widths.append(counts)
            named.append(known.to_numpy(bool))
            ids.append(own.to_numpy(np.int64))
            owner.append(np.array(rows, np.int64))
            number.append(np.array(lines, np.int32))
            hashed.append(_hashes(keys))
        if not sizes:
            return
        whole = lambda parts: np.concatenate(parts)
        owner, number, ids, named, widths = map(whole, (owner, number, ids, named, widths))
        task = TaskContext.get()
        count, keeper = index.probe(whole([a for a, _ in hashed]), whole([b for _, b in hashed]), task.partitionId() if task else 0)
        del hashed
        gone = np.flatnonzero((count >= min_docs) & ((keeper != ids[owner]) | ~named[owner]))
        owner, number = owner[gone], number[gone]
        start = 0
        for size in sizes:
            low, high = np.searchsorted(owner, (start, start + size))
            out: list = [None] * size
            for at in range(low, high):
                i = int(owner[at]) - start
                if out[i] is None:
                    out[i] = np.ones(widths[start + i], bool)
                out[i][number[at]] = False
            yield pd.Series(out, dtype=object)
            start += size
        tidy()

    own = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = fresh(docs, "_stays")
    out = docs.withColumn(name, stays(F.coalesce(own, F.lit(0)), own.isNotNull(), text))
    flags, lines = F.col(name), F.split(text, "\n")
    # joining leaves nulls out
    kept = F.array_join(F.zip_with(lines, flags, lambda line, stay: F.when(stay, line)), "\n")
    dropped = F.when(flags.isNull(), 0).otherwise(F.size(F.filter(flags, lambda stay: ~stay)))
    return out.withColumns({text_col: F.when(flags.isNull(), text).otherwise(kept), "n_lines": F.size(lines).cast("long"), "n_dropped": dropped.cast("long")}).drop(name)
