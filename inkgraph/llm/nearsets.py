"""Near-duplicates by SimHash tries and exact Jaccard likeness of word shingle sets.

Candidates are the pairs within BUDGET bits that a self-join of binary tries over the sets' SimHashes gives; what links
is decided on the whole sets. 64 bits don't bring all alike sets within any budget that tells them from others: what
the tries leave apart is settled by MinHash buckets, whose members of different groups are compared. Counts of a
set's hashes by ranges bound what two sets share from above, so that only sets that the counts don't tell apart are
sent to tasks whole. At the least likeness that links, a pair shares none of its BANDS buckets with a chance of (1 - 0.8 ** ROWS) ** BANDS, five in a
hundred million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.components import connected_components
from inkgraph.llm.shared import bound_batches, discard, materialize, maybe_among, only, tidy
from inkgraph.llm.simhash import majority, near_pairs

SHINGLE = 5
#: Differing SimHash bits of a candidate pair.
BUDGET = 11
#: Pairs that a task of the tries gives for a fingerprint at least, if it has them; the buckets settle the others.
NEAREST = 4
#: Least Jaccard likeness of a link, as a fraction.
LEAST = (4, 5)
#: Buckets of a set, and MinHash values that name each.
BANDS, ROWS = 32, 4
#: Pairs of one set that are verified together; sets in more pairs are copied to several tasks.
HUB = 256
#: Sets that a task returns at once.
PIECE = 500
#: Shingles of a bucket's sets, in all, that one task compares; of larger buckets every two parts meet in a task.
PART = 1_000_000
_rng = np.random.default_rng(42)
_MASKS, _FACTORS = (_rng.integers(0, 2**64, BANDS * ROWS, np.uint64) for _ in range(2))
_FACTORS |= np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of all the words, where they are fewer; none for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(words[i:] for i in range(min(size, len(words)))), strict=False))
    return np.unique(np.fromiter((digest(g, 42) for g in grams), np.uint64))


def node(hashes: np.ndarray) -> int:
    """Name of the set, a signed long; zero for the empty one."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64)) if len(hashes) else 0


def simhash(hashes: np.ndarray) -> int:
    """SimHash of the set, a signed long; zero for the empty one."""
    return int(np.uint64(majority(hashes)).view(np.int64)) if len(hashes) else 0


def buckets(hashes: np.ndarray) -> np.ndarray:
    """A signed long for each band; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for start in range(0, len(hashes), 1 << 11):
        part = hashes[start : start + (1 << 11), None]
        least = np.minimum(least, ((part ^ _MASKS) * _FACTORS).min(axis=0))
    bands = least.reshape(BANDS, ROWS)
    return np.fromiter((xxhash.xxh3_64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)), np.uint64, BANDS).view(np.int64)


def row_key(ids: Column, text: Column) -> Column:
    """Hash that tells rows of another id or text from each other; a null text has that of an empty one."""
    return F.xxhash64(ids.cast("long"), F.coalesce(text, F.lit("")))


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc_id, key, node, fp, buckets) for every row of ``docs``; key: its :func:`row_key`, fp: its :func:`simhash`. Ids
    don't pass through Python."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("node long, fp long, buckets array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            # a batch's sets would take as much memory as its texts
            own = [(node(s), simhash(s), buckets(s)) for s in (shingles(t, size) for t in texts)]
            nodes, fps, named = zip(*own, strict=True) if own else ((), (), ())
            yield pd.DataFrame({"node": np.array(nodes, np.int64), "fp": np.array(fps, np.int64), "buckets": pd.Series(named, dtype=object)})
        tidy()

    keyed = row_key(F.col(id_col), F.col(text_col)).alias("key")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), keyed, run(F.col(text_col)).alias("_s"))
    return rows.select("doc_id", "key", "_s.node", "_s.fp", "_s.buckets")


def cells(hashes: np.ndarray) -> bytes:
    """How many of the hashes are in each of a power of two of equal ranges, one to two a range in the mean, a byte
    each; empty where one has over 255."""
    bits = max(len(hashes).bit_length() - 1, 0)
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    counts = np.bincount(at, minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() <= 255 else b""


def _folded(held: bytes, size: int) -> np.ndarray:
    """Counts of ``held`` over ``size`` ranges, as many as it has or fewer."""
    return np.frombuffer(held, np.uint8).reshape(size, -1).sum(axis=1, dtype=np.uint16)


def most_common(a: bytes, b: bytes, m: int, n: int) -> int:
    """How many hashes two sets of ``m`` and ``n`` share at most, by their :func:`cells`."""
    if not a or not b:
        return min(m, n)
    size = min(len(a), len(b))
    return int(np.minimum(_folded(a, size), _folded(b, size)).sum())


def enough(common, m, n):
    """Whether sets of ``m`` and ``n`` hashes that share ``common`` are alike enough."""
    return common * LEAST[1] >= (m + n - common) * LEAST[0]


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, size, cells, grams) of the rows that ``wanted`` names by _k, each node once, and of a few others. No text
    is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["node", "size", "cells", "grams"]
        seen: set[int] = set()
        for batch in batches:
            out = []
            for text in batch["_t"]:
                hashes = shingles(text, size)
                if (name := node(hashes)) not in seen:
                    seen.add(name)
                    out.append((name, len(hashes), cells(hashes), hashes.view(np.int64)))
                if len(out) == PIECE:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns)
        tidy()

    rows = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("_k"), F.col(text_col).alias("_t"))
    rows = rows.where(maybe_among(F.col("_k"), wanted)).select("_t")
    return rows.mapInPandas(run, "node long, size long, cells binary, grams array<long>").dropDuplicates(["node"])


def _beside(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` (a, b) with ``columns`` of both their sets, named a_ and b_. A set in many pairs goes in copies to as
    many tasks."""
    ends = pairs
    for side, other in (("a", "b"), ("b", "a")):
        hubs = F.broadcast(ends.groupBy(side).agg(F.ceil(F.count("*") / HUB).alias("parts")).where("parts > 1"))
        own = sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]).join(hubs, side, "left")
        own = own.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        dealt = pairs.join(hubs, side, "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1)))).drop("parts")
        pairs = dealt.join(own, [side, "part"]).drop("part")
    return pairs


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are alike enough. Sizes and cells tell most others from these; what they
    leave is decided on the whole sets."""

    @F.pandas_udf("long")
    def most(a: pd.Series, b: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([most_common(*x) for x in zip(a, b, m, n, strict=True)], dtype=np.int64)

    near = _beside(pairs, sets, ["size"]).where(enough(F.least("a_size", "b_size"), F.col("a_size"), F.col("b_size"))).select("a", "b")
    near = _beside(materialize(near, "near-sizes"), sets, ["size", "cells"])
    common = most("a_cells", "b_cells", "a_size", "b_size")
    near = materialize(near.where(enough(common, F.col("a_size"), F.col("b_size"))).select("a", "b"), "near-possible")
    ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    near = _beside(near, sets.where(maybe_among(F.col("node"), ends)), ["size", "grams"])
    common = F.size(F.array_intersect("a_grams", "b_grams"))
    return near.where(enough(common, F.col("a_size"), F.col("b_size"))).select("a", "b")


def suspects(strays: np.ndarray, sizes: np.ndarray, held: list[bytes], labels: np.ndarray) -> np.ndarray:
    """Whether a set may, by sizes and cells (``held``), be alike enough to one of another class (``labels``), for all
    that such pairs have. Of two classes one at least has its sets among ``strays``."""
    out = np.zeros(len(sizes), bool)
    order = np.argsort(sizes, kind="stable")
    level = np.array([max(int(n).bit_length() - 1, 0) for n in sizes])
    sure = np.array([bool(h) for h in held], bool)
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def table(at: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets of ``1 << at`` ranges and of twice as many, by size, and their counts over the former."""
        if at not in tables:
            own = order[(level[order] == at) | (level[order] == at + 1)]
            rows = np.zeros((len(own), 1 << at), np.uint16)
            for k, i in enumerate(own.tolist()):
                if sure[i]:
                    rows[k] = _folded(held[i], 1 << at)
            tables[at] = own, rows
        return tables[at]

    for i in strays.tolist():
        # sizes of alike sets differ too little for more than one doubling between their ranges
        for at in {int(level[i]), max(int(level[i]) - 1, 0)}:
            own, rows = table(at)
            n = sizes[own]
            first = np.searchsorted(n * LEAST[1], sizes[i] * LEAST[0], "left")
            last = np.searchsorted(n * LEAST[0], sizes[i] * LEAST[1], "right")
            n, near = n[first:last], own[first:last]
            mine = _folded(held[i], 1 << at) if sure[i] else 0
            common = np.minimum(rows[first:last], mine).sum(axis=1, dtype=np.int64)
            common = np.where(sure[near] & sure[i], common, np.minimum(n, sizes[i]))
            near = near[enough(common, sizes[i], n) & (labels[near] != labels[i]) & (np.minimum(level[near], level[i]) == at)]
            out[near] = True
            out[i] |= len(near) > 0
    return out


def alike(strays: np.ndarray, sets: list[np.ndarray], labels: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs of ``sets`` that are alike enough and join all classes (``labels``) that such pairs join: each of
    ``strays`` is compared with all sets, by the sets that its shingles are in."""
    sizes = np.array([len(s) for s in sets], np.int64)
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], np.repeat(np.arange(len(sets)), sizes)[order]
    root = {int(x): int(x) for x in np.unique(labels)}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i in strays.tolist():
        first, last = np.searchsorted(grams, sets[i], "left"), np.searchsorted(grams, sets[i], "right")
        held = np.concatenate([owner[a:b] for a, b in zip(first, last, strict=True)]) if len(first) else np.zeros(0, np.int64)
        common = np.bincount(held, minlength=len(sets))
        for j in np.flatnonzero(enough(common, sizes[i], sizes)).tolist():
            a, b = find(int(labels[i])), find(int(labels[j]))
            if a != b:
                root[a] = b
                out.append((i, j))
    return out


def _strays(labels: np.ndarray) -> np.ndarray:
    """Indices of all but the commonest label's."""
    kinds, counts = np.unique(labels, return_counts=True)
    return np.flatnonzero(labels != kinds[np.argmax(counts)])


def compared(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of different components in one bucket of ``mixed`` (bucket, node, component), as many
    as join what the bucket's pairs join. A bucket's members are compared where they are, no pair leaves a task but a
    link, and a large bucket is dealt out in parts, every two of which meet. Members meet by their cells first; the
    whole sets go only where some pair of members may be alike."""
    sized = mixed.join(sets.select("node", "size"), "node")
    parts = sized.groupBy("bucket").agg(F.ceil(F.sum("size") / PART).alias("parts"))
    dealt = sized.join(parts, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), "parts"))
    tasks = F.expr("transform(sequence(0L, parts - 1), x -> struct(least(x, own) AS i, greatest(x, own) AS j))")
    dealt = dealt.select("bucket", "node", "component", F.explode(tasks).alias("t")).select("bucket", "node", "component", "t.i", "t.j")
    key = ["bucket", "i", "j"]

    def doubted(group: pd.DataFrame) -> pd.DataFrame:
        labels = group["component"].to_numpy(np.int64)
        own = suspects(_strays(labels), group["size"].to_numpy(np.int64), list(group["cells"]), labels)
        return group.loc[own, [*key, "node", "component"]]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ignore_index=True)
        labels = group["component"].to_numpy(np.int64)
        strays = _strays(labels)
        nodes = group["node"].to_numpy(np.int64)
        found = alike(strays, [np.asarray(g, np.int64) for g in group["grams"]], labels) if len(strays) else []
        return pd.DataFrame([(nodes[i], nodes[j]) for i, j in found], columns=["a", "b"], dtype=np.int64)

    doubts = dealt.join(sets.select("node", "size", "cells"), "node").groupBy(*key)
    doubts = materialize(doubts.applyInPandas(doubted, "bucket long, i long, j long, node long, component long"), "near-doubts")
    whole = sets.where(maybe_among(F.col("node"), doubts.select("node").distinct())).select("node", "grams")
    return doubts.join(whole, "node").groupBy(*key).applyInPandas(run, "a long, b long")


def _pairs(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def candidates(signed: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints the tries find within BUDGET bits; nodes of one fingerprint meet the
    least of them, which meets other fingerprints' for all."""
    own = signed.where(F.size("buckets") > 0).select("node", "fp").distinct()
    reps = materialize(own.groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("n")), "near-fingerprints")
    near = near_pairs(reps, BUDGET, NEAREST)
    for side in ("a", "b"):
        near = near.join(reps.select(F.col("fp").alias(side), F.col("rep").alias(f"{side}_rep")), side)
    same = own.join(reps.where("n > 1"), "fp").where("node <> rep").select(*_pairs("node", "rep"))
    return near.select(*_pairs("a_rep", "b_rep")).union(same).distinct()


def rest(members: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` (a, b) with those that join what the buckets of ``members`` (node, bucket, lo, hi) hold and ``links``
    leave apart.

    A bucket's members first meet its least and its greatest node. In buckets that then still hold several components
    all pairs of these are compared, but in tasks that give links alone, so that a large group of near copies is not
    squared into rows and no candidate is left out."""
    parts = materialize(connected_components(links), "near-components")
    stars = members.select("node", F.explode(F.array("lo", "hi")).alias("centre")).where("node <> centre")
    stars = stars.select(*_pairs("node", "centre")).distinct()
    for side in ("a", "b"):
        stars = stars.join(parts.select(F.col("node").alias(side), F.col("component").alias(f"{side}_of")), side, "left")
    apart = F.coalesce("a_of", "a") != F.coalesce("b_of", "b")
    stars = materialize(stars.where(apart).select("a", "b"), "near-stars")
    links = materialize(links.union(verified(stars, sets)), "near-links")
    discard(parts)
    parts = materialize(connected_components(links), "near-components")
    at = members.select("bucket", "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    held = at.groupBy("bucket", "component").count().groupBy("bucket").agg(F.count("*").alias("kinds"), F.sum("count").alias("n"))
    # of three members each pair has met already
    at = materialize(at.join(held.where("kinds > 1 AND n > 3").select("bucket"), "bucket"), "near-mixed")
    more = materialize(compared(at, sets), "near-more")
    for done in (stars, parts, at):
        discard(done)
    return links.union(more)


def components(docs: DataFrame, signed: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, component) of all nodes that link to another, directly or by others: by the tries first, then by what
    the buckets hold besides."""
    rows = signed.select("node", F.explode("buckets").alias("bucket"))
    ends = rows.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    ends = materialize(ends, "near-ends")
    rows = rows.where(maybe_among(F.col("bucket"), ends.select("bucket")))
    members = materialize(rows.join(ends, "bucket").distinct(), "near-members")
    pairs = materialize(candidates(signed), "near-pairs")
    nodes = members.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    first = signed.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("key").alias("_k"))
    first = materialize(first.select("_k"), "near-first")
    sets = materialize(_sets(docs, first, id_col, text_col, size), "near-sets")
    links = materialize(verified(pairs, sets), "near-tries")
    return materialize(connected_components(rest(members, sets, links)), "near-components")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without all but the smallest id of each group of texts that link, directly or by others.

    Rows that repeat a group's smallest id in that group all stay, being one document, as do rows without an id, which
    no name tells from each other. An id with texts in several groups is decided in each. Null and wordless texts are
    alike. No rows give no rows; other columns, whatever their names, are not looked at."""
    signed = materialize(sketches(docs, id_col, text_col, size), "near-sketches")
    with only(docs.sparkSession) as keep:
        parts = components(docs, signed, id_col, text_col, size)
        keep(parts)
    least = signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    named = least.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    # most nodes are a row each, which is its own group
    names = materialize(named.join(names, "component").where("most > name").select("node", "name"), "near-names")
    gone = signed.select("doc_id", "key", "node").join(names, "node").where("doc_id <> name")
    gone = materialize(gone.select(F.col("key").alias("_gone")).distinct(), "near-gone")
    discard(signed)
    # only rows that may be gone are sent to the join
    key = row_key(docs[id_col], docs[text_col])
    told = maybe_among(key, gone)
    return docs.where(~told).unionAll(docs.where(told).join(gone, key == gone["_gone"], "left_anti"))
