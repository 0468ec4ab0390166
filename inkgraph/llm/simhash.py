"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint has 64 bits; two link at up to three differing bits, so that of four 16-bit blocks at least one agrees.
Each distinct fingerprint enters four tries, whose keys start with another block. A pair of subtries below one root
block is walked together: every step down a bit gives up to four pairs of children, those of unlike bits add one to
the pair's error, and a pair goes as soon as its error exceeds the budget.

With a wider budget of b, one of the four blocks has at most b // 4 differing bits: the tries are then walked from their
roots, with that budget in the first block and b in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgraph.llm.components import connected_components
from inkgraph.llm.shared import bound_batches, discard, join_hot, materialize, text_key, tidy

BITS = 64
BLOCK = 16
#: Distinct fingerprints below one root block that one task joins; larger subtries are dealt out in parts by pairs.
PART = 20_000
#: Pairs of subtries with at most so many pairs of members are compared outright.
LEAF_PAIRS = 32
#: Pairs of subtries expanded at once, and rows joined at once.
FRONTIER, ROWS = 1_000_000, 250_000
#: For wider budgets: fingerprints of a part of a whole trie, parts of a smaller trie (not below 4,096 each), and pairs
#: of subtries expanded at once.
WIDE_PART, WIDE_PARTS, WIDE_FRONTIER = 1 << 17, 5, 1 << 14


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash over word shingles, repeats included; zero for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(g, 42) for g in grams), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keyed: bool = False) -> DataFrame:
    """(doc_id, fp) for every row; fp: the 64 bits as a signed long. keyed: with key, which tells texts from each other.
    Ids don't pass through Python, where nulls among them would make them floats."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64))
        tidy()

    more = [text_key(F.col(text_col)).alias("key")] if keyed else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), run(F.col(text_col)).alias("fp"), *more)


def _spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, ordinal within the owner) of ``lengths.sum()`` slots."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def trie_pairs(
    keys: np.ndarray, roots: np.ndarray, bits: int, budget: int, first: int | None = None, frontier: int = FRONTIER
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of ``keys`` within ``budget`` differing bits. first: the budget within the first block from
    the roots; pairs beyond it may be among those found.

    roots: rows (a_lo, a_hi, b_lo, b_hi) of subtries to be joined, each a range of ``keys`` sorted by its low
    ``bits`` bits, with equal bits above and no repeats; equal ranges stand for a join of a subtrie with itself.
    """
    zeros: dict[int, np.ndarray] = {}

    def middle(lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        if bit not in zeros:
            zeros[bit] = np.concatenate(([0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1) == 0)))
        return lo + zeros[bit][hi] - zeros[bit][lo]

    todo = [(bits - 1, roots.astype(np.int64), np.zeros(len(roots), np.int64))]
    while todo:
        bit, pairs, error = todo.pop()
        if len(pairs) > frontier:
            todo += [(bit, pairs[i : i + frontier], error[i : i + frontier]) for i in range(0, len(pairs), frontier)]
            continue
        n, m = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        small = (n * m <= LEAF_PAIRS) | (bit < 0)
        if small.any():
            leaf, width = pairs[small], m[small]
            owner, k = _spread(n[small] * width)
            i, j = leaf[owner, 0] + k // width[owner], leaf[owner, 2] + k % width[owner]
            near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            near &= (i < j) | (leaf[owner, 0] != leaf[owner, 2])
            if near.any():
                yield i[near], j[near]
        pairs, error = pairs[~small], error[~small]
        if not len(pairs):
            continue
        a_lo, a_hi, b_lo, b_hi = pairs.T
        a_mid, b_mid = middle(a_lo, a_hi, bit), middle(b_lo, b_hi, bit)
        alike = (a_lo == b_lo) & (a_hi == b_hi)
        children = [
            (np.stack((a_lo, a_mid, b_lo, b_mid), 1), error),
            (np.stack((a_mid, a_hi, b_mid, b_hi), 1), error),
            (np.stack((a_lo, a_mid, b_mid, b_hi), 1), error + 1),
            (np.stack((a_mid, a_hi, b_lo, b_mid), 1)[~alike], (error + 1)[~alike]),
        ]
        pairs, error = np.concatenate([c for c, _ in children]), np.concatenate([e for _, e in children])
        most = budget if first is None or bit < bits - BLOCK else first
        keep = (error <= most) & (pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])
        if keep.any():
            todo.append((bit - 1, pairs[keep], error[keep]))


def _forest(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index reachable from each of n indices."""
    label = np.arange(n)
    if not links:
        return label
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _join_groups(rows: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Star edges (a, b) that connect what the tries of whole groups link."""
    fps = rows["fp"].to_numpy(np.int64).view(np.uint64)
    distinct, member = np.unique(fps, return_inverse=True)
    links = []
    for turn in np.unique(rows["turn"]):
        part = rows[rows["turn"] == turn]
        own = part["fp"].to_numpy(np.int64).view(np.uint64)
        shift = int(turn) * BLOCK
        keys = own if not shift else (own << np.uint64(shift)) | (own >> np.uint64(BITS - shift))
        side = part["side"].to_numpy(np.int64)
        group = part.groupby(["block", "i", "j"], sort=False).ngroup().to_numpy()
        order = np.lexsort((keys, side, group))
        keys, side, group = keys[order], side[order], group[order]
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(group) != 0) | (np.diff(side) != 0))))
        ends = np.append(starts[1:], len(keys))
        first, second = side[starts] == 0, side[starts] == 1
        cross = np.zeros(len(starts), bool)
        cross[:-1] = first[:-1] & second[1:] & (group[starts][:-1] == group[starts][1:])
        split = (part["i"].to_numpy() != part["j"].to_numpy())[order][starts]
        own_roots = np.flatnonzero(first & ~split)
        cross_roots = np.flatnonzero(cross)
        roots = np.concatenate(
            (
                np.stack((starts[own_roots], ends[own_roots], starts[own_roots], ends[own_roots]), 1),
                np.stack((starts[cross_roots], ends[cross_roots], starts[cross_roots + 1], ends[cross_roots + 1]), 1),
            )
        )
        index = member[np.flatnonzero((rows["turn"] == turn).to_numpy())][order]
        links += [(index[i], index[j]) for i, j in trie_pairs(keys, roots, BITS - BLOCK, budget)]
    label = _forest(len(distinct), links)
    moved = np.flatnonzero(label != np.arange(len(distinct)))
    signed = distinct.view(np.int64)
    return pd.DataFrame({"a": signed[moved], "b": signed[label[moved]]})


def trie_links(reps: DataFrame, budget: int = 3, part: int = PART) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all those within ``budget`` (3 or less)
    differing bits, directly or by others. A subtrie of more than ``part`` members is dealt into parts by hash, and
    every two parts meet in a task of their own, so none takes the whole of it."""
    turns = F.explode(F.sequence(F.lit(0), F.lit(BITS // BLOCK - 1))).alias("turn")
    keyed = reps.select("fp", turns).withColumn("block", F.expr(f"shiftrightunsigned(fp, {BITS - BLOCK} - {BLOCK} * turn) & {(1 << BLOCK) - 1}"))
    sizes = keyed.groupBy("turn", "block").agg(F.ceil(F.count("*") / part).alias("parts")).where("parts > 1")
    keyed = keyed.join(sizes, ["turn", "block"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    keyed = keyed.withColumn("own", F.pmod(F.xxhash64("fp"), "parts"))
    tasks = F.expr("transform(sequence(0L, parts - 1), x -> struct(least(x, own) AS i, greatest(x, own) AS j, int(x < own) AS side))")
    dealt = keyed.select("fp", "turn", "block", F.explode(tasks).alias("t")).select("fp", "turn", "block", "t.i", "t.j", "t.side")
    key = ["turn", "block", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count < ROWS:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = (rows[key] == rows[key].iloc[-1]).all(axis=1).to_numpy()
            cut = int(np.argmax(last))
            if cut:
                yield _join_groups(rows[:cut], budget)
            held, count = [rows[cut:]], len(rows) - cut
        if count:
            yield _join_groups(pd.concat(held, ignore_index=True), budget)

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, "a long, b long")


def _turned(keys: np.ndarray, turn: int) -> np.ndarray:
    """``keys`` with block ``turn`` in front."""
    shift = turn * BLOCK
    return keys if not shift else (keys << np.uint64(shift)) | (keys >> np.uint64(BITS - shift))


def _ranks(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(values, kind="stable")
    own = values[order]
    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    return out


def wide_pairs(left: np.ndarray, right: np.ndarray | None, budget: int, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within ``budget`` differing bits of two tables of distinct fingerprints, or of one (``right`` None), each
    once. most: of a fingerprint in more pairs at least so many are given, and the others where their other end is
    in fewer."""
    fps = left if right is None else np.concatenate((left, right))
    seen = np.zeros(len(fps), np.int64)
    first = np.uint64(budget // (BITS // BLOCK))
    for turn in range(BITS // BLOCK):
        keys = _turned(fps, turn)
        order = np.argsort(keys[: len(left)])
        if right is not None:
            order = np.concatenate((order, len(left) + np.argsort(keys[len(left) :])))
        roots = [[0, len(left), 0, len(left)]] if right is None else [[0, len(left), len(left), len(fps)]]
        for i, j in trie_pairs(keys[order], np.array(roots), BITS, budget, int(first), WIDE_FRONTIER):
            i, j = order[i], order[j]
            unlike = fps[i] ^ fps[j]
            # the first block within its budget is the turn of the pair
            near = [np.bitwise_count(_turned(unlike, t) >> np.uint64(BITS - BLOCK)) <= first for t in range(turn + 1)]
            own = near[turn] & ~np.any(near[:turn], axis=0) if turn else near[0]
            own = np.flatnonzero(own)
            own = own[np.argsort(np.bitwise_count(unlike[own]), kind="stable")]
            i, j = i[own], j[own]
            if most is not None and len(i):
                few = (seen[i] + _ranks(i) < most) | (seen[j] + _ranks(j) < most)
                i, j = i[few], j[few]
                np.add.at(seen, i, 1)
                np.add.at(seen, j, 1)
            if len(i):
                yield fps[i], fps[j]


def near_pairs(reps: DataFrame, budget: int, most: int | None = None, part: int = WIDE_PART) -> DataFrame:
    """Pairs (a, b) within ``budget`` differing bits of distinct fingerprints (column fp), of any budget, each once.
    The fingerprints are dealt into parts by hash, every two of which meet in a task, so the work grows with the square
    of their number. most: as :func:`wide_pairs`, in each task."""
    count = reps.count()
    parts = max(-(-count // part), min(WIDE_PARTS, -(-count // 4096)), 1)
    own = F.pmod(F.xxhash64("fp"), F.lit(parts)).cast("long").alias("own")
    tasks = F.expr(f"transform(sequence(0L, {parts - 1}L), x -> struct(least(x, own) AS i, greatest(x, own) AS j, int(x < own) AS side))")
    dealt = reps.select("fp", own).select("fp", F.explode(tasks).alias("t")).select("fp", "t.i", "t.j", "t.side")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        fps, side = group["fp"].to_numpy(np.int64).view(np.uint64), group["side"].to_numpy() == 1
        within = group["i"].iloc[0] == group["j"].iloc[0]
        found = list(wide_pairs(fps, None, budget, most) if within else wide_pairs(fps[~side], fps[side], budget, most))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pd.DataFrame({"a": a, "b": b})

    keyed = dealt.repartition(parts * (parts + 1) // 2, "i", "j")
    return keyed.groupBy("i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3, keyed: bool = False
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``: its SimHash and the smallest doc_id reachable by links.
    keyed: with key, as :func:`fingerprints`.

    Null and wordless texts have fingerprint zero and link like any other. Repeated rows and ids keep a row each. A
    null doc_id is never a component's name while another member has an id. No rows give no rows; other columns,
    whatever their names, are not looked at.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle, keyed), "simhash")
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    parts = connected_components(trie_links(reps, budget))
    named = reps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = materialize(named.join(names, "component").select("fp", "component_id", "n"), "simhash-components")
    discard(reps)
    return join_hot(fps, names, "fp").select("doc_id", "fp", "component_id", *["key"] * keyed)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3) -> DataFrame:
    """The rows of ``docs`` without all but the smallest id of each near-duplicate group; rows that repeat that id in
    that group all stay, being one document, as do rows without an id, which no name tells from each other. An id with
    texts in several groups is decided in each."""
    found = near_duplicates(docs, id_col, text_col, shingle, budget, keyed=True).where("doc_id <> component_id")
    gone = materialize(found.select(F.col("doc_id").alias("_gone"), F.col("key").alias("_key")).distinct(), "simhash-gone")
    return docs.join(gone, (docs[id_col].cast("long") == gone["_gone"]) & (text_key(docs[text_col]) == gone["_key"]), "left_anti")
