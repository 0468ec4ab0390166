"""Best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.shared import materialize

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its length, in tokens.
OVERHEAD = 32
#: Pieces packed together by one task.
SHARD = 50_000


class _Remaining:
    """The lengths that are still to come. ``mask`` has a bit for each, so the greatest that fits is its highest bit up
    to there."""

    def __init__(self, lengths: Sequence[int]):
        self.counts = Counter(lengths)
        self.mask = sum(1 << n for n in self.counts)

    def take(self, length: int) -> None:
        self.counts[length] -= 1
        if not self.counts[length]:
            self.mask ^= 1 << length

    def fill(self, room: int) -> int:
        """What is filled of ``room`` if each time the greatest length that fits is added."""
        left, mask = room, self.mask
        while n := (mask & ((2 << left) - 1)).bit_length() - 1:
            if n < 0:
                break
            left -= n * min(left // n, self.counts[n])
            mask &= (1 << n) - 1
        return room - left


def cheapest(length: int, remaining: _Remaining, capacities: Sequence[int], overhead: int) -> int:
    """The capacity for a bin that is opened for ``length``: that of the least cost a token, if the bin is filled from
    what remains and then shrinks to its contents; the least at ties."""
    best, chosen = None, None
    for capacity in capacities:
        if capacity < length:
            continue
        filled = length + remaining.fill(capacity - length)
        cost = next(c for c in capacities if c >= filled) + overhead
        # cost / filled < best cost / best filled, in whole numbers
        if best is None or cost * best[1] < best[0] * filled:
            best, chosen = (cost, filled), capacity
    return chosen


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each length (falling, each at most the largest capacity), capacity of each bin.

    A piece goes to the open bin with the least room that holds it, the latest of equal ones; where none does, a bin is
    opened at the capacity that :func:`cheapest` tells, whatever those before had. In the end every bin shrinks to the
    least capacity that holds its contents. Bins of each room wait in a stack; ``open_`` has a bit for each room that
    some bin has."""
    remaining, stacks = _Remaining(lengths), {}
    open_, room, bins, offsets, sizes = 0, [], [], [], []
    for length in lengths:
        remaining.take(length)
        fits = open_ >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            stack = stacks[left]
            chosen = stack.pop()
            if not stack:
                open_ ^= 1 << left
        else:
            left = cheapest(length, remaining, capacities, overhead)
            chosen = len(room)
            room.append(left)
            sizes.append(left)
        bins.append(chosen)
        offsets.append(sizes[chosen] - left)
        left -= length
        room[chosen] = left
        if left:
            stacks.setdefault(left, []).append(chosen)
            open_ |= 1 << left
    return bins, offsets, [next(c for c in capacities if c >= s - r) for s, r in zip(sizes, room, strict=True)]


def pack(
    docs: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", capacities: Sequence[int] = CAPACITIES,
    overhead: int = OVERHEAD, shard: int = SHARD,
) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id, bin_offset, capacity): every row's tokens, each once, in bins.

    A row longer than the largest capacity is cut into pieces of that length and a rest. Pieces are dealt by hash of
    id, piece and place, so that repeated rows spread too, into shards of about ``shard`` and packed there, largest first, so a task's memory doesn't grow with the input,
    and at most a few bins a shard are left unfull. Rows of null or no length have one piece of length 0, in no bin
    (null bin_id). Repeated rows are packed each; ties go by id. No rows give none.
    """
    sizes = sorted(set(capacities))
    most = sizes[-1]
    length = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), length.alias("length"))
    last = F.greatest(F.ceil(F.col("length") / most) - 1, F.lit(0)).cast("int")
    pieces = rows.select("doc_id", "length", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * most
    pieces = pieces.select("doc_id", "piece", start.alias("start"), F.least(F.col("length") - start, F.lit(most)).cast("int").alias("n_tokens"))
    pieces = materialize(pieces, "pieces")
    shards = max(1, -(-pieces.count() // shard))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        lengths = [n for n in group["n_tokens"].tolist() if n]
        bins, offsets, final = best_fit(lengths, sizes, overhead)
        none = len(group) - len(lengths)
        base = int(key[0]) << 32
        group["bin_id"] = pd.array([base + b for b in bins] + [None] * none, dtype="Int64")
        group["bin_offset"] = pd.array(offsets + [None] * none, dtype="Int32")
        group["capacity"] = pd.array([final[b] for b in bins] + [None] * none, dtype="Int32")
        return group.drop(columns="shard")

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)))
    schema = "doc_id long, piece int, start long, n_tokens int, bin_id long, bin_offset int, capacity int"
    return dealt.groupBy("shard").applyInPandas(run, schema)
