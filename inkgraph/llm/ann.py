"""Approximate nearest neighbours by inner product, with a permutation index.

Each vector is represented by its nearest pivots, in order, and posted with its position in each of these pivots'
inverted lists. A query gathers the lists of its own pivots; the footrule distance of two orders, a missing pivot
counting as one past the end, follows from the sum over shared pivots of what their worse position leaves. The best
share by footrule is reranked by exact inner products.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.llm.shared import materialize

#: Pivots, sampled by smallest id hash, and how many of them represent a vector.
PIVOTS, NEAREST = 256, 40
#: Share of each segment that is reranked, and vectors of a segment at least reranked.
RERANK, RERANK_LEAST = 0.3, 200
#: Vectors of a segment, and queries of a block; a task meets one segment with one block.
SEGMENT, BLOCK = 8192, 16384


def sound(vector: Column) -> Column:
    """True for vectors that have components, all finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


class Index:
    """Inverted lists of one segment."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, longest: float, nearest: int = NEAREST):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.pivots = ids[order], vectors[order], pivots
        self.nearest = min(nearest, len(pivots))
        ranks = self.permutations(self.vectors, longest)
        flat = ranks.ravel()
        by = np.argsort(flat, kind="stable")
        self.row = (by // self.nearest).astype(np.int32)
        self.position = (by % self.nearest).astype(np.int16)
        self.start = np.searchsorted(flat[by], np.arange(len(pivots) + 1))

    def permutations(self, vectors: np.ndarray, longest: float) -> np.ndarray:
        """Nearest pivots of each vector, in order. A further component lends all stored vectors the same length, so
        that near means a large inner product."""
        rest = np.sqrt(np.maximum(0, longest - (vectors**2).sum(axis=1)))
        wide = np.column_stack((vectors, rest))
        return np.argsort(-(wide @ self.pivots.T), axis=1, kind="stable")[:, : self.nearest]

    def search(self, query: np.ndarray, own: int, top: int, share: float) -> list[tuple[int, float]]:
        """Ids and inner products of the ``top`` best rows but ``own``."""
        gain = np.zeros(len(self.ids), np.int32)
        wide = np.append(query, 0.0)
        for at, pivot in enumerate(np.argsort(-(self.pivots @ wide), kind="stable")[: self.nearest]):
            part = slice(self.start[pivot], self.start[pivot + 1])
            gain[self.row[part]] += self.nearest - np.maximum(self.position[part], at)
        wanted = max(RERANK_LEAST, top + 1, int(np.ceil(share * len(gain))))
        if wanted < len(gain):
            # rows of equal footrule at the cut all stay
            chosen = np.flatnonzero(gain >= np.partition(gain, len(gain) - wanted)[len(gain) - wanted])
        else:
            chosen = np.arange(len(gain))
        chosen = chosen[self.ids[chosen] != own]
        scores = (self.vectors[chosen] * query).sum(axis=1)
        if len(scores) > top:
            best = scores >= np.partition(scores, len(scores) - top)[len(scores) - top]
            chosen, scores = chosen[best], scores[best]
        order = np.lexsort((self.ids[chosen], -scores))[:top]
        return [(int(self.ids[chosen[i]]), float(scores[i])) for i in order]


def search(
    vectors: DataFrame, queries: Column, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    share: float = RERANK, segment: int = SEGMENT, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``vectors`` that ``queries`` holds for, the ``top`` rows of
    the largest inner product found among all others; all others, if fewer. Ties go to the smaller id.

    Vectors that are null, empty, zero or not finite, and rows without an id, take no part; of several lengths of
    vectors the commonest does (the longest at ties). Rows that repeat an id are one: that of the least vector.
    Rows are dealt into segments and queries into blocks by hash of the id, so copies of one vector spread evenly.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & sound(F.col("v")))
    about = rows.groupBy(F.size("v").alias("width")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("asking"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("longest")
    )
    about = about.orderBy(F.desc("n"), F.desc("width")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if about is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width, longest = about["width"], about["longest"]
    rows = rows.where(F.size("v") == width)
    sample = rows.select("id", "v").orderBy(F.xxhash64("id", F.lit(4)), "id", "v").limit(PIVOTS).collect()
    pivots = np.array([r["v"] for r in sample])
    pivots = np.column_stack((pivots, np.sqrt(np.maximum(0, longest - (pivots**2).sum(axis=1)))))
    segments, blocks = max(1, -(-about["n"] // segment)), max(1, -(-about["asking"] // block))
    dealt = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = rows.select("id", "v", dealt(1, segments).alias("segment"), each(blocks).alias("block"), F.lit(False).alias("asks"))
    asked = rows.where("asks").select("id", "v", each(segments).alias("segment"), dealt(2, blocks).alias("block"), F.lit(True).alias("asks"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        def distinct(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            ids = part["id"].to_numpy(np.int64)
            if not len(ids):
                return ids, np.zeros((0, width))
            data = np.stack(part["v"].to_numpy()).astype(np.float64)
            order = np.lexsort((*data.T[::-1], ids))
            order = order[np.concatenate(([True], np.diff(ids[order]) != 0))]
            return ids[order], data[order]

        ids, data = distinct(group[~group["asks"]])
        asking, wanted = distinct(group[group["asks"]])
        out = []
        if len(ids) and len(asking):
            index = Index(ids, data, pivots, longest)
            for own, query in zip(asking.tolist(), wanted, strict=True):
                out += [(own, other, s) for other, s in index.search(query, own, top, share)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = stored.unionByName(asked).groupBy("segment", "block").applyInPandas(run, "query_id long, vec_id long, score double")
    found = materialize(found, "neighbours")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
