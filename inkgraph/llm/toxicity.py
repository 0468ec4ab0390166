"""Toxicity by compression distance.

Two zstandard dictionaries are trained, each of two parts. The larger part is the same in both: ordinary text, chosen
by the library's own trainer. Before it stand windows of toxic rows, which the ordinary dictionary has without the
words that ordinary rows lack. Windows of a text, some words in a row, are compressed under both; what the toxic
dictionary saves on one tells how much of it toxic rows have that ordinary ones have not. Long windows, which cover the
whole text, come first, and short ones within those that save. A text's score comes from the savings of all its windows,
by a logistic curve that is fitted on labelled rows that no dictionary has.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgraph.llm.shared import bound_batches, discard, hashed_sample, materialize, tidy, with_struct
from inkgraph.llm.words import letters
from inkgraph.llm.zstd import compressor

THRESHOLD = 0.3
#: Labelled rows of each class that are learned from, the whole text of each, and parts of which each is measured with
#: a dictionary from the others.
ROWS_PER_CLASS, FOLDS = 3000, 3
#: Words of long and of short windows, each of which starts with the last word of the one before.
LONG, SHORT = 24, 4
#: Bytes of the common part, pieces of ordinary rows that it is trained on, and words of such a piece.
ORDINARY_BYTES, PIECES, PIECE_WORDS = 64 << 10, 16_384, 64
#: Settings of the library's trainer.
SEGMENT, OVERLAP = 32, 6
#: Bytes of toxic windows.
TOXIC_BYTES = 16 << 10
#: A fragment is a whole word or a word's beginning of so many letters.
STEMS = range(4, 9)
#: Least toxic rows with a fragment, and its least log odds ratio at the cautious end, that make windows with it toxic.
MIN_ROWS, MIN_LOG_ODDS = 3, 2.7
#: Lazy parsing over binary trees, which find what is far: the optimal parser weighs costs that differ between
#: dictionaries also where neither has a match.
LEVEL = 12
SETTINGS = {"strategy": 6, "window_log": 18, "chain_log": 18, "hash_log": 16, "search_log": 9, "min_match": 4, "target_length": 64}
#: Stands around each window and at the end of both dictionaries, in bytes that no word has, so that every frame compresses.
FRAME = b"\x01\x02\x03\x04\x05\x06\x07\x08"
#: Windows that save fewer bytes, and as many bytes, as clear ones do.
SOME, CLEAR = 2, 6
#: Windows added to a text's own where savings are shared out over them.
MORE = 20

RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("saved", T.IntegerType())])


def windows(words: list[bytes], width: int) -> list[list[bytes]]:
    """Windows of ``width`` of the words, all of which are in one; the last may be shorter."""
    return [words[i : i + width] for i in range(0, max(1, len(words) - 1), width - 1)] if words else []


def encoded(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def fragments(words: Iterable[str]) -> set[str]:
    """The words with a space around and their beginnings with a space before."""
    out = set()
    for w in words:
        if len(w) > 2:
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in STEMS if n <= len(w))
    return out


class Distance:
    """What the toxic dictionary saves on windows."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = compressor(toxic, LEVEL, **SETTINGS), compressor(ordinary, LEVEL, **SETTINGS)

    def saved(self, words: list[bytes]) -> list[int]:
        """Bytes saved on each short window within the long ones that save."""
        toxic, ordinary = self.toxic.compress, self.ordinary.compress
        out = []
        for long in windows(words, LONG):
            if len(ordinary(framed := FRAME + encoded(long) + FRAME)) > len(toxic(framed)):
                out += [len(ordinary(framed := FRAME + encoded(w) + FRAME)) - len(toxic(framed)) for w in windows(long, SHORT)]
        return out

    def features(self, text: str | None) -> list[float]:
        """What the score is made of: the best three windows, the number of windows that save, and all savings, the
        latter by the length of the text."""
        words = letters(text).encode("utf-8", "surrogatepass").split()
        n = len(words) / (SHORT - 1) + MORE
        best = [*sorted((s for s in self.saved(words) if s > 0), reverse=True), 0, 0, 0]
        some, clear, total = sum(s >= SOME for s in best), sum(s >= CLEAR for s in best), sum(best)
        return [float(best[0]), float(best[1]), float(best[2]), some / n, some / n**0.5, clear / n**0.5, total / n, total / n**0.5]


FEATURES = 8


class Model:
    """Both dictionaries' contents and the coefficients of the curve, the constant first."""

    def __init__(self, toxic: bytes, ordinary: bytes, coefficients: np.ndarray):
        self.toxic, self.ordinary, self.coefficients = toxic, ordinary, np.asarray(coefficients, float)

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        rows = np.asarray(rows, float).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + rows @ self.coefficients[1:], -700, 700)))


def curve(rows: np.ndarray, toxic: np.ndarray, rate: float) -> np.ndarray:
    """Coefficients of the logistic curve, the classes weighed to a share ``rate`` of toxic rows, by
    Newton's method with a ridge on scaled features; without rows of both classes ``rate`` for all."""
    out = np.zeros(FEATURES + 1)
    out[0] = math.log(rate / (1 - rate))
    if not (toxic.any() and (~toxic).any()):
        return out
    middle, spread = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    x = np.column_stack((np.ones(len(rows)), (rows - middle) / spread))
    weight = np.where(toxic, rate / toxic.sum(), (1 - rate) / (~toxic).sum()) * len(rows)
    ridge, w = np.diag([1e-6] + [1.0] * FEATURES), out.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - toxic)) + ridge @ w)
        w -= step / max(1.0, float(np.abs(step).max()))
    out[1:] = w[1:] / spread
    out[0] = w[0] - float((out[1:] * middle).sum())
    return out


def log_odds(toxic: Column | float, ordinary: Column | float, toxic_rows: int, ordinary_rows: int) -> Column:
    """Log odds ratio of a fragment's rows, two standard deviations below what was counted."""
    cautious = F.greatest(toxic - 2 * F.sqrt(toxic), F.lit(0.0)) + 0.5
    return F.log(cautious / (toxic_rows + 1)) - F.log((ordinary + F.sqrt(ordinary) + 0.5) / (ordinary_rows + 1))


def cover(found: Iterable[bytes], weights: dict[str, float], size: int) -> list[bytes]:
    """Windows, best first, of ``size`` bytes in all: each time that whose fragments, without those that chosen ones
    have already, weigh most a byte."""
    left = dict(weights)

    def value(window: bytes) -> tuple[float, set[str]]:
        own = {f for f in fragments(window.decode("utf-8", "surrogatepass").split()) if f in left}
        return sum(left[f] for f in sorted(own)) / len(window), own

    queue = [(-value(w)[0], w) for w in set(found)]
    heapq.heapify(queue)
    out, total = [], 0
    while queue and total < size:
        was, window = heapq.heappop(queue)
        now, own = value(window)
        if not now:
            continue
        if now < -was - 1e-12:
            heapq.heappush(queue, (-now, window))
            continue
        out.append(window)
        total += len(window)
        for f in own:
            del left[f]
    return out


def _pieces(rows: DataFrame) -> list[bytes]:
    """About PIECES pieces of ordinary rows, those of the smallest hash."""

    def cut(text: str) -> Iterator[bytes]:
        own = letters(text).split()
        for i in range(0, len(own), PIECE_WORDS):
            yield f" {' '.join(own[i : i + PIECE_WORDS])} ".encode("utf-8", "surrogatepass")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"n": [sum(sum(1 for _ in cut(t)) for t in batch["_t"]) for batch in batches]}, dtype="int64")

    texts = rows.where("_y = 0").select("_t")
    n = texts.mapInPandas(measure, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = int(2**64 * min(1.0, PIECES / max(1, n)))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"piece": [p for t in batch["_t"] for p in cut(t) if xxhash.xxh64_intdigest(p, 5) < limit]}, dtype=object)

    return sorted(bytes(r[0]) for r in texts.mapInPandas(take, "piece binary").collect())


def ordinary_part(pieces: list[bytes]) -> bytes:
    """Trained on the pieces; the pieces themselves, as far as they go, where they are too few to train on."""
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, pieces, k=SEGMENT, d=OVERLAP).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-ORDINARY_BYTES:]


def dictionaries(chosen: list[bytes], weights: dict[str, float], common: bytes) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary: the chosen windows, in the latter with the words blank for which they
    were chosen, then the common part. What isn't chosen is so at the same distance in both, and is encoded alike."""

    def ordinary(window: bytes) -> bytes:
        words = window.decode("utf-8", "surrogatepass").split()
        toxic = [not weights.keys().isdisjoint(fragments([w])) for w in words]
        parts = [w.encode("utf-8", "surrogatepass") for w in words]
        return b" " + b" ".join(b"\0" * len(p) if t else p for p, t in zip(parts, toxic, strict=True)) + b" "

    end = b" " + common + FRAME
    return b"".join(reversed(chosen)) + end, b"".join(map(ordinary, reversed(chosen))) + end


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the rows of ``docs`` that ``labels`` marks 0 or 1: ROWS_PER_CLASS of each class, by smallest id hash.

    Fragments of words are counted by row and class, near copies as one row. Windows of toxic rows are chosen by the
    fragments that toxic rows have oftener. The curve is fitted on what each of FOLDS parts of the rows saves under a
    dictionary with windows of the others; the model's has those of all. Null texts and null labels are left out; an
    id labelled both ways counts as toxic, and of rows that repeat an id one is read."""
    bound_batches(docs.sparkSession)
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_i")).agg(F.max(label_col).alias("_y"))
    sizes = {r["_y"]: r["count"] for r in marked.groupBy("_y").count().collect()}
    rate = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 5)
    ids = F.broadcast(hashed_sample(marked, "_y", "_i", ROWS_PER_CLASS))
    texts = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).where(F.col("_t").isNotNull())
    chosen = texts.join(ids, "_i").groupBy("_i", "_y").agg(F.min_by("_t", F.struct(F.xxhash64("_t"), "_t")).alias("_t"))
    fold = F.pmod(F.xxhash64("_i", F.lit(7)), F.lit(FOLDS)).cast("int").alias("_fold")
    # written, as all that follows reads the sample again and shouldn't read the table
    sample = materialize(chosen.select(F.xxhash64("_i").alias("_i"), "_y", "_t", fold), "toxic-sample")
    rows = materialize(sample.join(F.broadcast(_without_copies(sample.select("_i", "_t"))), "_i", "left_semi").drop("_i"), "toxic-rows")
    parts = [(y, k, f"n{y}_{k}") for y in (0, 1) for k in range(FOLDS)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {name: Counter() for _, _, name in parts}
        for batch in batches:
            for y, text, k in zip(batch["_y"], batch["_t"], batch["_fold"], strict=True):
                own = seen[f"n{int(y)}_{int(k)}"]
                own.update(fragments(set(letters(text).split())))
                own[""] += 1
        # Arrow makes no plain array of an empty column of strings
        if names := list(set().union(*seen.values())):
            yield pd.DataFrame({"fragment": names} | {name: [c[x] for x in names] for name, c in seen.items()})

    columns = [name for _, _, name in parts]
    counted = rows.mapInPandas(count, "fragment string, " + ", ".join(f"{c} long" for c in columns)).groupBy("fragment").agg(*[F.sum(c).alias(c) for c in columns])
    # a bounded sample's words, whatever the table's size: few tasks
    counted = materialize(counted.coalesce(8), "toxic-counts")
    totals = counted.where("fragment = ''").first() or dict.fromkeys(columns, 0)

    def weighty(without: int | None) -> dict[str, float]:
        """Weights of fragments by the rows of all parts but one."""
        used = {y: [name for c, k, name in parts if c == y and k != without] for y in (0, 1)}
        n = {y: sum((F.col(c) for c in own), F.lit(0)) for y, own in used.items()}
        odds = log_odds(n[1], n[0], *(sum(totals[c] for c in used[y]) for y in (1, 0)))
        known = counted.where((F.col("fragment") != "") & (n[1] >= MIN_ROWS)).select("fragment", odds.alias("odds"), n[1].alias("n"))
        # a dictionary has no room for windows of more
        known = known.where(F.col("odds") >= MIN_LOG_ODDS).orderBy(F.desc(F.col("odds") * F.col("n")), "fragment").limit(TOXIC_BYTES)
        return {r["fragment"]: r["odds"] * r["n"] for r in known.collect()}

    def trained(without: int | None) -> tuple[bytes, bytes]:
        """Both dictionaries from the toxic rows of all parts but one."""
        weights = weighty(without)

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = set()
            for batch in batches:
                for text in batch["_t"]:
                    own = letters(text).split()
                    weighty = {w for w in set(own) if not weights.keys().isdisjoint(fragments([w]))}
                    if weighty:
                        split = windows([w.encode("utf-8", "surrogatepass") for w in own], SHORT)
                        found.update(encoded(w) for k, w in enumerate(split) if not weighty.isdisjoint(own[k * (SHORT - 1) : k * (SHORT - 1) + SHORT]))
            yield pd.DataFrame({"window": cover(found, weights, TOXIC_BYTES)}, dtype=object)

        own = rows.where("_y = 1" if without is None else f"_y = 1 AND _fold <> {without}").select("_t")
        found = [bytes(r[0]) for r in own.mapInPandas(find, "window binary").collect()]
        return dictionaries(cover(found, weights, TOXIC_BYTES), weights, common)

    def measured(part: int) -> list[tuple[int, list[float]]]:
        """(class, features) of a part's rows."""
        toxic, ordinary = trained(part)

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            distance = Distance(toxic, ordinary)
            for batch in batches:
                yield pd.DataFrame({"y": batch["_y"].astype(int), "f": [distance.features(t) for t in batch["_t"]]})

        return [(r["y"], list(r["f"])) for r in rows.where(f"_fold = {part}").mapInPandas(measure, "y int, f array<double>").collect()]

    common = ordinary_part(_pieces(rows))
    known = sorted(x for k in range(FOLDS) for x in measured(k))
    coefficients = curve(np.array([f for _, f in known], float).reshape(-1, FEATURES), np.array([y for y, _ in known], int) == 1, rate)
    model = Model(*trained(None), coefficients)
    for done in (sample, rows, counted):
        discard(done)
    return model


def _without_copies(sample: DataFrame) -> DataFrame:
    """The ids (_i) of the bounded sample (_i, _t) that are the least of every group that shares one of four MinHash
    values over word shingles; near copies, which would lend rare words the weight of many documents, rarely share
    none."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sign(texts: pd.Series) -> pd.Series:
        return pd.Series([signature(t) for t in texts], dtype=object)

    # else the filter that Spark infers from the explode would sign every text a second time
    each = sample.select("_i", sign.asNondeterministic()("_t").alias("s")).select("_i", F.posexplode("s").alias("k", "s"))
    least = each.groupBy("k", "s").agg(F.min("_i").alias("_i"))
    return least.groupBy("_i").agg(F.countDistinct("k").alias("n")).where("n = 4").select("_i")


def signature(text: str, size: int = 5) -> list[int]:
    """Four MinHash values of the text's word shingles."""
    own = letters(text).split()
    grams = {" ".join(own[i : i + size]) for i in range(max(1, len(own) - size + 1))}
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(g.encode("utf-8", "surrogatepass")) for g in grams), np.uint64, len(grams))
    turns = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
    return [int(((hashes ^ np.uint64(t)) * np.uint64(t)).min().view(np.int64)) for t in turns]


def predict(model: Model, text: Column, threshold: float = THRESHOLD) -> Column:
    """Struct of score (0 to 1), predicted (1 if the score reaches ``threshold``) and the bytes saved on the best
    window, for each whole text. Null, empty and wordless texts have no window and get the score of no savings."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        distance = Distance(model.toxic, model.ordinary)
        for texts in batches:
            rows = [distance.features(t) for t in texts]
            score = model.scores(rows)
            yield pd.DataFrame({"score": score, "predicted": (score >= threshold).astype(np.int32), "saved": np.array([r[0] for r in rows], np.int32)})
        del distance
        tidy()

    return run(text)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the columns of :func:`predict`; own columns of these names are replaced, all others pass
    through. Repeated rows stay, and an empty table gives none."""
    bound_batches(docs.sparkSession)
    return with_struct(docs, predict(model, F.col(text_col), threshold), RESULT.names)
