"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgraph.llm.shared import bound_batches, hashed_sample, tidy, with_struct
from inkgraph.llm.words import letters
from inkgraph.llm.zstd import compressor

UNKNOWN = "und"
#: Labelled rows of each language whose whole texts are its dictionary.
ROWS_PER_LANGUAGE = 96
LEVEL, CHUNK = 6, 1024
SETTINGS = {"window_log": 21, "chain_log": 17, "hash_log": 17}
#: A text is rejected if its two smallest encodings differ by less than this share.
MIN_MARGIN = 0.003
#: Bytes of difference that change the odds of two languages by a factor of e.
BYTES_PER_NAT = 4.0
#: Ends every dictionary and surrounds every chunk, so that even a word is long enough to be compressed.
FRAME = b" 0 1 2 3 4 5 6 7 "

RESULT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("margin", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)


def normalise(text: str) -> bytes:
    """Letters and their marks in lower case; everything else becomes single spaces."""
    return letters(text).encode("utf-8", "surrogatepass")


class Classifier:
    """Dictionaries by language. One is loaded at a time, for all texts of a batch, so that memory doesn't grow with the
    number of languages."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries = dictionaries
        self.languages = sorted(dictionaries)

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Bytes of each whole text (row) under each dictionary (column), chunk by chunk."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            data = normalise(text)
            cut = [FRAME + data[start : start + CHUNK] + FRAME for start in range(0, len(data), CHUNK)]
            parts += cut
            owner += [i] * len(cut)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for column, language in enumerate(self.languages):
            compress = compressor(self.dictionaries[language] + FRAME, LEVEL, **SETTINGS).compress
            np.add.at(out[:, column], owner, [len(compress(part)) for part in parts])
        return out

    def classify(self, texts: list[str | None], min_margin: float = MIN_MARGIN) -> list[tuple[str, float, float, bool]]:
        """(language, score, margin, rejected) of each text."""
        out = [(UNKNOWN, 0.0, 0.0, True)] * len(texts)
        told = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        for i, sizes in zip(told, self.lengths([texts[i] for i in told]), strict=True):
            best = int(np.argmin(sizes))
            score = float(1 / np.exp(-np.minimum((sizes - sizes[best]) / BYTES_PER_NAT, 700)).sum())
            rest = np.delete(sizes, best)
            margin = float((rest.min() - sizes[best]) / max(1, rest.min())) if len(rest) else 1.0
            out[i] = self.languages[best], score, margin, margin < min_margin
        return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary of every language from a bounded sample of ``labelled``: the whole texts of ROWS_PER_LANGUAGE rows, those
    of the smallest id hash; null texts have none, and of rows that repeat an id one is read. Null labels are left out.
    Rows are chosen without their texts, so that the column is read once."""
    bound_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull())
    ids = hashed_sample(rows, lang_col, id_col, ROWS_PER_LANGUAGE)
    chosen = rows.join(F.broadcast(ids.select(F.col(id_col), F.col(lang_col))), [id_col, lang_col], "left_semi")
    taken = chosen.where(F.col(text_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"))
    taken = taken.agg(F.min_by(text_col, F.struct(F.xxhash64(text_col), text_col)).alias("text"))
    by: dict[str, list[bytes]] = {}
    for row in sorted(taken.collect(), key=lambda r: (r["lang"], r["id"])):
        by.setdefault(row["lang"], []).append(normalise(row["text"]))
    return {lang: b"".join(parts) for lang, parts in by.items()}


def predict(dictionaries: dict[str, bytes], text: Column, min_margin: float = MIN_MARGIN) -> Column:
    """Struct of lang_pred, score (0 to 1), margin and rejected for each whole text.

    A null text, and one without any letter, is ``und`` with score 0, and rejected; so is every text if nothing was
    learned. Ties go to the language that sorts first, and are rejected as narrow."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(dictionaries)
        for texts in batches:
            yield pd.DataFrame(classifier.classify(list(texts), min_margin), columns=RESULT.names)
        tidy()

    return run(text)


def identify(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``docs`` with the columns of :func:`predict`, learned from ``labelled``. Own columns of these names are
    replaced, all others pass through; repeated rows stay, and an empty table gives none."""
    return with_struct(docs, predict(fit(labelled, id_col, text_col, lang_col), F.col(text_col)), RESULT.names)
