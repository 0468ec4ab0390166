"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of a model has a white space marker after another character, no merge reaches across the start of a
run of markers. A chunk is such a run with what follows it; each distinct chunk is segmented once, and a text's ids
are its chunks' ids, joined by position.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgraph.llm.shared import bound_batches, tidy, with_struct

MARK = "▁"
#: Characters of distinct chunks that a task remembers, and texts that are cut into chunks at once.
REMEMBERED, TEXTS = 1_000_000, 256
_CHUNK = re.compile(r" +[^ ]*")
#: All that usual normalisations change: characters with another compatibility or lower-case form, blanks at both ends.
_CHANGEABLE = " a  \t\r\n" + "".join(c for c in map(chr, range(0xA0, 0xD800)) if unicodedata.normalize("NFKC", c) != c or c.lower() != c) + "e\u0301 A "


class Codec:
    """Encoder and decoder of the model at ``path``. Raises ValueError for models that pieces could cross chunks in,
    or that normalise text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.vocab_size()))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("pieces of this model cross white space markers")
        self.mark, self.end = self.model.piece_to_id(MARK), self.model.eos_id()
        if self.model.encode("a  ① ", out_type=str)[:2] != [MARK + "a", MARK * 2] or self.model.decode(self.model.encode(_CHANGEABLE)) != _CHANGEABLE:
            raise ValueError("this model normalises text")
        self.table: dict[str, tuple[list[int], str] | int] = {}
        self.held = 0

    def _learn(self, chunks: set[str], kept: Callable[[list[int]], tuple[list[int], str] | int]) -> None:
        """Segment the chunks that the table hasn't; ``kept`` of its ids is what it holds for each."""
        fresh = [c for c in chunks if c not in self.table]
        if self.held + sum(map(len, fresh)) > REMEMBERED:
            self.table.clear()
            self.held, fresh = 0, list(chunks)
        self.held += sum(map(len, fresh))
        # The library puts a marker before what it is given, in place of the chunk's first space.
        for chunk, ids in zip(fresh, self.model.encode([c[1:] for c in fresh], num_threads=1), strict=True):
            self.table[chunk] = kept(ids if chunk != " " else [self.mark])

    @staticmethod
    def chunks(text: str | None) -> list[str]:
        return _CHUNK.findall(" " + text.replace(MARK, " ")) if text else []

    def _looked_up(self, texts: list[str | None], kept: Callable) -> Iterator[list]:
        for start in range(0, len(texts), TEXTS):
            split = [self.chunks(t) for t in texts[start : start + TEXTS]]
            self._learn(set(chain.from_iterable(split)), kept)
            for own in split:
                yield [self.table[c] for c in own]

    def rows(self, texts: list[str | None]) -> Iterator[list[tuple[list[int], str]]]:
        """The chunks of each text as (ids, ids in decimal)."""
        return self._looked_up(texts, lambda ids: (ids, " ".join(map(str, ids))))

    def lengths(self, texts: list[str | None]) -> Iterator[int]:
        """Number of ids of each text, with the end id. A codec that counts holds numbers alone."""
        return (1 + sum(row) for row in self._looked_up(texts, len))

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text, with the end id; a null text is an empty one."""
        for row in self.rows(texts):
            yield [*chain.from_iterable(ids for ids, _ in row), self.end]

    def decode(self, ids: list[int] | None) -> str:
        return self.model.decode(ids) if ids else ""


def encode(text: Column, path: str) -> Column:
    """array<int> of each whole text's ids with the end id; null and empty texts have the end id alone."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(path)
        for texts in batches:
            yield pd.Series(list(codec.encode(list(texts))), dtype=object)

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """Text of each array of ids; null and empty arrays give an empty text."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(path)
        for rows in batches:
            yield pd.Series([codec.decode(None if x is None else [int(i) for i in x]) for x in rows], dtype=object)

    return run(ids)


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 (decimal ids joined by single spaces) and decoded_sha256 of each text,
    encoded and decoded in one pass, so that ids don't leave the worker. Own columns of these names are replaced."""

    @F.pandas_udf(DIGESTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(path)
        end = str(codec.end)
        for texts in batches:
            out = []
            for row in codec.rows(list(texts)):
                ids = [*chain.from_iterable(ids for ids, _ in row), codec.end]
                joined = " ".join([*(said for _, said in row), end])
                out.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        codec.table.clear()
        tidy()

    bound_batches(docs.sparkSession)
    return with_struct(docs, run(F.col(text_col)), ["n_tokens", "ids_sha256", "decoded_sha256"])


def with_lengths(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens: the ids of each whole text with the end id, which is all that null and empty texts have.
    An own n_tokens is replaced; repeated rows stay, and an empty table gives none."""

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(path)
        for texts in batches:
            yield pd.Series(list(codec.lengths(list(texts))), dtype="int64")
        codec.table.clear()
        tidy()

    bound_batches(docs.sparkSession)
    return docs.withColumn("n_tokens", run(F.col(text_col)))
