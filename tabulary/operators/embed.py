"""Vectors for text, and searches by text on them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.functions import words
from tabulary.functions.text import row_to_text
from tabulary.operators.search import hybrid_search, vector_topk
from tabulary.session import in_arrow, reach_package, written

FEATURES = 512
WORD, GAP = re.compile(r"\w+"), re.compile(r"\W")
#: Texts whose features are counted at once.
ROWS = 1024
#: Words whose feature a worker remembers, and the longest of them.
WORDS_KEPT, LONGEST_KEPT = 300_000, 64


class _Features(dict):
    """The feature of each word: the first two bytes of its MD5, modulo the number of features."""

    def __init__(self, features: int) -> None:
        super().__init__()
        self.features = features

    def __missing__(self, word: bytes) -> int:
        digest = hashlib.md5(word, usedforsecurity=False).digest()
        feature = int.from_bytes(digest[:2], "big") % self.features
        if len(word) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = feature
        return feature

    def counts(self, batch: pa.Array) -> Iterator[np.ndarray]:
        """How often each text has words of each feature, for ``ROWS`` texts at a time."""
        for start in range(0, len(batch), ROWS):
            texts = batch.slice(start, ROWS).to_pylist()
            found = np.zeros((len(texts), self.features), dtype=np.int32)
            for numbers, held in words.parts(texts, GAP):
                rows, own, different = words.of_texts(held, WORD.pattern)
                places = np.fromiter(map(self.__getitem__, different), np.int64, len(different))
                cells = rows * self.features + places[own]
                found[numbers] += np.bincount(cells, minlength=len(held) * self.features).reshape(len(held), -1)
            yield found


class TextEmbedder:
    """Text to unit vectors: counts of hashed lower-cased words, weighted by rarity.

    A feature of ``df`` of ``n`` texts weighs ``ln((n + 1) / (df + 1))``. Fitting is one pass that
    returns one number per feature; texts are turned into vectors in Arrow batches. Null and empty
    texts, and those that hold only words of every text, have a vector of zeros. To use a model
    instead, give ``model``: a function from a text column to an ``array<float>`` column.
    """

    def __init__(self, features: int = FEATURES, model: Callable[[Column], Column] | None = None):
        self.features = features
        self.model = model
        self.weights: np.ndarray | None = None

    def fit(self, texts: DataFrame, text: str = "document") -> TextEmbedder:
        if self.model is not None:
            return self
        features = self.features

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, total, rows = _Features(features), np.zeros(features, dtype=np.int64), 0
            for batch in batches:
                rows += batch.num_rows
                for counts in known.counts(batch.column(0)):
                    total += (counts > 0).sum(axis=0)
            held = pa.array([[rows, *total.tolist()]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([held], names=["held"])

        lowered = texts.select(F.lower(F.col(text).cast("string")).alias("text"))
        cells = in_arrow(lowered, add, "held array<long>").select(F.posexplode("held"))
        sums = dict(cells.groupBy("pos").agg(F.sum("col")).collect())
        count = sums.get(0, 0)
        held = np.array([sums.get(place + 1, 0) for place in range(features)], dtype=np.float64)
        self.weights = np.log((count + 1) / (held + 1))
        return self

    def embed(self, texts: DataFrame, text: str = "document", output: str = "embedding") -> DataFrame:
        if self.model is not None:
            return texts.withColumn(output, self.model(F.col(text)))
        if self.weights is None:
            raise ValueError("fit the embedder first")
        features, weights = self.features, self.weights
        reach_package(texts.sparkSession)

        @F.arrow_udf("array<float>")
        def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = _Features(features)
            for batch in batches:
                rows = np.zeros((len(batch), features), dtype=np.float32)
                for number, counts in enumerate(known.counts(batch)):
                    weighted = counts * weights
                    lengths = np.sqrt((weighted * weighted).sum(axis=1))[:, None]
                    part = rows[number * ROWS : (number + 1) * ROWS]
                    np.divide(weighted, lengths, out=part, where=lengths > 0, casting="same_kind")
                ends = np.arange(len(batch) + 1, dtype=np.int32) * features
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))

        return texts.withColumn(output, vectors(F.lower(F.col(text).cast("string"))))


def embedded_rows(
    rows: DataFrame,
    key: str,
    columns: Sequence[str] | None = None,
    embedder: TextEmbedder | None = None,
) -> tuple[DataFrame, TextEmbedder]:
    """``id, document, embedding`` of every row, written once, and the fitted embedder.

    Handed to ``row_search`` they save embedding the rows for every search.
    """
    sentences = rows.select(F.col(key).alias("id"), row_to_text(rows, columns).alias("document"))
    embedder = (embedder or TextEmbedder()).fit(sentences)
    return written(embedder.embed(sentences), "rows"), embedder


def row_search(
    rows: DataFrame,
    key: str,
    queries: DataFrame,
    columns: Sequence[str] | None = None,
    max_results: int = 10,
    embedder: TextEmbedder | None = None,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Rows whose sentence is nearest to each query, joined back to the whole row.

    ``queries`` has ``query_id, query_text``; ``key`` identifies a row. ``stored`` and the fitted
    ``embedder`` are those of ``embedded_rows``, if the rows have been embedded before.
    """
    if stored is None:
        stored, embedder = embedded_rows(rows, key, columns, embedder)
    elif embedder is None:
        raise ValueError("stored rows need the embedder they were made with")
    asked = embedder.embed(queries, "query_text", "query_vector")
    hits = vector_topk(stored, asked, max_results)
    return hits.join(rows, hits["id"] == rows[key]).drop("id")


def text_search(
    chunks: DataFrame,
    queries: DataFrame,
    n: int = 10,
    embedder: TextEmbedder | None = None,
) -> DataFrame:
    """Hits for texts: chunks and questions are embedded alike, then ranked as hybrid search.

    ``chunks`` has ``id, document`` and what else is to be shown, ``queries`` has ``query_id,
    query_text``. The vectors of the chunks are written once, as both ranking steps read them.
    """
    embedder = embedder or TextEmbedder().fit(chunks)
    stored = written(embedder.embed(chunks), "vectors")
    asked = written(embedder.embed(queries, "query_text", "query_vector"), "asked")
    return hybrid_search(stored, asked, n)
