"""Texts that share words, found by sketches of their word sets and decided on the whole sets.

A sketch has a bit for each remainder of the words' hashes: whether an odd number of the set's
words fall there. Bits in which two sketches differ are at most as many as the words in which the
sets do, so a pair of sketches too far apart needs no look at the words, and no pair that overlaps
enough is lost. Sets are sketched in classes by size, with bits in proportion; sets of too
different size are not compared at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.functions.text import word_hashes
from tabulary.operators.search import SCORE_DIGITS
from tabulary.session import in_arrow, written

#: Overlaps below this need sketches of twice the size to be told from chance.
LEAST = 0.5
#: Bytes of the query words that a task holds at once, cells and pairs it works on at once.
ASKED_BYTES, CELLS, PAIRS = 32 * 1024 * 1024, 1 << 22, 1 << 20
#: Bits for each word of the smallest set of a class, and the most of a sketch.
WORD_BITS, MOST_BITS = 8, 1 << 20


def word_sets(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, words``: 64-bit hashes of the distinct lower-cased words between white space of each text.

    Texts without words or without a key are left out.
    """
    sets = texts.filter(F.col(key).isNotNull()).select(F.col(key), word_hashes(F.col(text)).alias("words"))
    return sets.filter(F.size("words") > 0)


class _Groups:
    """The different sets of a column of lists, and the rows that hold each of them."""

    def __init__(self, lists: pa.ListArray) -> None:
        flat, own, known = lists.flatten().to_numpy(), [], {}
        end = 0
        self.sets: list[np.ndarray] = []
        for size in lists.value_lengths().to_pylist():
            words = np.sort(flat[end : end + size])
            end += size
            number = known.setdefault(words.tobytes(), len(known))
            if number == len(self.sets):
                self.sets.append(words)
            own.append(number)
        own = np.array(own, dtype=np.int64)
        self.rows = np.argsort(own, kind="stable")
        self.counts = np.bincount(own, minlength=len(self.sets))
        self.starts = np.cumsum(self.counts) - self.counts
        self.sizes = np.array([len(words) for words in self.sets], dtype=np.int64)

    def classes(self, word_bits: int) -> Iterator[tuple[int, np.ndarray]]:
        """Bits of a sketch, and the sets that get as many, by size."""
        order = np.argsort(self.sizes, kind="stable")
        powers = np.frexp(self.sizes[order])[1] - 1
        for power in np.unique(powers):
            bits = min(MOST_BITS, max(64, word_bits << int(power)))
            chosen, step = order[powers == power], max(1, CELLS // bits)
            for start in range(0, len(chosen), step):
                yield bits, chosen[start : start + step]

    def sketches(self, chosen: np.ndarray, bits: int) -> np.ndarray:
        """A column of ``bits`` bits for each chosen set."""
        places = np.concatenate([self.sets[number] for number in chosen]) & (bits - 1)
        places += np.repeat(np.arange(len(chosen)) * bits, self.sizes[chosen])
        odd = (np.bincount(places, minlength=len(chosen) * bits) & 1).astype(np.uint8)
        packed = np.packbits(odd.reshape(len(chosen), bits), axis=1).view(np.uint64)
        return np.ascontiguousarray(packed.T)


def _folded(sketches: np.ndarray, bits: int) -> np.ndarray:
    """The same sketches with fewer bits."""
    while len(sketches) * 64 > bits:
        half = len(sketches) // 2
        sketches = sketches[:half] ^ sketches[half:]
    return sketches


class _Asked:
    """The word sets of some queries, past which those of documents stream."""

    def __init__(self, queries: pa.Table, least: float) -> None:
        self.names = queries.column("query_id").combine_chunks()
        self.groups = _Groups(queries.column("words").combine_chunks())
        self.least = least - 1e-8  # scores are rounded before they are judged
        self.word_bits = WORD_BITS if least >= LEAST else 2 * WORD_BITS
        self.blocks = [
            (bits, chosen, self.groups.sketches(chosen, bits)) for bits, chosen in self.groups.classes(self.word_bits)
        ]

    def near(self, held: _Groups, bits: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets and queries whose sketches are near enough."""
        sketches, sizes = held.sketches(chosen, bits), held.sizes[chosen]
        apart = (1 - self.least) / (1 + self.least)
        sets, queries = [], []
        for own_bits, asked, own in self.blocks:
            wanted = self.groups.sizes[asked]
            if wanted[-1] < sizes[0] * self.least or sizes[-1] < wanted[0] * self.least:
                continue
            fewest = min(bits, own_bits)
            ours, theirs = _folded(own, fewest), _folded(sketches, fewest)
            first = np.searchsorted(sizes, wanted * self.least)
            last = np.searchsorted(sizes, wanted / self.least, side="right")
            for place, (start, end) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
                if start < end:
                    differ = np.bitwise_count(theirs[:, start:end] ^ ours[:, place, None]).sum(axis=0, dtype=np.int32)
                    found = np.flatnonzero(differ <= apart * (sizes[start:end] + wanted[place])) + start
                    sets.append(chosen[found])
                    queries.append(np.full(len(found), asked[place]))
        if not sets:
            return (np.zeros(0, dtype=np.int64),) * 2
        return np.concatenate(sets), np.concatenate(queries)

    def scores(self, held: _Groups, sets: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """The overlap of each pair, whose sets are in order."""
        scores, sizes = np.empty(len(sets)), self.groups.sizes[queries]
        edges = np.flatnonzero(np.diff(sets, prepend=-1, append=-1))
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            words = held.sets[sets[begin]]
            for start in range(begin, end, 1000):
                part = slice(start, min(end, start + 1000))
                asked = np.concatenate([self.groups.sets[number] for number in queries[part]])
                place = np.minimum(np.searchsorted(words, asked), len(words) - 1)
                shared = np.add.reduceat((words[place] == asked).astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
                scores[part] = shared / (sizes[part] + len(words) - shared)
        return scores

    def hits(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held = _Groups(batch.column("words"))
        for bits, chosen in held.classes(self.word_bits):
            sets, queries = self.near(held, bits, chosen)
            order = np.argsort(sets, kind="stable")
            sets, queries = sets[order], queries[order]
            scores = self.scores(held, sets, queries)
            kept = scores >= self.least
            yield from self._rows(batch, held, sets[kept], queries[kept], scores[kept])

    def _rows(
        self, batch: pa.RecordBatch, held: _Groups, sets: np.ndarray, queries: np.ndarray, scores: np.ndarray
    ) -> Iterator[pa.RecordBatch]:
        """Each pair of sets for all rows and queries that hold them."""
        asked = self.groups
        totals = held.counts[sets] * asked.counts[queries]
        part = (np.cumsum(totals) - totals) // PAIRS
        for number in np.unique(part):
            own = np.flatnonzero(part == number)
            pair = np.repeat(own, totals[own])
            place = np.arange(len(pair)) - np.repeat(np.cumsum(totals[own]) - totals[own], totals[own])
            row, query = np.divmod(place, asked.counts[queries[pair]])
            rows = held.rows[held.starts[sets[pair]] + row]
            query = asked.rows[asked.starts[queries[pair]] + query]
            yield pa.RecordBatch.from_arrays(
                [self.names.take(pa.array(query)), batch.column("id").take(pa.array(rows)), pa.array(scores[pair])],
                names=["query_id", "id", "keyword_score"],
            )


class KeywordIndex:
    """Word sets of documents, written once.

    ``id`` is taken as unique. Null and empty documents have no words and are never found.
    """

    def __init__(self, sets: DataFrame) -> None:
        self.sets = sets

    @classmethod
    def build(cls, documents: DataFrame, text: str = "document") -> KeywordIndex:
        return cls(written(word_sets(documents, "id", text), "sets"))

    def search(self, queries: DataFrame, least: float = LEAST) -> DataFrame:
        """``query_id, id, keyword_score``: all documents that overlap a query by ``least`` or more.

        ``queries`` has ``query_id, query_text`` with unique ids. Queries whose words take up to
        ``ASKED_BYTES`` go to every task, past whose documents they stream. More are dealt out in
        blocks, which take their turns: the documents are read once for each block and never moved.
        """
        if not 0 < least <= 1:
            raise ValueError("the least overlap is above 0 and at most 1")
        asked = written(word_sets(queries, "query_id", "query_text"), "asked")
        size = asked.agg(F.coalesce(F.sum(F.size("words").cast("long") * 8), F.lit(0))).first()[0]
        blocks = max(1, -(-size // ASKED_BYTES))
        if blocks == 1:
            found = self._passed(asked, least)
        else:
            own = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
            parts = (self._passed(asked.filter(own == number), least) for number in range(blocks))
            found = reduce(DataFrame.unionByName, [written(part, "overlaps") for part in parts])
        return found.distinct().filter(F.round("keyword_score", SCORE_DIGITS) >= least)

    def _passed(self, asked: DataFrame, least: float) -> DataFrame:
        """Hits of each task's documents for one block of queries."""
        shared = self.sets.sparkSession.sparkContext.broadcast(asked.toArrow())
        types = asked.schema["query_id"].dataType, self.sets.schema["id"].dataType
        schema = "query_id {}, id {}, keyword_score double".format(*(t.simpleString() for t in types))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not shared.value.num_rows:
                return
            block = _Asked(shared.value, least)
            for batch in batches:
                if batch.num_rows:
                    yield from block.hits(batch)

        return in_arrow(self.sets, run, schema)
