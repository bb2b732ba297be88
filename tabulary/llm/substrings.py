"""Repeated passages of words removed from documents by matching against suffix automata.

The reference is the corpus itself, so what an automaton holds must be told apart first. Of the
grams that start within any window the one with the smallest hash names the window's place, and
equal windows have their place at the same word. A place whose gram occurs nowhere else ends
there. The stretch of all windows of one place is a passage; of equal passages the earliest goes
on, and the others are repeated as a whole. The passages are dealt by gram into shards of bounded
size. A task builds the suffix automaton of its shard, in which every state knows where its
strings end for the first time, and streams the shard's passages through it: their matching
statistics, held at the length of a window, name the earliest place of every window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.llm.common import map_batches, picked
from tabulary.llm.suffixes import runs, signed, window_minima
from tabulary.session import written

LENGTH = 20
GRAM = 6
SLICE = 1 << 19
#: Words read as one sequence, if one text doesn't hold more.
BLOCK_WORDS = 200_000
#: Words of a shard beyond which no further gram joins it.
SHARD_WORDS = 100_000
#: Different passages of one gram beyond which their windows are told apart by digests instead,
#: as no shard may outgrow a task.
HOT_GRAM = 4_000

FACTORS = np.random.default_rng(20).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POSITION = np.uint64((1 << 20) - 1)


def gram_hashes(words: list[bytes], gram: int) -> np.ndarray:
    """A hash of the ``gram`` words from each place on."""
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - gram + 1
    hashed = np.zeros(n, dtype=np.uint64)
    for place in range(gram):
        hashed += each[place : place + n] * FACTORS[place % len(FACTORS)]
        hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xD6E8FEB86659FD93)
    hashed ^= hashed >> np.uint64(32)
    return hashed


def sampled(hashed: np.ndarray, width: int) -> np.ndarray:
    """The place of the least hash among each ``width`` in a row; of equal ones the first."""
    found = []
    for begin in range(0, len(hashed) - width + 1, SLICE):
        part = hashed[begin : begin + SLICE + width - 1]
        keys = (part & ~POSITION) | np.arange(len(part), dtype=np.uint64)
        found.append((window_minima(keys, width) & POSITION).astype(np.int64) + begin)
    return np.concatenate(found)


def places(rows: list[list[bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, gram hash, first window and number of windows of every place of every row.

    The rows' words are read as one sequence; windows that cross rows are left out.
    """
    sizes = np.array([len(words) for words in rows])
    words = list(chain.from_iterable(rows))
    if len(words) < length:
        return (np.zeros(0, dtype=np.int64),) * 4
    hashed = gram_hashes(words, gram)
    at = sampled(hashed, length - gram + 1)
    ends = np.cumsum(sizes)
    window = np.arange(len(at))
    whole = np.flatnonzero(window + length <= np.repeat(ends, sizes)[: len(at)])
    at = at[whole]
    own = np.flatnonzero(np.diff(at, prepend=-1) | (np.diff(whole, prepend=-1) != 1))
    starts = whole[own]
    owner = np.searchsorted(ends, starts, side="right")
    counts = np.diff(np.append(own, len(whole)))
    return owner, hashed[at[own]].view(np.int64), starts - (ends - sizes)[owner], counts


def blocks(texts: list[bytes | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of texts, as many texts at a time as make a block, with the first one's number."""
    held: list[list[bytes]] = []
    first = size = 0
    for number, text in enumerate(texts):
        held.append((text or b"").split())
        size += len(held[-1])
        if size >= BLOCK_WORDS:
            yield first, held
            first, held, size = number + 1, [], 0
    if held:
        yield first, held


def named(words: list[bytes], start: int, n: int, length: int) -> tuple[bytes, int]:
    """The words of a passage and their digest."""
    passage = b" ".join(words[start : start + n + length - 1])
    return passage, signed(xxhash.xxh3_64_intdigest(passage))


class Automaton:
    """Suffix automaton of passages; ``first`` is where a state's strings end for the first time."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [-1]

    def _state(self, length: int, following: dict[bytes, int], link: int, first: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """The part of ``target`` that is one word longer than ``state`` as a state of its own."""
        following, link = self.next, self.link
        part = self._state(
            self.length[state] + 1, dict(following[target]), link[target], self.first[target]
        )
        while state >= 0 and following[state].get(word) == target:
            following[state][word] = part
            state = link[state]
        link[target] = part
        return part

    def add(self, words: list[bytes], end: int) -> None:
        """Takes in a passage whose words end at ``end`` and the following numbers.

        Passages must come in the order of their places, or ``first`` isn't the earliest.
        """
        following, link, length = self.next, self.link, self.length
        last = 0
        for place, word in enumerate(words, end):
            target = following[last].get(word)
            if target is not None:
                fits = length[target] == length[last] + 1
                last = target if fits else self._split(last, word, target)
                continue
            state, own = last, self._state(length[last] + 1, {}, 0, place)
            while state >= 0 and word not in following[state]:
                following[state][word] = own
                state = link[state]
            if state >= 0:
                target = following[state][word]
                fits = length[target] == length[state] + 1
                link[own] = target if fits else self._split(state, word, target)
            last = own

    def matches(self, words: list[bytes], most: int) -> Iterator[tuple[int, int]]:
        """Matching statistics: for each word the longest match that ends there, up to ``most``
        words, and where that match ends for the first time."""
        following, link, length, first = self.next, self.link, self.length, self.first
        state = matched = 0
        for word in words:
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            if word in following[state]:
                state, matched = following[state][word], matched + 1
            while state and length[link[state]] >= most:
                state = link[state]
            matched = min(matched, most)
            yield matched, first[state]


def first_windows(passages: list[list[bytes]], length: int) -> list[list[int]]:
    """For each passage the windows that no passage before it, nor it itself before, holds.

    All passages together are one shard: its automaton is built once and each is streamed
    through it. Windows are given by their first word.
    """
    automaton, ends, end = Automaton(), [], 0
    for words in passages:
        automaton.add(words, end)
        ends.append(end)
        end += len(words)
    return [
        [
            place - length + 1
            for place, (matched, first) in enumerate(automaton.matches(words, length))
            if matched == length and first == begin + place
        ]
        for words, begin in zip(passages, ends, strict=True)
    ]


# Spark ------------------------------------------------------------------------------------


def occurring(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``row, gram``: each gram that names a place of a document; twice if it names several."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        rows, grams = [], []
        for first, words in blocks(batch.column(1).to_pylist()):
            owner, found, _, _ = places(words, length, gram)
            order = np.lexsort((found, owner))
            owner, found = owner[order], found[order]
            # The first two of each run of equal grams of a row.
            new = np.diff(owner, prepend=-1).astype(bool) | (np.diff(found, prepend=0) != 0)
            kept = np.flatnonzero(new | np.concatenate([[False], new[:-1]])[: len(new)])
            rows.append(owner[kept] + first)
            grams.append(found[kept])
        return [batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(grams))]

    return map_batches(docs.select("row", "text"), make, "`row` long, gram long", ["row", "gram"])


def packed(docs: DataFrame, kind: str) -> DataFrame:
    """Documents with their texts compressed, as they are shuffled and written more than once."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        press = zstandard.ZstdCompressor(level=3).compress
        texts = [press(text or b"") for text in batch.column(2).to_pylist()]
        return [batch.column(0), batch.column(1), pa.array(texts, pa.binary())]

    return map_batches(docs, make, f"`row` long, doc_id {kind}, packed binary", ["row", "doc_id", "packed"])


def unpacked(column: pa.Array) -> list[bytes]:
    open_ = zstandard.ZstdDecompressor().decompress
    return [open_(text) for text in column.to_pylist()]


RESULT = "n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,`end`:int>>, kept string"
RESULT_NAMES = ["n_words", "n_removed", "kept_sha256", "spans", "kept"]
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def result(words: list[bytes], gone: np.ndarray, keep: bool) -> tuple:
    """The result of a document of which the words marked in ``gone`` are removed."""
    kept = b" ".join(compress(words, (~gone).tolist())) if gone.any() else b" ".join(words)
    spans = [{"start": start, "end": end} for start, end in runs(gone)]
    digest = hashlib.sha256(kept).hexdigest()
    return len(words), int(gone.sum()), digest, spans, kept if keep else None


def once(
    words: list[bytes], grams: list[int], starts: list[int], counts: list[int], length: int
) -> tuple[list[int], ...]:
    """The different passages of a document, and where those are that it holds again."""
    seen: set[tuple[int, int]] = set()
    kept, again = [], []
    several = len(set(grams)) < len(grams)
    for gram, start, n in zip(grams, starts, counts, strict=True):
        # Equal passages have equal grams.
        name = (gram, named(words, start, n, length)[1]) if several else None
        if name in seen:
            again += [start, n]
        else:
            if several:
                seen.add(name)
            kept.append((gram, start, n))
    return (*(list(part) for part in zip(*kept, strict=True)), again)


OPENED = "`row` long, doc_id {0}, packed binary, grams array<long>, starts array<int>, counts array<int>, again array<int>"
OPENED_NAMES = ["row", "doc_id", "packed", "grams", "starts", "counts", "again"]


def opened(docs: DataFrame, kind: str, length: int, gram: int) -> DataFrame:
    """Documents with their open passages: those whose gram occurs again.

    A passage that a document holds several times is open once; ``again`` has the first windows
    and numbers of windows of the others, which are repeated for certain.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        rows, lists = [], batch.column(3).to_pylist()
        # Documents without such a gram aren't read.
        texts = [text if listed else None for text, listed in zip(batch.column(2).to_pylist(), lists, strict=True)]
        open_ = zstandard.ZstdDecompressor().decompress
        for first, block in blocks([open_(text) if text else None for text in texts]):
            found = places(block, length, gram)
            edges = np.searchsorted(found[0], np.arange(len(block) + 1))
            for number, words in enumerate(block):
                listed = lists[first + number]
                if not listed:
                    rows.append(([], [], [], []))
                    continue
                grams, starts, counts = (part[edges[number] : edges[number + 1]] for part in found[1:])
                chosen = np.flatnonzero(np.isin(grams, np.array(listed, dtype=np.int64)))
                own = (part[chosen].tolist() for part in (grams, starts, counts))
                rows.append(once(words, *own, length))
        kinds = [pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]
        columns = zip(*rows, strict=True)
        return [
            *batch.columns[:3],
            *(pa.array(column, k) for column, k in zip(columns, kinds, strict=True)),
        ]

    return map_batches(docs, make, OPENED.format(kind), OPENED_NAMES)


PASSAGE = "`none` boolean, doc_id {0}, `row` long, start int, gram long, digest long, words binary"
PASSAGE_NAMES = ["none", "doc_id", "row", "start", "gram", "digest", "words"]


def passages(opened_docs: DataFrame, kind: str, length: int) -> DataFrame:
    """The open passages of every document with their words."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        rows, starts, grams, digests, texts = [], [], [], [], []
        columns = (batch.column(n).to_pylist() for n in ("grams", "starts", "counts"))
        whole = unpacked(batch.column("packed"))
        for number, (text, own, begins, counts) in enumerate(zip(whole, *columns, strict=True)):
            words = text.split()
            for gram, start, n in zip(own, begins, counts, strict=True):
                passage, digest = named(words, start, n, length)
                rows.append(number)
                starts.append(start)
                grams.append(gram)
                digests.append(digest)
                texts.append(passage)
        ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
        return [
            ids.is_null(),
            ids,
            batch.column("row").take(pa.array(rows, pa.int64())),
            pa.array(starts, pa.int32()),
            pa.array(grams, pa.int64()),
            pa.array(digests, pa.int64()),
            pa.array(texts, pa.binary()),
        ]

    return map_batches(opened_docs, make, PASSAGE.format(kind), PASSAGE_NAMES)


KEPT = "`row` long, doc_id {0}, kept array<int>"


def matched(rows: DataFrame, kind: str, length: int) -> DataFrame:
    """``row, doc_id, kept``: the windows of each passage that occur there for the first time.

    Whole grams are gathered until a shard is full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            names = ("row", "doc_id", "start", "gram", "words")
            for row in zip(*(batch.column(name).to_pylist() for name in names), strict=True):
                if size > SHARD_WORDS and row[3] != held[-1][3]:
                    yield _shard(held, batch.schema.field("doc_id").type, length)
                    held, size = [], 0
                held.append((*row[:4], row[4].split()))
                size += len(held[-1][4])
        if held:
            yield _shard(held, batch.schema.field("doc_id").type, length)

    return rows.mapInArrow(run, KEPT.format(kind))


def _shard(held: list[tuple], id_type: pa.DataType, length: int) -> pa.RecordBatch:
    # A gram with one passage has nothing to match, and no passage holds a window of its own twice.
    grams = [row[3] for row in held]
    alone = [
        own != before and own != after
        for before, own, after in zip([None, *grams], grams, [*grams[1:], None])
    ]
    met = [row[4] for row, only in zip(held, alone, strict=True) if not only]
    streamed = iter(first_windows(met, length))
    found = [
        range(len(row[4]) - length + 1) if only else next(streamed)
        for row, only in zip(held, alone, strict=True)
    ]
    kept = [
        (row[0], row[1], [row[2] + place for place in firsts])
        for row, firsts in zip(held, found, strict=True)
        if firsts
    ]
    columns = list(zip(*kept, strict=True)) or [()] * 3
    kinds = pa.int64(), id_type, pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(column, k) for column, k in zip(columns, kinds, strict=True)],
        names=["row", "doc_id", "kept"],
    )


def told_by_digest(rows: DataFrame, kind: str, length: int) -> DataFrame:
    """As ``matched``, for grams with very many passages: the earliest place of each digest.

    The least place is combined before the shuffle, so no window is a burden to one task.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        rows, at, digests = [], [], []
        starts = batch.column("start").to_pylist()
        for number, passage in enumerate(batch.column("words").to_pylist()):
            words = passage.split()
            for place in range(len(words) - length + 1):
                rows.append(number)
                at.append(starts[number] + place)
                digests.append(xxhash.xxh3_128_digest(b" ".join(words[place : place + length])))
        chosen = pa.array(rows, pa.int64())
        return [
            *(batch.column(name).take(chosen) for name in ("none", "doc_id", "row")),
            pa.array(at, pa.int32()),
            pa.array(digests, pa.binary()),
        ]

    names = ["none", "doc_id", "row", "at", "digest"]
    schema = f"`none` boolean, doc_id {kind}, `row` long, `at` int, digest binary"
    each = map_batches(rows, make, schema, names)
    first = each.groupBy("digest").agg(F.min(F.struct("none", "doc_id", "row", "at")).alias("first"))
    return first.groupBy(F.col("first.row").alias("row"), F.col("first.doc_id").alias("doc_id")).agg(
        F.collect_list("first.at").alias("kept")
    )


def finished(rows: DataFrame, kind: str, length: int, keep: bool) -> DataFrame:
    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        results = []
        columns = (batch.column(n).to_pylist() for n in ("starts", "counts", "again", "kept"))
        for text, starts, counts, again, kept in zip(unpacked(batch.column("packed")), *columns, strict=True):
            words = text.split()
            windows = np.zeros(len(words) + 1, dtype=bool)
            for start, n in zip(starts, counts, strict=True):
                windows[start : start + n] = True
            windows[np.array(kept or [], dtype=np.int64)] = False
            for start, n in zip(again[::2], again[1::2], strict=True):
                windows[start : start + n] = True
            edges = np.zeros(len(words) + length + 1, dtype=np.int64)
            at = np.flatnonzero(windows)
            edges[at] += 1
            edges[at + length] -= 1
            results.append(result(words, np.cumsum(edges)[: len(words)] > 0, keep))
        columns = list(zip(*results, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), SPANS, pa.binary()]
        arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]
        return [batch.column("doc_id"), *arrays[:4], arrays[4].cast(pa.string())]

    return map_batches(rows, make, f"doc_id {kind}, {RESULT}", ["doc_id", *RESULT_NAMES])


def remove_repeats(
    df: DataFrame,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: bool = True,
    gram: int = GRAM,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans, kept`` for every row of ``df``.

    A word is removed if a window of ``length`` words covers it whose words also start earlier:
    in a document with a smaller id, or before in the same one. Windows are judged on the input
    and never cross documents. ``spans`` are the runs of removed words, ``kept`` is the rest
    joined by single blanks (null unless ``keep``).

    Null and empty texts have no words and keep the digest of nothing; texts with fewer words
    than a window stay whole. Rows without an id come after all others. Rows that share an id
    and a text are one document and get equal results; rows that share an id only are told
    apart, and ordered, by a hash of their text. Texts of any length are read whole, an empty
    table gives no row, extra columns are not looked at.
    """
    if not 0 < gram <= length:
        raise ValueError("a gram must fit into a window")
    kind = df.schema[id_col].dataType.simpleString()
    docs = picked(df, doc_id=id_col, text=text_col).select(
        F.xxhash64("doc_id", "text").alias("row"),
        "doc_id",
        F.col("text").cast("binary").alias("text"),
    )
    # A hash that two documents share joins their grams, which opens more passages and no fewer.
    rows = written(occurring(docs, length, gram), "grams")
    again = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
    # Written, so that the join alone deals the rows out and may split a hot gram.
    again = written(again, "again")
    listed = (
        rows.join(again, "gram", "left_semi")
        .groupBy(F.col("row").alias("own_row"))
        .agg(F.collect_set("gram").alias("listed"))
    )
    met = F.col("row") == F.col("own_row")
    both = packed(docs, kind).join(listed, met, "left").select("row", "doc_id", "packed", "listed")
    table = written(opened(both, kind, length, gram), "opened")
    open_ = table.filter(F.size("starts") > 0)
    # Equal passages meet before the shuffle, so copies of a document are no burden.
    firsts = (
        passages(open_, kind, length)
        .groupBy("gram", "digest")
        .agg(
            F.min(F.struct("none", "doc_id", "row", "start")).alias("first"),
            F.min("words").alias("words"),
        )
        .select("gram", "first.*", "words")
    )
    firsts = written(firsts, "firsts")
    many = firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"))
    many = written(many.filter(F.col("kinds") > HOT_GRAM).select("gram"), "many")
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = firsts.join(many, "gram", "left_anti")
    dealt = cold.repartition(partitions, "gram").sortWithinPartitions(
        "gram", "none", "doc_id", "row", "start"
    )
    kept = matched(dealt, kind, length)
    if not many.isEmpty():
        hot = firsts.join(many, "gram", "left_semi")
        kept = kept.unionByName(told_by_digest(hot, kind, length))
    found = kept.groupBy(F.col("row").alias("own_row"), F.col("doc_id").alias("own_id")).agg(
        F.flatten(F.collect_list("kept")).alias("kept")
    )
    # The id beside its hash, should two hashes ever agree.
    own = (F.col("row") == F.col("own_row")) & F.col("doc_id").eqNullSafe(F.col("own_id"))
    columns = ["doc_id", "packed", "starts", "counts", "again", "kept"]
    rest = open_.join(found, own, "left").select(columns)
    none = F.lit(None).cast("array<int>").alias("kept")
    closed = table.filter(F.size("starts") == 0).select(*columns[:-1], none)
    return finished(closed, kind, length, keep).unionByName(finished(rest, kind, length, keep))
