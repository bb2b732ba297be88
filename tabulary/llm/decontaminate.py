"""Benchmark passages found in documents with an FM-index per shard.

A shard is one Arrow batch. Its words are numbered by the benchmark's vocabulary; only runs of
words in which each neighbouring pair also stands in the benchmark can hold a window, so the
rest is left out of the index without loss. Windows are searched backwards through the ranks of
a wavelet matrix over the Burrows-Wheeler transform, all at once; their places follow from
sampled suffix positions, and overlapping places merge into spans to remove.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.llm.common import map_batches, picked, raw
from tabulary.session import written

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Small buckets of items of which a block is put together.
BUCKETS_PER_BLOCK = 64
SAMPLED_EVERY = 8

#: A word is a run of digits, a-z and anything that isn't ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text with A-Z in lower case."""
    return text.translate(LOWER).split()


class Benchmark:
    """Windows of one block of benchmark items, numbered words and pairs of words."""

    def __init__(self, items: list[tuple[object, bytes]], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = defaultdict(set)
        pairs: set[tuple[int, int]] = set()
        for item, text in items:
            codes = [
                self.numbers.setdefault(word, len(self.numbers) + 1) for word in words(text)
            ]
            pairs.update(zip(codes, codes[1:], strict=False))
            if codes:
                for start in range(max(1, len(codes) - window + 1)):
                    owners[tuple(codes[start : start + window])].add(item)
        self.owners = list(owners.values())
        self.lengths = np.array([len(w) for w in owners], dtype=np.int64)
        self.table = np.zeros((len(owners), window), dtype=np.int64)  # the last word first
        for row, codes in zip(self.table, owners, strict=True):
            row[: len(codes)] = codes[::-1]
        self.radix = len(self.numbers) + 1
        self.pairs = np.unique(np.array([a * self.radix + b for a, b in pairs], dtype=np.int64))
        self.shortest = int(self.lengths.min()) if len(owners) else 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order, by doubling the sorted prefix."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, width = len(text), 1
    while True:
        following = np.full(n, -1, dtype=np.int64)
        following[: n - width] = rank[width:]
        key = rank * (n + 1) + following + 1
        order = np.argsort(key, kind="stable")
        steps = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = steps
        if steps[-1] == n - 1:
            return order
        width *= 2


class WaveletMatrix:
    """Ranks of numbers in a sequence, a bit of the numbers a level."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = []
        for bit in range(int(values.max()).bit_length() - 1, -1, -1):
            ones = (values >> bit) & 1
            before = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)
            self.levels.append((bit, before, len(values) - int(before[-1])))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def rank(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each number stands before its place."""
        low = np.zeros_like(place)
        for bit, before, zeros in self.levels:
            one = (number >> bit) & 1 == 1
            low = np.where(one, zeros + before[low], low - before[low])
            place = np.where(one, zeros + before[place], place - before[place])
        return place - low


class FmIndex:
    """Backward search and location in a sequence of positive numbers."""

    def __init__(self, text: np.ndarray, every: int = SAMPLED_EVERY) -> None:
        text = np.concatenate([text, [0]])
        order = suffix_array(text)
        self.last = text[order - 1]
        self.ranks = WaveletMatrix(self.last)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.kept = order % every == 0
        self.sample_of = np.cumsum(self.kept) - 1
        self.samples = order[self.kept]

    def search(self, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows from and to which the suffixes begin with each pattern, read from its end."""
        low = np.zeros(len(table), dtype=np.int64)
        high = np.full(len(table), len(self.last), dtype=np.int64)
        for step in range(table.shape[1]):
            live = np.flatnonzero((step < lengths) & (low < high))
            number = table[live, step]
            known = number < len(self.first) - 1
            high[live[~known]] = low[live[~known]]
            live, number = live[known], number[known]
            low[live] = self.first[number] + self.ranks.rank(number, low[live])
            high[live] = self.first[number] + self.ranks.rank(number, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the sequence the suffixes of these rows start."""
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        while len(open_ := np.flatnonzero(~self.kept[rows])):
            number = self.last[rows[open_]]
            rows[open_] = self.first[number] + self.ranks.rank(number, rows[open_])
            steps[open_] += 1
        return self.samples[self.sample_of[rows]] + steps


def runs_of(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def occurrences(codes: np.ndarray, benchmark: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``codes`` (0: no word of the benchmark) and the windows that begin there."""
    none = np.zeros(0, dtype=np.int64)
    if not len(codes) or not len(benchmark.owners):
        return none, none
    key = codes[:-1] * benchmark.radix + codes[1:]
    near = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
    held = np.zeros(len(key), dtype=bool)
    if len(benchmark.pairs):
        at = np.minimum(np.searchsorted(benchmark.pairs, key[near]), len(benchmark.pairs) - 1)
        held[near] = benchmark.pairs[at] == key[near]
    starts, ends = runs_of(held)
    ends = ends + 1  # words of a run of pairs
    if benchmark.shortest == 1:
        alone = codes > 0
        alone[:-1] &= ~held
        alone[1:] &= ~held
        single = np.flatnonzero(alone)
        starts, ends = np.concatenate([starts, single]), np.concatenate([ends, single + 1])
    long = ends - starts >= benchmark.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return none, none
    # Runs follow each other with a number between them that no window has.
    sizes = ends - starts + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    places = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, sizes)
    text = codes[np.minimum(places, len(codes) - 1)] + 1
    text[offsets[1:] - 1] = 1
    index = FmIndex(text)
    table = np.where(benchmark.table > 0, benchmark.table + 1, 0)
    low, high = index.search(table, benchmark.lengths)
    count = high - low
    window = np.repeat(np.arange(len(count)), count)
    rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)
    return places[index.locate(rows)], window


def _pass(df: DataFrame, benchmark, key_type: str, clean: bool = False) -> DataFrame:
    """``doc_id, n_words, spans, items`` against one block of the benchmark.

    With ``clean`` also ``text``, without the passages found.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        stated = benchmark.value
        get, rows = stated.numbers.get, raw(batch.column(1))
        coded = []
        for text in rows:
            found = words(text)
            coded.append(np.fromiter(map(get, found, repeat(0)), np.int64, len(found)))
        counts = np.array([len(codes) for codes in coded], dtype=np.int64)
        apart = np.zeros(1, dtype=np.int64)
        codes = np.concatenate([part for codes in coded for part in (codes, apart)])
        begins = np.cumsum(counts + 1) - counts - 1
        places, windows = occurrences(codes, stated)
        docs = np.searchsorted(begins, places, side="right") - 1
        spans: list[list] = [[] for _ in rows]
        items: list[list] = [[] for _ in rows]
        order = np.argsort(docs, kind="stable")
        cuts = np.flatnonzero(np.diff(docs[order])) + 1
        for group in np.split(order, cuts) if len(order) else ():
            doc = docs[group[0]]
            hit = np.zeros(counts[doc] + 1, dtype=np.int64)
            start = places[group] - begins[doc]
            np.add.at(hit, start, 1)
            np.add.at(hit, start + stated.lengths[windows[group]], -1)
            from_, to = runs_of(np.cumsum(hit)[:-1] > 0)
            spans[doc] = np.stack([from_, to], axis=1).tolist()
            owners = set().union(*(stated.owners[w] for w in np.unique(windows[group])))
            items[doc] = sorted(str(item) for item in owners if item is not None)
        columns = [
            batch.column(0),
            pa.array(counts),
            pa.array(spans, pa.list_(pa.list_(pa.int64()))),
            pa.array(items, pa.list_(pa.string())),
        ]
        if clean:
            columns.append(_without(batch.column(1), spans))
        return columns

    schema = f"doc_id {key_type}, n_words long, spans array<array<long>>, items array<string>"
    names = ["doc_id", "n_words", "spans", "items"]
    if clean:
        schema, names = f"{schema}, text string", [*names, "text"]
    return map_batches(df, make, schema, names)


def _without(texts: pa.Array, spans: list[list]) -> pa.Array:
    """Texts without their spans; the column itself if none has any."""
    if not any(spans):
        return texts
    return pa.array(
        [without_passages(t, s) if s else t for t, s in zip(texts.to_pylist(), spans, strict=True)],
        pa.string(),
    )


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items`` for every row of ``df``.

    ``spans`` are the runs of words hit, as word numbers from 0 with the end left out, and
    ``items`` the ids of the items whose windows occur, sorted as strings. The benchmark is
    broadcast in blocks of about ``block_bytes`` of text, however large it is: each block is
    one pass over the documents, and spans and items of the passes are merged per document.

    Null texts have no words; items without words have no window; items with a null id hit
    words but are not listed. Repeated rows stay, with equal results, in documents and once in
    the benchmark. Without documents there is no row, without benchmark no hit. Only the named
    columns are used.
    """
    key_type = df.schema[id_col].dataType.simpleString()
    docs = picked(df, doc_id=id_col, text=text_col)
    items = picked(benchmark, item_id=item_col, text=item_text_col)
    shared = _blocks(items, window, block_bytes)
    first = next(shared)
    second = next(shared, None)
    if second is None:
        return _pass(docs, first, key_type).withColumn("n_hit", _hits("spans"))
    return _merged(docs, chain((first, second), shared), window, key_type)


def _blocks(items: DataFrame, window: int, block_bytes: int) -> Iterator:
    """The benchmark in blocks, each broadcast when it is asked for; one block at least.

    Repeated rows count once. Items are dealt into many small buckets, whose bytes are summed, and
    buckets in a row make a block of at most ``block_bytes``; only a longer bucket, such as one
    with a longer item, is a block of its own.
    """
    items = items.filter("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    if total <= block_bytes:
        yield _shared(items, F.lit(True), window)
        return
    items = written(items, "benchmark")
    buckets = BUCKETS_PER_BLOCK * math.ceil(total / block_bytes)
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(buckets))
    sizes = items.groupBy(bucket.alias("bucket")).agg(F.sum(F.octet_length("text").cast("long")))
    start, size = 0, 0
    for number, held in sorted(map(tuple, sizes.collect())):
        if size and size + held > block_bytes:
            yield _shared(items, (bucket >= start) & (bucket < number), window)
            start, size = number, 0
        size += held
    yield _shared(items, bucket >= start, window)


def _shared(items: DataFrame, own, window: int):
    """One block of the benchmark, broadcast."""
    rows = items.filter(own).collect()
    stated = Benchmark([(row[0], row[1].encode()) for row in rows], window)
    return items.sparkSession.sparkContext.broadcast(stated)


def _hits(spans: str) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, span: n + span[1] - span[0])


def _found(docs: DataFrame, blocks, window: int, key_type: str) -> DataFrame:
    """``key, spans, items`` of several passes, merged for each key of the documents hit."""
    found = None
    for shared in blocks:
        part = _pass(docs, shared, key_type)
        part = part.filter((F.size("spans") > 0) | (F.size("items") > 0)).distinct()
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("doc_id").agg(
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("all_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    none = F.array().cast("array<array<long>>")
    joined = F.aggregate(
        "all_spans",
        none,
        lambda spans, span: F.when(
            (F.size(spans) > 0) & (F.element_at(spans, -1)[1] >= span[0]),
            F.concat(
                F.slice(spans, 1, F.size(spans) - 1),
                F.array(
                    F.array(
                        F.element_at(spans, -1)[0],
                        F.greatest(F.element_at(spans, -1)[1], span[1]),
                    )
                ),
            ),
        ).otherwise(F.concat(spans, F.array(span))),
    )
    return merged.select(F.col("doc_id").alias("key"), joined.alias("spans"), "items")


def _merged(docs: DataFrame, blocks, window: int, key_type: str) -> DataFrame:
    """Spans and items of several passes, merged for each row of the documents."""
    spark = docs.sparkSession
    # Equal rows have one key and equal results.
    key = F.struct("doc_id", F.xxhash64("text").alias("hash"), F.length("text").alias("size"))
    kind = f"struct<doc_id:{key_type},hash:bigint,size:int>"
    keyed = docs.select(key.alias("doc_id"), "text")
    merged = _found(keyed, blocks, window, kind)
    empty = spark.sparkContext.broadcast(Benchmark([], window))
    counted = _pass(keyed, empty, kind).select(F.col("doc_id").alias("row_key"), "n_words")
    result = counted.join(merged, counted.row_key.eqNullSafe(merged.key), "left").select(
        F.col("row_key.doc_id").alias("doc_id"),
        "n_words",
        F.coalesce("spans", F.array().cast("array<array<long>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    return result.withColumn("n_hit", _hits("spans"))


def without_passages(text: str, spans: list[list[int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    data = text.encode()
    lowered = data.translate(LOWER)
    ends = [found.span() for found in WORD.finditer(lowered)]
    kept, done = [], 0
    for first, after in spans:
        kept.append(data[done : ends[first][0]])
        done = ends[after - 1][1]
    kept.append(data[done:])
    return b"".join(kept).decode()


def cleaned(
    df: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text"
) -> DataFrame:
    """``df`` with the passages of the benchmark taken out of ``text_col``.

    The words hit and what stands between them go; the rest of a text stays, and with it the
    row. Rows without a hit are untouched, null texts included. The benchmark has columns
    ``item_id, text``.
    """
    names = df.columns
    rest = F.struct(
        *(F.col(f"`{name}`") for name in names if name != text_col), F.lit(True).alias("_row")
    ).alias("rest")
    rows = df.select(rest, F.col(f"`{text_col}`").alias("text"))
    shared = _blocks(picked(benchmark, item_id="item_id", text="text"), window, BLOCK_BYTES)
    first = next(shared)
    second = next(shared, None)
    kind = rows.schema["rest"].dataType.simpleString()
    if second is None:
        cleaned = _pass(rows.select(F.col("rest").alias("doc_id"), "text"), first, kind, clean=True)
    else:
        # Spans depend on the text alone, so a text is known by two hashes and its length.
        text = F.col("text")
        key = F.struct(
            F.xxhash64(text).alias("one"),
            F.xxhash64(F.lit(1), text).alias("two"),
            F.length(text).alias("size"),
        )
        blocks, kind_of_key = chain((first, second), shared), "struct<one:bigint,two:bigint,size:int>"
        spans = _found(rows.select(key.alias("doc_id"), "text"), blocks, window, kind_of_key)
        known = rows.withColumn("own", key)
        found = known.join(spans, known.own == spans.key, "left").select("rest", "text", "spans")

        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            spans = [listed or [] for listed in batch.column(2).to_pylist()]
            return [batch.column(0), _without(batch.column(1), spans)]

        cleaned = map_batches(found, make, f"doc_id {kind}, text string", ("doc_id", "text"))
    return cleaned.select(
        *(
            F.col("text").alias(name) if name == text_col else F.col(f"doc_id.`{name}`").alias(name)
            for name in names
        )
    )
