"""Repeated byte strings removed from documents, found by sorting suffixes.

Only suffixes that can share 400 bytes are sorted. A cover of positions that depends on the
bytes alone is sampled: of the grams that start within any 400 bytes the one with the smallest
hash is taken, so equal strings have their sampled position at the same place. Sampled positions
are named by their gram and grouped; a name that occurs once ends there. The stretch of all
strings that belong to one sampled position is named next: where a whole stretch occurs again,
all its strings are repeated. What remains are the edges of repeats. Their stretches meet by gram
- or, if very many share one, in short pieces by nearly all their bytes - and are sorted with a difference cover of period three: triples at two of three places are
sorted, their names are sorted recursively, the remaining suffixes are merged in, and neighbours
in the order are compared over 400 bytes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.llm.common import map_batches, picked
from tabulary.session import written

LENGTH = 400
GRAM_BITS = 7
SLICE = 1 << 19
#: Bytes of stretches sorted at once.
SORTED_BYTES = 1_500_000
#: Stretches of one gram beyond which they are cut into pieces of so many starts that meet by the
#: bytes all these strings share. If as many pieces meet again, their strings are counted by
#: digests instead, as no group may outgrow a task.
HOT_GRAM = 2_000
PIECE = 16

BYTES = np.random.default_rng(9).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR = 0x9E3779B97F4A7C15
POSITION = np.uint64((1 << 20) - 1)


def gram_hashes(data: np.ndarray, bits: int) -> np.ndarray:
    """A hash of the ``2 ** bits`` bytes from each place on, by doubling their number."""
    hashed, factor = BYTES[data], FACTOR
    for step in range(bits):
        width = 1 << step
        hashed = hashed[:-width] * np.uint64(factor) + hashed[width:]
        factor = factor * factor & (1 << 64) - 1
    hashed ^= hashed >> np.uint64(32)
    hashed *= np.uint64(0xD6E8FEB86659FD93)
    hashed ^= hashed >> np.uint64(32)
    return hashed


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` keys in a row, from the left and the right of fixed blocks."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def cover(data: bytes, length: int, bits: int) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of strings by their sampled position.

    Gram hash, first start, how many starts, and how far from the first the position is.
    """
    width = length - (1 << bits) + 1
    whole = np.frombuffer(data, dtype=np.uint8)
    for begin in range(0, len(data) - length + 1, SLICE):
        part = whole[begin : begin + SLICE + length - 1]
        if len(part) < length:
            break
        hashed = gram_hashes(part, bits)
        keys = (hashed & ~POSITION) | np.arange(len(hashed), dtype=np.uint64)
        sampled = (window_minima(keys, width) & POSITION).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(sampled) != 0]))
        counts = np.diff(np.append(starts, len(sampled)))
        at = sampled[starts]
        grams = hashed[at].view(np.int64)
        columns = grams, starts + begin, counts, at - starts
        yield from zip(*(column.tolist() for column in columns), strict=True)


def suffix_order(text: np.ndarray, depth: int | None = None, reach: int = 1) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order, by a difference cover of period three.

    ``text`` holds numbers above zero. With ``depth`` suffixes that agree in so many symbols may
    stand in any order among themselves; ``reach`` is how many symbols a number stands for.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), dtype=np.int64)
    padded = np.concatenate([text, np.zeros(4, dtype=text.dtype)]).astype(np.int64)
    # With n of the form 3k+1 the empty suffix at n parts the two halves of the names.
    first = np.arange(1, n + (n % 3 == 1), 3)
    second = np.arange(2, n, 3)
    sample = np.concatenate([first, second])
    base = int(padded.max()) + 1
    if base < 1 << 21:
        names = np.unique((padded[sample] * base + padded[sample + 1]) * base + padded[sample + 2],
                          return_inverse=True)[1] + 1
    else:
        pairs = np.unique(padded[sample] * base + padded[sample + 1], return_inverse=True)[1]
        names = np.unique(pairs * base + padded[sample + 2], return_inverse=True)[1] + 1
    rank = np.zeros(n + 4, dtype=np.int64)
    enough = depth is not None and 3 * reach >= depth
    if names.max() == len(sample) or enough:
        rank[sample] = names
    else:
        order = suffix_order(names, depth, 3 * reach)
        rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[np.argsort(rank[sample], kind="stable")]
    rest = np.arange(0, n, 3)
    size = n + 5
    rest = rest[np.argsort(padded[rest] * size + rank[rest + 1], kind="stable")]
    ones = sorted_sample[(sorted_sample % 3 == 1) & (sorted_sample < n)]
    twos = sorted_sample[sorted_sample % 3 == 2]
    before_one = np.searchsorted(
        padded[ones] * size + rank[ones + 1], padded[rest] * size + rank[rest + 1]
    )
    # Three parts to compare: the first two are named together.
    named = np.unique(
        np.concatenate([padded[twos] * base + padded[twos + 1], padded[rest] * base + padded[rest + 1]]),
        return_inverse=True,
    )[1]
    before_two = np.searchsorted(
        named[: len(twos)] * size + rank[twos + 2], named[len(twos) :] * size + rank[rest + 2]
    )
    order = np.empty(n, dtype=np.int64)
    # Suffixes that agree over the depth may have met the two parts in different orders.
    places = np.maximum.accumulate(before_one + before_two) + np.arange(len(rest))
    order[places] = rest
    free = np.ones(n, dtype=bool)
    free[places] = False
    order[free] = sorted_sample[sorted_sample < n]
    return order


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``starts`` begin ``length`` bytes that begin at another of them too.

    Neighbours in the order of suffixes are compared eight bytes at a time.
    """
    wanted = np.zeros(len(text), dtype=bool)
    wanted[starts] = True
    order = suffix_order(text.astype(np.int64) + 1, length)
    order = order[wanted[order]]
    equal = np.arange(len(order) - 1)
    step = 8
    padded = np.concatenate([text, np.zeros(step, dtype=np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, step)
    done = 0
    while done < length and len(equal):
        at = min(done, length - step)
        same = (words[order[equal] + at] == words[order[equal + 1] + at]).all(axis=1)
        equal = equal[same]
        done += step
    found = np.zeros(len(text), dtype=bool)
    found[order[equal]] = True
    found[order[equal + 1]] = True
    return found[starts]


def runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans that touch or overlap as one, in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def without(data: bytes, spans: list[list[int]]) -> bytes:
    kept, done = [], 0
    for start, end in spans:
        kept.append(data[done:start])
        done = end
    return b"".join([*kept, data[done:]])


STRETCH = (
    "`row` long, doc_id {0}, gram long, stretch long, start int, n int, at int, copies int"
)
STRETCH_NAMES = ["row", "doc_id", "gram", "stretch", "start", "n", "at", "copies"]


def stretches(docs: DataFrame, kind: str, length: int, bits: int) -> DataFrame:
    """A row for every sampled position of every text of at least ``length`` bytes.

    Stretches that occur more than once in their text are repeated already: one of them goes on
    with the number of copies, and a row without a gram states where all of them are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for number, data in enumerate(batch.column(2).to_pylist()):
                if data is not None and len(data) >= length:
                    rows += _own_stretches(number, data, length, bits)
            columns = list(zip(*rows, strict=True)) or [()] * 7
            chosen = pa.array(columns[0], pa.int64())
            kinds = [pa.int64()] * 2 + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(chosen), batch.column(1).take(chosen)]
                + [pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)],
                names=STRETCH_NAMES,
            )

    return docs.mapInArrow(run, STRETCH.format(kind))


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _own_stretches(number: int, data: bytes, length: int, bits: int) -> list[tuple]:
    digest = xxhash.xxh3_64_intdigest
    first: dict[tuple[int, int], tuple] = {}
    copies: Counter = Counter()
    known: list[tuple[int, int]] = []
    for gram, start, n, at in cover(data, length, bits):
        name = gram, signed(digest(data[start : start + n + length - 1]))
        copies[name] += 1
        if name in first:
            if copies[name] == 2:
                known.append((first[name][0], first[name][0] + first[name][1]))
            known.append((start, start + n))
        else:
            first[name] = start, n, at
    rows = [(number, *name, *place, copies[name]) for name, place in first.items()]
    rows += [(number, None, None, start, end - start, 0, 0) for start, end in joined(known)]
    return rows


def decided(rows: DataFrame, *carried: str) -> DataFrame:
    """Stretches whose gram occurs again: whether they are repeated, and which to compare.

    Counts are combined before each shuffle and joined back by name, where adaptive execution
    splits a hot one, so no gram has to fit in a task.
    """
    places = ["row", "doc_id", "gram", "start", "n", "at", *carried]
    grams = rows.groupBy("gram").agg(
        F.sum("copies").alias("grams"),
        F.min("stretch").alias("least"),
        F.max("stretch").alias("most"),
    )
    # Written, so that the join alone deals the rows out and may split a hot gram.
    grams = written(grams.filter("grams > 1"), "grams")
    again = rows.join(grams, "gram").select(
        *places, "stretch", "copies", (F.col("least") == F.col("most")).alias("same")
    )
    again = written(again, "again")
    mixed = again.filter(~F.col("same"))
    names = mixed.groupBy("gram", "stretch").agg(
        F.sum("copies").alias("total"), F.min(F.struct("row", "start")).alias("one")
    )
    names = written(names, "names")
    many = names.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"))
    many = written(many.filter(F.col("kinds") > HOT_GRAM), "many")
    names = names.join(many, "gram", "left")
    known = mixed.join(names, ["gram", "stretch"]).select(
        *places,
        (F.col("total") > 1).alias("repeated"),
        (F.col("one") == F.struct("row", "start")).alias("compare"),
        F.col("kinds").isNotNull().alias("hot"),
    )
    whole = again.filter("same").select(
        *places,
        F.lit(True).alias("repeated"),
        F.lit(False).alias("compare"),
        F.lit(False).alias("hot"),
    )
    return known.unionByName(whole)


STRETCHES = (
    "array<struct<gram:bigint,start:int,n:int,at:int,own:boolean,hot:boolean,bytes:binary>>"
)
RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
RESULT_NAMES = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def result(data: bytes, spans: list[list[int]], keep: bool) -> tuple:
    kept = without(data, spans)
    removed = sum(end - start for start, end in spans)
    digest = hashlib.sha256(kept).hexdigest()
    return len(data), removed, len(spans), digest, kept if keep else None


def _results(rows: list[tuple | None]) -> list[pa.Array]:
    kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
    columns = zip(*(row or (None,) * 5 for row in rows), strict=True)
    return [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]


def opened(joined_docs: DataFrame, kind: str, length: int, keep: bool) -> DataFrame:
    """Results of documents that are decided; of others the text, and stretches to compare."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        spans_out, stretches_out, texts_out, results = [], [], [], []
        texts, lists = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for data, listed in zip(texts, lists, strict=True):
            data, listed = data or b"", listed or []
            spans = joined(
                [(s["start"], s["start"] + s["n"] + length - 1) for s in listed if s["repeated"]]
            )
            open_ = any(not s["repeated"] for s in listed)
            stretches_out.append(
                [
                    {
                        "gram": s["gram"],
                        "start": s["start"],
                        "n": s["n"],
                        "at": s["at"],
                        "own": not s["repeated"],
                        "hot": s["hot"],
                        "bytes": data[s["start"] : s["start"] + s["n"] + length - 1],
                    }
                    for s in listed
                    if s["compare"]
                ]
            )
            spans_out.append([at for span in spans for at in span] if open_ else [])
            texts_out.append(data if open_ else None)
            results.append(None if open_ else result(data, spans, keep))
        return [
            batch.column(0),
            batch.column(1),
            pa.array(texts_out, pa.binary()),
            pa.array(spans_out, pa.list_(pa.int32())),
            pa.array(stretches_out, STRETCH_TYPE),
            *_results(results),
        ]

    names = ["row", "doc_id", "text", "spans", "stretches", *RESULT_NAMES]
    schema = f"`row` long, doc_id {kind}, text binary, spans array<int>, stretches {STRETCHES}, {RESULT}"
    return map_batches(joined_docs, make, schema, names)


STRETCH_TYPE = pa.list_(
    pa.struct(
        [
            ("gram", pa.int64()),
            ("start", pa.int32()),
            ("n", pa.int32()),
            ("at", pa.int32()),
            ("own", pa.bool_()),
            ("hot", pa.bool_()),
            ("bytes", pa.binary()),
        ]
    )
)
FOUND = "`row` long, doc_id {0}, start int, `end` int"


def compared(rows: DataFrame, kind: str, length: int) -> DataFrame:
    """Spans of repeated strings among stretches that share a gram, by sorting their suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("bytes").nbytes
            if size >= SORTED_BYTES:
                table = pa.Table.from_batches(held).combine_chunks()
                grams = table.column("gram").to_numpy()
                cuts = np.flatnonzero(np.diff(grams)) + 1
                if len(cuts):
                    # Groups as many as fit at a time; the last may go on in the next batch.
                    last = int(cuts[-1])
                    yield from _compared(table.slice(0, last), cuts, length)
                    held = table.slice(last).to_batches()
                    size = sum(part.column("bytes").nbytes for part in held)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            cuts = np.flatnonzero(np.diff(table.column("gram").to_numpy())) + 1
            yield from _compared(table, cuts, length)

    return rows.mapInArrow(run, FOUND.format(kind))


def _compared(table: pa.Table, cuts: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    lengths = np.array([len(b) for b in table.column("bytes").to_pylist()])
    ends = np.cumsum(lengths)
    begin = 0
    for cut in [*[int(c) for c in cuts if c < table.num_rows], table.num_rows]:
        taken = ends[cut - 1] - (ends[begin - 1] if begin else 0)
        if taken >= SORTED_BYTES or cut == table.num_rows:
            yield _sorted(table.slice(begin, cut - begin), length)
            begin = cut


def _sorted(table: pa.Table, length: int) -> pa.RecordBatch:
    parts = table.column("bytes").to_pylist()
    text = np.frombuffer(b"".join(parts), dtype=np.uint8)
    counts = table.column("n").to_numpy().astype(np.int64)
    begins = np.cumsum([0, *map(len, parts)])[:-1]
    starts = np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    marks = repeated_starts(text, starts, length)
    offsets = np.cumsum(counts) - counts
    own = table.column("own").to_pylist()
    firsts = table.column("start").to_pylist()
    rows, from_, to = [], [], []
    for number in np.flatnonzero(own):
        part = marks[offsets[number] : offsets[number] + counts[number]]
        if part.any():
            for start, end in runs(part):
                rows.append(number)
                from_.append(firsts[number] + start)
                to.append(firsts[number] + end + length - 1)
    chosen = table.select(["row", "doc_id"]).take(pa.array(rows, pa.int64())).combine_chunks()
    columns = [
        chosen.column(name).chunk(0) if len(rows) else pa.array([], chosen.schema.field(name).type)
        for name in ("row", "doc_id")
    ]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(from_, pa.int32()), pa.array(to, pa.int32())],
        names=["row", "doc_id", "start", "end"],
    )


PIECES = (
    "`row` long, doc_id {0}, gram long, stretch long, start int, n int, at int, copies int, "
    "own boolean, bytes binary"
)


def cut_small(rows: DataFrame, kind: str, length: int) -> DataFrame:
    """Stretches cut into pieces, each named by the bytes that all strings of its place share.

    Pieces are aligned to the sampled position, so equal strings are in pieces of one name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("start", "n", "at", "bytes"))
            for number, (start, n, at, data) in enumerate(zip(*columns, strict=True)):
                begin = 0
                while begin < n:
                    block = (at - begin) // PIECE
                    end = min(n, at - block * PIECE + 1)
                    shared = at - block * PIECE
                    core = data[shared : shared + length - PIECE + 1]
                    piece = data[begin : end - 1 + length]
                    name = signed(digest(core, seed=block + (1 << 32))), signed(digest(piece))
                    out.append((number, *name, start + begin, end - begin, at - begin, 1, piece))
                    begin = end
            values = list(zip(*out, strict=True)) or [()] * 8
            chosen = pa.array(values[0], pa.int64())
            kinds = [pa.int64()] * 2 + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(chosen) for c in ("row", "doc_id")]
                + [pa.array(v, k) for v, k in zip(values[1:7], kinds, strict=True)]
                + [batch.column("own").take(chosen), pa.array(values[7], pa.binary())],
                names=[*STRETCH_NAMES, "own", "bytes"],
            )

    return rows.mapInArrow(run, PIECES.format(kind))


def compared_small(rows: DataFrame, kind: str, length: int) -> DataFrame:
    """Spans of repeated strings of grams with very many stretches, piece by piece."""
    pieces = decided(cut_small(rows, kind, length), "own", "bytes")
    pieces = written(pieces.filter("compare OR (own AND repeated)"), "pieces")
    known = pieces.filter("own AND repeated").select(
        "row", "doc_id", "start", (F.col("start") + F.col("n") + (length - 1)).alias("end")
    )
    open_ = pieces.filter("compare").withColumn("own", F.expr("own AND NOT repeated"))
    return known.unionByName(
        compared(by_gram(open_.filter("NOT hot")), kind, length)
    ).unionByName(counted(open_.filter("hot"), kind, length))


def by_gram(rows: DataFrame) -> DataFrame:
    """Groups of stretches, in as many partitions as shuffles have: few bytes are much work."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "gram").sortWithinPartitions("gram")


def counted(rows: DataFrame, kind: str, length: int) -> DataFrame:
    """Spans of repeated strings of grams with very many stretches, by counting digests.

    Counts are combined before the shuffle, so a string that fills a third of the rows is no
    burden to one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            number, start, digests = [], [], []
            for row in range(batch.num_rows):
                data = batch.column("bytes")[row].as_py()
                first = batch.column("start")[row].as_py()
                for at in range(batch.column("n")[row].as_py()):
                    number.append(row)
                    start.append(first + at)
                    digests.append(digest(data[at : at + length]))
            chosen = pa.array(number, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(name).take(chosen) for name in ("row", "doc_id", "own")]
                + [pa.array(start, pa.int32()), pa.array(digests, pa.binary())],
                names=["row", "doc_id", "own", "start", "digest"],
            )

    each = rows.mapInArrow(
        run, f"`row` long, doc_id {kind}, own boolean, start int, digest binary"
    )
    again = each.groupBy("digest").count().filter("count > 1").select("digest")
    return (
        each.filter("own")
        .join(again, "digest")
        .select("row", "doc_id", "start", (F.col("start") + length).alias("end"))
    )


def finished(rows: DataFrame, kind: str, keep: bool) -> DataFrame:
    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        results = []
        for data, flat, found in zip(*(batch.column(n).to_pylist() for n in (1, 2, 3)), strict=True):
            spans = list(zip(flat[::2], flat[1::2], strict=True))
            spans += [(span["start"], span["end"]) for span in found or ()]
            results.append(result(data, joined(spans), keep))
        return [batch.column(0), *_results(results)]

    return map_batches(rows, make, f"doc_id {kind}, {RESULT}", ["doc_id", *RESULT_NAMES])


def remove_repeats(
    df: DataFrame,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: bool = True,
    gram_bits: int = GRAM_BITS,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row of ``df``.

    Every byte is removed that a string of ``length`` bytes covers which also starts anywhere
    else, in the same document or another; strings are judged on the input, and matches never
    cross documents. ``kept`` are the remaining bytes (left null unless ``keep``): they need not
    be whole characters. Null and empty texts are empty and keep the digest of nothing. Repeated
    rows count as places of their own and stay, as do null ids; an empty table gives no row;
    extra columns are not looked at.
    """
    if length < 8 or 1 << gram_bits > length:
        raise ValueError("the strings must hold eight bytes and a gram")
    kind = df.schema[id_col].dataType.simpleString()
    docs = picked(df, doc_id=id_col, text=text_col)
    docs = docs.select(
        F.xxhash64(F.col("doc_id"), F.col("text")).alias("row"),
        "doc_id",
        F.col("text").cast("binary").alias("text"),
    )
    rows = written(stretches(docs, kind, length, gram_bits), "stretches")
    within = rows.filter("gram IS NULL").select(
        *("row", "doc_id", "gram", "start", "n", "at"),
        F.lit(True).alias("repeated"),
        F.lit(False).alias("compare"),
        F.lit(False).alias("hot"),
    )
    per_document = (
        decided(rows.filter("gram IS NOT NULL"))
        .unionByName(within)
        .groupBy(F.col("row").alias("own_row"), F.col("doc_id").alias("own_id"))
        .agg(
            F.collect_list(
                F.struct("gram", "start", "n", "at", "repeated", "compare", "hot")
            ).alias("listed")
        )
    )
    # The id beside its hash, should two hashes ever agree.
    own = (F.col("row") == F.col("own_row")) & F.col("doc_id").eqNullSafe(F.col("own_id"))
    both = docs.join(per_document, own, "left").select("row", "doc_id", "text", "listed")
    table = written(opened(both, kind, length, keep), "opened")
    pieces = table.select("row", "doc_id", F.inline("stretches"))
    found = compared(by_gram(pieces.filter("NOT hot")), kind, length)
    hot = pieces.filter("hot")
    if not hot.isEmpty():
        found = found.unionByName(compared_small(hot, kind, length))
    found = found.groupBy(F.col("row").alias("own_row"), F.col("doc_id").alias("own_id")).agg(
        F.collect_list(F.struct("start", "end")).alias("found")
    )
    open_ = table.filter(F.col("text").isNotNull()).select("row", "doc_id", "text", "spans")
    closed = table.filter(F.col("text").isNull()).select("doc_id", *RESULT_NAMES)
    rest = open_.join(found, own, "left").select("doc_id", "text", "spans", "found")
    return closed.unionByName(finished(rest, kind, keep))
