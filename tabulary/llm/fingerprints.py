"""Document fingerprints from content-defined chunks.

A gear hash rolls over the bytes; a chunk ends where the hash has enough leading zeros, more of
them before the wanted length than after it, which keeps lengths near it. Boundaries depend on
the bytes around them only, so an insertion shifts nothing but its own chunks. The fingerprint
is the set of chunk digests with their lengths, and likeness the share of the smaller text's
length in chunks of both.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.llm.common import map_batches, picked, texts

LEAST, WANTED, MOST = 32, 128, 512
#: Leading zeros asked for before and after the wanted length.
HARD, EASY = 9, 5
WINDOW_BITS = 5
SLOTS_PER_PARTITION = 4
GEAR = np.random.default_rng(64).integers(0, 1 << 32, 256, dtype=np.uint32)

Chunks = Counter  # (digest, length) -> how often


def gear(data: bytes) -> np.ndarray:
    """The hash of the last 32 bytes at each place, by doubling the window."""
    rolled = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for step in range(WINDOW_BITS):
        width = 1 << step
        grown = rolled.copy()
        grown[width:] += rolled[:-width] << np.uint32(width)
        rolled = grown
    return rolled


def chunks(data: bytes) -> Chunks:
    """Digests and lengths of the chunks of ``data``."""
    found: Chunks = Counter()
    digest = xxhash.xxh64_hexdigest
    size = len(data)
    if size <= LEAST:
        if size:
            found[digest(data), size] = 1
        return found
    rolled = gear(data)
    easy_at = np.flatnonzero(rolled < 1 << (32 - EASY))
    hard = (easy_at[rolled[easy_at] < 1 << (32 - HARD)] + 1).tolist()
    easy = (easy_at + 1).tolist()
    start = 0
    while start < size:
        at = bisect_left(hard, start + LEAST)
        if at < len(hard) and hard[at] < start + WANTED:
            end = hard[at]
        else:
            at = bisect_left(easy, start + WANTED)
            end = easy[at] if at < len(easy) else size
            end = min(end, start + MOST, size)
        found[digest(data[start:end]), end - start] += 1
        start = end
    return found


def printed(found: Chunks) -> str:
    """A fingerprint as text: digest, length and, if above one, count of each chunk, sorted."""
    return " ".join(
        f"{digest}:{length}" if count == 1 else f"{digest}:{length}*{count}"
        for (digest, length), count in sorted(found.items())
    )


def parsed(fingerprint: str) -> Chunks:
    found: Chunks = Counter()
    for part in fingerprint.split():
        chunk, _, count = part.partition("*")
        digest, _, length = chunk.partition(":")
        found[digest, int(length)] = int(count or 1)
    return found


def likeness(a: Chunks, b: Chunks) -> float:
    """Length in chunks of both over the length of the shorter; 1 for two empty texts."""
    total = min(
        sum(length * count for (_, length), count in found.items()) for found in (a, b)
    )
    if not total:
        return 1.0 if a == b else 0.0
    if len(b) < len(a):
        a, b = b, a
    shared = sum(min(n, b[chunk]) * chunk[1] for chunk, n in a.items() if chunk in b)
    return min(1.0, shared / total)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every whole text; a null text is empty and has none."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [printed(chunks(text.encode())) for text in texts(batch.column(1))]
        return [batch.column(0), pa.array(found, pa.string())]

    kind = df.schema[id_col].dataType.simpleString()
    chosen = picked(df, doc_id=id_col, text=text_col)
    return map_batches(chosen, make, f"doc_id {kind}, fingerprint string")


def slot_of(bounds: list[tuple]) -> Callable[[list, list], list[int]]:
    """Gives the slots of ids and hashes; ``bounds`` are the largest key of each slot, largest first.

    Keys without an id are smaller than all others.
    """
    named = sorted((own, tie) for own, tie in bounds if own is not None)
    nameless = sorted(tie for own, tie in bounds if own is None)
    last = len(named) - 1

    def slots(ids: list, ties: list) -> list[int]:
        found = []
        for own, tie in zip(ids, ties, strict=True):
            if own is not None:
                found.append(last - bisect_left(named, (own, tie)))
            else:
                place = bisect_left(nameless, tie)
                # Smaller than every bound with an id, larger than those without: in between.
                found.append(last + len(nameless) - place)
        return found

    return slots


def in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows in slots, sorted within each, every slot ended by the row that follows it.

    ``docs`` has ``doc_id, text``. Slots are ranges of id and hash of the text, larger ids first,
    so rows that share an id, or have none, lie in several slots as others do. A range sort of
    the narrow keys gives the bounds. The first row of each slot is also sent to the slot before,
    marked ``borrowed``; that of the first slot goes to the last. So whole texts are shuffled once.
    """
    spark = docs.sparkSession
    wanted = SLOTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    key = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "tie")
    firsts = (
        rows.select("doc_id", "tie")
        .repartitionByRange(wanted, *order)
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.max(key).alias("row"))
        .select("row.*")
        .orderBy(*order)
        .collect()  # one row for each slot
    )
    bounds = [(row["doc_id"], row["tie"]) for row in firsts]
    count = len(bounds)
    find = slot_of(bounds)
    borrowers = [((n - 1) % count, own, tie, n) for n, (own, tie) in enumerate(bounds)]

    @F.arrow_udf("int")
    def place(ids: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array(find(ids.to_pylist(), ties.to_pylist()), pa.int32())

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = rows.withColumn("slot", place("doc_id", "tie"))
    lent = spark.createDataFrame(
        borrowers, f"borrower int, first_id {kind}, first_tie long, first_slot int"
    )
    # One row per slot, and slots are a fixed multiple of the partitions.
    match = (
        (F.col("slot") == F.col("first_slot"))
        & F.col("doc_id").eqNullSafe(F.col("first_id"))
        & (F.col("tie") == F.col("first_tie"))
    )
    own = F.array(F.struct(F.col("slot").alias("slot"), F.lit(False).alias("borrowed")))
    slots = F.when(
        F.col("borrower").isNotNull(),
        F.concat(
            own, F.array(F.struct(F.col("borrower").alias("slot"), F.lit(True).alias("borrowed")))
        ),
    ).otherwise(own)
    dealt = placed.join(F.broadcast(lent), match, "left").select(
        "doc_id", "text", "tie", F.inline(slots)
    )
    ordered = dealt.repartition("slot").sortWithinPartitions("slot", "borrowed", *order)
    return ordered.select("doc_id", "text", "slot", "borrowed"), count


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


COLUMNS = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edit_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited texts, and how alike they and the next are.

    The next row is the one with the next smaller id, after the last the first; rows of equal
    ids follow each other by a hash of their text, rows without an id come last. A null text is
    empty; two empty texts are alike, an empty one is unlike any other. A single row is its own
    next. Repeated rows stay; an empty table gives no row; extra columns are not looked at.
    """
    docs = picked(df, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kind = df.schema[id_col].dataType.simpleString()
    ordered, _ = in_order(docs)
    names = ["doc_id", *(part.split()[0] for part in COLUMNS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None
        for batch in batches:
            rows: list[list] = []
            columns = [batch.column(n).to_pylist() for n in range(4)]
            for doc_id, text, slot, borrowed in zip(*columns, strict=True):
                found = chunks(text.encode())
                if pending is not None and pending[0] == slot:
                    rows.append(_row(*pending[1:], text, found))
                    pending = None
                if not borrowed:
                    pending = slot, doc_id, text, found
            if rows:
                values = list(zip(*rows, strict=True))
                kinds = [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 3]
                kinds += [pa.float64()] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names
                )

    return ordered.mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


def _row(doc_id, text: str, found: Chunks, following: str, following_found: Chunks) -> list:
    edited = edited_text(text, following).encode()
    edited_found = chunks(edited)
    return [
        doc_id,
        len(text),
        hashlib.sha256(edited).hexdigest(),
        printed(found),
        printed(edited_found),
        likeness(found, edited_found),
        likeness(found, following_found),
    ]
