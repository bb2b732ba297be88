"""Near-duplicates by 64-bit SimHash and a self-join over binary tries.

Two fingerprints with at most two differing bits agree in at least one of three blocks of bits.
The fingerprints are therefore rotated so that each block comes first once, and those that share
the block are joined by descending a binary trie of the rest: pairs of nodes are taken together,
a bit of difference is charged to the error budget, and a pair beyond the budget is pruned with
everything below it. Blocks that many fingerprints share are dealt out as pairs of salts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.llm.common import map_batches, picked, raw
from tabulary.llm.components import components
from tabulary.session import written

WORDS = 3
BUDGET = 2
SEED = 42
#: Bits of the blocks; by the pigeonhole rule one more than the budget.
BLOCKS = (22, 21, 21)
FIRST_BIT = min(BLOCKS)
HOT_BLOCK = 1024
ROWS_AT_ONCE = 100_000
PAIRS_AT_ONCE = 400_000


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of shingles of words; 0 without words."""
    found = text.lower().split()
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum([len(word) + 1 for word in found])
        starts = [0, *ends[:-words].tolist()]
        cuts = zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)
        hashes = [digest(joined[start:end], SEED) for start, end in cuts]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8)).reshape(-1, 64)
    kept = bits.sum(axis=0, dtype=np.int32) * 2 > len(hashes)
    return int(np.packbits(kept).view(">i8")[0])


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS
) -> DataFrame:
    """``doc_id, bits``: the fingerprint of every whole text as a signed 64-bit number.

    A null text is empty and has fingerprint zero. Repeated rows and null ids stay.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [fingerprint(text, words) for text in raw(batch.column(1))]
        return [batch.column(0), pa.array(found, pa.int64())]

    kind = df.schema[id_col].dataType.simpleString()
    chosen = picked(df, doc_id=id_col, text=text_col)
    return map_batches(chosen, make, f"doc_id {kind}, bits long", ("doc_id", "bits"))


def trie_join(group: np.ndarray, bits: np.ndarray, first_bit: int, budget: int) -> np.ndarray:
    """Links between numbers of one group that differ in at most ``budget`` bits.

    ``bits`` are distinct unsigned numbers sorted within their groups and equal up to
    ``first_bit``. A node is a range of them; its children are cut by the next bit. The links
    are thinned to a forest whenever many have gathered, which keeps who is connected.
    """
    edges = np.flatnonzero(np.diff(group)) + 1
    low, high = np.concatenate([[0], edges]), np.concatenate([edges, [len(bits)]])
    many = high - low > 1
    low, high = low[many], high[many]
    zeros = {}
    stack = [(first_bit, np.stack([low, high, low, high, np.zeros_like(low)]))]
    links, gathered = [], 0
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > PAIRS_AT_ONCE:
            middle = pairs.shape[1] // 2
            stack += [(depth, pairs[:, :middle]), (depth, pairs[:, middle:])]
            continue
        a, a_end, b, b_end, spent = pairs
        single = (a_end - a == 1) & (b_end - b == 1) & (a != b)
        if single.any():
            left, right = a[single], b[single]
            near = np.bitwise_count(bits[left] ^ bits[right]) <= budget
            links.append(np.stack([left[near], right[near]]))
            gathered += int(near.sum())
            if gathered > 2 * PAIRS_AT_ONCE:
                links = [forest(np.concatenate(links, axis=1), len(bits))]
                gathered = links[0].shape[1]
        a, a_end, b, b_end, spent = pairs[:, ~single]
        if not len(a) or depth == 64:
            continue
        if depth not in zeros:
            zero = (bits >> np.uint64(63 - depth)) & np.uint64(1) == 0
            zeros[depth] = np.concatenate([[0], np.cumsum(zero)])
        count = zeros[depth]
        a_cut, b_cut = a + count[a_end] - count[a], b + count[b_end] - count[b]
        own = a == b
        children = [
            np.stack([a, a_cut, b, b_cut, spent]),
            np.stack([a_cut, a_end, b_cut, b_end, spent]),
            np.stack([a, a_cut, b_cut, b_end, spent + 1]),
            np.stack([a_cut, a_end, b, b_cut, spent + 1])[:, ~own],
        ]
        following = np.concatenate(children, axis=1)
        a, a_end, b, b_end, spent = following
        kept = (a_end > a) & (b_end > b) & (spent <= budget) & ((a != b) | (a_end - a > 1))
        if kept.any():
            stack.append((depth + 1, following[:, kept]))
    return np.concatenate(links, axis=1) if links else np.zeros((2, 0), dtype=np.int64)


def forest(links: np.ndarray, n: int) -> np.ndarray:
    """One link from each node to the smallest of its component."""
    label = np.arange(n)
    left, right = links
    while True:
        least = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], least)
        np.minimum.at(label, label[right], least)
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        label = label[label]
        if (label == before).all():
            break
    child = np.flatnonzero(label != np.arange(n))
    return np.stack([child, label[child]])


def _rotated(bits: str, by: int) -> F.Column:
    if not by:
        return F.col(bits)
    left, right = F.shiftleft(bits, by), F.shiftrightunsigned(bits, 64 - by)
    return left.bitwiseOR(right)


def links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``a, b``: links that connect all fingerprints ``bits`` within the budget of each other.

    Every two fingerprints within the budget are connected through the links; between those
    of a dense group only a forest of links is kept.
    """
    if budget != len(BLOCKS) - 1:
        raise ValueError(f"the blocks allow for {len(BLOCKS) - 1} differing bits")
    turns, turned = [], 0
    for number, size in enumerate(BLOCKS):
        rotated = _rotated("bits", turned)
        turns.append(
            F.struct(
                F.lit(number).alias("block"),
                F.shiftrightunsigned(rotated, 64 - size).alias("value"),
                rotated.alias("rotated"),
            )
        )
        turned += size
    rows = distinct.select(F.inline(F.array(*turns)))
    # A hot block gets more salts the more rows it has, half as fast as its rows grow.
    sizes = rows.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n"))
    salted = sizes.filter(F.col("n") > 1).select(
        "block",
        "value",
        F.when(F.col("n") > HOT_BLOCK, F.ceil(F.sqrt("n") / 16)).otherwise(1).cast("int").alias("salts"),
    )
    own = F.pmod(F.xxhash64("rotated"), F.col("salts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("other")
    dealt = (
        rows.join(salted, ["block", "value"])
        .select("block", "value", "rotated", own.alias("own"), other)
        .select(
            "block",
            "value",
            F.least("own", "other").alias("one"),
            F.greatest("own", "other").alias("two"),
            "rotated",
        )
    )
    key = ["block", "value", "one", "two"]
    sorted_ = dealt.repartition(*key).sortWithinPartitions(*key, "rotated")
    return sorted_.mapInArrow(_joined, "a long, b long")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins whole groups as they arrive; keeps an unfinished group for the next batch."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns]))
            size += batch.num_rows
        if size >= ROWS_AT_ONCE:
            rows = np.concatenate(held, axis=1)
            cut = int(np.flatnonzero((rows[:4] != rows[:4, -1:]).any(axis=0))[-1:].sum() + 1)
            if (rows[:4, 0] != rows[:4, -1]).any():
                yield _links_of(rows[:, :cut])
                held, size = [rows[:, cut:]], rows.shape[1] - cut
            else:
                held = [rows]
    if size:
        yield _links_of(np.concatenate(held, axis=1))


def _links_of(rows: np.ndarray) -> pa.RecordBatch:
    bits = rows[4].view(np.uint64) if rows[4].flags.c_contiguous else rows[4].astype(np.uint64)
    change = np.concatenate([[False], (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)])
    found = trie_join(np.cumsum(change), bits, FIRST_BIT, BUDGET)
    found = forest(found, len(bits)) if found.shape[1] > len(bits) else found
    back = np.cumsum([0, *BLOCKS])[rows[0]].astype(np.uint64)
    original = (bits >> back) | (bits << ((np.uint64(64) - back) & np.uint64(63)))
    original = np.where(back == 0, bits, original).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(original[found[0]]), pa.array(original[found[1]])], names=["a", "b"]
    )


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    budget: int = BUDGET,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``df``.

    The fingerprint is 16 hex digits; rows with fingerprints of at most two differing bits are
    linked, and ``component_id`` is the smallest id reachable. Equal fingerprints meet as one,
    so copies are never paired with each other. Null and empty texts have fingerprint zero and
    are linked like any other; rows with a null id stay and never name a component unless all
    its ids are null. Repeated rows stay, an empty table gives no row, extra columns are not
    looked at.
    """
    rows = written(fingerprints(df, id_col, text_col, words), "fingerprints")
    distinct = rows.groupBy("bits").agg(F.min("doc_id").alias("least_id"))
    distinct = written(distinct, "distinct")
    linked = components(links(distinct, budget))
    linked = linked.select(F.col("node").alias("bits"), "component")
    named = distinct.join(linked, "bits", "left").withColumn(
        "component", F.coalesce("component", "bits")
    )
    named = written(named, "named")
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = named.join(least, "component").select("bits", "component_id")
    return rows.join(known, "bits").select(
        "doc_id",
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def representatives(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    budget: int = BUDGET,
) -> DataFrame:
    """``df`` with one row of each group of near-duplicates: the one with the smallest id.

    Rows without an id come after all others and then go by a hash of their text; of rows that
    are alike in both one stays. All columns are kept.
    """
    own = F.col(f"`{id_col}`")
    key = F.struct(
        own.isNull().alias("none"),
        own.alias("id"),
        F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("hash"),
    )
    named = df.select(key.alias("key"), F.col(f"`{text_col}`").alias("text"))
    groups = near_duplicates(named, "key", "text", words, budget)
    kept = groups.select(F.col("component_id").alias("kept")).distinct()
    names = df.columns
    whole = df.select(
        F.struct(*(F.col(f"`{name}`") for name in names)).alias("whole"), key.alias("key")
    )
    # Structs are equal also where a field of both is null; the join deals rows out by their key,
    # so repeated rows meet without another shuffle.
    one = whole.join(kept, F.col("key") == F.col("kept"), "left_semi").dropDuplicates(["key"])
    return one.select(*(F.col(f"whole.`{name}`").alias(name) for name in names))
