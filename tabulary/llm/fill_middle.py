"""Fill-in-the-middle texts made by rotating blocks of bytes in place, and undone the same way.

A text is cut into prefix, middle and suffix between two of its tokens. A sentinel is inserted
before each part, and two neighbouring blocks change places by three reversals: each block is
reversed, then both together. The inverse rotation and the removal of the sentinels give the
text back byte for byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.llm.common import map_batches, picked, raw, texts

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of a hundred texts so many are cut, and of those so many get the suffix first.
CUT_SHARE = 90
SPM_SHARE = 20
SEED = 1
#: Bytes reversed at once.
BLOCK = 1 << 16


def unit_starts(data: bytes) -> np.ndarray:
    """Byte offsets at which tokens start: runs of ASCII letters, any other character alone."""
    found = np.frombuffer(data, dtype=np.uint8)
    letter = (found | 0x20) - np.uint8(97) < 26
    starts = (found & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(starts)


def characters(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return int(((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80).sum())


def reverse(data: np.ndarray, start: int, end: int) -> None:
    """Reverses ``data[start:end]`` where it is, from both ends towards the middle."""
    while end - start > 1:
        step = min(BLOCK, (end - start) // 2)
        left = data[start : start + step].copy()
        data[start : start + step] = data[end - step : end][::-1]
        data[end - step : end] = left[::-1]
        start, end = start + step, end - step


def rotate(data: bytearray, start: int, middle: int, end: int) -> None:
    """Exchanges the blocks ``start:middle`` and ``middle:end`` by three reversals."""
    view = np.frombuffer(data, dtype=np.uint8)
    reverse(view, start, middle)
    reverse(view, middle, end)
    reverse(view, start, end)


def drawn(name: str, seed: int) -> list[int]:
    """Four numbers below 2**32 that depend on the id alone."""
    digits = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return [int(digits[n : n + 8], 16) for n in range(0, 32, 8)]


def transform(
    data: bytes, name: str, seed: int = SEED, cut_share: int = CUT_SHARE, spm_share: int = SPM_SHARE
) -> tuple[int, str, int | None, int | None, bytes]:
    """Tokens, form, characters of prefix and middle, and the output of one text."""
    starts = unit_starts(data)
    n = len(starts)
    one, two, chance, order = drawn(name, seed)
    if not data or chance % 100 >= cut_share or any(mark in data for mark in SENTINELS):
        return n, PLAIN, None, None, data
    cuts = np.append(starts, len(data))
    first, second = sorted((int(cuts[one % (n + 1)]), int(cuts[two % (n + 1)])))
    prefix_chars, middle_chars = characters(data[:first]), characters(data[first:second])
    output = bytearray(data)
    for place, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        output[place:place] = mark
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    form = SPM if order % 100 < spm_share else PSM
    rotate(output, 0 if form == SPM else middle, suffix, len(output))
    return n, form, prefix_chars, middle_chars, bytes(output)


def restore(output: bytes, form: str) -> bytes:
    """The text of which ``transform`` made ``output``."""
    if form == PLAIN:
        return output
    data = bytearray(output)
    # No sentinel was in the text, and none can arise across the edge of another.
    suffix, rest = data.find(SUFFIX), data.find(PREFIX if form == SPM else MIDDLE)
    rotate(data, suffix, rest, len(data))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        place = data.rfind(mark)
        del data[place : place + len(mark)]
    return bytes(data)


def fill_in_middle(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    cut_share: int = CUT_SHARE,
    spm_share: int = SPM_SHARE,
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``df``.

    ``n`` counts tokens, ``form`` is plain, psm (prefix, suffix, middle) or spm (suffix first).
    A null text is empty, and an empty text or one that holds a sentinel stays plain. Cuts
    depend on id, seed and number of tokens only, so repeated rows give equal rows; a null id
    is drawn as the empty name. Two cuts at one place leave the middle empty. Texts of any
    length are cut whole, an empty table gives no row, extra columns are not looked at.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        names = texts(batch.column(1))
        rows = [
            transform(data, name, seed, cut_share, spm_share)
            for data, name in zip(raw(batch.column(2)), names, strict=True)
        ]
        n, form, prefix, middle, output = zip(*rows, strict=True)
        return [
            batch.column(0),
            pa.array(n, pa.int64()),
            pa.array(form, pa.string()),
            pa.array(prefix, pa.int64()),
            pa.array(middle, pa.int64()),
            pa.array(output, pa.binary()).cast(pa.string()),
        ]

    kind = df.schema[id_col].dataType.simpleString()
    chosen = picked(df, doc_id=id_col, text=text_col).select(
        "doc_id", F.col("doc_id").cast("string").alias("name"), "text"
    )
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    schema = (
        f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )
    return map_batches(chosen, make, schema, names)


def restored(df: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``df`` with the texts behind its outputs in ``restored``, which it must not hold yet.

    A null output gives an empty text. All other columns pass unchanged.
    """
    names = df.columns
    output, form = names.index(output_col), names.index(form_col)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        forms = batch.column(form).to_pylist()
        back = map(restore, raw(batch.column(output)), forms)
        return [*batch.columns, pa.array(list(back), pa.binary()).cast(pa.string())]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    whole = picked(df, **{name: name for name in names})
    return map_batches(whole, make, f"{schema}, restored string", [*names, "restored"])
