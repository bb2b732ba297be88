"""Words of whole batches of texts, cut out with NumPy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Characters of text that are cut into words at once; a longer word is not parted.
PIECE = 1 << 20


@cache
def letters(pattern: str) -> np.ndarray:
    """Which code points a pattern of one class of characters, repeated, takes."""
    taken = np.zeros(0x110000, dtype=bool)
    for run in re.finditer(pattern, "".join(map(chr, range(0x110000)))):
        taken[run.start() : run.end()] = True
    return taken


def parts(texts: list[str | None], gap: re.Pattern) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers of texts and their parts, about ``PIECE`` characters a time; long texts are cut at gaps."""
    numbers, held, size = [], [], 0
    for number, text in enumerate(texts):
        start, length = 0, len(text or "")
        while start < length:
            found = gap.search(text, start + PIECE) if length - start > PIECE else None
            end = found.start() if found else length
            numbers.append(number)
            held.append(text[start:end])
            size += end - start
            start = end
            if size >= PIECE:
                yield numbers, held
                numbers, held, size = [], [], 0
    if held:
        yield numbers, held


def starts(inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and in which text: ``edges`` are the starts of the texts, none of them empty."""
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    fresh[edges] = inside[edges]
    found = np.flatnonzero(fresh)
    return found, np.searchsorted(edges, found, side="right") - 1


def distinct(lengths: np.ndarray, letters: bytes | np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word among the different ones, and those, from all words one after another."""
    ends = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=ends[1:])
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(letters)]
    found = pa.Array.from_buffers(pa.binary(), len(lengths), buffers).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_pylist()


def of_texts(texts: list[str], pattern: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """For every word that ``pattern`` takes the number of its text and its own, and the different words in UTF-8."""
    sizes = np.array([len(text) for text in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    inside = letters(pattern)[codes]
    found, rows = starts(inside, np.cumsum(sizes) - sizes)
    kept = codes[inside]
    if not len(kept):
        return rows, rows, []
    widths = 1 + (kept >= 0x80).astype(np.int32) + (kept >= 0x800) + (kept >= 0x10000)
    own = (np.cumsum(inside, dtype=np.int32) - 1)[found]
    numbers, words = distinct(np.add.reduceat(widths, own), kept.tobytes().decode("utf-32-le").encode())
    return rows, numbers, words
