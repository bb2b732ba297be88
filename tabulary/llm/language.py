"""Language identification with hyperdimensional profiles.

Each letter has a random vector of -1 and 1. A run of three letters is bound into one vector by
multiplying the vectors of its letters, the first permuted twice and the second once. A text is
bundled as the sum of its run vectors, a language as the sum of its texts; the language whose
prototype has the largest cosine with a text is predicted. As sums are linear, texts are
counted first and multiplied with the vectors of the distinct runs of a batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.llm.common import map_batches, picked, texts

WIDTH = 1024
SYMBOLS = 128
SEED = 20
CELLS = 1_500_000
#: Distinct runs whose vectors are held at once, whatever the number in a text.
RUNS_AT_ONCE = 8192
UNKNOWN = "und"


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """A symbol for each code point: 0 for what isn't a letter, a-z first, others by residue."""
    table = np.zeros(0x110000, dtype=np.uint8)
    letters = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]
    codes = np.array(letters)
    table[codes] = 27 + codes % (SYMBOLS - 27)
    table[97:123] = np.arange(1, 27)
    return table


@lru_cache(maxsize=1)
def letter_vectors(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice(
        np.array([-1, 1], dtype=np.float32), size=(SYMBOLS, width)
    )


def run_vectors(runs: np.ndarray, width: int) -> np.ndarray:
    """Bound vectors of runs of three symbols."""
    letters = letter_vectors(width)
    first, second, third = runs // SYMBOLS**2, runs // SYMBOLS % SYMBOLS, runs % SYMBOLS
    vectors = np.roll(letters, 2, axis=1)[first]
    vectors *= np.roll(letters, 1, axis=1)[second]
    vectors *= letters[third]
    return vectors


def runs_of(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and runs of three symbols around each letter of each row."""
    joined = "\n" + "\n".join(rows) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.array([len(row) + 1 for row in rows])
    line = symbols()[points].astype(np.int32)
    middle = np.flatnonzero(line)
    runs = (line[middle - 1] * SYMBOLS + line[middle]) * SYMBOLS + line[middle + 1]
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    return owner[middle - 1], runs


def profiles(rows: list[str], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bundled vectors of rows, a block of rows at a time, with the first row's number.

    Rows are in lower case. A row without letters has a vector of zeros.
    """
    first = 0
    while first < len(rows):
        size, after = 0, first
        while after < len(rows) and (after == first or size + len(rows[after]) <= CELLS):
            size += len(rows[after])
            after += 1
        owner, runs = runs_of(rows[first:after])
        present = np.zeros(SYMBOLS**3, dtype=bool)
        present[runs] = True
        distinct = np.flatnonzero(present)
        numbers = np.zeros(SYMBOLS**3, dtype=np.int32)
        numbers[distinct] = np.arange(len(distinct), dtype=np.int32)
        bundled = np.zeros((after - first, width), dtype=np.float32)
        for block in range(0, len(distinct), RUNS_AT_ONCE):
            part = distinct[block : block + RUNS_AT_ONCE]
            vectors = run_vectors(part, width)
            place = numbers[runs] - block
            held = (place >= 0) & (place < len(part))
            places, owners = place[held], owner[held]
            step = max(1, CELLS // len(part))
            for low in range(0, after - first, step):
                high = min(low + step, after - first)
                begin, end = np.searchsorted(owners, [low, high])
                cells = (owners[begin:end].astype(np.int64) - low) * len(part)
                counts = np.bincount(cells + places[begin:end], minlength=(high - low) * len(part))
                counts = counts.astype(np.float32).reshape(high - low, len(part))
                bundled[low:high] += counts @ vectors
        yield first, bundled
        first = after


def lowered(column: pa.Array) -> list[str]:
    """Texts in lower case; a dotted capital I becomes two characters."""
    return [text.lower() for text in texts(column)]


def learn(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", width: int = WIDTH
) -> dict[str, np.ndarray]:
    """A prototype for each language of the labelled rows.

    Every row counts; those with a null text or language teach nothing. Tasks send one sum per
    language; what reaches the driver is ``width`` numbers for each language.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            languages = np.array(batch.column(1).to_pylist(), dtype=object)
            rows = lowered(batch.column(0))
            for first, vectors in bundled_by(languages, rows, width):
                sums[first] = sums.get(first, 0) + vectors
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums), pa.string()),
                pa.array([total.tolist() for total in sums.values()], pa.list_(pa.float64())),
            ],
            names=["language", "total"],
        )

    labelled = picked(df, text=text_col, language=lang_col).dropna()
    cells = labelled.mapInArrow(add, "language string, total array<double>").select(
        "language", F.posexplode("total").alias("place", "value")
    )
    learned: dict[str, np.ndarray] = {}
    # Sums of whole numbers are exact, so their order doesn't matter.
    for row in cells.groupBy("language", "place").agg(F.sum("value").alias("value")).collect():
        learned.setdefault(row["language"], np.zeros(width))[row["place"]] = row["value"]
    return learned


def bundled_by(
    languages: np.ndarray, rows: list[str], width: int
) -> Iterator[tuple[str, np.ndarray]]:
    """Sums of the run vectors of all texts of each language in a batch."""
    for language in sorted(set(languages)):
        chosen = [row for row, own in zip(rows, languages, strict=True) if own == language]
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for start in range(0, len(chosen), 256):
            total += np.bincount(runs_of(chosen[start : start + 256])[1], minlength=SYMBOLS**3)
        distinct, bundled = np.flatnonzero(total), np.zeros(width)
        for start in range(0, len(distinct), 1024):
            part = distinct[start : start + 1024]
            bundled += total[part].astype(np.float64) @ run_vectors(part, width).astype(np.float64)
        yield language, bundled


def identify(
    df: DataFrame,
    learned: dict[str, np.ndarray],
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    with_text: bool = False,
) -> DataFrame:
    """``doc_id, lang_pred, score`` of whole texts; the score is the cosine, 0 at least.

    Texts that are null or have no letter are ``und`` with score 0, as are all if nothing was
    learned. Of equal cosines the language first in the alphabet wins. Repeated rows and null
    ids stay; an empty table gives no row. Only the two named columns are used; ``with_text``
    gives the texts back too.
    """
    names = sorted(learned)
    norms = [np.linalg.norm(learned[name]) or 1.0 for name in names]
    shared = df.sparkSession.sparkContext.broadcast(
        (names, np.array([learned[n] / m for n, m in zip(names, norms, strict=True)]))
    )

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        known, prototypes = shared.value
        predicted = np.full(batch.num_rows, UNKNOWN, dtype=object)
        scores = np.zeros(batch.num_rows)
        for first, vectors in profiles(lowered(batch.column(1)), width) if known else ():
            lengths = np.linalg.norm(vectors, axis=1)
            cosine = (vectors @ prototypes.T.astype(np.float32)).astype(np.float64)
            cosine /= np.maximum(lengths, 1e-9)[:, None]
            best = cosine.argmax(axis=1)
            some = np.flatnonzero(lengths > 0)
            predicted[first + some] = np.array(known, dtype=object)[best[some]]
            scores[first + some] = np.clip(cosine[some, best[some]], 0.0, 1.0)
        found = [batch.column(0), pa.array(predicted, pa.string()), pa.array(scores)]
        return [*found, batch.column(1)] if with_text else found

    kind = df.schema[id_col].dataType.simpleString()
    chosen = picked(df, doc_id=id_col, text=text_col)
    schema, names = f"doc_id {kind}, lang_pred string, score double", ["doc_id", "lang_pred", "score"]
    if with_text:
        schema, names = f"{schema}, text string", [*names, "text"]
    return map_batches(chosen, make, schema, names)
