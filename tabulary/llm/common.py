"""What the operators share: picking columns, mapping batches, written tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns of ``df``, under the names the operator works with.

    Whatever else the table holds is left behind, so no name can clash with an output.
    """
    # Workers find the package where the driver has it, unless it was shipped to them.
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return df.select(
        *(F.col(f"`{source}`").alias(name) for name, source in columns.items())
    )


def map_batches(
    df: DataFrame,
    make: Callable[[pa.RecordBatch], list[pa.Array]],
    schema: str,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """``make`` turns a batch into the columns of ``schema``; empty batches are passed over.

    ``names`` are the columns' names if the schema holds commas within a type.
    """
    names = list(names or (part.split()[0] for part in schema.split(",")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(make(batch), names=names)

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Whole texts of a batch; a null counts as an empty text."""
    return [text or "" for text in column.to_pylist()]


def raw(column: pa.Array) -> list[bytes]:
    """Whole texts as UTF-8 bytes; a null counts as empty."""
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


class Memo(dict):
    """Results of ``make`` by key; emptied at ``most`` entries.

    With ``longest`` longer keys are worked out anew each time, so that the memory is bounded
    also where a whole document is one key.
    """

    def __init__(self, make: Callable, most: int, longest: int | None = None) -> None:
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value
