"""Text expressions: words, masking, keyword overlap, row sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.functions.columns import cell_text

# Words that are never counted as common.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "is", "are", "was", "were", "be", "been", "being",
)

# Masks of the embedding text and what each one replaces, in order.
MASKS = (
    (r"\b(nan|null|none|n/a)\b", "[MISSING]"),
    (r"\b\d+\.\d+\b", "[NUMBER]"),
    (r"\b\d+\b", "[INTEGER]"),
)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Unicode words of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1)


def tokens(text: Column) -> Column:
    """Lower-cased parts between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda part: part != "")


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the distinct tokens; none for a null text."""
    return F.array_distinct(F.transform(tokens(F.coalesce(text, F.lit(""))), lambda word: F.xxhash64(word)))


def overlap(left: Column, right: Column) -> Column:
    """Jaccard overlap of two lists of distinct values; 0 when both are empty."""
    shared = F.size(F.array_intersect(left, right))
    either = F.size(left) + F.size(right) - shared
    return F.when(either > 0, shared / either).otherwise(F.lit(0.0))


def keyword_score(query: Column, document: Column) -> Column:
    """Jaccard overlap of the two token sets; 0 when both are empty."""
    return overlap(F.array_distinct(tokens(query)), F.array_distinct(tokens(document)))


def preprocess_text(text: Column) -> Column:
    """One-line text with missing markers and numbers masked."""
    masked = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    for pattern, mask in MASKS:
        masked = F.regexp_replace(masked, "(?i)" + pattern, mask)
    return F.trim(masked)


def row_to_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """``col is value. col is value`` over the cells that are not missing."""
    wanted = set(columns or df.columns)
    parts = [
        F.concat(F.lit(f"{field.name} is "), cell_text(field))
        for field in df.schema.fields
        if field.name in wanted
    ]
    return F.concat_ws(". ", *parts)


def labelled_cells(df: DataFrame, columns: Sequence[str], joiner: str) -> Column:
    """`` col<joiner>value;`` over the cells that are neither missing nor blank."""
    wanted = set(columns)
    cells = []
    for field in df.schema.fields:
        if field.name in wanted:
            value = cell_text(field)
            cell = F.concat(F.lit(f" {field.name}{joiner}"), value, F.lit(";"))
            cells.append(F.when(F.length(strip(value)) > 0, cell))
    return F.concat_ws("", *cells)
