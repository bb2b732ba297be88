"""Small tables that every operator must take."""

from __future__ import annotations

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\t ",
    "word",
    "Straße, Ñandú; naïve – 日本語 🎉",
    "a" * 5000,
    "the same words " * 400,
    "tie",
    "tie",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bits long, found int"


def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, a repeated row, clashing names."""
    rows = [(n, text, "en", "src", len(text or ""), 7, 8) for n, text in enumerate(ODD_TEXTS)]
    rows.append(rows[4])
    rows.append((None, "no id", None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *columns):
    return [tuple(row[name] for name in columns or df.columns) for row in df.collect()]
