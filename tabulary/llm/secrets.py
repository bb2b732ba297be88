"""Secrets in whole texts, with DataFrame expressions only.

Three plain kinds are regular expressions. Beside them, long strings that mix letters and digits
go through a battery of tests of randomness in the alphabet of their inferred encoding: a
chi-squared test that its symbols are equally frequent, a runs test about its middle and a test
of serial correlation. The three p-values combine by Fisher's rule. Within each class of lengths
the procedure of Benjamini and Hochberg then decides which strings are not random; its false
discoveries, random strings taken for text, are kept to a stated share. The rest are secrets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.llm.common import picked
from tabulary.session import written

KINDS = ("assign", "access", "hex", "random")

# Patterns of the plain kinds, and the least length of what a match must hold.
ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGNED_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Strings to test: both letters and digits, with nothing of their alphabet before them.
LEAST = 20
SYMBOLS = "A-Za-z0-9+/_=-"
CANDIDATE = (
    rf"(?<![{SYMBOLS}])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[{SYMBOLS}]{{{LEAST},}}"
)
#: Encodings from the narrowest alphabet to the widest, by a pattern of the whole string.
ENCODINGS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("^[0-9A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_+/="),
)
#: The share of random strings among those taken for text.
FALSE_SHARE = 0.05
#: p-values are counted in tenths of decades, the last for all below.
BINS = 400


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``start, end, body`` of the matches of ``pattern``, leftmost and apart.

    The text between matches and the matches themselves give the offsets in code points.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    # split() leaves a last part after the last match, which has no partner.
    steps = F.filter(F.arrays_zip(between.alias("gap"), whole.alias("hit"), bodies.alias("body")),
                     lambda step: step["hit"].isNotNull())
    kind = "struct<start:int,end:int,body:string>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("found"))

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + F.length(step["gap"])
        end = start + F.length(step["hit"])
        found = F.struct(start.alias("start"), end.alias("end"), step["body"].alias("body"))
        return F.struct(
            end.alias("at"), F.concat(state["found"], F.array(found)).alias("found")
        )

    found = F.aggregate(steps, begin, add, lambda state: state["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{kind}>"))


def _tail(z: Column) -> Column:
    """The upper tail of the normal distribution, to seven digits (Abramowitz and Stegun 26.2.17)."""
    size = F.abs(z)
    t = 1 / (1 + 0.2316419 * size)
    polynomial = t * (
        0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))
    )
    upper = F.exp(-size * size / 2) * 0.3989422804014327 * polynomial
    return F.greatest(F.when(z >= 0, upper).otherwise(1 - upper), F.lit(1e-300))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, value: total + value)


def _coded(c: Column) -> Column:
    """The string's symbols as numbers in the alphabet of its encoding."""
    body = F.regexp_replace(c["body"], "=+$", "")
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(body.rlike(pattern), letters).otherwise(alphabet)
    return F.struct(
        c["start"].alias("start"),
        c["end"].alias("end"),
        F.filter(F.split(body, ""), lambda letter: letter != "").alias("letters"),
        alphabet.alias("alphabet"),
    )


def _measured(c: Column) -> Column:
    values = F.transform(
        c["letters"], lambda letter: F.position(letter, c["alphabet"]).cast("double") - 1
    )
    repeats = F.transform(
        F.array_distinct(c["letters"]),
        lambda own: F.pow(F.size(F.filter(c["letters"], lambda x: x == own)), F.lit(2.0)),
    )
    return F.struct(
        c["start"].alias("start"),
        c["end"].alias("end"),
        values.alias("values"),
        _total(repeats).alias("squares"),
        F.length(c["alphabet"]).cast("double").alias("k"),
        F.size(c["letters"]).cast("double").alias("n"),
    )


def _pairs(values: Column) -> Column:
    n = F.size(values)
    return F.arrays_zip(
        F.slice(values, F.lit(1), n - 1).alias("a"), F.slice(values, F.lit(2), n - 1).alias("b")
    )


def _moments(c: Column) -> Column:
    middle, mean = c["k"] / 2, _total(c["values"]) / c["n"]
    return F.struct(
        *(c[name].alias(name) for name in ("start", "end", "values", "squares", "k", "n")),
        mean.alias("mean"),
        F.size(F.filter(c["values"], lambda v: v >= middle)).cast("double").alias("above"),
        (
            1
            + F.size(
                F.filter(_pairs(c["values"]), lambda p: (p["a"] >= middle) != (p["b"] >= middle))
            )
        )
        .cast("double")
        .alias("runs"),
    )


def _scores(c: Column) -> Column:
    """Standard scores of the three tests; 0 where a test has nothing to tell."""
    n, k = c["n"], c["k"]
    # The statistic grows with the pairs of equal symbols, of which a random string has ``pairs``
    # give or take their root; the cube root takes out the skew (Wilson and Hilferty).
    pairs = n * (n - 1) / (2 * k)
    seen = (c["squares"] - n) / 2
    chi = 3 * F.sqrt(pairs) * (F.cbrt(seen / pairs) - 1 + 1 / (9 * pairs))
    both = 2 * c["above"] * (n - c["above"])
    spread = both * (both - n) / (n * n * (n - 1))
    runs = F.when(spread > 0, (c["runs"] - both / n - 1) / F.sqrt(spread)).otherwise(99.0)
    around = _total(F.transform(c["values"], lambda v: (v - c["mean"]) * (v - c["mean"])))
    along = _total(
        F.transform(_pairs(c["values"]), lambda p: (p["a"] - c["mean"]) * (p["b"] - c["mean"]))
    )
    serial = F.when(around > 0, F.sqrt(n) * (along / around + 1 / n)).otherwise(99.0)
    return F.struct(
        c["start"].alias("start"),
        c["end"].alias("end"),
        F.floor(F.log2(n)).cast("int").alias("size_class"),
        F.greatest(F.lit(1e-300), _tail(chi)).alias("p_chi"),
        F.least(F.lit(1.0), 2 * _tail(F.abs(runs))).alias("p_runs"),
        F.least(F.lit(1.0), 2 * _tail(F.abs(serial))).alias("p_serial"),
    )


def _combined(c: Column) -> Column:
    """Fisher's rule: the tail of a chi-squared sum with six degrees of freedom."""
    half = -(F.log(c["p_chi"]) + F.log(c["p_runs"]) + F.log(c["p_serial"]))
    # In tenths of decades below one.
    down = 10 / 2.302585092994046 * (half - F.log(1 + half + half * half / 2))
    return F.struct(
        c["start"].alias("start"),
        c["end"].alias("end"),
        c["size_class"].alias("size_class"),
        F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor(down))).cast("int").alias("bin"),
    )


def cutoffs(tested: DataFrame, share: float = FALSE_SHARE) -> dict[int, int]:
    """For each class of lengths the bin from which on strings are not random.

    Benjamini-Hochberg over counts: of the bins whose upper p-value times the number of strings
    is at most ``share`` of the strings at or below it, the one with the largest p-value. The
    counts have at most ``BINS`` + 1 rows for each doubling of the length.
    """
    counts = (
        tested.select(F.explode("tested").alias("t"))
        .groupBy(F.col("t.size_class").alias("size_class"), F.col("t.bin").alias("bin"))
        .count()
        .collect()
    )
    found: dict[int, int] = {}
    for size in {row["size_class"] for row in counts}:
        bins = sorted(((r["bin"], r["count"]) for r in counts if r["size_class"] == size), reverse=True)
        total, below = sum(n for _, n in bins), 0
        for bin_, n in bins:
            below += n
            if 10 ** (-bin_ / 10) * total <= share * below:
                found[size] = bin_
    return found


def _ordered(order: int):
    """Spans as they sort: by start, then by the place of their kind in the list."""
    return lambda m: F.struct(
        m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end")
    )


def _above(size: int, limit: int):
    """Strings of other classes of lengths, or with a p-value above the cut."""
    return lambda t: (t["size_class"] != size) | (t["bin"] < limit)


def scanned(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, base, tested``: plain spans, and for other long strings their tested class."""
    docs = picked(df, doc_id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    spans = docs.select(
        "doc_id",
        F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["body"]) >= ASSIGNED_LEAST).alias(
            "assign"
        ),
        matches(text, ACCESS).alias("access"),
        matches(text, HEX).alias("hex"),
        matches(text, CANDIDATE).alias("candidates"),
    )
    base = F.flatten(
        F.array(*(F.transform(kind, _ordered(order)) for order, kind in enumerate(KINDS[:-1])))
    )
    spans = spans.select("doc_id", base.alias("base"), "candidates")
    spans = spans.select(
        "doc_id",
        "base",
        F.filter(
            "candidates",
            lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
        ).alias("tested"),
    )
    for step in (_coded, _measured, _moments, _scores, _combined):
        spans = spans.withColumn("tested", F.transform("tested", step))
    return spans


def judged(spans: DataFrame, limits: dict[int, int]) -> DataFrame:
    """``doc_id, found`` from scanned rows and the cut of each class of lengths."""
    random = F.col("tested")
    for size, limit in limits.items():
        random = F.filter(random, _above(size, limit))
    added = F.transform(random, _ordered(len(KINDS) - 1))
    names = F.array(*map(F.lit, KINDS))
    return spans.select(
        "doc_id",
        F.transform(
            F.array_sort(F.concat("base", added)),
            lambda s: F.struct(
                F.element_at(names, s["order"] + 1).alias("kind"),
                s["start"].alias("start"),
                s["end"].alias("end"),
            ),
        ).alias("found"),
    )


def find(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: float = FALSE_SHARE,
) -> DataFrame:
    """``doc_id, found``: spans of secrets of every whole text, by start and kind.

    ``found`` is an array of ``kind, start, end`` in code points, the end left out; kinds are
    ``assign``, ``access``, ``hex`` and, for strings no plain kind touches, ``random``. Which
    strings are random depends on all rows, so the scanned rows, without their texts, are
    written once. A null or empty text has no span. Repeated rows and null ids stay, an empty
    table gives no row, extra columns are not looked at.
    """
    spans = written(scanned(df, id_col, text_col), "secrets")
    return judged(spans, cutoffs(spans, share))


def mask(df: DataFrame, text_col: str = "text", share: float = FALSE_SHARE) -> DataFrame:
    """``df`` with every secret of ``text_col`` replaced by its kind in brackets.

    Rows are scanned twice, for the cuts and for the spans, rather than written with their
    texts. All columns stay as they are, a null text included.
    """
    own = f"`{text_col}`"
    limits = cutoffs(scanned(df.select(F.lit(None).cast("int").alias("none"), F.col(own).alias("text")), "none", "text"), share)
    rows = df.select(F.struct(*(F.col(f"`{name}`") for name in df.columns)).alias("whole"))
    rows = rows.withColumn("text", F.col(f"whole.{own}"))
    found = judged(scanned(rows, "whole", "text"), limits).select(F.col("doc_id").alias("whole"), "found")
    return found.select(
        *(
            masked(F.col(f"whole.{own}"), F.col("found")).alias(name)
            if name == text_col
            else F.col(f"whole.`{name}`").alias(name)
            for name in df.columns
        )
    )


def masked(text: Column, found: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlapping ones as one."""
    begin = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))

    def add(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        name = F.concat(gap, F.lit("["), span["kind"], F.lit("]"))
        return F.struct(
            F.concat(
                state["text"], F.when(span["start"] >= state["at"], name).otherwise("")
            ).alias("text"),
            F.greatest(state["at"], span["end"]).alias("at"),
        )

    def rest(state: Column) -> Column:
        return F.concat(state["text"], F.substring(text, state["at"] + 1, F.length(text)))

    return F.when(F.size(found) > 0, F.aggregate(found, begin, add, rest)).otherwise(text)
