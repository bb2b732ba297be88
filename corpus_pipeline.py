"""From raw documents to token ids: language, near-duplicates, benchmark, secrets, encoding.

Each stage takes the documents its predecessor kept and returns documents, the last one tokens.
``run`` writes each stage's result once below the shared folder and goes on from there, so a lost
executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.llm import byte_bpe, decontaminate, language, secrets, simhash
from tabulary.session import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Cosine below which a text is in none of the learned languages; unrelated texts are near zero.
LEAST_SCORE = 0.05

#: The stages hold hashes, models and encoders that SQL can't express.
ORACLE_SQL = None


def documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def measured(df: DataFrame) -> DataFrame:
    """Documents whose length follows their text; a null text keeps what it had."""
    return df.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the labelled ones; a missing label is filled in.

    Texts that are null, hold no letter or resemble no language go. Without any label nothing
    can be told apart, and all texts with a letter stay.
    """
    docs = documents(docs)
    learned = language.learn(docs)
    if not learned:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rest = F.struct(*(name for name in COLUMNS if name != "text")).alias("rest")
    found = language.identify(docs.select(rest, "text"), learned, id_col="rest", with_text=True)
    kept = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(
        *(
            F.col("text")
            if name == "text"
            else F.coalesce("doc_id.lang", "lang_pred").alias("lang")
            if name == "lang"
            else F.col(f"doc_id.{name}").alias(name)
            for name in COLUMNS
        )
    )


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Near are documents whose SimHash fingerprints of three-word shingles differ in two bits of 64
    at most, directly or through others. Null and empty texts are alike and leave one row; rows
    without an id come after all others; of rows alike in id and text one stays. No document
    gives no row.
    """
    return simhash.representatives(documents(docs), words=simhash.WORDS, budget=simhash.BUDGET)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages; those left without a word go.

    Null texts and texts without a passage stay as they are, repeated rows and null ids too. An
    empty benchmark changes nothing, no document gives no row.
    """
    docs = documents(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # The length before tells which texts were cut; it travels with the source.
    whole = docs.withColumn("source", F.struct("source", F.length("text").alias("before")))
    cleaned = decontaminate.cleaned(whole, benchmark).select(
        "doc_id", "text", "lang", "source.source", "source.before", "n_chars"
    )
    untouched = F.col("before").eqNullSafe(F.length("text"))
    kept = cleaned.filter(untouched | F.col("text").rlike(r"[\p{L}\p{N}]"))
    return documents(measured(kept))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret replaced by its kind in brackets.

    Null and empty texts, repeated rows and null ids stay as they are; no document gives no row.
    """
    return documents(measured(secrets.mask(documents(docs))))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with digests of the ids and of what they decode to.

    A null text is empty and has no ids; repeated rows and null ids stay; no document gives no
    row.
    """
    return byte_bpe.round_trip(documents(docs), with_ids=True)


STAGES = [
    ("language", identified),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
