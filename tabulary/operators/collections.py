"""Stored documents: add, update, delete, describe.

A collection is stored in folders by collection and by bucket of the id. A change rewrites only
the folders that hold a changed id; Spark replaces each of them as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.functions.columns import small_side
from tabulary.session import written

UNKNOWN_SOURCE = "unknown"  # fixed value: source of a document that names none
BUCKETS = 64
FOLDERS = ("collection", "bucket")


def with_defaults(documents: DataFrame) -> DataFrame:
    """Documents with an id and a source."""
    return documents.withColumns(
        {
            "id": F.coalesce(F.col("id").cast("string"), F.uuid()),
            "source": F.coalesce("source", F.lit(UNKNOWN_SOURCE)),
        }
    )


def bucket_of(key: str = "id") -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def add_documents(documents: DataFrame, path: str) -> None:
    """Append documents to a stored collection, one folder per collection and bucket of ids."""
    rows = written(with_defaults(documents), "added")  # an id that was made up must stay the same
    rows = rows.withColumn("bucket", bucket_of())
    # A collection with many documents is written by several tasks.
    rows.repartition(*FOLDERS).write.mode("append").partitionBy(*FOLDERS).parquet(path)


def merge_documents(
    spark: SparkSession, path: str, changes: DataFrame | None = None, removed: DataFrame | None = None
) -> int:
    """Change and remove stored documents in place; says how many folders were rewritten.

    ``changes`` and ``removed`` have string ids, one row per id, as ``update_documents`` and
    ``delete_documents`` take them. Ids that aren't stored change nothing. New folders are made
    whole before they replace old ones, so a failed task leaves the old ones.
    """
    frames = [df.select("id") for df in (changes, removed) if df is not None]
    ids = written(reduce(DataFrame.unionByName, frames).distinct(), "ids")
    stored = spark.read.parquet(path)
    buckets = [row[0] for row in ids.select(bucket_of()).distinct().collect()]  # BUCKETS at most
    near = stored.filter(F.col("bucket").isin(buckets))
    touched = near.join(ids, "id", "left_semi").select(*FOLDERS).distinct()
    touched = written(touched, "folders")
    named = small_side(touched.toDF("_collection", "_bucket"))
    met = F.col("collection").eqNullSafe(F.col("_collection")) & (F.col("bucket") == F.col("_bucket"))
    rows = near.join(named, met).select(*stored.columns)
    if removed is not None:
        rows = delete_documents(rows, removed)
    if changes is not None:
        rows = update_documents(rows, changes)
    made = written(rows, "merged")
    emptied = touched.join(
        made.select(*FOLDERS).distinct().toDF("_collection", "_bucket"), met, "left_anti"
    )
    # Only files of folders that are left without a document.
    lost = near.select(*FOLDERS, F.col("_metadata.file_path").alias("file")).distinct()
    lost = lost.join(emptied.toDF("_collection", "_bucket"), met, "left_semi").select("file").collect()
    made.repartition(*FOLDERS).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*FOLDERS).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    for row in lost:
        file = hadoop.Path(spark._jvm.java.net.URI(row["file"]))
        file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, False)
    spark.catalog.refreshByPath(path)
    return touched.count()


def update_documents(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """A new snapshot with changed cells replaced; ``changes`` has one row per id.

    Cells that are null in ``changes`` keep their stored value.
    """
    changed = [c for c in changes.columns if c != "id"]
    renamed = changes.select("id", *[F.col(c).alias(f"_new_{c}") for c in changed])
    return stored.join(renamed, "id", "left").select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in stored.columns]
    )


def delete_documents(stored: DataFrame, removed: DataFrame) -> DataFrame:
    """A new snapshot without the ids in ``removed``."""
    return stored.join(removed.select("id"), "id", "left_anti")


def collection_info(stored: DataFrame) -> DataFrame:
    return stored.groupBy("collection").agg(F.count(F.lit(1)).alias("n_documents"))
