"""An inverted file of vectors: lists around learned centroids, of which a query reads a few.

Centroids are learned over all vectors inside the tasks; what reaches the driver is one sum per
centroid and round. The vectors are written once, partitioned by list. A query is compared with
the vectors of its nearest lists only, and how many lists it needs for a wanted recall is read off
a bounded sample of queries that is searched exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.operators import search
from tabulary.session import in_arrow, scratch_path, written

MOST_LISTS = 4096
ROUNDS = 4
RECALL = 0.95
PROBE_SAMPLE = 200  # queries searched exactly to choose the number of lists
PART_ROWS = 100_000  # vectors of one list that one task reads
SCALE = 1 << 24  # whole numbers add up to the same sum in any order


def common_width(vectors: DataFrame, queries: DataFrame) -> int:
    """The width of all vectors, 1 without any; null and empty ones have none."""
    sizes = vectors.select(F.size("embedding").alias("n")).unionByName(
        queries.select(F.size("query_vector").alias("n"))
    )
    least, most = sizes.filter("n > 0").agg(F.min("n"), F.max("n")).first()
    if least != most:
        raise ValueError(f"vectors have different widths, from {least} to {most}")
    return most or 1


def _nearest(data: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.round(data @ centroids.T, search.SCORE_DIGITS).argmax(axis=1)


def learn_centroids(vectors: DataFrame, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of about ``lists`` groups of vectors, by rounds of spherical k-means.

    Starts from the vectors whose ids have the smallest hashes; copies among them count once. A
    centroid that no vector is nearest to stays where it is.
    """
    spark = vectors.sparkSession
    first = vectors.orderBy(F.xxhash64("id"), "id").limit(lists).select("embedding").collect()
    centroids = search._unit_rows(np.unique(np.array([row[0] for row in first], dtype="float64"), axis=0))
    width = centroids.shape[1]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centroids)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(shared.value.shape, dtype=np.int64)
            seen = np.zeros(len(sums), dtype=bool)
            for batch in batches:
                if batch.num_rows:
                    data = search._unit_rows(search._matrix(batch.column(0), batch.num_rows))
                    own = _nearest(data, shared.value)
                    np.add.at(sums, own, np.rint(data * SCALE).astype(np.int64))
                    seen[own] = True
            lists = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists.astype(np.int32)), pa.array(list(sums[lists]), pa.list_(pa.int64()))],
                names=["list", "total"],
            )

        partial = in_arrow(vectors.select("embedding"), add, "list int, total array<long>")
        cells = partial.select("list", F.posexplode("total").alias("place", "value"))
        totals = cells.groupBy("list", "place").agg(F.sum("value").alias("value"))
        moved = centroids.copy()
        for row in totals.collect():  # lists times width, whatever the number of vectors
            moved[row["list"], row["place"]] = row["value"]
        centroids = search._unit_rows(moved.reshape(-1, width))
    return centroids


@dataclass
class VectorIndex:
    """Vectors with their list, as a table written by list, and the centroids of the lists."""

    table: DataFrame  # id, embedding, list
    centroids: np.ndarray
    sizes: np.ndarray

    @classmethod
    def build(
        cls, vectors: DataFrame, lists: int | None = None, rounds: int = ROUNDS, path: str | None = None
    ) -> VectorIndex:
        """Learns ``lists`` lists (the square root of the number of vectors) and writes all rows.

        Null and empty vectors are left out. ``path`` keeps the index for ``open``.
        """
        spark = vectors.sparkSession
        known = vectors.filter(F.size("embedding") > 0).select("id", "embedding")
        count = known.count()
        lists = lists or max(1, min(MOST_LISTS, round(count**0.5)))
        centroids = learn_centroids(known, lists, rounds) if count else np.zeros((1, 1))
        shared = spark.sparkContext.broadcast(centroids)
        names = ["id", "embedding", "list"]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    data = search._unit_rows(search._matrix(batch.column(1), batch.num_rows))
                    own = pa.array(_nearest(data, shared.value).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*batch.columns, own], names=names)

        kinds = [known.schema[name].dataType.simpleString() for name in names[:2]]
        assigned = in_arrow(known, assign, f"id {kinds[0]}, embedding {kinds[1]}, list int")
        path = path or scratch_path(spark, "vector-index")
        # A list that holds a third of all vectors is written by several tasks.
        salt = F.pmod(F.xxhash64("id"), F.lit(16))
        assigned.repartition("list", salt).write.partitionBy("list").parquet(f"{path}/lists")
        rows = [(number, centroid.tolist()) for number, centroid in enumerate(centroids)]
        spark.createDataFrame(rows, "list int, centroid array<double>").write.parquet(f"{path}/centroids")
        return cls.open(spark, path, f"id {kinds[0]}, embedding {kinds[1]}, list int")

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: str | None = None) -> VectorIndex:
        reader = spark.read.schema(schema) if schema else spark.read
        table = reader.parquet(f"{path}/lists")
        centroids = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
        sizes = np.zeros(len(centroids), dtype=np.int64)
        for row in table.groupBy("list").count().collect():
            sizes[row["list"]] = row["count"]
        return cls(table, np.array([row["centroid"] for row in centroids]), sizes)

    def _lists(self, queries: DataFrame, probes: int, k: int) -> DataFrame:
        """Queries with the lists they read, nearest first, and the vectors in them.

        A query reads at least ``probes`` lists, and as many as hold ``k`` vectors.
        """
        shared = queries.sparkSession.sparkContext.broadcast((self.centroids, self.sizes))

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, sizes = shared.value
            for batch in batches:
                if not batch.num_rows or not sizes.any():
                    continue
                data = search._unit_rows(search._matrix(batch.column(1), batch.num_rows))
                scores = np.round(data @ centroids.T, search.SCORE_DIGITS)
                order = np.argsort(-scores, axis=1, kind="stable")
                held = np.cumsum(sizes[order], axis=1)
                read = np.maximum(probes, (held < k).sum(axis=1) + 1).clip(max=len(sizes))
                lists = [row[:n].tolist() for row, n in zip(order, read, strict=True)]
                compared = held[np.arange(len(read)), read - 1]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lists, pa.list_(pa.int32())), pa.array(compared)],
                    names=["query_id", "vector", "lists", "compared"],
                )

        kind = queries.schema["query_id"].dataType.simpleString()
        vector = F.col("query_vector").cast("array<double>").alias("vector")
        asked = queries.filter(F.size("query_vector") > 0).select("query_id", vector)
        schema = f"query_id {kind}, vector array<double>, lists array<int>, compared long"
        return in_arrow(asked, choose, schema)

    def probes_for(self, queries: DataFrame, k: int, recall: float = RECALL) -> int:
        """How many lists find ``recall`` of the true neighbours of a sample of the queries.

        The sample has ``PROBE_SAMPLE`` queries, chosen by a hash of their ids.
        """
        some = written(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(PROBE_SAMPLE), "sample")
        exact = search.vector_topk(self.table, some, k).select("query_id", "id")
        hits = written(exact.join(self.table.select("id", "list"), "id"), "neighbours")
        ordered = self._lists(some, len(self.sizes), k)
        place = F.array_position("lists", F.col("list").cast("int"))
        found = hits.join(ordered, "query_id").select(place.alias("place")).collect()
        places = sorted(row["place"] for row in found)
        return places[max(0, int(np.ceil(recall * len(places))) - 1)] if places else 1

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """``query_id, rank, id, similarity, compared``: hits among the lists each query reads.

        ``compared`` is the number of vectors a query was multiplied with. Lists are read in
        parts, so a list with many vectors or many queries is shared by several tasks.
        """
        spark = queries.sparkSession
        asked = written(self._lists(queries, probes, k), "asked")
        dealt = asked.select("query_id", "vector", F.explode("lists").alias("list"))
        bytes_asked = dealt.groupBy("list").agg(F.sum(F.size("vector").cast("long") * 8).alias("b"))
        blocks = {row["list"]: -(-row["b"] // search.QUERY_BYTES) for row in bytes_asked.collect()}
        rows = [
            (number, int(-(-size // PART_ROWS)), int(blocks[number]))
            for number, size in enumerate(self.sizes.tolist())
            if size and number in blocks
        ]
        # One row for each list at most.
        plan = F.broadcast(spark.createDataFrame(rows, "list int, parts int, blocks int"))
        none = F.lit(None).cast("string").alias("group")

        def share(column: str, most: str) -> F.Column:
            return F.pmod(F.xxhash64(column), F.col(most)).cast("int")

        def every(most: str) -> F.Column:
            return F.explode(F.sequence(F.lit(0), F.col(most) - 1))

        questions = dealt.join(plan, "list").withColumn("block", share("query_id", "blocks"))
        questions = questions.withColumn("part", every("parts"))
        vectors = self.table.join(plan, "list").withColumn("part", share("id", "parts"))
        vectors = vectors.withColumn("block", every("blocks"))
        cell = ["list", "part", "block"]
        vector = F.col("embedding").cast("array<double>").alias("vector")
        hits = search.met(
            vectors.select("id", vector, none, *cell),
            questions.select("query_id", "vector", none, *cell),
            cell,
            k,
        )
        return search.ranked(hits, k).join(asked.select("query_id", "compared"), "query_id")


def vector_topk_approx(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    lists: int | None = None,
    recall: float = RECALL,
    probes: int | None = None,
) -> DataFrame:
    """Approximate nearest neighbours by an inverted file, scored like the exact search.

    Every vector is indexed. ``probes`` lists are read for each query; if it isn't given, so many
    that ``recall`` of the neighbours of a bounded sample of queries are found. On vectors without
    clusters that may be most of the lists, and ``compared`` says so.
    """
    common_width(vectors, queries)
    index = VectorIndex.build(vectors, lists)
    if probes is None:
        probes = index.probes_for(queries, k, recall)
    return index.search(queries, k, probes)
