"""Vector, keyword and hybrid search for whole tables of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.functions.columns import BROADCAST_ROWS, quoted, small_side
from tabulary.functions.text import keyword_score, overlap, word_hashes
from tabulary.operators.questions import expand_query, search_type
from tabulary.session import in_arrow, written

QUERY_BYTES = 64 * 1024 * 1024  # query vectors a task holds at once
TILE_CELLS = 2_000_000  # similarities a task holds at once
VECTOR_CELLS = 1 << 20  # numbers of vectors a task turns into doubles at once
SCORE_DIGITS = 9  # scores closer than this count as equal; the id decides

# Weight of meaning against words per kind of search, the boost of chunks
# that suit it, the chunks it prefers, and how many candidates are ranked again.
SEMANTIC_WEIGHTS = {
    "data_analysis": 0.8,
    "column_search": 0.6,
    "statistical": 0.7,
    "filter_search": 0.5,
    "general": 0.7,
}
BOOSTS = (
    ("column_search", ("column",), 1.2),
    ("statistical", ("summary",), 1.2),
    ("data_analysis", ("summary", "column"), 1.1),
)
PREFERRED_CHUNKS = {"column_search": "column", "statistical": "summary"}
CANDIDATES_PER_HIT = 2


def candidates_for(n: int, most: int | None = None) -> int:
    """How many nearest chunks are ranked again: twice ``n``, ``most`` if given, never below n."""
    wanted = CANDIDATES_PER_HIT * n
    return max(n, wanted if most is None else min(wanted, most))


def vector_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    vector_group: str | None = None,
    query_group: str | None = None,
) -> DataFrame:
    """Exact ``k`` nearest vectors of every query: ``(query_id, rank, id, similarity)``.

    ``vectors`` has ``id, embedding``; ``queries`` has ``query_id, query_vector``, with ids of
    their own. With groups, a query whose group is not null sees only vectors of that group.

    Query vectors of up to ``QUERY_BYTES`` go to every task, which multiplies its vectors with
    them and keeps ``k`` per query, so only those are shuffled. More are dealt out in blocks, and
    so are the vectors: each pair of a query block and a vector block meets in a task that holds
    the queries and reads the vectors past them. Copies tie, the smaller id wins.
    """
    asked = queries.select(
        "query_id",
        F.col("query_vector").cast("array<double>").alias("vector"),
        (F.col(query_group) if query_group else F.lit(None)).cast("string").alias("group"),
    ).filter(F.size("vector") > 0)
    # Tasks make doubles of what they get; floats take half the room on the way there.
    vector, kind = F.col("embedding"), vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    stored = vectors.select(
        "id",
        (vector if single else vector.cast("array<double>")).alias("vector"),
        (F.col(vector_group) if vector_group else F.lit(None)).cast("string").alias("group"),
    ).filter(F.size("vector") > 0)
    size = asked.agg(F.coalesce(F.sum(F.size("vector").cast("long") * 8), F.lit(0))).first()[0]
    blocks = max(1, -(-size // QUERY_BYTES))
    if blocks == 1:
        return ranked(_shared_pass(stored, asked, k), k)
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = max(1, -(-partitions // blocks))
    own, others = F.pmod(F.xxhash64("query_id"), F.lit(blocks)), F.sequence(F.lit(0), F.lit(tiles - 1))
    asked = asked.withColumn("block", own.cast("int")).withColumn("tile", F.explode(others))
    own, others = F.pmod(F.xxhash64("id"), F.lit(tiles)), F.sequence(F.lit(0), F.lit(blocks - 1))
    stored = stored.withColumn("vector", F.col("vector").cast("array<double>"))
    stored = stored.withColumn("tile", own.cast("int")).withColumn("block", F.explode(others))
    return ranked(met(stored, asked, ["block", "tile"], k), k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of the hits that tasks handed on; at most ``k`` per query and task."""
    order = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("id").asc())
    kept = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return kept.select("query_id", "rank", "id", "similarity")


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)


def _best_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row the ``k`` columns with the highest scores, earlier columns first on ties."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    edge = np.partition(scores, -k, axis=1)[:, -k][:, None]
    above = scores > edge
    level = scores == edge
    room = k - above.sum(axis=1, keepdims=True)
    kept = above | (level & (np.cumsum(level, axis=1) <= room))
    return np.nonzero(kept)[1].reshape(len(scores), k)


class _Best:
    """The best ``k`` vectors of some queries, while vectors pass by."""

    def __init__(self, queries: pa.RecordBatch | pa.Table, textual: bool, k: int) -> None:
        if isinstance(queries, pa.Table):
            queries = queries.combine_chunks()
        self.names = queries.column("query_id")
        count = queries.num_rows
        self.matrix = _unit_rows(_matrix(queries.column("vector"), count))
        self.wanted = np.array([group or "" for group in queries.column("group").to_pylist()], dtype=str)
        self.grouped = bool((self.wanted != "").any())
        self.textual, self.k = textual, k
        self.best = np.full((count, k), -np.inf)
        self.ids = np.full((count, k), "" if textual else 0, dtype="U1" if textual else "int64")

    def add(self, vectors: pa.RecordBatch) -> None:
        step = max(1, VECTOR_CELLS // max(1, self.matrix.shape[1]))
        for start in range(0, vectors.num_rows, step):
            self._add(vectors.slice(start, step))

    def _add(self, vectors: pa.RecordBatch) -> None:
        found = vectors.column("id").to_numpy(zero_copy_only=False)
        found = found.astype(str) if self.textual else found.astype("int64")
        data = _unit_rows(_matrix(vectors.column("vector"), vectors.num_rows))
        order = np.argsort(found, kind="stable")
        found, data = found[order], data[order]
        if self.grouped:
            kinds = [group or "" for group in vectors.column("group").to_pylist()]
            kinds = np.array(kinds, dtype=str)[order]
        if self.textual:
            size = max(found.dtype.itemsize, self.ids.dtype.itemsize) // 4
            self.ids = self.ids.astype(f"U{size}")
        step = max(1, TILE_CELLS // len(found))
        for start in range(0, len(self.matrix), step):
            part = slice(start, start + step)
            cosine = np.clip(self.matrix[part] @ data.T, -1.0, 1.0)
            scores = np.round((1.0 + cosine) / 2.0, SCORE_DIGITS)
            if self.grouped:
                asked = self.wanted[part][:, None]
                scores[(asked != "") & (asked != kinds[None, :])] = -np.inf
            picked = _best_columns(scores, self.k)
            merged = np.hstack([self.best[part], np.take_along_axis(scores, picked, axis=1)])
            names = np.hstack([self.ids[part], found[picked]])
            top = np.lexsort((names, -merged), axis=1)[:, : self.k]
            self.best[part] = np.take_along_axis(merged, top, axis=1)
            self.ids[part] = np.take_along_axis(names, top, axis=1)

    def hits(self) -> pa.RecordBatch:
        number, place = np.nonzero(self.best > -np.inf)
        names = self.names.take(pa.array(number))
        return pa.RecordBatch.from_arrays(
            [
                names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names,
                pa.array(self.ids[number, place].tolist(), pa.string() if self.textual else pa.int64()),
                pa.array(self.best[number, place]),
            ],
            names=["query_id", "id", "similarity"],
        )


def _matrix(vectors: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(rows, -1)


def _hit_types(stored: DataFrame, asked: DataFrame) -> tuple[bool, str, str]:
    """Whether ids are text, the type they travel in, and the schema of hits."""
    textual = isinstance(stored.schema["id"].dataType, T.StringType)
    kept = "string" if textual else "long"
    query_type = asked.schema["query_id"].dataType.simpleString()
    return textual, kept, f"query_id {query_type}, id {kept}, similarity double"


def _shared_pass(stored: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Hits of each task of ``stored`` for queries of at most ``QUERY_BYTES`` together."""
    textual, kept, schema = _hit_types(stored, asked)
    shared = stored.sparkSession.sparkContext.broadcast(asked.toArrow())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not shared.value.num_rows:
            return
        best = _Best(shared.value, textual, k)
        for batch in batches:
            if batch.num_rows:
                best.add(batch)
        yield best.hits()

    hits = in_arrow(stored.withColumn("id", F.col("id").cast(kept)), search, schema)
    return hits.withColumn("id", F.col("id").cast(stored.schema["id"].dataType))


def met(stored: DataFrame, asked: DataFrame, cell: list[str], k: int) -> DataFrame:
    """Hits of every cell: its queries against its vectors, ``k`` per query.

    ``stored`` has ``id, vector, group``, ``asked`` has ``query_id, vector, group``, both with the
    columns of ``cell``. A task holds the queries of one cell at a time; vectors stream past.
    """
    textual, kept, schema = _hit_types(stored, asked)
    query_type = asked.schema["query_id"].dataType

    def side(df: DataFrame, number: int) -> DataFrame:
        query = F.col("query_id") if number == 0 else F.lit(None).cast(query_type)
        own = F.col("id").cast(kept) if number == 1 else F.lit(None).cast(kept)
        return df.select(
            *cell, F.lit(number).alias("side"), query.alias("query_id"), own.alias("id"), "vector", "group"
        )

    partitions = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = side(asked, 0).unionByName(side(stored, 1))
    dealt = both.repartition(partitions, *cell).sortWithinPartitions(*cell, "side")
    columns = len(cell)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, queries, best = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = np.stack([batch.column(n).to_numpy() for n in range(columns + 1)])
            edges = np.flatnonzero((numbers[:, 1:] != numbers[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                own, is_query = numbers[:columns, start].tolist(), numbers[columns, start] == 0
                if own != current:
                    if best is not None:
                        yield best.hits()
                    current, queries, best = own, [], None
                part = batch.slice(start, end - start)
                if is_query:
                    queries.append(part)
                elif queries:
                    if best is None:
                        best = _Best(pa.Table.from_batches(queries), textual, k)
                    best.add(part)
        if best is not None:
            yield best.hits()

    hits = in_arrow(dealt, search, schema)
    return hits.withColumn("id", F.col("id").cast(stored.schema["id"].dataType))


def semantic_search(chunks: DataFrame, queries: DataFrame, n: int = 5, **groups) -> DataFrame:
    """Nearest chunks of every query with their columns; empty documents are left out.

    The hits are written once, so that measuring them does not search again.
    """
    filled = chunks.filter(F.length("document") > 0)
    hits = small_side(vector_topk(filled, queries, n, **groups), store=True)
    return hits.join(filled.drop("embedding"), "id")


def hybrid_search(
    chunks: DataFrame,
    queries: DataFrame,
    n: int = 10,
    semantic_weight: Column | float = 0.7,
    keyword_weight: Column | float = 0.3,
    most_candidates: int | None = None,
    keyword_hits: DataFrame | None = None,
    **groups,
) -> DataFrame:
    """Nearest chunks ranked again by a weighted sum of similarity and word overlap.

    Twice ``n`` chunks are ranked again, or ``most_candidates`` if that is less. ``keyword_hits``,
    the result of a ``KeywordIndex`` search, are candidates too, however far their vectors are.

    ``queries`` carries ``query_text`` besides its vector; weights may be query columns.
    """
    filled = chunks.filter(F.length("document") > 0)
    hits = written(vector_topk(filled, queries, candidates_for(n, most_candidates), **groups), "hits")
    weights = queries.select(
        F.col("query_id"),
        F.col("query_text"),
        _number(semantic_weight).alias("_ws"),
        _number(keyword_weight).alias("_wk"),
    )
    scored = _with_overlap(hits, weights, filled.drop("embedding"))
    if keyword_hits is not None:
        more = _by_keywords(chunks, queries, keyword_hits, hits, **groups)
        more = more.join(small_side(weights), "query_id").withColumn(
            "keyword_score", keyword_score(F.col("query_text"), F.col("document"))
        )
        scored = scored.unionByName(more.select(*scored.columns))
    combined = F.col("_ws") * F.col("similarity") + F.col("_wk") * F.col("keyword_score")
    scored = scored.withColumn("combined_score", F.round(combined, SCORE_DIGITS))
    order = W.partitionBy("query_id").orderBy(
        F.col("combined_score").desc(), F.col("rank").asc_nulls_last(), F.col("id").asc()
    )
    return (
        scored.withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") <= n)
        .withColumnRenamed("similarity", "semantic_score")
        .withColumn("rank", F.col("_place"))
        .drop("_place", "_ws", "_wk")
    )


def _with_overlap(hits: DataFrame, weights: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the columns of their chunk and ``keyword_score``.

    The texts of few hits are compared where the chunks are. Of many hits each chunk's words are
    found once and joined last, so no text is moved or read again for each of its hits.
    """
    columns = ["query_id", "id", "rank", "similarity", *(c for c in chunks.columns if c != "id")]
    if hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = small_side(hits).join(chunks, "id").join(small_side(weights), "query_id")
        score = keyword_score(F.col("query_text"), F.col("document"))
    else:
        asked = weights.withColumn("_asked", word_hashes(F.col("query_text"))).drop("query_text")
        held = chunks.withColumn("_held", word_hashes(F.col("document")))
        found = hits.join(small_side(asked), "query_id").join(held, "id")
        score = overlap(F.col("_held"), F.col("_asked"))
    return found.select(*columns, "_ws", "_wk", score.alias("keyword_score"))


def _by_keywords(
    chunks: DataFrame,
    queries: DataFrame,
    keyword_hits: DataFrame,
    hits: DataFrame,
    vector_group: str | None = None,
    query_group: str | None = None,
) -> DataFrame:
    """Chunks found by their words and not by their vectors, with similarity and without a rank."""
    asked = queries.select(
        "query_id",
        F.col("query_vector").cast("array<double>").alias("_q"),
        (F.col(query_group) if query_group else F.lit(None)).cast("string").alias("_wanted"),
    )
    new = keyword_hits.select("query_id", "id").join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    new = written(new, "pairs")
    if new.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # Few pairs go to the chunks, whose texts and vectors stay where they are.
        pairs = small_side(new).join(chunks, "id").join(small_side(asked), "query_id")
    else:
        pairs = new.join(small_side(asked), "query_id").join(chunks, "id")
    if vector_group:
        pairs = pairs.filter(F.col("_wanted").isNull() | (F.col("_wanted") == F.col(vector_group)))
    vector = F.col("embedding").cast("array<double>")

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)

    size = F.sqrt(dot(F.col("_q"), F.col("_q")) * dot(vector, vector))
    cosine = F.when(size > 0, dot(F.col("_q"), vector) / size).otherwise(0.0)
    similarity = F.round((1 + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / 2, SCORE_DIGITS)
    return pairs.withColumn("similarity", similarity).withColumn("rank", F.lit(None).cast("int")).select(
        *hits.columns, *(c for c in chunks.columns if c not in ("id", "embedding"))
    )


def _number(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def semantic_weight(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SEMANTIC_WEIGHTS.items() for x in pair])
    return F.coalesce(known[kind], F.lit(SEMANTIC_WEIGHTS["general"]))


def preferred_chunks(kind: Column, given: Column | None = None) -> Column:
    """The chunk type a search is limited to; one that was asked for wins."""
    known = F.create_map(*[F.lit(x) for pair in PREFERRED_CHUNKS.items() for x in pair])
    return F.coalesce(given, known[kind]) if given is not None else known[kind]


def boost_factor(kind: Column, chunk_type: Column) -> Column:
    factor = F.lit(1.0)
    for name, suited, boost in reversed(BOOSTS):
        factor = F.when((kind == name) & chunk_type.isin(*suited), boost).otherwise(factor)
    return factor


def rerank_boost(results: DataFrame, kind: str = "search_type") -> DataFrame:
    """Scores raised for chunks that suit the kind of search, ranks renewed."""
    boosted = F.col("combined_score") * boost_factor(F.col(kind), F.col("chunk_type"))
    order = W.partitionBy("query_id").orderBy(F.col("combined_score").desc(), F.col("rank").asc())
    return results.withColumn("combined_score", F.round(boosted, SCORE_DIGITS)).withColumn(
        "rank", F.row_number().over(order)
    )


def plan_queries(queries: DataFrame, expansion: bool = True) -> DataFrame:
    """Queries with their kind of search, widened text and the chunk type they look at."""
    given = F.col("chunk_type") if "chunk_type" in queries.columns else None
    kind = search_type(F.col("query_text"))
    planned = queries.withColumn("search_type", kind)
    planned = planned.withColumn("wanted_chunks", preferred_chunks(F.col("search_type"), given))
    if expansion:
        planned = planned.withColumn("query_text", expand_query(F.col("query_text")))
    return planned


def optimized_search(
    chunks: DataFrame,
    queries: DataFrame,
    n: int = 5,
    filters: Column | None = None,
    expansion: bool = True,
    hybrid: bool = True,
) -> DataFrame:
    """Kind of search, synonyms, chunk preference, hybrid ranking and boost in one go.

    ``queries`` has ``query_id, query_text, query_vector`` and may ask for a ``chunk_type``.
    ``filters`` is applied to the chunks before anything is ranked.
    """
    planned = plan_queries(queries, expansion)
    if filters is not None:
        chunks = chunks.filter(filters)
    groups = {"vector_group": "chunk_type", "query_group": "wanted_chunks"}
    if hybrid:
        weight = semantic_weight(F.col("search_type"))
        found = hybrid_search(chunks, planned, n, weight, F.lit(1.0) - weight, **groups)
    else:
        found = semantic_search(chunks, planned, n, **groups).withColumns(
            {
                "semantic_score": F.col("similarity"),
                "keyword_score": F.lit(0.0),
                "combined_score": F.col("similarity"),
            }
        ).drop("similarity")
    kinds = planned.select("query_id", "search_type")
    return rerank_boost(found.join(small_side(kinds), "query_id"))


def search_insights(results: DataFrame, content_length: int = 200) -> DataFrame:
    """What the hits of each query look like: sizes, sources, chunk types, mean score."""
    score = F.avg("combined_score")
    best = F.min_by(F.col("document"), F.col("rank"))
    return results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.count_distinct(F.coalesce("source", F.lit("Unknown"))).alias("n_sources"),
        F.count_if(F.col("chunk_type") == "column").alias("n_column"),
        F.count_if(F.col("chunk_type") == "summary").alias("n_summary"),
        score.alias("avg_score"),
        F.when(score > 0.8, "High relevance scores - results closely match your query")
        .when(score < 0.5, "Lower relevance scores - consider refining your query")
        .alias("note"),
        F.when(F.length(best) > content_length, F.concat(F.substring(best, 1, content_length), F.lit("...")))
        .otherwise(best)
        .alias("best_content"),
    )


def row_result_format(hits: DataFrame, fields: list[str]) -> DataFrame:
    """A short text for every found row, with notes on the hits of its query.

    ``hits`` has ``query_id, rank, similarity`` and the row's columns.
    """
    shown = F.concat_ws(
        ", ", *[F.concat(F.lit(f"{f}: "), F.coalesce(quoted(f).cast("string"), F.lit("None"))) for f in fields[:4]]
    )
    per_query = W.partitionBy("query_id")
    mean = F.avg("similarity").over(per_query)
    return hits.select(
        "query_id",
        "rank",
        shown.alias("content"),
        F.col("similarity").alias("relevance"),
        F.count(F.lit(1)).over(per_query).alias("n_rows"),
        F.when(mean > 0.7, "High similarity scores - strong semantic matches")
        .when(mean < 0.4, "Lower similarity scores - may need to refine query")
        .alias("note"),
        F.format_string(
            "Results show similarity range: %.3f to %.3f",
            F.min("similarity").over(per_query),
            F.max("similarity").over(per_query),
        ).alias("spread"),
    )
