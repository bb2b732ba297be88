"""Search queries over a chunk store made of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.functions.text import keyword_score, row_to_text
from tabulary.operators import (
    chunks,
    collections,
    embed,
    keyword_index,
    search,
    vector_index,
)
from tabulary.plans.catalogue import q, query, rounded, table
from tabulary.plans.chunking import CHUNKS_OF_PART_SQL
from tabulary.plans.questions import expand_sql, search_type_sql
from tabulary.session import scratch_path, written
from tabulary.sources.readers import where_metadata

CHUNK_KINDS = ("rows", "column", "summary")
#: Tables that ask of themselves do so with every row whose id is divisible by this.
ASKED_EVERY = 20


def text_vectors_sql(texts: str, fitted: str | None = None) -> str:
    """``id, embedding`` of the texts of a subquery with ``id, text``, weighted by ``fitted``."""

    def counted(source: str) -> str:
        words = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
        return (
            f"(SELECT id, CAST('0x' || substr(md5(word), 1, 4) AS INTEGER) % {embed.FEATURES} AS b, "
            f"count(*) AS n FROM (SELECT id, unnest({words}) AS word FROM {source}) "
            "GROUP BY ALL)"
        )

    fitted = fitted or texts
    return f"""(
    WITH asked AS MATERIALIZED (SELECT id, text FROM {texts}),
    fitted AS MATERIALIZED (SELECT id, text FROM {fitted}),
    size AS (SELECT CAST(count(*) + 1 AS DOUBLE) AS n FROM fitted),
    weights AS (SELECT g.b, ln((SELECT n FROM size) / (count(t.b) + 1)) AS w
                FROM range({embed.FEATURES}) g(b) LEFT JOIN {counted('fitted')} t ON t.b = g.b GROUP BY g.b),
    weighted AS MATERIALIZED (SELECT id, b, n * w AS x FROM {counted('asked')} JOIN weights USING (b)),
    lengths AS (SELECT id, nullif(sqrt(sum(x * x)), 0) AS length FROM weighted GROUP BY id)
    SELECT a.id, list(CAST(coalesce(x / length, 0) AS FLOAT) ORDER BY g.b) AS embedding
    FROM asked a CROSS JOIN range({embed.FEATURES}) g(b)
    LEFT JOIN weighted t ON t.id = a.id AND t.b = g.b LEFT JOIN lengths l ON l.id = a.id GROUP BY a.id)"""


def with_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with one of the stored vectors; documents take turns at them."""
    vectors = table(spark, folder, "embeddings")
    turn = F.col("doc_id") % vectors.agg(F.count(F.lit(1))).scalar()
    documents = table(spark, folder, "documents").withColumn("vec_id", turn)
    return documents.join(vectors, "vec_id")


def chunk_table(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as chunks, without vectors."""
    kinds = F.array(*[F.lit(kind) for kind in CHUNK_KINDS])
    kind = F.element_at(kinds, (F.col("doc_id") % len(CHUNK_KINDS) + 1).cast("int"))
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("document"),
        "source",
        kind.alias("chunk_type"),
        F.col("lang").alias("collection"),
    )


def store_and_questions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The chunks and the benchmark's questions, each with the vector of its text."""
    chunks_ = chunk_table(spark, folder)
    embedder = embed.TextEmbedder().fit(chunks_)
    asked = embedder.embed(search_texts(spark, folder), "query_text", "query_vector")
    return written(embedder.embed(chunks_), "store"), written(asked, "questions")


CHUNKS_SQL = (
    "(SELECT doc_id AS id, text AS document, source, "
    "['rows', 'column', 'summary'][doc_id % 3 + 1] AS chunk_type, lang AS collection FROM documents)"
)
TEXTS_SQL = "(SELECT doc_id AS id, text FROM documents)"
STORE_SQL = f"(SELECT * FROM {CHUNKS_SQL} JOIN {text_vectors_sql(TEXTS_SQL)} USING (id))"

OPENINGS = (
    "",
    "analyze statistics trend: ",
    "list column and schema of ",
    "average total outlier of ",
    "filter rows where value is above ",
    "correlation of data in ",
    "unique missing total ",
)


def search_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages as search texts, each behind one of a few openings."""
    openings = F.array(*[F.lit(o) for o in OPENINGS])
    opening = F.element_at(openings, (F.col("item_id") % len(OPENINGS) + 1).cast("int"))
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.concat(opening, F.col("text")).alias("query_text")
    )


QUESTIONS_SQL = (
    "(SELECT item_id AS query_id, list_extract(["
    + ", ".join(q(o) for o in OPENINGS)
    + f"], item_id % {len(OPENINGS)} + 1) || text AS query_text FROM benchmark)"
)
ASKED_SQL = (
    f"(SELECT query_id, query_text, embedding AS query_vector FROM {QUESTIONS_SQL} JOIN "
    + text_vectors_sql(f"(SELECT query_id AS id, query_text AS text FROM {QUESTIONS_SQL})", TEXTS_SQL)
    + " ON query_id = id)"
)


def label_centres(spark: SparkSession, folder: str) -> DataFrame:
    """The mean vector of every label, as a query."""
    means = (
        table(spark, folder, "embeddings")
        .select("label", F.posexplode("embedding").alias("place", "x"))
        .groupBy("label", "place")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("place", "x")))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(ordered, lambda cell: cell["x"]).alias("query_vector")
    )


CENTRES_SQL = (
    "(SELECT label AS query_id, list(x ORDER BY place) AS query_vector FROM "
    "(SELECT label, place, avg(embedding[place]::DOUBLE) AS x FROM embeddings, range(1, 65) r(place) "
    "GROUP BY label, place) GROUP BY label)"
)

COSINE_SQL = "list_cosine_similarity(query_vector::DOUBLE[], embedding::DOUBLE[])"
SIMILARITY_SQL = f"round((1 + coalesce(nullif({COSINE_SQL}, 'NaN'::DOUBLE), 0)) / 2, 9)"


def topk_sql(store: str, asked: str, k: int, condition: str = "true") -> str:
    return (
        f"SELECT query_id, id, {SIMILARITY_SQL} AS similarity, CAST(row_number() OVER "
        f"(PARTITION BY query_id ORDER BY {SIMILARITY_SQL} DESC, id) AS INTEGER) AS rank "
        f"FROM {asked} a, {store} s WHERE {condition} QUALIFY rank <= {k}"
    )


VECTORS_SQL = "(SELECT vec_id AS id, embedding::DOUBLE[] AS embedding FROM embeddings)"


def all_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query(
    "vector_topk",
    f"SELECT query_id, id, rank, round(similarity, 6) AS similarity "
    f"FROM ({topk_sql(VECTORS_SQL, CENTRES_SQL, 5)})",
)
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = search.vector_topk(all_vectors(spark, folder), label_centres(spark, folder), 5)
    return rounded(hits, "similarity", places=6)


def asking_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored vector whose id is divisible by twenty, as a query."""
    chosen = table(spark, folder, "embeddings").filter(F.col("vec_id") % ASKED_EVERY == 0)
    return chosen.select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")
    )


@query("vector_topk_approx")
def vector_topk_approx(spark: SparkSession, folder: str) -> DataFrame:
    """Hits for every twentieth vector, with the share of all pairs that was compared."""
    vectors, asked = all_vectors(spark, folder), asking_vectors(spark, folder)
    hits = written(vector_index.vector_topk_approx(vectors, asked, 5), "approximate")
    compared = hits.filter("rank = 1").agg(F.sum("compared")).scalar()
    possible = vectors.agg(F.count(F.lit(1))).scalar() * asked.agg(F.count(F.lit(1))).scalar()
    return hits.drop("compared").withColumn("compared_share", F.round(compared / possible, 4))


@query(
    "embed_text",
    "SELECT id AS doc_id, list_transform(embedding, lambda x: round(x::DOUBLE, 5)) AS embedding "
    f"FROM {text_vectors_sql(TEXTS_SQL)}",
)
def embed_text(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", F.col("text").alias("document"))
    found = embed.TextEmbedder().fit(documents).embed(documents)
    rounded_ = F.transform("embedding", lambda x: F.round(x.cast("double"), 5))
    return found.select("doc_id", rounded_.alias("embedding"))


_FILTERS = {"source": {"$in": ["src1", "src2", "src3"]}, "chunk_type": "rows", "collection": ""}


@query(
    "metadata_filter",
    "SELECT query_id, id, rank, round(similarity, 6) AS similarity FROM ("
    + topk_sql(
        STORE_SQL, ASKED_SQL, 5, "source IN ('src1', 'src2', 'src3') AND chunk_type = 'rows'"
    )
    + ")",
)
def metadata_filter(spark: SparkSession, folder: str) -> DataFrame:
    store, asked = store_and_questions(spark, folder)
    hits = search.vector_topk(store.filter(where_metadata(_FILTERS)), asked, 5)
    return rounded(hits, "similarity", places=6)


_ROW_TEXT = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(
    "row_to_text",
    "SELECT c_custkey, concat_ws('. ', "
    + ", ".join(f"'{c} is ' || {c}" for c in (*_ROW_TEXT, "n_orders", "total_spent"))
    + ") AS row_text FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, "
    "max(o_totalprice) AS total_spent FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey",
)
def row_text(spark: SparkSession, folder: str) -> DataFrame:
    spent = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("total_spent"))
    )
    rows = table(spark, folder, "customer").join(spent, "c_custkey", "left")
    return rows.select("c_custkey", row_to_text(rows).alias("row_text"))


PART_TEXTS_SQL = (
    "(SELECT p_partkey AS id, concat_ws('. ', "
    + ", ".join(
        f"'{c} is ' || {c}"
        for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    )
    + ") AS text FROM part)"
)
TYPES_SQL = (
    "(SELECT p_type AS id, 'parts of type ' || p_type || ' and brand ' || max(p_brand) AS text "
    "FROM part GROUP BY p_type)"
)
TYPES_ASKED_SQL = (
    f"(SELECT id AS query_id, embedding AS query_vector FROM {text_vectors_sql(TYPES_SQL, PART_TEXTS_SQL)})"
)


@query(
    "row_search",
    f"SELECT query_id, rank, round(similarity + 2e-9, 6) AS similarity, part.* "
    f"FROM ({topk_sql(text_vectors_sql(PART_TEXTS_SQL), TYPES_ASKED_SQL, 10)}) JOIN part ON p_partkey = id",
)
def row_search(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    asked = (
        part.groupBy("p_type")
        .agg(F.max("p_brand").alias("_brand"))
        .select(
            F.col("p_type").alias("query_id"),
            F.concat_ws(" ", F.lit("parts of type"), "p_type", F.lit("and brand"), "_brand").alias(
                "query_text"
            ),
        )
    )
    return nudged(embed.row_search(part, "p_partkey", asked), "similarity")


_HIT_FIELDS = ["id", "collection", "source", "chunk_type"]


@query(
    "row_result_format",
    f"""
    WITH h AS (SELECT * FROM ({topk_sql(f"(SELECT * FROM {STORE_SQL} WHERE length(document) > 0)", ASKED_SQL, 10)}) JOIN
               (SELECT id, collection, source, chunk_type FROM {CHUNKS_SQL}) USING (id))
    SELECT query_id, rank, 'id: ' || id || ', collection: ' || collection || ', source: ' || source
           || ', chunk_type: ' || chunk_type AS content, round(similarity, 6) AS relevance,
           count(*) OVER p AS n_rows,
           CASE WHEN avg(similarity) OVER p > 0.7 THEN 'High similarity scores - strong semantic matches'
                WHEN avg(similarity) OVER p < 0.4 THEN
                     'Lower similarity scores - may need to refine query' END AS note,
           'Results show similarity range: ' || printf('%.3f', min(similarity) OVER p) || ' to '
           || printf('%.3f', max(similarity) OVER p) AS spread
    FROM h WINDOW p AS (PARTITION BY query_id)
    """,
)
def row_result_format(spark: SparkSession, folder: str) -> DataFrame:
    hits = search.semantic_search(*store_and_questions(spark, folder), 10)
    return rounded(search.row_result_format(hits, _HIT_FIELDS), "relevance", places=6)


def jaccard_sql(left: str, right: str) -> str:
    a = f"list_distinct(list_filter(regexp_split_to_array(lower({left}), '\\s+'), lambda x: x <> ''))"
    b = f"list_distinct(list_filter(regexp_split_to_array(lower({right}), '\\s+'), lambda x: x <> ''))"
    shared = f"len(list_intersect({a}, {b}))"
    return (
        f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE "
        f"CAST({shared} AS DOUBLE) / (len({a}) + len({b}) - {shared}) END"
    )


@query(
    "keyword_jaccard",
    f"""
    SELECT u.conv_id, u.turn, round({jaccard_sql('u.text', 'r.text')}, 6) AS keyword_score
    FROM conversations u JOIN conversations r ON u.conv_id = r.conv_id AND r.turn = u.turn + 1
    WHERE u.role = 'user' AND r.role = 'assistant'
    """,
)
def keyword_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    talk = table(spark, folder, "conversations")
    asked = talk.filter(F.col("role") == "user").select("conv_id", "turn", "text")
    replied = talk.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    return asked.join(replied, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(keyword_score(F.col("text"), F.col("reply")), 6).alias("keyword_score")
    )


def hybrid_sql(asked: str, n: int, condition: str, weight: str, store: str = STORE_SQL) -> str:
    return f"""
    SELECT query_id, id, source, chunk_type, document, semantic_score, keyword_score, combined_score,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, srank)
                AS INTEGER) AS rank
    FROM (SELECT query_id, id, source, chunk_type, document, similarity AS semantic_score,
                 rank AS srank, {jaccard_sql('query_text', 'document')} AS keyword_score,
                 round(({weight}) * similarity
                       + (1.0 - ({weight})) * {jaccard_sql('query_text', 'document')}, 9) AS combined_score
          FROM ({topk_sql(store, asked, 2 * n, f"length(document) > 0 AND ({condition})")})
          JOIN (SELECT * EXCLUDE (query_vector) FROM {asked}) USING (query_id)
          JOIN (SELECT * EXCLUDE (embedding) FROM {store}) USING (id))
    QUALIFY rank <= {n}
    """


_SCORES = ("semantic_score", "keyword_score", "combined_score")
# Scores agree to nine digits; a nudge keeps halves from falling on either side.
NUDGE = 2e-9
_SCORES_SQL = ", ".join(f"round({s} + {NUDGE}, 6) AS {s}" for s in _SCORES)


def nudged(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({name: F.round(F.col(name) + NUDGE, 6) for name in columns})



@query(
    "hybrid_search",
    f"SELECT query_id, id, rank, {_SCORES_SQL} FROM ({hybrid_sql(ASKED_SQL, 10, 'true', '0.7::DOUBLE')})",
)
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    found = search.hybrid_search(*store_and_questions(spark, folder), 10)
    return nudged(found.select("query_id", "id", "rank", *_SCORES), *_SCORES)


#: Least share of words that documents and questions have in common to be found by them.
LEAST_OVERLAP = 0.3
WORD_SETS_SQL = (
    "(SELECT doc_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), "
    "lambda x: x <> '')) AS words FROM documents)"
)


@query(
    "keyword_search",
    f"""
    WITH sets AS MATERIALIZED (SELECT * FROM {WORD_SETS_SQL} WHERE len(words) > 0),
    pairs AS (SELECT a.id AS query_id, d.id, len(list_intersect(a.words, d.words)) AS shared,
                     len(a.words) + len(d.words) AS total
              FROM sets a, sets d WHERE a.id % {ASKED_EVERY} = 0
              AND len(d.words) >= 0.49 * len(a.words) AND len(a.words) >= 0.49 * len(d.words))
    SELECT query_id, id, round(CAST(shared AS DOUBLE) / (total - shared), 6) AS keyword_score
    FROM pairs WHERE round(CAST(shared AS DOUBLE) / (total - shared), 9) >= 0.5
    """,
)
def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that share half of their words with every twentieth one."""
    documents = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("document")
    )
    asked = documents.filter(F.col("id") % ASKED_EVERY == 0).toDF("query_id", "query_text")
    found = keyword_index.KeywordIndex.build(documents).search(asked, 0.5)
    return rounded(found, "keyword_score", places=6)


def with_keywords_sql(n: int, weight: str) -> str:
    """Hybrid search among the nearest chunks and all that share enough words."""
    return f"""
    SELECT query_id, id, similarity AS semantic_score, keyword_score, combined_score,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC,
                CASE WHEN srank <= {2 * n} THEN srank END NULLS LAST, id) AS INTEGER) AS rank
    FROM (SELECT *, round(({weight}) * similarity + (1.0 - ({weight})) * keyword_score, 9) AS combined_score
          FROM (SELECT query_id, id, {SIMILARITY_SQL} AS similarity,
                       {jaccard_sql('query_text', 'document')} AS keyword_score,
                       row_number() OVER (PARTITION BY query_id ORDER BY {SIMILARITY_SQL} DESC, id) AS srank
                FROM {ASKED_SQL} a, {STORE_SQL} s WHERE length(document) > 0)
          WHERE srank <= {2 * n} OR round(keyword_score, 9) >= {LEAST_OVERLAP})
    QUALIFY rank <= {n}
    """


@query(
    "hybrid_search_keywords",
    f"SELECT query_id, id, rank, {_SCORES_SQL} FROM ({with_keywords_sql(10, '0.3::DOUBLE')})",
)
def hybrid_search_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid search whose candidates come from vectors and from words."""
    store, asked = store_and_questions(spark, folder)
    words = keyword_index.KeywordIndex.build(store).search(asked, LEAST_OVERLAP)
    found = search.hybrid_search(store, asked, 10, 0.3, 0.7, keyword_hits=words)
    return nudged(found.select("query_id", "id", "rank", *_SCORES), *_SCORES)


PLANNED_SQL = (
    f"(SELECT *, CASE search_type WHEN 'column_search' THEN 'column' WHEN 'statistical' THEN 'summary' "
    f"END AS wanted FROM (SELECT query_id, query_vector, {expand_sql('query_text')} AS query_text, "
    f"{search_type_sql('query_text')} AS search_type FROM {ASKED_SQL}))"
)
WEIGHT_SQL = (
    "CASE search_type WHEN 'data_analysis' THEN 0.8 WHEN 'column_search' THEN 0.6 "
    "WHEN 'statistical' THEN 0.7 WHEN 'filter_search' THEN 0.5 ELSE 0.7 END::DOUBLE"
)
BOOST_SQL = (
    "CASE WHEN search_type = 'column_search' AND chunk_type = 'column' THEN 1.2 "
    "WHEN search_type = 'statistical' AND chunk_type = 'summary' THEN 1.2 "
    "WHEN search_type = 'data_analysis' AND chunk_type IN ('summary', 'column') THEN 1.1 "
    "ELSE 1.0 END::DOUBLE"
)


def boosted_sql(found: str) -> str:
    return f"""
    SELECT * EXCLUDE (r, combined_score), round(b, 9) AS combined_score,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(b, 9) DESC, r) AS INTEGER) AS rank
    FROM (SELECT * EXCLUDE (rank), rank AS r, combined_score * {BOOST_SQL} AS b
          FROM ({found}) JOIN (SELECT query_id, search_type FROM {PLANNED_SQL}) USING (query_id))
    """


OPTIMIZED_SQL = boosted_sql(
    hybrid_sql(PLANNED_SQL, 5, "wanted IS NULL OR chunk_type = wanted", WEIGHT_SQL)
)


@query(
    "rerank_boost",
    f"SELECT query_id, id, rank, search_type, round(combined_score + {NUDGE}, 6) AS combined_score FROM "
    f"({boosted_sql(hybrid_sql(ASKED_SQL, 10, 'true', '0.7::DOUBLE'))})",
)
def rerank_boost(spark: SparkSession, folder: str) -> DataFrame:
    store, asked = store_and_questions(spark, folder)
    kinds = search.plan_queries(asked).select("query_id", "search_type")
    found = search.hybrid_search(store, asked, 10).join(kinds, "query_id")
    return nudged(search.rerank_boost(found), "combined_score").select(
        "query_id", "id", "rank", "search_type", "combined_score"
    )


@query(
    "type_filter_preference",
    f"""
    SELECT query_id, search_type, wanted AS wanted_chunks,
           CASE WHEN wanted IS NULL THEN (SELECT count(*) FROM {CHUNKS_SQL})
                ELSE (SELECT count(*) FROM {CHUNKS_SQL} WHERE chunk_type = wanted) END AS n_candidates
    FROM {PLANNED_SQL}
    """,
)
def type_filter_preference(spark: SparkSession, folder: str) -> DataFrame:
    planned = search.plan_queries(search_texts(spark, folder))
    sizes = chunk_table(spark, folder).groupBy("chunk_type").agg(F.count(F.lit(1)).alias("_n"))
    every = sizes.agg(F.sum("_n")).scalar()
    return planned.join(sizes, F.col("wanted_chunks") == F.col("chunk_type"), "left").select(
        "query_id",
        "search_type",
        "wanted_chunks",
        F.when(F.col("wanted_chunks").isNull(), every)
        .otherwise(F.coalesce("_n", F.lit(0)))
        .alias("n_candidates"),
    )


@query("optimized_search", f"SELECT query_id, id, rank, search_type, {_SCORES_SQL} FROM ({OPTIMIZED_SQL})")
def optimized_search(spark: SparkSession, folder: str) -> DataFrame:
    found = search.optimized_search(*store_and_questions(spark, folder), 5)
    return nudged(found.select("query_id", "id", "rank", "search_type", *_SCORES), *_SCORES)


@query(
    "search_insights",
    f"""
    SELECT query_id, count(*) AS n_hits, count(DISTINCT source) AS n_sources,
           count(*) FILTER (WHERE chunk_type = 'column') AS n_column,
           count(*) FILTER (WHERE chunk_type = 'summary') AS n_summary,
           round(avg(combined_score), 6) AS avg_score,
           CASE WHEN avg(combined_score) > 0.8 THEN
                     'High relevance scores - results closely match your query'
                WHEN avg(combined_score) < 0.5 THEN
                     'Lower relevance scores - consider refining your query' END AS note,
           CASE WHEN length(arg_min(document, rank)) > 200
                THEN substring(arg_min(document, rank), 1, 200) || '...'
                ELSE arg_min(document, rank) END AS best_content
    FROM ({OPTIMIZED_SQL}) GROUP BY query_id
    """,
)
def search_insights(spark: SparkSession, folder: str) -> DataFrame:
    found = search.optimized_search(*store_and_questions(spark, folder), 5)
    return rounded(search.search_insights(found), "avg_score", places=6)


@query(
    "add_documents",
    "SELECT CASE WHEN label = 0 THEN 'unknown' ELSE source END AS source, text AS document, "
    "lang AS collection, true AS has_id FROM documents JOIN embeddings "
    "ON doc_id % (SELECT count(*) FROM embeddings) = vec_id",
)
def add_documents(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "collection")
    joined = with_vectors(spark, folder)
    documents = joined.select(
        F.when(F.col("label") > 1, F.col("doc_id")).alias("id"),
        F.col("text").alias("document"),
        F.when(F.col("label") > 0, F.col("source")).alias("source"),
        F.col("lang").alias("collection"),
    )
    collections.add_documents(documents, path)
    return spark.read.parquet(path).select(
        "source", "document", "collection", (F.length("id") > 0).alias("has_id")
    )


def _label_changes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 0, "low quality").alias("document"),
        F.when(F.col("toxic") == 1, "quarantine").alias("source"),
    )


@query(
    "update_documents",
    f"""
    SELECT id, CASE WHEN quality = 0 THEN 'low quality' ELSE document END AS document,
           CASE WHEN toxic = 1 THEN 'quarantine' ELSE source END AS source
    FROM {CHUNKS_SQL} LEFT JOIN labels ON doc_id = id
    """,
)
def update_documents(spark: SparkSession, folder: str) -> DataFrame:
    changed = collections.update_documents(
        chunk_table(spark, folder), _label_changes(spark, folder)
    )
    return changed.select("id", "document", "source")


@query(
    "delete_documents",
    f"SELECT id, source FROM {CHUNKS_SQL} WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def delete_documents(spark: SparkSession, folder: str) -> DataFrame:
    toxic = table(spark, folder, "labels").filter(F.col("toxic") == 1)
    return collections.delete_documents(
        chunk_table(spark, folder), toxic.select(F.col("doc_id").alias("id"))
    ).select("id", "source")


@query(
    "merge_documents",
    f"""
    SELECT CAST(id AS VARCHAR) AS id, CASE WHEN quality = 0 THEN 'low quality' ELSE document END AS document,
           source, collection
    FROM {CHUNKS_SQL} LEFT JOIN labels ON doc_id = id WHERE toxic IS NULL OR toxic <> 1
    """,
)
def merge_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Stored documents after labels changed some of them and took out others, in place."""
    path = scratch_path(spark, "collection")
    stored = chunk_table(spark, folder).drop("chunk_type")
    collections.add_documents(stored, path)
    changes = _label_changes(spark, folder).select(F.col("id").cast("string").alias("id"), "document")
    toxic = table(spark, folder, "labels").filter(F.col("toxic") == 1)
    removed = toxic.select(F.col("doc_id").cast("string").alias("id"))
    collections.merge_documents(spark, path, changes, removed)
    return spark.read.parquet(path).select("id", "document", "source", "collection")


@query(
    "collection_info",
    "SELECT lang AS collection, count(*) AS n_documents FROM documents GROUP BY lang",
)
def collection_info(spark: SparkSession, folder: str) -> DataFrame:
    return collections.collection_info(
        table(spark, folder, "documents").withColumnRenamed("lang", "collection")
    )


PLAIN_ASKED_SQL = (
    "(SELECT item_id AS query_id, text AS query_text, embedding AS query_vector FROM benchmark JOIN "
    + text_vectors_sql("(SELECT item_id AS id, text FROM benchmark)", TEXTS_SQL)
    + " ON item_id = id)"
)


@query(
    "text_search",
    f"SELECT query_id, id, rank, source, {_SCORES_SQL} "
    f"FROM ({hybrid_sql(PLAIN_ASKED_SQL, 5, 'true', '0.7::DOUBLE')})",
)
def text_search(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages as questions, all documents as the store."""
    stored = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("document"), "source"
    )
    asked = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )
    found = embed.text_search(stored, asked, 5)
    return nudged(found.select("query_id", "id", "rank", "source", *_SCORES), *_SCORES)


PART_CHUNKS_SQL = f"(SELECT chunk_id AS id, embed_text AS document, chunk_type, source FROM ({CHUNKS_OF_PART_SQL}))"
PART_CHUNK_TEXTS_SQL = f"(SELECT id, document AS text FROM {PART_CHUNKS_SQL})"
PART_STORE_SQL = f"(SELECT * FROM {PART_CHUNKS_SQL} JOIN {text_vectors_sql(PART_CHUNK_TEXTS_SQL)} USING (id))"
PART_NAMES_SQL = f"(SELECT p_partkey AS id, p_name AS text FROM part WHERE p_partkey % {ASKED_EVERY} = 0)"
PART_ASKED_SQL = (
    f"(SELECT id AS query_id, text AS query_text, embedding AS query_vector FROM {PART_NAMES_SQL} JOIN "
    f"{text_vectors_sql(PART_NAMES_SQL, PART_CHUNK_TEXTS_SQL)} USING (id))"
)


@query(
    "chunk_search",
    f"SELECT query_id, id, rank, chunk_type, source, {_SCORES_SQL} "
    f"FROM ({hybrid_sql(PART_ASKED_SQL, 5, 'true', '0.7::DOUBLE', PART_STORE_SQL)})",
)
def chunk_search(spark: SparkSession, folder: str) -> DataFrame:
    """A table cut into chunks, embedded, stored and searched with texts of its own cells."""
    part = table(spark, folder, "part")
    made = chunks.build_chunks(part, "part", ["p_partkey"])
    store = written(made.drop("meta"), "chunk-store").select(
        F.col("chunk_id").alias("id"), F.col("embed_text").alias("document"), "chunk_type", "source"
    )
    asked = part.filter(F.col("p_partkey") % ASKED_EVERY == 0).select(
        F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query_text")
    )
    found = embed.text_search(store, asked, 5)
    shown = found.select("query_id", "id", "rank", "chunk_type", "source", *_SCORES)
    return nudged(shown, *_SCORES)
