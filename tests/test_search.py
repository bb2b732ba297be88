import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulary.functions import columns, words
from tabulary.functions.text import keyword_score, preprocess_text, row_to_text
from tabulary.operators import collections, search, vector_index
from tabulary.operators.embed import TextEmbedder, _Features, embedded_rows, row_search, text_search
from tabulary.operators.vector_index import VectorIndex, vector_topk_approx
from tabulary.plans import searching


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def brute_force(ids, vectors, queries, k, allowed=None):
    scores = np.round((1 + np.clip(unit(queries) @ unit(vectors).T, -1, 1)) / 2, 9)
    found = {}
    for q in range(len(queries)):
        order = [
            i
            for i in sorted(range(len(ids)), key=lambda i: (-scores[q, i], ids[i]))
            if allowed is None or allowed(q, i)
        ]
        found[q] = [ids[i] for i in order[:k]]
    return found


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 16)).astype("float32")
    vectors[::3] = vectors[0]  # a third of all vectors are copies
    queries = np.vstack([vectors[0], rng.normal(size=(4, 16))]).astype("float32")
    return vectors, queries


def frames(spark, vectors, queries, text_ids=False):
    ids = [f"id{i:05d}" if text_ids else i for i in range(len(vectors))]
    kinds = ["rows", "column", "summary"]
    stored = spark.createDataFrame(
        [(ids[i], v.tolist(), kinds[i % 3 if i % 2 else 0]) for i, v in enumerate(vectors)],
        f"id {'string' if text_ids else 'long'}, embedding array<float>, chunk_type string",
    ).repartition(5)
    asked = spark.createDataFrame(
        [(i, q.tolist(), "column" if i % 2 else None) for i, q in enumerate(queries)],
        "query_id int, query_vector array<float>, wanted string",
    )
    return ids, stored, asked


def collected(hits):
    found = {}
    for row in hits.orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append(row["id"])
    return found


@pytest.mark.parametrize("text_ids", [False, True])
@pytest.mark.parametrize("tile", [search.TILE_CELLS, 100])
def test_topk_with_copies(spark, monkeypatch, data, text_ids, tile):
    monkeypatch.setattr(search, "TILE_CELLS", tile)
    vectors, queries = data
    ids, stored, asked = frames(spark, vectors, queries, text_ids)
    assert collected(search.vector_topk(stored, asked, 7)) == brute_force(ids, vectors, queries, 7)


@pytest.mark.parametrize("text_ids", [False, True])
@pytest.mark.parametrize("vectors_at_once", [1, 2, 100])
def test_topk_in_blocks(spark, monkeypatch, data, text_ids, vectors_at_once):
    """Queries beyond one block meet the vectors in tasks; none passes the driver."""
    monkeypatch.setattr(search, "QUERY_BYTES", 8 * 16 * vectors_at_once)
    vectors, queries = data
    ids, stored, asked = frames(spark, vectors, queries, text_ids)
    if vectors_at_once < 5:
        monkeypatch.setattr(search, "_shared_pass", None)
    assert collected(search.vector_topk(stored, asked, 3)) == brute_force(ids, vectors, queries, 3)


def test_topk_of_a_group_in_blocks(spark, monkeypatch, data):
    monkeypatch.setattr(search, "QUERY_BYTES", 1)
    vectors, queries = data
    ids, stored, asked = frames(spark, vectors, queries)
    kinds = [r["chunk_type"] for r in stored.orderBy("id").collect()]
    found = collected(search.vector_topk(stored, asked, 5, "chunk_type", "wanted"))
    allowed = lambda q, i: q % 2 == 0 or kinds[i] == "column"
    assert found == brute_force(ids, vectors, queries, 5, allowed)


def test_topk_of_a_group(spark, data):
    vectors, queries = data
    ids, stored, asked = frames(spark, vectors, queries)
    kinds = [r["chunk_type"] for r in stored.orderBy("id").collect()]
    found = collected(search.vector_topk(stored, asked, 5, "chunk_type", "wanted"))
    allowed = lambda q, i: q % 2 == 0 or kinds[i] == "column"
    assert found == brute_force(ids, vectors, queries, 5, allowed)


def test_few_vectors_zero_vectors_and_no_queries(spark):
    stored = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "id long, embedding array<float>"
    )
    asked = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, query_vector array<float>")
    hits = search.vector_topk(stored, asked, 5).orderBy("rank").collect()
    assert [(r["id"], r["similarity"]) for r in hits] == [(1, 1.0), (2, 0.5)]
    assert search.vector_topk(stored, asked.limit(0), 5).count() == 0


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    vectors = np.repeat(centres, 50, axis=0) + rng.normal(scale=0.05, size=(3000, 16))
    queries = vectors[::20] + rng.normal(scale=0.01, size=(150, 16))
    return vectors.astype("float32"), queries.astype("float32")


def test_approximate_search_of_clusters_reads_few_vectors(spark, clustered):
    vectors, queries = clustered
    ids, stored, asked = frames(spark, vectors, queries)
    exact = search.vector_topk(stored, asked, 5)
    near = vector_topk_approx(stored, asked, 5).cache()
    assert exact.join(near, ["query_id", "id", "similarity"]).count() >= 0.9 * exact.count()
    shares = near.select("query_id", "compared").distinct().agg(F.avg("compared")).first()[0] / 3000
    assert shares <= 0.1
    index = VectorIndex.build(stored, 50)
    assert index.table.count() == index.sizes.sum() == 3000
    few = collected(index.search(asked, 5, 1))
    lists = {r["id"]: r["list"] for r in index.table.collect()}
    assert all(len({lists[i] for i in found}) == 1 for found in few.values())


def test_all_lists_give_the_exact_hits(spark, monkeypatch, data):
    """Hot lists are read in parts, and queries of one list in blocks."""
    monkeypatch.setattr(vector_index, "PART_ROWS", 100)
    monkeypatch.setattr(search, "QUERY_BYTES", 8 * 16 * 2)
    vectors, queries = data
    ids, stored, asked = frames(spark, vectors, queries)
    index = VectorIndex.build(stored, 7)
    assert collected(index.search(asked, 6, 7)) == brute_force(ids, vectors, queries, 6)


def test_index_is_kept_and_opened(spark, clustered, tmp_path):
    vectors, queries = clustered
    ids, stored, asked = frames(spark, vectors, queries, text_ids=True)
    made = VectorIndex.build(stored, 30, path=str(tmp_path / "index"))
    opened = VectorIndex.open(spark, str(tmp_path / "index"))
    assert (opened.centroids == made.centroids).all() and (opened.sizes == made.sizes).all()
    assert collected(opened.search(asked, 4, 2)) == collected(made.search(asked, 4, 2))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_approximate_search_of_the_tables(spark, size):
    folder = f"/root/testdata/{size}"
    asked = searching.asking_vectors(spark, folder)
    exact = search.vector_topk(searching.all_vectors(spark, folder), asked, 5)
    near = searching.vector_topk_approx(spark, folder).cache()
    ids = spark.read.parquet(f"{folder}/embeddings.parquet").filter("vec_id % 20 = 0")
    assert near.select("query_id").distinct().count() == ids.count() == near.count() / 5
    assert exact.join(near, ["query_id", "id", "similarity"]).count() >= 0.9 * exact.count()


def test_approximate_search_of_few_vectors_and_two_widths(spark):
    rng = np.random.default_rng(9)
    vectors, queries = rng.normal(size=(40, 16)), rng.normal(size=(6, 16))
    ids, stored, asked = frames(spark, vectors.astype("float32"), queries.astype("float32"))
    near = vector_topk_approx(stored, asked, 30, probes=1)
    assert {len(found) for found in collected(near).values()} == {30}
    assert vector_topk_approx(stored, asked, 50, probes=1).count() == 6 * 40
    assert vector_topk_approx(stored, asked.limit(0), 5).count() == 0
    assert vector_topk_approx(stored.limit(0), asked, 5).count() == 0
    other = spark.createDataFrame([(99, [1.0] * 3)], "id long, embedding array<float>")
    mixed = stored.select("id", "embedding").unionByName(other)
    with pytest.raises(ValueError, match="from 3 to 16"):
        vector_topk_approx(mixed, asked, 5)


def test_row_search_with_stored_rows(spark):
    rows = spark.createDataFrame([(n, f"thing {n}", n * 1.5) for n in range(30)], "k int, name string, x double")
    asked = spark.createDataFrame([(1, "thing 7"), (2, "thing 20")], "query_id int, query_text string")
    stored, embedder = embedded_rows(rows, "k")
    kept = row_search(rows, "k", asked, max_results=3, embedder=embedder, stored=stored)
    fresh = row_search(rows, "k", asked, max_results=3)
    assert sorted(kept.collect()) == sorted(fresh.collect())
    with pytest.raises(ValueError, match="embedder"):
        row_search(rows, "k", asked, stored=stored)


def test_chunk_search_asks_with_every_twentieth_row(spark):
    folder = "/root/testdata/sf0.001"
    part = spark.read.parquet(f"{folder}/part.parquet").filter("p_partkey % 20 = 0")
    found = searching.chunk_search(spark, folder).select("query_id").distinct()
    assert sorted(r[0] for r in found.collect()) == sorted(r.p_partkey for r in part.collect())


def test_text_search_finds_the_text_itself(spark):
    rows = [(n, f"item {n} is made of {w} in the town of {t}", w) for n, (w, t) in enumerate(
        zip(("wood", "steel", "glass", "stone") * 5, ("bern", "oslo", "rome", "kyiv", "bonn") * 4)
    )]
    store = spark.createDataFrame(rows, "id long, document string, material string")
    asked = store.filter("id % 3 = 0").selectExpr("id AS query_id", "document AS query_text")
    hits = text_search(store, asked, 30)
    first = {r["query_id"]: r["id"] for r in hits.filter("rank = 1").collect()}
    assert first == {n: n for n in range(0, 20, 3)}
    assert hits.groupBy("query_id").count().agg(F.min("count")).first()[0] == 20


def test_embedding_is_unit_length_and_equal_for_equal_texts(spark):
    df = spark.createDataFrame([("a b c",), ("a b c",), ("d e",), ("",), (None,)], "document string")
    vectors = [r["embedding"] for r in TextEmbedder().fit(df).embed(df).collect()]
    assert vectors[0] == vectors[1] and len(vectors[0]) == 512
    assert np.allclose([np.linalg.norm(v) for v in vectors], [1, 1, 1, 0, 0], atol=1e-6)


def test_embedding_follows_the_definition(spark):
    texts = ["Red fox runs\x0bred", "red fox", "A blue\tfox \n", "", None, "x" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "document string")
    found = [r["embedding"] for r in TextEmbedder(64).fit(df).embed(df).collect()]
    counts = np.zeros((len(texts), 64))
    for row, text in enumerate(texts):
        for word in re.findall(r"\w+", (text or "").lower()):
            counts[row, int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % 64] += 1
    weighted = counts * np.log((len(texts) + 1) / ((counts > 0).sum(axis=0) + 1))
    lengths = np.linalg.norm(weighted, axis=1, keepdims=True)
    assert np.allclose(found, weighted / np.where(lengths > 0, lengths, 1), atol=1e-6)


def test_many_hits_are_not_capped():
    assert [search.candidates_for(n) for n in (1, 30, 200)] == [2, 60, 400]
    assert search.candidates_for(200, 50) == 200


def test_keyword_score(spark):
    df = spark.createDataFrame(
        [("Red  fox", "the red FOX\nruns"), ("", ""), ("a", "b")], "q string, d string"
    )
    scores = [r[0] for r in df.select(keyword_score(F.col("q"), F.col("d"))).collect()]
    assert scores == [0.5, 0.0, 0.0]


def test_preprocess_text(spark):
    df = spark.createDataFrame(
        [("  a\n b  NaN 1.5 and 22, N/A none x1 3.x ",), (None,)], "t string"
    )
    texts = [r[0] for r in df.select(preprocess_text(F.col("t"))).collect()]
    assert texts == ["a b [MISSING] [NUMBER] and [INTEGER], [MISSING] [MISSING] x1 [INTEGER].x", ""]


@pytest.fixture(scope="module")
def store(spark):
    rows = [
        (1, "average total of salary", [1.0, 0.0, 0.0], "a", "summary"),
        (2, "salary column of people", [0.9, 0.1, 0.0], "a", "column"),
        (3, "rows of people", [0.8, 0.3, 0.0], "b", "rows"),
        (4, "", [1.0, 0.0, 0.0], "b", "rows"),
        (5, "unrelated words", [0.0, 0.0, 1.0], "b", "summary"),
    ]
    return spark.createDataFrame(
        rows,
        "id long, document string, embedding array<float>, source string, chunk_type string",
    )


def asked(spark, text):
    return spark.createDataFrame(
        [(1, text, [1.0, 0.0, 0.0])], "query_id int, query_text string, query_vector array<float>"
    )


def test_hybrid_without_words_keeps_vector_order(spark, store):
    found = search.hybrid_search(store, asked(spark, "rows of people"), 3, 1.0, 0.0)
    assert [r["id"] for r in found.orderBy("rank").collect()] == [1, 2, 3]


def test_hybrid_with_words_only(spark, store):
    found = search.hybrid_search(store, asked(spark, "rows of people"), 3, 0.0, 1.0)
    first = found.orderBy("rank").first()
    assert first["id"] == 3 and first["keyword_score"] == 1.0


def test_statistical_search_sees_summaries_only(spark, store):
    found = search.optimized_search(store, asked(spark, "average total salary"), 5)
    rows = found.orderBy("rank").collect()
    assert [r["id"] for r in rows] == [1, 5]
    assert {r["search_type"] for r in rows} == {"statistical"}
    plain = search.semantic_search(store, asked(spark, "x"), 5, ).orderBy("rank").first()
    assert plain["id"] == 1 and plain["similarity"] == 1.0


def test_optimized_search_switches_and_filters(spark, store):
    query = asked(spark, "people")
    found = search.optimized_search(
        store, query, 5, filters=F.col("source") == "b", expansion=False, hybrid=False
    )
    rows = found.orderBy("rank").collect()
    assert [r["id"] for r in rows] == [3, 5]
    assert {r["keyword_score"] for r in rows} == {0.0}


def test_row_search_matches_brute_force(spark):
    rows = spark.createDataFrame(
        [(i, ["red", "green", "blue"][i % 3], f"thing {i}") for i in range(60)],
        "key long, colour string, name string",
    )
    queries = spark.createDataFrame(
        [("q1", "colour is blue name is thing 5"), ("q2", "green")],
        "query_id string, query_text string",
    )
    found = row_search(rows, "key", queries, max_results=5)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["key"])
    assert got["q1"][0] == 5
    assert all(key % 3 == 1 for key in got["q2"])

    sentences = rows.select(F.col("key").alias("id"), row_to_text(rows).alias("document"))
    embedder = TextEmbedder().fit(sentences)
    stored = embedder.embed(sentences).orderBy("id").toPandas()
    vectors = np.array(stored["embedding"].tolist())
    lengths = np.linalg.norm(vectors, axis=1)
    assert np.allclose(lengths, 1.0, atol=1e-5)
    wanted = embedder.embed(queries, "query_text", "v").orderBy("query_id").toPandas()
    expected = brute_force(
        stored["id"].tolist(), vectors.astype("float64"), np.array(wanted["v"].tolist(), dtype="float64"), 5
    )
    assert got == {"q1": expected[0], "q2": expected[1]}


@pytest.mark.parametrize("piece", [5, 1 << 20])
def test_words_of_many_texts_are_counted_at_once(monkeypatch, piece):
    monkeypatch.setattr(words, "PIECE", piece)
    letters = "ab_ \n\t\u00e9\u65e5\u0301\U00020000\u00bd."
    source = np.random.default_rng(3)
    texts = ["".join(source.choice(list(letters), size)) for size in source.integers(0, 60, 1500)]
    texts += ["", None, " ", "a", "a" * 50 + " b"]
    features = _Features(64)
    found = list(features.counts(pa.array(texts, pa.string())))
    expected = np.zeros((len(texts), 64), dtype=int)
    for number, text in enumerate(texts):
        for word in re.findall(r"\w+", text or ""):
            expected[number, int.from_bytes(hashlib.md5(word.encode()).digest()[:2], "big") % 64] += 1
    assert [len(part) for part in found] == [1024, len(texts) - 1024]
    assert (np.vstack(found) == expected).all()
    assert not list(features.counts(pa.array([], pa.string())))


def test_floats_are_sent_as_floats_and_multiplied_in_parts(spark, monkeypatch, data):
    monkeypatch.setattr(search, "VECTOR_CELLS", 16 * 7)
    vectors, queries = data
    stored = spark.createDataFrame(
        [(n, row.tolist()) for n, row in enumerate(vectors)], "id long, embedding array<float>"
    )
    asked = spark.createDataFrame(
        [(n, row.tolist()) for n, row in enumerate(queries)], "query_id long, query_vector array<float>"
    )
    found = search.vector_topk(stored, asked, 5)
    assert "cast(embedding" not in found._jdf.queryExecution().optimizedPlan().toString()
    hits = {}
    for row in found.orderBy("query_id", "rank").collect():
        hits.setdefault(row["query_id"], []).append(row["id"])
    assert hits == brute_force(list(range(len(vectors))), vectors.astype(float), queries.astype(float), 5)


def test_own_model_slot(spark):
    @F.pandas_udf("array<float>")
    def model(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), 1.0])

    docs = spark.createDataFrame([("abc",)], "document string")
    assert TextEmbedder(model=model).fit(docs).embed(docs).first()["embedding"] == [3.0, 1.0]


def test_collections(spark, tmp_path):
    path = str(tmp_path / "docs")
    docs = spark.createDataFrame(
        [("a", "one", "s", "c1"), (None, "two", None, "c1"), ("b", "three", "s", "c2")],
        "id string, document string, source string, collection string",
    )
    collections.add_documents(docs, path)
    stored = spark.read.parquet(path)
    assert stored.filter("document = 'two'").first()["source"] == "unknown"
    assert len(stored.filter("document = 'two'").first()["id"]) == 36
    changes = spark.createDataFrame([("a", None, "t")], "id string, document string, source string")
    row = collections.update_documents(stored, changes).filter("id = 'a'").first()
    assert (row["document"], row["source"]) == ("one", "t")
    left = collections.delete_documents(stored, changes)
    assert left.count() == 2
    info = {r["collection"]: r["n_documents"] for r in collections.collection_info(stored).collect()}
    assert info == {"c1": 2, "c2": 1}


def test_many_hits_move_no_texts_to_their_queries(spark, monkeypatch):
    texts = [f"block {n} of {' '.join(f'w{(n * 7 + k) % 90}' for k in range(60))}" for n in range(40)]
    store = spark.createDataFrame([(n, t, "s") for n, t in enumerate(texts)], "id long, document string, source string")
    asked = spark.createDataFrame(
        [(n, f"w{n % 95} w{n % 31} Block") for n in range(60)] + [(60, None), (61, "")], "query_id long, query_text string"
    )
    stored = TextEmbedder().fit(store).embed(store)
    asked = TextEmbedder().fit(store).embed(asked, "query_text", "query_vector")
    few = search.hybrid_search(stored, asked, 5)
    for module in (columns, search):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 20)
    many = search.hybrid_search(stored, asked, 5)
    assert many.columns == few.columns
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    plan = spark._jvm.PythonSQLUtils.explainString(
        many.select("query_id", "id", "rank", "combined_score")._jdf.queryExecution(), "formatted"
    )
    moved = re.findall(r"Input \[\d+\]: \[([^\]]*)\]\nArguments: hashpartitioning\(query_id", plan)
    assert moved and not any("document" in columns_ for columns_ in moved)
