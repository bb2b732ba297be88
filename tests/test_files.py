"""Sources, sinks, chunks, conversations and streams on small frames of their own."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tabulary.operators import chunks, conversations
from tabulary.sources import catalog, readers, sinks
from tabulary.plans import talks
from tabulary.streaming import streams


def test_clean_names():
    assert readers.clean_column_names([" A b", "A-b", "a_b", "Price ($)", "ü"]) == [
        "a_b",
        "a_b_1",
        "a_b_2",
        "price____",
        "ü",
    ]


def test_latin1_csv(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_bytes("n,v\nJosé,1\nZoë,2\n".encode("latin-1"))
    assert readers.csv_encoding(spark, str(path)) == "ISO-8859-1"
    rows = readers.read_csv(spark, str(path)).orderBy("v").collect()
    assert [(r["n"], r["v"]) for r in rows] == [("José", 1), ("Zoë", 2)]
    path.write_bytes("n,v\nJosé �,1\n".encode())
    assert readers.csv_encoding(spark, str(path)) == "UTF-8"


def test_each_file_is_read_in_its_own_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("n,v\nMünchen,1\n".encode())
    (tmp_path / "b.csv").write_bytes("n,v\nKöln,2\n".encode("latin-1"))
    rows = {tuple(row) for row in readers.read_csv(spark, str(tmp_path)).collect()}
    assert rows == {("München", 1), ("Köln", 2)}
    rows = readers.read_csv(spark, str(tmp_path), schema="n string, v long").collect()
    assert {row["n"] for row in rows} == {"München", "Köln"}



def test_quoted_newlines_count_once(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n"x\ny",1\nz,2\n')
    df = readers.read_csv(spark, str(path), multi_line=True)
    assert readers.row_count(df).first()[0] == 2


def test_manifest_never_reads_content(spark, tmp_path):
    (tmp_path / "a.CSV").write_bytes(b"x" * 2048)
    (tmp_path / "b.txt").write_bytes(b"x")
    manifest = readers.file_manifest(spark, str(tmp_path), max_mb=0.0)
    plan = manifest._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    rows = {r["name"]: r for r in manifest.collect()}
    assert rows["a.CSV"]["extension"] == ".csv" and rows["a.CSV"]["is_allowed_type"]
    assert not rows["b.txt"]["is_allowed_type"]
    assert rows["a.CSV"]["size_bytes"] == 2048


def test_results_without_rows_become_lines(spark, tmp_path):
    results = spark.createDataFrame([("text", "one"), ("text", "two")], "type string, content string")
    sinks.write_csv(results, str(tmp_path / "out"), ["content"])
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ["one", "two"]


def test_dataset_names(spark):
    assert catalog.dataset_name("/x/y/sales.csv") == "sales"
    df = spark.createDataFrame([(1,)], "a int")
    catalog.register(spark, "/x/y/sales_small.csv", df)
    assert "sales_small" in catalog.registered(spark)
    assert spark.sql("SELECT sum(a) FROM sales_small").first()[0] == 1


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(2307).select(
        "id",
        F.concat(F.lit("person "), F.col("id").cast("string")).alias("name"),
        (F.col("id") % 7).cast("double").alias("score"),
        F.when(F.col("id") % 2 == 0, "even").alias("kind"),
    )


def test_row_chunks_cover_each_row_once(people):
    found = chunks.row_chunks(people, ["id"], "people", size=500).orderBy("chunk_no").collect()
    assert [(r["chunk_start_row"], r["chunk_end_row"]) for r in found] == [
        (0, 499),
        (500, 999),
        (1000, 1499),
        (1500, 1999),
        (2000, 2306),
    ]
    assert sum(r["text"].count("\nRow ") for r in found) == 2307
    assert "Row 0: id: 0; name: person 0; score: 0.0; kind: even;" in found[0]["text"]
    assert "Row 1: id: 1; name: person 1; score: 1.0;\n" in found[0]["text"]


@pytest.mark.parametrize(
    ("density", "length", "wanted"), [(0.9, 101, 250), (0.9, 100, 500), (0.2, 5, 1000), (0.5, 200, 500)]
)
def test_adaptive_size(density, length, wanted):
    assert chunks.adaptive_size(density, length, 1000, 200) == wanted


def test_build_chunks(people, tmp_path, spark):
    built = chunks.build_chunks(people, "people", ["id"])
    chunks.write_chunks(built, str(tmp_path / "chunks"))
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    counts = {r["chunk_type"]: r["count"] for r in stored.groupBy("chunk_type").count().collect()}
    assert counts == {"rows": 5, "column": 4, "summary": 1}
    column = stored.filter("chunk_id = 'people-column-score'").first()
    assert "mean=3.00" in column["text"] or "mean=2.99" in column["text"]
    assert "[NUMBER]" in column["embed_text"] and "mean=3" not in column["embed_text"]
    assert column["meta"]["data_type"] == "numeric"
    plan = stored.filter("chunk_type = 'column'")._jdf.queryExecution().executedPlan().toString()
    assert "chunk_type" in plan.split("PartitionFilters")[1]


def test_fixed_blocks_where_asked_for(spark):
    df = spark.range(300).select(
        "id", *[F.concat(F.lit(c), F.col("id").cast("string")).alias(c) for c in ("a", "b", "c")]
    )
    built = chunks.build_chunks(df, "wordy", ["id"], adaptive=False)
    built = built.filter("chunk_type = 'rows'").collect()
    assert len(built) == 1 and built[0]["text"].startswith("Data Table:")


def test_memory_defaults_and_history(spark, tmp_path):
    rows = [
        (None, None, None, "hello", None),
        ("s", "2", "assistant", "b", ("query", "d", "t")),
        ("s", "1", "user", "a", None),
    ]
    messages = spark.createDataFrame(
        rows,
        "session_id string, ts string, role string, text string, "
        "context struct<type: string, dataset_name: string, query_type: string>",
    )
    path = str(tmp_path / "memory")
    conversations.memory_write(messages, path)
    memory = spark.read.parquet(path)
    first = memory.filter("text = 'hello'").first()
    assert (first["session_id"], first["role"], first["analysis_context"]) == ("unknown", "user", "{}")
    assert first["ts"]
    assert json.loads(memory.filter("text = 'b'").first()["analysis_context"])["type"] == "query"
    history = conversations.session_history(memory, 1)
    assert {r["text"] for r in history.collect()} == {"hello", "a"}
    summary = {r["session_id"]: r for r in conversations.conversation_summary(memory).collect()}
    assert summary["s"]["total_messages"] == 2 and summary["s"]["n_query_types"] == 1
    assert summary["unknown"]["user_queries"] == 1


def test_cache_hits_per_search_run(spark):
    log = spark.createDataFrame(
        [(True, 1.0), (False, 2.0), (False, 4.0)], "cache_hit boolean, response_time double"
    )
    row = conversations.search_perf_stats(log).first()
    assert tuple(row) == (2, 3.0, 0.5)


def test_streams_equal_batches_as_files_arrive(spark, tmp_path):
    schema = "session_id string, ts timestamp, role string, text string"
    folder, out, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))

    def arrive(start):
        rows = spark.range(start, start + 100).select(
            (F.col("id") % 7).cast("string").alias("session_id"),
            (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("id"))).alias("ts"),
            F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
            F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
        )
        rows.coalesce(1).write.mode("append").parquet(folder)

    stream_schema = spark.createDataFrame([], schema).schema
    for start in (0, 100):
        arrive(start)
        stream = streams.arriving_files(spark, folder, stream_schema)
        summary = streams.session_summary(stream, out, progress)
        batch = spark.read.parquet(folder).groupBy("session_id").agg(
            F.count(F.lit(1)).alias("total_messages"),
            F.count_if(F.col("role") == "user").alias("user_queries"),
        )
        found = summary.select("session_id", "total_messages", "user_queries")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))
    assert len(os.listdir(os.path.join(out, "level=0"))) >= 2

    stream = streams.arriving_files(spark, folder, stream_schema)
    profile = streams.ingest_profile(stream, str(tmp_path / "p"), str(tmp_path / "pp"))
    counts = {r["column"]: (r["row_count"], r["non_null"]) for r in profile.collect()}
    assert counts == {name: (200, 200) for name in ("session_id", "ts", "role", "text")}


def test_streams_read_tables_of_one_file_or_many(spark, tmp_path):
    rows = spark.range(60).selectExpr(
        "id % 7 AS conv_id", "id AS turn", "if(id % 3 = 0, 'user', 'system') AS role", "'how many' AS text"
    )
    many, one = f"{tmp_path}/many", f"{tmp_path}/one"
    rows.repartition(3).write.parquet(f"{many}/conversations.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/made")
    os.makedirs(one)
    [part] = [name for name in os.listdir(tmp_path / "made") if name.startswith("part-")]
    os.rename(tmp_path / "made" / part, f"{one}/conversations.parquet")
    for folder in (many, one):
        found = talks.stream_session_summary(spark, folder)
        wanted = conversations.conversation_summary(talks.memory(spark, folder)).select(found.columns)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
        assert sum(row["total_messages"] for row in found.collect()) == 60
