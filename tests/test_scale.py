"""Hot keys, wide rows, large numbers and many batches, against plain answers."""

import os
import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tabulary.operators import chunks, collections, conversations, profile, stats
from tabulary.operators import keyword_index
from tabulary.operators.keyword_index import KeywordIndex
from tabulary.operators.quantiles import exact_quantiles
from tabulary.operators.rowindex import with_number_in_key
from tabulary.streaming import streams


def test_numbers_within_a_hot_key_come_from_several_tasks(spark):
    source = random.Random(1)
    rows = [(None if n % 5 == 0 else "hot" if n % 3 else f"k{n % 11}", source.random(), n) for n in range(4000)]
    df = spark.createDataFrame(rows, "k string, v double, n long").repartition(7)
    numbered = with_number_in_key(df, ["k"], ["v"], "no").withColumn("task", F.spark_partition_id())
    found = numbered.collect()
    expected = {}
    for key in {k for k, _, _ in rows}:
        own = sorted((v, n) for k, v, n in rows if k == key)
        expected |= {n: place for place, (_, n) in enumerate(own, 1)}
    assert {r["n"]: r["no"] for r in found} == expected
    assert numbered.columns == ["k", "v", "n", "no", "task"]
    assert with_number_in_key(df.limit(0), ["k"], ["v"], "no").count() == 0


def test_history_of_one_session_with_a_third_of_all_messages(spark):
    memory = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 100)).alias("session_id"),
        F.when(F.col("id") % 50 > 0, F.lpad((F.col("id") * 7919 % 3000).cast("string"), 5, "0")).alias("ts"),
        F.lit("user").alias("role"),
        F.col("id").cast("string").alias("text"),
        F.lit("{}").alias("analysis_context"),
    )
    found = conversations.session_history(memory)
    hot = found.filter("session_id = 'hot'").orderBy("message_no").collect()
    assert [r["message_no"] for r in hot] == list(range(1, 1001))
    order = [(r["ts"] is not None, r["ts"] or "", r["text"]) for r in hot]
    assert order == sorted(order)


def test_smallest_values_are_counted_whole(spark):
    source = random.Random(2)
    rows = [
        (source.choice([None, "é", "b" * source.randint(1, 9), "a", "Z"]), source.choice([None, float("nan"), -0.0, 0.0, 1.5, source.random()]), source.randint(-50, 50))
        for _ in range(3000)
    ]
    df = spark.createDataFrame(rows, "t string, x double, n int").repartition(6)
    found = {}
    for r in profile.sample_values(df, n=4).collect():
        found.setdefault(r["column"], {})[r["rank"]] = r["value"], r["n"]
    for place, name in enumerate(df.columns):
        known = [row[place] for row in rows if row[place] is not None and row[place] == row[place]]
        smallest = sorted(set(known), key=lambda v: v.encode() if isinstance(v, str) else v)[:4]
        assert [n for _, n in (found[name][rank] for rank in range(1, 5))] == [known.count(v) for v in smallest]
        shown = [value for value, _ in (found[name][rank] for rank in range(1, 5))]
        assert shown == smallest if name == "t" else [float(v) for v in shown] == smallest
    plan = profile.sample_values(df)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    assert profile.sample_values(df.limit(0)).count() == 0


def test_sums_and_extremes_keep_all_digits(spark):
    big = (1 << 62) + 1
    rows = [(big + n, Decimal(f"{10**26 + n}.1234567891"), n, 0.5) for n in range(50)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "a long, d decimal(38,10), i int, x double")
    found = {(r["column"], r["stat"]): (r["value"], r["exact"]) for r in stats.stats_table(df).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (a BIGINT, d DECIMAL(38,10), i INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    for column in ("a", "d", "i"):
        for stat in ("sum", "min", "max"):
            value, exact = con.execute(f"SELECT {stat}({column})::DOUBLE, {stat}({column})::VARCHAR FROM t").fetchone()
            assert found[column, stat] == (value, exact)
    assert found["x", "sum"] == (25.0, None) and found["a", "mean"][1] is None
    assert found["a", "mean"][0] == float(sum(big + n for n in range(50))) / 50
    wide = spark.createDataFrame([(Decimal(9 * 10**37),)] * 3, "d decimal(38,0)")
    found = {r["stat"]: (r["value"], r["exact"]) for r in stats.stats_table(wide).collect()}
    assert found["sum"] == (pytest.approx(2.7e38), None) and found["max"][1] == str(9 * 10**37)


def test_blocks_are_cut_by_length(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_LENGTH", 200)
    rows = [(n, "x" * (1000 if n == 7 else 3)) for n in range(60)]
    df = spark.createDataFrame(rows, "id long, t string")
    found = chunks.row_chunks(df, ["id"], "s", size=25).orderBy("chunk_no", "chunk_part").collect()
    header = len("Data Table:\nColumns: id, t\n\n")
    bodies = [r["text"][header:] for r in found]
    assert max(map(len, bodies)) <= 200
    lines = [f"Row {n}: id: {n}; t: {t};" for n, t in rows]
    for number in range(3):
        own = [(r["chunk_part"], body, r) for r, body in zip(found, bodies, strict=True) if r["chunk_no"] == number]
        assert [part for part, _, _ in own] == list(range(len(own)))
        text = "".join(body + ("\n" if len(body) < 200 else "") for _, body, _ in own)
        assert text.replace("\n", "") == "".join(lines[25 * number : 25 * number + 25])
        assert own[0][2]["chunk_start_row"] == 25 * number and own[-1][2]["chunk_end_row"] == min(59, 25 * number + 24)
    built = chunks.build_chunks(df, "s", ["id"], adaptive=False)
    ids = [r["chunk_id"] for r in built.select("chunk_id").collect()]
    assert len(ids) == len(set(ids))


def test_a_very_wide_cell_and_very_many_short_rows(spark):
    wide = spark.range(3).select("id", F.when(F.col("id") == 1, F.repeat(F.lit("y"), 30_000_000)).otherwise("z").alias("t"))
    lengths = chunks.row_chunks(wide, ["id"], "s").select(F.length("text").alias("n")).collect()
    assert sum(r["n"] for r in lengths) > 30_000_000 and max(r["n"] for r in lengths) < 4_100_000
    many = spark.range(300_000).withColumn("t", F.lit("z"))
    found = chunks.row_chunks(many, ["id"], "s").agg(F.sum("chunk_size"), F.count(F.lit(1))).first()
    assert tuple(found) == (300_000, 300)


def test_quantiles_read_the_input_three_times_at_most(spark, monkeypatch):
    source = random.Random(4)
    values = [1 + source.random() * 1e-9 for _ in range(30_000)] + [1.0] * 10
    df = spark.createDataFrame([(v, n % 2) for n, v in enumerate(values)], "v double, g int")
    for by in ([], ["g"]):
        found = {tuple(r[b] for b in by): r["value"] for r in exact_quantiles(df, ["v"], [0.5], by).collect()}
        for key, value in found.items():
            own = sorted(v for n, v in enumerate(values) if not key or n % 2 == key[0])
            middle = (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2
            assert value == pytest.approx(middle, rel=1e-15)


def documents(spark, n):
    return spark.range(n).select(
        F.col("id").cast("string").alias("id"),
        F.concat(F.lit("text "), F.col("id")).alias("document"),
        F.lit("src").alias("source"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("c d"), F.col("id") % 4)).alias("collection"),
    )


def files(path):
    return {os.path.join(folder, f) for folder, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_merge_rewrites_only_folders_with_a_changed_id(spark, tmp_path):
    path = str(tmp_path / "docs")
    collections.add_documents(documents(spark, 1000), path)
    before = files(path)
    changes = spark.createDataFrame([("7", "new"), ("12", None), ("9999", "x")], "id string, document string")
    removed = spark.createDataFrame([("3",), ("8",), ("8888",)], "id string")
    touched = collections.merge_documents(spark, path, changes, removed)
    assert 2 <= touched <= 4
    after = files(path)
    assert len(before - after) == touched and len(before & after) == len(before) - touched
    rows = {r["id"]: r["document"] for r in spark.read.parquet(path).collect()}
    expected = {str(n): f"text {n}" for n in range(1000) if n not in (3, 8)} | {"7": "new"}
    assert rows == expected
    assert collections.merge_documents(spark, path, changes.filter("id = '9999'")) == 0
    assert files(path) == after


def test_merge_empties_folders(spark, tmp_path):
    path = str(tmp_path / "docs")
    collections.add_documents(documents(spark, 200), path)
    gone = documents(spark, 200).filter("collection IS NULL OR collection = 'c d2'").select("id")
    collections.merge_documents(spark, path, removed=gone)
    left = spark.read.parquet(path)
    assert left.count() == 100 and {r[0] for r in left.select("collection").distinct().collect()} == {"c d1", "c d3"}


def test_cover_takes_few_folders_and_every_batch():
    for batches in range(1, 1300):
        found = streams.cover(batches)
        held = [n for level, part in found for n in range(part * 10**level, (part + 1) * 10**level)]
        assert held == list(range(batches)) and len(found) <= 9 * 4


def test_many_batches_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FAN", 3)
    folder, out, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    schema = "session_id string, role string"
    for n in range(10):
        rows = spark.range(20).select((F.col("id") % 5 + n).cast("string").alias("session_id"), F.lit("user").alias("role"))
        rows.coalesce(1).write.mode("append").parquet(folder)
        stream = streams.arriving_files(spark, folder, spark.createDataFrame([], schema).schema)
        summary = streams.session_summary(stream, out, progress)
    assert streams.cover(10) == [(2, 0), (0, 9)]
    assert sorted(os.listdir(out)) == ["level=0", "level=1", "level=2"]
    read = {f.split("/out/")[1].rsplit("/", 1)[0] for f in summary.inputFiles()}
    assert read == {"level=2/part=0", "level=0/part=9"}
    expected = spark.read.parquet(folder).groupBy("session_id").count()
    found = summary.select("session_id", "total_messages")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_keyword_index_finds_all_pairs(spark, least):
    source = random.Random(5)
    vocabulary = [f"w{n}" for n in range(40)] + ["the"] * 30
    texts = [" ".join(source.choices(vocabulary, k=source.choice((0, 1, 5, 12, 20)))) for _ in range(150)]
    texts += [texts[n] for n in range(0, 150, 9)] + ["THE w1\tw2", "the w1 w2", None]
    asked = [(n, t) for n, t in enumerate(texts) if n % 5 == 0] + [(1000, "unknown words only"), (1001, "the")]
    sets = [set((t or "").lower().split()) for t in texts]
    expected = {}
    for q, text in asked:
        own = set((text or "").lower().split())
        for n, other in enumerate(sets):
            if own and other and round(len(own & other) / len(own | other), 9) >= least:
                expected[q, n] = len(own & other) / len(own | other)
    store = spark.createDataFrame(list(enumerate(texts)), "id long, document string")
    queries = spark.createDataFrame(asked, "query_id long, query_text string")
    found = KeywordIndex.build(store).search(queries, least)
    assert {(r["query_id"], r["id"]): r["keyword_score"] for r in found.collect()} == expected
    assert found.count() == len(expected)


@pytest.mark.parametrize("blocks", [1, 3])
def test_keyword_search_moves_no_word_sets(spark, monkeypatch, blocks):
    source = random.Random(6)
    texts = [" ".join(f"w{source.randrange(3 * k)}" for _ in range(k)) for k in (3, 9, 30, 200, 700) * 12]
    texts += texts[:20] * 3 + [f"{text} more" for text in texts[:20]]
    sets = [set(text.split()) for text in texts]
    bytes_asked = sum(8 * len(words) for words in sets[::4])
    monkeypatch.setattr(keyword_index, "ASKED_BYTES", bytes_asked // blocks + blocks)
    monkeypatch.setattr(keyword_index, "CELLS", 1 << 12)
    monkeypatch.setattr(keyword_index, "PAIRS", 50)
    store = spark.createDataFrame(list(enumerate(texts)), "id long, document string")
    queries = store.filter("id % 4 = 0").toDF("query_id", "query_text")
    found = KeywordIndex.build(store).search(queries, 0.5)
    scores = {
        (q, n): len(sets[q] & own) / len(sets[q] | own) for q in range(0, len(sets), 4) for n, own in enumerate(sets)
    }
    assert {tuple(row[:2]): row[2] for row in found.collect()} == {k: v for k, v in scores.items() if v >= 0.5}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
