"""Benchmark passages against a search word by word, and the corpus pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import no_documents, odd_documents
from tabulary.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_hits(texts, items, window=10):
    windows = {}
    for item, text in items:
        words = slow_words(text)
        for start in range(max(1, len(words) - window + 1)) if words else ():
            windows.setdefault(tuple(words[start : start + window]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for text in texts:
        words, hit, found = slow_words(text), set(), set()
        for start in range(len(words)):
            for length in lengths:
                own = windows.get(tuple(words[start : start + length]))
                if own and start + length <= len(words):
                    hit.update(range(start, start + length))
                    found |= own
        out.append((len(words), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 5), min_size=1, max_size=4))
def test_index_finds_every_place(values, pattern):
    text, pattern = np.array(values), np.array(pattern)
    index = decontaminate.FmIndex(text, every=3)
    low, high = index.search(pattern[::-1][None, :], np.array([len(pattern)]))
    places = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert places == [
        n for n in range(len(values) - len(pattern) + 1) if values[n : n + len(pattern)] == pattern.tolist()
    ]


def tables(seed):
    source = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(12)] + ["Ünï", "x9"]
    words = lambda n: [source.choice(vocabulary) for _ in range(n)]
    items = [(n, " ".join(words(source.randint(0, 25)))) for n in range(30)]
    items += [(40, "w1"), (41, "w2, W3"), (42, None), (43, ""), (None, " ".join(words(14))), items[3]]
    texts = []
    for _ in range(80):
        parts = words(source.randint(0, 60))
        if source.random() < 0.5:
            parts += source.choice(items)[1:2] if source.choice(items)[1] else []
        texts.append(" - ".join(filter(None, parts)).upper() if source.random() < 0.3 else " ".join(filter(None, parts)))
    return texts + [None, "", texts[0]], items


@pytest.mark.parametrize(("seed", "short", "block_bytes"), [(1, True, 1 << 20), (2, False, 1 << 20), (3, True, 300)])
def test_against_search_word_by_word(spark, seed, short, block_bytes):
    texts, items = tables(seed)
    if not short:
        items = [(n, t) for n, t in items if t and len(slow_words(t)) > 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(docs, benchmark, block_bytes=block_bytes).collect()
    expected = slow_hits(texts, items)
    assert len(rows) == len(texts)
    for row in rows:
        assert (row.n_words, row.n_hit, row["items"]) == expected[row.doc_id]


def test_odd_rows_and_empty_tables(spark):
    df = odd_documents(spark)
    benchmark = spark.createDataFrame([(1, "the same words " * 4), (2, None), (None, "tie")], "item_id long, text string")
    rows = decontaminate.contamination(df, benchmark).collect()
    assert len(rows) == df.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[7].n_hit == by_id[7].n_words == 1200 and by_id[7]["items"] == ["1"]
    assert by_id[8].n_hit == 1 and by_id[8]["items"] == []
    assert by_id[0].n_words == 0
    assert decontaminate.contamination(no_documents(spark), benchmark).count() == 0
    rows = decontaminate.contamination(df, benchmark.limit(0)).collect()
    assert len(rows) == df.count() and not any(r.n_hit for r in rows)


def test_passages_are_cut_out(spark):
    passage = " ".join(f"p{n}" for n in range(12))
    texts = [f"Before, it. {passage}! After\nit.", "clean é text", None, passage]
    docs = spark.createDataFrame([(n, t, n) for n, t in enumerate(texts)], "doc_id long, text string, spans int")
    benchmark = spark.createDataFrame([(1, passage.upper())], "item_id long, text string")
    cleaned = decontaminate.cleaned(docs, benchmark)
    assert cleaned.columns == docs.columns
    rows = {r.doc_id: r.text for r in cleaned.collect()}
    assert rows == {0: "Before, it. ! After\nit.", 1: "clean é text", 2: None, 3: ""}


def test_passages_of_many_blocks_and_repeated_items(spark, monkeypatch):
    """Blocks hold no more than they may, however often an item is repeated."""
    passages = [" ".join(f"p{k}w{n}" for n in range(12)) for k in range(30)]
    texts = [f"start {passages[n % 30]} mid {passages[(n * 7 + 1) % 30]} end" for n in range(60)]
    texts += ["clean", None, texts[0], ""]
    docs = spark.createDataFrame([(n % 62, t, {"k": n}) for n, t in enumerate(texts)], "doc_id long, text string, extra map<string,int>")
    items = [(n, p) for n, p in enumerate(passages)] + [(3, passages[3])] * 2000
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate.cleaned(docs, benchmark).collect()))
    held = []
    shared = decontaminate._shared

    def watched(rows, own, window):
        held.append(sum(len(r.text) for r in rows.filter(own).collect()))
        return shared(rows, own, window)

    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    monkeypatch.setattr(decontaminate, "_shared", watched)
    assert sorted(map(str, decontaminate.cleaned(docs, benchmark).collect())) == whole
    assert len(held) > 3 and max(held) <= 500 and sum(held) == sum(map(len, passages))


FOLDER = "/root/testdata/sf0.001"


def test_query(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()
    expected = dict(zip((d.doc_id for d in documents), slow_hits([d.text for d in documents], benchmark), strict=True))
    for row in queries.QUERIES["op10_decontaminate"](spark, FOLDER).collect():
        n_words, n_hit, items = expected[row.doc_id]
        digest = hashlib.sha256(",".join(items).encode()).hexdigest()
        assert (row.n_words, row.n_hit, row.n_items, row.items_sha256) == (n_words, n_hit, len(items), digest)
        assert row.contaminated == (n_hit > 0)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    source = random.Random(12)
    english = "the of and that with from this have are was".split()
    passage = " ".join(f"bench{source.choice('abcdef')}{n}" for n in range(15))
    text = lambda: " ".join(source.choice(english) + source.choice("abc") for _ in range(60))
    same = text()
    rows = [(n, text(), "en", "s", 0) for n in range(10)]
    rows += [(10, same, None, "s", 0), (11, same, "en", "s", 0), (12, f"{text()} {passage}.", "en", "s", 0)]
    rows += [(13, passage, "en", "s", 0), (14, f"{text()} token=abcdef123456", "en", "s", 0), (15, "12 34 !", "en", "s", 0)]
    rows += [(16, None, "en", "s", 0), (17, "рыба и мясо", None, "s", 0), rows[0]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "encoding":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept[name] = sorted(r.doc_id for r in docs.collect())
        if name != "encoding":
            docs = spark.createDataFrame(docs.collect(), schema)
    assert kept["language"] == sorted([0, *range(15)])
    assert kept["near_duplicates"] == [*range(11), 12, 13, 14]
    assert kept["decontamination"] == [*range(11), 12, 14]
    assert kept["secrets"] == kept["encoding"] == kept["decontamination"]
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in ran) == kept["encoding"]
    digests = {r.doc_id: r.decoded_sha256 for r in ran}
    assert digests[12] == hashlib.sha256((rows[12][1].replace(passage, "")).encode()).hexdigest()
    assert digests[14] == hashlib.sha256(rows[14][1].replace("token=abcdef123456", "[assign]").encode()).hexdigest()
    assert digests[3] == hashlib.sha256(rows[3][1].encode()).hexdigest()


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    odd = odd_documents(spark)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, no_documents(spark)):
        for _, stage in corpus_pipeline.STAGES:
            count = docs.count()
            docs = stage(spark, docs, str(tmp_path))
            assert docs.count() <= count
