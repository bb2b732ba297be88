"""Archives by round trip, and the merged index by sorting."""

import base64
import hashlib
import random
from itertools import chain

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulary.llm import warc


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), max_size=8), max_size=9))
def test_loser_tree_merges_sorted_runs(runs):
    tree = warc.LoserTree([iter(sorted(run)) for run in runs])
    assert list(tree) == sorted(chain(*runs))


def pages(spark):
    source = random.Random(11)
    rows = []
    for n in range(300):
        html = source.choice(["", None, "<p>same</p>", f"<p>{n}</p>\r\n\r\nWARC/1.1\r\n\r\n", "é🎉" * 50])
        url = source.choice(["http://b.example.com/x", "https://www.a.example.org/?q=1", None, "bad url\nhttp://[", f"http://c.de/{n}"])
        rows.append((n, url, html, 1))
    rows += [(7, rows[7][1], rows[7][2], 1), (None, "http://n.de/", "<p>same</p>", 1), (None, None, None, None)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(5)


def test_round_trip(spark):
    rows, df = pages(spark)
    found = warc.archive(df).collect()
    assert len(found) == len(rows)
    best = {}
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        best[data] = max(best.get(data, -1), -1 if page_id is None else page_id)
    expected = []
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        response = page_id == best[data]
        expected.append((page_id, len(data), digest, "response" if response else "revisit", None if response else best[data]))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)
    order = [(r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0) for r in found]
    assert order == sorted(order)
    histories = {r.url_key: r.captures for r in warc.histories(warc.archive(df)).collect()}
    assert sum(histories.values()) == len(rows)


def test_small_payloads_may_stay_responses(spark):
    _, df = pages(spark)
    found = warc.archive(df, least_bytes=10_000).collect()
    assert {r.record_type for r in found} == {"response"}


def test_empty_table(spark):
    _, df = pages(spark)
    assert warc.archive(df.limit(0)).count() == 0


def test_url_keys():
    assert warc.url_key("http://www.Example.com/A?b=C") == "com,example)/a?b=c"
    assert warc.url_key("https://m.example.com:8080") == "com,example,m:8080)/"
    assert warc.url_key("not a url") == ")not a url"


def test_records_are_made_a_few_at_a_time():
    n = 3 * warc.ROWS + 1
    names = ["page_id", "url", "html", "digest", "kept_id", "response"]
    columns = [[*range(n)], ["http://a.de/"] * n, ["<p>"] * n, [hashlib.sha1(b"<p>").hexdigest()] * n, [None] * n, [True] * n]
    made = list(warc.recorded(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)])))
    assert [batch.num_rows for batch in made] == [warc.ROWS] * 3 + [1]
    found = [int(data["page_id"]) for batch in made for v in batch.column(0).to_pylist() for data in warc.parsed(v)]
    assert found == [*range(n)]
