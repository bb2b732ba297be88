"""Fill-in-the-middle texts against a plain reading of the definition, and back again."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import ODD_TEXTS, no_documents, odd_documents
from tabulary.llm import fill_middle


def slow(text, name):
    """Form, prefix, middle and output by slicing."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    digits = hashlib.sha256(f"1:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[n : n + 8], 16) for n in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or h3 % 100 >= 90 or any(mark in text for mark in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@given(st.text(alphabet="ab Z<>PSM\n,é日🎉0[`{@", max_size=40), st.integers(0, 10**6))
@settings(max_examples=600, deadline=None)
def test_any_text_comes_back(text, name):
    n, form, prefix, middle, output = fill_middle.transform(text.encode(), str(name))
    assert (n, form, prefix, middle, output.decode()) == slow(text, name)
    assert fill_middle.restore(output, form).decode() == text


def test_halves_of_a_sentinel_at_a_cut():
    forms = set()
    for name in range(3000):
        text = "<P S> <S M> <M P> <<>> P><S"
        _, form, _, _, output = fill_middle.transform(text.encode(), str(name))
        forms.add(form)
        assert fill_middle.restore(output, form).decode() == text
    assert forms == {"plain", "psm", "spm"}


def test_rotation_of_blocks_longer_than_one_step():
    source = np.random.default_rng(3).integers(0, 256, 5 * fill_middle.BLOCK + 7, dtype=np.uint8)
    for middle in (0, 1, fill_middle.BLOCK, 3 * fill_middle.BLOCK + 5, len(source)):
        data = bytearray(source.tobytes())
        fill_middle.rotate(data, 0, middle, len(data))
        assert bytes(data) == source[middle:].tobytes() + source[:middle].tobytes()
        fill_middle.rotate(data, 0, len(data) - middle, len(data))
        assert bytes(data) == source.tobytes()


def test_table_of_odd_rows(spark):
    extra = "é <P> not cut", "日本語 text " * 200_000
    rows = [*enumerate(ODD_TEXTS), *((100 + n, text) for n, text in enumerate(extra))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = fill_middle.fill_in_middle(df)
    found = {r.doc_id: r for r in fill_middle.restored(made).collect()}
    assert len(found) == len(rows)
    for name, text in rows:
        row = found[name]
        got = row.n, row.form, row.prefix_chars, row.middle_chars, row.output
        assert got == slow(text or "", name)
        assert row.restored == (text or "")


def test_repeated_rows_null_ids_and_extra_columns(spark):
    df = odd_documents(spark)
    made = fill_middle.fill_in_middle(df)
    rows = made.collect()
    assert len(rows) == df.count()
    nameless = [r for r in rows if r.doc_id is None]
    assert {r.output for r in nameless if r.n == 0} == {""}
    assert [r.form for r in nameless if r.n == 0] == ["plain"]
    assert [tuple(r) for r in rows if r.doc_id == 4][0] == [tuple(r) for r in rows if r.doc_id == 4][1]
    empty = fill_middle.fill_in_middle(no_documents(spark))
    assert fill_middle.restored(empty).count() == 0
    named = spark.createDataFrame([("x", "some words")], "name string, body string")
    assert fill_middle.fill_in_middle(named, id_col="name", text_col="body").first().doc_id == "x"
