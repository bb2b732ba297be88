"""Filter orders replayed document by document."""

import random
import re
from collections import defaultdict
from itertools import permutations

from helpers import no_documents, odd_documents
from tabulary.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int, fails int"


def fails_of(rows):
    """The failed letters of each row: id, text, source."""
    out = []
    for own, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        met = set()
        if len(words) < 50:
            met.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            met.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            met.add("C")
        if re.search(r"[#$%&*|]", text):
            met.add("D")
        if own is not None and any(
            other is not None and other < own and (body or "") == text for other, body, _ in rows
        ):
            met.add("E")
        out.append(met)
    return out


def slow(rows, labels):
    good = {own for own, quality, _, *_ in labels if own is not None and quality == 1}
    toxic = {own for own, _, bad, *_ in labels if own is not None and bad == 1}
    found = defaultdict(lambda: [0] * 6)
    shapley = defaultdict(int)
    for (own, _, source), met in zip(rows, fails_of(rows), strict=True):
        part = source or ""
        for order in map("".join, permutations("ABCDE")):
            there = True
            for step, letter in enumerate(order, 1):
                sums, fail = found[part, order, step], letter in met
                removed = there and fail
                sums[0] += there and not fail
                sums[1] += removed
                sums[2] += fail and not there
                sums[3] += met == {letter}
                sums[4] += removed and own in good
                sums[5] += removed and own in toxic
                shapley[part, letter] += removed
                there = there and not fail
    return {
        (part, order, step): (*sums, shapley[part, order[step - 1]])
        for (part, order, step), sums in found.items()
    }


def told(df):
    names = [*filter_audit.MEASURES, "shapley"]
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[name] for name in names) for r in rows}
    assert len(out) == len(rows)
    return out


def test_against_a_replay(spark):
    source = random.Random(11)
    vocabulary = [f"w{n}" for n in range(90)] + ["ABC", "X#", "50%", "é", "Ñ"]
    rows = []
    for number in range(160):
        words = source.choices(vocabulary[: source.choice((20, 90, 95))], k=source.choice((0, 30, 50, 70)))
        text = source.choice((" ", "\t", "\n  ")).join(words)
        rows.append((number, source.choice((text, text.upper(), "the same text")), source.choice("ab")))
    rows += [(500, rows[0][1], None), (501, None, "a"), (502, "", "b"), (None, "the same text", "a")]
    labels = [(n, source.randint(0, 1), source.randint(0, 1), 1) for n in range(0, 160, 2)]
    labels += [(2, 1, None, 1), (2, 0, 0, 1), (None, 1, 1, 1), (9_999, 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = filter_audit.audit(df, spark.createDataFrame(labels, LABELS))
    assert told(found) == slow(rows, labels)


def test_odd_rows_and_repeated_ones(spark):
    df = odd_documents(spark)
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    none = spark.createDataFrame([], LABELS)
    found = told(filter_audit.audit(df, none))
    assert found == slow(rows, [])
    assert {part for part, _, _ in found} == {"", "src"}
    assert len(found) == 2 * 600
    assert filter_audit.audit(no_documents(spark), none).count() == 0


def test_a_long_text(spark):
    text = " ".join(str(n) for n in range(300_000))
    df = spark.createDataFrame([(1, text, "s"), (2, text, "t")], "doc_id long, text string, source string")
    found = told(filter_audit.audit(df, spark.createDataFrame([(2, 0, 1, 0)], LABELS)))
    assert found["s", "ABCDE", 5][:2] == (1, 0)
    assert found["t", "ABCDE", 5] == (0, 1, 0, 1, 0, 1, 120)


def test_own_conditions(spark):
    df = spark.createDataFrame([(1, "x", "s"), (2, "x", "s")], "doc_id long, text string, source string")
    none = spark.createDataFrame([], LABELS)
    found = told(filter_audit.audit(df, none, conditions={"S": lambda text, words: text == "x"}))
    assert found == {
        ("s", "SE", 1): (0, 2, 0, 1, 0, 0, 3),
        ("s", "SE", 2): (0, 0, 1, 0, 0, 0, 1),
        ("s", "ES", 1): (1, 1, 0, 0, 0, 0, 1),
        ("s", "ES", 2): (0, 1, 1, 1, 0, 0, 3),
    }
