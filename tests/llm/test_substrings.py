"""Removal of repeated passages of words against every window of every document."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import ODD_TEXTS, no_documents, odd_documents
from tabulary.llm import substrings


def slow(texts, length):
    """Words kept of each text, in the order given: the earlier text, then the earlier start."""
    seen, out = set(), []
    for text in texts:
        words = (text or "").encode().split()
        gone = np.zeros(len(words), dtype=bool)
        for start in range(len(words) - length + 1):
            window = tuple(words[start : start + length])
            if window in seen:
                gone[start : start + length] = True
            seen.add(window)
        out.append((len(words), int(gone.sum()), [w for w, g in zip(words, gone, strict=True) if not g]))
    return out


def check(found, expected):
    for row, (n, removed, kept) in zip(found, expected, strict=True):
        text = b" ".join(kept)
        assert (row.n_words, row.n_removed, row.kept) == (n, removed, text.decode())
        assert row.kept_sha256 == hashlib.sha256(text).hexdigest()
        assert sum(span.end - span.start for span in row.spans) == removed
        assert all(a.end < b.start for a, b in zip(row.spans, row.spans[1:]))


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30), max_size=8), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_automaton_knows_the_earliest_place(passages, length):
    seen, expected = set(), []
    for words in passages:
        own = []
        for start in range(len(words) - length + 1):
            window = tuple(words[start : start + length])
            if window not in seen:
                own.append(start)
            seen.add(window)
        expected.append(own)
    assert substrings.first_windows(passages, length) == expected


@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=25), st.lists(st.sampled_from([b"a", b"b", b"z"]), max_size=25))
@settings(max_examples=300, deadline=None)
def test_matching_statistics_of_a_foreign_text(reference, words):
    automaton = substrings.Automaton()
    automaton.add(reference, 0)
    for most in (3, 100):
        for end, (matched, first) in enumerate(automaton.matches(words, most), 1):
            held = [
                n for n in range(min(end, most) + 1)
                if any(reference[at - n : at] == words[end - n : end] for at in range(n, len(reference) + 1))
            ]
            assert matched == max(held)
            if matched:
                tail = words[end - matched : end]
                ends = [at - 1 for at in range(matched, len(reference) + 1) if reference[at - matched : at] == tail]
                assert first == ends[0]


def test_places_cover_every_window_once(monkeypatch):
    source = random.Random(1)
    rows = [[b"%d" % source.randrange(4) for _ in range(n)] for n in (3000, 0, 19, 20, 5, 700)]
    owner, grams, starts, counts = substrings.places(rows, 20, 8)
    assert counts.max() <= 13
    for number, words in enumerate(rows):
        own = owner == number
        assert starts[own].tolist() == np.cumsum([0, *counts[own][:-1]])[: own.sum()].tolist()
        assert counts[own].sum() == max(0, len(words) - 19)
        alone = substrings.places([words], 20, 8)
        assert [part.tolist() for part in alone[1:]] == [part[own].tolist() for part in (grams, starts, counts)]
    monkeypatch.setattr(substrings, "SLICE", 64)
    sliced = substrings.places(rows, 20, 8)
    assert [part.tolist() for part in sliced] == [part.tolist() for part in (owner, grams, starts, counts)]


def corpus(seed, n=120):
    source = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(60)]
    passages = [source.choices(vocabulary, k=source.randint(5, 60)) for _ in range(12)]
    texts = []
    for _ in range(n):
        kind = source.random()
        if kind < 0.2 and texts:
            words = (source.choice(texts)).split()
            for _ in range(source.randint(0, 3)):
                if words:
                    words[source.randrange(len(words))] = source.choice(vocabulary)
        else:
            words = []
            for _ in range(source.randint(0, 4)):
                words += source.choices(vocabulary, k=source.randint(0, 30))
                words += source.choice(passages) * source.choice((1, 1, 2))
        texts.append(source.choice((" ", "\n", " \t ")).join(words))
    return texts


def test_documents_against_every_window(spark):
    texts = corpus(7) + ["x " * 500, "x y " * 90, "x " * 19, "x " * 20, *[t or "" for t in ODD_TEXTS]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for length, gram in ((20, 8), (6, 3), (3, 1)):
        found = substrings.remove_repeats(df, length, gram=gram).orderBy("doc_id").collect()
        check(found, slow(texts, length))


def test_hot_grams_and_small_shards(spark, monkeypatch):
    """One common line among words of its own in each document, and passages beyond it."""
    source = random.Random(8)
    line = [f"l{n}" for n in range(10)]
    texts = []
    for _ in range(150):
        own = [f"w{source.randrange(30)}" for _ in range(40)]
        texts.append(" ".join(own[:20] + line + own[20:]))
    texts += [texts[n] + " tail" for n in range(0, 150, 7)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = slow(texts, 12)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 50)
    check(substrings.remove_repeats(df, 12, gram=4).orderBy("doc_id").collect(), expected)
    monkeypatch.setattr(substrings, "HOT_GRAM", 5)
    check(substrings.remove_repeats(df, 12, gram=4).orderBy("doc_id").collect(), expected)


def test_a_text_beyond_one_slice(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE", 64)
    monkeypatch.setattr(substrings, "BLOCK_WORDS", 100)
    texts = [" ".join(corpus(9, 40)), " ".join(corpus(9, 30)), "few words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(substrings.remove_repeats(df).orderBy("doc_id").collect(), slow(texts, 20))


def test_null_ids_repeated_rows_and_other_types(spark):
    text = " ".join(f"w{n}" for n in range(30))
    rows = [(5, text), (5, text), (7, text), (None, text), (None, text + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.n_removed) for r in substrings.remove_repeats(df).collect()]
    assert sorted(found, key=str) == sorted([(5, 0), (5, 0), (7, 30), (None, 30), (None, 30)], key=str)
    nameless = spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string")
    assert [r.n_removed for r in substrings.remove_repeats(nameless).collect()] == [0, 0]
    named = spark.createDataFrame([("b", text), ("a", text)], "name string, body string")
    found = substrings.remove_repeats(named, id_col="name", text_col="body", keep=False).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept) for r in found) == [("a", 0, None), ("b", 30, None)]


def test_odd_and_no_documents(spark):
    df = odd_documents(spark)
    rows = substrings.remove_repeats(df).collect()
    assert len(rows) == df.count()
    assert {r.n_words for r in rows if r.doc_id in (0, 1, 2, 3)} == {0}
    assert substrings.remove_repeats(no_documents(spark)).count() == 0
