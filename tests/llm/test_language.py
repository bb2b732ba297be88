"""Language identification by accuracy on held-out rows, and by the definition on small ones."""

import os
import tracemalloc

import numpy as np
import pytest

from helpers import no_documents, odd_documents
from tabulary.llm import language

FOLDER = "/root/testdata/sf0.01"


def slow_profile(text, width):
    """The bundled vector by its definition, letter by letter."""
    letters, table = language.letter_vectors(width), language.symbols()
    points = [0, *(int(table[ord(c)]) for c in text), 0]
    total = np.zeros(width)
    for before, own, after in zip(points, points[1:], points[2:]):
        if own:
            total += np.roll(letters[before], 2) * np.roll(letters[own], 1) * letters[after]
    return total


def test_profiles_follow_the_definition():
    rows = ["the cat", "", "12 !", "ünïcode 日本", "a" * 300]
    found = np.concatenate([v for _, v in language.profiles(rows, 64)])
    assert np.allclose(found, [slow_profile(row, 64) for row in rows])


def test_profiles_of_more_runs_than_are_held_at_once(monkeypatch):
    rows = ["".join(chr(0x4E00 + (n * n + k) % 20_000) for n in range(400)) for k in range(3)]
    whole = np.concatenate([v for _, v in language.profiles(rows, 64)])
    monkeypatch.setattr(language, "RUNS_AT_ONCE", 50)
    assert (np.concatenate([v for _, v in language.profiles(rows, 64)]) == whole).all()
    assert np.allclose(whole, [slow_profile(row, 64) for row in rows])


def test_memory_of_text_without_spaces_is_bounded():
    text = "".join(chr(0x4E00 + n * n * 31 % 20_000) for n in range(300_000))
    tracemalloc.start()
    ((_, found),) = language.profiles([text], language.WIDTH)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.any() and peak < 400_000_000


def test_prediction_is_the_largest_cosine(spark):
    df = spark.createDataFrame(
        [(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (3, None, "fr"), (4, "x", None)],
        "doc_id long, text string, lang string",
    )
    learned = language.learn(df)
    assert set(learned) == {"en", "de"}
    assert np.allclose(learned["de"], slow_profile("der hund und die katze", language.WIDTH))
    rows = {r.doc_id: r for r in language.identify(df, learned).collect()}
    for n, text in ((1, "the cat sat on the mat"), (2, "der hund und die katze")):
        vector = slow_profile(text, language.WIDTH)
        cosine = {
            name: vector @ own / np.linalg.norm(vector) / np.linalg.norm(own)
            for name, own in learned.items()
        }
        assert rows[n].lang_pred == max(cosine, key=cosine.get)
        assert rows[n].score == pytest.approx(max(cosine.values()), abs=1e-5)
    assert (rows[3].lang_pred, rows[3].score) == ("und", 0.0)


def test_odd_rows(spark):
    df = odd_documents(spark)
    rows = language.identify(df, language.learn(df)).collect()
    assert len(rows) == df.count()
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[n].lang_pred == "und" and by_id[n].score == 0 for n in range(4))
    assert all(0 <= r.score <= 1 for r in rows)
    assert language.identify(no_documents(spark), language.learn(df)).count() == 0
    none = language.learn(no_documents(spark))
    assert none == {} and {r.lang_pred for r in language.identify(df, none).collect()} == {"und"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_accuracy_on_held_out_rows(spark):
    from tabulary.llm import queries

    found = queries.QUERIES["op5_language"](spark, FOLDER).filter("held_out")
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = found.join(documents, "doc_id").collect()
    assert len(rows) > 150
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) >= 0.98
