"""Token counts and byte-level BPE against the public libraries."""

import base64
import hashlib
import time

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import ODD_TEXTS, collected, no_documents, odd_documents
from tabulary.llm import byte_bpe, token_counts

LIBRARY = Tokenizer.from_file(token_counts.VOCABULARY)
RANKS = {
    base64.b64decode(token): int(rank)
    for token, rank in map(bytes.split, open(byte_bpe.RANKS, "rb"))
}
TIKTOKEN = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)
COUNTER = token_counts.counter(token_counts.VOCABULARY)
ENCODER = byte_bpe.encoder(byte_bpe.RANKS, byte_bpe.PIECES)

TEXT = st.one_of(
    st.text(max_size=60),
    st.text(alphabet="abtheinr 's'llDN\n\t.,", max_size=80),
    st.text(alphabet="aA ßΣİé́ \x1c\x85 12²٣<|>", max_size=40),
    st.lists(
        st.sampled_from([*COUNTER.marks, *"aé ́.'sİ1\x1c\u0345가ᅡᆨ゙か", "<|endof", " don't", "ing"]),
        max_size=12,
    ).map("".join),
)
STATED = [
    "don't 'r 're DON'T they'll",
    "<|endoftext|>x <|startoftext|>",
    "a  b \n\n c\t d ",
    "\n \n x \t\t y",
    "İstanbul ΣΑΣ σς",
    "é á̧ Å",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa aaaa",
    "",
]


def library_count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", [*STATED, *(t for t in ODD_TEXTS if t)])
def test_count_and_encoding_of_stated_texts(text):
    assert COUNTER.count(text) == library_count(text)
    ids = ENCODER.encode(text)
    assert list(memoryview(ids).cast("I")) == TIKTOKEN.encode_ordinary(text)
    assert ENCODER.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_count_is_the_library_s(text):
    assert COUNTER.count(text) == library_count(text)


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_every_prefix_is_counted_as_if_encoded_alone(text):
    assert COUNTER.prefixes(text).tolist() == [
        library_count(text[:end]) for end in range(len(text) + 1)
    ]


@settings(max_examples=60, deadline=None)
@given(TEXT, st.integers(0, 12))
def test_longest_fitting_prefix(text, limit):
    counts = [library_count(text[:end]) for end in range(len(text) + 1)]
    expected = max(end for end, count in enumerate(counts) if count <= limit)
    assert COUNTER.fitting(text, limit) == expected


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_ids_are_the_library_s_and_decode_to_the_text(text):
    ids = ENCODER.encode(text)
    assert list(memoryview(ids).cast("I")) == TIKTOKEN.encode_ordinary(text)
    assert ENCODER.decode(ids) == text.encode()


def test_memo_is_bounded():
    from tabulary.llm.common import Memo

    memo = Memo(lambda key: key * 2, 3)
    assert [memo[n] for n in range(10)] == [n * 2 for n in range(10)]
    assert len(memo) <= 3
    short = Memo(str.upper, 100, longest=4)
    assert [short["x" * n] for n in range(50)] == ["X" * n for n in range(50)]
    assert max(map(len, short)) == 4


def test_text_without_spaces_is_not_remembered():
    text = "".join(chr(0x4E00 + n * 7 % 20_000) for n in range(20_000))
    assert COUNTER.count(text) == library_count(text)
    assert list(memoryview(ENCODER.encode(text)).cast("I")) == TIKTOKEN.encode_ordinary(text)
    for memo in (COUNTER.chunks, COUNTER.counts, ENCODER.chunks, ENCODER.pieces):
        assert max(map(len, memo), default=0) <= byte_bpe.LONGEST_KEPT


@pytest.mark.parametrize("odd", ["<|endoftext|>", "\x1c", "é", "e\u0301 "])
def test_prefixes_of_a_long_text_take_time_in_proportion(odd):
    """A megabyte that holds a mark, an odd blank or letters to compose."""
    text = odd + "some words and " * 70_000 + odd + " end"
    begun = time.process_time()
    counts = COUNTER.prefixes(text)
    assert time.process_time() - begun < 30
    assert counts[-1] == library_count(text) and len(counts) == len(text) + 1
    fitting = COUNTER.fitting(text, 2048)
    assert library_count(text[:fitting]) == 2048 and library_count(text[: fitting + 5]) > 2048


def test_token_counts_of_odd_rows(spark):
    df = odd_documents(spark)
    rows = collected(token_counts.token_counts(df, limit=100))
    assert len(rows) == df.count()
    for doc_id, n_bytes, n_tokens, over, fitting in rows:
        text = (ODD_TEXTS[doc_id] or "") if doc_id is not None else None
        if text is not None:
            assert (n_bytes, n_tokens) == (len(text.encode()), library_count(text))
            assert over == (n_tokens > 100)
            assert library_count(text[:fitting]) <= 100
            assert over or fitting == len(text)
    assert token_counts.token_counts(no_documents(spark)).count() == 0
    prefixes = collected(token_counts.prefix_counts(df.filter("length(text) < 50 or text is null")))
    for doc_id, counts in prefixes:
        if doc_id is not None:
            text = ODD_TEXTS[doc_id] or ""
            assert counts[-1] == library_count(text) and len(counts) == len(text) + 1


def test_round_trip_of_odd_rows(spark):
    df = odd_documents(spark)
    rows = byte_bpe.round_trip(df, with_ids=True).collect()
    assert len(rows) == df.count()
    for row in rows:
        if row.doc_id is not None:
            text = ODD_TEXTS[row.doc_id] or ""
            assert row.token_ids == TIKTOKEN.encode_ordinary(text)
            assert row.n_tokens == len(row.token_ids)
            assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    encoded = byte_bpe.encode(df)
    decoded = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(encoded).collect() if r.doc_id is not None}
    assert decoded == {n: (text or "").encode() for n, text in enumerate(ODD_TEXTS)}
    assert byte_bpe.round_trip(no_documents(spark)).count() == 0
