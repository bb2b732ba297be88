"""Byte-level BPE encoding by backtracking over longest matches, and decoding.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton holds the tokens as strings. From
each position the longest token is tried first; a token stays if it may follow the one before
it, else the next shorter one is tried, and positions from which nothing fits are remembered.
The result is the sequence that merging pairs by rank gives, in time linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tabulary.llm.common import Memo, map_batches, picked, texts
from tabulary.llm.merges import Merges

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.PATTERN
CHUNKS_KEPT, PIECES_KEPT = 80_000, 250_000
#: Characters of the longest text that is remembered.
LONGEST_KEPT = 48

#: Marks that end most words; with the stated pattern such a word is two pieces.
STOPS = tuple(".,;:!?")
#: White space beside a space: only then may the pieces of a text cross its spaces.
TOUCHING = re.compile(r" \s|\s ")


class Encoder:
    """Encodes and decodes by the ranks of one file."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks: dict[str, int] = {}
        with open(path, "rb") as file:
            for line in file:
                token, rank = line.split()
                self.ranks[base64.b64decode(token).decode("latin-1")] = int(rank)
        self.strings = {rank: token for token, rank in self.ranks.items()}
        self.bytes = {rank: token.encode("latin-1") for rank, token in self.strings.items()}
        self.size = {rank: len(token) for token, rank in self.ranks.items()}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.pairs = Merges(self._rank, self._split).pairs
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.shorter = Memo(self._shorter, 200_000)
        self.pattern = regex.compile(pattern)
        self.own = pattern == PIECES
        self.pieces = Memo(self._whole, PIECES_KEPT, LONGEST_KEPT)
        self.chunks = Memo(self._chunk, CHUNKS_KEPT, LONGEST_KEPT)

    def _rank(self, left: int, right: int) -> int | None:
        return self.ranks.get(self.strings[left] + self.strings[right])

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge is ``token``; a byte has none."""
        if token not in self.splits:
            parts = [self.ranks[letter] for letter in self.strings[token]]
            while len(parts) > 2:
                merged = [
                    (rank, place)
                    for place in range(len(parts) - 1)
                    if (rank := self._rank(parts[place], parts[place + 1])) is not None
                    and rank < token
                ]
                if not merged:
                    raise ValueError(f"token {token} can't be merged from its bytes")
                rank, place = min(merged)
                parts[place : place + 2] = [rank]
            self.splits[token] = tuple(parts) if len(parts) == 2 else None
        return self.splits[token]

    def _shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of ``token``."""
        body = self.strings[token]
        for end in range(len(body) - 1, 0, -1):
            if (rank := self.ranks.get(body[:end])) is not None:
                return rank
        return None

    def piece(self, piece: str) -> list[int]:
        """The tokens of one piece, given as Latin-1."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = self._longest(piece)
        pairs, shorter, size = self.pairs, self.shorter, self.size
        tokens: list[int] = []
        place, dead, done = 0, set(), len(piece)
        token: int | None = longest(0)
        while True:
            while token is not None:
                end = place + size[token]
                if end not in dead and (not tokens or pairs[tokens[-1] << 20 | token]):
                    break
                token = shorter[token]
            if token is None:
                dead.add(place)
                token = tokens.pop()
                place -= size[token]
                token = shorter[token]
                continue
            tokens.append(token)
            place = end
            if place == done:
                return tokens
            token = longest(place)

    def _longest(self, piece: str) -> Callable[[int], int]:
        """Gives the longest token at a place of ``piece``.

        The automaton's own run of longest matches answers for the places it touches.
        """
        starts, size = {}, self.size
        for end, token in self.automaton.iter_long(piece):
            starts[end + 1 - size[token]] = token

        def at(place: int) -> int:
            token = starts.get(place)
            if token is None:
                _, token = next(self.automaton.iter_long(piece, place))
                starts[place] = token
            return token

        return at

    def _whole(self, piece: str) -> bytes:
        return array("I", self.piece(piece.encode().decode("latin-1"))).tobytes()

    def _pack(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def _chunk(self, chunk: str) -> bytes:
        if self.own and chunk.isalpha():
            return self.pieces[" " + chunk]
        if self.own and chunk[-1:] in STOPS and chunk[:-1].isalpha():
            return self.pieces[" " + chunk[:-1]] + self.pieces[chunk[-1]]
        return self._pack(" " + chunk)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers.

        Pieces begin at every single space, so text between spaces is looked up as one. Where
        a space touches other white space the whole text is cut by the pattern instead.
        """
        if TOUCHING.search(text):
            return self._pack(text)
        first, *rest = text.split(" ")
        return self._pack(first) + b"".join(map(self.chunks.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per process, file and pattern; it keeps what it has learned."""
    return Encoder(path, pattern)


def encode(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks: str = RANKS,
    pattern: str = PIECES,
) -> DataFrame:
    """``doc_id, token_ids``: the ids of every whole text.

    A null or empty text has an empty list. Rows are kept as they are, repeated ones and those
    with a null id included; an empty table gives no row. Only the two named columns are used.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        coder = encoder(ranks, pattern)
        packed = [coder.encode(text) for text in texts(batch.column(1))]
        return [batch.column(0), listed([len(ids) // 4 for ids in packed], b"".join(packed))]

    kind = df.schema[id_col].dataType.simpleString()
    chosen = picked(df, doc_id=id_col, text=text_col)
    names = ("doc_id", "token_ids")
    return map_batches(chosen, make, f"doc_id {kind}, token_ids array<int>", names)


def decode(
    df: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", ranks: str = RANKS
) -> DataFrame:
    """``doc_id, bytes``: what the ids stand for; a null list is empty."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        coder = encoder(ranks, PIECES)
        lists = batch.column(1).to_pylist()
        decoded = [b"".join(map(coder.bytes.__getitem__, ids or ())) for ids in lists]
        return [batch.column(0), pa.array(decoded, pa.binary())]

    kind = df.schema[id_col].dataType.simpleString()
    chosen = picked(df, doc_id=id_col, token_ids=ids_col)
    return map_batches(chosen, make, f"doc_id {kind}, bytes binary")


def round_trip(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks: str = RANKS,
    pattern: str = PIECES,
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: texts encoded and decoded again.

    Both happen in one pass, so no id leaves its task unless ``with_ids`` asks for the column
    ``token_ids``. Nulls, empty texts, repeated rows and empty tables as in :func:`encode`.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        coder = encoder(ranks, pattern)
        counts, ids_digests, decoded_digests, packed = [], [], [], []
        for text in texts(batch.column(1)):
            ids = coder.encode(text)
            counts.append(len(ids) // 4)
            ids_digests.append(hashlib.sha256(ids).hexdigest())
            decoded_digests.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            if with_ids:
                packed.append(ids)
        columns = [
            batch.column(0),
            pa.array(counts, pa.int64()),
            pa.array(ids_digests, pa.string()),
            pa.array(decoded_digests, pa.string()),
        ]
        if with_ids:
            columns.append(listed(counts, b"".join(packed)))
        return columns

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if with_ids:
        schema, names = f"{schema}, token_ids array<int>", [*names, "token_ids"]
    return map_batches(picked(df, doc_id=id_col, text=text_col), make, schema, names)


def listed(counts: list[int], packed: bytes) -> pa.Array:
    """Packed ids as one list of so many ids for each row."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(packed, "<i4")))
