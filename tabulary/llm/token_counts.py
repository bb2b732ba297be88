"""Exact token counts at every prefix of a text.

The vocabulary cuts lower-cased text into words and numbers and marks the last symbol of each
with a word end. Within a word a prefix dynamic program keeps, for each prefix, the last token
of its encoding and the number of tokens: the token is the one that ends there and may follow
the last token of what precedes it. A count for any truncation is then read off, not encoded.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tabulary.llm.common import Memo, map_batches, picked, texts
from tabulary.llm.merges import Merges

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIMIT = 2048
CHUNKS_KEPT, WORDS_KEPT = 150_000, 700_000
#: Characters of the longest text that is remembered.
LONGEST_KEPT = 48

#: White space as the library knows it, and the pattern of its words.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
WORD_END = "</w>"
#: Marks that end most words; a word before one needs no pattern.
STOPS = ".,;:!?"
CHUNK = re.compile(rf"[^{SPACE}]+")
#: Characters that Python takes for white space and the library doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_letters() -> dict[str, str]:
    """From the letters that stand for bytes in a byte-level vocabulary to Latin-1."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): chr(b) for b in shown} | {
        chr(256 + n): chr(b) for n, b in enumerate(hidden)
    }


@lru_cache(maxsize=1)
def composing() -> frozenset[str]:
    """Characters other than combining marks that a character before them may take in."""
    pairs = (unicodedata.decomposition(chr(code)).split() for code in range(0x110000))
    seconds = {chr(int(pair[1], 16)) for pair in pairs if len(pair) == 2 and pair[0][0] != "<"}
    jamo = map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])
    return frozenset(seconds.union(jamo))


def runs_apart(chunk: str) -> list[str]:
    """``chunk`` cut where letters, numbers and others meet, unless a form might cross the cut."""
    forms = [unicodedata.normalize("NFC", letter).lower() for letter in chunk]
    kinds = ["".join(unicodedata.category(part)[0] for part in form) for form in forms]
    groups = [kind[0] if kind[0] in "LN" else "" for kind in kinds]
    joining = composing()
    cuts = [
        place
        for place in range(1, len(chunk))
        if groups[place] != groups[place - 1]
        and "M" not in kinds[place - 1] + kinds[place]
        and chunk[place] not in joining
        and chunk[place - 1] != "'"
    ]
    return [chunk[start:end] for start, end in zip([0, *cuts], [*cuts, len(chunk)], strict=True)]


class PrefixCounter:
    """Counts tokens of texts and of all their prefixes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model, letters = stated["model"], byte_letters()
        numbers = model["vocab"]
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for token, number in numbers.items():
            body = token.removesuffix(WORD_END) if len(token) > len(WORD_END) else token
            side = self.inner if body is token or body == token else self.final
            side["".join(map(letters.__getitem__, body))] = number
        ranks: dict[tuple[int, int], int] = {}
        halves: dict[int, tuple[int, int]] = {}
        for order, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = numbers[left], numbers[right]
            ranks[pair] = order
            halves.setdefault(numbers[left + right], pair)
        self.pairs = Merges(lambda left, right: ranks.get((left, right)), halves.get).pairs
        self.longest = max(map(len, self.final))
        self.size = {number: len(token) for token, number in self.inner.items()}
        self.ending = ahocorasick.Automaton()
        for token, number in self.inner.items():
            self.ending.add_word(token, number)
        self.ending.make_automaton()
        special = [token["content"] for token in stated.get("added_tokens", ())]
        self.special = (
            re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        )
        self.marks = tuple(special)
        self.words = regex.compile(WORDS)
        self.counts = Memo(self.word, WORDS_KEPT, LONGEST_KEPT)
        self.chunks = Memo(self._chunk, CHUNKS_KEPT, LONGEST_KEPT)

    # One word ------------------------------------------------------------------------

    def states(self, word: str) -> tuple[list[int], list[int]]:
        """For each prefix of a word without its end: the last token and the count."""
        pairs, size = self.pairs, self.size
        last, count = [0], [0]
        for end, token in self.ending.iter(word):  # of tokens with one end the longest first
            if len(last) == end + 1:
                start = end + 1 - size[token]
                if not start or pairs[last[start] << 20 | token]:
                    last.append(token)
                    count.append(count[start] + 1)
        if len(last) <= len(word):
            raise ValueError(f"no token ends at {len(last)} of {word!r}")
        return last, count

    def closed(self, word: str, end: int, last: list[int], count: list[int]) -> int:
        """Tokens of the first ``end`` symbols taken as a whole word."""
        final, pairs = self.final.get, self.pairs
        for start in range(max(0, end - self.longest), end):
            token = final(word[start:end])
            if token is not None and (not start or pairs[last[start] << 20 | token]):
                return count[start] + 1
        raise ValueError(f"no token closes {word[:end]!r}")

    def word(self, word: str) -> int:
        symbols = word if word.isascii() else word.encode().decode("latin-1")
        if symbols in self.final:
            return 1
        return self.closed(symbols, len(symbols), *self.states(symbols[:-1]))

    def _lowered(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # The lower case of a sigma must not depend on its place.
        return text.replace("Σ", "σ").lower()

    def _chunk(self, chunk: str) -> int:
        counts, lowered = self.counts, self._lowered(chunk)
        if lowered.isalpha():
            return counts[lowered]
        if lowered[-1] in STOPS and lowered[:-1].isalpha():
            return counts[lowered[:-1]] + counts[lowered[-1]]
        return sum(map(counts.__getitem__, self.words.findall(lowered)))

    # Texts ---------------------------------------------------------------------------

    def _parts(self, text: str) -> list[str]:
        if self.special is not None and any(mark in text for mark in self.marks):
            return self.special.split(text)
        return [text]

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        chunks = self.chunks
        if "<" not in text and not ODD_SPACE.search(text):
            return sum(map(chunks.__getitem__, text.split()))
        total = 0
        for part in self._parts(text):
            if part in self.marks:
                total += 1
            elif ODD_SPACE.search(part):
                total += sum(map(chunks.__getitem__, CHUNK.findall(part)))
            else:
                total += sum(map(chunks.__getitem__, part.split()))
        return total

    def chunk_prefixes(self, chunk: str) -> list[int]:
        """Tokens of every prefix, empty and whole ones included, of text without space."""
        plain = chunk.isascii() or (
            unicodedata.is_normalized("NFC", chunk)
            and len(self._lowered(chunk)) == len(chunk)
        )
        if not plain:
            # Normal forms of prefixes differ near their end; each run is taken for itself.
            counts = [0]
            for run in runs_apart(chunk):
                before = counts[-1]
                counts += [before + self._chunk(run[:end]) for end in range(1, len(run) + 1)]
            return counts
        lowered, counts, before = self._lowered(chunk), [0], 0
        for found in self.words.finditer(lowered):
            word = found.group()
            if word[0] == "'" and word[1:2].isalpha():
                # A cut contraction falls apart into other words.
                counts += [before + self._chunk(word[:end]) for end in range(1, len(word) + 1)]
            else:
                ends = list(accumulate(len(letter.encode()) for letter in word))
                symbols = word.encode().decode("latin-1")
                last, count = self.states(symbols)
                counts += [before + self.closed(symbols, end, last, count) for end in ends]
            before = counts[-1]
        return counts

    def _marks_in(self, text: str) -> list[tuple[int, int]]:
        if self.special is None or not any(mark in text for mark in self.marks):
            return []
        return [found.span() for found in self.special.finditer(text)]

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of ``text[:p]`` for every p from 0 to its length.

        A special mark counts once it is whole. A cut one is plain text that goes on with the
        chunk before it; only that chunk is counted again, not what precedes it.
        """
        counts = np.zeros(len(text) + 1, dtype=np.int32)
        before, done = 0, 0
        for mark, after in [*self._marks_in(text), (len(text), None)]:
            last = done
            for found in CHUNK.finditer(text, done, mark):
                start, end = found.span()
                counts[done : start + 1] = before
                inner = self.chunk_prefixes(found.group())
                counts[start : end + 1] = before + np.array(inner, dtype=np.int32)
                before, done, last = int(counts[end]), end, start
            counts[done : mark + 1] = before
            if after is not None:
                if done < mark:
                    last = mark
                known = int(counts[last])
                for cut in range(mark + 1, after):
                    counts[cut] = known + self.count(text[last:cut])
                before, done = before + 1, after
                counts[after] = before
        return counts

    def fitting(self, text: str, limit: int) -> int:
        """Characters of the longest prefix that has at most ``limit`` tokens."""
        if self._marks_in(text):
            return int(np.flatnonzero(self.prefixes(text) <= limit)[-1])
        before, best = 0, 0
        for found in CHUNK.finditer(text):
            best = found.start()
            after = before + self.chunks[found.group()]
            if after > limit or before == limit:
                inner = self.chunk_prefixes(found.group())
                fits = [end for end, n in enumerate(inner) if before + n <= limit]
                return best + fits[-1]
            before = after
        return len(text)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One counter per process and vocabulary; it keeps what it has learned."""
    return PrefixCounter(path)


def prefix_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY
) -> DataFrame:
    """``doc_id, prefix_tokens``: the tokens of every prefix, from none to the whole text.

    Item p counts the first p code points as they would be encoded on their own. A null text
    is empty and has one item, zero. Repeated rows stay; an empty table gives no row; a null
    id is kept. Only the two named columns are used, so extra ones never clash.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        count = counter(vocabulary)
        rows = [count.prefixes(text) for text in texts(batch.column(1))]
        ends = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int32)
        return [
            batch.column(0),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows))),
        ]

    kind = df.schema[id_col].dataType.simpleString()
    chosen = picked(df, doc_id=id_col, text=text_col)
    return map_batches(chosen, make, f"doc_id {kind}, prefix_tokens array<int>")


def token_counts(
    df: DataFrame,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fitting_chars`` of whole texts.

    ``fitting_chars`` is the length in code points of the longest prefix of at most ``limit``
    tokens, so a truncation needs no further encoding. A null text is empty: no bytes, no
    tokens. Rows are kept as they are, repeated ones and those with a null id included; an
    empty table gives no row. Only the two named columns are used.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        count = counter(vocabulary)
        rows = texts(batch.column(1))
        totals = [count.count(text) for text in rows]
        fitting = [
            len(text) if total <= limit else count.fitting(text, limit)
            for text, total in zip(rows, totals, strict=True)
        ]
        return [
            batch.column(0),
            pa.array([len(text.encode()) for text in rows], pa.int64()),
            pa.array(totals, pa.int64()),
            pa.array([total > limit for total in totals]),
            pa.array(fitting, pa.int64()),
        ]

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(
        picked(df, doc_id=id_col, text=text_col),
        make,
        f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long",
    )
