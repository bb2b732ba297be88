"""Personal data in whole texts, disguised spellings included, with offsets into the source.

The plain kinds are matched on the text itself. Where a text holds a disguise, transducers
rewrite it - letters that look like others, invisible characters, "(at)" and "dot", digits
spelled out - and keep for each character written the stretch of source it stands for. What the
same rules find in the rewritten text is mapped back to the source through those stretches.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tabulary.llm.common import map_batches, picked, texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The patterns of the plain kinds, what each match must satisfy beside.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, so longer runs aren't tried again inside.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТУХаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαινυρ",
        "ABEKMHOPCTYXaeopcyxijsdhqwABEZHIKMNOPTYXoaivup",
        strict=True,
    )
)
# Characters that take no room.
INVISIBLE = "­​‌‍⁠﻿"
# Digits spelled out in English, Spanish, French and German.
NUMERALS = (
    "zero one two three four five six seven eight nine",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
)
DIGITS = {"oh": "0"} | {
    word: str(digit) for words in NUMERALS for digit, word in enumerate(words.split())
}
SPELLED = "|".join(sorted(DIGITS, key=len, reverse=True))
# Words for the sign @, and the words for a dot that go with them.
AT_WORDS = {
    "at": ("dot", "punkt"),
    "arroba": ("punto",),
    "arobase": ("point",),
    "klammeraffe": ("punkt",),
}
DOT_WORDS = tuple(dict.fromkeys(word for words in AT_WORDS.values() for word in words))
AT, DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
#: Blanks before a sign: taken as a whole from where they begin.
BLANKS = r"(?<!\s)\s++"

#: A sign in brackets, and signs that stand as words of their own.
SIGN = re.compile(rf"[\[({{<]\s*+(?P<sign>{AT}|@|{DOT}|\.)\s*+[\])}}>]", re.IGNORECASE)
BRACKETED = re.compile(rf"(?:{BLANKS})?{SIGN.pattern}\s*+", re.IGNORECASE)
BARE_AT = re.compile(rf"{BLANKS}(?P<sign>{AT})\s++|(?:{BLANKS})?(?P<plain>@)\s*+", re.IGNORECASE)


def _domain(dots: str) -> re.Pattern:
    return re.compile(
        rf"[A-Za-z0-9-]++(?:(?:\s++(?:{dots})\s++|\.)[A-Za-z0-9-]++)*", re.IGNORECASE
    )


#: What may follow an @ in any of its spellings, dots spelled out.
SPELLED_DOMAINS = {at: _domain("|".join(dots)) for at, dots in AT_WORDS.items()} | {"@": _domain(DOT)}
WORD_DOT = re.compile(rf"{BLANKS}(?:{DOT})\s++", re.IGNORECASE)
#: What may stand between digits that belong together.
GAP = rf"(?:\s+(?:{DOT})\s+|[\s,.-]{{1,3}})"
#: At least four numbers, a digit or a dot among them spelled out.
COUNTED = re.compile(
    rf"(?:\b(?:plus|más)[\s-]+|\+\s*)?\b(?:(?:{SPELLED})\b|[0-9]+)(?:{GAP}(?:(?:{SPELLED})\b|[0-9]+)){{3,}}",
    re.IGNORECASE,
)
DIGIT_PART = re.compile(rf"(?P<plus>\bplus\b|\bmás\b|\+)|\b(?P<word>{SPELLED})\b|(?P<digits>[0-9]+)", re.IGNORECASE)
#: Two spelled digits in a row: without them no sequence of digits is spelled out.
SPELLED_PAIR = re.compile(
    rf"\b(?:{SPELLED}){GAP}(?:{SPELLED}|[0-9])|[0-9]{GAP}(?:{SPELLED})\b|[0-9]\s+(?:{DOT})\s+[0-9]"
)


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(letter for letter in text if "0" <= letter <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost addresses: an @ with the longest local part before it and a domain after it."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_LETTERS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    return found


def plain(text: str) -> list[Span]:
    """The plain kinds, leftmost and apart within each kind; failing matches are passed over."""
    spans = emails(text) if "@" in text else []
    for match in IP.finditer(text):
        if all(len(short := part.lstrip("0")) <= 3 and int(short or 0) <= 255 for part in match[0].split(".")):
            spans.append(("ip", *match.span()))
    for match in CARD.finditer(text):
        digits = _digits(match[0]) if match.end() - match.start() >= 14 else ""
        if 14 <= len(digits) <= 19 and _luhn(digits):
            spans.append(("card", *match.span()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 10 <= len(_digits(match[0])) <= 15:
                spans.append(("phone", *match.span()))
    return spans


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda span: (span[1], KINDS.index(span[0]), span[2]))


class Tape:
    """A text being rewritten, with the stretch of source behind each of its characters."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts = list(range(len(text)))
        self.ends = list(range(1, len(text) + 1))
        self.changed = [False] * len(text)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces stretches, in order and apart; each new character stands for its stretch."""
        text, starts, ends, changed, done = [], [], [], [], 0
        for begin, end, new in edits:
            text.append(self.text[done:begin])
            starts += self.starts[done:begin]
            ends += self.ends[done:begin]
            changed += self.changed[done:begin]
            if not new and ends:  # what is left out goes with the character before it
                ends[-1], changed[-1] = self.ends[end - 1], True
            if new:
                text.append(new)
                starts += [self.starts[begin]] * len(new)
                ends += [self.ends[end - 1]] * len(new)
                changed += [True] * len(new)
            done = end
        text.append(self.text[done:])
        starts += self.starts[done:]
        ends += self.ends[done:]
        changed += self.changed[done:]
        self.text, self.starts, self.ends, self.changed = "".join(text), starts, ends, changed


@lru_cache(maxsize=65536)
def look(letter: str) -> str | None:
    """The ASCII character that ``letter`` looks like, empty if it is invisible, else None."""
    if letter in LOOKALIKES:
        return LOOKALIKES[letter]
    if letter in INVISIBLE:
        return ""
    same = unicodedata.normalize("NFKC", letter)
    return same if len(same) == 1 and same.isascii() and not same.isspace() else None


def _homoglyphs(tape: Tape) -> None:
    edits = [
        (place, place + 1, new)
        for place, letter in enumerate(tape.text)
        if letter >= "\x80" and (new := look(letter)) is not None
    ]
    if edits:
        tape.rewrite(edits)


def _signs(tape: Tape) -> None:
    edits = [
        (*match.span(), "." if match["sign"].lower() in (*DOT_WORDS, ".") else "@")
        for match in BRACKETED.finditer(tape.text)
    ]
    if edits:
        tape.rewrite(edits)
    text, edits, done = tape.text, [], 0
    # From each sign to both sides, so that no run of letters is read more than twice.
    for at in BARE_AT.finditer(text):
        start = at.start()
        if start <= done or text[start - 1] not in LOCAL_LETTERS:
            continue
        domain = SPELLED_DOMAINS[(at["sign"] or "@").lower()].match(text, at.end())
        dots = list(WORD_DOT.finditer(text, *domain.span())) if domain else []
        if dots:
            edits.append((*at.span(), "@"))
            edits += [(*dot.span(), ".") for dot in dots]
            done = domain.end()
    if edits:
        tape.rewrite(edits)


def _numbers(tape: Tape) -> None:
    edits = []
    for run in COUNTED.finditer(tape.text):
        parts = list(DIGIT_PART.finditer(tape.text, *run.span()))
        if not any(part["word"] for part in parts) and not WORD_DOT.search(run[0]):
            continue
        # A part's stretch reaches to the next one, so that what stands between goes with it.
        for number, part in enumerate(parts):
            end = parts[number + 1].start() if number + 1 < len(parts) else part.end()
            between = tape.text[part.end() : end].lower()
            keep = "." if "." in between or between.strip() in DOT_WORDS else ""
            new = "+" if part["plus"] else part["digits"] or DIGITS[part["word"].lower()]
            edits.append((part.start(), part.end(), new))
            if end > part.end():
                edits.append((part.end(), end, keep))
    if edits:
        tape.rewrite(edits)


def disguised(text: str) -> bool:
    """Whether a transducer could change the text."""
    low = text.lower()
    return (
        (not text.isascii() and any(look(c) is not None for c in set(text) if c >= "\x80"))
        or (WORD_DOT.search(low) is not None and BARE_AT.search(low) is not None)
        or SIGN.search(low) is not None
        or SPELLED_PAIR.search(low) is not None
    )


def hidden(text: str, known: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows, in offsets of the source."""
    if not disguised(text):
        return []
    tape = Tape(text)
    for transduce in (_homoglyphs, _signs, _numbers):
        transduce(tape)
    taken = {kind: sorted(span[1:] for span in known if span[0] == kind) for kind in KINDS}
    added: list[Span] = []
    for kind, start, end in plain(tape.text):
        if any(tape.changed[start:end]):
            first, last = tape.starts[start], tape.ends[end - 1]
            place = bisect_left(taken[kind], (first, last))
            before, after = taken[kind][max(place - 1, 0) : place], taken[kind][place : place + 1]
            if all(other[1] <= first for other in before) and all(last <= other[0] for other in after):
                added.append((kind, first, last))
                taken[kind].insert(place, (first, last))
    return added


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", disguises: bool = True
) -> DataFrame:
    """``doc_id, found``: the spans of personal data of every whole text, by start and kind.

    ``found`` is an array of ``kind, start, end, disguised`` in code points, the end left out.
    A disguised span never overlaps a plain one of its kind, and plain ones are always kept. A
    null or empty text has none; a text of any length is read whole, in time in proportion to its
    length also where it is one run of letters, digits or blanks. Repeated rows and null ids
    stay, an empty table gives no row, extra columns are not looked at.
    """
    kind_type = df.schema[id_col].dataType.simpleString()
    item = pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())]
    )

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for text in texts(batch.column(1)):
            base = plain(text)
            added = set(hidden(text, base)) if disguises else set()
            rows.append([(*span, span in added) for span in in_order([*base, *added])])
        named = [[dict(zip(("kind", "start", "end", "disguised"), s, strict=True)) for s in r] for r in rows]
        return [batch.column(0), pa.array(named, pa.list_(item))]

    found = "array<struct<kind:string,start:bigint,end:bigint,disguised:boolean>>"
    chosen = picked(df, doc_id=id_col, text=text_col)
    return map_batches(chosen, make, f"doc_id {kind_type}, found {found}", ("doc_id", "found"))


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans as one."""
    parts, done = [], 0
    for kind, start, end in in_order(spans):
        if start >= done:
            parts += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()
