"""Which tokens may stand side by side in a byte-pair encoding.

A sequence of tokens is the encoding of its text exactly when every two neighbours are: when
encoding the text of the pair gives the pair back. Whether it does is read off two spines. The
right spine of the left token lists the pieces that ended at the seam while the token was put
together, the left spine of the right token those that began there. The seam holds if at no
time the two pieces at it merge before either is used up on its own side.
"""

from __future__ import annotations

from tabulary.llm.common import Memo

NEVER = 1 << 60
SHIFT = 20
PAIRS_KEPT = 200_000


class Merges:
    """Merge rules by token number.

    ``rank(left, right)`` is the order of the merge of two tokens or None; ``split(token)`` the
    two tokens it is merged from, or None for a single symbol.
    """

    def __init__(self, rank, split) -> None:
        self.rank, self.split = rank, split
        self.right_spines: dict[int, list[tuple[int, int]]] = {}
        self.left_spines: dict[int, list[tuple[int, int]]] = {}
        self.pairs = Memo(self._fits, PAIRS_KEPT)

    def fits(self, left: int, right: int) -> bool:
        """True if ``[left, right]`` is the encoding of the text of both."""
        return self.pairs[left << SHIFT | right]

    def _spine(self, token: int, side: int, known: dict) -> list[tuple[int, int]]:
        spine = known.get(token)
        if spine is None:
            pieces, used_up = [token], [NEVER]
            while (halves := self.split(pieces[-1])) is not None:
                used_up.append(self.rank(*halves))
                pieces.append(halves[side])
            spine = known[token] = list(zip(pieces, used_up, strict=True))[::-1]
        return spine

    def _fits(self, pair: int) -> bool:
        lefts = self._spine(pair >> SHIFT, 1, self.right_spines)
        rights = self._spine(pair & (1 << SHIFT) - 1, 0, self.left_spines)
        i = j = 0
        while True:
            left, left_ends = lefts[i]
            right, right_ends = rights[j]
            joined = self.rank(left, right)
            # Of equal merges the one further left comes first.
            if joined is not None and joined < left_ends and joined <= right_ends:
                return False
            if left_ends <= right_ends:
                if left_ends == NEVER:
                    return True
                i += 1
            else:
                j += 1
