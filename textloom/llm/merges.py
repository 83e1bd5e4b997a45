"""Which adjacent tokens a byte-pair merge order leaves apart.

A merge order is a dict ``string -> rank``: of all adjacent pairs of symbols
whose concatenation has a rank, the lowest rank merges first, and of equal
ranks the leftmost. Single characters are the symbols to begin with.

A token sequence is what the merges give if, and only if, each two adjacent
tokens come out of the merges of their own concatenation unchanged: the first
merge across a border would have to happen in that concatenation as well.
"""

from __future__ import annotations

FOREVER = 1 << 60
#: Pairs of tokens that are remembered at a time.
MOST_PAIRS = 200_000


class MergeOrder:
    def __init__(self, rank: dict[str, int]):
        self.rank = rank
        self._halves: dict[str, tuple[str, str] | None] = {}
        self.known: dict[str, dict[str, bool]] = {}  # by the left token, then the right one
        self.held = 0

    def merge(self, symbols: list[str], below: int = FOREVER) -> list[str]:
        """The plain definition: merges of rank under ``below``, one by one."""
        parts = list(symbols)
        while len(parts) > 1:
            found = min(((self.rank.get(a + b, FOREVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(FOREVER, 0))
            if found[0] >= below:
                break
            parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
        return parts

    def halves(self, token: str) -> tuple[str, str] | None:
        """The two symbols whose merge makes the token; None if no merges make it."""
        if token not in self._halves:
            parts = self.merge(list(token), self.rank[token])
            self._halves[token] = tuple(parts) if len(parts) == 2 else None
        return self._halves[token]

    def reachable(self, token: str) -> bool:
        return len(token) == 1 or self.halves(token) is not None

    def apart(self, left: str, right: str) -> bool:
        """True if the merges of ``left + right`` end in just these two tokens (memoised).

        Of no token before, written as an empty one: if merges make the token.
        """
        row = self.known.get(left)
        if row is None:
            row = self.known[left] = {}
        found = row.get(right)
        if found is None:
            self.held += 1
            if self.held > MOST_PAIRS:
                self.held = 0
                self.known.clear()
                row = self.known[left] = {}
            found = row[right] = self._meet(left, right) if left else self.reachable(right)
        return found

    def _meet(self, left: str, right: str) -> bool:
        """Walks back in time along the symbols at the border, from the whole tokens to single characters.

        A symbol is there from its own rank until the rank of what it merges
        into. While two symbols face each other at the border, they merge if
        their concatenation has a lower rank than the end of either; at equal
        ranks the pair on the left goes first.
        """
        if not (self.reachable(left) and self.reachable(right)):
            return False
        rank = self.rank
        left_ends = right_ends = FOREVER
        while True:
            across = rank.get(left + right)
            if across is not None and across < left_ends and across <= right_ends:
                return False
            left_born = rank[left] if len(left) > 1 else -1
            right_born = rank[right] if len(right) > 1 else -1
            if left_born < 0 and right_born < 0:
                return True
            # the later merge is undone first; of equal ranks, the right one came later
            if left_born > right_born:
                left_ends, left = left_born, self.halves(left)[1]
            else:
                right_ends, right = right_born, self.halves(right)[0]
