"""A generalised suffix automaton over words, and matching statistics of a streamed text."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator, Sequence


class SuffixAutomaton:
    """States are sets of end positions; `go` their transitions, `link` their suffix links, `size` their longest strings."""

    def __init__(self, sequences: Iterable[Sequence[Hashable]]):
        self.go: list[dict[Hashable, int]] = [{}]
        self.link, self.size = [-1], [0]
        for s in sequences:
            last = 0
            for x in s:
                last = self._extend(last, x)

    def _state(self, go: dict, size: int) -> int:
        self.go.append(go)
        self.link.append(0)
        self.size.append(size)
        return len(self.go) - 1

    def _clone(self, p: int, q: int, x: Hashable) -> int:
        """Splits from q the strings that p leads to by x; afterwards p and its suffixes lead to the new state."""
        new = self._state(dict(self.go[q]), self.size[p] + 1)
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.go[p].get(x) == q:
            self.go[p][x] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, x: Hashable) -> int:
        q = self.go[last].get(x, -1)
        if q >= 0:  # an earlier sequence has this string already
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, q, x)
        new = self._state({}, self.size[last] + 1)
        p = last
        while p >= 0 and x not in self.go[p]:
            self.go[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.go[p][x]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, x)
        return new

    def matching(self, text: Sequence[Hashable]) -> Iterator[int]:
        """For each position, the length of the longest suffix of the text up to there that stands in a sequence."""
        state = length = 0
        for x in text:
            while state and x not in self.go[state]:
                state = self.link[state]
                length = self.size[state]
            if x in self.go[state]:
                state = self.go[state][x]
                length += 1
            yield length

    def spans(self, text: Sequence[Hashable], least: int) -> Iterator[tuple[int, int]]:
        """Start and end of the maximal matches of at least so many words; they may overlap."""
        before = 0
        end = 0
        for end, n in enumerate(self.matching(text), 1):
            if n <= before and before >= least:
                yield end - 1 - before, end - 1
            before = n
        if before >= least:
            yield end - before, end
