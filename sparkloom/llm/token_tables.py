"""Byte-pair encodings by prefix tables.

For each prefix of a word the encoding has one last token. An Aho-Corasick automaton names the tokens that end at each
place; the last token is the one whose predecessor (the last token of the prefix before it) stays apart from it when the
two are merged alone. So a table of one token a prefix holds the encodings of all prefixes of the word; a count table is
filled beside it, and ids are recovered backwards.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick

#: Most entries of a memo; it is emptied when full, so a worker's memory is bounded.
MEMO = 300_000


class PrefixTable:
    """surface: id -> text (one character an atom). rank(a, b): (priority, id) that a and b merge into, or None."""

    def __init__(self, surface: dict[int, str], rank: Callable[[int, int], tuple[int, int] | None]):
        self.surface, self.rank = surface, rank
        self.by_surface = {s: i for i, s in surface.items()}
        self._apart: dict[tuple[int, int], bool] = {}
        self._spines: dict[int, tuple[list[int], list[int]] | None] = {}
        self.length = {i: len(s) for i, s in surface.items()}
        self.automaton = ahocorasick.Automaton()
        for i, s in surface.items():
            if self.spines(i) is not None:  # else the rules never make it
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()

    def merge(self, ids: list[int], seen: Callable[[list[int]], None] = lambda ids: None) -> list[int]:
        """Plain merging, for the text of one or two tokens: best priority first, the leftmost of equals."""
        ids = list(ids)
        seen(ids)
        ranks = [self.rank(a, b) for a, b in zip(ids, ids[1:])]
        while True:
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                return ids
            at = next(k for k, r in enumerate(ranks) if r == best)
            ids[at : at + 2] = [best[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = self.rank(ids[at - 1], ids[at])
            if at < len(ranks):
                ranks[at] = self.rank(ids[at], ids[at + 1])
            seen(ids)

    def atoms(self, token: int) -> list[int]:
        return [self.by_surface[c] for c in self.surface[token]]

    def spines(self, token: int) -> tuple[list[int], list[int]] | None:
        """The tokens that stand first and last while the rules build the token from its atoms; None if they don't."""
        if token not in self._spines:
            first, last = {}, {}

            def seen(ids: list[int]) -> None:
                first[ids[0]] = last[ids[-1]] = True

            whole = self.merge(self.atoms(token), seen) == [token]
            self._spines[token] = (list(first), list(last)) if whole else None
        return self._spines[token]

    def apart(self, a: int, b: int) -> bool:
        """Whether a and b, next to each other, are what the rules make of their joint text."""
        # Only a merge of a token that once ends a with one that once begins b can cross the border.
        if all(self.rank(x, y) is None for x in self.spines(a)[1] for y in self.spines(b)[0]):
            known = True
        else:
            known = self.merge(self.atoms(a) + self.atoms(b)) == [a, b]
        if len(self._apart) >= MEMO:
            self._apart.clear()
        self._apart[a, b] = known
        return known

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """Last token, and count of tokens, of every prefix of text (place 0: the empty one). All atoms must be known."""
        last, count = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        known, done = self._apart.get, -1
        for end, (token, length) in self.automaton.iter(text):  # the longest first
            if end == done:
                continue
            begin = end + 1 - length
            if begin:
                before = last[begin]
                ok = known((before, token))
                if ok is None:
                    ok = self.apart(before, token)
                if not ok:
                    continue
            last[end + 1], count[end + 1], done = token, count[begin] + 1, end
        return last, count

    def encode(self, text: str) -> list[int]:
        last, _ = self.table(text)
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= self.length[last[at]]
        out.reverse()
        return out
