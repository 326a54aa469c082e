"""Suffix automaton of several word sequences, each state with the smallest owner of its occurrences."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """Every run of words that occurs in a sequence leads to one state; ``owner`` is the least of them all."""

    def __init__(self, sequences: Iterable[tuple[Sequence[Hashable], int]]):
        self.next: list[dict[Hashable, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owner: list[int | None] = [None]
        for words, owner in sequences:
            last = 0
            for word in words:
                last = self._step(last, word)
                held = self.owner[last]
                if held is None or owner < held:
                    self.owner[last] = owner
        # A state's occurrences are its own and those of all states that link to it.
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up, mine = self.link[state], self.owner[state]
            if up > 0 and (self.owner[up] is None or mine < self.owner[up]):
                self.owner[up] = mine

    def _state(self, length: int, link: int, transitions: dict[Hashable, int]) -> int:
        self.next.append(transitions)
        self.length.append(length)
        self.link.append(link)
        self.owner.append(None)
        return len(self.next) - 1

    def _split(self, at: int, word: Hashable, target: int) -> int:
        """A state for the shorter runs of ``target`` that are reached from ``at``."""
        copy = self._state(self.length[at] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _step(self, last: int, word: Hashable) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return new

    def owners(self, words: Sequence[Hashable], least: int) -> list[int | None]:
        """For each run of ``least`` words, by its start, the smallest owner; None where it does not occur.

        Streams the words once, keeping the longest run that ends at each place and occurs (the matching
        statistics); where that is ``least`` or longer, its last ``least`` words are looked up the links.
        """
        out: list[int | None] = []
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            if matched >= least:
                while self.length[self.link[state]] >= least:
                    state = self.link[state]
                    matched = self.length[state]
            if i >= least - 1:
                out.append(self.owner[state] if matched >= least else None)
        return out
