"""Many keywords in one pass: an automaton over the letters of words, and a tree over the words of phrases.

The automaton holds all keyword words in one tree of characters. A failure link leads from a state to that of the longest
proper end of what was read that is in the tree as well, and an ending link to the next state on this way where a keyword ends.
So a word is read once, character by character, whatever the number of keywords. What a word gave is kept, up to a bound."""

from __future__ import annotations

from collections import deque
from collections.abc import Hashable, Iterable, Iterator


class Automaton:
    """Which of the words occur anywhere in a text."""

    def __init__(self, words: Iterable[str]):
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]  # of a state: the word that ends there
        for number, word in enumerate(words):
            state = 0
            for c in word:
                if c not in self.step[state]:
                    self.step[state][c] = len(self.step)
                    self.step.append({})
                    self.ends.append(-1)
                state = self.step[state][c]
            self.ends[state] = number
        self.fail, self.ending = [0] * len(self.step), [0] * len(self.step)
        waiting = deque(self.step[0].values())
        while waiting:
            state = waiting.popleft()
            back = self.fail[state]
            self.ending[state] = back if self.ends[back] >= 0 else self.ending[back]
            for c, to in self.step[state].items():
                self.fail[to] = self.follow(back, c) if state else 0
                waiting.append(to)

    def follow(self, state: int, c: str) -> int:
        while c not in self.step[state] and state:
            state = self.fail[state]
        return self.step[state].get(c, 0)

    def found(self, text: str) -> frozenset[int]:
        """The numbers of the words that the text contains."""
        state, out, step, ends, ending = 0, set(), self.step, self.ends, self.ending
        for c in text:
            to = step[state].get(c)
            state = self.follow(state, c) if to is None else to
            at = state if ends[state] >= 0 else ending[state]
            while at and ends[at] not in out:  # what ends behind a word that was met was met with it
                out.add(ends[at])
                at = ending[at]
        return frozenset(out)


class Branch:
    """A node of the tree of phrases: what may come next, and the numbers of the phrases that end here."""

    def __init__(self):
        self.next: dict[int, Branch] = {}
        self.phrases: list[int] = []


ANY = -1  # a keyword word without a letter or digit is in every word


class Phrases:
    """Phrases of keyword words, found where consecutive words of a line contain theirs. plain: what of a word, and of a keyword word, is compared."""

    def __init__(self, phrases: list[str], plain, most: int = 200_000):
        self.plain, self.most = plain, most
        self.kept: dict[str, frozenset[int]] = {}
        numbers: dict[Hashable, int] = {}
        self.root = Branch()
        for k, phrase in enumerate(phrases):
            at = self.root
            for part in phrase.split():
                part = plain(part)
                at = at.next.setdefault(numbers.setdefault(part, len(numbers)) if part else ANY, Branch())
            if at is not self.root:
                at.phrases.append(k)
        self.automaton = Automaton(numbers)

    def of(self, word: str) -> frozenset[int]:
        """The keyword words that a word contains."""
        found = self.kept.get(word)
        if found is None:
            if len(self.kept) >= self.most:
                self.kept.clear()
            found = self.kept[word] = self.automaton.found(self.plain(word))
        return found

    def in_line(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(phrase, place of its first word, place of its last word)."""
        have = [*map(self.of, words)]
        for first in range(len(words)):
            if not have[first] and ANY not in self.root.next:
                continue
            ways, last = [self.root], first
            while ways and last < len(words):
                ways = [w.next[x] for w in ways for x in ((have[last] & w.next.keys()) | ({ANY} & w.next.keys()))]
                for w in ways:
                    for k in w.phrases:
                        yield k, first, last
                last += 1
