"""Tries of phrases: one pass over a text finds all of them, however many there are and however long."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class Trie:
    """Values by sequences of symbols: the characters of a word, or the tokens of a phrase."""

    def __init__(self, rows: Iterable[tuple[Sequence[Hashable], object]] = ()) -> None:
        self.root: dict = {}
        for symbols, value in rows:
            self.add(symbols, value)

    def add(self, symbols: Sequence[Hashable], value: object) -> None:
        node = self.root
        for s in symbols:
            node = node.setdefault(s, {})
        node.setdefault(None, []).append(value)

    def find(self, text: Sequence[Hashable]) -> set:
        """Values whose symbols stand one after another anywhere in ``text``; those of the empty sequence always do."""
        found = set(self.root.get(None, ()))
        for i in range(len(text)):
            node = self.root
            for k in range(i, len(text)):
                node = node.get(text[k])
                if node is None:
                    break
                found.update(node.get(None, ()))
        return found
