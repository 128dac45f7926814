"""Patterns that find the longest of many words at a place in one pass."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping


class _Node:
    def __init__(self) -> None:
        self.next: dict[str, _Node] = {}
        self.tails: tuple[str, ...] = ()


def pattern_of(words: Mapping[str, Iterable[str]], tails_first: bool = False) -> str:
    """A pattern that shares the beginnings of words, so each character is tried once.

    Each word is followed by one of its tails, which are patterns and are tried in order. A longer
    word is tried before a shorter one it begins with; with ``tails_first`` after it.
    """
    root = _Node()
    for word, tails in words.items():
        node = root
        for char in word:
            node = node.next.setdefault(char, _Node())
        node.tails = tuple(tails)
    return _rendered(root, tails_first)


def _rendered(node: _Node, tails_first: bool) -> str:
    branches = []
    for char, child in sorted(node.next.items()):
        text = re.escape(char)
        while len(child.next) == 1 and not child.tails:  # a chain needs no branching
            (char, child), = child.next.items()
            text += re.escape(char)
        branches.append(text + _rendered(child, tails_first))
    parts = [*node.tails, *branches] if tails_first else [*branches, *node.tails]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def longest_word(words: Iterable[str]) -> str:
    """A pattern of the longest of some literal words at a place."""
    return pattern_of({word: ("",) for word in words})


def overlaps_itself(word: str) -> bool:
    """Whether a second occurrence of a word can begin within the first."""
    return any(word.endswith(word[:size]) for size in range(1, len(word)))
