"""Lists of keywords as one prefix tree: a text is searched once, however many there are."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tree_pattern(words: Sequence[str]) -> str:
    """A pattern that matches the longest of the words at a place: words share their beginnings, as in a prefix tree."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def written(node: dict) -> str:
        branches = [re.escape(letter) + written(below) for letter, below in sorted(node.items()) if letter]
        if not branches:
            return ""
        inner = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return inner + ("?" if "" in node else "")

    return written(tree)


def first_contained(c: Column, words: Sequence[str]) -> Column:
    """The place, from 0, of the first of the words that the text holds, by the order of the list; null if it holds none.

    The tree gives the longest word at each place of the text. Others that match there are its beginnings, so each word stands for the earliest in the list among
    itself and its beginnings.
    """
    place = {}
    for k, word in enumerate(words):
        place.setdefault(word, k)
    earliest = {w: min(k for v, k in place.items() if w.startswith(v)) for w in place}
    ranks = F.create_map(*[x for w, k in earliest.items() for x in (F.lit(w), F.lit(k))])
    found = F.regexp_extract_all(c, F.lit(f"(?=({tree_pattern(list(place))}))"), 1)
    return F.array_min(F.transform(found, lambda w: F.try_element_at(ranks, w)))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Whether the text holds one of the words."""
    return c.rlike(tree_pattern(words))
