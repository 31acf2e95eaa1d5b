"""Keyword lists matched by one automaton: the cost of a text does not grow with the number of keywords.

A one-word keyword is a whole token of a text (B2), a longer one a substring of the tokens joined by '-'. All keywords of all
lists, so joined and the one-word ones between two hyphens, are compiled once a worker into one Aho-Corasick automaton; a text's
joined tokens pass through it once. Tokens come from Spark; record batches go to Python.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


@lru_cache(maxsize=64)
def compiled(lists: tuple[tuple[str, tuple[str, ...]], ...]) -> ahocorasick.Automaton | None:
    """The automaton of named lists: every key's value is the places (list, keyword) that it stands for; None for no keyword."""
    places: dict[str, list[tuple[int, str]]] = {}
    for number, (_, keywords) in enumerate(lists):
        for keyword in dict.fromkeys(keywords):
            parts = T._key_tokens(keyword)
            if parts:
                places.setdefault(f"-{parts[0]}-" if len(parts) == 1 else "-".join(parts), []).append((number, keyword))
    if not places:
        return None
    automaton = ahocorasick.Automaton()
    for key, value in places.items():
        automaton.add_word(key, tuple(value))
    automaton.make_automaton()
    return automaton


def matched(joined: str, lists) -> list[list[str]]:
    """For each of the named lists, its sorted keywords that occur in the tokens ``joined`` by '-'."""
    found: list[set[str]] = [set() for _ in lists]
    automaton = compiled(lists)
    if automaton is not None and joined:
        for _, value in automaton.iter(f"-{joined}-"):
            for number, keyword in value:
                found[number].add(keyword)
    return [sorted(f) for f in found]


def _frozen(lists: Mapping[str, Sequence[str]]):
    return tuple((name, tuple(keywords)) for name, keywords in lists.items())


def joined_tokens(c) -> Column:
    """The tokens of a text (I15) joined by '-'."""
    return F.array_join(T.tokens(c), "-")


def hits(c, lists: Mapping[str, Sequence[str]]) -> Column:
    """A struct with, for each named list, the sorted keywords that a text holds; a null text holds none."""
    known = _frozen(lists)

    @F.pandas_udf(", ".join(f"`{name}` array<string>" for name, _ in known))
    def find(joined: pd.Series) -> pd.DataFrame:
        rows = [matched(j, known) for j in joined]
        return pd.DataFrame({name: [row[i] for row in rows] for i, (name, _) in enumerate(known)}, columns=[name for name, _ in known])

    return find(joined_tokens(c))


def leading(c, lists: Mapping[str, Sequence[str]], default: str) -> Column:
    """The name of the list with most keywords in a text, ties to the one named first there (then in the lists); or ``default``."""
    known = _frozen(lists)

    def best(joined: str, low: str) -> str:
        scored = []
        for order, ((name, _), found) in enumerate(zip(known, matched(joined, known))):
            at = [low.find(k.replace("-", " ")) + 1 or low.find(k) + 1 for k in found]
            scored.append((-len(found), min((p for p in at if p), default=0), order, name))
        first = min(scored, default=(0, 0, 0, default))
        return first[3] if first[0] < 0 else default

    @F.pandas_udf("string")
    def name(joined: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series([best(j, t) for j, t in zip(joined, low)], dtype=object)

    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return name(joined_tokens(c), F.lower(text))
