"""Ranking profiles: what one dialect of search decides, behind one interface.

A profile compiles parsed terms, says which words are indexed, which documents a
query accepts, how far title and content are apart for a phrase, and what an
occurrence is worth. Matching and ranking ask the profile and branch on nothing else.
A new dialect is one more class in ``PROFILES``.
"""

from __future__ import annotations

from functools import reduce
from math import log
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from textrill.errors import UnsupportedEngine
from textrill.functions.text import normalise
from textrill.plans.query import MUST, MUST_NOT, SHOULD, Compiled, Term, Unit, compile_boolean, compile_fts5, compile_tsquery

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
# The default stop words of the boolean profile's engine.
STOPWORDS = frozenset("a about an are as at be by com de en for from how i in is it la of on or that the this to was what when where who will with und the www".split())
MIN_TOKEN = 3


class RankingProfile(Protocol):
    name: str
    #: Positions between the last word of the title and the first of the content; 0 lets a phrase run across.
    gap: int

    def normalise(self, text: Column | str) -> Column:
        """The form a text is indexed in."""

    def compile(self, terms: list[Term]) -> Compiled:
        """Parsed terms as units and in the profile's own language."""

    def keeps(self, unit: Unit) -> bool:
        """Whether a unit's words are indexed at all."""

    def accepts(self, query: Compiled, tf: dict[int, Column]) -> Column:
        """The match predicate over the units' counts."""

    def worth(self, tf: Column, length: Column, n_docs: int, avg_len: float, n: int) -> Column:
        """What ``tf`` occurrences of a unit that ``n`` documents hold add to the rank."""


def idf(n_docs: int, n: int) -> float:
    value = log((n_docs - n + 0.5) / (n + 0.5))
    return value if value > 0 else IDF_FLOOR


def bm25(tf: Column, idf_: Column | float, length: Column, avg_len: Column | float) -> Column:
    return F.lit(idf_) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / F.lit(avg_len)))


def _units(query: Compiled, occur: str) -> list[int]:
    return [i for i, u in enumerate(query.units) if u.occur == occur]


def _any(tf: dict[int, Column], ids: list[int]) -> Column:
    return reduce(lambda a, b: a | b, [tf[i] > 0 for i in ids])


def _all(tf: dict[int, Column], query: Compiled, parts: list[Column]) -> Column:
    parts = parts + [tf[i] > 0 for i in _units(query, MUST)] + [~(tf[i] > 0) for i in _units(query, MUST_NOT) if query.units[i].words]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


class Fts5:
    """An optional term is required beside required ones; exclusions alone find nothing; BM25."""

    name, gap = "fts5", 1

    def normalise(self, text):
        return normalise(text, self.name)

    def compile(self, terms):
        return compile_fts5(terms)

    def keeps(self, unit):
        return True

    def accepts(self, query, tf):
        should = _units(query, SHOULD)
        if not should and not _units(query, MUST):
            return F.lit(False)
        return _all(tf, query, [_any(tf, should)] if should else [])

    def worth(self, tf, length, n_docs, avg_len, n):
        return bm25(tf, idf(n_docs, n), length, avg_len or 1.0)


class Tsquery(Fts5):
    """One vector over title and content; exclusions alone find all else."""

    name, gap = "tsquery", 0

    def compile(self, terms):
        return compile_tsquery(terms)

    def accepts(self, query, tf):
        should = _units(query, SHOULD)
        if not should and not _units(query, MUST) and not _units(query, MUST_NOT):
            return F.lit(False)
        return _all(tf, query, [_any(tf, should)] if should else [])


class Boolean(Fts5):
    """Optional terms only raise the rank beside required ones; short and stop words are not indexed; tf idf^2."""

    name, gap = "boolean", 1

    def compile(self, terms):
        return compile_boolean(terms)

    def keeps(self, unit):
        return len(unit.words) > 1 or unit.prefix or (len(unit.words[0]) >= MIN_TOKEN and unit.words[0] not in STOPWORDS)

    def accepts(self, query, tf):
        should, must = _units(query, SHOULD), _units(query, MUST)
        if not should and not must:
            return F.lit(False)
        return _all(tf, query, [_any(tf, should)] if should and not must else [])

    def worth(self, tf, length, n_docs, avg_len, n):
        return tf * F.lit(log(n_docs / n, 10) ** 2 if n else 0.0)


PROFILES: dict[str, RankingProfile] = {p.name: p for p in (Fts5(), Tsquery(), Boolean())}


def profile_of(name: str) -> RankingProfile:
    if name not in PROFILES:
        raise UnsupportedEngine(name)
    return PROFILES[name]
