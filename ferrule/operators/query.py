"""Scan, filter and rank tables of precomputed scores."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elements import SYMBOLS, validate_element
from ..functions.formula import Composition, with_composition
from ..plans.workspace import Workspace
from .numbering import numbered

DEFAULT_THRESHOLD = 0.01


class InvalidRecords(ValueError):
    """A strict operation met records that do not validate."""


@dataclass(frozen=True)
class QueryFilters:
    """No elements: unrestricted. nary None: unrestricted, but an empty list matches nothing."""

    elements: tuple[str, ...] = ()
    nary: tuple[int, ...] | None = None
    threshold: float = DEFAULT_THRESHOLD
    inclusive: bool = True

    @classmethod
    def of(cls, elements: Iterable[str] | None = None, nary: Iterable[int] | None = None, threshold: float = DEFAULT_THRESHOLD, inclusive: bool = True) -> QueryFilters:
        if isinstance(elements, str) or isinstance(nary, str):
            raise ValueError("elements and nary are collections, not text")
        wanted = tuple(sorted({validate_element(e) for e in elements or ()}))
        if nary is not None:
            nary = list(nary)
            if any(isinstance(n, bool) or not isinstance(n, int) or not 1 <= n <= len(SYMBOLS) for n in nary):
                raise ValueError(f"nary holds integers from 1 to {len(SYMBOLS)}")
            nary = tuple(sorted(set(nary)))
        if isinstance(threshold, bool) or not isinstance(threshold, (int, float)) or not math.isfinite(threshold):
            raise ValueError("threshold must be a finite number")
        if not isinstance(inclusive, bool):
            raise ValueError("inclusive must be a boolean")
        return cls(wanted, nary, float(threshold), inclusive)

    def scores(self, score: Column) -> Column:
        """Pushed to the scan: rows that pass, and null scores, so that those surface as errors."""
        return (score >= self.threshold if self.inclusive else score > self.threshold) | score.isNull()

    def members(self, species: Column, nary: Column) -> Column:
        out = F.lit(True)
        for e in self.elements:
            out = out & F.array_contains(species, e)
        if self.nary is not None:
            out = out & (nary.isin(*self.nary) if self.nary else F.lit(False))
        return out


def score_error(score: Column) -> Column:
    return F.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), "invalid_score")


def validated(df: DataFrame, composition: str = "composition", score: str = "score") -> DataFrame:
    """with_composition plus ``error``: the first of not text, bad score, bad formula."""
    bad = F.when(F.col(composition).isNull(), "invalid_record").otherwise(F.coalesce(score_error(F.col(score)), F.col("formula_error")))
    return with_composition(df, composition).withColumn("error", bad)


def require_valid(df: DataFrame, error: str = "error") -> None:
    """One action: raises if any row has an error. Run it before a residual filter, so that no plan can move one past it."""
    found = df.where(F.col(error).isNotNull()).groupBy(error).count().orderBy(error).collect()
    if found:
        raise InvalidRecords(", ".join(f"{r[error]}: {r['count']}" for r in found))


class RankingMethod(ABC):
    """A pluggable ranking: a Column over formula, terms, nary and score; larger is better and it must be finite."""

    @abstractmethod
    def value(self, formula: Column, terms: Column, score: Column) -> Column: ...


class ScoreRanking(RankingMethod):
    def value(self, formula: Column, terms: Column, score: Column) -> Column:
        return score


class SimilarityRanking(RankingMethod):
    def __init__(self, reference: str | Composition):
        self.reference = reference if isinstance(reference, Composition) else Composition(reference)

    def value(self, formula: Column, terms: Column, score: Column) -> Column:
        return self.reference.cosine(terms, formula)


def ranking_values(df: DataFrame, method: RankingMethod) -> DataFrame:
    """Adds ranking_value, computed once a row."""
    return df.withColumn("ranking_value", method.value(F.col("formula"), F.col("terms"), F.col("score")).cast("double"))


def rank_compositions(df: DataFrame, method: RankingMethod | None = None, check: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows by value, then stored score, then formula; duplicates stay. Adds ranking_value and rank.

    ``columns``, with formula and score among them, are what the ranking keeps: the order is written, so others cost.
    """
    valued = ranking_values(df, method or ScoreRanking())
    valued = Workspace(df.sparkSession, "ranking").keep(valued.select(*columns, "ranking_value") if columns else valued, "values")
    if check:
        require_valid(valued.withColumn("__bad", score_error(F.col("ranking_value"))), "__bad")
    return numbered(valued, [F.desc("ranking_value"), F.desc("score"), F.asc("formula")])


def rank_by_score(df: DataFrame) -> DataFrame:
    return rank_compositions(df, ScoreRanking())


def rank_by_similarity(df: DataFrame, reference: str | Composition) -> DataFrame:
    return rank_compositions(df, SimilarityRanking(reference))


def query_compositions(
    table: DataFrame,
    elements: Iterable[str] | None = None,
    nary: Iterable[int] | None = None,
    threshold: float = DEFAULT_THRESHOLD,
    inclusive: bool = True,
    ranking: RankingMethod | None = None,
    legacy: bool = False,
) -> DataFrame:
    """Strict query of (composition, score): every row that passes the threshold must be valid, or the query fails.

    In a legacy table (one a arity, with element columns) only rows that pass the element filter are validated.
    """
    filters = QueryFilters.of(elements, nary, threshold, inclusive)
    rows = validated(filtered_scan(table, filters, legacy))
    require_valid(rows)
    return rank_compositions(rows.where(filters.members(F.col("species"), F.col("nary"))), ranking)


def filtered_scan(table: DataFrame, filters: QueryFilters, legacy: bool = False) -> DataFrame:
    passed = table.where(filters.scores(F.col("score")))
    if legacy:
        if filters.nary is not None:
            passed = passed.where(F.col("nary").isin(*filters.nary) if filters.nary else F.lit(False))
        for e in filters.elements:
            passed = passed.where(F.array_contains("elements", e))
        passed = passed.drop("nary", "elements", "amounts")
    return passed


def matching(table: DataFrame, filters: QueryFilters) -> DataFrame:
    """The lazy form for tables known to be clean: threshold, formula columns, element and arity filter."""
    return validated(filtered_scan(table, filters)).where(F.col("error").isNull() & filters.members(F.col("species"), F.col("nary")))
