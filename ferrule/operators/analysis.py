"""Comparisons of methods, policies and designs over metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.elements import HALOGENS
from .metrics import with_budgets
from .rankers import BRANCH

MEASURES = ("hits", "observed_label_fraction", "heldout_recall", "observed_label_enrichment", "random_expected_hits", "candidate_count", "heldout_count")


def paired(metrics: DataFrame, first: str = "similarity", second: str = "popularity", keys: Sequence[str] = (*BRANCH, "budget")) -> DataFrame:
    """(keys, first, second, difference) of two methods' hits."""
    wide = metrics.groupBy(*keys).pivot("method", [first, second]).agg(F.first("hits"))
    return wide.withColumn("difference", F.col(first) - F.col(second))


def paired_summary(pairs: DataFrame, keys: Sequence[str] = ("design", "policy", "budget")) -> DataFrame:
    d = F.col("difference")
    return pairs.groupBy(*keys).agg(
        F.avg(d).alias("mean"), F.median(d).alias("median"), F.min(d).alias("least"), F.max(d).alias("most"),
        F.count_if(d > 0).alias("positive"), F.count_if(d == 0).alias("zero"), F.count_if(d < 0).alias("negative"),
    )


def method_summary(metrics: DataFrame, keys: Sequence[str] = ("design", "policy", "method", "budget")) -> DataFrame:
    """Means of the measures over seeds."""
    return metrics.groupBy(*keys).agg(*[F.avg(m).alias(f"mean_{m}") for m in MEASURES])


def depth_summary(depths: DataFrame, keys: Sequence[str] = ("design", "policy", "method", "budget")) -> DataFrame:
    """The least and greatest original depth over seeds."""
    return depths.groupBy(*keys).agg(F.min("original_depth").alias("least_depth"), F.max("original_depth").alias("greatest_depth"))


def change_from(pairs: DataFrame, column: str, base: str) -> DataFrame:
    """difference less that of the branch whose ``column`` (policy or design) is ``base``."""
    keys = [c for c in ("design", "policy", "seed", "budget") if c in pairs.columns and c != column]
    of = pairs.where(F.col(column) == base).select(*keys, F.col("difference").alias("base_difference"))
    return pairs.where(F.col(column) != base).join(of, keys).select(column, *keys, "difference", "base_difference", (F.col("difference") - F.col("base_difference")).alias("change"))


def sign_changes(summary: DataFrame, budget: int = 100) -> DataFrame:
    """Does the sign of the mean difference at a budget differ from the original policy's?"""
    at = summary.where(F.col("budget") == budget).select("design", "policy", "mean")
    base = at.where("policy = 'original'").select("design", F.col("mean").alias("original_mean"))
    rows = at.where("policy <> 'original'").join(base, "design")
    return rows.withColumn("sign_changed", F.signum("mean") != F.signum("original_mean"))


def score_ties(ranking: DataFrame, budgets: Sequence[int], keys: Sequence[str] = (*BRANCH, "method")) -> DataFrame:
    """Distinct scores, the largest tie, the tie at the cutoff, and how many of that tie are selected."""
    keys = list(keys)
    scored = ranking.where("score IS NOT NULL")
    tied = scored.groupBy(*keys, "score").agg(F.count("*").alias("tie"), F.min("rank").alias("first_rank"))
    flat = tied.groupBy(*keys).agg(F.count("*").alias("distinct_scores"), F.max("tie").alias("largest_tie"))
    cut = with_budgets(tied, budgets).where("first_rank <= budget AND budget < first_rank + tie")
    return cut.join(flat, keys).select(*keys, "budget", "distinct_scores", "largest_tie", F.col("tie").alias("cutoff_tie_size"), (F.col("budget") - F.col("first_rank") + 1).alias("selected_from_cutoff_tie"))


def subgroups(df: DataFrame) -> DataFrame:
    """Explodes each composition into (kind, group): its system, each element, hydrogen, halogen and mixed flags."""
    halogen = F.arrays_overlap("species", F.array(*[F.lit(h) for h in HALOGENS]))
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("group"))
    fixed = F.array(one("chemical_system", F.col("system")), one("H_containing", F.array_contains("species", "H").cast("string")), one("halogen_containing", halogen.cast("string")), one("mixed_flags", F.col("mixed").cast("string")))
    elements = F.transform("species", lambda e: one("element", e))
    return df.withColumn("__g", F.explode(F.concat(fixed, elements))).withColumns({"kind": F.col("__g.kind"), "group": F.col("__g.group")}).drop("__g")


def breakdowns(members: DataFrame, ranking: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """Per branch, method, budget, kind and group: counts, hits, recall and fraction (null on a zero denominator).

    members: the split with species; ranking: method, rank, composition by branch.
    """
    each = subgroups(members)
    keys = [*BRANCH, "kind", "group"]
    of = lambda x, name: F.count_if(x).alias(name)
    sizes = each.groupBy(*keys).agg(of(F.col("role") == "training", "training_count"), of(F.col("role") == "candidate", "candidate_count"), of(F.col("heldout"), "heldout_count"))
    most = max(budgets)
    top = ranking.where(F.col("rank") <= most).select(*BRANCH, "method", "rank", "composition").join(each.where("role = 'candidate'").select(*keys, "composition", "heldout"), [*BRANCH, "composition"])
    chosen = with_budgets(top, budgets).where("rank <= budget").groupBy(*keys, "method", "budget").agg(F.count("*").alias("selected_count"), of(F.col("heldout"), "hits"))
    grid = with_budgets(ranking.select(*BRANCH, "method").distinct(), budgets)
    rows = sizes.join(grid, BRANCH).join(chosen, [*keys, "method", "budget"], "left").fillna(0, ["selected_count", "hits"])
    return rows.select(*keys, "method", "budget", "training_count", "candidate_count", "heldout_count", "selected_count", "hits", F.try_divide("hits", "heldout_count").alias("recall"), F.try_divide("hits", "selected_count").alias("fraction"))


def coverage(groups: DataFrame, scores: DataFrame) -> DataFrame:
    """Audited groups met in external scores(formula, score), by label: covered, total, percent, and the range of their scores."""
    external = scores.groupBy(F.col("formula").alias("composition")).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("n"))
    rows = groups.join(external, "composition", "left")
    return rows.groupBy("label").agg(
        F.count("*").alias("total"), F.count("n").alias("covered"), (100 * F.count("n") / F.count("*")).alias("percent"), F.min("lo").alias("score_min"), F.max("hi").alias("score_max"),
        F.count_if(F.col("n") > 1).alias("duplicate_canonical"),
    )


def optimisation_summary(fits: DataFrame) -> DataFrame:
    """Fits by design and policy: how many ended at the criterion or the iteration limit, and the ranges of iterations and objective."""
    one = fits.select(*BRANCH, "termination", "iterations", "objective").distinct()
    return one.groupBy("design", "policy").agg(
        F.count_if(F.col("termination") == "projected_gradient").alias("converged"), F.count_if(F.col("termination") == "iteration_limit").alias("capped"),
        F.min("iterations").alias("least_iterations"), F.max("iterations").alias("most_iterations"), F.min("objective").alias("least_objective"), F.max("objective").alias("most_objective"),
    )
