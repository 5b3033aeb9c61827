"""Deterministic holdouts by hash orderings; all branches live in one table keyed by design, policy and seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..plans.workspace import Workspace
from .numbering import numbered

POLICIES = ("original", "exclude_mixed", "unlabel_mixed")
DESIGNS = ("composition", "system")
SEEDS = tuple(range(20))
BUDGETS = (20, 50, 100, 200)
KEYS = ("design", "policy", "seed")


def integers(values: Sequence[int], name: str, least: int = 0) -> tuple[int, ...]:
    """A checked list of distinct integers; duplicates are an error here."""
    values = list(values)
    if not values or any(isinstance(v, bool) or not isinstance(v, int) or v < least for v in values):
        raise ValueError(f"{name} must be integers of at least {least}")
    if len(set(values)) != len(values):
        raise ValueError(f"duplicate {name}")
    return tuple(sorted(values))


def policy_groups(groups: DataFrame, policies: Sequence[str] = POLICIES) -> DataFrame:
    """(policy, composition, system, label, mixed): the groups under each label policy."""
    if set(policies) - set(POLICIES):
        raise ValueError("unknown label policy")
    each = groups.withColumn("policy", F.explode(F.array(*[F.lit(p) for p in policies])))
    kept = each.where(~(F.col("mixed") & (F.col("policy") == "exclude_mixed")))
    moved = F.when(F.col("mixed") & (F.col("policy") == "unlabel_mixed"), "unlabelled").otherwise(F.col("label"))
    return kept.withColumn("label", moved).select("policy", "composition", "system", "label", "mixed")


def with_seeds(df: DataFrame, seeds: Sequence[int] = SEEDS) -> DataFrame:
    return df.withColumn("seed", F.explode(F.array(*[F.lit(s).cast("long") for s in integers(seeds, "seeds")])))


def composition_splits(groups: DataFrame, seeds: Sequence[int] = SEEDS, policies: Sequence[str] = POLICIES) -> DataFrame:
    """(design, policy, seed, composition, system, mixed, role, heldout): floor(P/5) positives are held out by hash order.

    role is training or candidate and carries no label; heldout is for evaluation only.
    """
    pool = with_seeds(policy_groups(groups, policies).where("label <> 'unresolved'"), seeds)
    positive = F.col("label") == "positive"
    ranked = _first_fifth(pool, hashing.key(hashing.SPLIT, F.col("seed"), F.col("composition")), "composition", ["policy", "seed", "label"])
    return _roles(ranked.withColumn("heldout", positive & F.col("__first")).withColumn("design", F.lit("composition")), positive & ~F.col("heldout"))


def _first_fifth(df: DataFrame, key: Column, tie: str, keys: list[str]) -> DataFrame:
    """Adds __first: is the row among the first n div 5 of its keys by the hash key?"""
    rows = Workspace(df.sparkSession, "splits").keep(numbered(df.withColumn("__key", key), [F.asc("__key"), F.asc(tie)], keys, "__place"), "placed")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    return rows.join(F.broadcast(sizes), keys).withColumn("__first", F.expr("__place <= __n div 5")).drop("__place", "__n", "__key")  # a row for each branch


def _roles(df: DataFrame, training) -> DataFrame:
    role = F.when(training, "training").otherwise("candidate")
    return df.withColumn("role", role).select(*KEYS, "composition", "system", "mixed", "role", "heldout")


def universe(groups: DataFrame) -> DataFrame:
    """Systems of original positive and unlabelled groups, before any policy."""
    return groups.where("label <> 'unresolved'").select("system").distinct()


def selected_systems(groups: DataFrame, seeds: Sequence[int] = SEEDS) -> DataFrame:
    """(seed, system): floor(S/5) systems by hash order."""
    each = with_seeds(universe(groups), seeds)
    ranked = _first_fifth(each, hashing.key(hashing.SYSTEM_SPLIT, F.col("seed"), F.col("system")), "system", ["seed"])
    return ranked.where("__first").select("seed", "system")


def system_splits(groups: DataFrame, seeds: Sequence[int] = SEEDS, policies: Sequence[str] = POLICIES) -> DataFrame:
    """As composition_splits, but whole systems are held out: training are positives outside, candidates all inside the selected systems."""
    pool = with_seeds(policy_groups(groups, policies).where("label <> 'unresolved'"), seeds)
    chosen = selected_systems(groups, seeds).withColumn("__in", F.lit(True))
    joined = pool.join(chosen, ["seed", "system"], "left")
    inside, positive = F.col("__in").isNotNull(), F.col("label") == "positive"
    kept = joined.where(inside | positive).withColumn("heldout", inside & positive).withColumn("design", F.lit("system"))
    return _roles(kept, positive & ~inside)


def evaluation_only(split: DataFrame) -> DataFrame:
    """The original split's membership seen by each policy: only candidates and held-out rows change, training stays."""
    base = split.where("policy = 'original'").drop("policy").withColumn("policy", F.explode(F.array(*[F.lit(p) for p in POLICIES])))
    kept = base.where(~((F.col("policy") == "exclude_mixed") & F.col("mixed") & (F.col("role") == "candidate")))
    return kept.withColumn("heldout", F.col("heldout") & ((F.col("policy") == "original") | ~F.col("mixed"))).select(split.columns)


def counts(split: DataFrame) -> DataFrame:
    of = lambda x: F.count_if(x)
    return split.groupBy(*KEYS).agg(
        of(F.col("role") == "training").alias("training_count"), of(F.col("role") == "candidate").alias("candidate_count"), of(F.col("heldout")).alias("heldout_count")
    )


def check_splits(split: DataFrame, budgets: Sequence[int] = BUDGETS) -> None:
    """One action over all branches before any is ranked: every population must be feasible for the budgets."""
    most = max(integers(budgets, "budgets", 1))
    bad = counts(split).where(f"training_count = 0 OR heldout_count = 0 OR candidate_count <= heldout_count OR candidate_count < {most}").first()
    if bad:
        raise ValueError(f"infeasible branch: {bad.asDict()}")
    twice = split.groupBy(*KEYS, "composition").count().where("count > 1").first()
    if twice:
        raise ValueError(f"duplicate membership: {twice.asDict()}")
