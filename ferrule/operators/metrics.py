"""Fixed-budget recovery metrics, populations and similarity diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import gcd
from ..plans.workspace import Workspace
from .numbering import running_sum
from .rankers import BRANCH
from .selection import nearest_ranks, ordered_sum
from .splits import BUDGETS, POLICIES, integers, policy_groups, selected_systems, universe


#: Shares of a group's values that diagnostics report by name.
QUANTILES = {"p10": 0.1, "median": 0.5, "p90": 0.9}


def with_budgets(df: DataFrame, budgets: Sequence[int]) -> DataFrame:
    return df.withColumn("budget", F.explode(F.array(*[F.lit(b).cast("long") for b in integers(budgets, "budgets", 1)])))


def pu_metrics(ranked: DataFrame, budgets: Sequence[int] = BUDGETS, keys: Sequence[str] = (*BRANCH, "method"), strict: bool = True) -> DataFrame:
    """Metrics of a labelled ranking(keys, rank, heldout) at each budget; unlabelled entries are not failures.

    A budget above a branch's pool, or a branch without held-out rows, is an error, never clipped. If not ``strict``,
    such a branch has its row at every budget, as SQL gives it: the hits of its whole pool over the budget as asked
    for, and NaN for what is divided by no held-out rows.
    """
    keys, most = list(keys), max(integers(budgets, "budgets", 1))
    totals = ranked.groupBy(*keys).agg(F.count("*").alias("candidate_count"), F.count_if("heldout").alias("heldout_count"))
    small = F.when(F.lit(strict) & (F.col("candidate_count") < most), F.raise_error(F.lit("a budget is larger than its branch has candidates")).cast("long")).otherwise(F.col("candidate_count"))
    hits = ranked.select(*keys, "rank", "heldout").where(F.col("rank") <= most)
    at = with_budgets(hits, budgets).where("rank <= budget").groupBy(*keys, "budget").agg(F.count_if("heldout").alias("hits"))
    rows = at.join(totals.withColumn("candidate_count", small), keys)
    k, n, h = F.col("budget"), F.col("candidate_count"), F.col("heldout_count")
    by = gcd(k * h, n)
    over = lambda x, y: x / y if strict else F.coalesce(F.try_divide(x, y), F.lit(float("nan")))
    return rows.withColumn("__g", by).select(
        *keys, "budget", "hits", "candidate_count", "heldout_count",
        (F.col("hits") / k).alias("observed_label_fraction"),
        over(F.col("hits"), h).alias("heldout_recall"),
        over(F.col("hits") / k, h / n).alias("observed_label_enrichment"),
        ((k * h) / n).alias("random_expected_hits"),
        F.call_function("div", k * h, F.col("__g")).alias("random_expected_hits_numerator"),
        F.call_function("div", n, F.col("__g")).alias("random_expected_hits_denominator"),
    )


def running_hits(ranked: DataFrame, keys: Sequence[str] = (*BRANCH, "method")) -> DataFrame:
    """Adds the held-out count down to each rank."""
    return running_sum(ranked, [F.asc("rank")], keys, F.col("heldout").cast("long"), "running_hits")


def bench_metrics(ranking: DataFrame, candidates: DataFrame, training: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """Hits, precision, recall, enrichment, novelty, system diversity and element coverage; recall and enrichment are null without positives."""
    pool = candidates.agg(F.count("*").alias("n"), F.sum(F.col("outcome").cast("long")).alias("positives"))
    elements = candidates.select(F.explode("species").alias("e")).agg(F.countDistinct("e").alias("pool_elements"))
    known = training.select("system").distinct().withColumn("__known", F.lit(True))
    most = max(integers(sorted(set(budgets)), "budgets", 1))
    top = ranking.where(F.col("rank") <= most).join(candidates.select("composition", "system", "species"), "composition").join(known, "system", "left")
    each = with_budgets(top, sorted(set(budgets))).where("rank <= budget")
    at = ["method", "seed", "budget"]
    flat = each.groupBy(*at).agg(
        F.sum(F.col("outcome").cast("long")).alias("hits"), F.count_if(F.col("__known").isNull()).alias("novel"), F.countDistinct("system").alias("systems"), F.count("*").alias("taken")
    )
    covered = each.select(*at, F.explode("species").alias("e")).groupBy(*at).agg(F.countDistinct("e").alias("covered")).withColumnRenamed("seed", "__seed")
    rows = flat.join(covered, (flat["method"] == covered["method"]) & (flat["budget"] == covered["budget"]) & flat["seed"].eqNullSafe(covered["__seed"])).drop(covered["method"]).drop(covered["budget"]).drop("__seed")
    rows = rows.join(F.broadcast(pool), F.lit(True)).join(F.broadcast(elements), F.lit(True))  # one row each
    k = F.when(F.col("taken") < F.col("budget"), F.raise_error(F.lit("a budget is larger than the pool of candidates")).cast("long")).otherwise(F.col("budget"))
    some = F.col("positives") > 0
    return rows.select(
        *at, "hits",
        (F.col("hits") / k).alias("precision"),
        F.when(some, F.try_divide("hits", "positives")).alias("recall"),
        F.when(some, F.try_divide(F.col("hits") / k, F.col("positives") / F.col("n"))).alias("enrichment"),
        (F.col("novel") / k).alias("novel_system_fraction"),
        (F.col("systems") / k).alias("unique_system_fraction"),
        (F.col("covered") / F.col("pool_elements")).alias("element_coverage"),
    )


def concentration(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, largest, top5): shares of the largest and the five largest systems."""
    keys = list(keys)
    sizes = members.groupBy(*keys, "system").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "system"))
    rows = sizes.withColumn("at", place).groupBy(*keys).agg(F.max("n").alias("m"), F.sum(F.when(F.col("at") <= 5, F.col("n"))).alias("five"), F.sum("n").alias("t"))
    return rows.select(*keys, (F.col("m") / F.col("t")).alias("largest"), (F.col("five") / F.col("t")).alias("top5"))


def populations(split: DataFrame, groups: DataFrame) -> DataFrame:
    """The 23 columns of a population row, one for each design, policy and seed."""
    is_t, is_c, is_h = F.col("role") == "training", F.col("role") == "candidate", F.col("heldout")
    systems = lambda x: F.countDistinct(F.when(x, F.col("system")))
    rows = split.groupBy(*BRANCH).agg(
        F.count_if(is_t).alias("training_count"), F.count_if(is_c).alias("candidate_count"), F.count_if(is_h).alias("heldout_count"),
        systems(is_t).alias("training_system_count"), systems(is_c).alias("candidate_system_count"), systems(is_h).alias("heldout_system_count"),
        F.count_if(is_t & F.col("mixed")).alias("mixed_training_count"), F.count_if(is_c & F.col("mixed")).alias("mixed_candidate_count"),
    )
    sides = split.groupBy(*BRANCH, "system").agg(F.max(is_t).alias("t"), F.max(is_c).alias("c"))
    overlap = sides.groupBy(*BRANCH).agg(F.count_if(F.col("t") & F.col("c")).alias("system_overlap_count"))
    seeds = [r["seed"] for r in split.select("seed").distinct().collect()]
    chosen = selected_systems(groups, seeds)
    empty = (
        split.where("design = 'system'").select(*BRANCH).distinct().join(chosen, "seed")
        .join(sides.where("design = 'system' AND c").select(*BRANCH, "system").withColumn("met", F.lit(True)), [*BRANCH, "system"], "left")
        .groupBy(*BRANCH).agg(F.count("*").alias("selected_system_count"), F.count_if(F.col("met").isNull()).alias("selected_empty_system_count"))
    )
    total = groups.agg(F.count("*").alias("groups"))
    wide = universe(groups).agg(F.count("*").alias("universe_system_count"))
    usable = policy_groups(groups, POLICIES).groupBy("policy").agg(F.count_if(F.col("label") != "unresolved").alias("usable"), F.count_if(F.col("label") == "unlabelled").alias("unlabelled"))
    of = lambda d, name: d.withColumnsRenamed({"largest": f"{name}_largest_system_fraction", "top5": f"{name}_top5_system_fraction"})
    rows = rows.join(overlap, BRANCH).join(empty, BRANCH, "left").join(usable, "policy").join(F.broadcast(total), F.lit(True)).join(F.broadcast(wide), F.lit(True))
    rows = rows.join(of(concentration(split.where(is_t), BRANCH), "training"), BRANCH).join(of(concentration(split.where(is_h), BRANCH), "heldout"), BRANCH)
    unlabelled = F.col("candidate_count") - F.col("heldout_count")
    zero = F.lit(0).cast("long")
    return rows.select(
        "design", "policy", F.col("seed").alias("split_seed"), "training_count", "candidate_count", "heldout_count",
        unlabelled.alias("unlabelled_count"), (F.col("heldout_count") / F.col("candidate_count")).alias("prevalence"),
        (F.col("groups") - F.col("usable")).alias("excluded_group_count"), (F.col("unlabelled") - unlabelled).alias("unused_unlabelled_count"),
        "universe_system_count", F.coalesce("selected_system_count", zero).alias("selected_system_count"),
        F.coalesce("selected_empty_system_count", zero).alias("selected_empty_system_count"),
        "training_system_count", "candidate_system_count", "heldout_system_count", "system_overlap_count", "mixed_training_count", "mixed_candidate_count",
        "training_largest_system_fraction", "training_top5_system_fraction", "heldout_largest_system_fraction", "heldout_top5_system_fraction",
    )


def diagnostics(values: DataFrame, keys: Sequence[str], value: str = "value", by: str = "composition") -> DataFrame:
    """n, mean (summed in order of ``by``), min, p10, median, p90, max and the shares of at least 0.9 and 0.99."""
    keys = list(keys)
    rows = Workspace(values.sparkSession, "diagnostics").keep(values.select(*keys, by, value), "values")
    at_least = lambda t: (F.count_if(F.col(value) >= t) / F.count("*")).alias(f"fraction_ge_{str(t).replace('.', '')}")
    flat = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), at_least(0.9), at_least(0.99))
    found = nearest_ranks(rows, keys, value, list(QUANTILES.values()))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("share") == p, F.col(value))).alias(name) for name, p in QUANTILES.items()])
    out = flat.join(ordered_sum(rows, keys, value, by), keys).join(wide, keys)
    return out.select(*keys, "n", (F.col("total") / F.col("n")).alias("mean"), "min", *QUANTILES, "max", "fraction_ge_09", "fraction_ge_099")
