"""Rankings of candidates: the positive-unlabelled trio and the binary benchmark's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.formula import parse_each
from ..plans.workspace import Workspace
from .nearest import nearest
from .numbering import numbered
from .query import InvalidRecords
from .splits import integers

PU_METHODS = ("random", "popularity", "similarity")
BENCH_METHODS = ("score", "popularity", "random")
BRANCH = ["design", "policy", "seed"]


def element_frequency(training: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, element, n): each element once a training composition."""
    return training.select(*keys, F.explode("species").alias("element")).groupBy(*keys, "element").agg(F.count("*").alias("n"))


def popularity(candidates: DataFrame, training: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds value: mean training frequency of the elements; unseen ones count 0.

    The frequencies have at most one row an element and branch.
    """
    keys = list(keys)
    frequency = element_frequency(training, keys)
    wide = frequency.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("element", "n"))).alias("__n"))
    size = training.groupBy(*keys).agg(F.count("*").alias("__t"))
    stats = wide.join(size, keys) if keys else wide.join(F.broadcast(size), F.lit(True))
    joined = candidates.join(F.broadcast(stats) if not keys else stats, keys or F.lit(True), "inner" if keys else "cross")
    total = F.aggregate("species", F.lit(0).cast("long"), lambda s, e: s + F.coalesce(F.try_element_at("__n", e), F.lit(0).cast("long")))
    return joined.withColumn("value", total / (F.size("species") * F.col("__t"))).drop("__n", "__t")


def split_sides(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates and training of a split with formula columns; formulas are parsed once, not once a branch. The rows are written once for both."""
    parsed = parse_each(split.select("composition").distinct()).select("composition", "terms", "species")
    rows = Workspace(split.sparkSession, "sides").keep(split.join(parsed, "composition"), "rows")
    return rows.where("role = 'candidate'").drop("heldout"), rows.where("role = 'training'").drop("heldout")


def pu_rank(split: DataFrame, methods: Sequence[str] = PU_METHODS, tie_seed: int = hashing.TIE_SEED) -> DataFrame:
    """(design, policy, seed, method, rank, composition, score, random_key, tie_key) for every branch at once.

    random goes by its key, then the tie key, then the formula, and has no score; the others by score
    first. Evaluation labels are not read.
    """
    if set(methods) - set(PU_METHODS) or len(set(methods)) != len(methods):
        raise ValueError("unknown or repeated method")
    candidates, training = split_sides(split)
    parts = []
    if "random" in methods:
        drawn = hashing.key(hashing.PU_RANDOM, F.col("seed") + hashing.RANKING_SEED, F.col("composition"))
        parts.append(candidates.select(*BRANCH, F.lit("random").alias("method"), "composition", F.lit(None).cast("double").alias("score"), drawn.alias("random_key")))
    if "popularity" in methods:
        parts.append(popularity(candidates, training, BRANCH).select(*BRANCH, F.lit("popularity").alias("method"), "composition", F.col("value").alias("score"), F.lit(None).cast("string").alias("random_key")))
    if "similarity" in methods:
        parts.append(nearest(candidates, training, BRANCH).select(*BRANCH, F.lit("similarity").alias("method"), "composition", F.col("value").alias("score"), F.lit(None).cast("string").alias("random_key")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("tie_key", hashing.key(hashing.PU_TIE, tie_seed, F.col("composition")))
    return numbered(rows, [F.desc_nulls_last("score"), F.asc_nulls_last("random_key"), F.asc("tie_key"), F.asc("composition")], [*BRANCH, "method"])


def labelled(ranking: DataFrame, split: DataFrame) -> DataFrame:
    """Attach observed labels after ranking."""
    held = split.where("role = 'candidate'").select(*BRANCH, "composition", F.col("heldout"))
    return ranking.join(held, [*BRANCH, "composition"]).withColumn("observed_label", F.when(F.col("heldout"), "positive").otherwise("unlabelled"))


def filtered(ranking: DataFrame, eligible: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A saved ranking kept to eligible candidates: original_rank stays, rank is numbered anew."""
    kept = ranking.withColumnRenamed("rank", "original_rank").join(eligible.select(*keys, "composition").distinct(), [*keys, "composition"], "left_semi")
    return numbered(kept, [F.asc("original_rank")], [*keys, "method"])


def check_bench(candidates: DataFrame, training: DataFrame, budgets: Sequence[int]) -> None:
    """What a benchmark refuses: no training, repeated or shared compositions, and budgets beyond the pool."""
    most = max(integers(budgets, "budgets", 1))
    if not training.head(1):
        raise InvalidRecords("there is no training")
    both = candidates.select("composition", F.lit(1).alias("c"), F.lit(0).alias("t")).unionByName(training.select("composition", F.lit(0).alias("c"), F.lit(1).alias("t")))
    again = both.groupBy("composition").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).where("c + t > 1").orderBy("composition").first()
    if again:
        raise InvalidRecords(f"{again['composition']} is {again['c']} times a candidate and {again['t']} times in training")
    if (n := candidates.count()) < most:
        raise InvalidRecords(f"a budget of {most} is more than the {n} candidates")


def bench_rank(candidates: DataFrame, training: DataFrame, methods: Sequence[str] = BENCH_METHODS, seeds: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """(method, seed, rank, composition, stored_score, ranking_value, random_key, outcome) over formula columns.

    score and popularity run once, with a null seed; random once a seed. Ties never use the stored score.
    """
    seeds = sorted(set(seeds))
    parts = []
    base = ["composition", F.col("score").alias("stored_score"), "outcome"]
    none, nokey = F.lit(None).cast("long").alias("seed"), F.lit(None).cast("string").alias("random_key")
    if "score" in methods:
        parts.append(candidates.select(F.lit("score").alias("method"), none, *base, F.col("score").alias("ranking_value"), nokey))
    if "popularity" in methods:
        parts.append(popularity(candidates, training).select(F.lit("popularity").alias("method"), none, *base, F.col("value").alias("ranking_value"), nokey))
    if "random" in methods:
        each = candidates.withColumn("seed", F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])))
        drawn = hashing.key(hashing.BENCH_RANDOM, F.col("seed"), F.col("composition"))
        parts.append(each.select(F.lit("random").alias("method"), "seed", *base, F.lit(None).cast("double").alias("ranking_value"), drawn.alias("random_key")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return numbered(rows, [F.desc_nulls_last("ranking_value"), F.asc_nulls_last("random_key"), F.asc("composition")], ["method", "seed"])
