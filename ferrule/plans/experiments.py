"""Whole experiments: audit, split, rank, measure, compare, as one plan over all branches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, metrics, pairmodel, rankers, splits, verify
from ..sources.sinks import write_report
from ..sources.texts import write_texts

METHODS = (*rankers.PU_METHODS, "pair_model")


def rank_all(split: DataFrame, methods: Sequence[str] = rankers.PU_METHODS) -> DataFrame:
    """Labelled rankings of every branch and method; labels join only after ranking."""
    usual = [m for m in methods if m != "pair_model"]
    rows = rankers.pu_rank(split, usual) if usual else None
    if "pair_model" in methods:
        fitted = pairmodel.rank_candidates(split).withColumn("random_key", F.lit(None).cast("string")).drop("coverage", "observed_training_pair")
        rows = fitted if rows is None else rows.unionByName(fitted)
    return rankers.labelled(rows, split).select(*rankers.BRANCH, "method", "rank", "composition", "score", "random_key", "tie_key", "heldout", "observed_label")


def experiment(
    groups: DataFrame,
    designs: Sequence[str] = splits.DESIGNS,
    policies: Sequence[str] = splits.POLICIES,
    seeds: Sequence[int] = splits.SEEDS,
    budgets: Sequence[int] = splits.BUDGETS,
    methods: Sequence[str] = rankers.PU_METHODS,
    check: bool = True,
) -> dict[str, DataFrame]:
    """Tables split, population, ranking, metrics, paired and summary. All branches are checked before any is ranked."""
    parts = []
    if "composition" in designs:
        parts.append(splits.composition_splits(groups, seeds, policies))
    if "system" in designs:
        parts.append(splits.system_splits(groups, seeds, policies))
    if not parts:
        raise ValueError("unknown design")
    split = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if check:
        splits.check_splits(split, budgets)
    ranking = rank_all(split, methods)
    measured = metrics.pu_metrics(ranking, budgets)
    out = {"split": split, "population": metrics.populations(split, groups), "ranking": ranking, "metrics": measured, "method_summary": analysis.method_summary(measured)}
    if {"similarity", "popularity"} <= set(methods):
        out["paired"] = analysis.paired(measured)
        out["paired_summary"] = analysis.paired_summary(out["paired"])
    return out


#: Columns of a saved ranking; its seed and method are in its path.
SAVED = ["rank", "composition", "score", "random_key", "tie_key", "observed_label"]


def write_rankings(ranking: DataFrame, path: str | Path) -> dict[str, tuple[int, str]]:
    """Labelled rankings of one design and policy as split-NN/method.tsv below a folder; returns each file's rows and hash."""
    return write_texts(ranking, path, F.format_string("split-%02d/%s.tsv", "seed", "method"), ["rank"], SAVED)


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    """All saved rankings below a folder in one scan; seed and method come from the paths, blank cells are null, other headers raise."""
    kinds = {"rank": "bigint", "score": "double"}
    rows = spark.read.csv(f"{path}/split-*/*.tsv", ", ".join(f"{c} {kinds.get(c, 'string')}" for c in SAVED), sep="\t", header=True, enforceSchema=False, quote="", mode="FAILFAST")
    place = F.col("_metadata.file_path")
    seed = F.regexp_extract(place, r"split-([0-9]+)/[^/]*$", 1).cast("long")
    rows = rows.select(F.lit("composition").alias("design"), F.lit("original").alias("policy"), seed.alias("seed"), F.regexp_extract(place, r"([^/]*)\.tsv$", 1).alias("method"), *SAVED)
    return rows


def evaluation_only(
    groups: DataFrame, seeds: Sequence[int] = splits.SEEDS, budgets: Sequence[int] = splits.BUDGETS, methods: Sequence[str] = rankers.PU_METHODS, saved: DataFrame | None = None,
    strict: bool = True,
) -> dict[str, DataFrame]:
    """Rankings trained under original labels, evaluated under every policy: candidates are filtered and numbered anew.

    With ``saved`` rankings (read_rankings) nothing is ranked again. depths says how deep the original ranking was read
    to fill each budget, depth_summary the least and greatest depth over the seeds. ``strict`` is that of pu_metrics.
    """
    base = splits.composition_splits(groups, seeds, ("original",))
    seen = splits.evaluation_only(base)
    ranked = (rankers.pu_rank(base, methods) if saved is None else saved.where(F.col("seed").isin(*seeds) & F.col("method").isin(*methods)).drop("observed_label")).drop("policy")
    each = ranked.withColumn("policy", F.explode(F.array(*[F.lit(p) for p in splits.POLICIES])))
    kept = rankers.filtered(each, seen.where("role = 'candidate'"), rankers.BRANCH)
    ranking = rankers.labelled(kept, seen)
    depths = ranking.where(F.col("rank").isin(*budgets)).select(*rankers.BRANCH, "method", F.col("rank").alias("budget"), F.col("original_rank").alias("original_depth"))
    return {"split": seen, "ranking": ranking, "metrics": metrics.pu_metrics(ranking, budgets, strict=strict), "depths": depths, "depth_summary": analysis.depth_summary(depths)}


#: Designs, policies and methods of the three studies that compare branches.
STUDIES = {
    "sensitivity": (("composition",), splits.POLICIES, rankers.PU_METHODS),
    "system": (splits.DESIGNS, splits.POLICIES, rankers.PU_METHODS),
    "pair": (splits.DESIGNS, ("original", "exclude_mixed"), ("popularity", "similarity", "pair_model")),
}


def study(groups: DataFrame, name: str, seeds: Sequence[int] = splits.SEEDS, budgets: Sequence[int] = splits.BUDGETS) -> dict[str, DataFrame]:
    """The tables of an experiment and the study's comparisons: by policy, by design, ties, diagnostics, learned less baselines, and how fits ended."""
    if name not in STUDIES:
        raise ValueError(f"no study is called {name}")
    designs, policies, methods = STUDIES[name]
    out = experiment(groups, designs, policies, seeds, budgets, methods)
    if {"exclude_mixed", "unlabel_mixed"} <= set(policies):
        verify.require_invariant(out["ranking"])
        out["sign_changes"] = analysis.sign_changes(out["paired_summary"], max(budgets))
    out["change_by_policy"] = analysis.change_from(out["paired"], "policy", "original")
    if len(designs) > 1:
        out["change_by_design"] = analysis.change_from(out["paired"], "design", "composition")
    out["ties"] = analysis.score_ties(out["ranking"], budgets)
    if "pair_model" in methods:
        for base in ("popularity", "similarity"):
            out[f"learned_less_{base}"] = analysis.paired_summary(analysis.paired(out["metrics"], "pair_model", base))
        training = rankers.split_sides(out["split"])[1]
        out["fits"] = analysis.optimisation_summary(pairmodel.fit_branches(training))
        out |= pairmodel.fit_tables(training)
    return out


def write_experiment(tables: Mapping[str, DataFrame], path: str, config: Mapping) -> None:
    order = lambda df: [c for c in df.columns if df.schema[c].dataType.simpleString() != "double"]
    write_report({k: (v, order(v)) for k, v in tables.items() if k != "split"}, path, config)
