"""The binary benchmark as a report: captured inputs, every ranking, metrics as data and as a page, and what they were made of."""

from __future__ import annotations

import shutil
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula import with_composition
from ..operators import metrics, query, rankers
from ..sources import sinks, tsv
from ..sources.texts import write_texts
from .baseline import file_sha256
from .workspace import Workspace

CANDIDATES = ["method", "seed", "rank", "composition", "stored_score", "ranking_value", "outcome"]
SHOWN = {"hits": "Hits", "precision": "Precision", "novel_system_fraction": "Novel systems", "unique_system_fraction": "Unique systems", "element_coverage": "Element coverage"}
NOTES = """
Hits are candidates with outcome 1 among the first of a ranking, as many as the budget; precision is their share of the budget. Recall is
their share of all positives, and enrichment is precision over the pool's share of positives; both are null without positives.
A system is a set of elements: novel ones do not occur in training. Fractions of systems are of the budget, and element coverage
is of the elements of the pool. A random ranking's seeds are runs over the same data, not samples of others.

The inputs are in this directory as they were read; config.toml has their hashes and all settings. Scores must come from
a model that has not seen the outcomes. Shared compositions are refused, but what a model was trained on cannot be checked here.
"""


def inputs(spark: SparkSession, candidates: str, training: str) -> tuple[DataFrame, DataFrame]:
    """The two sides with formula columns, written once; any invalid row raises."""
    rows = query.validated(tsv.read_candidates(spark, candidates))
    known = with_composition(tsv.read_tsv(spark, training, ["composition"])).withColumn("error", F.col("formula_error"))
    query.require_valid(rows)
    query.require_valid(known)
    work = Workspace(spark, "benchmark")
    pick = lambda df, *c: work.keep(df.select(F.col("formula").alias("composition"), "species", "system", *c), "side")
    return pick(rows, "score", "outcome"), pick(known)


def page(measured: list, n_candidates: int, n_positive: int, n_training: int) -> str:
    head = f"# Rankings at fixed budgets\n\nThe pool has {n_candidates} candidates, {n_positive} of them positive; training has {n_training} compositions. The outcomes are labels that were given, and say nothing of stability.\n\n"
    rows = ["| Method | Seed | Budget | " + " | ".join(SHOWN.values()) + " |", "| --- " * (3 + len(SHOWN)) + "|"]
    for m in measured:
        values = [str(m[c]) if isinstance(m[c], int) else f"{m[c]:.4f}" for c in SHOWN]
        rows.append(f"| {m['method']} | {'-' if m['seed'] is None else m['seed']} | {m['budget']} | {' | '.join(values)} |")
    return head + "\n".join(rows) + "\n" + NOTES


def run(spark: SparkSession, candidates: str, training: str, output: str, source: str, methods: Sequence[str] = rankers.BENCH_METHODS, seeds: Sequence[int] = (0, 1, 2), budgets: Sequence[int] = (25, 50, 100)) -> dict:
    """Rank, measure and write input.tsv, training.tsv, candidates.csv, metrics.json, benchmark.md and config.toml; returns the config.

    The inputs are copied first and read from the copies, so the hashes are of what was ranked. Metrics have a row for
    each method, seed and budget.
    """
    if not source.strip():
        raise ValueError("the source must be described")
    with sinks.new_directory(output) as root:
        for name, path in (("input.tsv", candidates), ("training.tsv", training)):
            shutil.copyfile(path, root / name)
        pool, known = inputs(spark, str(root / "input.tsv"), str(root / "training.tsv"))
        rankers.check_bench(pool, known, budgets)
        ranking = Workspace(spark, "benchmark").keep(rankers.bench_rank(pool, known, methods, seeds), "ranking")
        measured = [r.asDict() for r in metrics.bench_metrics(ranking, pool, known, budgets).orderBy("method", "seed", "budget").collect()]
        _, digest = write_texts(ranking, root, "candidates.csv", ["method", "seed", "rank"], CANDIDATES, sep=",")["candidates.csv"]
        sinks.write_json({"schema_version": 1, "metrics": measured}, root / "metrics.json")
        n, positive = pool.count(), pool.where("outcome = 1").count()
        (root / "benchmark.md").write_text(page(measured, n, positive, known.count()))
        config = {
            "schema_version": 1, "source": source, "methods": sorted(methods), "seeds": sorted(set(seeds)), "budgets": sorted(set(budgets)), "candidate_count": n, "positive_count": positive, "training_count": known.count(),
            "files": {"candidates.csv": digest} | {name: file_sha256(Path(root) / name) for name in ("input.tsv", "training.tsv", "metrics.json", "benchmark.md")},
        }
        sinks.write_toml(config, root / "config.toml")
    return config
