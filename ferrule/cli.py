"""Command line: query, import, validate, benchmark, audit, split, experiment, study and snapshot over the Spark operators."""

from __future__ import annotations

import argparse
import sys
import tomllib
from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .operators import audit, query, rankers, splits, validate, verify
from .plans import audits, baseline, benchmark, experiments, recheck
from .sources import scores, sinks, sqlite_sink, tsv


def session() -> SparkSession:
    return SparkSession.builder.appName("ferrule").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def load(spark: SparkSession, path: str, filters: query.QueryFilters | None = None) -> DataFrame:
    """Scores from a SQLite file (which takes the filters), a TSV, or the Parquet of an import or a plain folder."""
    if path.endswith(".tsv"):
        return tsv.read_scored(spark, path)
    if path.endswith((".sqlite", ".db")):
        return scores.read_scores(spark, path, filters)
    found = Path(path, "compositions")
    return spark.read.parquet(str(found) if found.is_dir() else path)


def notes(path: str, nary: Sequence[int]) -> list[str]:
    """What a reader should know of the arities asked of a file with a table for each arity."""
    info = scores.database_info(path)
    if info["schema"] != "legacy":
        return []
    absent = sorted(set(nary) - {n for _, n, _ in info["tables"]})
    ionic = [n for _, n, only in info["tables"] if only and n in nary]
    return [f"this file has no table of arity {n}" for n in absent] + [f"its table of arity {n} holds ionic compositions only" for n in ionic]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="ferrule")
    sub = out.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query")
    q.add_argument("-d", "--database", required=True)
    q.add_argument("-e", "--elements", nargs="*", default=[])
    q.add_argument("-n", "--nary", nargs="*", type=int, default=[3])
    q.add_argument("--threshold", type=float, default=query.DEFAULT_THRESHOLD)
    q.add_argument("--strict-threshold", action="store_true")
    q.add_argument("--rank", choices=["score", "similarity"], default="score")
    q.add_argument("--reference")
    i = sub.add_parser("import")
    i.add_argument("--input", required=True)
    i.add_argument("-d", "--database", required=True)
    i.add_argument("--source", required=True)
    i.add_argument("--duplicates", choices=["error", "keep"], default="error")
    v = sub.add_parser("validate")
    v.add_argument("-d", "--database", required=True)
    v.add_argument("--report", action="store_true")
    b = sub.add_parser("benchmark")
    for name in ("input", "training", "output", "source"):
        b.add_argument(f"--{name}", required=True)
    b.add_argument("--methods", nargs="+", default=list(rankers.BENCH_METHODS), choices=rankers.BENCH_METHODS)
    b.add_argument("--budget", nargs="+", type=int, default=[25, 50, 100])
    b.add_argument("--seeds", nargs="+", type=int, default=[0, 1, 2])
    a = sub.add_parser("audit")
    a.add_argument("--snapshot", required=True, help="JSON lines of records")
    a.add_argument("--table", help="the same records as a TSV, which must agree row by row")
    a.add_argument("--metadata", help="a TOML file whose fields, count and hash the records must meet")
    a.add_argument("--output", required=True)
    s = sub.add_parser("split")
    e = sub.add_parser("experiment")
    for p in (s, e):
        p.add_argument("--groups", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--seeds", nargs="+", type=int, default=list(splits.SEEDS))
        p.add_argument("--budget", nargs="+", type=int, default=list(splits.BUDGETS))
    y = sub.add_parser("study")
    y.add_argument("name", choices=experiments.STUDIES)
    for flag in ("groups", "output"):
        y.add_argument(f"--{flag}", required=True)
    y.add_argument("--seeds", nargs="+", type=int, default=list(splits.SEEDS))
    y.add_argument("--budget", nargs="+", type=int, default=list(splits.BUDGETS))
    r = sub.add_parser("replay")
    r.add_argument("--groups", required=True)
    r.add_argument("--run", required=True, help="what the experiment command wrote")
    sub.add_parser("recheck").add_argument("--run", required=True)
    n = sub.add_parser("snapshot")
    n.add_argument("--documents", required=True, help="JSON lines of records")
    n.add_argument("--output", required=True)
    n.add_argument("--database-version", required=True)
    e.add_argument("--bundle", help="a bundle of the split command; the splits derived here must be its own")
    e.add_argument("--designs", nargs="+", default=["composition"], choices=splits.DESIGNS)
    e.add_argument("--policies", nargs="+", default=["original"], choices=splits.POLICIES)
    e.add_argument("--methods", nargs="+", default=list(rankers.PU_METHODS), choices=experiments.METHODS)
    return out


def run(args: argparse.Namespace, to=None) -> int:
    to = to or sys.stdout
    spark = session()
    say = lambda x: print(x, file=to)
    if args.command == "query":
        if (args.rank == "similarity") != bool(args.reference):
            raise ValueError("--reference goes with --rank similarity")
        method = query.SimilarityRanking(args.reference) if args.reference else query.ScoreRanking()
        filters = query.QueryFilters.of(args.elements, args.nary, args.threshold, not args.strict_threshold)
        table = load(spark, args.database, filters)
        found = query.query_compositions(table, args.elements, args.nary, args.threshold, not args.strict_threshold, method, "elements" in table.columns)
        for note in notes(args.database, args.nary) if args.database.endswith((".sqlite", ".db")) else []:
            print(f"note: {note}", file=sys.stderr)
        say("# Composition, Score" + (", Similarity" if args.reference else ""))
        for r in found.orderBy("rank").toLocalIterator():
            say("%s   %.5f" % (r["formula"], r["score"]) + ("   %.5f" % r["ranking_value"] if args.reference else ""))
    elif args.command == "import":
        write = sqlite_sink.import_sqlite if args.database.endswith((".sqlite", ".db")) else sinks.import_scores
        if args.input.endswith(".tsv"):
            say(sinks.import_tsv(spark, args.input, args.database, args.source, args.duplicates, write))
        else:
            say(write(load(spark, args.input), args.database, args.source, args.duplicates))
    elif args.command == "validate":
        if args.database.endswith((".sqlite", ".db")):
            scores.quick_check(args.database)
        table = load(spark, args.database)
        rows = validate.legacy_validated(table) if "elements" in table.columns else query.validated(table)
        report = validate.audit(rows, strict=not args.report)
        say(report)
        return 2 if report["invalid_rows"] else 0
    elif args.command == "benchmark":
        say(benchmark.run(spark, args.input, args.training, args.output, args.source, args.methods, args.seeds, args.budget))
    elif args.command == "audit":
        say(audits.run(spark, args.snapshot, args.output, args.metadata, args.table))
    elif args.command == "recheck":
        say(f"{recheck.recheck(spark, args.run)} checks passed")
    elif args.command == "snapshot":
        say(sinks.write_snapshot(spark, args.documents, args.output, args.database_version))
    else:
        groups = audit.mixed(tsv.read_groups(spark, args.groups))
        if args.command == "study":
            made = experiments.study(groups, args.name, args.seeds, args.budget)
            experiments.write_experiment(made, args.output, {"study": args.name, "seeds": args.seeds, "budgets": args.budget})
        elif args.command == "replay":
            baseline.require_same_experiment(groups, args.run)
            say("every file is the same")
        elif args.command == "split":
            split = splits.composition_splits(groups, args.seeds, ("original",))
            splits.check_splits(split, args.budget)
            sinks.write_bundle(split, args.output, {"seeds": args.seeds, "budgets": args.budget})
        else:
            if args.bundle:
                verify.load_bundle(spark, args.bundle, splits.composition_splits(groups, args.seeds, ("original",)))
            made = experiments.experiment(groups, args.designs, args.policies, args.seeds, args.budget, args.methods)
            experiments.write_experiment(made, args.output, {"designs": args.designs, "policies": args.policies, "methods": args.methods, "seeds": args.seeds, "budgets": args.budget})
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except (ValueError, OSError, PySparkException) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
