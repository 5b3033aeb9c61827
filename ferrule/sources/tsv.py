"""Strict tab-separated tables: exact header, fixed width, no quoting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula import with_composition
from ..operators.query import InvalidRecords
from .lines import numbered_lines

#: Plain decimal numbers only: no padding, suffixes, NaN or infinity.
NUMBER = r"\A[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


def read_tsv(spark: SparkSession, path: str, header: list[str] | None, filled: bool = True, prefix: bool = False) -> DataFrame:
    """Text columns named by the header, and ``source_row`` from 1. Without a header given, the file's own names the columns, each once.

    Every line must have as many cells as the header (at least, with prefix: then only the first columns are
    checked and kept), and with ``filled`` no cell may be empty. CRLF ends are dropped. Any fault raises.
    """
    cells = numbered_lines(spark, path).select(F.col("line").alias("source_row"), F.split("text", "\t", -1).alias("cells"))
    first = cells.where("source_row = 0").first()
    named = list(first["cells"])[: len(header)] if first and prefix and header else list(first["cells"]) if first else []
    if header is None:
        header = named
        if not named or "" in named or len({n.lower() for n in (*named, "source_row")}) <= len(named):
            raise InvalidRecords(f"{named} does not name each column once")
    if named != header:
        raise InvalidRecords(f"header is not {header}")
    body = cells.where("source_row > 0")
    wide = F.size("cells") >= len(header) if prefix else F.size("cells") == len(header)
    bad = ~wide
    if filled:
        bad = bad | F.exists(F.slice("cells", 1, len(header)), lambda c: c == "")
    worst = body.where(bad).agg(F.min("source_row")).first()[0]
    if worst is not None:
        raise InvalidRecords(f"row {worst} does not have {len(header)} {'non-empty ' if filled else ''}cells")
    return body.select("source_row", *[F.element_at("cells", i + 1).alias(h) for i, h in enumerate(header)])


def number(column):
    """A double from strict text; null where the text is no plain number."""
    return F.when(column.rlike(NUMBER), column.try_cast("double"))


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """(source_row, composition, score) of a scored table; a score that is no number is null, for the validator to report."""
    rows = read_tsv(spark, path, ["composition", "score"])
    return rows.withColumn("score", number(F.col("score")))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    rows = read_tsv(spark, path, ["composition", "score", "outcome"]).withColumn("score", number(F.col("score")))
    faulty = rows.where(F.col("score").isNull() | ~F.col("outcome").isin("0", "1")).agg(F.min("source_row")).first()[0]
    if faulty is not None:
        raise InvalidRecords(f"row {faulty}: score must be a number and outcome 0 or 1")
    return rows.withColumn("outcome", F.col("outcome").cast("int"))


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """A saved ranking: a blank score is null."""
    rows = read_tsv(spark, path, ["rank", "composition", "score", "random_key", "tie_key", "observed_label"], filled=False)
    return rows.withColumns({"rank": F.col("rank").cast("long"), "score": number(F.nullif("score", F.lit(""))), "random_key": F.nullif("random_key", F.lit(""))}).drop("source_row")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Audited groups; the last cell may be empty, two groups of one canonical formula raise."""
    header = ["composition", "chemical_system", "label", "record_count", "experimental_records", "theoretical_records", "unknown_records", "material_ids", "source_ids"]
    rows = read_tsv(spark, path, header, filled=False)
    empty = rows.where(" OR ".join(f"{h} = ''" for h in header[:-1])).first()
    named = with_composition(rows.select("composition")).select(F.coalesce("formula", "composition").alias("composition"))
    twice = named.groupBy("composition").count().where("count > 1").first()
    if empty or twice:
        raise InvalidRecords("empty cell" if empty else f"duplicate group {twice['composition']}")
    counts = {h: F.col(h).cast("long") for h in header if h.endswith("_records") or h == "record_count"}
    return rows.withColumns(counts | {h: F.split(F.nullif(h, F.lit("")), ";") for h in ("material_ids", "source_ids")}).drop("source_row")
