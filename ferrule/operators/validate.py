"""Validation audit and import of score tables: nothing bad is dropped silently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import with_composition
from .query import InvalidRecords, require_valid, validated

CATEGORIES = ("unsupported_symbol", "unsupported_syntax", "inconsistent_columns", "invalid_score", "invalid_stoichiometry", "invalid_record")


def legacy_validated(df: DataFrame) -> DataFrame:
    """validated() for rows that repeat their formula as nary, elements and amounts: those must agree."""
    rows = validated(df.withColumnRenamed("nary", "table_nary"))
    entries = F.zip_with("elements", "amounts", lambda s, n: F.struct(s.alias("symbol"), n.alias("amount")))
    rows = rows.withColumn("__same", F.array_join(F.transform(F.array_sort(entries), lambda t: F.concat(t["symbol"], t["amount"].cast("string"))), ""))
    parsed = with_composition(rows.select("*").withColumnsRenamed({c: f"__{c}" for c in ("formula_error", "terms", "formula", "species", "nary", "system")}), "__same")
    unknown = F.exists("elements", lambda s: s.isNull()) | (F.col("formula_error") == "unsupported_symbol")
    bad = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(unknown, "unsupported_symbol")
        .when(F.exists("amounts", lambda n: n.isNull() | (n <= 0)), "invalid_stoichiometry")
        .when((F.col("table_nary") != F.col("__nary")) | ~F.col("formula").eqNullSafe(F.col("__formula")), "inconsistent_columns")
    )
    names = ("formula_error", "terms", "formula", "species", "nary", "system")
    return parsed.withColumn("error", bad).drop("__same", *names).withColumnsRenamed({f"__{c}": c for c in names})


def category_counts(rows: DataFrame) -> DataFrame:
    return rows.where("error IS NOT NULL").groupBy(F.col("error").alias("category")).agg(F.count("*").alias("n"))


def table_counts(rows: DataFrame, table: str) -> DataFrame:
    return rows.groupBy(table).agg(F.count("*").alias("n_rows"), F.count_if(F.col("error").isNotNull()).alias("invalid_rows"))


def first_examples(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """The first bad row of each category, by the given order; one aggregated row a category crosses the shuffle."""
    first = F.min(F.struct(*order, *columns)).alias("__first")
    return rows.where("error IS NOT NULL").groupBy(F.col("error").alias("category")).agg(first).select("category", "__first.*")


def issues(rows: DataFrame, order: list[str], columns: list[str], most: int = 20) -> DataFrame:
    """The first ``most`` bad rows; a report's length, taken as a distributed top-k."""
    if most < 0:
        raise ValueError("most must be nonnegative")
    return rows.where("error IS NOT NULL").orderBy(*order).limit(most).select(*order, *columns, F.col("error").alias("category"))


def audit(rows: DataFrame, table: str | None = None, strict: bool = True, order: Sequence[str] = ("composition", "score"), most: int = 20) -> dict:
    """Counts of all rows, of bad rows by category and table, the first bad row of each category and the first ``most`` bad rows.

    strict raises on the first bad category.
    """
    if strict:
        require_valid(rows)
    counted = rows.groupBy(*([table] if table else []), "error").count().collect()
    total = sum(r["count"] for r in counted)
    bad = [r for r in counted if r["error"]]
    out = {"rows": total, "invalid_rows": sum(r["count"] for r in bad), "categories": {}, "tables": {}, "invalid_by_table": {}}
    out["valid_rows"] = total - out["invalid_rows"]
    for r in bad:
        out["categories"][r["error"]] = out["categories"].get(r["error"], 0) + r["count"]
    for r in counted if table else []:
        out["tables"][r[table]] = out["tables"].get(r[table], 0) + r["count"]
        out["invalid_by_table"][r[table]] = out["invalid_by_table"].get(r[table], 0) + (r["count"] if r["error"] else 0)
    out["examples"] = {r["category"]: r.asDict() for r in first_examples(rows, list(order), []).collect()} if bad else {}
    out["issues"] = [r.asDict() for r in issues(rows, list(order), [], most).collect()] if bad else []
    return out


def duplicates(rows: DataFrame, row: Column) -> DataFrame:
    """Canonical formulas met twice or more: formula, n, first_row and second_row (the second occurrence is the offence).

    The two smallest rows come from a group limit, which every task applies before the shuffle.
    """
    placed = rows.select("formula", row.alias("__row")).withColumn("__at", F.row_number().over(Window.partitionBy("formula").orderBy("__row")))
    ends = placed.where("__at <= 2").groupBy("formula").agg(F.min("__row").alias("first_row"), F.max("__row").alias("second_row"))
    return rows.groupBy("formula").agg(F.count("*").alias("n")).where("n > 1").join(ends, "formula")


def imported(rows: DataFrame, row: str, policy: str = "error") -> DataFrame:
    """(composition, score, source_formula, source_row) of valid rows; bad rows, or duplicates under policy error, raise."""
    if policy not in ("error", "keep"):
        raise ValueError("duplicate policy is error or keep")
    require_valid(rows)
    if policy == "error":
        offence = duplicates(rows, F.col(row)).orderBy("second_row", "formula").first()
        if offence:
            raise InvalidRecords(f"source row {offence['second_row']} repeats {offence['formula']} of row {offence['first_row']}")
    return rows.select(F.col("formula").alias("composition"), "score", F.col("composition").alias("source_formula"), F.col(row).alias("source_row"))
