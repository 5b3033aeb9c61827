"""Provenance-flagged records to exclusion reasons, groups and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formula import with_composition

SCOPE_ELEMENT, SCOPE_NARY = "O", 3
ID = r"\Amp-(?:[0-9]+|[a-z]+)\z"


def in_scope(nary="nary", species="species"):
    return (F.col(nary) == SCOPE_NARY) & F.array_contains(species, SCOPE_ELEMENT)


def tri_state(flag):
    """A nullable boolean as true, false or unknown."""
    return F.coalesce(flag.cast("string"), F.lit("unknown"))


def with_reason(records: DataFrame) -> DataFrame:
    """Adds the formula columns and ``reason``: normalization_issue, unsupported_formula, outside_oxygen_ternary_scope, or null."""
    rows = with_composition(records)
    reason = (
        F.when(F.col("normalization_issue") != ".", "normalization_issue")
        .when(F.col("formula_error").isNotNull(), "unsupported_formula")
        .when(~in_scope(), "outside_oxygen_ternary_scope")
    )
    return rows.withColumn("reason", reason)


def excluded(rows: DataFrame) -> DataFrame:
    return rows.where("reason IS NOT NULL").select("material_id", "composition", "reason", "normalization_issue")


def exclusion_counts(rows: DataFrame) -> DataFrame:
    return rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def label(experimental, unknown):
    return F.when(experimental > 0, "positive").when(unknown > 0, "unresolved").otherwise("unlabelled")


def groups(rows: DataFrame) -> DataFrame:
    """The nine columns of an audited group, one row a canonical composition; lists are arrays until a sink joins them."""
    kept = rows.where("reason IS NULL").groupBy(F.col("formula").alias("composition"), F.col("system").alias("chemical_system")).agg(
        F.count("*").alias("record_count"),
        F.count_if(F.col("theoretical") == "false").alias("experimental_records"),
        F.count_if(F.col("theoretical") == "true").alias("theoretical_records"),
        F.count_if(F.col("theoretical") == "unknown").alias("unknown_records"),
        F.array_sort(F.collect_list("material_id")).alias("material_ids"),
        F.array_sort(F.collect_set(F.when(F.col("source_ids") != ".", F.col("source_ids")))).alias("source_ids"),
    )
    labelled = kept.withColumn("label", label(F.col("experimental_records"), F.col("unknown_records")))
    return labelled.select("composition", "chemical_system", "label", "record_count", "experimental_records", "theoretical_records", "unknown_records", "material_ids", "source_ids")


def as_text(grouped: DataFrame) -> DataFrame:
    return grouped.withColumns({c: F.array_join(c, ";") for c in ("material_ids", "source_ids")})


def mixed(grouped: DataFrame) -> DataFrame:
    """(composition, system, label, mixed) as the splits take them."""
    both = (F.col("experimental_records") > 0) & (F.col("theoretical_records") > 0)
    return grouped.select("composition", F.col("chemical_system").alias("system"), "label", both.alias("mixed"))


def summary(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row of counts over records and groups."""
    records = rows.agg(
        F.count("*").alias("total_records"),
        F.count_if(F.col("reason").isNull()).alias("included_records"),
        F.count_if(F.col("reason").isNotNull()).alias("excluded_records"),
        F.count_if(F.col("theoretical") == "unknown").alias("records_missing_flag"),
        F.count_if(F.col("source_ids") == ".").alias("records_missing_source_ids"),
    )
    of = lambda x: F.count_if(F.col("label") == x)
    counts = grouped.agg(
        F.count("*").alias("unique_compositions"),
        of("positive").alias("positive_compositions"),
        of("unlabelled").alias("unlabelled_compositions"),
        of("unresolved").alias("unresolved_compositions"),
        F.count_if((F.col("experimental_records") > 0) & (F.col("theoretical_records") > 0)).alias("mixed_flag_compositions"),
    )
    both = records.join(F.broadcast(counts), F.lit(True))  # one row each
    holdout = F.call_function("div", F.col("positive_compositions"), F.lit(5).cast("long"))
    return both.withColumns(
        {
            "collapsed_extra_records": F.col("included_records") - F.col("unique_compositions"),
            "positive_holdout_20_percent_floor": holdout,
            "eligible_pu_compositions": F.col("positive_compositions") + F.col("unlabelled_compositions"),
            "has_minimum_pilot_data": (holdout >= 1) & (F.col("unlabelled_compositions") >= 1),
        }
    )
