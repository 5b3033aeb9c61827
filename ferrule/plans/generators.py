"""Synthetic populations of any size, for tests and demonstrations; no registered query reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairmodel import AXIS

COUNTS = ((1, 1), (1, 2), (2, 1))


def similarity_pool(spark: SparkSession, n: int) -> DataFrame:
    """(composition) of up to n ternaries with oxygen: pairs of the other symbols by three count pairs."""
    wide = len(AXIS)
    symbols = F.array(*[F.lit(s) for s in AXIS])
    counts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in COUNTS])
    i = F.call_function("div", F.col("id"), F.lit(len(COUNTS)).cast("long"))
    rows = spark.range(n).withColumn("i", (i % wide).cast("int")).withColumn("j", F.call_function("div", i, F.lit(wide).cast("long")).cast("int")).where("i < j AND j < " + str(wide))
    pick = F.element_at(counts, (F.col("id") % len(COUNTS) + 1).cast("int"))
    return rows.select(F.concat(F.element_at(symbols, F.col("i") + 1), pick["a"].cast("string"), F.element_at(symbols, F.col("j") + 1), pick["b"].cast("string"), F.lit("O3")).alias("composition"))


def snapshot(spark: SparkSession, n: int, systems: int = 10) -> DataFrame:
    """Records of unequal systems, one of which dominates, with mixed, unlabelled and unknown flags."""
    at = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % systems).cast("int")
    first = F.element_at(F.array(*[F.lit(s) for s in AXIS[:systems]]), at + 1)
    text = F.concat(first, (1 + F.col("id") % 5).cast("string"), F.lit("Zr"), (1 + F.col("id") % 4).cast("string"), F.lit("O"), (1 + F.col("id") % 7).cast("string"))
    flag = F.when(F.col("id") % 5 == 0, "false").when(F.col("id") % 11 == 0, "unknown").otherwise("true")
    return spark.range(n).select(F.concat(F.lit("mp-"), F.col("id").cast("string")).alias("material_id"), text.alias("composition"), flag.alias("theoretical"), F.lit(".").alias("source_ids"), F.lit(".").alias("normalization_issue"))
