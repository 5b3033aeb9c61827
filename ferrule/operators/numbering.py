"""Row numbers in a global order, and within keys, without a task that holds a whole table or key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.workspace import Workspace

#: Bits of monotonically_increasing_id that number rows within a partition.
ROW_BITS = 33


def _sorted(df: DataFrame, order: Sequence[Column], keys: Sequence[str], work: Workspace) -> DataFrame:
    """The rows range-partitioned by keys and order, written once, with __row_part and __row_place within it (from 0)."""
    whole = [*[F.asc(k) for k in keys], *order]
    dealt = df.repartitionByRange(*whole).sortWithinPartitions(*whole).withColumn("__id", F.monotonically_increasing_id())
    place = F.col("__id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return work.keep(dealt, "sorted").withColumn("__row_part", F.shiftright("__id", ROW_BITS)).withColumn("__row_place", place).drop("__id")


def running_sum(df: DataFrame, order: Sequence[Column], keys: Sequence[str], column: Column, name: str) -> DataFrame:
    """Adds the sum of a column down to each row in the order within its keys: within a partition, and offset by the partitions before."""
    keys, work = list(keys), Workspace(df.sparkSession, "running")
    written = _sorted(df.withColumn("__value", column), order, keys, work)
    sums = written.groupBy(*keys, "__row_part").agg(F.sum("__value").alias("__sum"))  # a row for each partition and key in it
    before = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__row_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(F.col("__row_part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"), *[F.col(k).alias(f"__{k}") for k in keys])
    same = [F.col("__row_part") == F.col("__p"), *[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]]
    inside = F.sum("__value").over(Window.partitionBy(*keys, "__row_part").orderBy("__row_place").rowsBetween(Window.unboundedPreceding, 0))
    return written.withColumn(name, inside).join(offsets, same).withColumn(name, F.col(name) + F.col("__before")).drop("__value", "__row_part", "__row_place", "__p", "__before", *[f"__{k}" for k in keys])


def numbered(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Adds each row's number, from 1, in the order within its keys.

    The rows are range-partitioned by keys and the whole order, so equal leading values spread over partitions too,
    and sorted and written once with their partition and place. A partition's offset is the rows before it, a key's
    is its first place: both are small tables, of a row a partition and a row a key.
    """
    keys, work = list(keys), Workspace(df.sparkSession, "numbering")
    written = _sorted(df, order, keys, work)
    sizes = written.groupBy("__row_part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__row_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = work.keep(sizes.select("__row_part", before.alias("__before")), "offsets")  # a row for each partition
    placed = written.join(F.broadcast(offsets), "__row_part").withColumn("__at", F.col("__row_place") + F.col("__before") + 1)
    if keys:
        firsts = work.keep(placed.groupBy(*keys).agg(F.min("__at").alias("__first")).withColumnsRenamed({k: f"__{k}" for k in keys}), "firsts")
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        placed = placed.join(firsts, same).withColumn("__at", F.col("__at") - F.col("__first") + 1).drop("__first", *[f"__{k}" for k in keys])
    return placed.withColumn(name, F.col("__at").cast("long")).drop("__row_part", "__row_place", "__before", "__at")
