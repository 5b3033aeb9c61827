"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.workspace import Workspace  # noqa: F401

#: Rows and bytes of an Arrow batch sent to Python; texts may be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20

#: A key is hot with more than one row in HOT_SHARE and more than HOT_LEAST; its rows go to HOT_SALTS tasks.
HOT_SHARE, HOT_LEAST, HOT_SALTS = 1000, 256, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough that a batch of long texts fits a Python worker.

    The limits hold for the session, as Spark reads them when a plan runs; smaller ones that are set stay.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def join_unique(rows: DataFrame, unique: DataFrame, on: str, n: str, spread: str, how: str = "inner") -> DataFrame:
    """Join with a table of one row a key, whose column n counts the key's rows in ``rows``; n is dropped.

    Keys with more than a thousandth of all rows, so a thousand at most, are broadcast by name, and their rows are
    dealt over HOT_SALTS tasks by a hash of the column ``spread``. Null keys match nothing.
    """
    total = unique.agg(F.sum(n)).first()[0] or 0
    hot = unique.where((F.col(n) * HOT_SHARE > total) & (F.col(n) > HOT_LEAST)).select(F.col(on).alias("__key"), F.lit(True).alias("__hot"))
    marked = rows.join(F.broadcast(hot), F.col(on) == F.col("__key"), "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(HOT_SALTS).cast("long"))).otherwise(0)).drop("__key", "__hot")
    salts = F.when((F.col(n) * HOT_SHARE > total) & (F.col(n) > HOT_LEAST), F.sequence(F.lit(0).cast("long"), F.lit(HOT_SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return marked.join(unique.withColumn("__salt", F.explode(salts)).drop(n).hint("merge"), [on, "__salt"], how).drop("__salt")


def add_columns(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join on a key that may be null, without clashing column names."""
    right = other.withColumnRenamed(key, "__key")
    return base.join(right, base[key].eqNullSafe(right["__key"]), "left").drop("__key")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
