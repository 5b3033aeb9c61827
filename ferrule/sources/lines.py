"""Numbered lines of a text file, read in as many tasks as it has blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line from 0, text without its end) of one file. Blocks are counted first; only a row a block is summed up in one place."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r\\z", "").alias("text"))
    blocks = rows.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumn("before", before).select("block", "first", "before")
    return rows.join(F.broadcast(placed), "block").select((F.col("at") - F.col("first") + F.col("before")).alias("line"), "text")
