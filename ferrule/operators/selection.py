"""Exact order statistics of many groups without sorting or gathering one: histograms of values, refined until they single one out."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.workspace import Workspace

#: Bins of one interval. Each pass narrows an interval to one of them, or to the values that share it.
BINS = 4096
#: Far more passes than doubles can need: each narrows by 12 bits, or by the gap between neighbouring values.
MOST_PASSES = 200


def nearest_ranks(values: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], bins: int = BINS) -> DataFrame:
    """(keys, share, n, value): for each share p the value at place max(1, ceil(p n)) of a group's values in order.

    Every pass counts the values of each interval that is still open by bin, in partial aggregates: a row is read, not
    shuffled, and no more than ``bins`` counts of an open interval meet. Intervals are a small table, of a row a group
    and share. Values must be neither null nor NaN.
    """
    keys, work = list(keys), Workspace(values.sparkSession, "selection")
    rows = work.keep(values.select(*keys, F.col(value).cast("double").alias("__v")), "values")
    ends = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    each = ends.withColumn("share", F.explode(F.array(*[F.lit(float(p)) for p in shares])))
    place = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n"))).cast("long")
    state = work.keep(each.withColumn("__place", place), "intervals")  # __place counts from the interval's least value
    for _ in range(MOST_PASSES):
        open_ = state.where("__low < __high")
        if not open_.head(1):
            return state.select(*keys, "share", "n", F.col("__low").alias(value))
        renamed = F.broadcast(open_.withColumnsRenamed({k: f"__{k}" for k in keys}))
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__v") >= F.col("__low"), F.col("__v") <= F.col("__high")]
        v, low, high = F.col("__v"), F.col("__low"), F.col("__high")
        # ends of unlike sign may be further apart than a double can say; their halves are not
        part = F.when(high - low < float("inf"), (v - low) / (high - low)).otherwise((v / 2 - low / 2) / (high / 2 - low / 2))
        bin_of = F.least(F.floor(part * bins), F.lit(bins - 1).cast("long"))
        at = [*[f"__{k}" for k in keys], "share"]
        counts = rows.join(renamed, same).groupBy(*at, "n", "__place", bin_of.alias("__bin")).agg(F.count("*").alias("__count"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        before = F.coalesce(F.sum("__count").over(Window.partitionBy(*at).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        narrowed = counts.withColumn("__before", before).where("__place > __before AND __place <= __before + __count").withColumn("__place", F.col("__place") - F.col("__before"))
        narrowed = narrowed.withColumnsRenamed({f"__{k}": k for k in keys}).select(state.columns)
        state = work.keep(state.where("__low = __high").unionByName(narrowed), "intervals")
    raise RuntimeError(f"an interval of values did not settle in {MOST_PASSES} passes")


def ordered_sum(values: DataFrame, keys: Sequence[str], value: str, by: str) -> DataFrame:
    """(keys, total): the sum of doubles in order of ``by``, then of value, one after another, so that it is the same to the last bit on any cluster.

    A group's values pass one task as a sorted stream, and only the sum so far is held.
    """
    keys = list(keys)
    rows = values.select(*keys, F.col(by).alias("__by"), F.col(value).cast("double").alias("__v"), F.to_json(F.struct(*keys)).alias("__key"))
    dealt = rows.repartition("__key").sortWithinPartitions("__key", "__by", "__v").drop("__by")

    def run(batches):
        now, total, held = None, 0.0, None
        for batch in batches:
            key = batch.column("__key")
            cuts = [0, *(np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), len(batch)]
            numbers = batch.column("__v").to_numpy()
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if key[a].as_py() != now:
                    if held is not None:
                        yield pa.record_batch([*held.columns, pa.array([total])], [*keys, "total"])
                    now, total, held = key[a].as_py(), 0.0, batch.select(keys).slice(a, 1)
                total = float(np.add.accumulate(np.concatenate([[total], numbers[a:b]]))[-1])  # one after another, unlike sum
        if held is not None:
            yield pa.record_batch([*held.columns, pa.array([total])], [*keys, "total"])

    schema = ", ".join([*[f"`{k}` {values.schema[k].dataType.simpleString()}" for k in keys], "total double"])
    return dealt.mapInArrow(run, schema)
