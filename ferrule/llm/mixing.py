"""Operator 6: mix sources to target weights by Poisson replication.

A source's target rate is its weight's share of all characters over its own share. Each document's count
inverts a Poisson distribution of that mean at a uniform number hashed from seed and doc_id, documents are
exploded by their counts, and the copies are dealt out by a hash of seed, doc_id and copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, fresh, table

SEED = "mix-1"
#: Without explicit weights a source weighs its characters to this power (1: as it is, 0: all alike).
POWER = 0.5
#: Rates above this are drawn as a sum of several draws, as exp(-rate) would vanish.
LARGEST_MEAN = 16.0
#: Terms of the distribution; beyond, a mean of LARGEST_MEAN leaves less than 2^-52.
TERMS = 80


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, work: Workspace, weights: dict[str, float] | None = None, power: float = POWER) -> DataFrame:
    """(source, rate, draws, cdf): the target repetition rate and the distribution of one of its draws.

    With explicit weights a source without one has rate 0. Sources without characters have rate 1.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("chars"))
    sizes = work.keep(sizes, "sizes")
    if weights is None:
        weight = F.pow("chars", F.lit(power))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(given, F.coalesce("source", F.lit(""))), F.lit(0.0))
    totals = sizes.select(F.col("chars"), weight.alias("w")).agg(F.sum("chars"), F.sum("w")).first()
    chars, total = totals[0] or 0.0, totals[1] or 0.0
    rate = F.when(F.col("chars") == 0, 1.0).otherwise(weight / F.lit(total or 1.0) * F.lit(chars) / F.col("chars"))
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int")
    mean = F.col("rate") / F.col("draws")
    terms = F.sequence(F.lit(1), F.lit(TERMS))
    first = F.exp(-mean)
    cdf = F.aggregate(
        terms,
        F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / k)).alias("c")),
        lambda s: s["c"],
    )
    return sizes.withColumn("rate", rate).withColumn("draws", draws).select("source", "rate", "draws", cdf.alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, seed: str = SEED) -> DataFrame:
    """The columns of ``docs`` and two more, ``copy`` (1 on) and ``shuffle_key``; rows are dealt and ordered by that key within partitions.

    A document's count depends on seed, doc_id and its source's rate alone: repeated rows get equal counts.
    A null source is a source of its own, a null doc_id hashes as ``null``, a null text has no characters.
    Where ``docs`` has a column of such a name, it stays and the new one gets underscores. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "mixing")
    copy, shuffle_key = fresh(docs, "copy"), fresh(docs, "shuffle_key")
    s, draws, cdf, n = (fresh(docs, x) for x in ("__s", "__draws", "__cdf", "__n"))
    rates = work.keep(source_rates(docs, work, weights, power), "rates").select(F.col("source").alias(s), F.col("draws").alias(draws), F.col("cdf").alias(cdf))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    count = F.aggregate(
        F.sequence(F.lit(1), F.col(draws)),
        F.lit(0),
        lambda total, j: total + F.size(F.filter(cdf, lambda c: c <= _uniform(F.lit(seed), F.lit("n"), name, j.cast("string")))),
    )
    copies = (
        docs.join(rates, docs["source"].eqNullSafe(rates[s]))
        .withColumn(n, count)
        .where(F.col(n) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n).cast("long"))))
        .drop(s, draws, cdf, n)
    )
    keyed = copies.withColumn(shuffle_key, F.md5(F.concat_ws(":", F.lit(seed), F.lit("s"), name, F.col(copy).cast("string"))))
    return keyed.repartition(F.col(shuffle_key)).sortWithinPartitions(shuffle_key)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP6_ORACLE = f"""
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS chars FROM documents GROUP BY source),
totals AS (SELECT sum(chars) AS c, sum(pow(chars, {POWER})) AS w FROM sizes),
rates AS (SELECT source, CASE WHEN chars = 0 THEN 1.0 ELSE pow(chars, {POWER}) / w * c / chars END AS rate FROM sizes, totals),
split AS (SELECT source, rate, greatest(1, ceil(rate / {LARGEST_MEAN}))::INTEGER AS draws FROM rates),
cdfs AS (
  SELECT source, draws, list_transform(range({TERMS} + 1), lambda k: list_sum(list_transform(range(k + 1), lambda i: exp(-rate / draws + i * ln(rate / draws) - lgamma(i + 1))))) AS cdf
  FROM split),
counts AS (
  SELECT d.*, coalesce(d.doc_id::VARCHAR, 'null') AS name,
    list_sum(list_transform(range(1, draws + 1), lambda j: len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('{SEED}:n:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || j), 1, 13))::BIGINT / 4503599627370496.0))))::BIGINT AS n
  FROM documents d JOIN cdfs ON d.source IS NOT DISTINCT FROM cdfs.source),
copies AS (SELECT * EXCLUDE (n), unnest(range(1, n + 1)) AS copy FROM counts)
SELECT doc_id, text, lang, source, n_chars, copy, md5('{SEED}:s:' || name || ':' || copy) AS shuffle_key FROM copies
"""
