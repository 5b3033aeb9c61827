"""Operator 8: quality rules whose failures are judged by host.

Each document is measured once. Failures of any rule are counted by host (here: source), each host's
rate is shrunk towards the corpus by a beta prior fitted to all hosts by moments, and a host whose shrunk
rate passes the limit loses all its documents. A document that fails a base rule goes in any case.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, bounded_batches, fresh, table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Rules that count against the host only.
MAX_SYMBOLS_PER_WORD = 0.5
MAX_DUP_LINE_SHARE = 0.5
#: A host goes if more than this share of its documents fails, after shrinkage.
HOST_LIMIT = 0.6

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(parts: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more."""
    n = len(parts)
    if n <= window:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - window + 1].tolist()
    ends = ends[window - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    codes = np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(codes), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    found = np.flatnonzero(hit).tolist()
    exact = Counter(joined[starts[i] : ends[i]] for i in found)
    edges = np.zeros(n + 1, np.int64)
    for i in found:
        if exact[joined[starts[i] : ends[i]]] > 1:
            edges[i] += 1
            edges[i + window] -= 1
    return int((np.cumsum(edges)[:n] > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the lines that have a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode()
    parts = raw.split()
    chars = len(text) - (len(raw) - sum(map(len, parts)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(parts), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(parts), len(lines)


def measured(docs: DataFrame, columns: list[str], name: str = "__m") -> DataFrame:
    """The given columns and one struct of that name with the measures, base_failed and any_failed."""
    kinds = [(m, pa.int64()) for m in MEASURES] + [("base_failed", pa.bool_()), ("any_failed", pa.bool_())]
    struct = pa.struct(kinds)

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                n, chars, symbols, dup, repeat, lines = measure(text)
                base = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
                other = symbols > MAX_SYMBOLS_PER_WORD * n or dup > MAX_DUP_LINE_SHARE * lines
                rows.append((n, chars, symbols, dup, repeat, base, base or other))
            out = pa.array([dict(zip([k for k, _ in kinds], r, strict=True)) for r in rows], struct)
            yield pa.record_batch([*batch.columns[1:], out], [*batch.schema.names[1:], name])

    bounded_batches(docs.sparkSession)
    mine = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES] + [T.StructField(m, T.BooleanType()) for m in ("base_failed", "any_failed")])
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField(name, mine)])
    return docs.select(F.col("text").cast("string").alias(fresh(docs, "__text")), *columns).mapInArrow(run, schema)


def host_verdicts(rows: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n_docs, n_failed, host_rate, host_ok) from rows(host, __m); a null host is never judged."""
    counts = rows.groupBy(host).agg(F.count("*").alias("n_docs"), F.count_if(F.col("__m.any_failed")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = counts.agg(
        F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("hosts"), F.sum(rate).alias("r"), F.sum(rate * rate).alias("rr"), F.sum(1 / F.col("n_docs")).alias("inv")
    ).first()
    mean, strength = prior(moments["n"] or 0, moments["f"] or 0, moments["hosts"], moments["r"] or 0.0, moments["rr"] or 0.0, moments["inv"] or 0.0)
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return counts.withColumn("host_rate", shrunk).withColumn("host_ok", F.col(host).isNull() | (shrunk <= limit))


def prior(n: int, failed: int, hosts: int, rates: float, squares: float, inverse: float) -> tuple[float, float]:
    """Mean and strength of the beta prior: the spread of host rates less the spread that sampling alone makes."""
    mean = failed / n if n else 0.0
    if hosts < 2 or not 0 < mean < 1:
        return mean, 1.0
    spread = (squares - rates * rates / hosts) / (hosts - 1) - mean * (1 - mean) * inverse / hosts
    return mean, min(1e6, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6


def quality_rules(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row for each document: doc_id, the measures, base_failed, kept, and the host's shrunk failure rate.

    Null and empty texts have no words and fail. Rows of a null host are judged by the base rules alone.
    Repeated rows are judged one by one, and a null doc_id stays null. Texts of any length are measured whole, one at a
    time. Further columns of ``docs`` are ignored. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "quality")
    rows = work.keep(measured(docs.select(F.col("text"), F.col("doc_id"), F.col(host).alias("__host")), ["doc_id", "__host"]), "measures")
    hosts = host_verdicts(rows, "__host", limit).select("__host", "host_rate", "host_ok").withColumnRenamed("__host", "__h")
    joined = rows.join(hosts, F.col("__host").eqNullSafe(F.col("__h")), "left")
    return joined.select("doc_id", *[F.col(f"__m.{m}").alias(m) for m in MEASURES], F.col("__m.base_failed").alias("base_failed"), (~F.col("__m.base_failed") & F.col("host_ok")).alias("kept"), "host_rate")


def keep_good(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that quality_rules keeps, with their columns; texts are read once and never shuffled with a small host table."""
    work = Workspace(docs.sparkSession, "quality")
    m, h = fresh(docs, "__m"), fresh(docs, "__h")
    rows = work.keep(measured(docs, docs.columns, m), "measured")
    hosts = host_verdicts(rows.select(F.col(host).alias("__host"), F.col(m).alias("__m")), "__host", limit).where("host_ok").select(F.col("__host").alias(h))
    hosts = work.keep(hosts, "hosts")
    return rows.where(~F.col(f"{m}.base_failed")).join(hosts, F.col(host).eqNullSafe(F.col(h)), "left_semi").select(docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 9))
