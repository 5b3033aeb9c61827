"""Operator 1: SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is eight bytes. Two fingerprints that differ in at most d bits share at least 8 - d of their
positional bytes. The list of one positional byte holds a 256th of all fingerprints, and pairs over it would
grow in the square of the corpus, so the index posts every choice of GRAM positional bytes: a pair that shares
s bytes meets in as many lists as GRAM bytes can be chosen from s. Meetings are tallied by pair, pairs that
reach the guaranteed minimum (that of 8 - d shared bytes) stay, and their differing bits are then counted.

Fingerprints of lists longer than ``long_list`` are crowded. Two of one such list are found through lists of
variants: each is posted under itself and its one-bit changes (up to d / 2 of them), and a variant has at most
65 fingerprints that close. A pair without a common long list has its whole tally in short lists, so none is lost.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, join_unique, table
from .components import components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
#: Bytes of a posted gram: short enough for a tally, long enough that chance fills no list.
GRAM = 5
LONG_LIST = 64
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles; zero for a text without words or null."""
    parts = text.encode().lower().split() if text else []
    n = len(parts)
    if not n:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if n < words:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    chunks = (np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], "<u8") for at in range(0, len(starts), CHUNK))
    return majority(chunks, len(starts))


def majority(chunks: Iterable[np.ndarray], n: int) -> int:
    """The 64 bits that more than half of n hashes have."""
    counts = np.zeros(64, np.int64)
    for hashes in chunks:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row for each input row."""

    def run(batches):
        for batch in batches:
            fps = [_signed(fingerprint(t)) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _byte(position: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255).cast("long"))


def postings(fps: DataFrame, gram: int = GRAM) -> DataFrame:
    """(key, fp): the choice of byte positions and the bytes there, in one long."""
    keys = []
    for n, positions in enumerate(combinations(range(8), gram)):
        key = F.lit(n).cast("long")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(F.col(f"b{p}"))
        keys.append(key)
    return fps.select("fp", *[_byte(p).alias(f"b{p}") for p in range(8)]).select("fp", F.explode(F.array(*keys)).alias("key"))


def links(fps: DataFrame, work: Workspace, max_bits: int = MAX_BITS, long_list: int = LONG_LIST, gram: int = GRAM) -> DataFrame:
    """(a, b), a < b: every pair of distinct fingerprints that differ in at most max_bits bits."""
    if not 0 <= max_bits <= 8 - gram or max_bits > 2:
        raise ValueError("at most two bits, and no more than the bytes that a gram leaves out")
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number is not made smaller, as postings are many times the fingerprints
    posted = postings(fps.select("fp").repartition(tasks, "fp").distinct(), gram)
    sizes = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    index = work.keep(posted.join(sizes.hint("merge"), "key"), "index")  # no table here is broadcast: the driver would hold it
    work.release()

    short = index.where(F.col("n") <= long_list)
    met = short.select("key", F.col("fp").alias("a")).join(short.select("key", F.col("fp").alias("b")).hint("merge"), "key").where("a < b")
    tallied = met.groupBy("a", "b").agg(F.count("*").alias("tally")).where(F.col("tally") >= comb(8 - max_bits, gram))

    crowded = index.where(F.col("n") > long_list).select("fp").distinct()
    changes = F.array(*[F.lit(_signed(1 << i)) for i in range(64)], F.lit(0).cast("long"))
    variants = crowded.repartition(tasks, "fp").select("fp", F.explode(changes).alias("change")).select("fp", F.col("fp").bitwiseXOR(F.col("change")).alias("variant"))
    close = variants.select("variant", F.col("fp").alias("a")).join(variants.select("variant", F.col("fp").alias("b")).hint("merge"), "variant").where("a < b")

    pairs = tallied.select("a", "b").unionByName(close.select("a", "b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, long_list: int = LONG_LIST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable over links).

    Null or word-free texts have fingerprint zero and are linked like any other. Repeated rows and ids
    come back once for each input row; a null id never wins component_id, which is null only if every id of
    the component is. Texts of any length are taken whole, CHUNK shingles at a time. Other columns of ``docs`` are ignored,
    whatever their names. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "simhash")
    fps = work.keep(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = work.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = work.keep(components(links(distinct, work, max_bits, long_list), work), "roots")
    work.release()
    rooted = distinct.join(roots.select(F.col("node").alias("fp"), "root").hint("merge"), "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    least = work.keep(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m")), "least")
    named = work.keep(join_unique(rooted, least, "root", "m", "fp").select("fp", "n", "component_id"), "named")
    return join_unique(fps, named, "fp", "n", "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
