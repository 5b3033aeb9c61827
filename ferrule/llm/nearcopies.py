"""Near copies by the Jaccard similarity of five-word shingles, without a miss: the pipeline's form of operator 1.

Operator 1 goes first: SimHash fingerprints of the shingle sets, its index over positional bytes, its tally by pair
with the guaranteed minimum, and its count of differing bits. What it links is then verified on the whole sets.
A SimHash of 64 bits cannot promise a similarity of 0.8 (README gives figures), so a second inverted index, of the
shingle hashes themselves, finds the near copies that fingerprints leave apart. It is used in the same way: post,
tally, keep the pairs that reach the guaranteed minimum, verify.

Two sets of similarity 0.8 or more share at least k = ceil(0.8 n) hashes, n being the size of the larger. A set
posts its least n - k + 1 + x, where x is an eighth of k, so of what two such sets post they share 1 + x of the
larger or more. A set of which fewer postings are shared at all is therefore alone, and leaves. Of the others'
postings the x most shared may be left out of both, and a common one remains: common passages hardly make lists.

What meets in a list is verified on the whole sets. First every entry meets the list's most central one. Where a
list's entries are not all in one component, they then meet further ones in rounds, FIRST_ROUND of them and GROWTH
times as many in each next round, until all of different components have met. Sizes and parities rule out most of
these pairs as they meet, without doubt: sets that differ in few hashes differ in no more parities. Larger sets have
more parities, as a few of them all look alike to a large set. Equal sets are one node.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import Workspace, bounded_batches, fresh
from .components import components

SEED = 42
WORDS = 5
FIRST_ROUND, GROWTH = 16, 8
#: Parities kept of a set: how many hashes, odd or even, have each value of the last bits. Sets of more than WIDE_FROM
#: hashes have the wide ones too; others have zeros there.
PARITIES, WIDE_PARITIES, WIDE_FROM = 256, 2048, 300
NARROW_WORDS = PARITIES // 64
WORDS_OF_PARITY = NARROW_WORDS + WIDE_PARITIES // 64
#: Nodes that a task remembers, so as to post a set once.
HELD_NODES = 1 << 20


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct word shingles, ascending; a shorter text is one shingle, one without words none."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.zeros(0, "<i8")
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    hashes = {digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=False)} or {digest(joined, SEED)}
    return np.sort(np.array(list(hashes), "<u8").view("<i8"))


def node_of(hashes: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """A set's node, of so many bits, and 64 further bits."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    raw = hashes.tobytes()
    return signed(xxhash.xxh64_intdigest(raw, SEED) >> (64 - bits)), signed(xxhash.xxh64_intdigest(raw, SEED + 1))


def posted(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes)
    least = (4 * n + 4) // 5
    return hashes[: n - least + 1 + least // 8]


def parity(hashes: np.ndarray) -> list[int]:
    def odd(n: int) -> list[int]:
        return np.packbits((np.bincount(hashes & (n - 1), minlength=n) & 1).astype(np.uint8)).view("<i8").tolist()

    return odd(PARITIES) + (odd(WIDE_PARITIES) if len(hashes) > WIDE_FROM else [0] * (WIDE_PARITIES // 64))


def fingerprint(hashes: np.ndarray) -> int:
    """Operator 1's fingerprint, of a set's hashes and as a signed long; zero for an empty set."""
    return simhash._signed(simhash.majority((hashes[at : at + simhash.CHUNK] for at in range(0, len(hashes), simhash.CHUNK)), len(hashes)))


def _nodes(docs: DataFrame, bits: int) -> DataFrame:
    """(doc_id, hash, node, check, size, fp, parity, posted) of every row; size is the number of shingles, and posted is null where the task has posted the set."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            nodes, firsts = [node_of(s, bits) for s in sets], []
            for node, s in zip(nodes, sets, strict=True):
                firsts.append(None if node in seen else posted(s))
                seen.add(node)
            if len(seen) > HELD_NODES:
                seen.clear()
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array([x[k] for x in nodes], pa.int64()) for k in (0, 1)], pa.array(map(len, sets), pa.int64()), pa.array(map(fingerprint, sets), pa.int64()), pa.array(map(parity, sets), pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64()))], ["doc_id", "hash", "node", "check", "size", "fp", "parity", "posted"])

    return docs.mapInArrow(run, "doc_id long, hash long, node long, check long, size long, fp long, parity array<long>, posted array<long>")


def _spare(size: str) -> Column:
    """Postings of a set that may be left out."""
    return F.floor((4 * F.col(size) + 4) / 5 / 8)


def _index(made: DataFrame, nodes: DataFrame, work: Workspace) -> DataFrame:
    """(token, node, size, p0 to p3, n, center): the postings that must meet, each once, with their list's length and its most central node.

    A node is the more central, the more company its postings have: of copies with single changes, their original.
    """
    entries = made.where("posted IS NOT NULL").select("node", F.explode("posted").alias("token"))
    several = entries.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("token")
    several = work.keep(several, "several")
    work.release()
    shared = work.keep(entries.join(several.hint("merge"), "token").distinct(), "shared")
    work.release()
    for _ in range(2):  # what leaves may leave others alone
        alive = shared.groupBy("node").agg(F.count("*").alias("c")).join(nodes.select("node", "size").hint("merge"), "node").where(F.col("c") > _spare("size")).select("node", "size")
        kept = shared.select("token", "node").join(alive.hint("merge"), "node")
        lists = kept.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
        shared = work.keep(kept.join(lists.hint("merge"), "token"), "shared")
    rarest = Window.partitionBy("node").orderBy("n", "token")
    ranked = shared.withColumn("at", F.row_number().over(rarest)).withColumn("c", F.count("*").over(Window.partitionBy("node")))
    company = ranked.withColumn("company", F.sum("n").over(Window.partitionBy("node")) / F.col("size"))
    kept = work.keep(company.where(F.col("at") <= F.col("c") - _spare("size")).select("token", "node", "size", "company"), "rarest")
    lists = kept.groupBy("token").agg(F.count("*").alias("n"), F.max_by("node", F.struct("company", "node")).alias("center")).where("n > 1")
    return work.keep(kept.select("token", "node").join(lists.hint("merge"), "token").join(nodes.drop("fp").hint("merge"), "node"), "index")


def _sets(texts: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, tokens) of some nodes, from one text of each."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "tokens"])

    one = rows.join(nodes.hint("merge"), "node").groupBy("node").agg(F.min(F.struct("doc_id", "hash")).alias("r")).select("node", "r.doc_id", "r.hash")
    same = texts["doc_id"].eqNullSafe(one["doc_id"]) & texts["hash"].eqNullSafe(one["hash"])
    found = texts.join(one.hint("merge"), same).select("node", "text").mapInArrow(run, "node long, tokens array<long>")
    return found.groupBy("node").agg(F.first("tokens").alias("tokens"))


def _near(m: str, n: str, x: str, y: str) -> Column:
    """Can sets of these sizes and parities (columns x.., y..) be near copies? They may differ by a ninth of both sizes, and every difference flips one parity of a kind."""
    differ = lambda a, b: 9 * reduce(Column.__add__, [F.bit_count(F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))) for i in range(a, b)]) <= F.col(m) + F.col(n)
    small = F.least(m, n) <= WIDE_FROM
    return (5 * F.col(m) >= 4 * F.col(n)) & (5 * F.col(n) >= 4 * F.col(m)) & differ(0, NARROW_WORDS) & (small | differ(NARROW_WORDS, WORDS_OF_PARITY))


def _fingerprint_pairs(nodes: DataFrame, work: Workspace) -> DataFrame:
    """(a, b) of nodes that operator 1 links: of each fingerprint its least node with its others, and with those of fingerprints within its bits."""
    prints = work.keep(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    close = simhash.links(prints, work)
    of = lambda side, name: prints.select(F.col("fp").alias(side), F.col("first").alias(name)).hint("merge")
    apart = close.join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
    equal = nodes.join(prints.hint("merge"), "fp").where("node <> first").select("first", "node")
    return work.keep(apart.union(equal).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "linked")


def _named(prefix: str) -> list[Column]:
    return [F.col(f"p{i}").alias(f"{prefix}{i}") for i in range(WORDS_OF_PARITY)]


def _similar(pairs: DataFrame, sets: DataFrame, work: Workspace) -> DataFrame:
    """The pairs (a, b) of similarity 0.8 or more: nine times the overlap is four times both sizes or more."""
    both = pairs.join(sets.toDF("b", "y").hint("merge"), "b").join(sets.toDF("a", "x").hint("merge"), "a")
    links = work.keep(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "links")
    work.release()
    return links


def grouped(docs: DataFrame, work: Workspace, first_round: int = FIRST_ROUND, growth: int = GROWTH, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hash, node) of every row of (doc_id, hash, text), and (node, root) of nodes with near copies: one root a component."""
    bounded_batches(docs.sparkSession)
    where, made = work.write(_nodes(docs, bits), "nodes")
    checks = made.groupBy("node").agg(F.min("check").alias("first"), F.max("check").alias("last"))
    clashes = work.keep(checks.where("first < last").select("node", "first"), "clashes")  # of 64 bits: about three in 10^10 sets
    if clashes.head(1):
        own = F.when(F.col("first").isNull() | (F.col("check") == F.col("first")), F.col("node")).otherwise(F.xxhash64("node", "check"))
        made = made.join(clashes, "node", "left").withColumn("node", own).drop("first")
    rows = work.keep(made.select("doc_id", "hash", "node"), "rows")
    nodes = work.keep(made.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), *[F.first(F.col("parity")[i]).alias(f"p{i}") for i in range(WORDS_OF_PARITY)]), "sizes")
    index = _index(made, nodes, work)
    work.drop(where)
    work.release()
    linked = _fingerprint_pairs(nodes, work)
    work.release()
    sets = work.keep(_sets(docs, rows, index.select("node").distinct()), "sets")
    work.release()
    met = index.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b"), F.col("size").alias("n"), *_named("y")).distinct()
    met = met.join(nodes.select(F.col("node").alias("a"), F.col("size").alias("m"), *_named("x")).hint("merge"), "a").where(_near("m", "n", "x", "y"))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    met = work.keep(met.unionByName(linked).distinct(), "pairs")  # near copies share postings, so a linked set that the index lacks has none
    links = _similar(met, sets, work)
    roots = components(links, work)
    place = F.pmod(F.xxhash64("node", "token"), F.lit(1 << 40)) / float(1 << 40) * F.col("n")  # an entry's place in its list, by hash
    low, high, left = 0, first_round, index.drop("center")
    while True:
        named = left.join(roots.hint("merge"), "node", "left").select(*left.columns, F.coalesce("root", "node").alias("root"))
        several = named.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("token")
        now = work.keep(named.where(F.col("n") > low).join(several.hint("merge"), "token"), "left")
        if not now.head(1):
            return rows, roots
        holders = now.where((place >= low) & (place < high)).select("token", F.col("node").alias("other"), F.col("size").alias("far"), *_named("y"), F.col("root").alias("there"))
        apart = (now["token"] == holders["token"]) & (F.col("root") != F.col("there")) & _near("size", "far", "p", "y")
        pairs = now.join(holders.hint("merge"), apart).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        pairs = work.keep(pairs.join(met.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        met, more = met.unionByName(pairs), _similar(pairs, sets, work)
        if more.head(1):
            links = links.unionByName(more)
            roots = components(links, work)
        left, low, high = now.select(left.columns), high, high * growth


def keep_one(docs: DataFrame, first_round: int = FIRST_ROUND, growth: int = GROWTH, bits: int = 64) -> DataFrame:
    """One document of each group of near copies, with its columns: that of the least doc_id, then of the least text hash.

    Rows are judged one by one, so different texts under one doc_id are different documents, and of rows that agree in
    both one stays. A null doc_id comes after all others. Null texts and texts without words are copies of each other.
    An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "nearcopies")
    key, mine, n = (fresh(docs, x) for x in ("__key", "__mine", "__n"))
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows, roots = grouped(docs.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text")), work, first_round, growth, bits)
    place = lambda hashed: F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("doc_id"), hashed.alias("hash"))
    best = rows.groupBy("node").agg(F.min(place(F.col("hash"))).alias(key)).join(roots.hint("merge"), "node", "left")
    best = Workspace(docs.sparkSession, "nearcopies-kept").keep(best.groupBy(F.coalesce("root", "node")).agg(F.min(key).alias(key)).select(key), "kept")
    work.drop(work.root)  # the result reads nothing else
    work.release()
    once = Window.partitionBy(mine).orderBy("text")
    placed = docs.withColumn(mine, place(F.xxhash64(text)))
    kept = placed.join(best.hint("merge"), F.col(mine) == F.col(key), "left_semi").withColumn(n, F.row_number().over(once)).where(F.col(n) == 1)
    return kept.select(docs.columns)
