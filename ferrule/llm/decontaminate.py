"""Operator 13: benchmark decontamination by a broadcast hash set of test windows, in DataFrame operations alone.

A benchmark item's windows are all its runs of WINDOW words, or its whole text if it has fewer. Distinct windows are
hashed and broadcast in blocks of bounded size; each document's windows are hashed where the document is read, and
looked up there, so that only hits leave the scan. A hit counts once its words have been compared. Items with the same
words are one class, so a text that a third of the benchmark repeats is looked up and counted once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, table

WINDOW = 10
#: Windows that are broadcast at once, some 150 bytes each; a larger benchmark takes one more scan for each further block.
BLOCK = 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of a text as written, with what stands before it.
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A window is coded as SPAN times its first word's place plus its number of words.
SPAN = 64


def words(text: Column) -> Column:
    """Words in lower case, A to Z alone; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def classes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(class, words, items): benchmark texts with equal words are one class, with their distinct ids as sorted text; null ids are left out."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    once = rows.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return once.withColumn("class", F.monotonically_increasing_id())


def item_windows(known: DataFrame, window: int = WINDOW) -> DataFrame:
    """(len, words, classes) of distinct windows."""
    size = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    runs = known.select("class", size.alias("len"), F.explode(starts).alias("at"), "words").select("class", "len", F.slice("words", F.col("at"), F.col("len")).alias("words"))
    return runs.groupBy("len", "words").agg(F.collect_set("class").alias("classes"))


def _window_hash(hashes: Column, at: Column, length: Column, lengths: list[int]) -> Column:
    """One hash of the words' hashes from a place (0 on), for each length that the benchmark has."""
    of = lambda n: F.xxhash64(*[F.get(hashes, at + k) for k in range(n)])
    return of(lengths[0]) if len(lengths) == 1 else reduce(lambda c, n: c.when(length == n, of(n)), lengths[1:], F.when(length == lengths[0], of(lengths[0])))


def hits(rows: DataFrame, tests: DataFrame, lengths: list[int]) -> DataFrame:
    """rows(__row, doc_id, __words) to (__row, doc_id, n_words, start, len, classes): each verified hit, and one row with a null start for every row."""
    hashed = rows.select("__row", "doc_id", "__words", F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"))
    n = F.size("__words")
    codes = [F.when(n >= k, F.sequence(F.lit(k), (n - k) * SPAN + k, F.lit(SPAN))).otherwise(F.array().cast("array<int>")) for k in lengths]
    each = hashed.select("__row", "doc_id", "__words", "__hashes", F.explode(F.concat(F.array(F.lit(0)), *codes)).alias("__code"))
    at, length = F.shiftright("__code", 6), F.col("__code").bitwiseAND(F.lit(SPAN - 1))
    looked = each.withColumn("__hash", F.when(F.col("__code") > 0, _window_hash(F.col("__hashes"), at, length, lengths)))
    met = looked.join(F.broadcast(tests), F.col("__hash") == F.col("test_hash"), "left")
    same = (F.col("test_len") == length) & (F.slice("__words", at + 1, length) == F.col("test_words"))
    start = F.when(F.col("__code") > 0, at)
    return met.where((F.col("__code") == 0) | same).select("__row", "doc_id", F.size("__words").cast("long").alias("n_words"), start.alias("start"), F.when(start.isNotNull(), length).alias("len"), F.when(start.isNotNull(), F.col("classes")).alias("classes"))


def all_hits(rows: DataFrame, known: DataFrame, work: Workspace, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``hits`` over all test windows; without any, the rows alone."""
    if not 1 <= window < SPAN:
        raise ValueError(f"a window has 1 to {SPAN - 1} words")
    size = F.size("words")
    found = item_windows(known, window)
    tests = found.select(F.col("len").alias("test_len"), F.col("words").alias("test_words"), "classes", F.transform("words", lambda w: F.xxhash64(w)).alias("__hashes"))
    shape = [r["len"] for r in known.select(F.least(size, F.lit(window)).alias("len")).distinct().orderBy(F.desc("len")).collect()]  # at most ``window`` lengths
    if not shape:
        return rows.select("__row", "doc_id", F.size("__words").cast("long").alias("n_words"), *[F.lit(None).cast(kind).alias(c) for c, kind in (("start", "int"), ("len", "int"), ("classes", "array<bigint>"))])
    tests = work.keep(tests.withColumn("test_hash", _window_hash(F.col("__hashes"), F.lit(0), F.col("test_len"), shape)).drop("__hashes"), "tests")
    weight = F.lit(1) + F.size("classes")
    total = tests.agg(F.sum(weight)).first()[0]
    blocks = -(-total // block)
    parts = [hits(rows, tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("test_hash"), F.lit(blocks)) == b), shape) for b in range(blocks)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more.where("start IS NOT NULL"))
    return out


def _covered(found: DataFrame) -> DataFrame:
    """Adds __from and __upto to hits: the words of each that no hit before it in its document covers."""
    before = Window.partitionBy("__row").orderBy("start", F.desc("len")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    return found.withColumn("__from", F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0)))).withColumn("__upto", end)


def contamination(rows: DataFrame, benchmark: DataFrame, work: Workspace, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """rows(__row, doc_id, text) to one row each: __row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    known = work.keep(classes(benchmark), "classes")
    found = all_hits(rows.select("__row", "doc_id", words(F.col("text")).alias("__words")), known, work, window, block)
    found = work.keep(found, "hits")
    hit = found.where("start IS NOT NULL")
    new = F.greatest(F.lit(0), F.col("__upto") - F.col("__from")).cast("long")
    counted = _covered(hit.select("__row", "start", "len")).groupBy("__row").agg(F.sum(new).alias("n_hit"))
    items = known.select("class", "items")
    size = known.agg(F.sum(F.size("items") + 1)).first()[0] or 0
    met = hit.select("__row", F.explode("classes").alias("class")).distinct().join(F.broadcast(items) if size <= block else items, "class")
    named = met.groupBy("__row").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"))
    all_rows = found.where("start IS NULL").select("__row", "doc_id", "n_words")
    joined = all_rows.join(counted, "__row", "left").join(named, "__row", "left")
    list_of = F.coalesce("__items", F.array().cast("array<string>"))
    return joined.select("__row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(list_of).cast("long").alias("n_items"), F.sha2(F.array_join(list_of, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted, comma-joined item ids) and contaminated, for every row.

    Null and empty texts have no words and no hits; items without words have no window. Repeated rows, and rows that
    share an id or have none, are counted one by one. Items that share an id count once, and null ids are not counted.
    Texts and items of any length are taken whole, and other columns ignored. An empty benchmark hits nothing.
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "text")
    return contamination(rows, benchmark, work, window, block).drop("__row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", max_share: float = 0.0, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The documents with their columns, cleaned. "documents" drops those with more than max_share of their words hit.

    "spans" cuts the hit words, each with the separators before it, out of the others' texts; null texts stay null.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is spans or documents")
    work = Workspace(docs.sparkSession, "decontaminate")
    whole = work.keep(docs.withColumn("__row", F.monotonically_increasing_id()), "documents")  # written, so that a row keeps its number
    rows = whole.select("__row", F.lit(0).alias("doc_id"), "text")
    known = work.keep(classes(benchmark), "classes")
    found = all_hits(rows.select("__row", "doc_id", words(F.col("text")).alias("__words")), known, work, window, block)
    found = work.keep(found.where("start IS NOT NULL").select("__row", "n_words", "start", "len"), "hits")
    each = _covered(found).where("__upto > __from").groupBy("__row").agg(F.max("n_words").alias("__n"), F.sum(F.col("__upto") - F.col("__from")).alias("__hit"), F.sort_array(F.collect_list(F.struct("__from", "__upto"))).alias("__runs"))
    if remove == "documents":
        return whole.join(each.where(F.col("__hit") > F.lit(max_share) * F.col("__n")), "__row", "left_anti").select(docs.columns)
    text = F.col("text").cast("string")
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    end_before = lambda i: F.coalesce(F.get("__runs", i - 1)["__upto"], F.lit(0))
    until = lambda i: F.coalesce(F.get("__runs", i)["__from"], F.size("__pieces"))
    kept = F.array_join(F.transform(F.sequence(F.lit(0), F.size("__runs")), lambda i: F.array_join(F.slice("__pieces", end_before(i) + 1, until(i) - end_before(i)), "")), "")
    tail = F.substring(text, F.length(F.array_join("__pieces", "")) + 1, F.length(text))
    cut = whole.join(each.select("__row", "__runs"), "__row", "left").withColumn("__pieces", F.when(F.col("__runs").isNotNull(), pieces))
    cleaned = F.when(F.col("__runs").isNull(), text).otherwise(F.concat(kept, tail))
    return cut.withColumn("text", cleaned).select(docs.columns)


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
i AS (SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM benchmark),
s AS (SELECT item, words, least(len(words), {WINDOW}) AS n FROM i WHERE len(words) > 0),
t AS (SELECT DISTINCT item, n, array_to_string(words[p : p + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS p FROM s)),
g AS (SELECT rid, p, n, array_to_string(words[p : p + n - 1], ' ') AS gram FROM (SELECT rid, n, words, unnest(range(1, len(words) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM s) WHERE len(words) >= n)),
h AS (SELECT g.rid, g.p, g.n, t.item FROM g JOIN t ON g.n = t.n AND g.gram = t.gram),
c AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM h)) GROUP BY rid),
m AS (SELECT rid, count(DISTINCT item) AS n_items, coalesce(string_agg(DISTINCT item, ',' ORDER BY item), '') AS items FROM h GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN m USING (rid)
"""
