"""Operator 7: line deduplication by pairwise alignment.

Lines are named by 128-bit hashes, and what documents share is found through lists of hashes that are as rare as needed: the shortest runs of lines that reach MIN_CHARS characters, from each line on and up to
each line, are posted under their hashes: no shorter common block is ever deleted, and every line of a longer
one lies in such a run of it. Each document is first paired with the holder before it in every list; lists
longer than LIST_PART are cut into parts by a hash, whose first holders pair with the list's first. Pairs are
aligned by patience diff over line hashes, and aligned common blocks of at least MIN_CHARS characters go from
the later document. A run of which lines remain then meets further earlier holders in rounds, FIRST_ROUND of
them and GROWTH times as many in each next round, until it is gone or all were met: the result is that of all
pairs that share a run. Blank lines go with the lines around them. Texts are read only to write the result.

No pair is aligned twice. A run stays past its first round only where an alignment crosses it, that is where the two
texts have their common lines in another order; such a run alone meets all its holders.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, bounded_batches, fresh, join_unique, table

#: About one sentence.
MIN_CHARS = 40
LIST_PART = 256
FIRST_ROUND, GROWTH = 4, 8

Lines = list[bytes]
SPACES = " \t\n\x0b\x0c\r"
#: Name of a blank line.
BLANK = md5(b"").digest()


def patience(a: Lines, b: Lines) -> list[tuple[int, int]]:
    """Aligned positions of two line lists: equal ends first, then lines unique in both, and so on between them.

    Where no line is unique in both, occurrences are counted, and the first of a line goes with the first, the second
    with the second: between two aligned lines no line but a blank one is left that both sides have.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = _ascending(_unique_in_both(a, a0, a1, b, b0, b1)) or _ascending(_counted_in_both(a, a0, a1, b, b0, b1))
        if not anchors:
            continue
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            todo.append((i + 1, k, j + 1, m))
        out += anchors
    return sorted(out)


def _unique_in_both(a: Lines, a0: int, a1: int, b: Lines, b0: int, b1: int) -> list[tuple[int, int]]:
    def once(lines, lo, hi):
        at: dict[bytes, int] = {}
        for i in range(lo, hi):
            at[lines[i]] = -1 if lines[i] in at else i
        return at

    first, second = once(a, a0, a1), once(b, b0, b1)
    return [(i, second[x]) for x, i in first.items() if i >= 0 and second.get(x, -1) >= 0]


def _counted_in_both(a: Lines, a0: int, a1: int, b: Lines, b0: int, b1: int) -> list[tuple[int, int]]:
    def counted(lines, lo, hi):
        seen: dict[bytes, int] = {}
        out = {}
        for i in range(lo, hi):
            if lines[i] != BLANK:
                seen[lines[i]] = seen.get(lines[i], 0) + 1
                out[lines[i], seen[lines[i]]] = i
        return out

    second = counted(b, b0, b1)
    return [(i, second[x]) for x, i in counted(a, a0, a1).items() if x in second]


def _ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain of pairs that ascend on both sides; the pairs come ascending on the first."""
    ends: list[int] = []
    tops: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        before[n] = tops[at - 1] if at else -1
        ends[at : at + 1] = [j]
        tops[at : at + 1] = [n]
    out, n = [], tops[-1] if tops else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def common_blocks(earlier: Lines, later: Lines, chars: list[int], min_chars: int = MIN_CHARS) -> list[int]:
    """Positions in ``later`` of the lines, but blank ones, of the aligned blocks that reach min_chars."""
    out, block = [], []
    for i, j in [*patience(earlier, later), (-9, -9)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            at = [q for _, q in block]
            if sum(chars[q] for q in at) >= min_chars:
                out += [q for q in at if chars[q]]
            block = []
        block.append((i, j))
    return out


def with_blanks(gone: set[int], filled: list) -> set[int]:
    """The lines that go, and the blank ones between them: those that have a line that goes, or the text's end, on both sides."""
    out, between, open_ = set(gone), [], bool(gone)
    for i, has in enumerate(filled):
        if not has:
            between.append(i)
            continue
        if open_ and i in gone:
            out.update(between)
        between, open_ = [], i in gone
    return out | set(between) if open_ else out


def _key(docs: DataFrame):
    """Rows with the same doc_id and text are one document; ids come before text hashes, a null id before all."""
    return F.struct(F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(docs["text"]).alias("hash"))


def line_table(docs: DataFrame) -> DataFrame:
    """(key, lines, chars): 128-bit hashes and lengths of each distinct document's trimmed lines."""
    lines = F.split(F.col("text"), "\n")
    trimmed = F.transform(lines, lambda x: F.regexp_replace(x, "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", ""))
    made = docs.where("text IS NOT NULL").select(_key(docs).alias("key"), trimmed.alias("t"))
    made = made.select("key", F.transform("t", lambda x: F.unhex(F.md5(x))).alias("lines"), F.transform("t", lambda x: F.length(x)).alias("chars"))
    return made.groupBy("key").agg(F.first("lines").alias("lines"), F.first("chars").alias("chars"))


def runs(chars: list[int], min_chars: int = MIN_CHARS) -> set[tuple[int, int]]:
    """(i, j): the shortest runs i to j - 1 that reach min_chars, from each line on and up to each line that is not empty."""
    found, j, size = set(), 0, 0
    for i in range(len(chars)):
        while size < min_chars and j < len(chars):
            size += chars[j]
            j += 1
        if size < min_chars:
            break
        if chars[i]:
            found.add((i, j))
        size -= chars[i]
    i, size = 0, 0
    for j in range(len(chars)):
        size += chars[j]
        while size - chars[i] >= min_chars:
            size -= chars[i]
            i += 1
        if size >= min_chars and chars[j]:
            while not chars[i]:
                i += 1
            found.add((i, j + 1))
    return found


def postings(lines: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(run, key): the hashes of the document's runs; of a table with a column ``gone`` only those with a line that remains."""

    def run(batches):
        import xxhash

        for batch in batches:
            keys, held = [], []
            gone = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
            for n, (lines, chars, away) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), gone, strict=True)):
                raw, away = b"".join(lines), set(away or ())
                found = {xxhash.xxh64_intdigest(raw[16 * i : 16 * j]) - (1 << 63) for i, j in runs(chars, min_chars) if not away or any(chars[q] and q not in away for q in range(i, j))}
                keys += [n] * len(found)
                held += found
            yield pa.record_batch([pa.array(held, pa.int64()), batch.column(0).take(pa.array(keys, pa.int64()))], ["run", "key"])

    schema = T.StructType([T.StructField("run", T.LongType()), T.StructField("key", lines.schema["key"].dataType)])
    return lines.select("key", "lines", "chars", *[c for c in lines.columns if c == "gone"]).mapInArrow(run, schema)


def shared(posted: DataFrame, work: Workspace) -> DataFrame:
    """(run, key, n, least): the postings of runs that n > 1 documents hold, the first of them ``least``."""
    lists = posted.groupBy("run").agg(F.count("*").alias("n"), F.min("key").alias("least")).where("n > 1")
    return join_unique(posted, work.keep(lists.withColumn("rows", F.col("n")), "lists"), "run", "rows", "key")


def pairs(held: DataFrame, list_part: int = LIST_PART) -> DataFrame:
    """(later, earlier), each once: neighbours in the lists."""
    before = F.lag("key").over(Window.partitionBy("run", "part").orderBy("key"))
    held = held.withColumn("part", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / list_part)))
    linked = held.select(F.col("key").alias("later"), F.coalesce(before, F.col("least")).alias("earlier"))
    return linked.where("earlier < later").distinct()


def _removed(linked: DataFrame, lines: DataFrame, min_chars: int) -> DataFrame:
    """(key, line), each once: what the alignments of some pairs delete."""
    both = linked.join(lines.select(F.col("key").alias("later"), F.col("lines").alias("b"), F.col("chars")), "later").join(
        lines.select(F.col("key").alias("earlier"), F.col("lines").alias("a")), "earlier"
    )

    def run(batches):
        for batch in batches:
            gone = [common_blocks(a, b, chars, min_chars) for a, b, chars in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])

    schema = T.StructType([T.StructField("key", linked.schema["later"].dataType), T.StructField("gone", T.ArrayType(T.IntegerType()))])
    found = both.select(F.col("later").alias("key"), "a", "b", "chars").mapInArrow(run, schema).where(F.size("gone") > 0)
    return found.select("key", F.explode("gone").alias("line")).distinct()


def _by_document(gone: DataFrame) -> DataFrame:
    return gone.distinct().groupBy("key").agg(F.array_sort(F.collect_list("line")).alias("gone"))


def removals(docs: DataFrame, work: Workspace, min_chars: int = MIN_CHARS, list_part: int = LIST_PART) -> DataFrame:
    """(key, gone): the positions of the lines that go from each document that loses any."""
    lines = work.keep(line_table(docs), "lines")
    held = work.keep(shared(work.keep(postings(lines, min_chars), "postings"), work), "shared")
    linked = work.keep(pairs(held, list_part), "pairs")
    gone = work.keep(_removed(linked, lines, min_chars), "removed")
    place = F.pmod(F.xxhash64("key", "run"), F.lit(1 << 40)) / float(1 << 40) * F.col("n")  # a holder's place in its list, by hash
    # runs that their documents still hold, and have an earlier holder
    later, low, high, left = held.where("key > least").select("run", "key", "n"), 0, FIRST_ROUND, lines
    while True:
        left = left.join(later.select("key").distinct(), "key", "left_semi")
        still = postings(left.drop("gone").join(_by_document(gone), "key", "left"), min_chars)
        later = work.keep(later.join(still, ["run", "key"], "left_semi").where(F.col("n") > low), "later")
        if not later.head(1):
            return _by_document(gone)
        holders = held.where((place >= low) & (place < high)).select("run", F.col("key").alias("earlier"))
        met = later.select("run", F.col("key").alias("later")).join(holders, "run").where("earlier < later").select("later", "earlier").distinct()
        fresh_pairs = work.keep(met.join(linked, ["later", "earlier"], "left_anti"), "pairs")
        linked = linked.unionByName(fresh_pairs)
        gone = gone.unionByName(work.keep(_removed(fresh_pairs, lines, min_chars), "removed"))
        low, high = high, high * GROWTH


def _counts(docs: DataFrame) -> tuple[str, str]:
    return fresh(docs, "__lines"), fresh(docs, "__lost")


def without_lines(docs: DataFrame, min_chars: int = MIN_CHARS, list_part: int = LIST_PART) -> DataFrame:
    """The columns of ``docs``, text without the deleted lines, and as the last two columns its lines before and the lines deleted.

    Later means a larger doc_id (a null one is the least), then a larger hash of the text; rows that agree in
    both are one document and lose the same lines. Blank lines go if the lines, or the text's end, on both sides do. Null texts stay null.
    """
    bounded_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "lines")
    mine, key, gone = (fresh(docs, x) for x in ("__k", "__key", "gone"))
    found = Workspace(docs.sparkSession, "lines-gone").keep(removals(docs, work, min_chars, list_part), "gone").withColumnsRenamed({"key": key, "gone": gone})
    work.drop(work.root)  # the result reads nothing else
    joined = docs.withColumn(mine, _key(docs)).join(found.hint("merge"), F.col(mine) == F.col(key), "left").drop(mine, key)
    at, counts = docs.columns.index("text"), _counts(docs)

    def run(batches):
        for batch in batches:
            texts, before, lost = [], [], []
            for text, dropped in zip(batch.column(at).to_pylist(), batch.column(len(batch.columns) - 1).to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                away = ()
                if dropped:
                    away = with_blanks(set(dropped), [x.strip(SPACES) for x in lines])
                    text = "\n".join([x for i, x in enumerate(lines) if i not in away])
                texts.append(text)
                before.append(len(lines))
                lost.append(len(away))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch([*columns, pa.array(before, pa.int64()), pa.array(lost, pa.int64())], [*batch.schema.names[:-1], *counts])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in counts]])
    return joined.mapInArrow(run, schema)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, list_part: int = LIST_PART) -> DataFrame:
    """doc_id, n_lines, n_removed and the remaining text for every row; an empty table gives no rows."""
    return without_lines(docs.select("doc_id", "text"), min_chars, list_part).select("doc_id", F.col("__lines").alias("n_lines"), F.col("__lost").alias("n_removed"), "text")


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, list_part: int = LIST_PART) -> DataFrame:
    """The documents with repeated blocks deleted; one that loses its last word goes. n_chars, where there is one, follows the text."""
    lost = _counts(docs)[1]
    kept = without_lines(docs, min_chars, list_part).where((F.col(lost) == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.when(F.col(lost) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))
