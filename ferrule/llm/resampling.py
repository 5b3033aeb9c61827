"""Operator 11: importance resampling towards a target distribution, with hashed n-gram features.

Each Arrow batch's texts are joined with sentinels, and one regex pass finds the words of all of them. The words'
starts are looked up in the texts' offsets, which names each word's document and masks n-grams that would span two.
Features are kept as bucket numbers, so texts are read once: corpus counts add one vector of buckets a task, and a
document's weight is the sum of its buckets' gains, a table of as many numbers as there are buckets. A document is
drawn by weight plus Gumbel noise from its id, which samples by weight without replacement.
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import Workspace, bounded_batches, table

#: Longest n-gram, buckets, seed of the noise, least words of a drawn document and percent drawn.
GRAMS, BUCKETS, SEED, MIN_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: ASCII letters and digits after lower-casing, and every byte of a character beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Ends each text of a batch; no word holds it.
SENTINEL = b"\x00"
#: Words that are hashed at once.
CHUNK = 1 << 19


def features(texts: list[str | None], grams: int = GRAMS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, document of each feature, bucket of each feature), features in order of their documents."""
    parts = [(t or "").encode().lower() + SENTINEL for t in texts]
    offsets = np.cumsum([0, *map(len, parts)])
    n_words = np.zeros(len(texts), np.int64)
    docs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    words, owner = [], np.zeros(0, np.int64)
    matches = WORD.finditer(b"".join(parts))
    while block := list(islice(matches, CHUNK)):
        new = np.searchsorted(offsets, np.fromiter((m.start() for m in block), np.int64, len(block)), "right") - 1
        n_words += np.bincount(new, minlength=len(texts))
        seen = len(words)  # the last words of the block before, for n-grams that go on
        words += [m[0] for m in block]
        owner = np.concatenate([owner, new])
        for n in range(1, grams + 1):
            at = np.arange(max(0, seen - n + 1), len(words) - n + 1)
            at = at[owner[at] == owner[at + n - 1]]
            texts_of = words[seen:] if n == 1 else (b" ".join(words[i : i + n]) for i in at.tolist())
            docs.append(owner[at])
            found.append(np.fromiter(map(crc32, texts_of), np.int64, len(at)) % buckets)
        words, owner = words[len(words) - grams + 1 :], owner[len(owner) - grams + 1 :]
    doc, bucket = np.concatenate(docs), np.concatenate(found)
    order = np.argsort(doc, kind="stable")
    return n_words, doc[order], bucket[order]


def _width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _slices(column: pa.BinaryArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch, and where each row's begin; rows are never null."""
    starts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[starts[0] : starts[-1]] if starts[-1] > starts[0] else np.zeros(0, np.uint8)
    return data.view(kind), (starts - starts[0]) // np.dtype(kind).itemsize


def featured(docs: DataFrame, text_col: str = "text", grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """The other columns of docs, and __words, __features (their number) and __buckets (little-endian bucket numbers)."""
    others = [c for c in docs.columns if c != text_col]
    names = [*others, "__words", "__features", "__buckets"]

    def run(batches):
        for batch in batches:
            n_words, doc, bucket = features(batch.column(0).to_pylist(), grams, buckets)
            per = np.bincount(doc, minlength=len(n_words))
            data = bucket.astype(_width(buckets))
            ends = np.concatenate([[0], np.cumsum(per)]) * data.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(n_words), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.record_batch([*batch.columns[1:], pa.array(n_words), pa.array(per.astype(np.int64)), packed], names)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("__text"), *others)
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others], "__words long, __features long, __buckets binary"])
    return rows.mapInArrow(run, schema)


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of ``featured``: a vector a task, and one of ``buckets`` numbers on the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_slices(batch.column(0), _width(buckets))[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("__buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What one feature of each bucket adds to a weight: thousandths of the log ratio of smoothed shares, floored."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, doc_id) -> int:
    """Thousandths of a Gumbel deviate from an id's hash; a null id counts as empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(rows: DataFrame, gain: np.ndarray, id_col: str, seed: int = SEED) -> DataFrame:
    """Adds weight and score to rows of ``featured`` in place of their buckets."""
    buckets = len(gain)
    others = [c for c in rows.columns if c not in (id_col, "__buckets")]

    def run(batches):
        for batch in batches:
            data, starts = _slices(batch.column(1), _width(buckets))
            weight = np.diff(np.concatenate([[0], np.cumsum(gain[data])])[starts])
            drawn = np.array([noise(seed, i) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.record_batch([batch.column(0), *batch.columns[2:], pa.array(weight), pa.array(weight + drawn)], [id_col, *others, "weight", "score"])

    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (id_col, *others)], "weight long, score long"])
    return rows.select(id_col, "__buckets", *others).mapInArrow(run, schema)


def ranked(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The id, n_features, weight, score and rank: 1, 2, 3 ... over the drawn documents, null for the rest.

    Settings are grams, buckets, seed, min_words and percent. Other columns of both tables are ignored, whatever their names.

    Null and empty texts have no features and weight 0, and are never drawn while min_words is above 0. Repeated rows
    are drawn one by one; ties go to the smaller id, then to fewer features, a null id last. An empty target leaves
    the corpus' own rarity to decide, and an empty table gives no rows. Texts of any length are taken whole.
    """
    return _ranked(docs.select(id_col, "text"), target, id_col, **settings)


def _ranked(docs: DataFrame, target: DataFrame, id_col: str, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    if not 0 <= percent <= 100 or grams < 1 or buckets < 1:
        raise ValueError("percent is 0 to 100, and there is at least one bucket and one word in a feature")
    work = Workspace(docs.sparkSession, "resampling")
    rows = work.keep(featured(docs, "text", grams, buckets), "features")
    gain = gains(bucket_counts(rows, buckets), bucket_counts(featured(target.select("text"), "text", grams, buckets), buckets))
    scored = work.keep(weighted(rows, gain, id_col, seed), "scores")
    fits = F.col("__words") >= min_words
    n = scored.where(fits).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.asc("__features")]
    placed = numbered(scored.where(fits), order, (), "__rank").withColumn("rank", F.when(F.col("__rank") <= n, F.col("__rank"))).drop("__rank")
    rest = scored.where(~fits).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select(*[c for c in docs.columns if c != "text"], F.col("__features").alias("n_features"), "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The drawn documents with all their columns; settings as for ``ranked``."""
    work = Workspace(docs.sparkSession, "resample")
    whole = work.keep(docs.withColumn("__row", F.monotonically_increasing_id()), "documents")  # written, so that a row keeps its number
    slim = whole.select("__row", F.col(id_col).alias("__doc"), "text")
    drawn = _ranked(slim, target, "__doc", **settings).where("rank IS NOT NULL").select("__row")
    return whole.join(drawn, "__row", "left_semi").select(docs.columns)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The 256 entries of the cyclic redundancy check's table, and the check of a list of bytes, in DuckDB's SQL.
CRC_TABLE = "(SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) AS r(n))"
CRC = "xor(list_reduce({bytes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
BYTES = "list_transform(range(len({hex}) // 2), lambda i: ('0x' || substr({hex}, 2 * i + 1, 2))::BIGINT)"

OP11_ORACLE = f"""
WITH crc AS {CRC_TABLE},
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
q AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
e AS (SELECT rid, unnest(words) AS w FROM d),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM e UNION SELECT w FROM q)),
b AS (SELECT w, {CRC.format(bytes=BYTES.format(hex="h"))} % {BUCKETS} AS bucket FROM v, crc),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM e JOIN b USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM q JOIN b USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS}) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
x AS (SELECT rid, sum(gain)::BIGINT AS weight FROM e JOIN b USING (w) JOIN g USING (bucket) GROUP BY rid),
z AS (SELECT d.rid, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256(concat('{SEED}:', doc_id)), 1, 8))::BIGINT AS h FROM d LEFT JOIN x USING (rid)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, n_features >= {MIN_WORDS} AS fits FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY fits ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, (count(*) FILTER (fits) OVER ()) * {PERCENT} // 100 AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN fits AND place <= n THEN place END AS rank FROM r
"""
