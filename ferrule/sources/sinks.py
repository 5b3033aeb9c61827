"""Sinks: Parquet tables that never overwrite, and exact-text reports."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterable, Mapping, Sequence
from contextlib import contextmanager
from decimal import Decimal
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula import Composition, with_composition
from ..operators.query import InvalidRecords, require_valid, validated
from ..operators.validate import imported
from ..plans.workspace import Workspace
from .jsonl import read_jsonl
from .lines import numbered_lines
from .texts import cell, line, write_texts  # noqa: F401
from .tsv import read_scored

#: Lines of a block of text that is hashed at once, bytes of blocks that a task hands on together, and how blocks are packed.
BLOCK_LINES, HELD_BYTES, LEVEL = 1024, 4 << 20, 9
BLOCKS = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("block", pa.binary())])


@contextmanager
def new_directory(path: str):
    """A directory that must not exist yet, not even as a broken link; filled beside its place and renamed when complete, removed on failure."""
    target = Path(path)
    if os.path.lexists(target):
        raise FileExistsError(path)
    if not target.parent.is_dir():
        raise FileNotFoundError(target.parent)
    making = target.parent / f".{target.name}.{os.getpid()}.part"
    making.mkdir()
    try:
        yield making
        if os.path.lexists(target):
            raise FileExistsError(path)
        making.rename(target)
    except BaseException:
        shutil.rmtree(making, ignore_errors=True)
        raise


def write_tsv(rows: Iterable, header: list[str], path: str | Path) -> str:
    """A small report's rows as text with a header; returns the SHA-256. Tables go through write_texts."""
    digest = hashlib.sha256()
    with open(path, "xb") as to:
        for row in chain([header], rows):
            text = line(row).encode()
            digest.update(text)
            to.write(text)
    return digest.hexdigest()


def write_toml(values: Mapping, path: str | Path) -> None:
    """Flat and one-level nested values by sorted key."""

    def one(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return repr(v)
        return "[" + ", ".join(map(one, v)) + "]" if isinstance(v, (list, tuple)) else json.dumps(str(v))

    flat = [f"{k} = {one(v)}" for k, v in sorted(values.items()) if not isinstance(v, Mapping)]
    for k, table in sorted((k, v) for k, v in values.items() if isinstance(v, Mapping)):
        flat += ["", f"[{k}]", *[f"{json.dumps(str(a))} = {one(b)}" for a, b in sorted(table.items())]]
    Path(path).write_text("\n".join(flat) + "\n")


def inventory(directory: str | Path) -> dict[str, str]:
    """SHA-256 of every file below a directory, by relative path; links are refused."""
    root = Path(directory)
    out = {}
    for p in sorted(root.rglob("*")):
        if p.is_symlink():
            raise ValueError(f"link in a bundle: {p}")
        if p.is_file():
            out[p.relative_to(root).as_posix()] = hashlib.sha256(p.read_bytes()).hexdigest()
    return out


def verify(directory: str | Path, expected: Mapping[str, str], besides: Iterable[str] = ()) -> None:
    found = {k: v for k, v in inventory(directory).items() if k not in set(besides)}
    if found != dict(expected):
        raise InvalidRecords(f"bundle differs in {sorted(set(found.items()) ^ set(dict(expected).items()))[:3]}")


@contextmanager
def new_folder(spark: SparkSession, path: str):
    """A folder of any file system that Spark writes, which must not exist yet; written beside its place and renamed when complete, removed on failure."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = hadoop(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = system.makeQualified(target)
    if system.exists(target) or (target.toUri().getScheme() == "file" and os.path.lexists(target.toUri().getPath())):
        raise FileExistsError(path)
    if not system.exists(target.getParent()):
        raise FileNotFoundError(str(target.getParent()))
    making = hadoop(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}.part")
    try:
        yield str(making)
        if system.exists(target) or not system.rename(making, target):
            raise FileExistsError(path)
    finally:
        system.delete(making, True)


def score_text(x: float) -> str:
    """The fewest digits that read back: plain from 0.0001 up to a million, and beyond as digits, e and the power without sign or zeros to fill."""
    if x == 0 or 1e-4 <= abs(x) < 1e6:
        return repr(x)
    sign, digits, _ = (number := Decimal(repr(x))).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    return f"{'-' * sign}{text[0]}.{text[1:] or '0'}e{number.adjusted()}"


def records_digest(rows: DataFrame) -> str:
    return records_digests(rows).first()["records_sha256"]


def records_digests(rows: DataFrame) -> DataFrame:
    """(n, records_sha256) of one row: SHA-256 of formula, tab, score and line end of every row in order of source_row, the same at any size.

    Tasks sort their range of rows and make packed blocks of its text. A digest is one chain of states, so one task
    reads the blocks in their order; it holds one batch of them, and nothing passes the driver but the result.
    """
    def blocks(batches):
        part, place, held, size, codec = TaskContext.get().partitionId(), 0, [], 0, pa.Codec("zstd", compression_level=LEVEL)
        for batch in batches:
            texts = [f"{c}\t{score_text(s)}\n" for c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            for at in range(0, len(texts), BLOCK_LINES):
                some = "".join(texts[at : at + BLOCK_LINES]).encode()
                held.append((part, place, len(texts[at : at + BLOCK_LINES]), len(some), codec.compress(some, asbytes=True)))
                place, size = place + 1, size + len(some)
                if size >= HELD_BYTES:
                    yield pa.RecordBatch.from_pylist([dict(zip(BLOCKS.names, x, strict=True)) for x in held], BLOCKS)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(BLOCKS.names, x, strict=True)) for x in held], BLOCKS)

    def chain_up(batches):
        digest, n, codec = hashlib.sha256(), 0, pa.Codec("zstd")
        for batch in batches:
            n += sum(batch.column(0).to_pylist())
            for size, block in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                digest.update(codec.decompress(block.as_buffer(), size))
        yield pa.record_batch([pa.array([n]), pa.array([digest.hexdigest()])], ["n", "records_sha256"])

    order = ["source_row", "composition", "score"]
    dealt = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    written = Workspace(rows.sparkSession, "digest").keep(dealt.select("composition", F.col("score").cast("double").alias("score")).mapInArrow(blocks, "part int, place long, n long, size long, block binary"), "blocks")
    chained = written.repartition(1).sortWithinPartitions("part", "place").select("n", "size", "block").mapInArrow(chain_up, "n long, records_sha256 string")
    return chained.agg(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("n"), F.coalesce(F.max("records_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("records_sha256"))


def import_scores(table: DataFrame, path: str, source: str, policy: str = "error", row: str = "source_row", further: Mapping[str, str] | None = None) -> dict:
    """Validate (composition, score, source_row) and write it as Parquet with metadata; the folder appears only when what was written validates again."""
    spark: SparkSession = table.sparkSession
    if not source.strip():
        raise ValueError("the source must be described")
    with new_folder(spark, path) as making:
        imported(validated(table), row, policy).write.parquet(f"{making}/compositions")
        back = spark.read.parquet(f"{making}/compositions")
        n = back.count()
        if not n:
            raise InvalidRecords("there are no records to import")
        require_valid(validated(back))
        metadata = {"schema_version": "1", "source": source, "row_count": str(n), "duplicate_policy": policy, "records_sha256": records_digest(back), **(further or {})}
        spark.createDataFrame(sorted(metadata.items()), "key string, value string").coalesce(1).write.parquet(f"{making}/import_metadata")
    return metadata


def import_tsv(spark: SparkSession, path: str, target: str, source: str, policy: str = "error", write=import_scores) -> dict:
    """Import a scored TSV; source_sha256 is the hash of the file's bytes."""
    with open(path, "rb") as f:
        digest = hashlib.file_digest(f, "sha256").hexdigest()
    return write(read_scored(spark, path), target, source, policy, further={"source_sha256": digest})


def import_records(spark: SparkSession, records: Iterable, path: str, source: str, policy: str = "error") -> dict:
    """Import records that the driver holds: pairs of a formula or Composition and a score."""
    rows = []
    for n, record in enumerate(records, 1):
        if not isinstance(record, tuple) or len(record) != 2:
            raise InvalidRecords(f"record {n} is no pair of formula and score")
        formula, score = record
        formula = formula.formula if isinstance(formula, Composition) else formula
        if not isinstance(formula, str) or isinstance(score, bool) or not isinstance(score, (int, float)):
            raise InvalidRecords(f"record {n} is no pair of formula and score")
        rows.append((n, formula, float(score)))
    return import_scores(spark.createDataFrame(rows, "source_row long, composition string, score double"), path, source, policy)


def write_by_arity(table: DataFrame, path: str) -> None:
    """Score rows partitioned by arity, so that an arity filter reads only its folders."""
    rows = with_composition(table)
    require_valid(rows.withColumn("error", F.col("formula_error")))
    rows.select("formula", "terms", "score", "nary").write.partitionBy("nary").mode("errorifexists").parquet(path)


def write_bundle(split: DataFrame, path: str, manifest: Mapping) -> None:
    """A split as text: per seed its training, candidates, heldout and labels, and a root manifest with the hash of each file."""
    seeds = sorted(r["seed"] for r in split.select("seed").distinct().collect())
    label = F.when(F.col("heldout"), "positive").otherwise("unlabelled")
    parts = {
        "inputs/training.tsv": (split.where("role = 'training'"), ["composition"]),
        "inputs/candidates.tsv": (split.where("role = 'candidate'"), ["composition"]),
        "evaluation/heldout.tsv": (split.where("heldout"), ["composition"]),
        "evaluation/labels.tsv": (split.where("role = 'candidate'").withColumn("label", label), ["composition", "label"]),
    }
    with new_directory(path) as root:
        files = {}
        for name, (rows, columns) in parts.items():
            where = F.concat(F.format_string("split-%02d/", "seed"), F.lit(name))
            files |= write_texts(rows, root, where, ["composition"], columns, [f"split-{s:02d}/{name}" for s in seeds])
        write_toml({**manifest, "files": {k: digest for k, (_, digest) in files.items()}}, root / "manifest.toml")


def write_snapshot(spark: SparkSession, documents: str, path: str, database_version: str) -> dict:
    """A synthetic snapshot from JSON lines: normalised records and documents in order of their ids, and metadata with count and hashes."""
    if not database_version.strip():
        raise ValueError("the database version must be given")
    rows = read_jsonl(spark, documents).join(numbered_lines(spark, documents).select((F.col("line") + 1).alias("line"), F.rtrim(F.col("text"), F.lit("\r")).alias("text")), "line")
    columns = ["material_id", "composition", "theoretical", "source_ids", "normalization_issue"]
    with new_directory(path) as root:
        _, table = write_texts(rows, root, "records.tsv", ["material_id"], columns)["records.tsv"]
        n, raw = write_texts(rows, root, "records.jsonl", ["material_id"], ["text"], header=False)["records.jsonl"]
        if not n:
            raise InvalidRecords("a snapshot has at least one record")
        metadata = {"schema_version": 2, "database_version": database_version, "is_synthetic": True, "redistribution_status": "synthetic fixture", "record_count": n, "records_sha256": raw, "table_sha256": table}
        write_toml(metadata, root / "snapshot.toml")
    return metadata


def write_json(values, path: str | Path) -> None:
    """A small report as JSON, keys in order."""
    with open(path, "x") as to:
        json.dump(values, to, indent=2, sort_keys=True)
        to.write("\n")


def write_report(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], path: str, config: Mapping) -> None:
    """Named result tables, each with the columns that order it, as TSV in a new directory, with config.toml holding the hash of each file."""
    with new_directory(path) as root:
        files = {}
        for name, (df, order) in tables.items():
            files |= write_texts(df, root, f"{name}.tsv", order)
        write_toml({**config, "files": {k: digest for k, (_, digest) in files.items()}}, root / "config.toml")
