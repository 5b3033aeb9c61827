"""Checks between tables: equality, row-by-row agreement, disjointness, and a written bundle against its groups."""

from __future__ import annotations

import hashlib
import re
import tomllib
from collections.abc import Mapping, Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formula as fm
from ..sources.sinks import verify
from ..sources.tsv import read_tsv
from .numbering import numbered
from .query import InvalidRecords

RECORD = ["material_id", "composition", "theoretical", "source_ids", "normalization_issue"]
METADATA = {"schema_version": int, "database_version": str, "is_synthetic": bool, "redistribution_status": str, "record_count": int, "records_sha256": str}


def require_same(left: DataFrame, right: DataFrame, what: str = "tables") -> None:
    """Equal as multisets of rows, whatever the order of columns."""
    right = right.select(left.columns)
    if left.exceptAll(right).first() or right.exceptAll(left).first():
        raise InvalidRecords(f"{what} differ")


def require_disjoint(left: DataFrame, right: DataFrame, key: str = "composition") -> None:
    found = left.join(right, key, "left_semi").first()
    if found:
        raise InvalidRecords(f"{found[key]} is on both sides")


def signature(text) -> F.Column:
    """The reduced formula without asking whether its symbols are elements; the text itself where it has no syntax or leaves 64 bits."""
    terms = fm.totals(fm.tokens(text))
    fits = text.rlike(fm.SYNTAX) & F.forall(fm.tokens(text), lambda t: t["amount"].isNotNull()) & F.forall(terms, lambda t: t["amount"].isNotNull())
    return F.when(fits, fm.formula(fm.reduced(terms))).otherwise(text)


def require_agreement(table: DataFrame, documents: DataFrame) -> None:
    """Row i of a table (source_row) and line i of its documents (line, from 1) must say the same; formulas of rows without an issue up to reduction."""
    left = table.select(F.col("source_row").alias("at"), F.struct(*RECORD).alias("a"))
    right = documents.select(F.col("line").alias("at"), F.struct(*RECORD).alias("b"))
    equal = reduce(lambda x, y: x & y, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in RECORD if c != "composition"))
    text = F.when(F.col("a.normalization_issue") == ".", signature(F.col("a.composition")).eqNullSafe(signature(F.col("b.composition")))).otherwise(F.col("a.composition").eqNullSafe(F.col("b.composition")))
    odd = left.join(right, "at", "full").where(~F.coalesce(equal & text, F.lit(False))).agg(F.min("at")).first()[0]
    if odd is not None:
        raise InvalidRecords(f"row {odd} of the table differs from its document")


def require_metadata(values: Mapping, count: int | None = None, path: str | None = None) -> None:
    """A snapshot's metadata must have every field with its own type and a 64-digit hash, and fit the given count and file."""
    for name, kind in METADATA.items():
        if name not in values or not isinstance(values[name], kind) or (kind is int and isinstance(values[name], bool)):
            raise InvalidRecords(f"metadata: {name} must be {kind.__name__}")
    if values["schema_version"] not in (1, 2) or values["record_count"] < 0 or not re.fullmatch("[0-9a-f]{64}", values["records_sha256"]):
        raise InvalidRecords("metadata: unknown version, negative count or malformed hash")
    if count is not None and count != values["record_count"]:
        raise InvalidRecords(f"metadata: {values['record_count']} records are named, {count} were read")
    if path is not None:
        with open(path, "rb") as f:
            if hashlib.file_digest(f, "sha256").hexdigest() != values["records_sha256"]:
                raise InvalidRecords("metadata: the records have another hash")


def require_invariant(ranking: DataFrame, keys: Sequence[str] = ("design", "seed", "method")) -> None:
    """Candidates that excluding and unlabelling the mixed groups have in common must have equal scores and stand in the same order under both."""
    keys = list(keys)
    left = ranking.where("policy = 'exclude_mixed'").select(*keys, "composition", F.col("score").alias("a"), "rank")
    right = ranking.where("policy = 'unlabel_mixed'").select(*keys, "composition", F.col("score").alias("b"), F.col("rank").alias("other"))
    both = left.join(right, [*keys, "composition"])
    placed = numbered(numbered(both, [F.asc("rank")], keys, "at"), [F.asc("other")], keys, "other_at")
    odd = placed.where(~F.col("a").eqNullSafe(F.col("b")) | (F.col("at") != F.col("other_at"))).orderBy(*keys, "composition").first()
    if odd:
        raise InvalidRecords(f"{odd['composition']} has another score or place under another policy")


def load_bundle(spark: SparkSession, path: str, split: DataFrame) -> dict:
    """Read a bundle's manifest, compare every file's hash, and compare its members with a split derived anew; returns the manifest."""
    root = Path(path)
    manifest = tomllib.loads((root / "manifest.toml").read_text())
    verify(root, manifest["files"], ["manifest.toml"])
    for (seed,) in sorted(map(tuple, split.select("seed").distinct().collect())):
        mine = split.where(F.col("seed") == seed)
        parts = {"inputs/training": mine.where("role = 'training'"), "inputs/candidates": mine.where("role = 'candidate'"), "evaluation/heldout": mine.where("heldout")}
        label = F.when(F.col("heldout"), "positive").otherwise("unlabelled").alias("label")
        labels = read_tsv(spark, f"{path}/split-{seed:02d}/evaluation/labels.tsv", ["composition", "label"]).select("composition", "label")
        require_same(labels, mine.where("role = 'candidate'").select("composition", label), f"split {seed}, labels")
        for name, rows in parts.items():
            require_same(read_tsv(spark, f"{path}/split-{seed:02d}/{name}.tsv", ["composition"]).select("composition"), rows.select("composition"), f"split {seed}, {name}")
    return manifest
