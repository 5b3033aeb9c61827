"""Snapshot documents, one JSON object a line, normalised with JSON's own types kept apart."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elements import SYMBOLS
from ..operators.query import InvalidRecords
from .lines import numbered_lines

SCHEMA = "line long, material_id string, composition string, theoretical string, source_ids string, normalization_issue string, fault string"
ID = re.compile(r"mp-(?:[0-9]+|[a-z]+)", re.ASCII)
LARGEST = (1 << 63) - 1


def formula_of(counts) -> tuple[str, str]:
    """Text and issue ('.': none) of a JSON map of counts; the first faulty symbol in order decides, and nothing is reduced."""
    if not isinstance(counts, dict) or not counts:
        return ".", "missing_composition"
    out = []
    for symbol in sorted(counts):
        n = counts[symbol]
        if symbol not in SYMBOLS:
            return ".", "unsupported_species"
        if isinstance(n, bool) or not isinstance(n, (int, Decimal)) or (isinstance(n, Decimal) and not n.is_finite()) or n <= 0:
            return ".", "invalid_counts"
        if n != int(n):
            return ".", "fractional_counts"
        if n > LARGEST:
            return ".", "count_overflow"
        out.append(f"{symbol}{int(n)}")
    return "".join(out), "."


def normalised(text: str) -> tuple[str | None, ...]:
    """material_id, composition, theoretical, source_ids, normalization_issue and fault of one line."""
    none = (None,) * 5
    try:
        doc = json.loads(text, parse_float=Decimal, parse_constant=lambda c: Decimal(c))
    except ValueError:
        return *none, "blank line" if not text.strip() else "invalid JSON"
    if not isinstance(doc, dict):
        return *none, "not an object"
    name, flag, ids = doc.get("material_id"), doc.get("theoretical"), doc.get("database_IDs")
    if not isinstance(name, str) or not ID.fullmatch(name):
        return *none, "invalid material_id"
    if flag is not None and not isinstance(flag, bool):
        return *none, "invalid theoretical flag"
    if ids is not None and (not isinstance(ids, dict) or any(not isinstance(v, list) or any(not isinstance(x, str) for x in v) for v in ids.values())):
        return *none, "invalid database_IDs"
    sources = sorted({f"{k}:{x}" for k, v in (ids or {}).items() for x in v})
    if any(re.search(r"[\t\r\n]", s) for s in sources):
        return *none, "invalid database_IDs"
    composition, issue = formula_of(doc.get("composition"))
    return name, composition, "unknown" if flag is None else str(flag).lower(), ";".join(sources) or ".", issue, None


def read_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Normalised records with their line's number; with strict any faulty line or repeated id raises."""
    lines = numbered_lines(spark, path)

    def run(frames):
        for frame in frames:
            rows = [(n + 1, *normalised(t)) for n, t in zip(frame["line"], frame["text"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    rows = lines.mapInPandas(run, SCHEMA)
    if strict:
        bad = rows.where("fault IS NOT NULL").orderBy("line").first()
        if bad:
            raise InvalidRecords(f"line {bad['line']}: {bad['fault']}")
        twice = rows.groupBy("material_id").count().where("count > 1").first()
        if twice:
            raise InvalidRecords(f"duplicate material_id: {twice['material_id']}")
        return rows.drop("fault")
    return rows
