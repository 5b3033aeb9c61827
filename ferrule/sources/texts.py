"""Tables as text files with exact bytes, written by tasks.

Rows are dealt by ranges of (file, order), and each task writes its stretch of every file it meets to a part of its
own. Then one task a file strings the parts together under the header and hashes what it writes. The driver sees the
names of parts, counts and hashes, and no row. The folder must be one that executors and the driver share.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections import defaultdict
from collections.abc import Sequence
from itertools import groupby
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are copied at once.
PIECE = 1 << 20
PARTS = pa.schema([("file", pa.string()), ("part", pa.int32()), ("path", pa.string()), ("n", pa.int64())])


def cell(value) -> str:
    """Text of one value: blank for null, true or false, shortest text that reads back for floats."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return ";".join(map(cell, value))
    text = repr(value) if isinstance(value, float) else str(value)
    if any(c in text for c in "\t\r\n"):
        raise ValueError(f"cell with a tab or line end: {text!r}")
    return text


def line(row: Sequence, sep: str = "\t") -> str:
    cells = list(map(cell, row))
    if sep != "\t" and any(sep in c for c in cells):
        raise ValueError(f"cell with a {sep}: {cells}")
    return sep.join(cells) + "\n"


def write_texts(df: DataFrame, root: str | Path, file: str | Column, order: Sequence[str], columns: Sequence[str] | None = None, files: Sequence[str] = (), header: bool = True, sep: str = "\t") -> dict[str, tuple[int, str]]:
    """Write rows below ``root`` in files named by ``file``, in the given order; returns each file's rows and SHA-256.

    ``file`` is a relative path or a column of them, and ``files`` names those that must be there even without rows.
    Without a header the one column is text that is written as it is, a line each. Existing files are not replaced.
    """
    columns = list(columns or df.columns)
    if not header and len(columns) != 1:
        raise ValueError("text without a header is one column")
    root, fixed = Path(root).absolute(), isinstance(file, str)
    staging = root / f".parts-{uuid.uuid4().hex}"
    staging.mkdir(parents=True)
    keys = [f"__order{n}" for n in range(len(order))]
    rows = df.select((F.lit(file) if fixed else file).alias("__file"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)], *columns)
    dealt = rows.repartitionByRange("__file", *keys).sortWithinPartitions("__file", *keys).select("__file", *columns)

    def write_parts(batches):
        part, made = TaskContext.get().partitionId(), []
        each = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for name, members in groupby(each, key=lambda r: r[0]):
            path, n = staging / uuid.uuid4().hex, 0
            with open(path, "xb") as to:
                for row in members:
                    to.write((line(row[1:], sep) if header else f"{row[1]}\n").encode())
                    n += 1
            made.append({"file": name, "part": part, "path": str(path), "n": n})
        yield pa.RecordBatch.from_pylist(made, PARTS)

    try:
        parts: dict[str, list] = defaultdict(list)
        for name in {file} if fixed else set(files):
            parts[name] = []
        for r in dealt.mapInArrow(write_parts, "file string, part int, path string, n long").collect():
            parts[r["file"]].append((r["part"], r["path"], r["n"]))
        return _strung(df.sparkSession, root, dict(parts), line(columns, sep) if header else "")
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def _strung(spark: SparkSession, root: Path, parts: dict[str, list], header: str) -> dict[str, tuple[int, str]]:
    def string(batches):
        for batch in batches:
            done = []
            for name, paths in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                target = root / name
                target.parent.mkdir(parents=True, exist_ok=True)
                making = target.parent / f".{target.name}.{uuid.uuid4().hex}"
                digest = hashlib.sha256(header.encode())
                with open(making, "xb") as to:
                    to.write(header.encode())
                    for path in paths:
                        with open(path, "rb") as part:
                            while some := part.read(PIECE):
                                digest.update(some)
                                to.write(some)
                try:
                    os.link(making, target)
                except FileExistsError:  # an attempt before this one may have got as far
                    with open(target, "rb") as there:
                        if hashlib.file_digest(there, "sha256").hexdigest() != digest.hexdigest():
                            raise
                finally:
                    making.unlink()
                done.append({"file": name, "digest": digest.hexdigest()})
            yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("digest", pa.string())]))

    for name in parts:
        if os.path.lexists(root / name):
            raise FileExistsError(root / name)
    rows = [(name, [p for _, p, _ in sorted(found)]) for name, found in sorted(parts.items())]
    if not rows:
        return {}
    table = spark.createDataFrame(rows, "file string, paths array<string>").repartition(len(rows), "file")
    digests = {r["file"]: r["digest"] for r in table.mapInArrow(string, "file string, digest string").collect()}
    return {name: (sum(n for _, _, n in parts[name]), digests[name]) for name in parts}
