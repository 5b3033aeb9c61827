"""An audit of a snapshot as a report: groups, exclusions, the summary as data and as a page, and the snapshot's own metadata."""

from __future__ import annotations

import shutil
import tomllib
from pathlib import Path

from pyspark.sql import SparkSession

from ..operators import audit, verify
from ..sources import jsonl, sinks, tsv
from ..sources.texts import write_texts
from .baseline import file_sha256
from .workspace import Workspace

NOTES = """
A composition is positive if any of its records says that it is not theoretical, unlabelled if all of them say that they are, and
unresolved if a flag is missing and none is positive. Unlabelled ones are not failures. Records that are out of scope or
cannot be read are listed in excluded.tsv with the first reason that holds. The holdout is a fifth of the positive compositions, rounded down.
"""


def run(spark: SparkSession, snapshot: str, output: str, metadata: str | None = None, table: str | None = None) -> dict:
    """Audit JSON lines and write compositions.tsv, excluded.tsv, audit.toml, audit.md and, where given, snapshot.toml; returns the summary.

    Metadata must fit the documents' count and hash, and a table must agree with them row by row.
    """
    documents = jsonl.read_jsonl(spark, snapshot)
    known = {}
    if metadata:
        known = tomllib.loads(Path(metadata).read_text())
        verify.require_metadata(known, documents.count(), snapshot)
    if table:
        verify.require_agreement(tsv.read_tsv(spark, table, verify.RECORD), documents)
    work = Workspace(spark, "audit")
    rows = work.keep(audit.with_reason(documents.drop("line")), "records")
    grouped = work.keep(audit.groups(rows), "groups")
    summary = audit.summary(rows, grouped).first().asDict()
    with sinks.new_directory(output) as root:
        files = {name: digest for name, (_, digest) in (write_texts(audit.as_text(grouped), root, "compositions.tsv", ["composition"]) | write_texts(audit.excluded(rows), root, "excluded.tsv", ["material_id"])).items()}
        head = "# Audit of a snapshot\n\n" + ("**Synthetic records, not measurements.**\n\n" if known.get("is_synthetic") else "")
        lines = [f"| {k.replace('_', ' ')} | {sinks.cell(v)} |" for k, v in summary.items()]
        (root / "audit.md").write_text(head + "| Quantity | Count |\n| --- | --- |\n" + "\n".join(lines) + "\n" + NOTES)
        if metadata:
            shutil.copyfile(metadata, root / "snapshot.toml")
        more = {name: file_sha256(root / name) for name in ("audit.md", *["snapshot.toml"] * bool(metadata))}
        sinks.write_toml({"schema_version": 1, **summary, "files": files | more}, root / "audit.toml")
    return summary
