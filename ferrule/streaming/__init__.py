"""Score tables that arrive as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.query import validated


def sorted_out(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows with formula columns, and faulty ones with their category: both stateless, so a stream needs no watermark for them."""
    rows = validated(stream)
    return rows.where("error IS NULL").drop("error", "formula_error"), rows.where("error IS NOT NULL").select(*stream.columns, "error")
