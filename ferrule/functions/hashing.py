"""Deterministic orderings by domain-separated SHA-256 keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Domains of the hash orderings: fixed values, which the golden keys depend on.
BENCH_RANDOM = "eka-random-v1"
PU_RANDOM = "eka-pu-random-v1"
PU_TIE = "eka-pu-tie-v1"
SPLIT = "eka-pu-split-v1"
SYSTEM_SPLIT = "eka-pu-system-split-v2"
FACTORS = "eka-element-pair-symnmf-v1"

TIE_SEED = 20260901
RANKING_SEED = 10_000


def key(domain: str, seed: Column | int, value: Column) -> Column:
    """Lower-case hex of SHA-256 over domain, seed and value, one a line."""
    seed = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.sha2(F.concat(F.lit(domain), F.lit("\n"), seed, F.lit("\n"), value), 256)


def uniform(hexed: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a key."""
    return F.conv(F.substring(hexed, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
