"""Reproducible draws: a uniform number is a hash of (seed, row id, draw key)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
SPAN = 4294967296  # 2^32


def draw(seed: int, *keys: Column) -> Column:
    """An integer in [0, 2^32) from the first 8 hex digits of an md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int, *keys: Column) -> Column:
    """A double in [0, 1)."""
    return draw(seed, *keys) / F.lit(float(SPAN))


def draw_sql(seed: int, *keys: str) -> str:
    """The same integer in DuckDB SQL."""
    text = " || '|' || ".join([f"'{seed}'"] + [f"({k})::varchar" for k in keys])
    return f"('0x' || substr(md5({text}), 1, 8))::bigint"


def uniform_sql(seed: int, *keys: str) -> str:
    return f"({draw_sql(seed, *keys)} / 4294967296.0::double)"
