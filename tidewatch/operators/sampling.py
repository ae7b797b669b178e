"""Dedup, concatenation, reproducible samples and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = 16**8


def first_per_uid(df: DataFrame, order: list[str]) -> DataFrame:
    """The first row per uid in ``order``. A min over the row, not a window: copies of one uid are
    reduced in every task before the shuffle."""
    columns = [c for c in df.columns if c != "uid"]
    simple = [f.name for f in df.schema.fields if f.name in columns and f.dataType.typeName() not in ("map", "variant")]
    # ties in ``order`` are settled by the remaining comparable columns
    rank = F.struct(*order, *[c for c in simple if c not in order])
    kept = df.groupBy("uid").agg(F.min_by(F.struct(*columns), rank).alias("_row"))
    return kept.select("uid", *[F.col(f"_row.{c}").alias(c) for c in columns]).select(*df.columns)


def concatenate(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def unit_hash(key: Column, seed: int) -> Column:
    """Key and seed as a number in [0, 1): the same on every run, partitioning and engine."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(_SCALE))


def sample_fraction(df: DataFrame, fraction: float, seed: int, key: str = "uid") -> DataFrame:
    """About ``fraction`` of the keys, chosen by hash: a filter, no shuffle and no sorting."""
    return df.filter(unit_hash(F.col(key), seed) < F.lit(float(fraction)))


def train_test_split(
    df: DataFrame, test_fraction: float, seed: int, key: str = "uid"
) -> tuple[DataFrame, DataFrame]:
    """Split by hash of the key: every label of a row goes with it, and reruns agree."""
    u = unit_hash(F.col(key), seed)
    return df.filter(u >= test_fraction), df.filter(u < test_fraction)


def split_by_block(df: DataFrame, position: Column, block: int, fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Split of an ordered sequence by whole blocks of positions: overlapping windows of one block
    stay on one side."""
    u = unit_hash(F.floor(position / block), seed)
    return df.filter(u >= fraction), df.filter(u < fraction)
