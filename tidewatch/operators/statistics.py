"""Column statistics for training: moments, standardising, percentiles, class weights."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.fixed_values import FEATURE_NAMES, NON_FEATURE_COLUMNS
from tidewatch.functions.numeric import clean_feature

_STD_FLOOR = 1e-8


def feature_matrix(training: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Identifiers and labels dropped (unless kept), every remaining feature cleaned."""
    dropped = [c for c in NON_FEATURE_COLUMNS if c not in (keep or [])]
    rest = training.drop(*dropped)
    return rest.select(
        *[clean_feature(F.col(c)).alias(c) if c in FEATURE_NAMES else F.col(c) for c in rest.columns]
    )


def moments(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean and population standard deviation (plus a floor) per column, as rows. One pass, one
    aggregate over the whole vector: dozens of separate ones outgrow what the JVM compiles. A missing
    value counts as 0, as everywhere in training."""
    names = columns or FEATURE_NAMES
    vector = array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names]))
    summary = df.select(vector.alias("_v")).agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")
    )
    n = F.col("s.count").cast("double")
    arrays = summary.select(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance"), n.alias("n")
    )
    rows = arrays.select(F.posexplode("mean").alias("i", "mean"), "variance", "n").withColumn(
        "_sample", F.element_at("variance", F.col("i") + 1)
    )
    return rows.select(
        F.element_at(F.array(*[F.lit(c) for c in names]), F.col("i") + 1).alias("feature"),
        "mean",
        (F.sqrt(F.col("_sample") * (F.col("n") - 1) / F.col("n")) + F.lit(_STD_FLOOR)).alias("std"),
    )


def collect_moments(df: DataFrame, columns: list[str] | None = None) -> dict[str, tuple[float, float]]:
    """``moments`` on the driver: one row per feature."""
    return {r.feature: (r.mean, r.std) for r in moments(df, columns).collect()}


def standardised(df: DataFrame, stats: dict[str, tuple[float, float]], scaler: bool = False) -> DataFrame:
    """(x - mean) / std with non-finite results as 0. ``scaler``: a constant column is divided by 1,
    and the floor is taken off again, which is what a standard scaler does."""

    def scaled(c: str) -> Column:
        mean, std = stats[c]
        if scaler:
            std = std - _STD_FLOOR
            # a spread of rounding noise counts as constant
            std = std if std > 10 * 2.220446049250313e-16 * max(abs(mean), 1.0) else 1.0
        z = (F.col(c) - F.lit(mean)) / F.lit(std)
        return F.when(z.isNull() | F.isnan(z) | (F.abs(z) == float("inf")), 0.0).otherwise(z)

    return df.select(*[scaled(c).alias(c) if c in stats else F.col(c) for c in df.columns])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.agg(F.sum("rows").alias("_all"), F.count(F.lit(1)).alias("_k")).first()
    n, k = int(totals["_all"] or 0), int(totals["_k"] or 0)
    return counts.withColumn("weight", F.lit(float(n)) / (F.lit(float(max(k, 1))) * F.col("rows")))


def label_ids(df: DataFrame, label: str) -> dict[int, str]:
    """Class id -> label in sorted order. Brings the distinct labels to the driver, of which an
    attack taxonomy has dozens; the number is checked."""
    names = [r[0] for r in df.select(label).distinct().limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError(f"{label} has more than 10000 distinct values: not a class label")
    return dict(enumerate(sorted(n for n in names if n is not None)))


def with_label_id(df: DataFrame, label: str, labels: dict[int, str], name: str = "label_id") -> DataFrame:
    entries: list[Column] = []
    for k, v in labels.items():
        entries += [F.lit(v), F.lit(k)]
    return df.withColumn(name, F.create_map(*entries)[F.col(label)])


def exact_percentile(df: DataFrame, column: str, p: float, bins: int = 4096, small: int = 20_000) -> float | None:
    """Linear-interpolated percentile without sorting and without holding the distinct values.

    Each pass counts values per bin of the interval that still contains the wanted rank (combined on
    the map side to at most ``bins`` rows), until that bin holds few distinct values. Store or
    ``materialise`` an expensive input first: it is read once per pass, usually two or three times.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    span = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not span.n:
        return None
    rank = p * (span.n - 1)
    low = math.floor(rank)
    bounds = (float(span.lo), float(span.hi), span.n, bins, small)
    a, b = _order_statistics(values, low, *bounds)
    if low == rank:
        return a
    if b is None:
        b = _order_statistics(values, low + 1, *bounds)[0]
    return a + (b - a) * (rank - low)


def _order_statistics(
    values: DataFrame, k: int, lo: float, hi: float, n: int, bins: int, small: int
) -> tuple[float, float | None]:
    """The k-th smallest value (from 0), and the next one when it turned up in the same last bin."""
    before = 0
    while n > small and hi > lo:
        width = (hi - lo) / bins
        if lo + width == lo:
            break  # a few neighbouring doubles are left
        inside = values.filter((F.col("v") >= lo) & (F.col("v") <= hi))
        slot = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1))
        counts = (
            inside.groupBy(slot.alias("s"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .orderBy("s")
            .collect()
        )
        for row in counts:
            if k < before + row.n:
                lo, hi, n = float(row.lo), float(row.hi), row.n
                break
            before += row.n
    if hi == lo:
        return lo, lo if k + 1 < before + n else None
    distinct = (
        values.filter((F.col("v") >= lo) & (F.col("v") <= hi))
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("v")
        .collect()
    )
    found = None
    for row in distinct:
        before += row.n
        if found is None and k < before:
            found = float(row.v)
        if found is not None and k + 1 < before:
            return found, float(row.v)
    assert found is not None, "rank outside the values"
    return found, None
