"""Number handling: missing, zero, non-finite and rounding rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

# Fixed value: largest finite 32-bit float, the clipping range of training features.
FLOAT32_MAX = 3.4028234663852886e38


def field(df: DataFrame, name: str, data_type: str) -> Column:
    """The column when the input carries it, else a typed NULL: an absent log field is a missing one."""
    return F.col(name) if name in df.columns else F.lit(None).cast(data_type)


def _not_finite(v: Column) -> Column:
    return F.isnan(v) | (F.abs(v) == F.lit(float("inf")))


def finite(c: Column, default: float = 0.0) -> Column:
    """Parse as double; text that is no number, NULL, NaN and infinities become ``default``."""
    v = c.try_cast("double")
    # a difference with itself is 0 for finite numbers only
    return F.when(v - v == 0, v).otherwise(F.lit(default))


def finite_field(df: DataFrame, *names: str) -> Column:
    """``finite`` of a field, or of the first of two that is not zero. Whole-number fields need no
    test for infinities, which keeps the generated code small enough to be compiled."""
    types = [df.schema[n].dataType for n in names if n in df.columns]
    whole = all(isinstance(t, IntegralType) for t in types)
    columns = [field(df, n, "bigint") for n in names]
    value = columns[0] if len(columns) == 1 else nonzero_or(columns[0], columns[1])
    return F.coalesce(value.cast("double"), F.lit(0.0)) if whole else finite(value)


def nonzero_or(first: Column, second: Column) -> Column:
    """``first`` unless it is NULL or zero, else ``second``: zero counts as not reported."""
    return F.when(first.isNotNull() & (first != 0), first).otherwise(second)


def present(c: Column) -> Column:
    """Text that says something; NULL for the empty string."""
    return F.when(c != "", c)


def reported(c: Column) -> Column:
    """Text field of a log: '-' and the empty string both mean missing."""
    return F.when((c != "") & (c != "-"), c)


def clean_feature(c: Column) -> Column:
    """Training value: missing and non-finite to 0, the rest clipped to the 32-bit float range."""
    v = c.try_cast("double")
    clipped = F.greatest(F.lit(-FLOAT32_MAX), F.least(F.lit(FLOAT32_MAX), v))
    return F.when(v.isNull() | _not_finite(v), F.lit(0.0)).otherwise(clipped)


def truncated_score(fused: Column) -> Column:
    """A 0..1 value as an integer 0..100, truncating."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), fused * 100)).cast("int")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 with microseconds as fraction; missing stays missing."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def round3(c: Column) -> Column:
    return F.bround(c, 3)
