"""Column expressions and small table checks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_linear(neglog: Column, scale: float = 1.0) -> Column:
    """10^-x, times a unit factor (1e6 for micro units)."""
    return F.pow(F.lit(10.0), -neglog) * F.lit(float(scale))


def to_neglog(linear: Column) -> Column:
    return -F.log10(linear)


def orders_between(lo: Column, hi: Column) -> Column:
    return F.log10(hi / lo)


def clip(col: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a column; null stays null."""
    out = col
    if lo is not None:
        out = F.when(out < lo, F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > hi, F.lit(hi)).otherwise(out)
    return out


def finite(col: Column, fill: float | None = None) -> Column:
    """NaN and infinities become null, or the fill value."""
    ok = F.when(~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), col)
    return ok if fill is None else F.coalesce(ok, F.lit(float(fill)))


def clean_numeric(df: DataFrame, cols: Sequence[str], fill: float | None = None) -> DataFrame:
    """Numeric columns with null instead of NaN, infinities and unreadable text."""
    out = df
    for c in cols:
        kind = df.schema[c].dataType
        if isinstance(kind, T.ArrayType):
            out = out.withColumn(c, F.transform(F.col(c).cast("array<double>"), lambda v: finite(v, fill)))
        else:
            num = F.col(c).try_cast("double") if isinstance(kind, T.StringType) else F.col(c).cast("double")
            out = out.withColumn(c, finite(num, fill))
    return out


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The table itself, or an error that names the first missing column and counts them."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{len(missing)} of {len(names)} required columns are missing, starting with {missing[0]}")
    return df
