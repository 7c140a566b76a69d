"""Claims over result tables and the bookkeeping of stored results."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ranking import merge_cells


def claim(name: str, table: DataFrame, holds: Column, detail: Column) -> DataFrame:
    """One row (name, ok, detail): ``holds`` and ``detail`` aggregate the table; a null verdict fails."""
    return table.agg(holds.alias("ok"), detail.cast("string").alias("detail")).select(
        F.lit(name).alias("name"), F.coalesce("ok", F.lit(False)).alias("ok"), "detail"
    )


def run_claims(claims: Sequence[DataFrame]) -> DataFrame:
    """(name, ok, verdict, detail) of all claims."""
    out = None
    for c in claims:
        out = c if out is None else out.unionByName(c)
    return out.withColumn("verdict", F.when(F.col("ok"), F.lit("HOLDS")).otherwise(F.lit("FAILS")))


def failures(results: DataFrame) -> DataFrame:
    return results.where(~F.col("ok"))


def spans_zero(lo: Column, hi: Column) -> Column:
    return (lo <= 0) & (hi >= 0)


def pending(work: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Work that has no stored result yet."""
    return work.join(done, list(on), "left_anti")


def missing_inputs(expected: DataFrame, present: DataFrame, on: str = "name") -> DataFrame:
    """Expected outputs (name, producer) that are not there."""
    return expected.join(present, on, "left_anti")


def value_changes(old: DataFrame, new: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """(name, old, new, change): values that appeared, went away or differ."""
    a = old.select(name, F.col(value).alias("old"), F.lit(True).alias("_o"))
    b = new.select(name, F.col(value).alias("new"), F.lit(True).alias("_n"))
    j = a.join(b, name, "full_outer")
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("changed")
    return j.where(~(F.col("old").eqNullSafe(F.col("new")) & F.col("_o").isNotNull() & F.col("_n").isNotNull())).select(
        name, "old", "new", kind.alias("change")
    )


def merge_done(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored results with new ones added, a new row replacing the stored row of its key."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    return merge_cells(both, key, "_seq").drop("_seq")
