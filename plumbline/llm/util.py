"""Helpers the operators of this package share: text patterns, stored tables and hot-key-safe look-ups.

A key may hold a third of all rows. ``lookup`` and ``with_group`` therefore never bring the rows of a
key together: the rows of a key are dealt over ``SALTS`` sub-keys, only one small row per (key, sub-key)
meets the key's value, and the rows then fetch it from their own sub-key.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.tables import scratch_path

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SALTS = 256
FILTER_BITS = 29  # a bitmap has at most two to this many bits, 64 MB


def whole_text(text: Column | str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def stored(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: lineage ends, lost executors do no harm.

    Rows of megabytes need few ``rows_per_file``: all rows of a file are in memory at once when it is written, and when it is read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salt(*cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], by: Column, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``table`` (one row per key, keys not null), however many rows share a key.

    ``by`` is a deterministic expression that differs between the rows of a key.
    """
    salted = rows.withColumn("_salt", by)
    here = salted.select(*keys, "_salt").distinct().join(table, list(keys))
    return salted.join(here, [*keys, "_salt"], how).drop("_salt")


def with_group(rows: DataFrame, keys: Sequence[str], by: Column, **merges: tuple[Column, str]) -> DataFrame:
    """Attach group values to every row of its group: ``name=(expression, 'sum'|'min'|'max')``.

    The expression is evaluated per row; sums, minima and maxima are taken per (key, sub-key) and then
    per key, so neither step gathers the rows of a hot key.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    salted = rows.withColumn("_salt", by)
    small = salted.groupBy(*keys, "_salt").agg(*[fold[how](e).alias(n) for n, (e, how) in merges.items()])
    whole = small.groupBy(*keys).agg(*[fold[how](n).alias(n) for n, (_, how) in merges.items()])
    here = small.select(*keys, "_salt").join(whole, list(keys))
    return salted.join(here, [*keys, "_salt"]).drop("_salt")


def bitmap(hashes: DataFrame, column: str) -> tuple[Broadcast, int]:
    """Bits of the 64-bit hashes in ``column`` for ``holds``, sent to all executors, and the logarithm of their number.

    The bitmap has two bits per hash and some sixteen places for each, up to ``FILTER_BITS``; a fuller one lets
    more others pass and misses none, so what follows must still join on the hash.
    """
    width = min(max((16 * hashes.count()).bit_length(), 10), FILTER_BITS)
    h, mask = F.col(column), F.lit((1 << width) - 1)
    places = hashes.select(F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS INT)))").alias("bits")).toArrow()
    bits = np.zeros(1 << (width - 6), np.uint64)
    bits[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(bits), width


def holds(sent: Broadcast, width: int, v: np.ndarray) -> np.ndarray:
    """True for every hash (unsigned) of the bitmap and for few others."""
    bits, hit = sent.value, np.ones(len(v), bool)
    for p in (v, v >> np.uint64(32)):
        p = p & np.uint64((1 << width) - 1)
        hit &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def hash_filter(hashes: DataFrame, column: str) -> Callable[[Column | str], Column]:
    """A predicate that is true for every 64-bit hash in ``column`` and for few others, see ``bitmap``."""
    sent = bitmap(hashes, column)

    @F.pandas_udf("boolean")
    def may_hold(x: pd.Series) -> pd.Series:
        return pd.Series(holds(*sent, x.to_numpy().view(np.uint64)))

    return may_hold
