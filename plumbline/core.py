"""Shared pieces: session, scratch folder, hashed draws, rounding and distributed ranking.

Ranking is the one thing Spark's window functions do not spread out by themselves: a window with
no partition key, or with a key that holds a third of the table, runs in a single task. The
functions here sort by range instead, number the rows inside each range, and add per-range
offsets, so a hot key or a hot value is cut into as many tasks as its size asks for.
"""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def session(name: str = "plumbline", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="plumbline-ckpt-")
    sc.setCheckpointDir(named)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder; survives the loss of executors."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """Like ``settle`` for a table of long rows: compressed, as Parquet in the checkpoint folder."""
    _ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- hashing and rounding
def md5_number(text: Column, digits: int = 8) -> Column:
    """First hex digits of an md5 as a non-negative long (8 digits = 32 bits, at most 15)."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def draw(n: Column | int, seed: int | Column, *parts: Column) -> Column:
    """Reproducible integer in [0, n) from a seed and any key columns."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    key = F.concat_ws(":", seed.cast("string"), *[p.cast("string") for p in parts])
    return md5_number(key) % (n if isinstance(n, Column) else F.lit(n))


def hash_key(seed: int | Column, ident: Column) -> Column:
    """Seeded pseudo-random sort key of an id."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed.cast("string"), ident.cast("string")))


def r6(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def half_even(c: Column) -> Column:
    """Nearest integer, halves to even."""
    return F.rint(c).cast("bigint")


# ---------------------------------------------------------------- distributed ranking
def _asc(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o).asc() if isinstance(o, str) else o for o in order]


def _positioned(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    cols = [F.col(k).asc() for k in keys] + _asc(order)
    placed = (
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    # Both uses of the positions below must see one and the same set of range bounds.
    return (
        settle(placed)
        .withColumn("_part", F.shiftright("_pos", _ROW_BITS).cast("int"))
        .withColumn("_loc", F.col("_pos").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_pos")
    )


def _join_null_safe(rows: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-range values to the rows of their range; keys may be null."""
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    offsets = offsets.withColumnRenamed("_part", "_p").withColumnsRenamed(names)
    on = F.col("_part") == F.col("_p")
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return rows.join(offsets, on).drop("_p", *names.values())


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str = "rn") -> DataFrame:
    """Exact ``row_number() over (partition by keys order by order)``, spread over range partitions.

    ``order`` should end in a unique column, which also lets a run of equal values be cut up.
    """
    rows = _positioned(df, keys, order)
    per_part = rows.groupBy("_part", *keys).agg(F.min("_loc").alias("_first"), F.count("*").alias("_tot"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumn("_off", F.coalesce(F.sum("_tot").over(before), F.lit(0))).drop("_tot")
    joined = _join_null_safe(rows, offsets, keys)
    return joined.withColumn(
        out, (F.col("_loc") - F.col("_first") + F.col("_off") + 1).cast("bigint")
    ).drop("_part", "_loc", "_first", "_off")


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], weight: str, out: str
) -> DataFrame:
    """Exact inclusive running sum of ``weight`` in the given order, spread over range partitions."""
    return running_totals(df, keys, order, {weight: out})


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], weights: dict[str, str]
) -> DataFrame:
    """Several running sums over one sort: ``weights`` maps weight columns to result columns."""
    rows = _positioned(df, keys, order)
    tot = rows.groupBy("_part", *keys).agg(*[F.sum(w).alias(f"_t_{o}") for w, o in weights.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tot.select(
        "_part", *keys, *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in weights.values()]
    )
    local = Window.partitionBy("_part", *keys).orderBy("_loc").rowsBetween(Window.unboundedPreceding, 0)
    for w, o in weights.items():
        rows = rows.withColumn(o, F.sum(w).over(local))
    joined = _join_null_safe(rows, offsets, keys)
    for o in weights.values():
        joined = joined.withColumn(o, F.col(o) + F.col(f"_o_{o}"))
    return joined.drop("_part", "_loc", *[f"_o_{o}" for o in weights.values()])


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per (keys, value): ``cnt``, ``below`` (rows with a smaller value) and ``midrank``.

    Equal values are counted before anything is sorted, so ties cost nothing.
    """
    cnt = F.count("*") if weight is None else F.sum(weight)
    vc = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(cnt.alias("cnt"))
    cum = running_total(vc, keys, [value], "cnt", "_upto")
    return cum.select(
        *keys,
        value,
        "cnt",
        (F.col("_upto") - F.col("cnt")).alias("below"),
        (F.col("_upto") - F.col("cnt") + (F.col("cnt") + 1) / 2.0).alias("midrank"),
    )


def with_totals(left: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach per-key totals; without keys the totals are one row and come in as scalars."""
    if keys:
        return left.join(totals, list(keys))
    return left.select("*", *[totals.select(c).scalar().alias(c) for c in totals.columns])
