"""Reading and writing the tables the other operators work on."""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.core import _ensure_checkpoint_dir

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core on a table that came in fewer scan partitions than there are cores.

    A large table has far more partitions than that and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared scratch folder of the session."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- records
def strip_records(df: DataFrame) -> DataFrame:
    """Trim column names and string values."""
    df = df.toDF(*[c.strip() for c in df.columns])
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c) if c in text else F.col(f"`{c}`") for c in df.columns])


def read_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Raw records from Parquet or CSV (with an explicit schema), names and strings stripped."""
    if path.rstrip("/").endswith(".csv"):
        df = spark.read.csv(path, header=True, schema=schema)
    else:
        df = spark.read.parquet(path)
    return strip_records(df)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True, multiLine=True, escape='"') if fmt == "csv" else reader.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> str:
    if fmt == "csv":
        df.write.mode("overwrite").csv(path, header=True, escape='"')
    else:
        df.write.mode("overwrite").format(fmt).save(path)
    return path


def load_light(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the needed columns; the Parquet reader skips the others."""
    return spark.read.parquet(path).select(*columns)


# ---------------------------------------------------------------- reports
def write_report(df: DataFrame, path: str) -> str:
    """Nested rows as JSON lines; the commit protocol makes the new files visible as a whole."""
    df.write.mode("overwrite").json(path)
    return path


def read_report(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


# ---------------------------------------------------------------- representations
def write_reps(df: DataFrame, path: str) -> str:
    """(rep, id, features) as Parquet, one folder per representation."""
    df.write.mode("overwrite").partitionBy("rep").parquet(path)
    return path


def load_reps(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Only the folders of the named representations are read."""
    return spark.read.parquet(path).where(F.col("rep").isin(*names))


def to_long_features(df: DataFrame, ident: str = "id", vec: str = "features") -> DataFrame:
    return df.select(F.col(ident).alias("id"), F.posexplode(vec).alias("pos", "value"))


def to_wide_features(df: DataFrame) -> DataFrame:
    """(id, features) from (id, pos, value); the values of one entity form one row."""
    packed = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return df.groupBy("id").agg(F.transform(packed, lambda s: s["value"]).alias("features"))


def concat_reps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Features of both tables side by side."""
    return a.join(b.select("id", F.col("features").alias("_b")), "id").select(
        "id", F.concat("features", "_b").alias("features")
    )


# ---------------------------------------------------------------- partitions and predictions
def partitions_to_long(df: DataFrame) -> DataFrame:
    """(split, id, role) from (split, train_idx, test_idx)."""
    sides = [
        df.select("split", F.explode(f"{role}_idx").alias("id"), F.lit(role).alias("role")) for role in ("train", "test")
    ]
    return sides[0].unionByName(sides[1])


def predictions_to_long(df: DataFrame) -> DataFrame:
    """(split, model, id, role, y, pred) from aligned vectors.

    Per split and model: train_idx, y_train and out-of-fold ``oof``; test_idx, y_test and ``test``.
    """
    def side(role: str, pred: str) -> DataFrame:
        z = F.arrays_zip(F.col(f"{role}_idx").alias("id"), F.col(f"y_{role}").alias("y"), F.col(pred).alias("pred"))
        return df.select("split", "model", F.lit(role).alias("role"), F.inline(z)).select(
            "split", "model", "id", "role", "y", "pred"
        )

    return side("train", "oof").unionByName(side("test", "test"))


# ---------------------------------------------------------------- queries and scores
def query_field(line: Column) -> Column:
    """First whitespace-separated field of a line; null for blank lines and comments."""
    body = F.regexp_replace(line, r"^\s+", "")
    first = F.split(body, r"\s+", 2)[0]
    return F.when((body != "") & ~line.startswith("#"), first)


def read_queries(spark: SparkSession, path: str, extra: Sequence[str] = ()) -> DataFrame:
    """(query) from a line-oriented file plus an inline list; blank lines and # comments are skipped."""
    lines = spark.read.text(path).select(query_field(F.col("value")).alias("query")).where("query is not null")
    if extra:
        lines = spark.createDataFrame([(q,) for q in extra], "query string").unionByName(lines)
    return lines


def rounded_scores(df: DataFrame, digits: int = 3) -> DataFrame:
    """All doubles rounded half-even."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*[
        F.bround(F.col(c), digits).alias(c) if isinstance(kinds[c], T.DoubleType) else F.col(c) for c in df.columns
    ])


def write_scores(df: DataFrame, path: str, digits: int = 3) -> str:
    return write_table(rounded_scores(df, digits), path)
