"""Predictions are made where they are used: no settled table holds a row per document, fold and model."""
import random

from pyspark.sql import functions as F

from plumbline.functions.features import n_types, token_set
from plumbline.operators.metrics import ensemble_mean
from plumbline.plans import fixtures as X


def _documents(spark, folder):
    rng = random.Random(3)
    words = "alpha beta gamma delta the of and 12 x-y".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30))), rng.choice(["en", "de", None]), rng.choice("abcdefgh")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs.withColumn("n_chars", F.length("text").cast("bigint")).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_no_settled_table_holds_a_row_per_fold_and_model(spark, tmp_path):
    sf = _documents(spark, tmp_path / "sf")
    assert X.predictions(spark, sf).count() == 60 * 3 * X.K * len(X.MODELS)
    assert X.cells(spark, sf).count() == 3 * X.K * len(X.MODELS)
    kept = {k[1]: df.count() for k, df in X._memo.items() if k[2] == sf}
    assert kept.pop("fits") < 3 * X.K * (X.K + 1) * (1 + 3 + 8 + 24)
    assert max(kept.values()) <= 3 * 60, kept


def test_group_of_an_id_comes_with_every_held_out_row(spark, tmp_path):
    sf = _documents(spark, tmp_path / "sf")
    want = X.held_out(spark, sf).join(X.entities(spark, sf).select("id", "grp"), "id")
    got = X.held_groups(spark, sf).select(want.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_ensemble_needs_every_member_and_one_aggregation(spark):
    p = spark.createDataFrame([(1, "a", 1.0, 5.0), (1, "a", 1.0, 5.0), (1, "b", 2.0, 5.0), (2, "a", 1.0, 5.0), (2, "a", 3.0, 5.0), (3, "c", 1.0, 5.0)], "id int, model string, pred double, y double")
    out = ensemble_mean(p, spark.createDataFrame([("a",), ("b",)], "model string"), ["id"])
    assert [tuple(r) for r in out.collect()] == [(1, 4 / 3, 2, 5.0)]
    assert out._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2  # partial and final


def test_number_of_types_is_the_size_of_the_token_set(spark):
    d = spark.createDataFrame([("b a  B\n a",), ("",), ("  ",), (None,), (" z",)], "t string")
    assert all(a == b for a, b in d.select(n_types(F.col("t")), F.size(token_set(F.col("t")))).collect())
