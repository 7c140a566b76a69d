"""S: reading and writing."""
from pyspark.sql import functions as F

from plumbline.plans import fixtures as X
from plumbline.plans.registry import query
from plumbline.sources import tables as S


@query("s1_read_records", "SELECT c_custkey, trim(c_name) AS c_name, c_nationkey::BIGINT AS c_nationkey, round(c_acctbal, 6) AS c_acctbal, trim(c_mktsegment) AS c_mktsegment FROM customer")
def s1(spark, sf):
    return S.read_records(spark, f"{sf}/customer.parquet")


@query("s2_csv_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderpriority FROM orders")
def s2(spark, sf):
    df = S.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return S.read_table(spark, S.write_table(df, S.scratch_path(spark, "csv")), df.schema)


@query("s3_report_round_trip", """
SELECT s_nationkey::BIGINT AS n_nationkey, count(*) AS n, round(avg(s_acctbal), 6) AS mean_balance, max(s_name) AS last_name
FROM supplier GROUP BY s_nationkey""")
def s3(spark, sf):
    s = S.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.struct(F.count("*").alias("n"), F.avg("s_acctbal").alias("mean_balance"), F.max("s_name").alias("last_name")).alias("report")
    )
    path = S.write_report(s, S.scratch_path(spark, "report"))
    return S.read_report(spark, path, s.schema).select("n_nationkey", "report.*")


def _reps(spark, sf):
    e = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    lens = S.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.array(F.col("n_chars").cast("float")).alias("features")
    )
    return e.withColumn("rep", F.lit("embedding")).unionByName(lens.withColumn("rep", F.lit("length")))


@query("s4_representation_store", """
SELECT 'embedding' AS rep, vec_id AS id, len(embedding)::BIGINT AS width, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""")
def s4(spark, sf):
    path = S.write_reps(_reps(spark, sf), S.scratch_path(spark, "reps"))
    d = S.load_reps(spark, path, ["embedding"])
    total = F.aggregate(F.col("features").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return d.select("rep", "id", F.size("features").alias("width"), total.alias("total"))


CHUNK = 100


@query("s5_partitions_to_long", X.WITH_ENT + "," + X.PRIMARY_SQL + " SELECT split, id, role FROM prim")
def s5(spark, sf):
    # the compact form: arrays of the ids of each side, at most CHUNK of them in a row
    p = X.primary(spark, sf)
    wide = p.groupBy("split", F.floor(F.col("id") / CHUNK).alias("chunk")).agg(
        *[F.collect_list(F.when(F.col("role") == r, F.col("id"))).alias(f"{r}_idx") for r in ("train", "test")]
    )
    return S.partitions_to_long(wide)


@query("s6_predictions_to_long", X.WITH_PREDS + " SELECT part AS split, model, id, role, round(y, 6) AS y, pred FROM preds")
def s6(spark, sf):
    p = X.predictions(spark, sf)
    sides = []
    for role, pred in (("train", "oof"), ("test", "test")):
        z = F.array_sort(F.collect_list(F.struct("id", "y", "pred")))
        sides.append(p.where(F.col("role") == role).groupBy(
            F.col("part").alias("split"), "model", F.floor(F.col("id") / CHUNK).alias("chunk")
        ).agg(z.alias("z")).select(
            "split", "model", "chunk", F.col("z.id").alias(f"{role}_idx"), F.col("z.y").alias(f"y_{role}"), F.col("z.pred").alias(pred)
        ))
    return S.predictions_to_long(sides[0].join(sides[1], ["split", "model", "chunk"], "full_outer"))


@query("s7_read_queries", r"""
WITH l AS (SELECT unnest(string_split_regex(text, '\r\n|\n|\r')) AS v FROM documents),
f AS (SELECT v, regexp_extract(v, '^[ \t\x0B\f]*([^ \t\x0B\f]+)', 1) AS q FROM l)
SELECT q AS query, count(*) AS n FROM f WHERE q <> '' AND NOT starts_with(v, '#') GROUP BY q""")
def s7(spark, sf):
    path = S.scratch_path(spark, "lines")
    S.table(spark, sf, "documents").select("text").write.text(path)
    return S.read_queries(spark, path).groupBy("query").agg(F.count("*").alias("n"))


@query("s8_write_scores", X.WITH_SLICE + " SELECT id, round_even(pred, 3) AS predicted, round_even(nn_sim, 3) AS similarity FROM slice WHERE role = 'test'")
def s8(spark, sf):
    df = X.slice_scores(spark, sf).where("role = 'test'").select("id", F.col("pred").alias("predicted"), F.col("nn_sim").alias("similarity"))
    return S.read_table(spark, S.write_scores(df, S.scratch_path(spark, "scores")), "id bigint, predicted double, similarity double")


@query("s9_light_load", "SELECT doc_id, lang, n_chars FROM documents")
def s9(spark, sf):
    return S.load_light(spark, f"{sf}/documents.parquet", ["doc_id", "lang", "n_chars"])


@query("s10_long_and_wide_features", """
SELECT vec_id AS id, len(embedding)::BIGINT AS width, round(embedding[1]::DOUBLE, 6) AS v_first, round(embedding[-1]::DOUBLE, 6) AS v_last,
       round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""")
def s10(spark, sf):
    e = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    w = S.to_wide_features(S.to_long_features(e))
    return w.select(
        "id", F.size("features").alias("width"), F.element_at("features", 1).alias("v_first"), F.element_at("features", -1).alias("v_last"),
        F.aggregate("features", F.lit(0.0), lambda a, v: a + v).alias("total"),
    )
