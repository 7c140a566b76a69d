"""A: aggregations (A12 and A13 are with the partitions, A26 with the pairs)."""
from pyspark.sql import functions as F

from plumbline.operators import audit as A
from plumbline.operators import inference as I
from plumbline.operators import metrics as M
from plumbline.plans import fixtures as X
from plumbline.plans import tails
from plumbline.plans.registry import query
from plumbline.plans.scalars import BIN_CASE, KEYS_SQL
from plumbline.sources import tables as S


@query("a1_provenance", """
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT sum(n)::BIGINT AS n_records, count(*) AS n_sources, max(n) AS max_per_source, min(n) AS min_per_source, round(100.0 * max(n) / sum(n), 6) AS pct_largest,
  count(*) FILTER (n = 1) AS n_single_record, round(100.0 * (SELECT sum(n) FROM (SELECT n FROM s ORDER BY n DESC, source LIMIT 10)) / sum(n), 6) AS pct_top,
  (SELECT count(DISTINCT doc_id) FROM documents) AS n_ids, (SELECT count(DISTINCT text) FROM documents) AS n_texts,
  quantile_cont(n, 0.5)::DOUBLE AS median_per_source, quantile_cont(n, 0.25)::DOUBLE AS q25_per_source, quantile_cont(n, 0.75)::DOUBLE AS q75_per_source FROM s""")
def a1(spark, sf):
    return A.provenance(S.table(spark, sf, "documents"), "source", "doc_id", "text")


@query("a2_value_counts", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 15")
def a2(spark, sf):
    return A.value_counts(S.table(spark, sf, "part"), "p_name", 15)


@query("a3_duplicate_report", "WITH" + KEYS_SQL + """,
lv AS (UNPIVOT (SELECT y, key_raw, key_folded, key_hash, key_block FROM ks) ON key_raw, key_folded, key_hash, key_block INTO NAME level VALUE k),
g AS (SELECT level, k, count(*) AS n, max(y) - min(y) AS spread FROM lv GROUP BY ALL)
SELECT level, count(*) AS n_unique, count(*) FILTER (n > 1) AS n_groups, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS n_records,
  round(coalesce(max(spread) FILTER (n > 1), 0), 6) AS max_spread, count(*) FILTER (n > 1 AND spread > 1) AS n_spread_gt_1,
  round(coalesce(median(spread) FILTER (n > 1), 0), 6) AS median_spread FROM g GROUP BY level""")
def a3(spark, sf):
    docs = S.spread(S.table(spark, sf, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    d = A.norm_keys(docs.withColumn("y", F.log10("n_chars")), "text")
    return A.duplicate_report(d, A.KEY_LEVELS, "y")


@query("a4_endpoint_summary", """
WITH v AS (SELECT log10(l_extendedprice) AS y, power(10.0, -log10(l_extendedprice)) AS x FROM lineitem), m AS (SELECT avg(y) AS my, avg(x) AS mx FROM v)
SELECT count(*) AS n, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS sd, round(min(y), 6) AS min, round(max(y), 6) AS max,
  round(avg(power(y - my, 3)) / power(var_pop(y), 1.5), 6) AS skew, round(avg(power(x - mx, 3)) / power(var_pop(x), 1.5), 6) AS skew_linear,
  round(quantile_cont(y, 0.5), 6) AS median, round(quantile_cont(y, 0.25), 6) AS q25, round(quantile_cont(y, 0.75), 6) AS q75, round(log10(max(x) / min(x)), 6) AS orders_of_magnitude
FROM v, m""")
def a4(spark, sf):
    return A.endpoint_summary(S.table(spark, sf, "lineitem").select(F.log10("l_extendedprice").alias("y")), "y")


@query("a5_category_table", X.WITH_ENT + "," + X.PRIMARY_SQL + """
SELECT cat, count(*) AS n, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test, round(avg(y), 6) AS mean_y,
  round(coalesce(stddev_samp(y), 0), 6) AS sd_y, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y, count(DISTINCT grp) AS n_sources, round(100.0 * count(*) / (SELECT count(*) FROM ent), 6) AS pct
FROM ent JOIN prim USING (id) WHERE split = 'stratified' GROUP BY cat""")
def a5(spark, sf):
    df = X.entities(spark, sf).join(X.primary(spark, sf).where("split = 'stratified'"), "id")
    return A.category_table(df, "cat", "grp")


@query("a6_group_inventory", X.WITH_ENT + """, g AS (SELECT tmpl, count(*) AS n FROM ent GROUP BY tmpl)
SELECT count(*) AS n_groups, count(*) FILTER (n = 1) AS n_singletons, max(n) AS largest, coalesce(max(n) FILTER (tmpl = '<none>'), 0) AS n_special FROM g""")
def a6(spark, sf):
    return A.group_inventory(X.entities(spark, sf), "tmpl", "<none>")


@query("a6_top_groups", X.WITH_ENT + " SELECT tmpl, count(*) AS n FROM ent GROUP BY tmpl ORDER BY n DESC, tmpl LIMIT 10")
def a6b(spark, sf):
    return A.value_counts(X.entities(spark, sf), "tmpl", 10)


@query("a7_anova", """
WITH g AS (SELECT l_returnflag AS c, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * power(m - (SELECT avg(l_extendedprice) FROM lineitem), 2)) AS ssb, sum(n * v) AS ssw FROM g)
SELECT k, n::BIGINT AS n, round(f, 6) AS f, round(eta2, 6) AS eta2, round(""" + tails.f_upper("f", "(k - 1)", "(n - k)") + """, 6) AS p
FROM (SELECT k, n, (ssb / (k - 1)) / (ssw / (n - k)) AS f, ssb / (ssb + ssw) AS eta2 FROM s)""")
def a7(spark, sf):
    return I.anova(S.table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")


@query("a8_regression_metrics", X.WITH_PREDS + f" SELECT part, model, role, count(*) AS n, round({X.R2}, 6) AS r2, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse, round(avg(abs(y - pred)), 6) AS mae FROM preds GROUP BY ALL")
def a8(spark, sf):
    return M.regression_metrics(X.predictions(spark, sf), ["part", "model", "role"])


@query("a8_metrics_large", """
WITH g AS (SELECT l_suppkey, avg(l_extendedprice) AS pred FROM lineitem GROUP BY 1)
SELECT l_returnflag, count(*) AS n, round(1 - sum(power(l_extendedprice - pred, 2)) / (count(*) * var_pop(l_extendedprice)), 6) AS r2,
  round(sqrt(avg(power(l_extendedprice - pred, 2))), 4) AS rmse, round(avg(abs(l_extendedprice - pred)), 4) AS mae FROM lineitem JOIN g USING (l_suppkey) GROUP BY 1""")
def a8l(spark, sf):
    li = S.table(spark, sf, "lineitem").select("l_returnflag", "l_suppkey", F.col("l_extendedprice").alias("y"))
    fit = li.groupBy("l_suppkey").agg(F.avg("y").alias("pred"))
    m = M.regression_metrics(li.join(fit, "l_suppkey"), ["l_returnflag"])
    return m.withColumn("rmse", F.round("rmse", 4)).withColumn("mae", F.round("mae", 4))


@query("a9_classwise_metrics", X.WITH_PREDS + f"""
SELECT design, model, cat, round(avg(p.y), 6) AS mean_y, count(*) AS n, CASE WHEN count(*) >= 6 THEN round({X.R2.replace('y', 'p.y').replace('var_pop(p.y)', 'var_pop(p.y)')}, 6) END AS r2,
  CASE WHEN count(*) >= 3 THEN round(sqrt(avg((p.y - pred) * (p.y - pred))), 6) END AS rmse, CASE WHEN count(*) >= 3 THEN round(avg(abs(p.y - pred)), 6) END AS mae
FROM preds p JOIN ent USING (id) WHERE role = 'test' GROUP BY ALL""")
def a9(spark, sf):
    p = X.held_out(spark, sf).join(X.entities(spark, sf).select("id", "cat"), "id")
    return M.classwise_metrics(p, "cat", ["design", "model"])


@query("a10_binned_metrics", X.WITH_SLICE + f"""
SELECT sim_bin, count(*) AS n, CASE WHEN count(*) > 5 THEN round({X.R2}, 6) END AS r2, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse, round(avg(abs(y - pred)), 6) AS mae
FROM (SELECT *, {BIN_CASE} AS sim_bin FROM slice WHERE role = 'test') GROUP BY sim_bin HAVING count(*) >= 3""")
def a10(spark, sf):
    return M.binned_metrics(X.slice_scores(spark, sf).where("role = 'test'"), "nn_sim")


NULL_SQL = X.WITH_CELLS + """,
nm AS (SELECT part, avg(p.y) FILTER (role = 'train') AS m FROM (SELECT DISTINCT part, id, role, y FROM preds) p GROUP BY part),
nul AS (SELECT part, any_value(m) AS train_mean, sqrt(avg(power(y - m, 2))) AS null_rmse FROM (SELECT DISTINCT part, id, y FROM preds WHERE role = 'test') JOIN nm USING (part) GROUP BY part)"""


@query("a11_null_model", NULL_SQL + " SELECT part, round(train_mean, 6) AS train_mean, round(null_rmse, 6) AS null_rmse FROM nul")
def a11(spark, sf):
    return M.null_model(X.scored(spark, sf), ["part"])


@query("a11_worse_than_null", NULL_SQL + " SELECT part, count(*) AS n_models, count(*) FILTER (test_r2 < 0) AS n_negative, count(*) FILTER (test_rmse > round(null_rmse, 6)) AS n_worse_than_null FROM cells JOIN nul USING (part) GROUP BY part")
def a11b(spark, sf):
    c = X.cells(spark, sf).withColumnsRenamed({"test_r2": "r2", "test_rmse": "rmse"})
    null = M.null_model(X.scored(spark, sf), ["part"]).withColumn("null_rmse", F.round("null_rmse", 6))
    return M.worse_than_null(c, null, ["part"])


SPREAD_SQL = X.WITH_CELLS + """,
sp AS (SELECT part, rep, count(DISTINCT learner) AS n_learners, min(test_r2) AS lo, max(test_r2) AS hi, arg_max(learner, {'a': test_r2, 'b': learner}) AS best_learner,
              round(max(test_r2) - min(test_r2), 6) AS spread FROM cells GROUP BY ALL HAVING count(DISTINCT learner) >= 2)"""


@query("a14_learner_spread", SPREAD_SQL + " SELECT * FROM sp")
def a14(spark, sf):
    return M.learner_spread(X.cells(spark, sf), ["part"], "rep", "learner", "test_r2", 2)


@query("a14_spread_summary", SPREAD_SQL + " SELECT part, round(median(spread), 6) AS median_spread, max(spread) AS widest, arg_max(rep, {'a': spread, 'b': rep}) AS widest_rep FROM sp GROUP BY part")
def a14b(spark, sf):
    sp = M.learner_spread(X.cells(spark, sf), ["part"], "rep", "learner", "test_r2", 2).withColumn("spread", F.round("spread", 6))
    return M.spread_summary(sp, ["part"], "rep")


BEST_SQL = X.WITH_CELLS + ", fb AS (SELECT part, fam, max(test_r2) AS best FROM cells GROUP BY ALL)"


@query("a15_family_best", BEST_SQL + " SELECT * FROM fb")
def a15(spark, sf):
    return M.family_best(X.cells(spark, sf), ["part"], "fam", "test_r2")


@query("a15_family_spread", BEST_SQL + " SELECT part, round(max(best) - min(best), 6) AS family_spread FROM fb GROUP BY part")
def a15b(spark, sf):
    return M.family_spread(M.family_best(X.cells(spark, sf), ["part"], "fam", "test_r2"), ["part"])


@query("a16_pivot_cells", X.WITH_CELLS + """
SELECT part, rep, max(test_r2) FILTER (learner = 'Mean') AS "Mean", max(test_r2) FILTER (learner = 'Shrunk') AS "Shrunk", max(test_r2) FILTER (learner = 'Line') AS "Line" FROM cells GROUP BY ALL""")
def a16(spark, sf):
    return M.pivot_cells(X.cells(spark, sf), ["part", "rep"], "learner", ["Mean", "Shrunk", "Line"], "test_r2")


@query("a17_grid_coverage", X.WITH_CELLS + """
SELECT part, learner, count(DISTINCT rep) AS n_inputs, any_value(n) AS n_reps, count(DISTINCT rep) = any_value(n) AS covers_all
FROM cells JOIN (SELECT part, count(DISTINCT rep) AS n FROM cells GROUP BY part) USING (part) GROUP BY ALL""")
def a17(spark, sf):
    return M.grid_coverage(X.cells(spark, sf), ["part"], "rep", "learner")


@query("a18_ensemble_mean", X.WITH_PREDS + """
SELECT design, id, round(avg(pred), 6) AS pred, count(DISTINCT model) AS n_members, round(any_value(y), 6) AS y FROM preds
WHERE role = 'test' AND model IN ('lang | Mean', 'source | Mean', 'length | Line') GROUP BY ALL""")
def a18(spark, sf):
    members = spark.createDataFrame([("lang | Mean",), ("source | Mean",), ("length | Line",)], "model string")
    return M.ensemble_mean(X.held_out(spark, sf), members, ["design", "id"])


@query("a19_seed_stats", X.WITH_CELLS + """
SELECT design, key, count(*) AS n_seeds, round(avg(test_r2), 6) AS mean, round(coalesce(stddev_samp(test_r2), 0), 6) AS sd, min(test_r2) AS min, max(test_r2) AS max FROM cells GROUP BY ALL""")
def a19(spark, sf):
    return M.seed_stats(X.cells(spark, sf), ["design", "key"], "test_r2")


@query("a20_histogram", """
WITH e AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem),
h AS (SELECT l_returnflag, least(floor((l_extendedprice - a) / ((b - a) / 40)) + 1, 40)::BIGINT AS bin, a, b FROM lineitem, e)
SELECT l_returnflag, bin, count(*) AS n, round(any_value(a + (bin - 1) * ((b - a) / 40)), 6) AS lo, round(any_value(a + bin * ((b - a) / 40)), 6) AS hi FROM h GROUP BY ALL""")
def a20(spark, sf):
    return M.histogram(S.table(spark, sf, "lineitem"), "l_extendedprice", 40, ["l_returnflag"])


@query("a21_box_stats", """
WITH s AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, min(o_totalprice) AS mn, max(o_totalprice) AS mx, quantile_cont(o_totalprice, 0.25) AS q25,
  quantile_cont(o_totalprice, 0.5) AS q50, quantile_cont(o_totalprice, 0.75) AS q75 FROM orders GROUP BY 1)
SELECT o_orderpriority, n, round(m, 6) AS mean, round(mn, 6) AS min, round(mx, 6) AS max, round(q25, 6) AS q25, round(q50, 6) AS median, round(q75, 6) AS q75, row_number() OVER (ORDER BY m, o_orderpriority) AS position FROM s""")
def a21(spark, sf):
    return A.box_stats(S.table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")


@query("a22_matrix_agreement", """
WITH a AS (SELECT vec_id AS id, unnest(embedding::DOUBLE[]) AS va, generate_subscripts(embedding, 1) AS pos FROM embeddings),
b AS (SELECT id, pos, va + 0.05 * (pos % 3) * sqrt(id + 1) / 10 AS vb FROM a WHERE pos <= 48),
j AS (SELECT * FROM a JOIN b USING (id, pos)), r AS (SELECT id, corr(va, vb) AS r FROM j GROUP BY id), c AS (SELECT pos, corr(va, vb) AS r FROM j GROUP BY pos)
SELECT round(median(r), 6) AS median_row_r, round(min(r), 6) AS min_row_r, (SELECT round(avg(r), 6) FROM c) AS mean_col_r, (SELECT round(max(abs(va - vb)), 6) FROM j) AS max_abs_diff FROM r""")
def a22(spark, sf):
    a = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    b = a.select("id", F.transform(F.slice("features", 1, 48), lambda v, i: v + 0.05 * ((i + 1) % 3) * F.sqrt(F.col("id") + 1) / 10).alias("features"))
    return M.matrix_agreement(a, b)


@query("a23_length_stats", X.WITH_ENT + " SELECT cat, round(quantile_cont(x1, 0.5), 6) AS median, round(quantile_cont(x1, 0.99), 6) AS p99, max(x1) AS max_len, count(*) FILTER (x1 >= 512) AS n_at_limit FROM ent GROUP BY cat")
def a23(spark, sf):
    return M.length_stats(X.entities(spark, sf), "x1", 512, ["cat"])


def _sequence(spark, sf):
    """Embeddings as 4 positions of 16 values on 6 layers; the mask leaves out the last position of odd ids."""
    e = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    g = e.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return g.select(
        "id", "layer", "pos", F.when((F.col("pos") == 3) & (F.col("id") % 2 == 1), 0).otherwise(1).alias("mask"),
        F.transform(F.slice("v", F.col("pos") * 16 + 1, F.lit(16)), lambda x: x * (F.col("layer") + 1)).alias("vec"),
    )


POOL_SQL = """WITH s AS (SELECT vec_id AS id, l AS layer, p AS pos, CASE WHEN p = 3 AND vec_id % 2 = 1 THEN 0 ELSE 1 END AS mask,
  unnest(embedding[p * 16 + 1 : p * 16 + 16]::DOUBLE[]) * (l + 1) AS v, unnest(range(0, 16)) AS dim FROM embeddings, range(6) t1(l), range(4) t2(p))
SELECT id, dim, round({agg}, 6) AS value FROM s WHERE {where} GROUP BY id, dim"""
for _how, _agg, _where in (("mean", "avg(v)", "mask = 1 AND layer = 5"), ("first", "any_value(v)", "pos = 0 AND layer = 5"), ("mean_last4", "avg(v)", "mask = 1 AND layer > 1")):

    @query(f"a24_pool_{_how}", POOL_SQL.format(agg=_agg, where=_where))
    def a24(spark, sf, how=_how):
        return M.pool_vectors(_sequence(spark, sf), how).select("id", F.posexplode("features").alias("dim", "value"))


@query("a27_threshold_contrast", X.WITH_SLICE + f"""
SELECT CASE WHEN nn_sim >= 0.15 THEN 'above' ELSE 'below' END AS side, count(*) AS n, round({X.R2}, 6) AS r2, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse, round(avg(abs(y - pred)), 6) AS mae
FROM slice WHERE role = 'test' GROUP BY 1""")
def a27(spark, sf):
    return M.threshold_contrast(X.slice_scores(spark, sf).where("role = 'test'"), "nn_sim", 0.15)


@query("r12_linear_fit", X.WITH_SLICE + " SELECT round(regr_slope(abs(y - pred), nn_sim), 6) AS slope, round(regr_intercept(abs(y - pred), nn_sim), 6) AS intercept, regr_count(abs(y - pred), nn_sim)::BIGINT AS n FROM slice WHERE role = 'test'")
def r12(spark, sf):
    return M.linear_fit(X.slice_scores(spark, sf).where("role = 'test'").withColumn("ae", F.abs(F.col("y") - F.col("pred"))), "nn_sim", "ae")
