"""L: selection and stability."""
from pyspark.sql import functions as F

from plumbline.operators import selection as L
from plumbline.plans import fixtures as X
from plumbline.plans.inference import PAIRS_SQL, ROWS_SQL, WILCOXON_SQL, contrast_pairs, row_scores
from plumbline.plans.registry import query

REP_SQL = X.WITH_CELLS + """,
q AS (SELECT part, fam, key AS selected, q2, "inner", test_r2 AS own_r2 FROM cells QUALIFY row_number() OVER (PARTITION BY part, fam ORDER BY q2 DESC, key) = 1),
iq AS (SELECT part, fam, key AS selected_by_inner FROM cells QUALIFY row_number() OVER (PARTITION BY part, fam ORDER BY "inner" DESC, key) = 1),
tq AS (SELECT part, fam, key AS selected_by_test, test_r2 AS test_selected_r2 FROM cells QUALIFY row_number() OVER (PARTITION BY part, fam ORDER BY test_r2 DESC, key) = 1),
nq AS (SELECT part, fam, count(*) AS n_candidates FROM cells GROUP BY ALL),
reps AS (SELECT *, selected = selected_by_inner AS same_under_both, selected <> selected_by_test AS selection_changed, round(test_selected_r2 - own_r2, 6) AS optimism,
  row_number() OVER (PARTITION BY part ORDER BY own_r2 DESC, fam) AS rank FROM q JOIN iq USING (part, fam) JOIN tq USING (part, fam) JOIN nq USING (part, fam))"""


def reps(spark, sf):
    return L.select_representatives(X.cells(spark, sf), ["part"])


@query("l1_select_representatives", REP_SQL + " SELECT * FROM reps")
def l1(spark, sf):
    return reps(spark, sf)


@query("l1_selection_summary", REP_SQL + " SELECT count(*) AS n_combinations, count(*) FILTER (selection_changed) AS n_changed, count(*) FILTER (same_under_both) AS n_agree, max(optimism) AS max_optimism FROM reps")
def l1s(spark, sf):
    return L.selection_summary(reps(spark, sf))


@query("l2_contrasts", ROWS_SQL + "," + WILCOXON_SQL.split("WITH", 1)[1].split(", cen AS (SELECT design, avg(y) AS c FROM held GROUP BY design),", 1)[1] + f""",
pt AS (SELECT design, model, {X.R2} AS r2 FROM held GROUP BY ALL)
SELECT ws.design, ws.model_a, ws.model_b, round(x.r2 - z.r2, 6) AS delta_r2, delta_lo, delta_hi, p_boot, least(w_plus, w_minus)::DOUBLE AS wilcoxon_w FROM ws
JOIN pt x ON x.design = ws.design AND x.model = model_a JOIN pt z ON z.design = ws.design AND z.model = model_b
JOIN (SELECT design, model_a, model_b, round(quantile_cont(d, 0.025), 6) AS delta_lo, round(quantile_cont(d, 0.975), 6) AS delta_hi, round(least(1.0, 2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT))), 6)::DOUBLE AS p_boot
  FROM (SELECT a.design, model_a, model_b, a.r2 - b.r2 AS d FROM br a JOIN cp ON a.model = model_a JOIN br b ON b.model = model_b AND b.design = a.design AND b.b = a.b) GROUP BY ALL) u
  ON u.design = ws.design AND u.model_a = ws.model_a AND u.model_b = ws.model_b""")
def l2(spark, sf):
    return L.contrasts(X.held_out(spark, sf), row_scores(spark, sf), contrast_pairs(spark), ["design"]).drop("wilcoxon_p")


@query("l3_retention", REP_SQL + """ SELECT a.part, a.fam, CASE WHEN b.own_r2 <> 0 THEN round(100.0 * a.own_r2 / b.own_r2, 6) END AS retention_pct FROM reps a JOIN reps b ON b.part = 'stratified_f00' AND b.fam = a.fam WHERE a.part <> 'stratified_f00'""")
def l3(spark, sf):
    return L.retention(reps(spark, sf), "part", "stratified_f00")


# The cell that stands for each family under the fixed rule.
FIXED = {"Cat": "lang | Mean", "Src": "source | Mean", "Desc": "loglength | Line", "Hyb": "lang+source | Mean"}


def chosen(spark, sf):
    c = X.cells(spark, sf)
    fixed = spark.createDataFrame(list(FIXED.items()), "fam string, key string")
    return L.nested_selection(c, ["part"]).unionByName(L.fixed_selection(c, fixed).select(*c.columns, "rule"))


NESTED = """ne AS (SELECT part, design, fam, key, test_r2, "inner" FROM cells QUALIFY row_number() OVER (PARTITION BY part, fam ORDER BY "inner" DESC, key) = 1)"""


@query("l4_nested_vs_fixed", X.WITH_CELLS + "," + NESTED + " SELECT fam, count(*) AS n, count(*) FILTER (key = CASE fam " + " ".join(f"WHEN '{f}' THEN '{k}'" for f, k in FIXED.items()) + " END) AS n_same FROM ne GROUP BY fam")
def l4(spark, sf):
    return L.nested_vs_fixed(chosen(spark, sf), ["part"])


GAPS = "key = 'lang | Shrunk' AND part IN ('source_f01', 'source_f03', 'template_f02', 'source_f04')"


@query("l5_complete_partitions", X.WITH_CELLS + f"""
SELECT design, part, count(DISTINCT key) AS n_cells FROM cells WHERE NOT ({GAPS}) GROUP BY ALL HAVING count(DISTINCT key) = 7""")
def l5(spark, sf):
    c = X.cells(spark, sf)
    return L.complete_partitions(c.where(f"not ({GAPS})"), ["design", "part"], c.select("key"))


@query("l5_usable_designs", X.WITH_CELLS + f"""
SELECT design, count(*) AS n_complete FROM (SELECT design, part FROM cells WHERE NOT ({GAPS}) GROUP BY ALL HAVING count(DISTINCT key) = 7) GROUP BY design HAVING count(*) >= 3""")
def l5u(spark, sf):
    c = X.cells(spark, sf)
    return L.usable_designs(L.complete_partitions(c.where(f"not ({GAPS})"), ["design", "part"], c.select("key")), "design")


FAM_PAIRS = [("Hyb", "Cat"), ("Src", "Cat"), ("Desc", "Hyb")]


@X.shared
def nested(spark, sf):
    r = reps(spark, sf).select("part", "fam", "optimism")
    n = L.nested_selection(X.cells(spark, sf), ["part"]).withColumnRenamed("test_r2", "r2")
    return n.select("design", "part", "fam", "key", "r2").join(r, ["part", "fam"])


def _family_pairs(spark):
    return spark.createDataFrame(FAM_PAIRS, "fam_a string, fam_b string")


@query("l6_paired_over_partitions", X.WITH_CELLS + "," + NESTED + """,
fp AS (SELECT * FROM (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in FAM_PAIRS) + """) v(fam_a, fam_b))
SELECT a.design, fam_a, fam_b, count(*) AS n_parts, round(avg(a.test_r2 - b.test_r2), 6) AS mean_delta, round(stddev_samp(a.test_r2 - b.test_r2), 6) AS sd_delta, count(*) FILTER (a.test_r2 > b.test_r2) AS n_a_better,
  count(*) FILTER (a.test_r2 <> b.test_r2) AS n_nonzero, round(min(a.test_r2 - b.test_r2), 6) AS min_delta, round(max(a.test_r2 - b.test_r2), 6) AS max_delta
FROM ne a JOIN fp ON a.fam = fam_a JOIN ne b ON b.fam = fam_b AND b.part = a.part GROUP BY ALL""")
def l6(spark, sf):
    return L.paired_over_partitions(nested(spark, sf), _family_pairs(spark), "part", ["design"]).drop("lo", "hi", "p_sign", "p_wilcoxon")


@query("l6_paired_tests")
def l6t(spark, sf):
    return L.paired_over_partitions(nested(spark, sf), _family_pairs(spark), "part", ["design"])


@query("l7_stability", REP_SQL + "," + NESTED + """,
nr AS (SELECT ne.*, optimism, row_number() OVER (PARTITION BY ne.part ORDER BY ne.test_r2 DESC, ne.fam) AS rk FROM ne JOIN reps USING (part, fam)),
s AS (SELECT design, fam, round(avg(test_r2), 6) AS r2_mean, round(stddev_samp(test_r2), 6) AS r2_sd, median(test_r2)::DOUBLE AS r2_median, min(test_r2) AS r2_min, max(test_r2) AS r2_max, round(avg(optimism), 6) AS mean_optimism,
  count(*) FILTER (rk = 1) AS n_first, count(*) FILTER (rk <= 3) AS n_top3, count(*) FILTER (rk = 4) AS n_last, round(avg(rk), 6) AS rank_mean, median(rk)::DOUBLE AS rank_median, count(DISTINCT key) AS n_models, avg(test_r2) AS am, avg(rk) AS ar FROM nr GROUP BY ALL)
SELECT * EXCLUDE (am, ar), row_number() OVER (PARTITION BY design ORDER BY am DESC, fam) AS rank_of_mean_score, row_number() OVER (PARTITION BY design ORDER BY ar, fam) AS rank_of_mean_rank FROM s""")
def l7(spark, sf):
    s = L.stability(nested(spark, sf), ["design"], "part")
    return s.withColumn("n_models", F.size("selected")).drop("selected")


@query("l7_late_cell_wins", X.WITH_CELLS + """, s AS (SELECT part, fam, max("inner") FILTER (learner = 'Shrunk') AS late, max("inner") FILTER (learner <> 'Shrunk') AS early FROM cells GROUP BY ALL)
SELECT fam, count(*) AS n_checked, count(*) FILTER (late > early) AS n_late_wins FROM s WHERE late IS NOT NULL GROUP BY fam""")
def l7l(spark, sf):
    c = X.cells(spark, sf)
    return L.late_cell_wins(c, c.where("learner = 'Shrunk'").select("key").distinct(), ["part"])


@query("l8_same_input_contrast", X.WITH_CELLS + """,
b AS (SELECT part, key AS frozen_key, test_r2 AS frozen_r2 FROM cells WHERE key IN ('lang | Mean', 'lang | Shrunk') QUALIFY row_number() OVER (PARTITION BY part ORDER BY "inner" DESC, key) = 1)
SELECT part, c.test_r2 AS tuned_r2, frozen_key, frozen_r2, round(c.test_r2 - frozen_r2, 6) AS delta FROM cells c JOIN b USING (part) WHERE key = 'lang+source | Mean'""")
def l8(spark, sf):
    return L.same_input_contrast(X.cells(spark, sf), ["part"], "lang+source | Mean", ["lang | Mean", "lang | Shrunk"])


@query("l9_reproduction_diff", X.WITH_CELLS + f""", t AS (SELECT part, model AS key, round({X.R2}, 6) AS rerun FROM preds WHERE role = 'test' GROUP BY ALL)
SELECT part, key, test_r2 AS stored, rerun, abs(test_r2 - rerun) AS abs_diff FROM cells JOIN t USING (part, key)""")
def l9(spark, sf):
    from plumbline.operators.metrics import regression_metrics

    again = regression_metrics(X.held_out(spark, sf), ["part", "model"]).select("part", F.col("model").alias("key"), F.round("r2", 6).alias("test_r2"))
    return L.reproduction_diff(X.cells(spark, sf), again, ["part", "key"], "test_r2")


ROLES = [("lang+source | Mean", "reported", 0), ("lang | Mean", "reference", 1), ("lang+source | Mean", "representative", 2), ("loglength | Line", "representative", 3)]


@query("l10_main_table", X.WITH_CELLS + """, r AS (SELECT * FROM (VALUES """ + ", ".join(f"('{k}', '{r}', {s})" for k, r, s in ROLES) + """) v(key, role, seq))
SELECT key, min_by(role, seq) AS role, any_value(q2) AS q2, any_value(test_r2) AS test_r2, any_value(test_rmse) AS test_rmse, any_value(test_mae) AS test_mae FROM cells JOIN r USING (key) WHERE part = 'stratified_f00' GROUP BY key""")
def l10(spark, sf):
    return L.main_table(X.cells(spark, sf), spark.createDataFrame(ROLES, "key string, role string, seq int"), "part", "stratified_f00")


@query("l11_negative_counts", X.WITH_CELLS + """
SELECT design, sum(neg)::BIGINT AS n_negative, sum(n)::BIGINT AS n_scored, count(*) FILTER (every) AS n_parts_all_negative FROM (
  SELECT design, part, count(*) FILTER (test_r2 < 0) AS neg, count(*) AS n, bool_and(test_r2 < 0) AS every FROM cells GROUP BY ALL) GROUP BY design""")
def l11(spark, sf):
    return L.negative_counts(X.cells(spark, sf), ["design"], "part", "test_r2")
