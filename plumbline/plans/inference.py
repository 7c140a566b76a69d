"""I: resampling and statistical inference."""
from pyspark.sql import functions as F

from plumbline.operators import inference as I
from plumbline.operators import metrics as M
from plumbline.operators import poisson as Q
from plumbline.operators import selection as L
from plumbline.plans import fixtures as X
from plumbline.plans import tails
from plumbline.plans.registry import query
from plumbline.sources import tables as S

B_ROWS, B_CLUSTERS, SEED = 2000, 2000, 20260930


def _draw(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 8))::BIGINT"


def weights_sql(name: str, units: str, unit: str, b: int, key: str | None = None) -> str:
    """SQL of the resample weights: units (one row each) drawn within an optional key."""
    by = f"PARTITION BY {key} " if key else ""
    k, kj, using = (f"{key}, ", f"|| {key} || ':' ", f"{key}, pos") if key else ("", "", "pos")
    drawn = f"('0x' || substr(md5('{SEED}:' {kj}|| b || ':' || pos), 1, 8))::BIGINT % n"
    return f"""
{name}_u AS (SELECT {k}{unit}, row_number() OVER ({by}ORDER BY {unit}) - 1 AS pos, count(*) OVER ({by}) AS n FROM (SELECT DISTINCT {k}{unit} FROM {units})),
{name}_d AS (SELECT {k}b, {drawn} AS pos, count(*) AS w FROM {name}_u, range({b}) t(b) GROUP BY ALL),
{name} AS (SELECT {k}b, {unit}, w FROM {name}_d JOIN {name}_u USING ({using}))"""


def poisson_sql(name: str, units: str, unit: str, b: int, key: str | None = None) -> str:
    """SQL of the Poisson weights of the units (one row each) of an optional key, zero weights left out."""
    k, kj = (f"{key}, ", f"{key} || ':' || ") if key else ("", "")
    h = ", ".join(f"('0x' || substr(m, {8 * i + 1}, 8))::BIGINT % {Q.PRIME} AS h{i}" for i in range(3))
    w = " + ".join(f"(u >= {t})::INT" for t in Q.BOUNDS)
    return f"""
{name}_u AS (SELECT {k}{unit}, {h} FROM (SELECT DISTINCT {k}{unit}, md5('{SEED}:' || {kj}{unit}) AS m FROM {units})),
{name}_d AS (SELECT {k}{unit}, b, (h2 + b * ((h1 + b * h0 % {Q.PRIME}) % {Q.PRIME})) % {Q.PRIME} AS u FROM {name}_u, range({b}) t(b)),
{name} AS (SELECT {k}b, {unit}, ({w})::BIGINT AS w FROM {name}_d WHERE u >= {Q.BOUNDS[0]})"""


@query("i19_hashed_draws", "SELECT b, slot, ('0x' || substr(md5('7:' || b || ':' || slot), 1, 8))::BIGINT % (SELECT count(*) FROM documents) AS pos FROM range(20) t1(b), (SELECT unnest(range(0, (SELECT count(*) FROM documents))) AS slot)")
def i19(spark, sf):
    return I.hashed_draws(spark, S.table(spark, sf, "documents").count(), 20, 7)


HELD_SQL = X.WITH_PREDS + ", held AS (SELECT design, part, id, model, y, pred FROM preds WHERE role = 'test'), cen AS (SELECT design, avg(y) AS c FROM held GROUP BY design)"


def scores_sql(name: str, w: str, unit: str, using: str) -> str:
    return f"""
{name}_s AS (SELECT h.design, model, {unit}, count(*) AS s0, sum(y - c) AS sy, sum((y - c) * (y - c)) AS syy, sum((y - pred) * (y - pred)) AS see, sum(abs(y - pred)) AS sae
   FROM held_x h JOIN cen ON cen.design = h.design GROUP BY ALL),
{name}_t AS (SELECT s.design, model, b, sum(w * s0) AS n, sum(w * sy) AS sy, sum(w * syy) AS syy, sum(w * see) AS see, sum(w * sae) AS sae FROM {name}_s s JOIN {w} USING ({using}) GROUP BY ALL),
{name} AS (SELECT design, model, b, CASE WHEN syy - sy * sy / n > 1e-12 THEN 1 - see / (syy - sy * sy / n) END AS r2, sqrt(see / n) AS rmse, sae / n AS mae FROM {name}_t)"""


ROWS_SQL = HELD_SQL + ", held_x AS (SELECT * FROM held)," + poisson_sql("wr", "held", "id", B_ROWS, "design") + "," + scores_sql("br", "wr", "id", "design, id")
CLUS_SQL = HELD_SQL + ", held_x AS (SELECT held.*, ent.grp FROM held JOIN ent USING (id))," + weights_sql("wc", "held_x", "grp", B_CLUSTERS, "design") + "," + scores_sql("bc", "wc", "grp", "design, grp")
CI = ", ".join(f"round(quantile_cont({m}, {q}), 6) AS {m}_{e}" for m in ("r2", "rmse", "mae") for q, e in ((0.025, "lo"), (0.975, "hi")))
# The pairs of models that are compared.
PAIRS = [("lang | Mean", "source | Mean"), ("lang+source | Mean", "lang | Mean"), ("length | Line", "loglength | Line"), ("lang | Mean", "length | Line")]
PAIRS_SQL = "cp AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ") v(model_a, model_b))"


def contrast_pairs(spark):
    return spark.createDataFrame(PAIRS, "model_a string, model_b string")


@X.shared
def row_scores(spark, sf):
    return Q.poisson_scores(X.held_out(spark, sf), ["design"], B_ROWS, SEED)


def _held_groups(spark, sf):
    return X.held_groups(spark, sf)


@query("i1_bootstrap_ci", ROWS_SQL + f" SELECT design, model, {CI} FROM br GROUP BY ALL")
def i1(spark, sf):
    return I.bootstrap_ci(row_scores(spark, sf), ["design"])


@query("i2_paired_bootstrap", ROWS_SQL + "," + PAIRS_SQL + """
SELECT design, model_a, model_b, round(quantile_cont(d, 0.025), 6) AS delta_lo, round(quantile_cont(d, 0.975), 6) AS delta_hi, round(least(1.0, 2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT))), 6)::DOUBLE AS p_boot
FROM (SELECT a.design, model_a, model_b, a.r2 - b.r2 AS d FROM br a JOIN cp ON a.model = model_a JOIN br b ON b.model = model_b AND b.design = a.design AND b.b = a.b) GROUP BY ALL""")
def i2(spark, sf):
    return I.paired_bootstrap(row_scores(spark, sf), contrast_pairs(spark), ["design"])


@query("i3_cluster_bootstrap", CLUS_SQL + f" SELECT design, model, {CI} FROM bc GROUP BY ALL")
def i3(spark, sf):
    return I.bootstrap_ci(I.bootstrap_scores(_held_groups(spark, sf), ["design"], B_CLUSTERS, SEED, unit="grp"), ["design"])


@query("i4_joint_bootstrap", X.WITH_PREDS + ", held AS (SELECT part AS design, id, model, y, pred, grp FROM (SELECT design, part, id, model, y, pred FROM preds WHERE role = 'test') JOIN (SELECT id, grp FROM ent) USING (id)), held_x AS (SELECT * FROM held), cen AS (SELECT design, avg(y) AS c FROM held GROUP BY design),"
       + weights_sql("wj", "ent", "grp", B_CLUSTERS) + "," + scores_sql("bj", "wj", "grp", "grp") + """,
mj AS (SELECT model, b, avg(r2) AS r FROM bj GROUP BY ALL) SELECT model, round(quantile_cont(r, 0.025), 6) AS mean_r2_lo, round(quantile_cont(r, 0.975), 6) AS mean_r2_hi FROM mj GROUP BY model""")
def i4(spark, sf):
    j = I.joint_bootstrap(_held_groups(spark, sf), "part", X.entities(spark, sf), "grp", B_CLUSTERS, SEED)
    return j.groupBy("model").agg(*I._ci("mean_r2", "mean_r2"))


RANK_SQL = X.WITH_SLICE + ", held AS (SELECT 'slice' AS k, id, y, pred, y >= (SELECT quantile_cont(y, 0.9) FROM ent) AS act FROM slice WHERE role = 'test')," + poisson_sql("wk", "held", "id", B_ROWS) + """,
rw AS (SELECT b, id, y, pred, act, w FROM wk JOIN held USING (id)),
rx AS (SELECT *, (SELECT 1) AS one, sum(w) OVER (PARTITION BY b ORDER BY y RANGE UNBOUNDED PRECEDING) - (sum(w) OVER (PARTITION BY b, y) - 1) / 2.0 AS ry,
  sum(w) OVER (PARTITION BY b ORDER BY pred RANGE UNBOUNDED PRECEDING) - (sum(w) OVER (PARTITION BY b, pred) - 1) / 2.0 AS rp,
  sum(w) OVER (PARTITION BY b ORDER BY pred DESC, id ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY b) AS n, sum(w * act::INT) OVER (PARTITION BY b) AS na FROM rw),
rm AS (SELECT *, sum(w * ry) OVER (PARTITION BY b) / n AS my, sum(w * rp) OVER (PARTITION BY b) / n AS mp, greatest(1, round_even(n * 0.1, 0)) AS k FROM rx),
rs AS (SELECT b, sum(w * (ry - my) * (rp - mp)) / sqrt(sum(w * (ry - my) * (ry - my)) * sum(w * (rp - mp) * (rp - mp))) AS spearman,
  CASE WHEN any_value(na) > 0 THEN 100 * sum(greatest(0, least(w, k - (upto - w))) * act::INT) / any_value(k) END AS hit_rate,
  CASE WHEN any_value(na) > 0 THEN sum(greatest(0, least(w, k - (upto - w))) * act::INT) / any_value(k) / (any_value(na) / any_value(n)) END AS ef FROM rm GROUP BY b)"""


@query("i5_bootstrap_rank", RANK_SQL + " SELECT b, round(spearman, 6)::DOUBLE AS spearman, round(hit_rate, 6)::DOUBLE AS hit_rate, round(ef, 6)::DOUBLE AS ef FROM rs")
def i5(spark, sf):
    h = X.slice_plain(spark, sf).where("role = 'test'").withColumn("act", F.col("y") >= X.threshold(spark, sf))
    return Q.bootstrap_rank(X.settle(h), [], B_ROWS, SEED, "act", 0.1)


@query("i6_spearman_pearson", X.WITH_PREDS + """,
r AS (SELECT part, model, y, pred, rank() OVER (PARTITION BY part, model ORDER BY y) + (count(*) OVER (PARTITION BY part, model, y) - 1) / 2.0 AS ry,
  rank() OVER (PARTITION BY part, model ORDER BY pred) + (count(*) OVER (PARTITION BY part, model, pred) - 1) / 2.0 AS rp FROM preds WHERE role = 'test')
SELECT part, model, CASE WHEN var_pop(rp) > 0 THEN round(corr(ry, rp), 6) END AS spearman, CASE WHEN var_pop(pred) > 0 THEN round(corr(y, pred), 6) END AS pearson FROM r GROUP BY ALL""")
def i6(spark, sf):
    h, by = X.held_out(spark, sf), ["part", "model"]
    return M.spearman(h, "y", "pred", by).join(M.correlation(h, "y", "pred", by), by)


WILCOXON_SQL = HELD_SQL + "," + PAIRS_SQL + """,
er AS (SELECT a.design, model_a, model_b, abs(a.y - a.pred) - abs(b.y - b.pred) AS d FROM held a JOIN cp ON a.model = model_a JOIN held b ON b.model = model_b AND b.design = a.design AND b.id = a.id),
wk AS (SELECT *, rank() OVER (PARTITION BY design, model_a, model_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY design, model_a, model_b, abs(d)) - 1) / 2.0 AS r,
  count(*) OVER (PARTITION BY design, model_a, model_b, abs(d))::DOUBLE AS t FROM er WHERE d <> 0),
ws AS (SELECT design, model_a, model_b, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, sum(t * t - 1) AS ties FROM wk GROUP BY ALL)"""


@query("i7_wilcoxon", WILCOXON_SQL + """
SELECT design, model_a, model_b, n, w_plus::DOUBLE AS w_plus, w_minus::DOUBLE AS w_minus, least(w_plus, w_minus)::DOUBLE AS statistic,
  round((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6)::DOUBLE AS z FROM ws""")
def i7(spark, sf):
    p = L.paired_errors(X.held_out(spark, sf), contrast_pairs(spark), ["design"])
    return I.wilcoxon(p, "err_a", "err_b", ["design", "model_a", "model_b"]).drop("p")


#: Ways to reach each sum of signed ranks of n untied differences, n up to the size that is counted exactly.
SIGNED_SQL = """sr(n, ways) AS (SELECT 0, [1.0::DOUBLE] UNION ALL
  SELECT n + 1, [coalesce(CASE WHEN s < len(ways) THEN ways[s + 1] END, 0) + coalesce(CASE WHEN s >= n + 1 THEN ways[s - n] END, 0) for s in range(0, (n + 1) * (n + 2) // 2 + 1)] FROM sr WHERE n < 50)"""


def wilcoxon_p_sql(w: str) -> str:
    """Two-sided p from columns n, ties (sum of t * t - 1), w_plus and the ways of n (null beyond the exact sizes)."""
    z = f"(({w} - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48))"
    exact = f"2 * least(list_sum(ways[ceil({w})::BIGINT + 1:]), list_sum(ways[ceil(n * (n + 1) / 2 - {w})::BIGINT + 1:])) / power(2.0, n)"
    return f"least(1.0, CASE WHEN n <= 50 AND ties = 0 THEN {exact} ELSE 2 * {tails.normal_upper(f'abs({z})')} END)"


@query("i7_wilcoxon_p", WILCOXON_SQL.replace("WITH", "WITH RECURSIVE", 1) + ", " + SIGNED_SQL + """
SELECT design, model_a, model_b, n, w_plus::DOUBLE AS w_plus, w_minus::DOUBLE AS w_minus, least(w_plus, w_minus)::DOUBLE AS statistic,
  round((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6)::DOUBLE AS z, round(""" + wilcoxon_p_sql("w_plus") + """, 6)::DOUBLE AS p
FROM ws LEFT JOIN sr USING (n)""")
def i7p(spark, sf):
    p = L.paired_errors(X.held_out(spark, sf), contrast_pairs(spark), ["design"])
    return I.wilcoxon(p, "err_a", "err_b", ["design", "model_a", "model_b"])


SEEN_SQL = HELD_SQL + """,
sd AS (SELECT model, abs(y - pred) AS ae, id IN (SELECT id FROM folds WHERE design = 'source' AND ofold < 2) AS seen FROM held WHERE design = 'stratified'),
sr AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY ae) + (count(*) OVER (PARTITION BY model, ae) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY model, ae)::DOUBLE AS t FROM sd),
ss AS (SELECT model, count(*) FILTER (seen) AS n_a, count(*) FILTER (NOT seen) AS n_b, sum(r) FILTER (seen) AS ra, sum(t * t - 1) AS ties, sqrt(avg(ae * ae) FILTER (seen)) AS rmse_seen, sqrt(avg(ae * ae) FILTER (NOT seen)) AS rmse_unseen,
  median(ae) FILTER (seen) AS median_seen, median(ae) FILTER (NOT seen) AS median_unseen FROM sr GROUP BY model)"""


def _seen(spark, sf):
    seen = X.folds(spark, sf).where("design = 'source'").select("id", (F.col("ofold") < 2).alias("seen"))
    return X.held_out(spark, sf).where("design = 'stratified'").join(seen, "id")


@query("i8_seen_unseen_test", SEEN_SQL + """
SELECT model, n_a, n_b, u, round(z, 6)::DOUBLE AS z, round(rmse_seen, 6) AS rmse_seen, round(rmse_unseen, 6) AS rmse_unseen, round(rmse_unseen / rmse_seen, 6) AS rmse_ratio, round(median_seen, 6) AS median_seen,
  round(median_unseen, 6) AS median_unseen, round(""" + tails.normal_upper("(-z)") + """, 6)::DOUBLE AS p_less
FROM (SELECT *, (ra - n_a * (n_a + 1) / 2)::DOUBLE AS u, (ra - n_a * (n_a + 1) / 2 - n_a * n_b / 2 + 0.5) / sqrt(n_a * n_b / 12 * (n_a + n_b + 1 - ties / ((n_a + n_b) * (n_a + n_b - 1)))) AS z FROM ss)""")
def i8(spark, sf):
    return I.seen_unseen_test(_seen(spark, sf), ["model"])


@query("i9_ks_2samp", """
WITH v AS (SELECT l_returnflag AS g, l_extendedprice AS x, count(*) FILTER (l_linestatus = 'O') AS a, count(*) FILTER (l_linestatus <> 'O') AS b FROM lineitem GROUP BY ALL),
c AS (SELECT g, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY g) AS n_a, sum(b) OVER (PARTITION BY g) AS n_b FROM v WINDOW w AS (PARTITION BY g ORDER BY x))
SELECT l_returnflag, n_a, n_b, round(d, 6) AS d, round(""" + tails.ks_upper("d", "n_a", "n_b") + """, 6)::DOUBLE AS p FROM (
  SELECT g AS l_returnflag, any_value(n_a)::BIGINT AS n_a, any_value(n_b)::BIGINT AS n_b, max(abs(ca / n_a - cb / n_b)) AS d FROM c GROUP BY g)""")
def i9(spark, sf):
    return I.ks_2samp(S.table(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus", "O", ["l_returnflag"])


@query("i10_levene", """
WITH m AS (SELECT l_linestatus, median(l_extendedprice) AS med FROM lineitem GROUP BY 1), d AS (SELECT l_linestatus, abs(l_extendedprice - med) AS dev FROM lineitem JOIN m USING (l_linestatus)),
g AS (SELECT count(*) AS n, avg(dev) AS a, var_pop(dev) AS v FROM d GROUP BY l_linestatus),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * power(a - (SELECT avg(dev) FROM d), 2)) AS ssb, sum(n * v) AS ssw FROM g)
SELECT k, n::BIGINT AS n, round(f, 6) AS f, round(eta2, 6) AS eta2, round(""" + tails.f_upper("f", "(k - 1)", "(n - k)") + """, 6) AS p
FROM (SELECT k, n, (ssb / (k - 1)) / (ssw / (n - k)) AS f, ssb / (ssb + ssw) AS eta2 FROM s)""")
def i10(spark, sf):
    return I.levene(S.table(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus")


@query("i11_sign_test", """WITH d AS (SELECT s_nationkey % 5 AS r, s_acctbal - 5000 AS a, (s_suppkey % 7) - 3 AS b FROM supplier)
SELECT *, round(""" + tails.binom_upper("n_agree", "n_tested") + """, 6)::DOUBLE AS p_greater FROM (
  SELECT r::BIGINT AS r, count(*) AS n, round(100.0 * avg((sign(a) = sign(b))::INT), 6) AS sign_agreement_pct, count(*) FILTER (a <> 0) AS n_tested, count(*) FILTER (sign(a) = sign(b) AND a <> 0) AS n_agree FROM d GROUP BY r)""")
def i11(spark, sf):
    d = S.table(spark, sf, "supplier").select((F.col("s_nationkey") % 5).alias("r"), (F.col("s_acctbal") - 5000).alias("a"), (F.col("s_suppkey") % 7 - 3).cast("double").alias("b"))
    return I.sign_test(d, "a", "b", ["r"])


@query("i12_t_interval", """SELECT o_orderpriority, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(t, 5) AS t, round(""" + tails.t_two_sided("t", "(n - 1)") + """, 6) AS p
FROM (SELECT *, mean / (sd / sqrt(n)) AS t FROM (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice - 250000) AS mean, stddev_samp(o_totalprice - 250000) AS sd FROM orders GROUP BY 1))""")
def i12(spark, sf):
    o = S.table(spark, sf, "orders").withColumn("d", F.col("o_totalprice") - 250000)
    t = I.t_interval(o, "d", ["o_orderpriority"])
    return t.select("o_orderpriority", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round("t", 5).alias("t"), "p")


@query("i13_friedman_kendall", X.WITH_CELLS + """,
r AS (SELECT design, part, key, rank() OVER (PARTITION BY part ORDER BY test_r2) + (count(*) OVER (PARTITION BY part, test_r2) - 1) / 2.0 AS mid,
  row_number() OVER (PARTITION BY part ORDER BY test_r2 DESC, key) AS o, count(*) OVER (PARTITION BY part, test_r2) AS t FROM cells),
s AS (SELECT design, key, sum(mid) AS rs, sum(o) AS os FROM r GROUP BY ALL), ti AS (SELECT design, sum(t * t - 1) AS ties, count(DISTINCT part) AS n, count(DISTINCT key) AS k FROM r GROUP BY design)
SELECT *, round(""" + tails.chi2_upper("chi2", "(k - 1)") + """, 6) AS p FROM (SELECT design, any_value(n) AS n, any_value(k) AS k, round((12.0 / (any_value(n) * any_value(k) * (any_value(k) + 1)) * sum(rs * rs) - 3 * any_value(n) * (any_value(k) + 1)) / (1 - any_value(ties) / (any_value(n) * (any_value(k)^3 - any_value(k)))), 6)::DOUBLE AS chi2,
  round(12 * sum(power(os - n * (k + 1) / 2.0, 2)) / (any_value(n)^2 * (any_value(k)^3 - any_value(k))), 6)::DOUBLE AS kendall_w FROM s JOIN ti USING (design) GROUP BY design)""")
def i13(spark, sf):
    return I.friedman(X.cells(spark, sf), "part", "key", "test_r2", ["design"])


def _i14_sql() -> str:
    from plumbline.plans.pairs import ENR_SQL

    return ENR_SQL + " SELECT design, part, frac, n, n_act, k, hits, round(" + tails.hypergeom_upper("hits", "n", "n_act", "k") + ", 6)::DOUBLE AS p FROM ef"


@query("i14_hypergeometric", _i14_sql())
def i14(spark, sf):
    from plumbline.plans.pairs import fold_enrichment

    return fold_enrichment(spark, sf).select("design", "part", "frac", "n", "n_act", "k", "hits", "p")


CONF_SQL = X.WITH_PREDS + """,
cal AS (SELECT part, model, abs(y - pred) AS s, row_number() OVER (PARTITION BY part, model ORDER BY abs(y - pred)) AS rn, count(*) OVER (PARTITION BY part, model) AS n FROM preds WHERE role = 'train'),
wd AS (SELECT part, model, t AS target, max(s) FILTER (rn = ceil((n - 1) * t - 1e-9) + 1) AS q FROM cal, (VALUES (0.9), (0.8)) v(t) GROUP BY ALL)
SELECT part, model, target::DOUBLE AS target, round(any_value(q), 6) AS half_width, round(avg((abs(y - pred) <= q)::INT), 6) AS coverage FROM preds JOIN wd USING (part, model) WHERE role = 'test' GROUP BY ALL"""


@query("i15_conformal", CONF_SQL)
def i15(spark, sf):
    p = X.predictions(spark, sf)
    return I.conformal(p.where("role = 'train'"), p.where("role = 'test'"), keys=["part", "model"])


@query("i16_conformal_normalised", X.WITH_SLICE + "," + X.SELF_SQL + """,
cal AS (SELECT abs(y - pred) / greatest(1 - s.nn_sim, 0.001) AS s FROM slice JOIN snn s USING (id) WHERE role = 'train'),
ck AS (SELECT s, row_number() OVER (ORDER BY s) AS rn, count(*) OVER () AS n FROM cal),
wd AS (SELECT t AS target, max(s) FILTER (rn = ceil((n - 1) * t - 1e-9) + 1) AS q FROM ck, (VALUES (0.9), (0.8)) v(t) GROUP BY ALL)
SELECT target::DOUBLE AS target, round(avg(q * greatest(1 - nn_sim, 0.001)), 6) AS half_width, round(avg((abs(y - pred) <= q * greatest(1 - nn_sim, 0.001))::INT), 6) AS coverage FROM slice, wd WHERE role = 'test' GROUP BY target""")
def i16(spark, sf):
    s = X.slice_scores(spark, sf)
    cal = s.where("role = 'train'").drop("nn_sim").join(X.self_nn(spark, sf).select("id", "nn_sim"), "id")
    return I.conformal_normalised(cal, s.where("role = 'test'"))


@query("i17_williams_domain")
def i17(spark, sf):
    from plumbline.plans.models import described

    rows = described(spark, sf)
    w = I.williams_domain(rows.where("role = 'train'"), rows.where("role = 'test'"), 4)
    inside = M.regression_metrics(w.where("inside")).select("r2", "rmse")
    return w.agg(F.count("*").alias("n"), F.first("h_star").alias("h_star"), F.count_if(F.col("leverage") > F.col("h_star")).alias("n_high_leverage"),
                 F.count_if(F.abs("std_resid") > 3).alias("n_high_residual"), F.count_if("inside").alias("n_inside")).select(
        "*", inside.select("r2").scalar().alias("r2_inside"), inside.select("rmse").scalar().alias("rmse_inside"))


@query("i18_interaction", HELD_SQL + ", held_x AS (SELECT held.*, ent.grp FROM held JOIN ent USING (id))," + PAIRS_SQL + "," + weights_sql("wi", "ent", "grp", B_CLUSTERS) + """,
wa AS (SELECT b, grp, w FROM wi UNION ALL SELECT -1, grp, 1 FROM wi_u), gc AS (SELECT avg(y) AS c FROM held),
us AS (SELECT design, model, grp, count(*) AS s0, sum(y - c) AS sy, sum((y - c) * (y - c)) AS syy, sum((y - pred) * (y - pred)) AS see FROM held_x, gc GROUP BY ALL),
tt AS (SELECT design, model, b, sum(w * see) / sum(w * s0) AS mse, sum(w * syy) / sum(w * s0) - power(sum(w * sy) / sum(w * s0), 2) AS v FROM us JOIN wa USING (grp) GROUP BY ALL),
gp AS (SELECT a.design, a.b, model_a, model_b, (x.mse - a.mse) / a.v AS gap FROM tt a JOIN cp ON a.model = model_a JOIN tt x ON x.model = model_b AND x.design = a.design AND x.b = a.b),
dd AS (SELECT g.design, g.b, g.model_a, g.model_b, g.gap, r.gap AS gap_base, g.gap - r.gap AS d FROM gp g JOIN gp r ON r.design = 'stratified' AND r.b = g.b AND r.model_a = g.model_a AND r.model_b = g.model_b WHERE g.design <> 'stratified')
SELECT design, model_a, model_b, round(max(gap) FILTER (b = -1), 6) AS gap, round(max(gap_base) FILTER (b = -1), 6) AS gap_base, round(max(d) FILTER (b = -1), 6) AS interaction,
  round(quantile_cont(d, 0.025) FILTER (b >= 0), 6) AS interaction_lo, round(quantile_cont(d, 0.975) FILTER (b >= 0), 6) AS interaction_hi,
  round(least(1.0, 2 * least(avg((d <= 0)::INT) FILTER (b >= 0), avg((d >= 0)::INT) FILTER (b >= 0))), 6)::DOUBLE AS p_boot FROM dd GROUP BY ALL""")
def i18(spark, sf):
    return I.interaction(_held_groups(spark, sf), "stratified", contrast_pairs(spark), "grp", B_CLUSTERS, SEED, X.entities(spark, sf))
