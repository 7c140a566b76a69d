"""R: matched pairs, triage, attribution tables."""
from pyspark.sql import functions as F

from plumbline.core import draw
from plumbline.operators import attribution as T
from plumbline.operators import pairs as P
from plumbline.operators.graph import pair_kind
from plumbline.plans import fixtures as X
from plumbline.plans import tails
from plumbline.plans.clusters import COMP_SQL, PAIRS_SQL, part_components, part_pairs
from plumbline.plans.joins import SPANS_SQL, part_folds
from plumbline.plans.registry import query
from plumbline.sources import tables as S

# ---------------------------------------------------------------- pairs of parts
# Row-level protocol: mean of the brand without the row's own fold; component protocol: mean of the type.
VALUES_SQL = """,
pv AS (SELECT p_partkey AS id, p_brand, p_type, round(log10(p_retailprice), 9) AS y, (row_number() OVER (ORDER BY md5('5:' || p_partkey), p_partkey) - 1) % 10 AS f FROM part),
pb AS (SELECT p_brand, sum(y) AS s, count(*) AS n FROM pv GROUP BY 1), pbf AS (SELECT p_brand, f, sum(y) AS s, count(*) AS n FROM pv GROUP BY ALL), pt AS (SELECT p_type, avg(y) AS m FROM pv GROUP BY 1),
pw AS (SELECT id, y, round((pb.s - pbf.s) / (pb.n - pbf.n) + 1.23e-8, 6) AS pr, round(m + 1.23e-8, 6) AS pc FROM pv JOIN pb USING (p_brand) JOIN pbf USING (p_brand, f) JOIN pt USING (p_type)),
dl AS (SELECT pairs.*, b.y - a.y AS observed, b.pr - a.pr AS predicted, b.pc - a.pc AS predicted_c FROM pairs JOIN pw a ON a.id = id_without JOIN pw b ON b.id = id_with)"""


@X.shared
def part_values(spark, sf):
    """(id, y, row_pred, comp_pred) of the parts under two scoring protocols."""
    p = S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", F.round(F.log10("p_retailprice"), 9).alias("y"))
    p = p.join(part_folds(spark, sf).select("id", "fold"), "id")
    by_fold = p.groupBy("p_brand", "fold").agg(F.sum("y").alias("sf"), F.count("*").alias("nf"))
    brand = by_fold.groupBy("p_brand").agg(F.sum("sf").alias("s"), F.sum("nf").alias("n"))
    kind = p.groupBy("p_type").agg(F.avg("y").alias("m"))
    rows = p.join(by_fold, ["p_brand", "fold"]).join(brand, "p_brand").join(kind, "p_type")
    return rows.select(
        "id", "y", F.round((F.col("s") - F.col("sf")) / (F.col("n") - F.col("nf")) + X.NUDGE, 6).alias("row_pred"),
        F.round(F.col("m") + X.NUDGE, 6).alias("comp_pred"),
    )


def _values(spark, sf, col):
    return part_values(spark, sf).select("id", "y", F.col(col).alias("pred"))


def _stats_sql(pred: str) -> str:
    return f"""SELECT count(*) AS n_pairs, round(avg(observed), 6) AS mean_observed, round(stddev_samp(observed), 6) AS sd_observed, round(avg({pred}), 6) AS mean_predicted, round(avg(abs(observed - {pred})), 6) AS mae_of_delta,
 (SELECT round(corr(a, b), 6) FROM (SELECT rank() OVER (ORDER BY observed) + (count(*) OVER (PARTITION BY observed) - 1) / 2.0 AS a, rank() OVER (ORDER BY {pred}) + (count(*) OVER (PARTITION BY {pred}) - 1) / 2.0 AS b FROM dl)) AS spearman,
 round(corr(observed, {pred}), 6) AS pearson, round(100.0 * avg((sign(observed) = sign({pred}))::INT), 6) AS sign_agreement_pct, round(avg({pred}) / (stddev_samp({pred}) / sqrt(count(*))), 5) AS t_predicted FROM dl"""


KEEP = ["n_pairs", "mean_observed", "sd_observed", "mean_predicted", "mae_of_delta", "spearman", "pearson", "sign_agreement_pct"]


@query("r1_pair_stats", PAIRS_SQL + VALUES_SQL + " " + _stats_sql("predicted"))
def r1(spark, sf):
    d = P.pair_deltas(part_pairs(spark, sf), _values(spark, sf, "row_pred"))
    return P.pair_stats(d).select(*KEEP, F.round("t_predicted", 5).alias("t_predicted"))


@query("r2_pair_protocols", PAIRS_SQL + VALUES_SQL + " SELECT 'row_level' AS protocol, * EXCLUDE (t_predicted) FROM (" + _stats_sql("predicted") + ") UNION ALL SELECT 'component_aware', * EXCLUDE (t_predicted) FROM (" + _stats_sql("predicted_c") + ")")
def r2(spark, sf):
    v = {"row_level": _values(spark, sf, "row_pred"), "component_aware": _values(spark, sf, "comp_pred")}
    return P.pair_protocols(part_pairs(spark, sf), v).select("protocol", *KEEP)


@query("r2_pair_bootstrap")
def r2b(spark, sf):
    d = P.pair_deltas(part_pairs(spark, sf), _values(spark, sf, "row_pred"))
    c = part_components(spark, sf).withColumnRenamed("id", "id_without")
    return P.pair_bootstrap(d.join(c, "id_without"), "component", 2000, 20260930)


KINDS = (("brand", "^brand#"), ("type", "^(economy|medium|promo|standard)$"), ("size_word", "^(large|small)$"))


@query("r3_pair_kind", PAIRS_SQL + """ SELECT CASE WHEN regexp_matches(unit, '^brand#') THEN 'brand' WHEN regexp_matches(unit, '^(economy|medium|promo|standard)$') THEN 'type'
 WHEN regexp_matches(unit, '^(large|small)$') THEN 'size_word' ELSE 'other' END AS kind, count(*) AS n FROM pairs GROUP BY 1""")
def r3(spark, sf):
    return part_pairs(spark, sf).select(pair_kind(KINDS, F.col("unit")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- triage
ENR_SQL = X.WITH_PREDS + """,
th AS (SELECT quantile_cont(y, 0.9) AS t FROM ent),
er AS (SELECT design, part, model, y >= t AS act, row_number() OVER (PARTITION BY part, model ORDER BY pred DESC, id) AS rn, count(*) OVER (PARTITION BY part, model) AS n,
  sum((y >= t)::INT) OVER (PARTITION BY part, model) AS n_act FROM preds, th WHERE role = 'test'),
enr AS (SELECT design, part, model, frac::DOUBLE AS frac, any_value(n) AS n, any_value(n_act)::BIGINT AS n_act, greatest(1, round_even(any_value(n) * frac, 0))::BIGINT AS k,
  count(*) FILTER (act AND rn <= greatest(1, round_even(n * frac, 0))) AS hits FROM er, (VALUES (0.05), (0.1), (0.2)) v(frac) GROUP BY design, part, model, frac),
ef AS (SELECT *, CASE WHEN n_act > 0 THEN 100.0 * hits / k END AS hit_rate_pct, CASE WHEN n_act > 0 THEN hits / k / (n_act / n) END AS e, CASE WHEN n_act > 0 THEN least(1.0, n_act / k) / (n_act / n) END AS ef_max FROM enr)"""


@X.shared
def fold_enrichment(spark, sf):
    p = X.held_out(spark, sf).withColumn("active", F.col("y") >= X.threshold(spark, sf))
    return P.enrichment(X.settle(p), keys=["design", "part", "model"])


@query("r4_enrichment", ENR_SQL + " SELECT design, part, model, frac, n, n_act, k, hits, round(hit_rate_pct, 6)::DOUBLE AS hit_rate_pct, round(e, 6)::DOUBLE AS ef, round(ef_max, 6)::DOUBLE AS ef_max, round(" + tails.hypergeom_upper("hits", "n", "n_act", "k") + ", 6)::DOUBLE AS p FROM ef")
def r4(spark, sf):
    return fold_enrichment(spark, sf)


@query("r5_enrichment_repeated", ENR_SQL + """ SELECT design, model, frac, count(*) AS n_folds, round(avg(e), 6) AS ef_mean, round(stddev_samp(e), 6) AS ef_sd, round(min(e), 6)::DOUBLE AS ef_min, round(max(e), 6)::DOUBLE AS ef_max_fold,
 count(*) FILTER (e > 1) AS n_above_one FROM ef GROUP BY ALL""")
def r5(spark, sf):
    return P.enrichment_repeated(fold_enrichment(spark, sf), ["design", "model"])


@query("a26_pooled_enrichment", ENR_SQL + """ SELECT design, model, frac, sum(k)::BIGINT AS k, sum(hits)::BIGINT AS hits, round(100.0 * sum(hits) / sum(k), 6)::DOUBLE AS hit_rate_pct, round(100.0 * sum(n_act) / sum(n), 6)::DOUBLE AS base_rate_pct,
 CASE WHEN sum(n_act) > 0 THEN round(sum(hits) / sum(k) / (sum(n_act) / sum(n)), 6)::DOUBLE END AS ef FROM enr GROUP BY ALL""")
def a26(spark, sf):
    return P.pooled_enrichment(fold_enrichment(spark, sf), ["design", "model"])


# ---------------------------------------------------------------- attribution tables
METHODS = ("alpha", "beta")
# Token scores are hashed draws: alpha from (id, token), beta half of it plus an own draw.
SCORES_SQL = SPANS_SQL + """,
sc AS (SELECT id, tok, 'alpha' AS method, ('0x' || substr(md5('1:' || id || ':' || tok), 1, 8))::BIGINT % 1000 / 1000.0 AS score FROM tokens
 UNION ALL SELECT id, tok, 'beta', (('0x' || substr(md5('1:' || id || ':' || tok), 1, 8))::BIGINT % 1000 + ('0x' || substr(md5('2:' || id || ':' || tok), 1, 8))::BIGINT % 1000) / 2000.0 FROM tokens),
cv AS (SELECT id, tok, count(*) AS m FROM ovl GROUP BY ALL),
rw AS (SELECT o.id, method, unit, sum(score / m) AS raw FROM ovl o JOIN cv USING (id, tok) JOIN sc USING (id, tok) GROUP BY ALL),
nu AS (SELECT id, count(*) AS n FROM units GROUP BY id), tl AS (SELECT id, method, sum(raw) AS total FROM rw GROUP BY ALL),
us AS (SELECT u.id, t.method, u.unit, CASE WHEN total > 0 THEN round(coalesce(raw, 0) * n / total, 9) ELSE 1.0 END AS score FROM units u JOIN tl t ON t.id = u.id JOIN nu ON nu.id = u.id LEFT JOIN rw ON rw.id = u.id AND rw.method = t.method AND rw.unit = u.unit),
gr AS (SELECT id, unit, 'even' AS grp FROM units WHERE unit % 2 = 0 UNION ALL SELECT id, unit, 'late' FROM units WHERE unit >= 3),
pe AS (SELECT id, method, count(*) AS n_units, avg(score) AS ma FROM us GROUP BY ALL),
en AS (SELECT us.id, us.method, grp, count(*) AS n_in, any_value(n_units) AS n_units, round(avg(score), 9) AS observed, round(any_value(ma), 9) AS null_mean FROM us JOIN gr USING (id, unit) JOIN pe ON pe.id = us.id AND pe.method = us.method
  GROUP BY us.id, us.method, grp HAVING count(*) < any_value(n_units))"""


@X.shared
def units(spark, sf):
    d = S.table(spark, sf, "documents").withColumn("n", F.length("text"))
    return T.windows_of(d, "doc_id", "n", 200)


@X.shared
def unit_scores(spark, sf):
    d = S.spread(S.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    tok = X.settle(T.token_spans(d, "doc_id", "text"))
    a, b = draw(1000, 1, F.col("id"), F.col("tok")), draw(1000, 2, F.col("id"), F.col("tok"))
    both = tok.select("id", "tok", F.inline(F.array(
        F.struct(F.lit("alpha").alias("method"), (a / 1000.0).alias("score")), F.struct(F.lit("beta").alias("method"), ((a + b) / 2000.0).alias("score")))))
    return T.project_scores(T.span_overlap_join(tok, units(spark, sf)), both, units(spark, sf)).withColumn("score", F.round("score", 9))


def unit_groups(spark, sf):
    u = units(spark, sf)
    return u.where("unit % 2 = 0").select("id", "unit", F.lit("even").alias("grp")).unionByName(u.where("unit >= 3").select("id", "unit", F.lit("late").alias("grp")))


@X.shared
def enrichments(spark, sf):
    e = T.group_enrichment(unit_scores(spark, sf), unit_groups(spark, sf))
    return e.withColumn("observed", F.round("observed", 9)).withColumn("null_mean", F.round("null_mean", 9))


@query("r6_project_scores", SCORES_SQL + " SELECT id, method, unit, round(score + 1.23e-8, 6)::DOUBLE AS score FROM us")
def r6q(spark, sf):
    return unit_scores(spark, sf).withColumn("score", F.col("score") + X.NUDGE)


@query("r7_group_enrichment", SCORES_SQL + " SELECT id, method, grp, n_in, n_units, round(observed, 6)::DOUBLE AS observed, round(null_mean, 6)::DOUBLE AS null_mean FROM en")
def r7(spark, sf):
    return enrichments(spark, sf)


@query("r7_permutation_null", SCORES_SQL + """,
pr AS (SELECT id, b, unit, row_number() OVER (PARTITION BY id, b ORDER BY ('0x' || substr(md5('0:' || id || ':' || b || ':' || unit), 1, 8))::BIGINT % 2147483648, unit) AS rn FROM units, range(200) t(b)),
cn AS (SELECT us.id, method, n_in, unit, score, m FROM (SELECT id, n_in, unit, count(*) AS m FROM pr JOIN (SELECT DISTINCT id, n_in FROM en) USING (id) WHERE rn <= n_in GROUP BY ALL) q JOIN us USING (id, unit))
SELECT en.id, en.method, grp, en.n_in, n_units, round(observed, 6)::DOUBLE AS observed, round(p.null_mean, 6)::DOUBLE AS null_mean
FROM en JOIN (SELECT id, method, n_in, sum(score * m) / sum(m) + 1.23e-8 AS null_mean FROM cn GROUP BY ALL) p ON p.id = en.id AND p.method = en.method AND p.n_in = en.n_in""")
def r7p(spark, sf):
    e = T.group_enrichment(unit_scores(spark, sf), unit_groups(spark, sf), 200, 0)
    return e.withColumn("null_mean", F.col("null_mean") + X.NUDGE).withColumn("observed", F.round("observed", 9))


@query("r8_enrichment_summary", SCORES_SQL + """,
wk AS (SELECT method, grp, observed - null_mean AS d, rank() OVER (PARTITION BY method, grp ORDER BY abs(observed - null_mean)) + (count(*) OVER (PARTITION BY method, grp, abs(observed - null_mean)) - 1) / 2.0 AS r FROM en WHERE observed <> null_mean),
ws AS (SELECT method, grp, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS statistic FROM wk GROUP BY ALL)
SELECT method, grp, count(*) AS n, round(avg(observed), 6) AS mean_enrichment, round(avg(null_mean), 6) AS mean_null, round(median(observed), 6)::DOUBLE AS median_enrichment, round(100.0 * avg((observed > null_mean)::INT), 6) AS pct_enriched,
  any_value(statistic)::DOUBLE AS statistic FROM en JOIN ws USING (method, grp) GROUP BY ALL HAVING count(*) >= 8""")
def r8(spark, sf):
    return T.enrichment_summary(enrichments(spark, sf)).drop("p", "p_adj")


@query("r8_enrichment_p")
def r8p(spark, sf):
    return T.enrichment_summary(enrichments(spark, sf)).select("method", "grp", "p", "p_adj")


@query("r9_method_agreement", SCORES_SQL + """,
jj AS (SELECT a.id, a.score AS s1, b.score AS s2 FROM us a JOIN us b ON a.id = b.id AND a.unit = b.unit AND a.method = 'alpha' AND b.method = 'beta'),
rr AS (SELECT id, rank() OVER (PARTITION BY id ORDER BY s1) + (count(*) OVER (PARTITION BY id, s1) - 1) / 2.0 AS a, rank() OVER (PARTITION BY id ORDER BY s2) + (count(*) OVER (PARTITION BY id, s2) - 1) / 2.0 AS b FROM jj),
rh AS (SELECT id, CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END AS rho FROM rr GROUP BY id)
SELECT 'alpha' AS m1, 'beta' AS m2, round(quantile_cont(rho, 0.5), 6) AS median, round(quantile_cont(rho, 0.25), 6) AS q25, round(quantile_cont(rho, 0.75), 6) AS q75, count(rho) AS n FROM rh""")
def r9(spark, sf):
    return T.method_agreement(unit_scores(spark, sf))


@query("r10_faithfulness", SCORES_SQL + """,
wt AS (SELECT id, unit, (('0x' || substr(md5('3:' || id || ':' || unit), 1, 8))::BIGINT % 1000 - 300) / 1000.0 AS weight FROM units),
kk AS (SELECT id, n, greatest(1, round_even(n * 0.2, 0)) AS k FROM nu),
tp AS (SELECT us.id, method, unit, row_number() OVER (PARTITION BY us.id, method ORDER BY score DESC, unit) AS rn FROM us),
td AS (SELECT tp.id, method, abs(sum(weight)) AS top_drop FROM tp JOIN kk USING (id) JOIN wt USING (id, unit) WHERE rn <= k GROUP BY ALL),
rd0 AS (SELECT id, b, unit, row_number() OVER (PARTITION BY id, b ORDER BY ('0x' || substr(md5('0:' || id || ':' || b || ':' || unit), 1, 8))::BIGINT % 2147483648, unit) AS rn FROM units, range(10) t(b)),
rd AS (SELECT id, avg(d) AS random_drop FROM (SELECT rd0.id, b, abs(sum(weight)) AS d FROM rd0 JOIN kk USING (id) JOIN wt USING (id, unit) WHERE rn <= k GROUP BY rd0.id, b) GROUP BY id)
SELECT method, count(*) AS n, round(avg(top_drop), 6)::DOUBLE AS mean_top, round(avg(random_drop), 6)::DOUBLE AS mean_random, round(avg(top_drop) / greatest(avg(random_drop), 1e-9), 6)::DOUBLE AS ratio FROM td JOIN rd USING (id) GROUP BY method""")
def r10(spark, sf):
    w = units(spark, sf).select("id", "unit", ((draw(1000, 3, F.col("id"), F.col("unit")) - 300) / 1000.0).alias("weight"))
    return T.faithfulness(T.top_unit_drops(unit_scores(spark, sf), w)).drop("w_plus", "p")


@query("r11_count_vs_y", """
WITH d AS (SELECT l.doc_id, log10(n_chars) AS y, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS c, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
r AS (SELECT rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM d WHERE quality IS NOT NULL)
SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM r""")
def r11(spark, sf):
    d = S.table(spark, sf, "documents").join(S.table(spark, sf, "labels"), "doc_id", "left")
    return T.count_vs_y(d.select(F.size(F.regexp_extract_all("text", F.lit("([0-9]+)"))).alias("c"), F.log10("n_chars").alias("y"), "quality"), "c", "y", "quality")
