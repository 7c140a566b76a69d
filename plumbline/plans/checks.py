"""K: claims and stored results."""
from pyspark.sql import functions as F

from plumbline.operators import checks as K
from plumbline.plans import fixtures as X
from plumbline.plans.inference import ROWS_SQL, row_scores
from plumbline.operators.inference import bootstrap_ci
from plumbline.operators.metrics import null_model
from plumbline.operators.splits import coverage_check, shared_groups
from plumbline.plans.registry import query
from plumbline.sources import tables as S


def claims(spark, sf):
    c, parts, e = X.cells(spark, sf), X.parts(spark, sf), X.entities(spark, sf)
    shared = shared_groups(parts.where("design = 'source'"), e.select("id", "grp"), ["part"])
    null = c.join(null_model(X.scored(spark, sf), ["part"]), "part")
    mean_of = lambda k: F.avg(F.when(F.col("key") == k, F.col("test_r2")))
    return K.run_claims([
        K.claim("every document is held out once by each design", coverage_check(parts), F.count("*") == 0, F.count("*")),
        K.claim("the source design shares no source", shared, F.count("*") == 0, F.count("*")),
        K.claim("log length beats length on average", c, mean_of("loglength | Line") > mean_of("length | Line"), F.count("*")),
        K.claim("the source mean helps on unseen sources", c.where("design = 'source'"), F.max(F.when(F.col("key") == "source | Mean", F.col("test_r2"))) > 0, F.count("*")),
        K.claim("every cell beats the training mean", null, F.bool_and(F.col("test_rmse") < F.col("null_rmse")), F.count_if(F.col("test_rmse") < F.col("null_rmse"))),
    ])


NULLS = X.WITH_CELLS + "," + X.PARTS_SQL + """,
nm AS (SELECT part, avg(y) AS m FROM (SELECT DISTINCT part, id, y FROM preds WHERE role = 'train') GROUP BY part),
nul AS (SELECT part, sqrt(avg(power(y - m, 2))) AS null_rmse FROM (SELECT DISTINCT part, id, y FROM preds WHERE role = 'test') JOIN nm USING (part) GROUP BY part),
cl AS (
 SELECT 'every document is held out once by each design' AS name, count(*) = 0 AS ok, count(*)::VARCHAR AS detail FROM (SELECT design, id FROM parts GROUP BY ALL HAVING count(*) FILTER (role = 'test') <> 1)
 UNION ALL SELECT 'the source design shares no source', count(*) = 0, count(*)::VARCHAR FROM (SELECT part, grp FROM parts JOIN ent USING (id) WHERE design = 'source' GROUP BY ALL HAVING count(DISTINCT role) = 2)
 UNION ALL SELECT 'log length beats length on average', avg(test_r2) FILTER (key = 'loglength | Line') > avg(test_r2) FILTER (key = 'length | Line'), count(*)::VARCHAR FROM cells
 UNION ALL SELECT 'the source mean helps on unseen sources', max(test_r2) FILTER (key = 'source | Mean') > 0, count(*)::VARCHAR FROM cells WHERE design = 'source'
 UNION ALL SELECT 'every cell beats the training mean', bool_and(test_rmse < null_rmse), (count(*) FILTER (test_rmse < null_rmse))::VARCHAR FROM cells JOIN nul USING (part))"""


@query("k1_run_claims", NULLS + " SELECT name, ok, CASE WHEN ok THEN 'HOLDS' ELSE 'FAILS' END AS verdict, detail FROM cl")
def k1(spark, sf):
    return claims(spark, sf)


@query("k1_failures", NULLS + " SELECT count(*) AS n_failures FROM cl WHERE NOT ok")
def k1f(spark, sf):
    return K.failures(claims(spark, sf)).agg(F.count("*").alias("n_failures"))


@query("k2_spans_zero", ROWS_SQL + " SELECT design, model, quantile_cont(r2, 0.025) <= 0 AND quantile_cont(r2, 0.975) >= 0 AS spans_zero FROM br GROUP BY ALL")
def k2(spark, sf):
    ci = bootstrap_ci(row_scores(spark, sf), ["design"])
    return ci.select("design", "model", K.spans_zero(F.col("r2_lo"), F.col("r2_hi")).alias("spans_zero"))


@query("k3_pending", "SELECT DISTINCT p_brand, p_type FROM part WHERE (p_brand, p_type) NOT IN (SELECT p_brand, p_type FROM part WHERE p_size > 40)")
def k3(spark, sf):
    p = S.table(spark, sf, "part")
    return K.pending(p.select("p_brand", "p_type").distinct(), p.where("p_size > 40"), ["p_brand", "p_type"])


@query("k4_missing_inputs", "SELECT 'doc_' || doc_id AS name, source AS producer FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k4(spark, sf):
    want = S.table(spark, sf, "documents").select(F.format_string("doc_%d", "doc_id").alias("name"), F.col("source").alias("producer"))
    return K.missing_inputs(want, S.table(spark, sf, "labels").select(F.format_string("doc_%d", "doc_id").alias("name")))


@query("k5_value_changes", """
WITH o AS (SELECT p_partkey AS name, p_retailprice AS v FROM part WHERE p_size <= 40), n AS (SELECT p_partkey AS name, CASE WHEN p_size % 3 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS v FROM part WHERE p_size >= 5)
SELECT coalesce(o.name, n.name) AS name, round(o.v, 6) AS old, round(n.v, 6) AS new, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.name = n.name WHERE o.name IS NULL OR n.name IS NULL OR o.v IS DISTINCT FROM n.v""")
def k5(spark, sf):
    p = S.table(spark, sf, "part").withColumn("name", F.col("p_partkey")).withColumn("value", F.col("p_retailprice"))
    new = p.where("p_size >= 5").withColumn("value", F.when(F.col("p_size") % 3 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return K.value_changes(p.where("p_size <= 40"), new)


@query("k6_merge_done", "SELECT p_partkey, p_brand, CASE WHEN p_size >= 20 THEN 'new' ELSE 'old' END AS state FROM part WHERE p_size <= 30 OR p_size >= 20")
def k6(spark, sf):
    p = S.table(spark, sf, "part")
    old = p.where("p_size <= 30").select("p_partkey", "p_brand", F.lit("old").alias("state"))
    new = p.where("p_size >= 20").select("p_partkey", "p_brand", F.lit("new").alias("state"))
    return K.merge_done(old, new, ["p_partkey"])
