"""U and G: set operations and partition builders."""
from pyspark.sql import functions as F

from plumbline.operators import splits as G
from plumbline.operators.selection import union_parts
from plumbline.operators.ranking import distinct_ordered
from plumbline.plans import fixtures as X
from plumbline.plans.clusters import BUTINA_SQL, clusters
from plumbline.plans.registry import query
from plumbline.sources import tables as S

WITH_PRIM = X.WITH_ENT + "," + X.PRIMARY_SQL


@query("u1_union_parts", X.WITH_CELLS + """
SELECT part, key, test_r2, NULL::DOUBLE AS q2 FROM cells WHERE learner = 'Mean' UNION ALL SELECT part, key, NULL, q2 FROM cells WHERE learner <> 'Mean'""")
def u1(spark, sf):
    c = X.cells(spark, sf)
    return union_parts([c.where("learner = 'Mean'").select("part", "key", "test_r2"), None, c.where("learner <> 'Mean'").select("part", "key", "q2")])


@query("u2_complement", WITH_PRIM + " SELECT id FROM prim WHERE split = 'source' AND role = 'train'")
def u2(spark, sf):
    return G.complement(X.entities(spark, sf).select("id"), X.primary(spark, sf).where("split = 'source' and role = 'test'"))


@query("u3_shared_groups", X.WITH_PARTS + """
SELECT design, part, grp FROM parts JOIN ent USING (id) GROUP BY ALL HAVING count(DISTINCT role) = 2""")
def u3(spark, sf):
    return G.shared_groups(X.parts(spark, sf), X.entities(spark, sf).select("id", "grp"), ["design", "part"])


@query("u4_coverage_check", X.WITH_PARTS + """
SELECT design, id, count(*) FILTER (role = 'test') AS times_held_out FROM parts GROUP BY ALL HAVING count(*) FILTER (role = 'test') <> 1""")
def u4(spark, sf):
    return G.coverage_check(X.parts(spark, sf))


@query("u5_distinct_ordered", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def u5(spark, sf):
    return distinct_ordered(S.table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id")


@query("g1_stratified_split", WITH_PRIM + " SELECT id, role FROM prim WHERE split = 'stratified'")
def g1(spark, sf):
    return G.stratified_split(X.entities(spark, sf), "id", "cat", X.PRIMARY_SEED)


@query("g2_group_disjoint_split", X.WITH_ENT + """,
gs AS (SELECT tmpl, count(*) AS n FROM ent GROUP BY tmpl),
gc AS (SELECT tmpl, n, sum(n) OVER (ORDER BY n, md5('42:' || tmpl), tmpl ROWS UNBOUNDED PRECEDING) AS upto FROM gs)
SELECT id, CASE WHEN upto <= round_even((SELECT count(*) FROM ent) * 0.1, 0) OR upto = n THEN 'test' ELSE 'train' END AS role FROM ent JOIN gc USING (tmpl)""")
def g2(spark, sf):
    return G.group_disjoint_split(X.entities(spark, sf), "id", "tmpl", X.PRIMARY_SEED)


@query("g3_source_disjoint_split", WITH_PRIM + " SELECT id, role FROM prim WHERE split = 'source'")
def g3(spark, sf):
    return G.group_disjoint_split(X.entities(spark, sf), "id", "grp", X.PRIMARY_SEED)


@query("g3_cluster_disjoint_split", BUTINA_SQL + """,
ce AS (SELECT home.id, od.id AS cluster FROM home JOIN od ON od.k = h),
gs AS (SELECT cluster, count(*) AS n FROM ce GROUP BY cluster),
gc AS (SELECT cluster, n, sum(n) OVER (ORDER BY n, md5('42:' || cluster), cluster ROWS UNBOUNDED PRECEDING) AS upto FROM gs)
SELECT id, CASE WHEN upto <= round_even((SELECT count(*) FROM ce) * 0.1, 0) OR upto = n THEN 'test' ELSE 'train' END AS role FROM ce JOIN gc USING (cluster)""")
def g3c(spark, sf):
    return G.group_disjoint_split(clusters(spark, sf), "id", "cluster", X.PRIMARY_SEED)


SEEDS25 = list(range(1000, 1025))


@query("g5_repeated_splits", X.WITH_ENT + """,
st AS (SELECT cat, count(*) AS n FROM ent GROUP BY cat),
st2 AS (SELECT cat, ceil(sum(n) OVER () * 0.1 - 1e-9) AS tot, n * ceil(sum(n) OVER () * 0.1 - 1e-9) / sum(n) OVER () AS ideal FROM st),
st3 AS (SELECT cat, floor(ideal) AS base, tot - sum(floor(ideal)) OVER () AS lft, row_number() OVER (ORDER BY round(ideal - floor(ideal), 9) DESC, cat) AS pos FROM st2)
SELECT seed, id, CASE WHEN rn <= base + CASE WHEN pos <= lft THEN 1 ELSE 0 END THEN 'test' ELSE 'train' END AS role FROM (
  SELECT seed, id, cat, row_number() OVER (PARTITION BY seed, cat ORDER BY md5(seed || ':' || id), id) AS rn FROM ent, range(1000, 1025) t(seed))
JOIN st3 USING (cat)""")
def g5(spark, sf):
    return G.repeated_splits(X.entities(spark, sf), "id", "cat", SEEDS25)


@query("g6_stratified_kfold", X.WITH_ENT + """,
strata AS (SELECT cat, coalesce(sum(n) OVER (ORDER BY cat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
           FROM (SELECT cat, count(*) AS n FROM ent GROUP BY cat))
SELECT id, ((rn - 1 + start) % 10)::BIGINT AS fold FROM (SELECT id, cat, row_number() OVER (PARTITION BY cat ORDER BY md5('7:' || id), id) AS rn FROM ent) JOIN strata USING (cat)""")
def g6(spark, sf):
    return G.stratified_kfold(X.entities(spark, sf), "id", "cat", 10, 7)


@query("g7_balanced_group_folds")
def g7(spark, sf):
    return G.balanced_group_folds(X.entities(spark, sf), "id", "tmpl", 10, 7)


@query("g8_kfold", "SELECT o_orderkey AS id, (row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1) % 10 AS fold FROM orders")
def g8(spark, sf):
    return G.kfold(S.table(spark, sf, "orders"), "o_orderkey", 10, 42)


@query("g9_component_folds")
def g9(spark, sf):
    from plumbline.plans.clusters import part_pairs

    nodes = S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return G.component_folds(nodes, "id", part_pairs(spark, sf).select("id_without", "id_with"), 10, 7)


REPL_SQL = X.WITH_ENT + """,
gs AS (SELECT tmpl, count(*) AS n FROM ent GROUP BY tmpl),
gc AS (SELECT seed, tmpl, n, sum(n) OVER (PARTITION BY seed ORDER BY n, md5(seed || ':' || tmpl), tmpl ROWS UNBOUNDED PRECEDING) AS upto FROM gs, range(1, 6) t(seed)),
rep AS (SELECT seed, id, CASE WHEN upto <= round_even((SELECT count(*) FROM ent) * 0.1, 0) OR upto = n THEN 'test' ELSE 'train' END AS role FROM ent JOIN gc USING (tmpl))"""


@X.shared
def replicates(spark, sf):
    return G.replicate_splits(X.entities(spark, sf), "id", "tmpl", [1, 2, 3, 4, 5])


@query("g10_replicate_splits", REPL_SQL + " SELECT * FROM rep")
def g10(spark, sf):
    return replicates(spark, sf)


@query("g10_overlap_with_primary", REPL_SQL + "," + X.PRIMARY_SQL.replace("gs AS", "pgs AS").replace("FROM gs)", "FROM pgs)").replace("gc AS", "pgc AS").replace("JOIN gc", "JOIN pgc") + """
SELECT 'template' AS design, seed, count(*) AS n_test, round(100.0 * count(p.id) / count(*), 6) AS pct_shared_with_primary
FROM rep LEFT JOIN (SELECT id FROM prim WHERE split = 'source' AND role = 'test') p ON p.id = rep.id WHERE role = 'test' GROUP BY seed""")
def g10b(spark, sf):
    r = replicates(spark, sf).withColumn("design", F.lit("template"))
    return G.overlap_with_primary(r, X.primary(spark, sf).where("split = 'source'"), "design", "seed")


@query("j15_partition_overlap", REPL_SQL + """,
h AS (SELECT seed, id FROM rep WHERE role = 'test'), s AS (SELECT seed, count(*) AS n FROM h GROUP BY seed)
SELECT 'template' AS design, a.seed AS part_a, b.seed AS part_b, any_value(a.n) AS n_a, count(x.id) AS n_shared, round(100.0 * count(x.id) / any_value(a.n), 6) AS pct_shared
FROM s a JOIN s b ON a.seed < b.seed LEFT JOIN (SELECT p.seed AS sa, q.seed AS sb, p.id FROM h p JOIN h q USING (id)) x ON x.sa = a.seed AND x.sb = b.seed
GROUP BY a.seed, b.seed""")
def j15(spark, sf):
    return G.partition_overlap(replicates(spark, sf).withColumn("design", F.lit("template")), "design", "seed")


@query("j15_ever_held_out", REPL_SQL + " SELECT 'template' AS design, count(DISTINCT id) AS n_ever_held_out FROM rep WHERE role = 'test'")
def j15b(spark, sf):
    return G.ever_held_out(replicates(spark, sf).withColumn("design", F.lit("template")), "design")


@query("w7_dissimilarity_split", "WITH" + X.TOK_SQL + "," + X.SELF_SQL + """
SELECT id, CASE WHEN row_number() OVER (ORDER BY nn_sim, id) <= greatest(1, round_even(count(*) OVER () * 0.1, 0)) THEN 'test' ELSE 'train' END AS role FROM snn""")
def w7(spark, sf):
    return G.dissimilarity_split(X.self_nn(spark, sf))


CHAR_SQL = X.WITH_NN + """,
pe AS (SELECT * FROM prim JOIN ent USING (id)),
s1 AS (SELECT split, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test, round(avg(y) FILTER (role = 'test'), 6) AS test_mean_y,
         round(stddev_samp(y) FILTER (role = 'test'), 6) AS test_sd_y, round(avg(y) FILTER (role = 'train'), 6) AS train_mean_y, round(stddev_samp(y) FILTER (role = 'train'), 6) AS train_sd_y FROM pe GROUP BY split),
s2 AS (SELECT split, count(*) AS n_test_groups, round(100.0 * sum(CASE WHEN r > 0 THEN t ELSE 0 END) / sum(t), 6) AS pct_group_seen, max(t) AS largest_test_group FROM (
         SELECT split, grp, count(*) FILTER (role = 'test') AS t, count(*) FILTER (role = 'train') AS r FROM pe GROUP BY ALL) WHERE t > 0 GROUP BY split),
s3 AS (SELECT split, round(avg(nn_sim), 6) AS nn_mean, round(100.0 * avg((nn_sim >= 0.7)::INT), 6) AS pct_nn_ge_07, round(100.0 * avg((nn_sim >= 0.4)::INT), 6) AS pct_nn_ge_04,
         round(quantile_cont(nn_sim, 0.5), 6) AS nn_median, round(quantile_cont(nn_sim, 0.1), 6) AS nn_p10, round(quantile_cont(nn_sim, 0.9), 6) AS nn_p90 FROM nn GROUP BY split),
ch AS (SELECT * FROM s1 JOIN s2 USING (split) JOIN s3 USING (split))"""


def characteristics(spark, sf):
    return G.characterise(X.primary(spark, sf), X.primary_nn(spark, sf), X.entities(spark, sf), ["split"])


@query("a12_characterise", CHAR_SQL + " SELECT * FROM ch")
def a12(spark, sf):
    return characteristics(spark, sf)


@query("a12_category_counts", X.WITH_PARTS + " SELECT part, cat, count(*) AS n FROM parts JOIN ent USING (id) WHERE role = 'test' GROUP BY ALL")
def a12b(spark, sf):
    m = G.category_counts(X.parts(spark, sf), X.entities(spark, sf), ["part"])
    return m.select("part", F.explode("test_categories").alias("cat", "n"))


@query("a13_design_summary", X.WITH_PARTS + """,
c AS (SELECT design, part, count(*) FILTER (role = 'test')::DOUBLE AS n_test, round(avg(y) FILTER (role = 'test'), 6) AS mean_y FROM parts JOIN ent USING (id) GROUP BY ALL)
SELECT design, count(*) AS n_parts, min(n_test) AS n_test_min, max(n_test) AS n_test_max, round(avg(n_test), 6) AS n_test_mean,
       min(mean_y) AS mean_y_min, max(mean_y) AS mean_y_max, round(avg(mean_y), 6) AS mean_y_mean FROM c GROUP BY design""")
def a13(spark, sf):
    c = X.parts(spark, sf).join(X.entities(spark, sf), "id").groupBy("design", "part").agg(
        F.count_if(F.col("role") == "test").cast("double").alias("n_test"), F.round(F.avg(F.when(F.col("role") == "test", F.col("y"))), 6).alias("mean_y")
    )
    return G.design_summary(c, "design", ["n_test", "mean_y"])
