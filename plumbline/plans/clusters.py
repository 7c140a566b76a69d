"""C: graphs and clusters."""
from pyspark.sql import functions as F

from plumbline.operators import geometry as Y
from plumbline.operators import graph as GR
from plumbline.operators.similarity import knn_sets
from plumbline.operators.vectors import knn_vectors
from plumbline.plans import fixtures as X
from plumbline.plans.registry import query
from plumbline.sources import tables as S


def part_units(spark, sf):
    """(id, units): words of name, brand and type of each part."""
    p = S.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.split(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), " ").alias("units"))


@X.shared
def part_pairs(spark, sf):
    return GR.deletion_pairs(part_units(spark, sf), "id", "units")


PAIRS_SQL = """WITH RECURSIVE pu AS (SELECT p_partkey AS id, list_sort(list_distinct(string_split(lower(p_name || ' ' || p_brand || ' ' || p_type), ' '))) AS u FROM part),
pk AS (SELECT array_to_string(u, ' ') AS k, min(id) AS id_without FROM pu GROUP BY 1),
px AS (SELECT id AS id_with, u, unnest(u) AS unit FROM pu),
pc AS (SELECT id_with, unit, array_to_string([x for x in u if x <> unit], ' ') AS k FROM px),
pairs AS (SELECT id_without, id_with, min(unit) AS unit FROM pc JOIN pk USING (k) WHERE id_without <> id_with GROUP BY ALL)"""
COMP_SQL = PAIRS_SQL + """,
ed AS (SELECT id_without AS a, id_with AS b FROM pairs UNION SELECT id_with, id_without FROM pairs),
walk(id, lab) AS (SELECT a, a FROM ed UNION SELECT ed.b, walk.lab FROM walk JOIN ed ON ed.a = walk.id),
comp AS (SELECT id, min(lab) AS component FROM walk GROUP BY id)"""


@X.shared
def part_components(spark, sf):
    return GR.connected_components(part_pairs(spark, sf).select("id_without", "id_with"))


@X.shared
def clusters(spark, sf):
    return GR.butina(X.sets(spark, sf), "id", "els", 0.6)


BUTINA_SQL = "WITH RECURSIVE" + X.TOK_SQL + """,
ov AS (SELECT a.id, b.id AS r, count(*) AS c FROM tok a JOIN tok b ON a.w = b.w AND a.id <> b.id GROUP BY ALL),
nb AS (SELECT ov.id, r FROM ov JOIN sz x ON x.id = ov.id JOIN sz y ON y.id = r WHERE c / (x.n + y.n - c) >= 0.6),
od AS (SELECT doc_id AS id, row_number() OVER (ORDER BY coalesce(d, 0) DESC, doc_id) AS k FROM documents LEFT JOIN (SELECT id, count(*) AS d FROM nb GROUP BY id) n ON n.id = doc_id),
near AS (SELECT od.id, od.k, coalesce(list(o.k) FILTER (o.k IS NOT NULL), []) AS ks FROM od LEFT JOIN nb ON nb.id = od.id LEFT JOIN od o ON o.id = nb.r GROUP BY ALL),
walk(k, cent) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT near.k, CASE WHEN list_has_any(ks, cent) THEN cent ELSE list_append(cent, near.k) END FROM walk JOIN near ON near.k = walk.k + 1),
fin AS (SELECT cent FROM walk ORDER BY k DESC LIMIT 1),
home AS (SELECT id, CASE WHEN list_contains(cent, k) THEN k ELSE list_min(list_intersect(ks, cent)) END AS h FROM near, fin)"""


@query("c1_butina", BUTINA_SQL + " SELECT home.id, od.id AS cluster, home.id = od.id AS is_centroid FROM home JOIN od ON od.k = h")
def c1(spark, sf):
    return clusters(spark, sf)


@query("c2_connected_components", COMP_SQL + " SELECT id, component FROM comp")
def c2(spark, sf):
    return part_components(spark, sf)


@query("c3_component_report", COMP_SQL + """, s AS (SELECT component, count(*) AS n FROM comp GROUP BY 1)
SELECT (SELECT count(*) FROM pairs) AS n_pairs, sum(n)::BIGINT AS n_entities, count(*) AS n_components, max(n) AS largest_component, count(*) FILTER (n > 2) AS n_larger_than_two FROM s""")
def c3(spark, sf):
    return GR.component_report(part_pairs(spark, sf), "id_without", "id_with", part_components(spark, sf))


SIL_SQL = "WITH" + X.TOK_SQL + """,
ps AS (SELECT a.id, b.id AS r, count(*) AS c FROM tok a JOIN tok b ON a.w = b.w AND a.id <> b.id GROUP BY ALL),
d AS (SELECT doc_id AS id, lang FROM documents), nl AS (SELECT lang, count(*) AS n FROM d GROUP BY lang),
sl AS (SELECT ps.id, d.lang, sum(c / (x.n + y.n - c)) AS s FROM ps JOIN sz x ON x.id = ps.id JOIN sz y ON y.id = r JOIN d ON d.id = r GROUP BY ALL),
md AS (SELECT d.id, d.lang AS own, nl.lang, CASE WHEN d.lang = nl.lang THEN 1 - coalesce(s, 0) / (nl.n - 1) ELSE 1 - coalesce(s, 0) / nl.n END AS dist
       FROM d CROSS JOIN nl LEFT JOIN sl ON sl.id = d.id AND sl.lang = nl.lang),
ab AS (SELECT id, own, max(dist) FILTER (own = lang) AS a, min(dist) FILTER (own <> lang) AS b FROM md GROUP BY ALL)"""


@query("c4_silhouette_jaccard", SIL_SQL + " SELECT own AS label, count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab GROUP BY own")
def c4(spark, sf):
    labels = X.entities(spark, sf).select("id", "cat")
    return Y.silhouette_sets(X.sets(spark, sf), "id", "els", "cat", labels=labels).groupBy("label").agg(F.count("*").alias("n"), F.avg("silhouette").alias("silhouette"))


@query("c4_silhouette_euclidean", """
WITH p AS (SELECT a.vec_id AS id, a.label AS own, b.label, avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS dist
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY ALL),
ab AS (SELECT id, own, max(dist) FILTER (own = label) AS a, min(dist) FILTER (own <> label) AS b FROM p GROUP BY ALL)
SELECT own::BIGINT AS label, count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab GROUP BY own""")
def c4e(spark, sf):
    s = Y.silhouette_vectors(S.table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return s.groupBy(F.col("label").cast("bigint").alias("label")).agg(F.count("*").alias("n"), F.avg("silhouette").alias("silhouette"))


@query("c5_knn_preservation", """
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, [list_sum(embedding[g * 8 + 1 : g * 8 + 8]::DOUBLE[]) FOR g IN range(8)] AS f FROM embeddings),
hi AS (SELECT a.id, b.id AS nbr FROM v a JOIN v b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.e, b.e), 9), b.id) <= 15),
lo AS (SELECT a.id, b.id AS nbr FROM v a JOIN v b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.f, b.f), 9), b.id) <= 15)
SELECT round(count(*) / 15.0 / (SELECT count(*) FROM v), 6) AS preservation FROM hi JOIN lo USING (id, nbr)""")
def c5(spark, sf):
    """Neighbours kept by a projection of all 64 values: sums over eight blocks of eight."""
    v = S.table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    block = lambda g: F.aggregate(F.slice("embedding", g * 8 + 1, F.lit(8)), F.lit(0.0), lambda a, x: a + x)
    projected = v.withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(7)), block))
    return Y.knn_preservation(v, projected, "vec_id", "embedding", 15)


@query("c5_sets_against_vectors", "WITH" + X.TOK_SQL + """,
bo AS (SELECT doc_id AS id, embedding::DOUBLE[] AS e FROM documents JOIN embeddings ON vec_id = doc_id),
ps AS (SELECT a.id, b.id AS nbr, count(*) AS c FROM tok a JOIN tok b ON a.w = b.w AND a.id <> b.id WHERE a.id IN (SELECT id FROM bo) AND b.id IN (SELECT id FROM bo) GROUP BY ALL),
pr AS (SELECT a.id, b.id AS nbr, round(list_distance(a.e, b.e), 9) AS d, coalesce(c / (x.n + y.n - c), 0) AS s
       FROM bo a JOIN bo b ON a.id <> b.id LEFT JOIN ps ON ps.id = a.id AND ps.nbr = b.id LEFT JOIN sz x ON x.id = a.id LEFT JOIN sz y ON y.id = b.id),
rk AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY s DESC, nbr) AS rs, row_number() OVER (PARTITION BY id ORDER BY d, nbr) AS rd FROM pr)
SELECT count(DISTINCT id) AS n, count(*) FILTER (rs <= 15 AND rd <= 15) AS kept, round(count(*) FILTER (rs <= 15 AND rd <= 15) / (15 * count(DISTINCT id)), 6) AS preservation FROM rk""")
def c5s(spark, sf):
    """Neighbours by token sets (Jaccard) that are neighbours by embedding (Euclidean): documents and vectors mapped by id."""
    v = S.table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    ids = S.table(spark, sf, "documents").join(v, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("a_id"), F.col("vec_id").alias("b_id"))
    sets = X.sets(spark, sf).join(ids.select(F.col("a_id").alias("id")), "id")
    vectors = v.join(ids.select(F.col("b_id").alias("vec_id")), "vec_id")
    return Y.neighbours_kept(knn_sets(sets, "id", "els", 15), knn_vectors(vectors, "vec_id", "embedding", 15), 15, ids)


@query("c6_landscape", "WITH" + X.TOK_SQL + "," + X.ENT_SQL + """,
ps AS (SELECT a.id, b.id AS nbr, count(*) AS c FROM tok a JOIN tok b ON a.w = b.w AND a.id <> b.id GROUP BY ALL),
knn AS (SELECT a.id, b.id AS nbr FROM ent a JOIN ent b ON a.id <> b.id LEFT JOIN ps ON ps.id = a.id AND ps.nbr = b.id LEFT JOIN sz x ON x.id = a.id LEFT JOIN sz y ON y.id = b.id
        QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY coalesce(c / (x.n + y.n - c), 0) DESC, b.id) <= 5),
near AS (SELECT knn.id, avg(abs(b.y - a.y)) AS gap FROM knn JOIN ent a ON a.id = knn.id JOIN ent b ON b.id = nbr GROUP BY ALL),
pos AS (SELECT id, y, row_number() OVER (ORDER BY id) - 1 AS pos FROM ent),
rnd AS (SELECT a.id, avg(abs(b.y - a.y)) AS gap FROM pos a, range(5) t(slot) JOIN pos b
        ON b.pos = ('0x' || substr(md5('7:' || a.id || ':' || slot), 1, 8))::BIGINT % (SELECT count(*) FROM ent) GROUP BY ALL)
SELECT count(*) AS n, round(avg(near.gap), 6) AS near_gap, round(avg(rnd.gap), 6) AS random_gap FROM near JOIN rnd USING (id)""")
def c6(spark, sf):
    from plumbline.plans.joins import knn5

    return Y.landscape(X.entities(spark, sf), knn5(spark, sf), 5, 7).select("n", "near_gap", "random_gap")


@query("c6_landscape_test")
def c6t(spark, sf):
    from plumbline.plans.joins import knn5

    return Y.landscape(X.entities(spark, sf), knn5(spark, sf), 5, 7)


@query("c7_top_dispersion", "WITH" + X.TOK_SQL + "," + X.ENT_SQL + """,
hi AS (SELECT * FROM ent WHERE y >= (SELECT quantile_cont(y, 0.9) FROM ent)),
ht AS (SELECT id, w, n FROM tok JOIN sz USING (id) WHERE id IN (SELECT id FROM hi)),
ps AS (SELECT a.id, b.id AS r, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM ht a JOIN ht b ON a.w = b.w AND a.id <> b.id GROUP BY a.id, b.id),
nn AS (SELECT hi.id, coalesce(max(c / (na + nb - c)), 0) AS s FROM hi LEFT JOIN ps USING (id) GROUP BY hi.id)
SELECT (SELECT count(*) FROM hi) AS n_top, round((SELECT median(s) FROM nn), 6) AS median_nn_sim, (SELECT count(DISTINCT grp) FROM hi) AS n_groups, (SELECT count(DISTINCT cat) FROM hi) AS n_categories""")
def c7(spark, sf):
    return Y.top_dispersion(X.entities(spark, sf), X.sets(spark, sf))
