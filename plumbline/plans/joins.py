"""J: joins. Pair joins are with the pair queries, overlap of partitions with the partitions."""
from pyspark.sql import functions as F

from plumbline.operators import attribution as T
from plumbline.operators import minhash as H
from plumbline.operators import selection as L
from plumbline.operators import similarity as J
from plumbline.operators.graph import deletion_pairs
from plumbline.operators.models import bin_lookup
from plumbline.operators.pairs import combined_predictions, pair_exposure
from plumbline.operators.vectors import knn_vectors
from plumbline.plans import fixtures as X
from plumbline.plans.clusters import PAIRS_SQL, part_pairs, part_units
from plumbline.plans.registry import query
from plumbline.sources import tables as S


@query("j1_attach_attributes", X.WITH_PARTS + " SELECT part, role, cat, count(*) AS n, round(avg(y), 6) AS mean_y FROM parts JOIN ent USING (id) GROUP BY ALL")
def j1(spark, sf):
    return X.parts(spark, sf).join(X.entities(spark, sf), "id").groupBy("part", "role", "cat").agg(F.count("*").alias("n"), F.avg("y").alias("mean_y"))


@query("j2_with_predictions", X.WITH_CELLS + " SELECT part, key FROM cells WHERE (part, key) IN (SELECT part, model FROM preds WHERE role = 'test' AND model LIKE '%Mean')")
def j2(spark, sf):
    p = X.held_out(spark, sf).where(F.col("model").endswith("Mean")).withColumnRenamed("model", "key")
    return L.with_predictions(X.cells(spark, sf), p, ["part", "key"]).select("part", "key")


@query("j3_eligible", X.WITH_CELLS + " SELECT part, key FROM cells WHERE NOT contains(lower(fam), 'hyb') AND NOT contains(lower(fam), 'desc')")
def j3(spark, sf):
    return L.eligible(X.cells(spark, sf), ["Hyb", "desc"], family="fam").select("part", "key")


@query("j4_deletion_pairs", PAIRS_SQL + " SELECT * FROM pairs")
def j4(spark, sf):
    return deletion_pairs(part_units(spark, sf), "id", "units")


SPANS_SQL = """WITH RECURSIVE t0 AS (SELECT doc_id AS id, string_split(text, ' ') AS p, length(text) AS n FROM documents),
t1 AS (SELECT id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM t0),
tk AS (SELECT id, i - 1 AS tok, w, coalesce(sum(length(w) + 1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM t1),
tokens AS (SELECT id, tok, a, (a + length(w))::BIGINT AS b FROM tk),
units AS (SELECT id, u AS unit, u * 200 AS s, least((u + 1) * 200, n) AS e FROM t0, LATERAL (SELECT unnest(range(0, ceil(n / 200)::BIGINT)) AS u)),
ovl AS (SELECT t.id, tok, unit FROM tokens t JOIN units u ON t.id = u.id AND a < b AND a < e AND s < b)"""


@query("j5_span_overlap_join", SPANS_SQL + " SELECT id, unit, count(*) AS n_tokens, min(tok) AS first_tok, max(tok) AS last_tok FROM ovl GROUP BY ALL")
def j5(spark, sf):
    d = S.table(spark, sf, "documents").withColumn("n", F.length("text"))
    ovl = T.span_overlap_join(T.token_spans(d, "doc_id", "text"), T.windows_of(d, "doc_id", "n", 200))
    return ovl.groupBy("id", "unit").agg(F.count("*").alias("n_tokens"), F.min("tok").alias("first_tok"), F.max("tok").alias("last_tok"))


@query("j6_bin_lookup", "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'middle' ELSE 'large' END AS label FROM orders")
def j6(spark, sf):
    bins = spark.createDataFrame([(0.0, 5e4, "small"), (5e4, 2e5, "middle"), (2e5, 1e300, "large")], "lo double, hi double, label string")
    return bin_lookup(S.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), bins, "o_totalprice").select("o_orderkey", "label")


J7_SQL = "WITH" + X.TOK_SQL + """,
sg AS (SELECT id, md5(string_agg(w, chr(1) ORDER BY w)) AS sig, count(*) AS n FROM tok GROUP BY id),
rp AS (SELECT sig, min(id) AS rid, count(*) AS copies, any_value(n) AS n FROM sg GROUP BY sig),
rt AS (SELECT rid, w FROM rp JOIN tok ON tok.id = rid),
ov AS (SELECT a.rid AS q, b.rid AS r, count(*) AS c FROM rt a JOIN rt b ON a.w = b.w AND a.rid < b.rid GROUP BY ALL),
sim AS (SELECT q AS id_a, r AS id_b, x.copies AS copies_a, y.copies AS copies_b, round(c / (x.n + y.n - c), 6) AS sim
        FROM ov JOIN rp x ON x.rid = q JOIN rp y ON y.rid = r WHERE c / (x.n + y.n - c) >= 0.4)"""


@query("j7_tanimoto_join", J7_SQL + " SELECT * FROM sim")
def j7(spark, sf):
    return J.tanimoto_join(X.sets(spark, sf), None, "id", "els", 0.4)


@X.shared
def likely_similar(spark, sf):
    return H.minhash_join(X.sets(spark, sf), None, "id", "els", 0.4)


@query("j7_minhash_join")
def j7m(spark, sf):
    return likely_similar(spark, sf)


@query("j7_minhash_recall", J7_SQL + " SELECT copies_a > 1 OR copies_b > 1 AS has_copies, count(*) AS n_exact, 0::BIGINT AS n_wrong, true AS recall_is_90_percent FROM sim GROUP BY 1")
def j7r(spark, sf):
    """The approximate join held against the exact one: pairs it should not return, and whether 90% are found."""
    exact, found = J.tanimoto_join(X.sets(spark, sf), None, "id", "els", 0.4), likely_similar(spark, sf)
    both = exact.withColumn("e", F.lit(1)).join(found.withColumn("f", F.lit(1)), exact.columns, "full")
    n = both.groupBy(((F.col("copies_a") > 1) | (F.col("copies_b") > 1)).alias("has_copies")).agg(
        F.count("e").alias("n_exact"), F.count_if(F.col("e").isNull()).alias("n_wrong"), F.count_if(F.col("f").isNotNull() & F.col("e").isNotNull()).alias("n"))
    return n.select("has_copies", "n_exact", "n_wrong", (F.col("n") >= 0.9 * F.col("n_exact")).alias("recall_is_90_percent"))


@query("j10_minhash_knn")
def j10m(spark, sf):
    return H.minhash_knn(X.sets(spark, sf), "id", "els", 5, 0.3)


@query("j8_nn_similarity", X.WITH_NN + " SELECT split, id, nn_sim, nn_id FROM nn")
def j8(spark, sf):
    return X.primary_nn(spark, sf)


@query("j8_benchmark_nn", f"""WITH b AS (SELECT item_id AS id, unnest(list_distinct({X.TOK})) AS w FROM benchmark), bn AS (SELECT id, count(*) AS n FROM b GROUP BY id),""" + X.TOK_SQL + """,
ov AS (SELECT b.id, tok.id AS r, count(*) AS c FROM b JOIN tok USING (w) GROUP BY ALL)
SELECT bn.id, round(coalesce(max(c / (bn.n + sz.n - c)), 0), 6) AS nn_sim, arg_max(r, {'s': c / (bn.n + sz.n - c), 'i': -r}) AS nn_id
FROM bn LEFT JOIN ov ON ov.id = bn.id LEFT JOIN sz ON sz.id = r GROUP BY bn.id""")
def j8b(spark, sf):
    from plumbline.functions.features import token_set

    b = S.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), token_set(F.col("text")).alias("els"))
    return J.nn_similarity(b, X.sets(spark, sf), "id", "els")


@query("j9_self_nn_similarity", "WITH" + X.TOK_SQL + "," + X.SELF_SQL + " SELECT id, nn_sim, nn_id FROM snn")
def j9(spark, sf):
    return X.self_nn(spark, sf)


KNN_SQL = "WITH" + X.TOK_SQL + """,
ps AS (SELECT a.id, b.id AS nbr, count(*) AS c FROM tok a JOIN tok b ON a.w = b.w AND a.id <> b.id GROUP BY ALL),
dd AS (SELECT doc_id AS id FROM documents),
sm AS (SELECT a.id, b.id AS nbr, coalesce(c / (x.n + y.n - c), 0) AS sim FROM dd a JOIN dd b ON a.id <> b.id LEFT JOIN ps ON ps.id = a.id AND ps.nbr = b.id LEFT JOIN sz x ON x.id = a.id LEFT JOIN sz y ON y.id = b.id),
knn AS (SELECT id, nbr, sim, row_number() OVER (PARTITION BY id ORDER BY sim DESC, nbr) AS rank FROM sm QUALIFY rank <= 5)"""


@X.shared
def knn5(spark, sf):
    return J.knn_sets(X.sets(spark, sf), "id", "els", 5)


@query("j10_knn_jaccard", KNN_SQL + " SELECT id, rank, nbr, round(sim, 6) AS sim FROM knn")
def j10(spark, sf):
    return knn5(spark, sf)


@query("j10_knn_euclidean", """
SELECT id, rank, nbr, round(d, 5) AS dist FROM (
  SELECT a.vec_id AS id, b.vec_id AS nbr, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 15""")
def j10e(spark, sf):
    return knn_vectors(S.table(spark, sf, "embeddings"), "vec_id", "embedding", 15).withColumn("dist", F.round("dist", 5))


@query("j11_seen_flag", X.WITH_ENT + "," + X.PRIMARY_SQL + """
SELECT a.id, b.id IS NOT NULL AS seen FROM prim a LEFT JOIN (SELECT id FROM prim WHERE split = 'source' AND role = 'train') b ON a.id = b.id WHERE a.split = 'stratified' AND a.role = 'test'""")
def j11(spark, sf):
    p = X.primary(spark, sf)
    return seen_flag(p.where("split = 'stratified' and role = 'test'").select("id"), p.where("split = 'source' and role = 'train'"))


def seen_flag(test, other_train):
    """(…, seen): is a held-out id in another fit's training rows?"""
    other = other_train.select("id").distinct().withColumn("_s", F.lit(True))
    return test.join(other, "id", "left").select(*test.columns, F.col("_s").isNotNull().alias("seen"))


EXPO_SQL = PAIRS_SQL + """,
pf AS (SELECT p_partkey AS id, (rn - 1) % 10 AS f10, CASE WHEN (rn - 1) % 10 = 0 THEN 'test' ELSE 'train' END AS role FROM (
  SELECT p_partkey, row_number() OVER (ORDER BY md5('5:' || p_partkey), p_partkey) AS rn FROM part)),
ex AS (SELECT (CASE WHEN a.role = 'test' THEN b.role = 'train' WHEN b.role = 'test' THEN false ELSE a.f10 <> b.f10 END)::INT
            + (CASE WHEN b.role = 'test' THEN a.role = 'train' WHEN a.role = 'test' THEN false ELSE a.f10 <> b.f10 END)::INT AS seen
       FROM pairs JOIN pf a ON a.id = id_without JOIN pf b ON b.id = id_with)"""


def part_folds(spark, sf):
    from plumbline.operators.splits import kfold

    f = kfold(S.table(spark, sf, "part"), "p_partkey", 10, 5)
    return f.withColumn("role", F.when(F.col("fold") == 0, "test").otherwise("train"))


@query("j12_pair_exposure", EXPO_SQL + """
SELECT count(*) AS n_pairs, count(*) FILTER (seen = 2) AS both, count(*) FILTER (seen = 1) AS one, count(*) FILTER (seen = 0) AS neither,
       round(100.0 * count(*) FILTER (seen > 0) / count(*), 6) AS pct_pairs_exposed, round(100.0 * sum(seen) / (2 * count(*)), 6) AS pct_predictions_exposed FROM ex""")
def j12(spark, sf):
    return pair_exposure(part_pairs(spark, sf), part_folds(spark, sf))


@query("j13_combined_predictions", X.WITH_PREDS + """
SELECT id, y, min_by(pred, s) AS pred FROM (
  SELECT ent.id, round(ent.y, 6) AS y, pred, CASE role WHEN 'train' THEN 0 ELSE 1 END AS s FROM ent LEFT JOIN preds p ON p.id = ent.id AND part = 'source_f00' AND model = 'lang | Mean') GROUP BY id, y""")
def j13(spark, sf):
    p = X.predictions(spark, sf).where("part = 'source_f00' and model = 'lang | Mean'")
    e = X.entities(spark, sf).select("id", "y")
    return combined_predictions(e, p.where("role = 'train'"), p.where("role = 'test'"))


@query("j14_model_pairs", X.WITH_PREDS + """
SELECT a.design, a.model AS model_a, b.model AS model_b, count(*) AS n, round(avg(abs(a.y - a.pred) - abs(b.y - b.pred)), 6) AS mean_gap
FROM preds a JOIN preds b ON a.design = b.design AND a.id = b.id AND a.model < b.model AND a.role = 'test' AND b.role = 'test' GROUP BY ALL""")
def j14(spark, sf):
    p = X.held_out(spark, sf)
    j = L.paired_errors(p, L.model_pairs(p), ["design"])
    return j.groupBy("design", "model_a", "model_b").agg(F.count("*").alias("n"), F.avg(F.col("err_a") - F.col("err_b")).alias("mean_gap"))
