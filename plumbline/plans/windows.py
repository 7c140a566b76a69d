"""W: ranking, quantiles, top-k (W7 is with the partitions)."""
from pyspark.sql import functions as F

from plumbline.operators import ranking as W
from plumbline.plans import fixtures as X
from plumbline.plans.registry import query
from plumbline.sources import tables as S


@query("w1_select_best", X.WITH_CELLS + " SELECT part, fam, key, q2 FROM cells QUALIFY row_number() OVER (PARTITION BY part, fam ORDER BY q2 DESC, key) = 1")
def w1(spark, sf):
    return W.select_best(X.cells(spark, sf), ["part", "fam"], "q2", "key").select("part", "fam", "key", "q2")


RANK_SQL = X.WITH_CELLS + """, fb AS (SELECT design, part, fam, max(test_r2) AS r2 FROM cells GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY design, part ORDER BY r2 DESC, fam) AS rank FROM fb)"""


def ranks(spark, sf):
    best = X.cells(spark, sf).groupBy("design", "part", "fam").agg(F.max("test_r2").alias("r2"))
    return W.rank_families(best, ["design", "part"], "r2", "fam")


@query("w2_rank_families", RANK_SQL + " SELECT * FROM rk")
def w2(spark, sf):
    return ranks(spark, sf)


@query("w3_rank_of_mean", RANK_SQL + """, m AS (SELECT design, fam, avg(r2) AS s, avg(rank) AS k FROM rk GROUP BY ALL)
SELECT design, fam, round(s, 6) AS mean_score, round(k, 6) AS mean_rank, row_number() OVER (PARTITION BY design ORDER BY s DESC, fam) AS rank_of_mean_score,
  row_number() OVER (PARTITION BY design ORDER BY k, fam) AS rank_of_mean_rank FROM m""")
def w3(spark, sf):
    return W.rank_of_mean(ranks(spark, sf), ["design"], "fam", "r2", "rank")


@query("w4_average_rank", """
SELECT p_partkey, p_brand, round(rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0, 6)::DOUBLE AS avg_rank FROM part""")
def w4(spark, sf):
    return W.avg_rank(S.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), "p_size", ["p_brand"]).select("p_partkey", "p_brand", "avg_rank")


@query("w5_bh_adjust", """
WITH r AS (SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey, (s_suppkey * 7919 % 997 + 1) / 1000.0 AS p FROM supplier),
k AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY p, s_suppkey) AS rk, count(*) OVER (PARTITION BY s_nationkey) AS m FROM r)
SELECT s_suppkey, s_nationkey, round(p, 6)::DOUBLE AS p, round(least(1.0, min(p * m / rk) OVER (PARTITION BY s_nationkey ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 6)::DOUBLE AS p_adj FROM k""")
def w5(spark, sf):
    r = S.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", ((F.col("s_suppkey") * 7919 % 997 + 1) / 1000.0).alias("p"))
    return W.bh_adjust(r, "p", "s_suppkey", ["s_nationkey"])


@query("w6_top_fraction", """
SELECT o_orderpriority, o_orderkey, rn, k FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn,
  greatest(1, round_even(count(*) OVER (PARTITION BY o_orderpriority) * 0.05, 0))::BIGINT AS k FROM orders) WHERE rn <= k""")
def w6(spark, sf):
    o = S.table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return W.top_fraction(o, "o_totalprice", 0.05, "o_orderkey", ["o_orderpriority"]).drop("o_totalprice")


@query("w8_largest_errors", X.WITH_SLICE + """
SELECT s.id, round(abs(s.y - s.pred), 6) AS abs_err, s.cat, CASE WHEN length(text) > 46 THEN substr(text, 1, 44) || '...' ELSE text END AS text
FROM slice s JOIN ent USING (id) WHERE role = 'test' ORDER BY abs(s.y - s.pred) DESC, s.id LIMIT 12""")
def w8(spark, sf):
    d = S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    s = X.slice_scores(spark, sf).where("role = 'test'").join(d, "id")
    return W.largest_errors(s, 12, "id", "y", "pred", "text").select("id", "abs_err", "cat", "text")


@query("w10_quantile_higher", """
WITH r AS (SELECT l_returnflag AS g, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT g AS l_returnflag, max(v) FILTER (rn = ceil((n - 1) * 0.9 - 1e-9) + 1) AS q0, max(v) FILTER (rn = ceil((n - 1) * 0.8 - 1e-9) + 1) AS q1 FROM r GROUP BY g""")
def w10(spark, sf):
    return W.quantile_higher(S.table(spark, sf, "lineitem"), "l_extendedprice", [0.9, 0.8], ["l_returnflag"])


@query("w11_percentiles", "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS q{i}" for i, q in enumerate((0.025, 0.1, 0.25, 0.9, 0.975, 0.99))) + " FROM lineitem GROUP BY 1")
def w11(spark, sf):
    return W.quantiles(S.table(spark, sf, "lineitem"), "l_extendedprice", [0.025, 0.1, 0.25, 0.9, 0.975, 0.99], ["l_returnflag"])


@query("w12_merge_cells", "SELECT l_orderkey, l_partkey, max_by(l_suppkey, {'d': l_shipdate, 'l': l_linenumber, 's': l_suppkey}) AS l_suppkey FROM lineitem GROUP BY ALL")
def w12(spark, sf):
    li = S.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.struct("l_shipdate", "l_linenumber", "l_suppkey").alias("seq"))
    return W.merge_cells(li, ["l_orderkey", "l_partkey"], "seq").select("l_orderkey", "l_partkey", "l_suppkey")


@query("w13_runner_up", X.WITH_CELLS + " SELECT part, key, q2 FROM cells QUALIFY row_number() OVER (PARTITION BY part ORDER BY q2 DESC, key) = 2")
def w13(spark, sf):
    return W.runner_up(X.cells(spark, sf), ["part"], "q2", "key").select("part", "key", "q2")


@query("w14_rank_counts", RANK_SQL + """
SELECT design, fam, count(*) FILTER (rank = 1) AS n_first, count(*) FILTER (rank <= 3) AS n_top3, count(*) FILTER (rank = 4) AS n_last, round(avg(rank), 6) AS rank_mean, median(rank)::DOUBLE AS rank_median FROM rk GROUP BY ALL""")
def w14(spark, sf):
    return W.rank_counts(ranks(spark, sf), ["design"], "fam", "rank", 4)
