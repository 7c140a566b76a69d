"""F: features."""
from pyspark.sql import functions as F

from plumbline.functions import features as E
from plumbline.plans import fixtures as X
from plumbline.plans.registry import query
from plumbline.sources import tables as S

def _docs(spark, sf):
    return S.spread(S.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


SHINGLE_SQL = f"""WITH t AS (SELECT doc_id AS id, {X.TOK} AS w FROM documents),
sh AS (SELECT id, unnest(w) AS s FROM t UNION ALL SELECT id, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM t),
bt AS (SELECT id, ('0x' || substr(md5(s), 1, 15))::BIGINT % 2048 AS bit FROM sh)"""


@query("f1_shingle_bits", SHINGLE_SQL + " SELECT id, count(DISTINCT bit) AS n_bits, min(bit) AS lo, max(bit) AS hi, sum(DISTINCT bit)::BIGINT AS total FROM bt GROUP BY id")
def f1(spark, sf):
    b = E.shingle_bits(_docs(spark, sf), "doc_id", "text", 2, 2048)
    return b.select(F.col("doc_id").alias("id"), F.explode("bits").alias("bit")).groupBy("id").agg(
        F.count("*").alias("n_bits"), F.min("bit").alias("lo"), F.max("bit").alias("hi"), F.sum("bit").alias("total")
    )


@query("f2_shingle_counts", SHINGLE_SQL + " SELECT id, bit, count(*) AS n FROM bt GROUP BY ALL")
def f2(spark, sf):
    return E.shingle_counts(_docs(spark, sf), "doc_id", "text", 2, 2048).withColumnRenamed("doc_id", "id")


KEYSET_SQL = "SELECT doc_id AS id, " + " + ".join("regexp_matches(text, '" + p.replace("'", "''") + f"')::BIGINT * {2**i}" for i, (_, p) in enumerate(E.KEY_PATTERNS)) + " AS mask FROM documents"


@query("f3_keyset_bits", KEYSET_SQL)
def f3(spark, sf):
    bits = E.keyset_bits(F.col("text"))
    mask = F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a + F.pow(F.lit(2.0), b).cast("bigint"))
    return _docs(spark, sf).select(F.col("doc_id").alias("id"), mask.alias("mask"))


@query("f4_descriptors", f"""WITH t AS (SELECT doc_id AS id, text, length(text) AS n, {X.TOK} AS w FROM documents)
SELECT id, n AS n_chars, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_types, round(len(list_distinct(w)) / nullif(len(w), 0), 6) AS type_token_ratio,
  round(length(array_to_string(w, '')) / nullif(len(w), 0), 6) AS mean_token_length, """ + ", ".join(
    f"round((n - length(regexp_replace(text, '{p}', '', 'g'))) / nullif(n, 0), 6) AS {c}" for c, p in
    (("digit_share", "[0-9]"), ("upper_share", "[A-Z]"), ("space_share", "[ \\t\\r\\n]"), ("punct_share", "[.,;:!?]"))) + " FROM t")
def f4(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").alias("id"), *[c.alias(n) for n, c in E.descriptors(F.col("text")).items()])


@query("f5_template_key", X.WITH_ENT + " SELECT id, tmpl FROM ent")
def f5(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").alias("id"), E.template_key(F.col("text")).alias("tmpl"))


@query("f6_packed_tanimoto", SHINGLE_SQL + """, d AS (SELECT DISTINCT id, bit FROM bt), n AS (SELECT id, count(*) AS n FROM d GROUP BY id),
c AS (SELECT a.id, count(*) AS c FROM d a JOIN d b ON b.id = a.id + 1 AND a.bit = b.bit GROUP BY a.id)
SELECT x.id, x.n AS n_bits, round(coalesce(c, 0) / greatest(x.n + y.n - coalesce(c, 0), 1), 6) AS sim FROM n x JOIN n y ON y.id = x.id + 1 LEFT JOIN c ON c.id = x.id""")
def f6(spark, sf):
    b = E.shingle_bits(_docs(spark, sf), "doc_id", "text", 2, 2048)
    p = X.settle(E.pack_bits(b, "doc_id", "bits", 2048))
    q = p.select((F.col("id") - 1).alias("id"), F.col("fp").alias("fq"))
    return p.join(q, "id").select("id", E.popcount(F.col("fp")).alias("n_bits"), E.bit_tanimoto(F.col("fp"), F.col("fq")).alias("sim"))


@query("f7_embeddings", "SELECT vec_id AS id, unnest(range(0, 64)) AS pos, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings")
def f7(spark, sf):
    e = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    return S.to_long_features(e)
