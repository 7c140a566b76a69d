"""P: projections, filters, predicates."""
from pyspark.sql import functions as F

from plumbline.functions import scalars as C
from plumbline.operators import audit as A
from plumbline.operators import selection as L
from plumbline.operators.metrics import similarity_bin
from plumbline.operators.pairs import pair_deltas
from plumbline.plans import fixtures as X
from plumbline.plans.registry import query
from plumbline.sources import tables as S


@query("p1_unit_transform", """
SELECT p_partkey, round(power(10.0, -log10(p_retailprice)) * 1e6, 6) AS micro, round(-log10(power(10.0, -log10(p_retailprice))), 6) AS neglog,
       round((SELECT log10(max(p_retailprice) / min(p_retailprice)) FROM part), 6) AS orders_of_magnitude FROM part""")
def p1(spark, sf):
    p = S.table(spark, sf, "part").withColumn("x", F.log10("p_retailprice"))
    ends = p.agg(C.orders_between(F.min("p_retailprice"), F.max("p_retailprice"))).scalar()
    return p.select("p_partkey", C.to_linear(F.col("x"), 1e6).alias("micro"), C.to_neglog(C.to_linear(F.col("x"))).alias("neglog"), ends.alias("orders_of_magnitude"))


KEYS_SQL = rf"""
k0 AS (SELECT doc_id AS id, text, md5(array_to_string(list_sort(list_distinct({X.TOK})), ' ')) AS h,
              trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g'), ' ') AS key_folded, log10(n_chars) AS y FROM documents),
ks AS (SELECT id, y, text AS key_raw, key_folded, substr(h, 1, 14) || '-' || substr(h, 15, 10) || '-' || substr(h, 25, 8) AS key_hash,
              substr(h, 1, 14) AS key_block FROM k0)"""


@query("p2_norm_keys", "WITH" + KEYS_SQL + " SELECT id, md5(key_raw) AS key_raw, md5(key_folded) AS key_folded, key_hash, key_block FROM ks")
def p2(spark, sf):
    d = A.norm_keys(S.table(spark, sf, "documents"), "text")
    return d.select(F.col("doc_id").alias("id"), F.md5("key_raw").alias("key_raw"), F.md5("key_folded").alias("key_folded"), "key_hash", "key_block")


@query("p3_contains_share", """
SELECT t AS term, count(*) FILTER (contains(lower(text), lower(t))) AS n, round(avg(contains(lower(text), lower(t))::INT), 6) AS share
FROM documents, (SELECT unnest(['The', 'tion', '30', 'http']) AS t) GROUP BY t""")
def p3(spark, sf):
    return A.contains_share(S.table(spark, sf, "documents"), "text", ["The", "tion", "30", "http"])


@query("p4_window_wording", r"""
WITH w AS (SELECT conv_id, turn, regexp_matches(text, '(?i)\b\d+\s*to\s*\d+\s*(min|mins|minute|minutes|hr|hrs|hour|hours)\b|\bup to\s*\d+\s*(min|mins|minute|minutes|hr|hrs|hour|hours)\b') AS windowed FROM conversations)
SELECT windowed, count(*) AS n FROM w GROUP BY windowed""")
def p4(spark, sf):
    w = S.table(spark, sf, "conversations").select(A.window_wording(F.col("text")).alias("windowed"))
    return w.groupBy("windowed").agg(F.count("*").alias("n"))


@query("p5_sensitivity_subset", X.WITH_ENT + "," + X.PRIMARY_SQL + """
SELECT split, role, count(*) AS n_full, count(*) FILTER (NOT regexp_matches(text, '[0-9]')) AS n_kept FROM prim JOIN ent USING (id) GROUP BY split, role""")
def p5(spark, sf):
    p = X.primary(spark, sf)
    flags = S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").rlike("[0-9]").alias("flag"))
    return A.subset_counts(p, A.sensitivity_subset(p, flags), ["split"])


RULES = (("symbols", [r"[#$%&*]{3,}"]), ("table", [r" \| "]), ("numbers", [r"[0-9]{2,}", r"\b[0-9]\b"]), ("accents", ["[éèêç]", "[äöüß]"]))


@query("p6_category_cascade", r"""
SELECT CASE WHEN regexp_matches(text, '[#$%&*]{3,}') THEN 'symbols' WHEN regexp_matches(text, ' \| ') THEN 'table'
            WHEN regexp_matches(text, '[0-9]{2,}') OR regexp_matches(text, '\b[0-9]\b') THEN 'numbers'
            WHEN regexp_matches(text, '[éèêç]') OR regexp_matches(text, '[äöüß]') THEN 'accents' ELSE 'Other' END AS category, count(*) AS n
FROM documents GROUP BY 1""")
def p6(spark, sf):
    return S.table(spark, sf, "documents").select(A.cascade(F.col("text"), RULES).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("p7_qc_report", r"""
SELECT count(*) AS n_records, count(*) FILTER (length(trim(text)) > 0) AS n_usable, count(*) FILTER (contains(text, chr(10))) AS n_multi_part,
       count(*) FILTER (regexp_matches(text, '[#$%&*]{3,}')) AS n_symbol_run,
       count(*) FILTER (regexp_matches(regexp_replace(lower(text), '[a-z]', '', 'g'), '\p{L}')) AS n_outside_alphabet,
       count(*) FILTER (regexp_matches(text, '[0-9]')) AS n_has_digits FROM documents""")
def p7(spark, sf):
    return A.qc_report(A.qc_flags(S.table(spark, sf, "documents"), "text"))


@query("p8_family_key", X.WITH_CELLS + """, c AS (
  SELECT key, rep, CASE fam WHEN 'Cat' THEN 'Fingerprint baseline' WHEN 'Src' THEN 'Descriptor baseline' WHEN 'Hyb' THEN 'Hybrid' ELSE 'Unlisted' END AS family FROM cells)
SELECT key, CASE WHEN family = 'Fingerprint baseline' THEN 'Fp' WHEN family = 'Descriptor baseline' THEN 'Desc'
  WHEN family = 'Hybrid' THEN CASE WHEN regexp_matches(rep, 'ChemBERTa|MoLFormer') THEN 'HybClm' ELSE 'Hyb' END END AS family_key, count(*) AS n FROM c GROUP BY ALL""")
def p8(spark, sf):
    c = X.cells(spark, sf)
    fam = F.when(F.col("fam") == "Cat", "Fingerprint baseline").when(F.col("fam") == "Src", "Descriptor baseline").when(
        F.col("fam") == "Hyb", "Hybrid").otherwise("Unlisted")
    return c.withColumn("family", fam).select("key", L.family_key(F.col("family"), F.col("rep")).alias("family_key")).groupBy("key", "family_key").agg(F.count("*").alias("n"))


@query("p9_cell_key", X.WITH_CELLS + " SELECT part, rep || ' | ' || learner AS key, split_part(key, ' | ', 1) AS rep, split_part(key, ' | ', 2) AS learner FROM cells")
def p9(spark, sf):
    c = X.cells(spark, sf).select("part", L.cell_key(F.col("rep"), F.col("learner")).alias("key"))
    rep, learner = L.split_cell_key(F.col("key"))
    return c.select("part", "key", rep.alias("rep"), learner.alias("learner"))


@query("p10_rename_keys", X.WITH_CELLS + """
SELECT part, CASE rep WHEN 'lang' THEN 'language' WHEN 'length' THEN 'n_types' ELSE rep END AS rep, learner, test_r2 FROM cells""")
def p10(spark, sf):
    return L.rename_keys(X.cells(spark, sf).select("part", "rep", "learner", "test_r2"), "rep", {"lang": "language", "length": "n_types"})


@query("p11_clean_numeric", r"""
SELECT event_id, round(CASE WHEN isfinite(v) THEN v END, 6) AS v, coalesce(TRY_CAST(regexp_extract(props, ':\s*(.*?)\}', 1) AS DOUBLE), 0) AS k,
       round(list_sum([CASE WHEN x > 0.1 THEN 0 ELSE x END for x in embedding::DOUBLE[]]), 6) AS clean_total
FROM (SELECT event_id, props, CASE WHEN event_type = 'error' THEN 'nan'::DOUBLE WHEN event_type = 'view' THEN 'inf'::DOUBLE ELSE value END AS v FROM events)
LEFT JOIN embeddings ON vec_id = event_id""")
def p11(spark, sf):
    e = S.table(spark, sf, "events").select(
        "event_id", F.regexp_extract("props", r":\s*(.*?)\}", 1).alias("k"),
        F.when(F.col("event_type") == "error", F.lit(float("nan"))).when(F.col("event_type") == "view", F.lit(float("inf"))).otherwise(F.col("value")).alias("v"),
    )
    vec = S.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("event_id"),
        F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x > 0.1, F.lit(float("nan"))).otherwise(x)).alias("features"),
    )
    df = C.clean_numeric(e, ["v"])
    df = C.clean_numeric(df, ["k"], 0.0)
    vec = C.clean_numeric(vec, ["features"], 0.0)
    return df.join(vec, "event_id", "left").select("event_id", "v", "k", F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("clean_total"))


@query("p12_clip", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, round(greatest(l_discount, 0.001), 6) AS floored, round(least(greatest(l_tax, 0.02), 0.06), 6) AS bounded FROM lineitem")
def p12(spark, sf):
    return S.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", C.clip(F.col("l_discount"), 1e-3).alias("floored"), C.clip(F.col("l_tax"), 0.02, 0.06).alias("bounded")
    )


@query("p13_concat_representations", """
SELECT vec_id AS id, (len(embedding) + 2)::BIGINT AS width, round(list_sum(embedding::DOUBLE[]) + n_chars + length(lang), 6) AS total
FROM embeddings JOIN documents ON doc_id = vec_id""")
def p13(spark, sf):
    a = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    b = S.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.array(F.col("n_chars").cast("double"), F.length("lang").cast("double")).alias("features")
    )
    j = S.concat_reps(a, b)
    return j.select("id", F.size("features").alias("width"), F.aggregate("features", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("p14_pair_deltas", """
WITH v AS (SELECT p_partkey AS id, log10(p_retailprice) AS y, avg(log10(p_retailprice)) OVER (PARTITION BY p_brand) AS pred, p_name, p_brand FROM part),
f AS (SELECT p_name, p_brand, min(id) AS id_without FROM v GROUP BY ALL),
pr AS (SELECT id_without, v.id AS id_with FROM v JOIN f USING (p_name, p_brand) WHERE v.id <> id_without)
SELECT id_without, id_with, round(b.y - a.y, 6) AS observed, round(b.pred - a.pred, 6) AS predicted, sign(round(b.y - a.y, 6))::DOUBLE AS direction
FROM pr JOIN v a ON a.id = id_without JOIN v b ON b.id = id_with""")
def p14(spark, sf):
    p = S.table(spark, sf, "part").withColumn("y", F.log10("p_retailprice"))
    v = p.join(p.groupBy("p_brand").agg(F.avg("y").alias("pred")), "p_brand").select(F.col("p_partkey").alias("id"), "y", "pred", "p_name", "p_brand")
    first = v.groupBy("p_name", "p_brand").agg(F.min("id").alias("id_without"))
    pairs = v.join(first, ["p_name", "p_brand"]).where("id <> id_without").select("id_without", F.col("id").alias("id_with"))
    return pair_deltas(pairs, v.select("id", "y", "pred")).withColumn("direction", F.signum(F.round("observed", 6)))


BIN_CASE = """CASE WHEN nn_sim IS NULL THEN '?' WHEN nn_sim < 0.4 THEN '[0.0, 0.4)' WHEN nn_sim < 0.6 THEN '[0.4, 0.6)'
 WHEN nn_sim < 0.8 THEN '[0.6, 0.8)' WHEN nn_sim < 1.01 THEN '[0.8, 1.0)' ELSE '?' END"""


@query("p15_similarity_bin", X.WITH_NN + f" SELECT split, {BIN_CASE} AS sim_bin, count(*) AS n FROM nn GROUP BY ALL")
def p15(spark, sf):
    return X.primary_nn(spark, sf).select("split", similarity_bin(F.col("nn_sim")).alias("sim_bin")).groupBy("split", "sim_bin").agg(F.count("*").alias("n"))


@query("p16_require_columns", "SELECT doc_id, lang, source FROM documents")
def p16(spark, sf):
    return C.require_columns(S.table(spark, sf, "documents"), ["doc_id", "lang", "source"]).select("doc_id", "lang", "source")
