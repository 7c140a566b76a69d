"""Tables the registered queries share: entities, designs, fixture predictions, cells, token sets.

The predictions come from simple fits (group means, shrunk means, straight lines) made only from
sums, so that models of different quality exist without any learner. Each table is settled once per
session and folder and then shared.

The same tables as SQL common table expressions are in ``*_SQL``; they are what the oracle uses.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.core import kept, settle
from plumbline.functions.features import n_types, template_key, token_set
from plumbline.operators import splits
from plumbline.operators.ranking import quantiles
from plumbline.operators.selection import split_cell_key
from plumbline.operators.similarity import nn_similarity, self_nn_similarity
from plumbline.sources.tables import spread, table

K = 5
SEED_STRATIFIED, SEED_SOURCE, SEED_INNER, SEED_TEMPLATE = 11, 12, 13, 14
PRIMARY_SEED = 42
SHRINK = 10.0
ROWS_PER_PART = 500_000  # entities and designs that a task turns into rows per fold and model
BROADCAST_FITS = 200_000  # sums of groups that may be sent to every task
# Means of two values can end exactly in 5; the shift keeps every engine on the same side of the rounding.
NUDGE = 1.23e-8
MODELS = {  # cell key -> family key
    "lang | Mean": "Cat",
    "lang | Shrunk": "Cat",
    "source | Mean": "Src",
    "source | Shrunk": "Src",
    "length | Line": "Desc",
    "loglength | Line": "Desc",
    "lang+source | Mean": "Hyb",
}
_memo: dict = {}


def shared(fn):
    """Compute a table once per session and folder."""

    def get(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, fn.__name__, sf)
        if key not in _memo:
            _memo[key] = settle(fn(spark, sf))
        return _memo[key]

    return get


# ---------------------------------------------------------------- entities
@shared
def entities(spark: SparkSession, sf: str) -> DataFrame:
    """(id, cat, grp, tmpl, n_chars, y, x1, x2): documents as entities, y = log10 of their length."""
    d = spread(table(spark, sf, "documents"), "doc_id")
    n = F.greatest(n_types(F.col("text")), F.lit(1)).cast("double")
    return d.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("cat"), F.col("source").alias("grp"),
        template_key(F.col("text")).alias("tmpl"), "n_chars", F.round(F.log10("n_chars"), 9).alias("y"),
        n.alias("x1"), F.round(F.log10(n), 9).alias("x2"),
    )


TOK = r"[x for x in string_split_regex(lower(text), '[ \t\r\n]+') if x <> '']"
STOP_SQL = "['the','of','and','to','in','is','a','der','die','und','de','la','le','et','el','en','y']"
ENT_SQL = rf"""
ent0 AS (
  SELECT doc_id AS id, text, lang AS cat, source AS grp, n_chars, round(log10(n_chars), 9) AS y,
         greatest(len(list_distinct({TOK})), 1)::DOUBLE AS x1,
         array_to_string(([x for x in string_split_regex(
           regexp_replace(lower(text), '[0-9.,;:!?|#$%&*"''()<>/@_=+-]+', ' ', 'g'), '[ \t\r\n]+')
           if x <> '' AND NOT list_contains({STOP_SQL}, x)]), ' ') AS t0
  FROM documents),
ent AS (
  SELECT id, text, cat, grp, n_chars, y, x1, round(log10(x1), 9) AS x2,
         CASE WHEN text IS NULL OR t0 = '' THEN '<none>' ELSE md5(t0) END AS tmpl
  FROM ent0)"""


# ---------------------------------------------------------------- folds of three designs
@shared
def folds(spark: SparkSession, sf: str) -> DataFrame:
    """(design, id, ofold, inner_f): outer fold under each design and one inner fold per id."""
    e = entities(spark, sf)
    inner = splits.kfold(e, "id", K, SEED_INNER).withColumnRenamed("fold", "inner_f")
    parts = splits.stratified_kfold(e, "id", "cat", K, SEED_STRATIFIED).select(
        F.lit("stratified").alias("design"), "id", F.col("fold").alias("ofold")
    )
    for name, col, seed in (("source", "grp", SEED_SOURCE), ("template", "tmpl", SEED_TEMPLATE)):
        of_group = splits.kfold(e.select(col).distinct(), col, K, seed).withColumnsRenamed({"id": col, "fold": "ofold"})
        parts = parts.unionByName(e.join(of_group, col).select(F.lit(name).alias("design"), "id", "ofold"))
    return parts.join(inner, "id")


FOLDS_SQL = f"""
strata AS (SELECT cat, coalesce(sum(n) OVER (ORDER BY cat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
           FROM (SELECT cat, count(*) AS n FROM ent GROUP BY cat)),
inn AS (SELECT id, (row_number() OVER (ORDER BY md5('{SEED_INNER}:' || id), id) - 1) % {K} AS inner_f FROM ent),
src AS (SELECT grp, (row_number() OVER (ORDER BY md5('{SEED_SOURCE}:' || grp), grp) - 1) % {K} AS ofold
        FROM (SELECT DISTINCT grp FROM ent)),
tpl AS (SELECT tmpl, (row_number() OVER (ORDER BY md5('{SEED_TEMPLATE}:' || tmpl), tmpl) - 1) % {K} AS ofold
        FROM (SELECT DISTINCT tmpl FROM ent)),
fo AS (
  SELECT 'stratified' AS design, id, ((rn - 1 + start) % {K})::BIGINT AS ofold FROM (
    SELECT id, cat, row_number() OVER (PARTITION BY cat ORDER BY md5('{SEED_STRATIFIED}:' || id), id) AS rn FROM ent)
    JOIN strata USING (cat)
  UNION ALL SELECT 'source', id, ofold FROM ent JOIN src USING (grp)
  UNION ALL SELECT 'template', id, ofold FROM ent JOIN tpl USING (tmpl)),
folds AS (SELECT design, id, ofold, inner_f FROM fo JOIN inn USING (id))"""


def _part():
    return F.concat("design", F.lit("_f"), F.lpad(F.col("fold").cast("string"), 2, "0")).alias("part")


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """(design, part, fold, id, role): every fold of every design held out once."""
    f = folds(spark, sf).select("design", "id", "ofold", F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("fold"))
    return f.select(
        "design", _part(), F.col("fold").cast("bigint").alias("fold"), "id",
        F.when(F.col("ofold") == F.col("fold"), "test").otherwise("train").alias("role"),
    )


PARTS_SQL = f"""
parts AS (SELECT design, design || '_f0' || o AS part, o AS fold, id,
                 CASE WHEN ofold = o THEN 'test' ELSE 'train' END AS role
          FROM folds, range({K}) t(o))"""


# ---------------------------------------------------------------- predictions
_SUMS = ("n", "sy", "s1", "s11", "s1y", "s2", "s22", "s2y")


@shared
def folded(spark: SparkSession, sf: str) -> DataFrame:
    """Entities with their folds, one row per design, spread so that a task's share does not grow with the table."""
    rows = entities(spark, sf).join(folds(spark, sf), "id").withColumn("both", F.concat_ws("/", "cat", "grp"))
    n = folds(spark, sf).count()
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_PART)), "id")


@shared
def fits(spark: SparkSession, sf: str) -> DataFrame:
    """(design, fold, f, gname, gval, sums): sums of the training rows of every fold, and of those without inner fold f (f = -1: all)."""
    groups = F.array(*[
        F.struct(F.lit(n).alias("gname"), v.alias("gval"))
        for n, v in (("all", F.lit("")), ("lang", F.col("cat")), ("source", F.col("grp")), ("lang+source", F.col("both")))
    ])
    g = folded(spark, sf).withColumn("g", F.explode(groups)).groupBy("design", "ofold", "inner_f", "g.gname", "g.gval").agg(
        F.count("*").cast("double").alias("n"), F.sum("y").alias("sy"),
        F.sum("x1").alias("s1"), F.sum(F.col("x1") * F.col("x1")).alias("s11"), F.sum(F.col("x1") * F.col("y")).alias("s1y"),
        F.sum("x2").alias("s2"), F.sum(F.col("x2") * F.col("x2")).alias("s22"), F.sum(F.col("x2") * F.col("y")).alias("s2y"),
    )
    return (
        g.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(K - 1))))
        .withColumn("f", F.explode(F.sequence(F.lit(-1), F.lit(K - 1))))
        .where("fold <> ofold and f <> inner_f")
        .groupBy("design", "fold", "f", "gname", "gval")
        .agg(*[F.sum(s).alias(s) for s in _SUMS])
    )


def scored(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """One row per row of ``rows`` (default: all of ``folded``) and fold, with the fits that score it.

    What a model gives a whole group is rounded in the table of fits, once per group. The rows are made again
    wherever they are used: they are a hundred times the documents, and cheaper to make than to keep.
    """
    t = fits(spark, sf)
    small = F.broadcast if t.count() <= BROADCAST_FITS else (lambda df: df)
    on = ["design", "fold", "f"]
    mu = F.col("a_sy") / F.col("a_n")
    every = t.where("gname = 'all'").select(*on, _part(), *[F.col(c).alias(f"a_{c}") for c in _SUMS]).withColumn("mu", _pred(mu))

    def fit(name: str, prefix: str, value: str) -> DataFrame:
        g = t.where(F.col("gname") == name).join(F.broadcast(every.select(*on, "a_sy", "a_n")), on)
        mean, shrunk = F.col("sy") / F.col("n"), (F.col("sy") + SHRINK * mu) / (F.col("n") + SHRINK)
        return small(g.select(*on, F.col("gval").alias(value), _pred(F.coalesce(mean, mu)).alias(f"{prefix}_mean"), _pred(F.coalesce(shrunk, mu)).alias(f"{prefix}_shrunk")))

    test = F.col("ofold") == F.col("fold")
    return (
        (folded(spark, sf) if rows is None else rows)
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(K - 1))))
        .withColumn("role", F.when(test, "test").otherwise("train"))
        .withColumn("f", F.when(test, F.lit(-1)).otherwise(F.col("inner_f")))
        .join(F.broadcast(every), on)  # at most one row per design, fold and inner fold
        .join(fit("lang", "l", "cat"), [*on, "cat"], "left")
        .join(fit("source", "s", "grp"), [*on, "grp"], "left")
        .join(fit("lang+source", "b", "both"), [*on, "both"], "left")
        .withColumn("fold", F.col("fold").cast("bigint"))
    )


def _pred(p):
    return F.round(p + NUDGE, 6)


def by_model(rows: DataFrame, *more: str) -> DataFrame:
    """(design, part, fold, role, inner_f, id, y, more, model, pred) from :func:`scored`."""

    def group(c: str):
        return F.coalesce(c, "mu")

    def line(i: int):
        n, sy, sx, sxx, sxy = (F.col(f"a_{c}") for c in ("n", "sy", f"s{i}", f"s{i}{i}", f"s{i}y"))
        b = (n * sxy - sx * sy) / (n * sxx - sx * sx)
        return _pred(sy / n + b * (F.col(f"x{i}") - sx / n))

    preds = (group("l_mean"), group("l_shrunk"), group("s_mean"), group("s_shrunk"), line(1), line(2), group("b_mean"))
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("pred")) for m, p in zip(MODELS, preds)]))
    return rows.select("design", "part", "fold", "role", "inner_f", "id", "y", *more, each)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(design, part, fold, role, inner_f, id, y, model, pred).

    Test rows are scored by the fit on the training rows of their part, training rows by the fit
    without their inner fold. All fits are differences of the same group sums.
    """
    return by_model(scored(spark, sf))


def _sql_models() -> str:
    def mean(p):
        return f"coalesce({p}.sy / {p}.n, a.sy / a.n)"

    def shrunk(p):
        return f"coalesce(({p}.sy + {SHRINK} * (a.sy / a.n)) / ({p}.n + {SHRINK}), a.sy / a.n)"

    def line(i):
        return (f"a.sy / a.n + (a.n * a.s{i}y - a.s{i} * a.sy) / (a.n * a.s{i}{i} - a.s{i} * a.s{i}) * (x{i} - a.s{i} / a.n)")

    vals = (mean("l"), shrunk("l"), mean("s"), shrunk("s"), line(1), line(2), mean("b"))
    return ", ".join(f"{{'model': '{m}', 'pred': round({v} + {NUDGE}, 6)}}" for m, v in zip(MODELS, vals))


PREDS_SQL = f"""
fe AS (SELECT * FROM folds JOIN ent USING (id)),
g AS (SELECT design, ofold, inner_f, s.gname AS gname, s.gval AS gval, count(*)::DOUBLE AS n, sum(y) AS sy,
             sum(x1) AS s1, sum(x1*x1) AS s11, sum(x1*y) AS s1y, sum(x2) AS s2, sum(x2*x2) AS s22, sum(x2*y) AS s2y
      FROM (SELECT *, unnest([{{'gname':'all','gval':''}}, {{'gname':'lang','gval':cat}}, {{'gname':'source','gval':grp}},
                              {{'gname':'lang+source','gval':cat || '/' || grp}}]) AS s FROM fe)
      GROUP BY ALL),
fits AS (SELECT design, o, f, gname, gval, sum(n) AS n, sum(sy) AS sy, sum(s1) AS s1, sum(s11) AS s11, sum(s1y) AS s1y,
                sum(s2) AS s2, sum(s22) AS s22, sum(s2y) AS s2y
         FROM g, range({K}) t1(o), range(-1, {K}) t2(f) WHERE o <> ofold AND f <> inner_f GROUP BY ALL),
pr AS (SELECT fe.*, o, CASE WHEN ofold = o THEN 'test' ELSE 'train' END AS role,
              CASE WHEN ofold = o THEN -1 ELSE inner_f END AS f FROM fe, range({K}) t(o)),
preds AS (
  SELECT design, design || '_f0' || o AS part, o AS fold, role, inner_f, id, y, m.model AS model, m.pred AS pred FROM (
    SELECT r.design, r.o, r.role, r.inner_f, r.id, r.y, unnest([{_sql_models()}]) AS m
    FROM pr r
    JOIN fits a ON a.gname = 'all' AND a.design = r.design AND a.o = r.o AND a.f = r.f
    LEFT JOIN fits l ON l.gname = 'lang' AND l.design = r.design AND l.o = r.o AND l.f = r.f AND l.gval = r.cat
    LEFT JOIN fits s ON s.gname = 'source' AND s.design = r.design AND s.o = r.o AND s.f = r.f AND s.gval = r.grp
    LEFT JOIN fits b ON b.gname = 'lang+source' AND b.design = r.design AND b.o = r.o AND b.f = r.f
                    AND b.gval = r.cat || '/' || r.grp))"""


def held_out(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of the test rows; within a design every document is there once per model."""
    return by_model(scored(spark, sf).where("role = 'test'")).drop("inner_f", "role")


def held_groups(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`held_out` joined to the group of each id, before every document becomes a row per model."""
    groups = entities(spark, sf).select("id", F.col("grp").alias("of"))
    held = scored(spark, sf, folded(spark, sf).join(groups, "id")).where("role = 'test'")
    return by_model(held, "of").drop("inner_f", "role").withColumnRenamed("of", "grp")


# ---------------------------------------------------------------- cells
def _fam(model):
    return F.element_at(F.create_map(*[F.lit(v) for kv in MODELS.items() for v in kv]), model)


@shared
def cells(spark: SparkSession, sf: str) -> DataFrame:
    """(design, part, fold, key, rep, learner, fam, q2, inner, test_r2, test_rmse, test_mae)."""
    from plumbline.operators.metrics import regression_metrics

    p = predictions(spark, sf)
    by = ["design", "part", "fold", "model"]
    test = regression_metrics(p.where("role = 'test'"), by)
    oof = regression_metrics(p.where("role = 'train'"), by).select(*by, F.col("r2").alias("q2"))
    inner = regression_metrics(p.where("role = 'train'"), [*by, "inner_f"]).groupBy(*by).agg(F.avg("r2").alias("inner"))
    rep, learner = split_cell_key(F.col("model"))
    return test.join(oof, by).join(inner, by).select(
        "design", "part", "fold", F.col("model").alias("key"), rep.alias("rep"), learner.alias("learner"), _fam(F.col("model")).alias("fam"),
        *[F.round(c, 6).alias(n) for c, n in (("q2", "q2"), ("inner", "inner"), ("r2", "test_r2"), ("rmse", "test_rmse"), ("mae", "test_mae"))],
    )


R2 = "1 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y))"
CELLS_SQL = f"""
cells AS (
  SELECT design, part, fold, model AS key, split_part(model, ' | ', 1) AS rep, split_part(model, ' | ', 2) AS learner,
         CASE {' '.join(f"WHEN model = '{m}' THEN '{f}'" for m, f in MODELS.items())} END AS fam,
         round(q2, 6) AS q2, round("inner", 6) AS "inner", round(test_r2, 6) AS test_r2, round(test_rmse, 6) AS test_rmse,
         round(test_mae, 6) AS test_mae
  FROM (SELECT design, part, fold, model, {R2} AS test_r2, sqrt(avg((y - pred) * (y - pred))) AS test_rmse,
               avg(abs(y - pred)) AS test_mae FROM preds WHERE role = 'test' GROUP BY ALL)
  JOIN (SELECT design, part, fold, model, {R2} AS q2 FROM preds WHERE role = 'train' GROUP BY ALL)
       USING (design, part, fold, model)
  JOIN (SELECT design, part, fold, model, avg(r) AS "inner" FROM (
          SELECT design, part, fold, model, inner_f, {R2} AS r FROM preds WHERE role = 'train' GROUP BY ALL) GROUP BY ALL)
       USING (design, part, fold, model))"""

WITH_ENT = "WITH" + ENT_SQL
WITH_PARTS = WITH_ENT + "," + FOLDS_SQL + "," + PARTS_SQL
WITH_PREDS = WITH_ENT + "," + FOLDS_SQL + "," + PREDS_SQL
WITH_CELLS = WITH_PREDS + "," + CELLS_SQL


# ---------------------------------------------------------------- token sets, primary splits, similarity
def sets(spark: SparkSession, sf: str) -> DataFrame:
    """(id, els): distinct tokens of each document. The longest rows of all, so kept compressed, once per session and folder."""
    key = (spark.sparkContext.applicationId, "sets", sf)
    if key not in _memo:
        _memo[key] = kept(_token_sets(spark, sf), "sets")
    return _memo[key]


def _token_sets(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return d.select(F.col("doc_id").alias("id"), token_set(F.col("text")).alias("els"))


TOK_SQL = f"""
tok AS (SELECT doc_id AS id, unnest(list_distinct({TOK})) AS w FROM documents),
sz AS (SELECT id, count(*) AS n FROM tok GROUP BY id)"""


@shared
def primary(spark: SparkSession, sf: str) -> DataFrame:
    """(split, id, role): the stratified and the source-disjoint 9:1 partition."""
    e = entities(spark, sf)
    a = splits.stratified_split(e, "id", "cat", PRIMARY_SEED).withColumn("split", F.lit("stratified"))
    b = splits.group_disjoint_split(e, "id", "grp", PRIMARY_SEED).withColumn("split", F.lit("source"))
    return a.unionByName(b).select("split", "id", "role")


PRIMARY_SQL = f"""
st AS (SELECT cat, count(*) AS n FROM ent GROUP BY cat),
st2 AS (SELECT cat, n, ceil(sum(n) OVER () * 0.1 - 1e-9) AS tot,
               n * ceil(sum(n) OVER () * 0.1 - 1e-9) / sum(n) OVER () AS ideal FROM st),
st3 AS (SELECT cat, floor(ideal) AS base, tot - sum(floor(ideal)) OVER () AS lft,
               row_number() OVER (ORDER BY round(ideal - floor(ideal), 9) DESC, cat) AS pos FROM st2),
quota AS (SELECT cat, base + CASE WHEN pos <= lft THEN 1 ELSE 0 END AS q FROM st3),
gs AS (SELECT grp, count(*) AS n FROM ent GROUP BY grp),
gc AS (SELECT grp, n, sum(n) OVER (ORDER BY n, md5('{PRIMARY_SEED}:' || grp), grp ROWS UNBOUNDED PRECEDING) AS upto FROM gs),
prim AS (
  SELECT 'stratified' AS split, id, CASE WHEN rn <= q THEN 'test' ELSE 'train' END AS role FROM (
    SELECT id, cat, row_number() OVER (PARTITION BY cat ORDER BY md5('{PRIMARY_SEED}:' || id), id) AS rn FROM ent)
    JOIN quota USING (cat)
  UNION ALL
  SELECT 'source', id, CASE WHEN upto <= round_even((SELECT count(*) FROM ent) * 0.1, 0) OR upto = n THEN 'test' ELSE 'train' END
  FROM ent JOIN gc USING (grp))"""


def _held(spark: SparkSession, sf: str, split: str, role: str) -> DataFrame:
    """Sets of the rows that a split gives a role, by id. Sets are not shuffled: the smaller side, by its ids, is sent to them."""
    s, ids = sets(spark, sf), primary(spark, sf).where((F.col("split") == split) & (F.col("role") == role)).select("id").distinct()
    if role == "test":
        return s.join(F.broadcast(ids), "id", "left_semi")
    others = s.select("id").distinct().join(ids, "id", "left_anti").where("id is not null")
    return s.where("id is not null").join(F.broadcast(others), "id", "left_anti")


def _split_nn(spark: SparkSession, sf: str, split: str) -> DataFrame:
    nn = nn_similarity(_held(spark, sf, split, "test"), _held(spark, sf, split, "train"), "id", "els")
    return nn.select(F.lit(split).alias("split"), "id", F.round("nn_sim", 6).alias("nn_sim"), "nn_id")


@shared
def stratified_nn(spark: SparkSession, sf: str) -> DataFrame:
    return _split_nn(spark, sf, "stratified")


@shared
def source_nn(spark: SparkSession, sf: str) -> DataFrame:
    """(split, id, nn_sim, nn_id) of the source-disjoint split, which the slices need without the other one."""
    return _split_nn(spark, sf, "source")


def primary_nn(spark: SparkSession, sf: str) -> DataFrame:
    """(split, id, nn_sim, nn_id): similarity of each held-out document to the training rows of its split."""
    return stratified_nn(spark, sf).unionByName(source_nn(spark, sf))


NN_SQL = """
pts AS (SELECT split, id, role, w, n FROM prim JOIN tok USING (id) JOIN sz USING (id)),
ov AS (SELECT a.split, a.id, b.id AS r, a.n AS na, b.n AS nb, count(*) AS c
       FROM pts a JOIN pts b ON a.split = b.split AND a.w = b.w AND a.role = 'test' AND b.role = 'train' GROUP BY ALL),
nn AS (SELECT split, id, round(coalesce(max(c / (na + nb - c)), 0), 6) AS nn_sim,
              arg_max(r, {'s': c / (na + nb - c), 'i': -r}) AS nn_id
       FROM prim LEFT JOIN ov USING (split, id) WHERE role = 'test' GROUP BY split, id)"""
WITH_NN = WITH_ENT + "," + PRIMARY_SQL + "," + TOK_SQL + "," + NN_SQL


@shared
def self_nn(spark: SparkSession, sf: str) -> DataFrame:
    return self_nn_similarity(sets(spark, sf), "id", "els").withColumn("nn_sim", F.round("nn_sim", 6))


SELF_SQL = """
ps AS (SELECT a.id, b.id AS r, count(*) AS c FROM tok a JOIN tok b ON a.w = b.w AND a.id <> b.id GROUP BY ALL),
snn AS (SELECT d.doc_id AS id, round(coalesce(max(c / (na.n + nb.n - c)), 0), 6) AS nn_sim,
               arg_max(r, {'s': c / (na.n + nb.n - c), 'i': -r}) AS nn_id
        FROM documents d LEFT JOIN ps ON ps.id = d.doc_id LEFT JOIN sz na ON na.id = ps.id LEFT JOIN sz nb ON nb.id = ps.r
        GROUP BY d.doc_id)"""


def slice_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(id, role, cat, grp, y, pred): source-disjoint split scored by the training mean of the language."""
    p = primary(spark, sf).where("split = 'source'").drop("split")
    rows = entities(spark, sf).join(p, "id")
    means = rows.where("role = 'train'").groupBy("cat").agg(F.round(F.avg("y"), 6).alias("pred"))
    glob = rows.where("role = 'train'").agg(F.round(F.avg("y"), 6)).scalar()
    return rows.join(means, "cat", "left").select("id", "role", "cat", "grp", "y", F.coalesce("pred", glob).alias("pred"))


@shared
def slice_scores(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`slice_rows` with nn_sim, the similarity of held-out rows to the training rows."""
    return slice_rows(spark, sf).join(source_nn(spark, sf).select("id", "nn_sim"), "id", "left")


@shared
def slice_plain(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of :func:`slice_scores`, repeated ids as often as there, for queries that do not read nn_sim."""
    held = _held(spark, sf, "source", "test").select("id")
    return slice_rows(spark, sf).join(held, "id", "left")


SLICE_SQL = """
sr AS (SELECT ent.*, role FROM ent JOIN prim USING (id) WHERE split = 'source'),
sm AS (SELECT cat, round(avg(y), 6) AS pred FROM sr WHERE role = 'train' GROUP BY cat),
slice AS (SELECT sr.id, role, sr.cat, sr.grp, y,
                 coalesce(pred, (SELECT round(avg(y), 6) FROM sr WHERE role = 'train')) AS pred, nn_sim
          FROM sr LEFT JOIN sm USING (cat) LEFT JOIN (SELECT id, nn_sim FROM nn WHERE split = 'source') n ON n.id = sr.id)"""
WITH_SLICE = WITH_NN + "," + SLICE_SQL


def threshold(spark: SparkSession, sf: str):
    """Scalar: the 90th percentile of y over all documents."""
    return quantiles(entities(spark, sf), "y", [0.9]).select("q0").scalar()
