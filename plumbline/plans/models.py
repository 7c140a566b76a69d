"""M: learners on MLlib; results of iterative fits have no SQL counterpart."""
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from plumbline.core import settle
from plumbline.functions.features import descriptors
from plumbline.operators import metrics as M
from plumbline.operators import models as ML
from plumbline.operators import selection as L
from plumbline.operators.poisson import poisson_scores
from plumbline.plans import fixtures as X
from plumbline.plans.inference import B_ROWS, SEED
from plumbline.plans.registry import query
from plumbline.sources import tables as S

COLS = ["n_tokens", "n_types", "type_token_ratio", "mean_token_length", "digit_share", "upper_share", "space_share", "punct_share"]


def _described(spark, sf, sets):
    d = S.spread(S.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    rows = d.select(F.col("doc_id").alias("id"), *[c.cast("double").alias(n) for n, c in descriptors(F.col("text")).items() if n in COLS])
    inner = X.folds(spark, sf).where("design = 'source'").select("id", F.col("inner_f").cast("int").alias("fold"))
    s = X.slice_plain(spark, sf).select("id", "y", "role", "pred")
    return rows.join(inner, "id").join(s, "id").join(sets, "id").withColumn("features", F.array(*COLS))


@X.shared
def described(spark, sf):
    """(id, y, role, fold, descriptors, features, pred): documents under the source-disjoint split; the ids of the sets join, their tokens stay out."""
    return _described(spark, sf, X.sets(spark, sf).select("id"))


@X.shared
def described_sets(spark, sf):
    """The same rows with their token sets (els), which only scoring needs."""
    return _described(spark, sf, X.sets(spark, sf))


def _train(spark, sf, rows=described):
    return rows(spark, sf).where("role = 'train'").drop("features", "pred")


def _test(spark, sf, rows=described):
    return rows(spark, sf).where("role = 'test'").drop("features", "pred")


@query("m1_preprocess")
def m1(spark, sf):
    from pyspark.ml.functions import vector_to_array

    fitted = ML.preprocess(_train(spark, sf), COLS)
    v = fitted.transform(_train(spark, sf)).select(F.posexplode(vector_to_array("features")).alias("pos", "v"))
    return v.groupBy("pos").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))


def _fit_scores(spark, sf, est):
    model = Pipeline(stages=[*ML.preprocess_stages(COLS), est]).fit(_train(spark, sf))
    return M.regression_metrics(model.transform(_test(spark, sf)))


@query("m2_ridge")
def m2(spark, sf):
    n, sd = ML.label_stats(_train(spark, sf))
    return _fit_scores(spark, sf, ML.ridge(10.0, n, sd))


@query("m3_forest")
def m3(spark, sf):
    return _fit_scores(spark, sf, ML.forest(20, 6))


@query("m4_boosted_trees")
def m4(spark, sf):
    return _fit_scores(spark, sf, ML.gbt(10, 3))


@query("m5_tune")
def m5(spark, sf):
    train = _train(spark, sf)
    est, grid = ML.ridge_grid(train)
    cv = ML.tune(train, COLS, est, grid, X.K)
    rows = [(a, float(s)) for a, s in zip(ML.RIDGE_ALPHAS, cv.avgMetrics)]
    test = M.regression_metrics(cv.bestModel.transform(_test(spark, sf))).select("r2").scalar()
    return spark.createDataFrame(rows, "alpha double, inner_r2 double").withColumn("test_r2", test)


@query("m6_out_of_fold")
def m6(spark, sf):
    train = _train(spark, sf)
    n, sd = ML.label_stats(train)
    return ML.q2(ML.oof_predict(train, COLS, ML.ridge(10.0, n, sd), X.K))


@query("m7_stack")
def m7(spark, sf):
    """Stacks of every partition, with and without the members that know the language or the source, each compared with the full one."""
    families = sorted(set(X.MODELS.values()))
    chosen = settle(ML.best_members(X.cells(spark, sf)))
    sets = ML.member_sets(chosen, ["part"], {"without_lang": ["lang"], "without_source": ["source"]})
    preds, weights = ML.stack(ML.prediction_columns(X.predictions(spark, sf), chosen, ["part"], families), sets, ["part"], families)
    test = settle(preds.where("role = 'test'").select("part", F.col("members").alias("model"), "id", "y", "pred"))
    scored = M.regression_metrics(test, ["part", "model"]).withColumnRenamed("model", "members")
    pairs = spark.createDataFrame([("full", "without_lang"), ("full", "without_source")], "model_a string, model_b string")
    change = L.contrasts(test, poisson_scores(test, ["part"], B_ROWS, SEED), pairs, ["part"]).drop("model_a").withColumnRenamed("model_b", "members")
    return scored.join(weights.drop("n"), ["part", "members"]).join(change, ["part", "members"], "left")


@query("m8_linear_probe")
def m8(spark, sf):
    d = described(spark, sf)
    e = X.entities(spark, sf).select("id", "x1", "x2")
    return ML.probe({"descriptors": (d.drop("features", "pred"), COLS), "type counts": (d.drop("features", "pred").join(e, "id"), ["x1", "x2"]),
                     "shares": (d.drop("features", "pred"), COLS[4:])})


@query("m9_score")
def m9(spark, sf):
    train, test = _train(spark, sf, described_sets), _test(spark, sf, described_sets)
    n, sd = ML.label_stats(train)
    model = Pipeline(stages=[*ML.preprocess_stages(COLS), ML.ridge(10.0, n, sd)]).fit(train)
    bins = ML.bin_table(model.transform(test).join(X.slice_scores(spark, sf).select("id", "nn_sim"), "id"))
    return ML.score(test, model, train.select("id", "els"), bins)
