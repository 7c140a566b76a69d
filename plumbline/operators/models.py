"""Learners on MLlib: preprocessing on training rows only, tuning, out-of-fold scores, stacking, scoring."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.core import settle
from plumbline.operators.metrics import binned_metrics, regression_metrics, similarity_bin
from plumbline.operators.similarity import nn_similarity

# The ridge penalties tried, and the similarity below which a score is only a hint.
RIDGE_ALPHAS = (1.0, 10.0, 100.0, 1000.0, 10000.0)
STACK_ALPHAS = tuple(np.logspace(-3, 3, 25).tolist())
LOW_SIMILARITY = 0.6


def preprocess_stages(cols: Sequence[str], relative_error: float = 1e-4) -> list:
    """Median imputation, constant columns dropped, unit variance; fit it on training rows."""
    filled = [f"{c}__filled" for c in cols]
    return [
        Imputer(inputCols=list(cols), outputCols=filled, strategy="median", relativeError=relative_error),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        VarianceThresholdSelector(featuresCol="_raw", outputCol="_varying", varianceThreshold=0.0),
        StandardScaler(inputCol="_varying", outputCol="features", withMean=True, withStd=True),
    ]


def preprocess(train: DataFrame, cols: Sequence[str]) -> PipelineModel:
    return Pipeline(stages=preprocess_stages(cols)).fit(train)


def ridge(alpha: float, n: int, sd_pop: float, features: str = "features") -> LinearRegression:
    """Ridge with penalty alpha on the sum of squares; Spark averages the loss and scales the label."""
    return LinearRegression(
        featuresCol=features, labelCol="y", predictionCol="pred", elasticNetParam=0.0,
        regParam=alpha * sd_pop / n, standardization=False, solver="normal",
    )


def label_stats(train: DataFrame) -> tuple[int, float]:
    r = train.agg(F.count("*").alias("n"), F.stddev_pop("y").alias("sd")).first()
    return r["n"], r["sd"]


def forest(trees: int = 50, depth: int = 8, seed: int = 42) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features", labelCol="y", predictionCol="pred", numTrees=trees, maxDepth=depth,
        featureSubsetStrategy="0.3", seed=seed,
    )


def gbt(rounds: int = 20, depth: int = 4, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol="y", predictionCol="pred", maxIter=rounds, maxDepth=depth, seed=seed)


def tune(train: DataFrame, cols: Sequence[str], estimator, grid: list, folds: int, fold_col: str = "fold", parallelism: int = 2):
    """Grid search with given folds inside the training rows, refitted on all of them.

    Preprocessing is part of what is cross-validated. Returns the fitted CrossValidatorModel.
    """
    cv = CrossValidator(
        estimator=Pipeline(stages=[*preprocess_stages(cols), estimator]), estimatorParamMaps=grid,
        evaluator=RegressionEvaluator(labelCol="y", predictionCol="pred", metricName="r2"),
        numFolds=folds, foldCol=fold_col, parallelism=parallelism,
    )
    # foldCol must be an int column
    return cv.fit(train.withColumn(fold_col, F.col(fold_col).cast("int")))


def ridge_grid(train: DataFrame, alphas: Sequence[float] = RIDGE_ALPHAS):
    """(estimator, grid) for :func:`tune`."""
    n, sd = label_stats(train)
    est = ridge(alphas[0], n, sd)
    return est, ParamGridBuilder().addGrid(est.regParam, [a * sd / n for a in alphas]).build()


def oof_predict(train: DataFrame, cols: Sequence[str], estimator, folds: int, fold_col: str = "fold") -> DataFrame:
    """(id, y, pred, fold): every training row scored by a fit that did not see its fold.

    One fit per fold; the number of folds is fixed and small.
    """
    out = None
    for k in range(folds):
        model = Pipeline(stages=[*preprocess_stages(cols), estimator]).fit(train.where(F.col(fold_col) != k))
        part = model.transform(train.where(F.col(fold_col) == k)).select("id", "y", "pred", fold_col)
        out = part if out is None else out.unionByName(part)
    return out


def q2(oof: DataFrame) -> DataFrame:
    return regression_metrics(oof).select(F.col("r2").alias("q2"), F.col("rmse").alias("oof_rmse"), "n")


# ---------------------------------------------------------------- stacking
def best_members(cells: DataFrame, keys: Sequence[str] = ("part",)) -> DataFrame:
    """(keys, member, model, rep): the model with the best training score of each family."""
    from plumbline.operators.ranking import select_best

    return select_best(cells, [*keys, "fam"], "q2", "key").select(*keys, F.col("fam").alias("member"), F.col("key").alias("model"), "rep")


def member_sets(chosen: DataFrame, keys: Sequence[str], ablations: dict[str, Sequence[str]]) -> DataFrame:
    """(keys, members, member): the set ``full``, and one set per ablation without the members whose representation names a token.

    What a representation holds decides, not its family label. A set that equals ``full``, or is empty, is left out.
    """
    full = chosen.select(*keys, F.lit("full").alias("members"), "member")
    out = full
    for name, tokens in ablations.items():
        hit = F.lit(False)
        for t in tokens:
            hit = hit | F.contains("rep", F.lit(t))
        some = chosen.groupBy(*keys).agg(F.bool_or(hit).alias("_hit"))
        out = out.unionByName(chosen.where(~hit).join(some.where("_hit"), list(keys)).select(*keys, F.lit(name).alias("members"), "member"))
    return out


def prediction_columns(preds: DataFrame, chosen: DataFrame, keys: Sequence[str], members: Sequence[str]) -> DataFrame:
    """(keys, id, role, y, x0, x1, ...): one row per entity and partition with its members' predictions; rows that lack one are left out."""
    rows = preds.join(chosen.select(*keys, "model", "member"), [*keys, "model"])
    cols = [F.max(F.when(F.col("member") == m, F.col("pred"))).alias(f"x{i}") for i, m in enumerate(members)]
    return rows.groupBy(*keys, "id", "role").agg(F.max("y").alias("y"), *cols).dropna(subset=[f"x{i}" for i in range(len(members))])


def _axes(m: int, keys: Sequence[str]):
    """From one row of moments per (keys, members): the axes of the Gram matrix, its eigenvalues and the rotated right side."""

    def solve(batches):
        for t in batches:
            for r, row in t.iterrows():
                use = np.array([row[f"u{i}"] for i in range(m)], float)
                gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)], float) * np.outer(use, use)
                lam, axes = np.linalg.eigh(gram)
                rot = axes.T @ (use * np.array([row[f"b{i}"] for i in range(m)], float))
                for j in range(m):
                    t.loc[r, [f"l{j}", f"r{j}"]] = max(lam[j], 0.0), rot[j]
                    for i in range(m):
                        t.loc[r, f"a{i}_{j}"] = axes[i, j] * use[i]
            yield t[[*keys, "members", "n", "my", *[f"m{i}" for i in range(m)], *_axis_columns(m)]]

    return solve


def _axis_columns(m: int) -> list[str]:
    return [*[f"l{j}" for j in range(m)], *[f"r{j}" for j in range(m)], *[f"a{i}_{j}" for i in range(m) for j in range(m)]]


def stack(columns: DataFrame, sets: DataFrame, keys: Sequence[str], members: Sequence[str], alphas: Sequence[float] = STACK_ALPHAS) -> tuple[DataFrame, DataFrame]:
    """Ridge on out-of-fold columns, for every partition and set of members at once.

    ``columns``: :func:`prediction_columns`; ``sets``: :func:`member_sets`. Returns (keys, members, id, role, y, pred) for
    all rows, and (keys, members, n, alpha, one weight per member, 0 outside the set). One aggregation gives the Gram
    matrices, a second the leave-one-out error of every penalty: rotated to the axes of its matrix, a row's leverage and
    fit are sums over the members for each penalty. The smallest error wins, ties go to the smaller penalty. Partitions without training rows give none.
    """
    m, keys = len(members), list(keys)
    train = columns.where("role = 'train'")
    mean = train.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("y").alias("my"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(m)])
    x = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(m)]
    y = F.col("y") - F.col("my")
    gram = train.join(mean, keys).groupBy(*keys).agg(
        *[F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(m) for j in range(i, m)], *[F.sum(x[i] * y).alias(f"b{i}") for i in range(m)])
    use = sets.groupBy(*keys, "members").agg(*[F.max((F.col("member") == f).cast("double")).alias(f"u{i}") for i, f in enumerate(members)])
    moments = use.join(mean, keys).join(gram, keys)
    for c in _axis_columns(m):
        moments = moments.withColumn(c, F.lit(0.0))
    named = [*keys, "members", "n", "my", *[f"m{i}" for i in range(m)], *_axis_columns(m)]
    # One row per (partition, set) goes through the solver.
    fits = settle(moments.mapInPandas(_axes(m, keys), moments.select(*named).schema))
    z = [sum(x[i] * F.col(f"a{i}_{j}") for i in range(m)).alias(f"z{j}") for j in range(m)]
    rows = train.join(fits, keys).select(*keys, "members", "n", y.alias("_y"), *z, *[f"l{j}" for j in range(m)], *[f"r{j}" for j in range(m)])
    errors = []
    for k, a in enumerate(alphas):
        part = [F.col(f"z{j}") / (F.col(f"l{j}") + F.lit(float(a))) for j in range(m)]
        fit, lev = sum(p * F.col(f"r{j}") for j, p in enumerate(part)), 1 / F.col("n") + sum(p * F.col(f"z{j}") for j, p in enumerate(part))
        errors.append(F.sum(F.pow((F.col("_y") - fit) / (1 - lev), 2)).alias(f"e{k}"))
    loo = rows.groupBy(*keys, "members").agg(*errors)
    every = F.array(*[f"e{k}" for k in range(len(alphas))])
    best = loo.select(*keys, "members", F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.array_position(every, F.array_min(every)).cast("int")).alias("alpha"))
    weights = [sum(F.col(f"a{i}_{j}") * F.col(f"r{j}") / (F.col(f"l{j}") + F.col("alpha")) for j in range(m)).alias(f"w{i}") for i in range(m)]
    coef = settle(fits.join(best, [*keys, "members"]).select(*keys, "members", "n", "alpha", "my", *[f"m{i}" for i in range(m)], *weights))
    pred = F.col("my") + sum(x[i] * F.col(f"w{i}") for i in range(m))
    out = columns.join(coef.drop("n"), keys).select(*keys, "members", "id", "role", "y", pred.alias("pred"))
    return out, coef.select(*keys, "members", "n", "alpha", *[F.col(f"w{i}").alias(f) for i, f in enumerate(members)])


# ---------------------------------------------------------------- probe and scoring
def probe(reps: dict[str, tuple[DataFrame, Sequence[str]]], alpha: float = 100.0) -> DataFrame:
    """(rep, n, r2, rmse, mae): the same ridge on several representations, scored on their test rows.

    Every table has y, role and its feature columns.
    """
    out = None
    for name, (df, cols) in reps.items():
        train = df.where("role = 'train'")
        n, sd = label_stats(train)
        model = Pipeline(stages=[*preprocess_stages(cols), ridge(alpha, n, sd)]).fit(train)
        m = regression_metrics(model.transform(df.where("role = 'test'"))).withColumn("rep", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.select("rep", "n", "r2", "rmse", "mae")


def bin_table(scored: DataFrame) -> DataFrame:
    """Measured error per similarity bin of a scored hold-out (y, pred, nn_sim)."""
    return binned_metrics(scored, "nn_sim").select("sim_bin", F.col("rmse").alias("bin_rmse"), F.col("n").alias("bin_n"))


def score(queries: DataFrame, model: PipelineModel, train_sets: DataFrame, bins: DataFrame, ident: str = "id", els: str = "els") -> DataFrame:
    """(id, pred, nn_sim, sim_bin, bin_rmse, bin_n, low_similarity) for every query row."""
    sims = nn_similarity(queries, train_sets, ident, els)
    rows = model.transform(queries).select(F.col(ident).alias("id"), "pred").join(sims.select("id", "nn_sim"), "id")
    rows = rows.withColumn("sim_bin", similarity_bin(F.col("nn_sim")))
    return rows.join(bins, "sim_bin", "left").select(
        "id", "pred", "nn_sim", "sim_bin", "bin_rmse", "bin_n", (F.col("nn_sim") < LOW_SIMILARITY).alias("low_similarity")
    )


def bin_lookup(df: DataFrame, bins: DataFrame, value: str) -> DataFrame:
    """Range join with a bin table (lo, hi, label, …); the table has one row per bin, a few dozen at most."""
    found = F.broadcast(bins)
    return df.join(found, (F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi")), "left")


