"""MLlib-backed models (M12–M15), permutation importance (M20) and
cross-validated grid search (E20).

Tree ensembles, the preprocessing pipeline and CV are Spark ML estimators —
distributed training, no driver-side data.  Permutation importance permutes
a feature's test values with a seeded hash order (distributed ranks, no
single-partition window) and scores every feature of one repeat in ONE
transform over a frame that carries a feature id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riselens.operators.order import global_rank


def modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most-frequent value per categorical column (ties by value), one aggregate each."""
    fills = {}
    for c in cols:
        top = df.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.col("count").desc(), F.col(c)).first()
        if top is not None:
            fills[c] = top[c]
    return fills


def fill_stage(fills: dict) -> SQLTransformer:
    """``c__fill`` per column: nulls replaced by the value fitted on the training rows."""
    quoted = {c: "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" for c, v in fills.items()}
    return SQLTransformer(statement="SELECT *, " + ", ".join(f"coalesce(`{c}`, {v}) AS `{c}__fill`" for c, v in quoted.items()) + " FROM __THIS__")


def tabular_pipeline(numeric: Sequence[str], categorical: Sequence[str], fills: dict, out: str = "features") -> Pipeline:
    """Median-impute + standardise numerics; mode-fill (``fills``) and
    one-hot categoricals with unknown levels mapped to all zeros (index 'keep' +
    drop of that last slot)."""
    stages = [fill_stage(fills)] if fills else []
    num_imp = [f"{c}__imp" for c in numeric]
    if numeric:
        stages.append(Imputer(strategy="median", inputCols=list(numeric), outputCols=num_imp))
        stages.append(VectorAssembler(inputCols=num_imp, outputCol="_num_raw", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="_num_raw", outputCol="_num", withMean=True, withStd=True))
    cat_vec = []
    for c in categorical:
        stages.append(StringIndexer(inputCol=f"{c}__fill" if c in fills else c, outputCol=f"{c}__idx", handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"{c}__idx", outputCol=f"{c}__ohe", dropLast=True))
        cat_vec.append(f"{c}__ohe")
    stages.append(VectorAssembler(inputCols=(["_num"] if numeric else []) + cat_vec, outputCol=out))
    return Pipeline(stages=stages)


def regressor(kind: str, label: str = "label", features: str = "features", seed: int = 42, **params):
    """M13 / M14 estimators by name."""
    if kind == "linear":
        return LinearRegression(labelCol=label, featuresCol=features, **params)
    if kind == "random_forest":
        return RandomForestRegressor(labelCol=label, featuresCol=features, seed=seed, **params)
    if kind == "gbt":
        return GBTRegressor(labelCol=label, featuresCol=features, seed=seed, **params)
    raise ValueError(kind)


def fit_trees(train: DataFrame, kind: str, numeric: Sequence[str], categorical: Sequence[str], label: str,
              **params):
    """Preprocessing pipeline + regressor, fitted on ``train``."""
    pipe = tabular_pipeline(numeric, categorical, modes(train, categorical))
    est = regressor(kind, label=label, **params)
    return Pipeline(stages=[pipe, est]).fit(train)


def zero_stage(cols: Sequence[str]) -> SQLTransformer:
    """``c__zero`` per column: nulls and NaN as 0, as in the Grams of the linear stages."""
    filled = (f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE)), 0.0D) AS `{c}__zero`" for c in cols)
    return SQLTransformer(statement="SELECT *, " + ", ".join(filled) + " FROM __THIS__")


def boosted_residual_model(train: DataFrame, features: Sequence[str], label: str, valid_col: str,
                           max_iter: int = 400, step: float = 0.05, depth: int = 4, seed: int = 42):
    """Boosted trees on the residual with early stopping on a validation
    slice of the TRAINING rows (``valid_col`` true), not on the test set.

    The trees take no NaN: a feature without a value (of a title without
    words) is 0."""
    asm = VectorAssembler(inputCols=[f"{c}__zero" for c in features], outputCol="features")
    gbt = GBTRegressor(labelCol=label, featuresCol="features", validationIndicatorCol=valid_col,
                       maxIter=max_iter, stepSize=step, maxDepth=depth, subsamplingRate=0.7,
                       featureSubsetStrategy="0.7", minInstancesPerNode=60, seed=seed, validationTol=1e-4)
    return Pipeline(stages=[zero_stage(features), asm, gbt]).fit(train)


def evaluate(model, df: DataFrame, label: str, pred: str = "prediction") -> dict:
    """rmse, mae, r2 and n in one pass; r2 is null where the label does not vary."""
    mse, spread = F.avg((F.col(label) - F.col(pred)) ** 2), F.var_pop(label)
    agg = model.transform(df).agg(
        F.sqrt(mse).alias("rmse"), F.avg(F.abs(F.col(label) - F.col(pred))).alias("mae"),
        F.when(spread > 0, 1 - mse / spread).alias("r2"), F.count(F.lit(1)).alias("n")).first()
    return agg.asDict()


def permutation_importance(model, test: DataFrame, features: Sequence[str], label: str, repeats: int = 15,
                           seed: int = 42, key: str = "post_id") -> DataFrame:
    """Mean / std increase of test RMSE when one feature is permuted.

    Per repeat a permutation is the pairing of two distributed ranks (by key,
    and by a seeded hash of the key); the frame is exploded once per feature
    with only that feature replaced by its partner's value and scored in a
    single transform; RMSE is aggregated per feature.
    """
    spark = test.sparkSession
    base_rmse = evaluate(model, test, label)["rmse"]
    results = []
    ranked = global_rank(test, [key], "_r0")
    for r in range(repeats):
        h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(f"{seed}:{r}")))
        perm = global_rank(test.select(key, *features).withColumn("_h", h), ["_h", key], "_r1")
        partner = perm.select(F.col("_r1").alias("_r0"), *[F.col(c).alias(f"_p_{c}") for c in features])
        j = ranked.join(partner, "_r0")
        ex = j.withColumn("_fid", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
        ex = ex.withColumns({c: F.when(F.col("_fid") == i, F.col(f"_p_{c}")).otherwise(F.col(c))
                             for i, c in enumerate(features)})
        scored = model.transform(ex)
        res = scored.groupBy("_fid").agg(F.sqrt(F.avg((F.col(label) - F.col("prediction")) ** 2)).alias("rmse"))
        for row in res.collect():
            results.append((features[row["_fid"]], r, row["rmse"] - base_rmse))
    df = spark.createDataFrame(results, "feature string, rep int, delta_rmse double")
    return df.groupBy("feature").agg(F.avg("delta_rmse").alias("importance_mean"),
                                     F.stddev_samp("delta_rmse").alias("importance_std")).orderBy(
        F.col("importance_mean").desc(), "feature")


def _columns_with_holes(data: DataFrame, cols: Sequence[str], folds: int) -> dict[str, bool]:
    """Columns that miss values (null or NaN), in one pass; true where the training
    rows of some fold have no value at all, so that there is no median."""
    has = [F.count(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in cols]
    counts = data.groupBy("_fold").agg(F.count(F.lit(1)).alias("_n"), *has).collect()
    total = {c: sum(r[c] for r in counts) for c in cols}
    own = {r["_fold"]: r for r in counts}
    return {c: any(total[c] == (own[f][c] if f in own else 0) for f in range(folds))
            for c in cols if total[c] < sum(r["_n"] for r in counts)}


def grid_search(train: DataFrame, kind: str, features: Sequence[str], label: str, grid: dict, folds: int = 3,
                seed: int = 42, key: str = "post_id") -> DataFrame:
    """K-fold CV over a parameter grid (fold ids from a hash of the key).

    The trees take no NaN: missing values get the column's median, fitted with
    the model on the training rows of each fold."""
    est = regressor(kind, label=label, seed=seed)
    pb = ParamGridBuilder()
    for name, values in grid.items():
        pb = pb.addGrid(est.getParam(name), list(values))
    maps = pb.build()
    fold = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int")
    data = train.withColumn("_fold", fold)
    holes = _columns_with_holes(data, features, folds)
    data = data.fillna(0, [c for c, empty in holes.items() if empty])
    gaps = [c for c, empty in holes.items() if not empty]
    asm = VectorAssembler(inputCols=[f"{c}__imp" if c in gaps else c for c in features], outputCol="features")
    if gaps:
        imputer = Imputer(strategy="median", inputCols=gaps, outputCols=[f"{c}__imp" for c in gaps])
        fitted = Pipeline(stages=[imputer, asm, est])
    else:
        data, fitted = asm.transform(data), est
    cv = CrossValidator(estimator=fitted, estimatorParamMaps=maps, numFolds=folds, foldCol="_fold", parallelism=2,
                        evaluator=RegressionEvaluator(labelCol=label, metricName="rmse"), seed=seed)
    m = cv.fit(data)
    rows = [({p.name: v for p, v in pm.items()}, float(metric)) for pm, metric in zip(maps, m.avgMetrics)]
    spark = train.sparkSession
    return spark.createDataFrame([(str(sorted(p.items())), metric) for p, metric in rows],
                                 "params string, cv_rmse double").orderBy("cv_rmse", "params")
