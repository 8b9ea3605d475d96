"""Models from pyspark.ml under the engine's splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gbt_classifier(df: DataFrame, features: list[str], label: str, depth: int = 4, rounds: int = 20, seed: int = 42):
    """Gradient-boosted trees with class weight (1 - p) / p; missing features become 0. Returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    p = df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.5
    weight = F.when(F.col(label) == 1, F.lit((1 - p) / p if p else 1.0)).otherwise(F.lit(1.0))
    x = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features], F.col(label).cast("double").alias("label"), weight.alias("weight"))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), GBTClassifier(maxDepth=depth, maxIter=rounds, seed=seed, weightCol="weight")]).fit(x)


def gbt_regressor(df: DataFrame, features: list[str], label: str, depth: int = 4, rounds: int = 20, seed: int = 42):
    """Gradient-boosted trees for a number; missing features become 0, rows without label don't train. Returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    x = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features], F.col(label).cast("double").alias("label")).filter("label is not null")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), GBTRegressor(maxDepth=depth, maxIter=rounds, seed=seed)]).fit(x)


def importances(fitted, features: list[str]) -> list[tuple[str, float]]:
    """Features of a fitted tree pipeline by their share of the gain, largest first."""
    return sorted(zip(features, map(float, fitted.stages[-1].featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


def expanding_folds(df: DataFrame, day: str, folds: int) -> DataFrame:
    """Rows by fold and part: fold i trains on the first i of ``folds`` + 1 equal stretches of distinct days and tests on the next."""
    days = df.select(day).distinct()
    n = days.count()
    stretch = F.least(F.floor((F.row_number().over(Window.orderBy(day)) - 1) * (folds + 1) / F.lit(max(1, n))), F.lit(folds)).cast("int")
    days = days.select(F.col(day).alias("__day"), stretch.alias("__stretch"))
    out = df.join(F.broadcast(days), F.col(day) == F.col("__day")).withColumn("fold", F.explode(F.sequence(F.greatest(F.col("__stretch"), F.lit(1)), F.lit(folds))))
    return out.withColumn("part", F.when(F.col("__stretch") < F.col("fold"), "train").otherwise("test")).drop("__day", "__stretch")


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One-variable least squares: slope, intercept, r2."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def linear_regression(df: DataFrame, features: list[str], label: str, reg: float = 0.0):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    x = df.select(*[F.col(c).cast("double") for c in features], F.col(label).cast("double").alias("label")).na.drop()
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), LinearRegression(regParam=reg, elasticNetParam=0.0)]).fit(x)


def lag_table(series: DataFrame, time: str, value: str, lags: int, entity: str) -> DataFrame:
    """Lags 1..n of a series as columns; rows without all of them go."""
    w = Window.partitionBy(entity).orderBy(time)
    return series.withColumns({f"lag_{i}": F.lag(value, i).over(w) for i in range(1, lags + 1)}).na.drop(subset=[f"lag_{lags}"])


def forecast(series: DataFrame, time: str, value: str, lags: int, horizon: int, entity: str, reg: float = 1.0) -> dict:
    """Recursive ridge forecast per entity: fits once on all lag rows, then rolls each series' last values forward."""
    cols = [f"lag_{i}" for i in range(1, lags + 1)]
    model = linear_regression(lag_table(series, time, value, lags, entity), cols, value, reg).stages[-1]
    coef, base = list(model.coefficients), model.intercept
    w = Window.partitionBy(entity).orderBy(F.desc(time))
    last = series.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= lags).groupBy(entity).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", value))), lambda s: s[value].cast("double")).alias("v"))
    for _ in range(horizon):
        step = sum((F.col("v")[i] * F.lit(float(c)) for i, c in enumerate(coef)), F.lit(float(base)))
        last = last.withColumn("v", F.concat(F.array(step), F.col("v")))
    return last.select(entity, F.posexplode(F.reverse(F.slice("v", 1, horizon))).alias("step", "forecast"))


def smooth(series: DataFrame, time: str, value: str, entity: str, alpha: float) -> DataFrame:
    """Simple exponential smoothing of each series: level after each row."""
    w = Window.partitionBy(entity).orderBy(time)
    seen = F.collect_list(F.col(value).cast("double")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    level = F.aggregate(F.slice(seen, 2, F.greatest(F.size(seen) - 1, F.lit(0))), F.element_at(seen, 1), lambda s, x: s * (1 - alpha) + x * alpha)
    return series.withColumn("level", level)
