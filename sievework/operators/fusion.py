"""Evidence fusion: features, a sign-constrained logistic model, calibration maps, distance from known texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.stats import logit, sigmoid


def score_features(p: Column) -> tuple[Column, Column]:
    """A probability as a clipped, scaled logit, and whether it is missing."""
    z = logit(p)
    return F.when(p.isNull(), 0.0).otherwise(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z)) / 4), F.when(p.isNull(), 1.0).otherwise(0.0)


def capped_half(c: Column) -> Column:
    return F.least(F.coalesce(c, F.lit(0.0)), F.lit(4.0)) / 2


def linear_score(features: Column, weights: list[float], bias: float) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return sigmoid(F.aggregate(F.zip_with(features, w, lambda x, y: x * y), F.lit(float(bias)), lambda a, x: a + x))


def contributions(features: Column, names: list[str], weights: list[float], least: float = 0.05) -> Column:
    """array<struct(name, value)> of w * x that matter, largest first."""
    w, n = F.array(*[F.lit(float(x)) for x in weights]), F.array(*[F.lit(x) for x in names])
    both = F.zip_with(F.zip_with(features, w, lambda x, y: x * y), n, lambda v, k: F.struct(F.abs(v).alias("size"), k.alias("name"), v.alias("value")))
    kept = F.filter(both, lambda x: x["size"] >= least)
    return F.transform(F.reverse(F.array_sort(kept)), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))


def fit_bounded(rows: DataFrame, features: list[str], label: str, weight: str, positive: list[str] = (), negative: list[str] = (), l2: float = 1.0):
    """Weighted logistic regression with sign bounds on coefficients; l2 is the penalty on the sum of losses."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import DenseMatrix

    total = rows.agg(F.sum(weight)).first()[0] or 1.0
    low = [0.0 if f in positive else float("-inf") for f in features]
    high = [0.0 if f in negative else float("inf") for f in features]
    lr = LogisticRegression(featuresCol="_x", labelCol=label, weightCol=weight, regParam=l2 / total, elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-10)
    lr = lr.setLowerBoundsOnCoefficients(DenseMatrix(1, len(features), low)).setUpperBoundsOnCoefficients(DenseMatrix(1, len(features), high))
    model = lr.fit(VectorAssembler(inputCols=features, outputCol="_x").transform(rows))
    return list(map(float, model.coefficients)), float(model.intercept)


def fit_platt(rows: DataFrame, z: str, label: str) -> tuple[float, float]:
    """(slope >= 0, intercept) with smoothed targets: each row counts for both classes by its target."""
    n1, n0 = rows.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)), F.sum(F.when(F.col(label) == 1, 0).otherwise(1))).first()
    target = F.when(F.col(label) == 1, (n1 + 1) / (n1 + 2)).otherwise(1 / (n0 + 2))
    both = rows.select(F.col(z).alias("z"), F.explode(F.array(F.struct(F.lit(1.0).alias("y"), target.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - target).alias("w")))).alias("r")).select("z", "r.*")
    (slope,), intercept = fit_bounded(both, ["z"], "y", "w", positive=["z"], l2=0.0)
    return slope, intercept


def fit_isotonic(rows: DataFrame, z: str, label: str, weight: str | None = None):
    from pyspark.ml.regression import IsotonicRegression

    data = rows.select(F.col(z).cast("double").alias("features"), F.col(label).cast("double").alias("label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"))
    model = IsotonicRegression(weightCol="weight").fit(data)
    return list(map(float, model.boundaries)), list(map(float, model.predictions))


def fit_distance(vectors: DataFrame, column: str, k: int, quantile: float = 0.99):
    """PCA and the quantile of the scaled distance in it: (mean, components, variances, threshold)."""
    import numpy as np
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    dim = vectors.select(F.size(column)).first()[0]
    stats = vectors.agg(*[F.avg(F.col(column)[i]).alias(f"m{i}") for i in range(dim)]).first()
    mean = np.array([float(x) for x in stats])
    data = vectors.select(array_to_vector(F.col(column).cast("array<double>")).alias("x"))
    model = PCA(k=k, inputCol="x", outputCol="p").fit(data)
    comps = model.pc.toArray().T
    proj = model.transform(data).select(vector_to_array("p").alias("p"))
    var = np.array([float(x) for x in proj.agg(*[F.var_pop(F.col("p")[i]) for i in range(k)]).first()]) + 1e-6
    d = distance(vectors, column, mean, comps, var, "d")
    return mean, comps, var, d.agg(F.percentile("d", quantile)).first()[0]


def distance(vectors: DataFrame, column: str, mean, components, variances, name: str) -> DataFrame:
    """Mahalanobis distance in the fitted space, as column functions; the fitted arrays are literals of fixed size."""
    c = F.zip_with(F.col(column), F.array(*[F.lit(float(x)) for x in mean]), lambda x, m: x - m)
    rows = vectors.withColumn("_c", c)
    total = F.lit(0.0)
    for comp, v in zip(components, variances):
        dot = F.aggregate(F.zip_with("_c", F.array(*[F.lit(float(x)) for x in comp]), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
        total = total + F.pow(dot, 2) / float(v)
    return rows.withColumn(name, F.sqrt(total)).drop("_c")
