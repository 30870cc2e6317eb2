"""Significance of experiment results: aggregates in Spark, distribution functions as vectorised UDFs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_lower(t: float, df: float) -> float:
    """P(T <= t) for Student's t."""
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0 if t < 0 else 1.0
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return tail if t < 0 else 1 - tail


@F.pandas_udf(T.DoubleType())
def t_lower_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([math.nan if pd.isna(a) or pd.isna(b) else t_lower(float(a), float(b)) for a, b in zip(t, df, strict=True)])


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return pd.Series([math.nan if pd.isna(x) else 0.5 * (1 + math.erf(float(x) / math.sqrt(2))) for x in z])


@F.pandas_udf(T.DoubleType())
def erf(x: pd.Series) -> pd.Series:
    return pd.Series([math.nan if pd.isna(v) else math.erf(float(v)) for v in x])


def summarise(rows: DataFrame, by: list[str], value: str, target: float) -> DataFrame:
    """n, mean, sample deviation, standard error, extremes and the one-sample t against ``target``, for each group."""
    v = F.col(value)
    out = rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    out = out.withColumn("stderr", F.col("std") / F.sqrt("n"))
    return out.withColumn("t", F.when(F.col("stderr") > 0, (F.col("mean") - target) / F.col("stderr"))).withColumn("df", F.col("n") - 1)


def one_sample_less(rows: DataFrame, by: list[str], value: str, target: float) -> DataFrame:
    """``summarise`` with the p-value of "the mean is below the target"."""
    return summarise(rows, by, value, target).withColumn("p", t_lower_p("t", F.col("df").cast("double")))


def z_test_less(rows: DataFrame, by: list[str], value: str, target: float, sigma: float) -> DataFrame:
    """One-sided z test with a known deviation."""
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return out.withColumn("z", (F.col("mean") - target) / (F.lit(sigma) / F.sqrt("n"))).withColumn("p", normal_cdf("z"))


def welch(rows: DataFrame, arm: str, value: str, a: object, b: object) -> DataFrame:
    """Welch's t of two arms, and the p-value of "arm a is below arm b": one row."""
    of = lambda x: F.when(F.col(arm) == x, F.col(value))
    out = rows.agg(*(f(of(x)).alias(f"{n}_{k}") for k, x in (("a", a), ("b", b)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))))
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    out = out.withColumn("t", F.when(va + vb > 0, (F.col("mean_a") - F.col("mean_b")) / F.sqrt(va + vb)))
    out = out.withColumn("df", F.when(va + vb > 0, (va + vb) * (va + vb) / (va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))))
    return out.withColumn("p", t_lower_p("t", "df"))


# Fixed values of the acceptance rules: the target loss, the margin of a result, and the loss that a hundred steps are worth.
TARGET, MARGIN, LOSS_PER_100_STEPS = 3.28, 0.004, 0.0045


def precision_rule(mean: Column, n: Column, target: float = TARGET, margin: float = MARGIN) -> tuple[Column, Column, Column]:
    """Statistic, whether it passes, and the runs that the mean would need to pass."""
    statistic = (F.lit(target) - mean) * F.sqrt(n)
    needed = F.when(F.lit(target) - mean > 0, F.ceil(F.pow(F.lit(margin) / (F.lit(target) - mean), 2)))
    return statistic, statistic >= margin, needed


def pairwise_rule(loss_difference: Column, step_difference: Column, n1: Column, n2: Column, margin: float = MARGIN) -> tuple[Column, Column]:
    """Statistic of one result against another, and whether the difference counts."""
    statistic = (loss_difference + step_difference * F.lit(LOSS_PER_100_STEPS) / 100) / F.sqrt(1 / n1 + 1 / n2)
    return statistic, statistic >= margin


def bootstrap_interval(means: DataFrame, level: float = 0.99) -> DataFrame:
    edge = (1 - level) / 2
    return means.agg(F.avg("mean").alias("mean"), F.expr(f"percentile(mean, {edge})").alias("low"), F.expr(f"percentile(mean, {1 - edge})").alias("high"))
