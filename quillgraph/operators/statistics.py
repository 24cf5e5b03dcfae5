"""Tests between groups: sufficient statistics in Spark, tails for the few resulting rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import tails


def moments(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean and sample variance of each group, nulls left out."""
    v = F.col(value)
    return rows.where(v.isNotNull() & ~F.isnan(v.cast("double"))).groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))


def welch(a: DataFrame, b: DataFrame, on: list[str], least: int = 5) -> DataFrame:
    """t, df and two-sided p between the groups of two moments() tables; null where a group has under `least` rows or nothing varies."""
    x = a.select(*on, F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("var").alias("v1"))
    y = b.select(*on, F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("var").alias("v2"))
    at = x.join(y, on) if on else x.crossJoin(y)  # one row each without keys
    ok = (F.col("n1") >= least) & (F.col("n2") >= least)
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(e1 + e2))
    df = F.try_divide((e1 + e2) * (e1 + e2), F.try_divide(e1 * e1, F.col("n1") - 1) + F.try_divide(e2 * e2, F.col("n2") - 1))
    at = at.withColumn("t", F.when(ok, t)).withColumn("df", F.when(ok, df))
    return _tail(at, lambda r: tails.t_two_sided(r["t"], r["df"]))


def anova(groups: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """F, its degrees of freedom and p over the groups of a moments() table with at least `least` rows, if two or more remain."""
    g = groups.where(F.col("n") >= least)
    at = g.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("s2"), F.sum((F.col("n") - 1) * F.col("var")).alias("within"))
    at = at.where("k >= 2").withColumn("between", F.col("s2") - F.col("n") * F.col("grand") * F.col("grand")).withColumn("df1", F.col("k") - 1).withColumn("df2", F.col("n") - F.col("k"))
    at = at.withColumn("f", F.try_divide(F.col("between") / F.col("df1"), F.col("within") / F.col("df2")))
    return _tail(at.select(*by, "k", "n", "between", "within", "df1", "df2", "f"), lambda r: tails.f_upper(r["f"], r["df1"], r["df2"]))


def ratio_difference(at: DataFrame, r1: str, c1: str, r2: str, c2: str) -> DataFrame:
    """z and two-sided p of the difference of two ratios from their 95 % half widths; null where both are 0."""
    se = F.sqrt(F.pow(F.col(c1) / 1.96, 2.0) + F.pow(F.col(c2) / 1.96, 2.0))
    return _tail(at.withColumn("z", F.try_divide(F.abs(F.col(r1) - F.col(r2)), se)), lambda r: tails.normal_two_sided(r["z"]))


def _tail(at: DataFrame, p) -> DataFrame:
    """at with p, computed row by row on executors; these tables have a row for each group."""

    def run(batches):
        for f in batches:
            f["p"] = [None if any(x is None or (isinstance(x, float) and math.isnan(x)) for x in (r.get("t", 0), r.get("f", 0), r.get("z", 0))) else p(r) for r in f.to_dict("records")]
            f["p"] = f["p"].astype("float64")
            yield f

    return at.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in at.dtypes) + ", p double")
