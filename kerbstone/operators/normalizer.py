"""Per-column standardization of feature vectors, fitted in one pass and stored as one row per column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: keeps the division finite.
EPSILON = 1e-6


def fit(rows: DataFrame, column: str = "features", log_columns: Iterable[int] = ()) -> DataFrame:
    """``pos, n, mean, std``: count, mean and sample deviation of each position of an array column.

    Non-finite deviations and those of fewer than two values are 1. Columns named in ``log_columns`` are taken
    as log(1 + x). The moments merge from partial aggregates.
    """
    logged = [int(i) for i in log_columns]
    value = F.when(F.col("pos").isin(logged), F.log1p("value")).otherwise(F.col("value")) if logged else F.col("value")
    each = rows.select(F.posexplode(column).alias("pos", "value")).withColumn("value", value)
    std = F.coalesce(F.stddev_samp("value"), F.lit(1.0))
    return each.groupBy("pos").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.when(F.isnan(std) | (F.abs(std) == float("inf")), 1.0).otherwise(std).alias("std"))


def transform(rows: DataFrame, stats: DataFrame, column: str = "features", log_columns: Iterable[int] = ()) -> DataFrame:
    """The column standardized; positions without statistics are taken as mean 0 and deviation 1.

    ``stats`` has a row per position of the vector and is collected.
    """
    known = {r["pos"]: (r["mean"], r["std"]) for r in stats.collect()}
    width = max(known, default=-1) + 1
    means, stds = (F.array(*[F.lit(float(known.get(i, (0.0, 1.0))[k])) for i in range(width)]).cast("array<double>") for k in (0, 1))
    logged = F.array(*[F.lit(int(i)) for i in log_columns]).cast("array<int>")
    one = lambda x, i: (F.when(F.array_contains(logged, i), F.log1p(x)).otherwise(x) - F.coalesce(F.get(means, i), F.lit(0.0))) / (F.coalesce(F.get(stds, i), F.lit(1.0)) + EPSILON)
    return rows.withColumn(column, F.transform(column, one))
