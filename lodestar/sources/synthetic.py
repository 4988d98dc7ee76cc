"""Made-up vectors in clusters, for tests and benchmarks of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def gaussian(*keys: Column) -> Column:
    """A standard normal number drawn by hash: equal keys, equal numbers, in every run and on every executor."""
    h = F.xxhash64(*keys)
    part = lambda x: (x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("double") + 0.5) / float(1 << 31)
    return F.sqrt(-2 * F.log(part(h))) * F.cos(2 * math.pi * part(F.shiftrightunsigned(h, 32)))


def clustered(spark: SparkSession, n: int, dimension: int, clusters: int = 256, spread: float = 0.5, seed: int = 0) -> DataFrame:
    """``(id, cluster, values)``: ``n`` points around ``clusters`` centres; axis i has the scale 3 over the root of i."""
    rows = spark.range(n).select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(clusters)).alias("cluster"))
    axis = lambda i: (gaussian(F.col("cluster"), i, F.lit(seed)) + spread * gaussian(F.col("id"), i, F.lit(seed + 1), F.lit("point"))) * 3 / F.sqrt(i.cast("double"))
    return rows.withColumn("values", F.transform(F.sequence(F.lit(1), F.lit(dimension)), axis).cast("array<float>"))
