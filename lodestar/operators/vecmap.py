"""A map of an index in two dimensions: sample, principal components, clusters."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument


def sample(records: DataFrame, limit: int = 1500, seed: int = 0) -> DataFrame:
    """A repeatable sample: the rows whose hashed ids come first."""
    if not 1 <= limit <= 5000:
        raise InvalidArgument("limit must be 1 to 5000")
    return records.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(limit)


def vector_map(records: DataFrame, limit: int = 1500, clusters: int = 6, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """``(id, x, y, cluster)`` of a sample with both axes scaled into [-1, 1], and the variance the axes explain."""
    rows = sample(records, limit, seed).select("id", array_to_vector(F.col("values").cast("array<double>")).alias("features")).persist()
    n, d = rows.count(), len(rows.first()["features"]) if not rows.isEmpty() else 0
    if n < 2 or d < 2:
        flat = F.lit(0.0)
        one = vector_to_array("features")
        x = one[0] - F.avg(one[0]).over(_all()) if d == 1 and n else flat
        return rows.select("id", x.alias("x"), flat.alias("y"), F.lit(0).alias("cluster")), [1.0 if d == 1 and n > 1 else 0.0, 0.0]
    k = min(8, d)
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(rows)
    p = model.transform(rows).select("id", vector_to_array("pcs").alias("p"))
    mean = p.select(*[F.avg(F.col("p")[i]).alias(f"m{i}") for i in range(k)])
    centred = p.crossJoin(F.broadcast(mean)).select("id", F.array(*[F.col("p")[i] - F.col(f"m{i}") for i in range(k)]).alias("p"))
    if n > clusters:
        fitted = KMeans(k=clusters, seed=seed, maxIter=30, featuresCol="v", predictionCol="cluster").fit(centred.select(array_to_vector("p").alias("v")))
        centred = fitted.transform(centred.withColumn("v", array_to_vector("p"))).select("id", "p", "cluster")
    else:
        centred = centred.withColumn("cluster", F.lit(0))
    top = F.max(F.greatest(F.abs(F.col("p")[0]), F.abs(F.col("p")[1]))).over(_all())
    at = lambda i: F.round(F.coalesce(F.try_divide(F.col("p")[i], top), F.lit(0.0)), 5)
    return centred.select("id", at(0).alias("x"), at(1).alias("y"), "cluster"), [round(float(v), 4) for v in model.explainedVariance.toArray()[:2]]


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # over at most 5000 sampled rows
