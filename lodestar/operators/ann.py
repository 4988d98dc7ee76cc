"""Approximate search: records are dealt to k-means cells, a query looks into the nearest few and scores those exactly."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from .search import batch_top_k, query_blocks, scanned, top_k

#: Rows on which cells are fitted, a documented sample (every row is dealt to a cell), and most cells there are.
FIT_ROWS, MOST_CELLS = 200_000, 4_096
#: Recall that the default number of probed cells reaches on the asking vectors (a margin: others may find 0.95), at so many neighbours, and how many rows ask for theirs to find it.
LEAST_RECALL, RECALL_K, ASKING_ROWS = 0.98, 10, 500

#: Distances of rows to centres held at once.
DISTANCES = 1_000_000


@dataclass(frozen=True)
class Cells:
    """Fitted cell centres (at most ``MOST_CELLS``, so they travel with the tasks), the metric they serve, and the cells a query probes by default (none: all)."""

    centres: list[list[float]]
    metric: str
    probes: int | None = None

    def order(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each row of a matrix, nearest first, ties by number."""
        c = np.array(self.centres)
        with np.errstate(all="ignore"):
            if self.metric == "cosine":
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
            far = (c**2).sum(axis=1)[None, :] - 2 * np.nan_to_num(x) @ c.T
        return far.argmin(axis=1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n]

    def nearest(self, values: Column, n: int) -> Column:
        """The n cells nearest to a vector, as an array of cell numbers; one matrix product a batch."""
        if len(self.centres) < 2:
            return F.array(F.lit(0))
        n = min(n, len(self.centres))

        def run(vectors: pa.Array) -> pa.Array:
            x = V.matrix(vectors, len(self.centres[0]))
            step = max(1, DISTANCES // len(self.centres))
            near = np.concatenate([self.order(x[k : k + step], n).astype(np.int32) for k in range(0, len(x), step)] or [np.empty((0, n), np.int32)])
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(near.ravel(), pa.int32()))

        return F.arrow_udf(run, "array<int>")(values.cast("array<float>"))


def fit_cells(records: DataFrame, metric: str = "cosine", k: int | None = None, seed: int = 0, total: int | None = None) -> Cells:
    """Centres of about the square root of the number of records; fewer than two records are one cell."""
    total = records.count() if total is None else total
    k = min(k or max(1, round(math.sqrt(total))), total, MOST_CELLS)
    if k < 2:
        first = records.select("values").first()
        return Cells([] if first is None else [[float(x) for x in first["values"]]], metric)
    sample = records if total <= FIT_ROWS else records.sample(FIT_ROWS / total, seed=seed)
    v = V.normalized(F.col("values")) if metric == "cosine" else F.col("values")
    rows = sample.select(array_to_vector(v.cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=10).fit(rows)
    return Cells([c.tolist() for c in model.clusterCenters()], metric)


def assign(records: DataFrame, cells: Cells) -> DataFrame:
    """Every record with its ``cell``: partition a table by it and a query reads only the cells it probes."""
    return records.withColumn("cell", F.get(cells.nearest(F.col("values"), 1), 0))


def measured(celled: DataFrame, cells: Cells) -> Cells:
    """``cells`` with the fewest probes that find ``LEAST_RECALL`` of the ``RECALL_K`` nearest rows; all cells where fewer do not.

    Half of the asking vectors are a bounded sample of the rows. The other half are differences of two rows
    of it: near no cell, as queries from elsewhere are. Both halves have to reach the recall.
    """
    rows = celled.select("id", "values")
    taken = rows.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(ASKING_ROWS // 2).select("values").toArrow()["values"].combine_chunks()
    known = next((v for v in taken if v.is_valid), None)
    if known is None:
        return cells
    x = V.matrix(taken, len(known))
    x = x[~np.isnan(x).any(axis=1)]
    with np.errstate(all="ignore"):
        unit = x / np.linalg.norm(x, axis=1, keepdims=True) if cells.metric == "cosine" else x
    asked = np.concatenate((x, np.nan_to_num(unit - np.roll(unit, 1, axis=0))))
    q = celled.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, values array<float>")
    truth = batch_top_k(rows, q, RECALL_K, cells.metric).select("query_id", "id")
    order = q.select("query_id", cells.nearest(F.col("values"), len(cells.centres)).alias("order"))
    found = truth.join(celled.select("id", "cell"), "id").join(order, "query_id")
    counts = found.groupBy((F.col("query_id") < len(x)).alias("own"), F.array_position("order", F.col("cell")).alias("effort")).count().collect()
    needed = []
    for own in (True, False):
        half = sorted((c["effort"], c["count"]) for c in counts if c["own"] == own)
        upto = np.cumsum([n for _, n in half])
        needed += [half[int(np.searchsorted(upto, LEAST_RECALL * upto[-1]))][0]] if half else []
    return replace(cells, probes=int(max(needed))) if needed else cells


def probe(celled: DataFrame, cells: Cells, query: Sequence[float], k: int, metric: str, nprobe: int | None = None, where: Column | None = None) -> DataFrame:
    """Top k of one query among its nearest cells; the filter applies before scoring."""
    nprobe = nprobe or cells.probes or len(cells.centres)
    near = cells.order(np.array([list(query)], np.float64), nprobe)[0].tolist() if len(cells.centres) > 1 else [0]
    return top_k(celled.where(F.col("cell").isin(near)), query, k, metric, where)


def batch_probe(celled: DataFrame, cells: Cells, queries: DataFrame, k: int = 10, metric: str = "cosine", nprobe: int | None = None, where: Column | None = None) -> DataFrame:
    """``(query_id, id, score, rank)``: each record meets the queries that probe its cell, where it stands; work follows cell sizes and nothing but each task's best is shuffled."""
    nprobe = nprobe or cells.probes or len(cells.centres) or 1
    rows = celled if where is None else celled.where(where)
    out = None
    for block in query_blocks(queries):
        block = block.orderBy("query_id")
        asked = block.select(cells.nearest(F.col("values"), nprobe).alias("c")).toArrow()["c"].to_pylist()
        by_cell: dict[int, list[int]] = {}
        for i, near in enumerate(asked):
            for c in near:
                by_cell.setdefault(c, []).append(i)
        part = scanned(rows, block, k, metric, {c: np.array(i, np.int32) for c, i in by_cell.items()})
        out = part if out is None else out.unionByName(part)
    return out
