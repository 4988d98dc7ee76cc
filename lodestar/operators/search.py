"""Nearest neighbours: exact for one and for many queries, and the choice of a plan."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import vector as V

#: Largest number of query rows that travel with a task; more are searched in blocks of this many.
QUERY_BLOCK = 2_000
#: Scores held at once, and candidates gathered before they are cut to the best.
SCORES, GATHERED = 4_000_000, 1_000_000


def top_k(records: DataFrame, query: Sequence[float], k: int = 10, metric: str = "cosine", where: Column | None = None, values: Sequence[str] = ()) -> DataFrame:
    """``(id, score, ...)`` of the k best records, ties by id. Nothing is shuffled but each task's k best."""
    rows = records if where is None else records.where(where)
    scored = rows.select("id", V.score_to(metric, F.col("values"), query).alias("score"), *values)
    return scored.orderBy(V.best_first(metric), F.col("id")).limit(config.check_top_k(k))


def _scan(qs: np.ndarray, names: pa.Array, k: int, metric: str, probes: dict[int, np.ndarray] | None = None):
    """Batches ``(id, values[, cell])`` to the k best ``(query_id, id, score)`` of each query in them: one matrix product a chunk, or one a cell for the queries that probe it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.full(len(qs), -np.inf)  # what a candidate has to reach
        pool, chunk = [], max(256, SCORES // max(1, len(qs)))

        def cut() -> None:
            t = pa.concat_tables(pool).combine_chunks() if pool else None
            pool.clear()
            if t is None or not t.num_rows:
                return
            t = t.take(pa.compute.sort_indices(t, [("q", "ascending"), ("key", "descending"), ("id", "ascending")]))
            q = t["q"].to_numpy()
            start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
            place = np.arange(len(q)) - np.repeat(start, np.diff(start, append=len(q)))
            full = np.flatnonzero(place == k - 1)
            floor[q[full]] = t["key"].to_numpy()[full]
            pool.append(t.filter(pa.array(place < k)))

        def pack(part: pa.RecordBatch) -> None:
            """One table of a chunk's hits, however many cells they are from: a table takes some KB even without rows."""
            if hits:
                q, key, rows = (np.concatenate(c) for c in zip(*hits, strict=True))
                pool.append(pa.table({"q": q, "key": key, "id": part.column(0).take(pa.array(rows))}))
                hits.clear()

        gathered, hits = 0, []
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                x = V.matrix(part.column(1), qs.shape[1])
                if probes is None:
                    groups = [(np.arange(len(x)), np.arange(len(qs)))]
                else:
                    cell = part.column(2).to_numpy(zero_copy_only=False)
                    by_cell = np.argsort(cell, kind="stable")
                    ends = np.flatnonzero(np.diff(cell[by_cell])) + 1
                    groups = [(rows, probes[c]) for rows in np.split(by_cell, ends) if len(rows) and (c := cell[rows[0]].item()) in probes]
                for rows, asked in groups:
                    key = V.keys(metric, qs[asked], x[rows])
                    least = floor[asked]
                    if len(rows) > k and np.isneginf(least).any():
                        least = np.maximum(least, np.partition(key, len(rows) - k, axis=1)[:, len(rows) - k])
                    qi, ri = np.nonzero(key >= least[:, None])
                    if len(qi):
                        hits.append((asked[qi], key[qi, ri], rows[ri]))
                        gathered += len(qi)
                    if gathered > GATHERED:
                        pack(part)
                        cut()
                        gathered = 0
                pack(part)
        cut()
        for t in pool:
            key = t["key"].to_numpy()
            score = -key if metric == "euclidean" else key
            out = pa.table({"query_id": names.take(t["q"].combine_chunks()), "id": t["id"], "score": pa.array(score, mask=~(np.abs(score) < V.LARGEST))})
            yield from out.to_batches()

    return run


def scanned(records: DataFrame, queries: DataFrame, k: int, metric: str, probes: dict[int, np.ndarray] | None = None) -> DataFrame:
    """The k best of each of a bounded number of queries, which travel with the tasks; each task sends k rows a query to the shuffle."""
    asked = queries.select("query_id", F.col("values").cast("array<float>").alias("values")).toArrow()
    first = next((v for v in asked["values"] if v.is_valid), None)
    qs = V.matrix(asked["values"].combine_chunks(), len(first) if first is not None else 1)
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    cols = ["id", F.col("values").cast("array<float>").alias("values"), *(["cell"] if probes is not None else [])]
    found = records.select(*cols).mapInArrow(_scan(qs, asked["query_id"].combine_chunks(), k, metric, probes), f"query_id {kind(queries, 'query_id')}, id {kind(records, 'id')}, score double")
    best = Window.partitionBy("query_id").orderBy(V.best_first(metric), F.col("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def query_blocks(queries: DataFrame) -> Iterator[DataFrame]:
    """Queries in blocks that a task can hold: by hashed ids, where there are more than ``QUERY_BLOCK``."""
    q = queries.select("query_id", "values")
    blocks = math.ceil(max(1, q.count()) / QUERY_BLOCK)
    for b in range(blocks):
        yield q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)


def batch_top_k(records: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """``(query_id, id, score, rank)`` of each query's k nearest records: one pass over the corpus for each block of queries."""
    config.check_top_k(k)
    parts = [scanned(records, part, k, metric) for part in query_blocks(queries)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def plan(live: int, index_type: str, matched: int | None = None, effort: int = config.DEFAULT_EF) -> tuple[str, int]:
    """Which way to search, and with what effort, from the number of live records and of those a filter matches."""
    if live == 0:
        return "empty", 0
    graph = index_type == "hnsw" or index_type == "auto" and live >= config.ANN_MIN_ROWS
    if matched is None:
        return ("hnsw", effort) if graph else ("exact", 0)
    if matched == 0:
        return "filtered-empty", 0
    if not graph or matched <= max(config.EXACT_MAX_ROWS, int(config.EXACT_MAX_SHARE * live)):
        return "filtered-exact", 0
    return "filtered-hnsw", int(min(max(effort / math.sqrt(matched / live), effort), 4 * effort))


def rank_delta(baseline: DataFrame, other: DataFrame) -> DataFrame:
    """``(id, rank, baseline_rank, delta)`` of another ranking's rows; a null delta is new to it."""
    base = baseline.select("id", F.col("rank").alias("baseline_rank"))
    return other.select("id", "rank").join(base, "id", "left").withColumn("delta", F.col("baseline_rank") - F.col("rank"))
