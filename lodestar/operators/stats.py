"""Reports over records, requests and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper edges of the latency histogram in milliseconds; the last bucket is open.
EDGES_MS = (0.25, 0.5, 1, 2.5, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000)


def namespace_stats(records: DataFrame, where: Column | None = None) -> DataFrame:
    """``(namespace, records)``: matches per namespace, none left out, and the total under null."""
    hit = F.lit(True) if where is None else where
    return records.rollup("namespace").agg(F.count_if(hit).alias("records"))


def latency_summary(samples: DataFrame, window_s: float = 60.0) -> DataFrame:
    """``(route, index, samples, qps, p50, p95, p99, errors)`` overall, by route and by index over the last ``window_s`` seconds of ``(ts, route, index, ms, error)``.

    The end of the window is the newest sample. Equal samples are counted before they meet in a percentile.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    end = samples.agg(F.max(at).alias("end"))
    recent = samples.withColumn("at", at).join(F.broadcast(end), F.col("at") > F.col("end") - F.lit(round(window_s * 1e6)))
    counted = recent.groupBy("route", "index", "ms").agg(F.count("*").alias("n"), F.count_if("error").alias("errors"))
    by = counted.groupingSets([[], [F.col("route")], [F.col("index")]], "route", "index")
    p = F.percentile("ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.col("n"))
    out = by.agg(F.sum("n").alias("samples"), F.sum("errors").alias("errors"), p.alias("p"), F.grouping_id().alias("level")).where("samples > 0")
    return out.select("level", "route", "index", "samples", "errors", F.round(F.col("samples") / window_s, 2).alias("qps"), *[F.col("p")[i].alias(f"p{n}") for i, n in enumerate((50, 95, 99))])


def bench_latency(samples: DataFrame) -> DataFrame:
    """``(route, mean_ms, p50, p95, p99, qps)`` of requests made one after the other: as many a second as their time allows."""
    p = F.percentile("ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.col("n"))
    counted = samples.groupBy("route", "ms").agg(F.count("*").alias("n"))
    total = F.sum(F.col("ms") * F.col("n"))
    one = counted.groupBy("route").agg((total / F.sum("n")).alias("mean_ms"), p.alias("p"), F.try_divide(1000 * F.sum("n"), total).alias("qps"))
    return one.select("route", "mean_ms", *[F.col("p")[i].alias(f"p{n}") for i, n in enumerate((50, 95, 99))], "qps")


def legend_counts(points: DataFrame, by: str) -> DataFrame:
    """``(by, n)``: how many points each entry of a legend stands for, most first."""
    return points.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def latency_histogram(samples: DataFrame, by: str = "route", edges: Sequence[float] = EDGES_MS) -> DataFrame:
    """``(by, edge, upto)``: cumulative counts at each edge and infinity (null), with sum and count of the route."""
    sums = [F.count_if(F.col("ms") <= e).alias(f"e{i}") for i, e in enumerate(edges)]
    one = samples.groupBy(by).agg(*sums, F.count("*").alias("samples"), F.sum("ms").alias("total_ms"))
    rows = F.array(*[F.struct(F.lit(float(e)).alias("edge"), F.col(f"e{i}").alias("upto")) for i, e in enumerate(edges)], F.struct(F.lit(None).cast("double").alias("edge"), F.col("samples").alias("upto")))
    return one.select(by, F.explode(rows).alias("x"), "samples", "total_ms").select(by, "x.edge", "x.upto", "samples", "total_ms")


def request_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("route", "method", "index", "status").agg(F.count("*").alias("requests"))


def prometheus(histogram: DataFrame, by: str = "route", name: str = "request_ms") -> DataFrame:
    """A cumulative histogram as lines of the exposition format: buckets, sum and count."""
    edge = F.coalesce(F.col("edge").cast("string"), F.lit("+Inf"))
    buckets = histogram.select(F.format_string(f'{name}_bucket{{{by}="%s",le="%s"}} %d', by, edge, "upto").alias("line"))
    whole = histogram.where("edge is null")
    sums = whole.select(F.format_string(f'{name}_sum{{{by}="%s"}} %.2f', by, "total_ms").alias("line"))
    return buckets.unionByName(sums).unionByName(whole.select(F.format_string(f'{name}_count{{{by}="%s"}} %d', by, "samples").alias("line")))


def prometheus_values(rows: DataFrame, name: str, labels: Sequence[str], value: str) -> DataFrame:
    """Counters or gauges as lines of the exposition format: one a row."""
    said = ",".join(f'{c}="%s"' for c in labels)
    return rows.select(F.format_string(f"{name}{{{said}}} %d", *labels, value).alias("line"))


def group_fields(groups: DataFrame, least: int = 2, most: int = 12) -> DataFrame:
    """Fields of ``(field, value)`` with few enough distinct values to colour by."""
    return groups.where("value is not null").groupBy("field").agg(F.count_distinct("value").alias("groups")).where(F.col("groups").between(least, most))


def facets(values: DataFrame, fields: int = 3) -> DataFrame:
    """``(field, value, n)`` of the first fields by name with 2 to 8 values of at most 40 characters, most frequent first."""
    short = values.where("value is not null and length(value) <= 40")
    counted = short.groupBy("field", "value").agg(F.count("*").alias("n"))
    few = counted.groupBy("field").agg(F.count("*").alias("k")).where("k between 2 and 8").orderBy("field").limit(fields)
    return counted.join(few.select("field"), "field", "left_semi").orderBy("field", F.desc("n"), "value")


def unpivot_fields(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Columns to ``(field, value)`` rows, values as text."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return rows.select(F.explode(pairs).alias("x")).select("x.field", "x.value")


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of the true k nearest that were found, over all queries. Both are ``(query_id, id, rank)``."""
    t = truth.where(F.col("rank") <= k).select("query_id", "id")
    f = found.where(F.col("rank") <= k).select("query_id", "id").withColumn("hit", F.lit(1))
    return t.join(f, ["query_id", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def operating_point(sweep: DataFrame, least: float = 0.95) -> DataFrame:
    """The smallest effort whose recall is high enough, else the last of the sweep."""
    good = F.min_by(F.struct("*"), F.when(F.col("recall") >= least, F.col("effort")))
    return sweep.agg(good.alias("a"), F.max_by(F.struct("*"), "effort").alias("b"), F.min(F.when(F.col("recall") >= least, F.col("effort"))).alias("e")).select(F.when(F.col("e").isNotNull(), F.col("a")).otherwise(F.col("b")).alias("x")).select("x.*")


def centroids(records: DataFrame, by: str) -> DataFrame:
    """``(by, position, mean)`` of the vectors of each group."""
    return records.select(by, F.posexplode("values").alias("position", "x")).groupBy(by, "position").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def rolling(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Per key, how many samples the last seconds held at each event, and their mean value; events without a time count each other.

    Time is cut into stretches as long as a window, so a window is the start of its stretch up to the event and the end
    of the stretch before. Both are running totals over instants, one upwards and one downwards: work follows the
    number of events and not that of windows times their contents, and nothing is subtracted.
    """
    span = seconds * 1_000_000
    rows = events.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    instants = rows.groupBy("key", "_at").agg(F.count("*").alias("n"), F.count("value").alias("m"), F.sum(F.col("value").cast("double")).alias("s"))
    here = F.struct(F.lit(True).alias("own"), F.col("_at").alias("at"), F.col("n"), F.col("m"), F.col("s"))
    edge = F.struct(F.lit(False).alias("own"), (F.col("_at") - span).alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m"), F.lit(None).cast("double").alias("s"))
    points = instants.select("key", "_at", F.explode(F.when(F.col("_at").isNull(), F.array(here)).otherwise(F.array(here, edge))).alias("x")).select("key", "_at", "x.*")
    points = points.withColumn("stretch", F.col("at") - F.pmod("at", F.lit(span)))
    stretch = Window.partitionBy("key", "stretch")
    up, down = (stretch.orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.col("at").asc(), F.col("at").desc()))
    points = points.withColumns({f"{c}_{way}": F.sum(c).over(w) for way, w in (("up", up), ("down", down)) for c in ("n", "m", "s")})
    totals = points.groupBy("key", "_at").agg(*[F.sum(F.when(F.col("own"), F.col(f"{c}_up")).otherwise(F.col(f"{c}_down"))).alias(f"_{c}") for c in ("n", "m", "s")])
    totals = totals.withColumnsRenamed({"key": "_k", "_at": "_a"})
    out = rows.join(totals, F.col("key").eqNullSafe(F.col("_k")) & F.col("_at").eqNullSafe(F.col("_a")))
    return out.withColumns({"in_window": F.col("_n"), "mean_in_window": F.try_divide("_s", "_m")}).drop("_at", "_k", "_a", "_n", "_m", "_s")
