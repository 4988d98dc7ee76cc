"""Registered queries of the engine and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters, text
from ..functions import vector as V
from ..operators import ann, embed, search, stats, vecmap
from ..sources.store import latest, page, purgeable
from ..streaming import events as streams


#: Seconds that the latency report looks back over the events, which are minutes apart.
DAY = 86_400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"), "label")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every record whose id is divisible by 50."""
    return records(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("query_id"), "values")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")


def _nearest(spark: SparkSession, sf_dir: str, metric: str, rid: int, k: int = 10, where: Column | None = None) -> DataFrame:
    """Neighbours of a stored record; none where there is no such record."""
    rows = records(spark, sf_dir)
    found = rows.where(F.col("id") == rid).first()
    if found is None:
        return rows.limit(0).select("id", F.lit(None).cast("double").alias("score"))
    return search.top_k(rows, list(found["values"]), k, metric, where).select("id", F.round("score", 6).alias("score"))


def _knn(metric: str, rid: int = 7) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _nearest(spark, sf_dir, metric, rid)


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = filters.compile_filter({"label": {"$in": [1, 2]}}, filters.typed(records(spark, sf_dir).schema))
    return _nearest(spark, sf_dir, "cosine", 7, 10, where)


def knn_batch_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.batch_top_k(records(spark, sf_dir), asked(spark, sf_dir), 10, "dotproduct").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def similar_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve nearest of a stored record, without itself."""
    return _nearest(spark, sf_dir, "cosine", 11, 12, F.col("id") != 11)


def vector_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.summary(F.col("values"))
    return records(spark, sf_dir).select("id", F.round(s["norm"], 5).alias("norm"), F.round(s["min"].cast("double"), 6).alias("least"), F.round(s["max"].cast("double"), 6).alias("largest"))


def label_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.centroids(records(spark, sf_dir), "label").select("label", "position", F.round("mean", 6).alias("mean"))


def _filtered(spec: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = labelled(spark, sf_dir)
        return rows.where(filters.compile_filter(spec, filters.typed(rows.schema))).select("doc_id", "lang")

    return run


def filter_json_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("m", F.try_parse_json("props"))
    return rows.where(filters.compile_filter({"k": {"$gt": 50, "$lte": 90}}, filters.variant("m"))).select("event_id", "user_id")


def namespace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumn("namespace", F.col("lang"))
    return stats.namespace_stats(rows, filters.compile_filter({"quality": 1}, filters.typed(rows.schema)))


def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return page(ids, 24, "1", "150")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a change log: a user's record is replaced by each event, and deleted by an ``error``."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("").alias("namespace"), F.col("user_id").cast("string").alias("id"), F.array(F.col("value").cast("float")).alias("values"), F.col("value").alias("norm"), F.col("props").alias("metadata"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("deleted"))


def lww_latest_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(changes(spark, sf_dir)).select("id", "seq", "metadata")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("ts", F.col("event_type").alias("route"), F.concat(F.lit("i"), (F.col("user_id") % 3).cast("string")).alias("index"), F.col("value").alias("ms"), (F.col("event_type") == "error").alias("error"))


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.latency_summary(samples(spark, sf_dir), DAY)
    return s.select("route", "index", "samples", "errors", "qps", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latency_histogram(samples(spark, sf_dir)).select("route", "edge", "upto", "samples", F.round("total_ms", 2).alias("total_ms"))


def rolling_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("key"), "value")
    return stats.rolling(e, 3600).select("event_id", "in_window", F.round("mean_in_window", 6).alias("mean_in_window"))


def tumbling_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"))


def text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.text_id(F.col("text")).alias("id"))


def bow_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.word_slots(F.col("text"))).alias("slot"))
    return slots.groupBy("item_id", "slot").agg(F.count("*").alias("n"))


def group_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    named = d.select(text.group_value(F.col("lang"), "string").alias("lang"), text.group_value(F.col("source"), "string").alias("source"), text.group_value(F.col("text"), "string").alias("text"))
    return stats.group_fields(stats.unpivot_fields(named, ["lang", "source", "text"]))


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return stats.facets(stats.unpivot_fields(o, ["o_orderpriority", "o_orderstatus"])).select("field", "value", "n")


def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = samples(spark, sf_dir).select("route", F.lit("POST").alias("method"), "index", F.when(F.col("error"), 500).otherwise(200).alias("status"))
    return stats.request_counts(r)


def labels_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.label([F.col("text")]).alias("label"))


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 of cell probing as an index does it by default, against the exact neighbours, over the stated queries."""
    rows, q = records(spark, sf_dir), asked(spark, sf_dir)
    cells = ann.fit_cells(rows, "cosine")
    celled = ann.assign(rows, cells)
    found = ann.batch_probe(celled, ann.measured(celled, cells), q, 10, "cosine")
    return stats.recall(found, search.batch_top_k(rows, q, 10, "cosine"), 10)


def vector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecmap.vector_map(records(spark, sf_dir))[0]


def _ranked(spark: SparkSession, sf_dir: str, rid: int, k: int) -> DataFrame:
    one = records(spark, sf_dir).where(F.col("id") == rid).select(F.col("id").alias("query_id"), "values")
    return search.batch_top_k(records(spark, sf_dir), one, k, "cosine").select("id", "rank")


def rank_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the neighbours of one record stand among those of another."""
    return search.rank_delta(_ranked(spark, sf_dir, 7, 100), _ranked(spark, sf_dir, 11, 100))


def ann_operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest probed cells, of a sweep up to half of all, with a recall at 10 of 0.95; the last where none has it."""
    rows, q = records(spark, sf_dir), asked(spark, sf_dir)
    cells = ann.fit_cells(rows, "cosine")
    celled, truth, sweep = ann.assign(rows, cells), search.batch_top_k(rows, q, 10, "cosine"), None
    for share in (8, 4, 2):
        effort = max(1, len(cells.centres) // share)
        one = stats.recall(ann.batch_probe(celled, cells, q, 10, "cosine", effort), truth, 10).select(F.lit(effort).alias("effort"), "recall")
        sweep = one if sweep is None else sweep.unionByName(one)
    return stats.operating_point(sweep)


def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages nearest to a text under hashed words of two sizes."""
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    asked_for = texts.orderBy("id").first()
    if asked_for is None:
        return spark.createDataFrame([], "model string, id long, score double, rank int")
    return embed.compare_models(texts, asked_for["text"], [("hashed", "words-256", 256), ("hashed", "words-512", 512)], 10)[0]


def quiet_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("ts", F.col("user_id").alias("key"))
    return streams.sessions(e, "1 hour").select("key", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "writes")


def sliding_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.windowed_latency(samples(spark, sf_dir), "1 hour", "20 minutes")
    return s.select(F.col("start").cast("timestamp_ntz").alias("start"), "route", "samples", F.round("mean_ms", 6).alias("mean_ms"), "max_ms")


def prometheus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stats.prometheus(stats.latency_histogram(samples(spark, sf_dir)))
    lines = lines.unionByName(stats.prometheus_values(request_counts(spark, sf_dir), "requests_total", ("route", "method", "index", "status"), "requests"))
    spaces = namespace_stats(spark, sf_dir).where("namespace is not null")
    return lines.unionByName(stats.prometheus_values(spaces, "records", ("namespace",), "records"))


def legend_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.legend_counts(records(spark, sf_dir), "label")


def bench_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.bench_latency(samples(spark, sf_dir))
    return s.select("route", *[F.round(c, 6).alias(c) for c in ("mean_ms", "p50", "p95", "p99", "qps")])


#: Writes up to which the two snapshots of the events reach that are kept.
SNAPSHOTS = (9_900, 9_950)


def purgeable_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of deleted records that every kept snapshot covers."""
    return purgeable(changes(spark, sf_dir), SNAPSHOTS).select("id", "seq")


def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of the change log above a number, in order."""
    return changes(spark, sf_dir).where("seq > 400").orderBy("seq", "id").limit(5000).select("seq", "id", "deleted", "metadata")


def audit_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 2,000 events; the rest is due for removal."""
    return streams.retained(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", "user_id"), 2_000)


def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.where(F.col("c_name").startswith("Customer#00000001")).select(F.col("c_name").alias("id"), "c_mktsegment")


#: Name to filter over documents joined with labels: missing labels are missing fields.
FILTERS = {
    "filter_eq": {"lang": "en", "quality": 1},
    "filter_ne_missing": {"quality": {"$ne": 1}},
    "filter_in": {"source": {"$in": ["src0", "src5", 3]}},
    "filter_nin": {"quality": {"$nin": [0, True, "1"]}},
    "filter_range": {"n_chars": {"$gte": 1000, "$lt": 2000}},
    "filter_exists": {"toxic": {"$exists": True}},
    "filter_not_exists": {"toxic": {"$exists": False}},
    "filter_and_or": {"$or": [{"$and": [{"lang": {"$in": ["fr", "de"]}}, {"n_chars": {"$gt": 500}}]}, {"quality": 0}], "source": {"$ne": "src1"}},
}
_LABELLED = "SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE "
_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_DOT = "list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_TOP = "SELECT e.vec_id AS id, round({s}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = {q} {w} ORDER BY {s} {d}, e.vec_id LIMIT {k}"
_SAMPLES = "SELECT ts, event_type AS route, 'i' || CAST(user_id % 3 AS VARCHAR) AS \"index\", value AS ms, event_type = 'error' AS error FROM events"
_EDGES = " UNION ALL ".join(f"SELECT CAST({e} AS DOUBLE) AS edge" for e in stats.EDGES_MS) + " UNION ALL SELECT CAST(NULL AS DOUBLE)"
_RECENT = f"(SELECT * FROM ({_SAMPLES}) WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 86400 SECONDS)"
_SUMMARY = "count(*) AS samples, count(*) FILTER (WHERE error) AS errors, round(count(*) / 86400.0, 2) AS qps, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99"

SQL = {
    "knn_cosine": _TOP.format(s=_COS, q=7, w="", d="DESC", k=10),
    "knn_dot": _TOP.format(s=_DOT, q=7, w="", d="DESC", k=10),
    "knn_euclidean": "SELECT id, round(s, 6) AS score FROM (SELECT e.vec_id AS id, list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) + list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) - 2 * " + _DOT + " AS s FROM embeddings e, embeddings q WHERE q.vec_id = 7) ORDER BY abs(s), id LIMIT 10",
    "knn_filtered": _TOP.format(s=_COS, q=7, w="AND e.label IN (1, 2)", d="DESC", k=10),
    "similar_records": _TOP.format(s=_COS, q=11, w="AND e.vec_id <> 11", d="DESC", k=12),
    "knn_batch_dot": f"SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_DOT}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 10",
    "vector_summary": "SELECT vec_id AS id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm, round(CAST(list_min(embedding) AS DOUBLE), 6) AS least, round(CAST(list_max(embedding) AS DOUBLE), 6) AS largest FROM embeddings",
    "label_centroid": "SELECT label, position, round(avg(x), 6) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS position, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, position",
    "filter_eq": _LABELLED + "d.lang = 'en' AND l.quality = 1",
    "filter_ne_missing": _LABELLED + "l.quality IS DISTINCT FROM 1",
    "filter_in": _LABELLED + "d.source IN ('src0', 'src5')",
    "filter_nin": _LABELLED + "l.quality IS DISTINCT FROM 0",
    "filter_range": _LABELLED + "d.n_chars >= 1000 AND d.n_chars < 2000",
    "filter_exists": _LABELLED + "l.toxic IS NOT NULL",
    "filter_not_exists": _LABELLED + "l.toxic IS NULL",
    "filter_and_or": _LABELLED + "((d.lang IN ('fr', 'de') AND d.n_chars > 500) OR coalesce(l.quality = 0, false)) AND d.source <> 'src1'",
    "filter_json_range": "SELECT event_id, user_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50 AND CAST(json_extract(props, '$.k') AS BIGINT) <= 90",
    "namespace_stats": "SELECT d.lang AS namespace, count(*) FILTER (WHERE l.quality = 1) AS records FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ROLLUP (d.lang)",
    "list_page": "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE starts_with(CAST(doc_id AS VARCHAR), '1') AND CAST(doc_id AS VARCHAR) > '150' ORDER BY 1 LIMIT 25",
    "lww_latest_live": "SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, props AS metadata FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'",
    "latency_summary": f"SELECT NULL AS route, NULL AS \"index\", {_SUMMARY} FROM {_RECENT} UNION ALL SELECT route, NULL, {_SUMMARY} FROM {_RECENT} GROUP BY route UNION ALL SELECT NULL, \"index\", {_SUMMARY} FROM {_RECENT} GROUP BY \"index\"",
    "latency_histogram": f"SELECT s.route, e.edge, count(*) FILTER (WHERE e.edge IS NULL OR s.ms <= e.edge) AS upto, count(*) AS samples, round(sum(s.ms), 2) AS total_ms FROM ({_SAMPLES}) s, ({_EDGES}) e GROUP BY s.route, e.edge",
    "rolling_1h": "SELECT event_id, count(*) OVER w AS in_window, round(avg(value) OVER w, 6) AS mean_in_window FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW)",
    "tumbling_1h": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "text_ids": "SELECT doc_id, substr(sha1(text), 1, 24) AS id FROM documents",
    "bow_embed": "SELECT item_id, CAST(CAST('0x' || substr(sha1(w), 38, 3) AS BIGINT) % 512 AS INTEGER) AS slot, count(*) AS n FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM benchmark) WHERE w <> '' GROUP BY ALL",
    "group_fields": "SELECT field, count(DISTINCT value) AS groups FROM (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'text', text FROM documents) WHERE length(value) <= 40 AND trim(value) <> '' GROUP BY field HAVING count(DISTINCT value) BETWEEN 2 AND 12",
    "facet_counts": "SELECT field, value, count(*) AS n FROM (SELECT 'o_orderpriority' AS field, o_orderpriority AS value FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders) GROUP BY field, value",
    "request_counts": f"SELECT route, 'POST' AS method, \"index\", CASE WHEN error THEN 500 ELSE 200 END AS status, count(*) AS requests FROM ({_SAMPLES}) GROUP BY ALL",
    "rank_delta": "WITH r AS (SELECT q.vec_id AS q, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY " + _COS + " DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id IN (7, 11)) SELECT o.id, o.rank, b.rank AS baseline_rank, b.rank - o.rank AS delta FROM r o LEFT JOIN r b ON o.id = b.id AND b.q = 7 AND b.rank <= 100 WHERE o.q = 11 AND o.rank <= 100",
    "quiet_periods": "WITH e AS (SELECT user_id AS key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ts) AS n FROM e) SELECT key, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS \"end\", count(*) AS writes FROM s GROUP BY key, n",
    "sliding_latency": f"SELECT time_bucket(INTERVAL 20 MINUTE, ts) - k * INTERVAL 20 MINUTE AS start, route, count(*) AS samples, round(avg(ms), 6) AS mean_ms, max(ms) AS max_ms FROM ({_SAMPLES}), range(3) t(k) GROUP BY ALL",
    "prometheus_lines": f"SELECT 'request_ms_bucket{{route=\"' || s.route || '\",le=\"' || coalesce(CAST(e.edge AS VARCHAR), '+Inf') || '\"}} ' || CAST(count(*) FILTER (WHERE e.edge IS NULL OR s.ms <= e.edge) AS VARCHAR) AS line FROM ({_SAMPLES}) s, ({_EDGES}) e GROUP BY s.route, e.edge"
    f" UNION ALL SELECT 'request_ms_sum{{route=\"' || route || '\"}} ' || printf('%.2f', sum(ms)) FROM ({_SAMPLES}) GROUP BY route"
    f" UNION ALL SELECT 'request_ms_count{{route=\"' || route || '\"}} ' || CAST(count(*) AS VARCHAR) FROM ({_SAMPLES}) GROUP BY route"
    f" UNION ALL SELECT 'requests_total{{route=\"' || route || '\",method=\"POST\",index=\"' || \"index\" || '\",status=\"' || CASE WHEN error THEN '500' ELSE '200' END || '\"}} ' || CAST(count(*) AS VARCHAR) FROM ({_SAMPLES}) GROUP BY route, \"index\", error"
    " UNION ALL SELECT 'records{namespace=\"' || d.lang || '\"} ' || CAST(count(*) FILTER (WHERE l.quality = 1) AS VARCHAR) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang",
    "legend_counts": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "bench_latency": f"SELECT route, round(avg(ms), 6) AS mean_ms, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99, round(count(*) / (sum(ms) / 1000), 6) AS qps FROM ({_SAMPLES}) GROUP BY route",
    "purgeable_markers": "SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type = 'error' AND event_id <= 9900",
    "log_page": "SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS id, event_type = 'error' AS deleted, props AS metadata FROM events WHERE event_id > 400 ORDER BY event_id LIMIT 5000",
    "audit_retention": "SELECT event_id AS id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 2000",
    "prefix_scan": "SELECT c_name AS id, c_mktsegment FROM customer WHERE starts_with(c_name, 'Customer#00000001')",
    "labels_of_records": "SELECT doc_id, CASE WHEN length(t) > 90 THEN substr(t, 1, 89) || '…' ELSE t END AS label FROM (SELECT doc_id, nullif(trim(text), '') AS t FROM documents)",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (knn_filtered, knn_batch_dot, similar_records, vector_summary, label_centroid, filter_json_range, namespace_stats, list_page, lww_latest_live, latency_summary, latency_histogram, rolling_1h, tumbling_1h, text_ids, bow_embed, group_fields, facet_counts, request_counts, labels_of_records, ann_recall, vector_map, rank_delta, ann_operating_point, model_ranking, quiet_periods, sliding_latency, prometheus_lines, purgeable_markers, log_page, audit_retention, prefix_scan, legend_counts, bench_latency)
    out = {"knn_cosine": _knn("cosine"), "knn_dot": _knn("dotproduct"), "knn_euclidean": _knn("euclidean")}
    return out | {f.__name__: f for f in plain} | {n: _filtered(spec) for n, spec in FILTERS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, s in SQL.items() if n in queries()}
