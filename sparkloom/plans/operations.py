"""Queries of operations: jobs, idempotency, metrics, alerts, costs, and their streaming forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.catalog import query
from sparkloom.operators.relational import top_per_group
from sparkloom.plans.overlay import table

_STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'parsing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'needs_review' END"


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _jobs(spark, d):
    return _events(spark, d).select(F.col("user_id").alias("job_id"), F.expr(_STATUS).alias("status"), "ts", "event_id")


@query("job_state_latest", f"SELECT user_id AS job_id, arg_max({_STATUS}, (ts, event_id)) AS status, count(*) AS n_transitions FROM events GROUP BY 1")
def job_state_latest(spark, d):
    return _jobs(spark, d).groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n_transitions"))


@query(
    "job_recovery",
    f"WITH s AS (SELECT user_id AS job_id, arg_max({_STATUS}, (ts, event_id)) AS status FROM events GROUP BY 1) SELECT job_id, CASE WHEN status IN ('completed', 'failed', 'needs_review') THEN status ELSE 'queued' END AS after_restart FROM s",
)
def job_recovery(spark, d):
    s = _jobs(spark, d).groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    ended = F.col("status").isin("completed", "failed", "needs_review")
    return s.select("job_id", F.when(ended, F.col("status")).otherwise("queued").alias("after_restart"))


@query(
    "idempotency_outcomes",
    """WITH a AS (SELECT event_id, event_type, user_id, sha256(props) AS fp, first_value(sha256(props)) OVER w AS first_fp, row_number() OVER w AS nth FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id))
    SELECT event_id, CASE WHEN nth = 1 THEN 'reserved' WHEN fp = first_fp THEN 'replayed' ELSE 'conflict' END AS outcome FROM a""",
)
def idempotency_outcomes(spark, d):
    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    a = _events(spark, d).withColumn("fp", F.sha2("props", 256)).withColumns({"first_fp": F.first("fp").over(w), "nth": F.row_number().over(w)})
    return a.select("event_id", F.when(F.col("nth") == 1, "reserved").when(F.col("fp") == F.col("first_fp"), "replayed").otherwise("conflict").alias("outcome"))


@query(
    "repeated_calls",
    "WITH c AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events) SELECT event_id, n, n > 2 AS stop FROM c",
)
def repeated_calls(spark, d):
    w = Window.partitionBy("user_id", "event_type", "props").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _events(spark, d).select("event_id", F.count("*").over(w).alias("n")).withColumn("stop", F.col("n") > 2)


@query("json_props_typed", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_props_typed(spark, d):
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"))


@query("ref_path_lookup", "SELECT event_id, json_extract_string('{\"data\":' || props || '}', '$.data.k') AS value FROM events")
def ref_path_lookup(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object(F.concat(F.lit('{"data":'), "props", F.lit("}")), "$.data.k").alias("value"))


@query(
    "json_from_noisy_text",
    "WITH t AS (SELECT event_id, 'answer: ```json ' || props || ' ``` done' AS s FROM events) SELECT event_id, CAST(json_extract(regexp_extract(s, '\\{.*\\}'), '$.k') AS BIGINT) AS k FROM t",
)
def json_from_noisy_text(spark, d):
    noisy = F.concat(F.lit("answer: ```json "), "props", F.lit(" ``` done"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json(F.regexp_extract(noisy, r"(?s)\{.*\}", 0)), "$.k", "bigint").alias("k"))


@query("model_cost", "SELECT event_type, round(sum((user_id * 3 + 100) * 0.5 + value * 1.5) / 1000000, 9) AS cost, CAST(sum(user_id * 3 + 100) AS BIGINT) AS input_tokens FROM events GROUP BY 1")
def model_cost(spark, d):
    tokens = F.col("user_id") * 3 + 100
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum(tokens * 0.5 + F.col("value") * 1.5) / 1000000, 9).alias("cost"), F.sum(tokens).alias("input_tokens"))


@query("route_fallback", "SELECT user_id, event_id, event_type FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) = 1")
def route_fallback(spark, d):
    ok = table(spark, d, "events").where("event_type <> 'error'")
    return top_per_group(ok, ["user_id"], [F.asc("event_type"), F.asc("event_id")], 1).select("user_id", "event_id", "event_type")


_CATEGORY = "CASE WHEN value > 95 THEN 'rate_limit' WHEN value > 90 THEN 'timeout' WHEN value > 85 THEN 'network' WHEN value > 80 THEN 'schema' WHEN value > 75 THEN 'provider' ELSE 'unknown' END"


@query("error_category", f"SELECT {_CATEGORY} AS category, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def error_category(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").groupBy(F.expr(_CATEGORY).alias("category")).agg(F.count("*").alias("n"))


@query("tumbling_window_counts", "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window_counts(spark, d):
    return _events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n")


@query(
    "sliding_window_counts",
    "SELECT CAST(epoch(time_bucket(INTERVAL 15 MINUTE, ts)) - i * 900 AS BIGINT) AS start_s, count(*) AS n FROM events, range(4) AS t(i) WHERE event_type = 'error' GROUP BY 1",
)
def sliding_window_counts(spark, d):
    e = _events(spark, d).where("event_type = 'error'")
    return e.groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start_s"), "n")


@query(
    "session_window_counts",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n FROM s GROUP BY user_id, sid""",
)
def session_window_counts(spark, d):
    s = _events(spark, d).groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_timestamp("w.start").alias("start_s"), "n")


@query(
    "alert_increase_15m",
    "SELECT CAST(epoch(time_bucket(INTERVAL 15 MINUTE, ts)) AS BIGINT) AS start_s, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 3",
)
def alert_increase_15m(spark, d):
    e = _events(spark, d).where("event_type = 'error'").groupBy(F.window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.where("n >= 3").select(F.unix_timestamp("w.start").alias("start_s"), "n")


@query(
    "alert_error_ratio_5m",
    "WITH r AS (SELECT CAST(epoch(time_bucket(INTERVAL 5 MINUTE, ts)) AS BIGINT) AS start_s, count(*) FILTER (event_type = 'error') AS bad, count(*) AS n FROM events GROUP BY 1) SELECT start_s, round(bad / greatest(n, 0.001), 6) AS ratio FROM r WHERE bad / greatest(n, 0.001) > 0.05 AND n / 300.0 > 0.001",
)
def alert_error_ratio_5m(spark, d):
    bad = F.sum((F.col("event_type") == "error").cast("long"))
    r = _events(spark, d).groupBy(F.window("ts", "5 minutes").alias("w")).agg(bad.alias("bad"), F.count("*").alias("n"))
    r = r.withColumn("ratio", F.col("bad") / F.greatest(F.col("n"), F.lit(0.001))).where("ratio > 0.05 AND n / 300.0 > 0.001")
    return r.select(F.unix_timestamp("w.start").alias("start_s"), F.round("ratio", 6).alias("ratio"))


@query("alert_hold", "WITH b AS (SELECT DISTINCT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS s FROM events WHERE event_type = 'error'), g AS (SELECT s, s - 3600 * row_number() OVER (ORDER BY s) AS island FROM b) SELECT min(s) AS from_s, max(s) AS to_s, count(*) AS hours FROM g GROUP BY island HAVING count(*) >= 3")
def alert_hold(spark, d):
    """Stretches of at least three consecutive hours with errors. One task puts them in order: hours are 8,784
    a year at most, however many events there are."""
    b = _events(spark, d).where("event_type = 'error'").select(F.unix_timestamp(F.date_trunc("hour", "ts")).alias("s")).distinct()
    start = b.join(b.select((F.col("s") + 3600).alias("s"), F.lit(1).alias("_p")), "s", "left").where("_p IS NULL").select(F.col("s").alias("from_s"))
    ends = b.join(b.select((F.col("s") - 3600).alias("s"), F.lit(1).alias("_n")), "s", "left").where("_n IS NULL").select(F.col("s").alias("to_s"))
    both = start.select(F.col("from_s").alias("at"), F.lit(0).alias("k")).unionAll(ends.select("to_s", F.lit(1)))
    runs = both.withColumn("to_s", F.lead("at").over(Window.orderBy("at", "k"))).where("k = 0")
    return runs.select(F.col("at").alias("from_s"), "to_s", ((F.col("to_s") - F.col("at")) / 3600 + 1).cast("long").alias("hours")).where("hours >= 3")


@query("stream_window_counts", "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    from sparkloom.streaming.jobs import run_to_end, windowed_counts

    return run_to_end(windowed_counts(_stream(spark, d), "1 hour", None), "complete").select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n")


@query("stream_dedup", "SELECT user_id, event_type, 1 AS n FROM events GROUP BY 1, 2")
def stream_dedup(spark, d):
    from sparkloom.streaming.jobs import run_to_end

    s = _stream(spark, d).withWatermark("ts", "10 minutes").dropDuplicates(["user_id", "event_type"])
    return run_to_end(s, "append").select("user_id", "event_type", F.lit(1).alias("n"))


@query("stream_job_state", f"SELECT user_id AS job_id, arg_max({_STATUS}, (ts, event_id)) AS status FROM events GROUP BY 1")
def stream_job_state(spark, d):
    from sparkloom.streaming.jobs import latest_status, run_to_end

    s = _stream(spark, d).select(F.col("user_id").alias("job_id"), F.expr(_STATUS).alias("status"), "ts", "event_id")
    last = run_to_end(latest_status(s), "update")
    return last.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"))


@query("stream_compaction")
def stream_compaction(spark, d):
    from sparkloom.streaming.jobs import compacted, run_to_end, table_stream

    out = run_to_end(compacted(table_stream(spark, f"{d}/conversations.parquet"), keep=3, longest=600), "update")
    return out.groupBy("conv_id").agg(F.max_by(F.struct("n_kept", "summary"), "seen").alias("s")).select("conv_id", "s.n_kept", "s.summary")


def _stream(spark, d):
    from sparkloom.streaming.jobs import table_stream

    return table_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
