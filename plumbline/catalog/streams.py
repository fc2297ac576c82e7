"""Streams and their batch twins."""

from pyspark.sql import functions as F

from ..session import table
from ..sources.readers import stream_dataset
from ..streaming import streams as R
from .registry import query


def events(spark, d):
    return table(spark, d, "events")


def event_stream(spark, d):
    return stream_dataset(spark, d, events(spark, d).schema, pattern="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def batch(spark, d):
    return events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))


PROFILE = "\nUNION ALL\n".join(f"SELECT '{c}' AS col, count({c}) AS count, sum({c})::DOUBLE AS sum, avg({c}) AS mean, stddev_pop({c}) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM events" for c in ["value", "user_id"])


@query("stream_profile", PROFILE, 4, "sum mean std min max")
def _(spark, d):
    return R.run_to_table(R.stream_profile(event_stream(spark, d), ["value", "user_id"]), "complete").drop("q25", "median", "q75")


@query("stream_profile_batch", PROFILE, 4, "sum mean std min max")
def _(spark, d):
    return R.stream_profile(batch(spark, d), ["value", "user_id"]).drop("q25", "median", "q75")


def updates(df):
    return df.select(
        F.col("user_id").alias("validation_id"), "ts", F.col("event_id").alias("update_id"), F.col("event_type").alias("status"),
        (F.col("event_id") % 19).cast("int").alias("models_completed"), F.lit(18).alias("models_total"), (F.col("value") * 10.0).alias("elapsed_seconds"))


PROGRESS = """SELECT validation_id, status, ts, 100.0 * done / 18 AS progress_percent, CASE WHEN done > 0 THEN el / done * (18 - done) ELSE 0.0 END AS eta_seconds FROM (
 SELECT user_id AS validation_id, event_type AS status, ts, event_id % 19 AS done, value * 10.0 AS el, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1"""


@query("progress_latest", PROGRESS, 5, "progress_percent eta_seconds")
def _(spark, d):
    return R.progress_latest(updates(batch(spark, d)))


@query("progress_latest_stream", PROGRESS, 5, "progress_percent eta_seconds")
def _(spark, d):
    return R.run_to_table(R.progress_latest(updates(event_stream(spark, d))), "complete")


def repeated_updates(spark, d):
    """Every fifth update comes twice."""
    again = F.when(F.col("update_id") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return updates(event_stream(spark, d)).withColumn("_again", F.explode(again)).drop("_again")


@query("distinct_updates_stream", "SELECT user_id AS validation_id, event_id AS update_id, ts, event_type AS status FROM events")
def _(spark, d):
    return R.run_to_table(R.distinct_updates(repeated_updates(spark, d)).select("validation_id", "update_id", "ts", "status"))


@query("progress_latest_distinct", PROGRESS, 5, "progress_percent eta_seconds")
def _(spark, d):
    return R.progress_latest(R.run_to_table(R.distinct_updates(repeated_updates(spark, d))))


@query("stream_counts", "SELECT count(*) AS input_rows, 0::BIGINT AS late_rows, count_if(event_id % 5 = 0)::BIGINT AS duplicate_rows FROM events")
def _(spark, d):
    counts = R.run_counted(R.distinct_updates(repeated_updates(spark, d)))[1]
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in counts.items()])


WINDOWS = """SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, user_id, event_type, count(*) AS request_count FROM events GROUP BY ALL"""


@query("rate_windows", WINDOWS)
def _(spark, d):
    return R.rate_windows(batch(spark, d), "1 hour", ["user_id", "event_type"])


# a stream emits the windows the final watermark has passed
@query("rate_windows_stream", f"SELECT * FROM ({WINDOWS}) WHERE window_end <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)")
def _(spark, d):
    return R.run_to_table(R.rate_windows(event_stream(spark, d), "1 hour", ["user_id", "event_type"]))


LIMIT, SECONDS = 3, 86400.0
LIMITER = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, true AS allowed, []::BIGINT[] AS st FROM e
 UNION ALL SELECT user_id, i, event_id, ts, len(kept) < {LIMIT}, CASE WHEN len(kept) < {LIMIT} THEN list_append(kept, us) ELSE kept END FROM (
  SELECT e.user_id, e.i, e.event_id, e.ts, e.us, list_filter(g.st, lambda x: e.us - x < {int(SECONDS) * 1000000}) AS kept FROM g JOIN e ON e.user_id = g.user_id AND e.i = g.i + 1))
SELECT user_id, event_id, ts, allowed FROM g WHERE i > 0"""


@query("rate_violations", LIMITER)
def _(spark, d):
    return R.rate_violations(batch(spark, d), LIMIT, SECONDS)


@query("rate_limiter_stream", LIMITER)
def _(spark, d):
    return R.run_to_table(R.rate_limiter_stream(event_stream(spark, d), LIMIT, SECONDS))


@query("ordered_limiter_stream", f"SELECT * FROM ({LIMITER}) WHERE ts < (SELECT max(ts) - INTERVAL '10 minutes' FROM events)")
def _(spark, d):
    with R.rocksdb_state(spark):
        return R.run_to_table(R.ordered_limiter_stream(event_stream(spark, d), LIMIT, SECONDS))


DRIFT = """WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT ts, least(floor((value - lo) / (hi - lo) * 20), 19)::INT AS b FROM events, r),
base AS (SELECT b, count(*) / (SELECT count(*) FROM b) AS p FROM b GROUP BY 1), w AS (SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, b, count(*) AS n FROM b GROUP BY ALL),
t AS (SELECT window_start, sum(n)::BIGINT AS n FROM w GROUP BY 1)
SELECT window_start, n, distance, distance > 0.2 AS alert FROM (SELECT t.window_start, t.n, sum(abs(coalesce(w.n, 0) / t.n - coalesce(p, 0))) / 2 AS distance
 FROM t CROSS JOIN range(20) AS s(k) LEFT JOIN base ON base.b = k LEFT JOIN w ON w.window_start = t.window_start AND w.b = k GROUP BY t.window_start, t.n) x(window_start, n, distance)"""


def monitor(spark, d, source):
    edges, shares = R.histogram_baseline(events(spark, d), "value", 20)
    return R.drift_monitor(source, "value", edges, shares)


@query("drift_monitor", DRIFT, 7, "distance")
def _(spark, d):
    return monitor(spark, d, batch(spark, d))


@query("drift_monitor_stream", f"SELECT * FROM ({DRIFT}) WHERE window_start + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)", 7, "distance")
def _(spark, d):
    return R.run_to_table(monitor(spark, d, event_stream(spark, d)))
