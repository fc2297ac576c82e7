"""Metadata queries over tables derived from the supplied ones."""

from pyspark.sql import functions as F

from ..operators import metadata as B
from ..session import table
from .registry import query

# --- derived tables -------------------------------------------------------------------------------------

USERS = "SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'professional' WHEN 'MACHINERY' THEN 'enterprise' ELSE 'free' END AS subscription_tier FROM {customer}"
DATASETS = """SELECT o_orderkey AS id, o_custkey AS user_id, 'ds_' || CAST(o_orderkey AS STRING) AS filename, CAST(floor(o_totalprice) AS BIGINT) AS file_size,
 CASE WHEN o_orderstatus = 'P' THEN NULL ELSE (o_orderkey * 7) % 100000 END AS row_count, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'uploading' ELSE 'deleted' END AS status,
 o_orderdate AS uploaded_at, CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate END AS deleted_at FROM {orders}"""
VALIDATIONS = """SELECT o_orderkey AS id, o_orderkey * 2 AS dataset_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
 CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 100 END AS risk_score,
 CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN CAST(floor(o_totalprice) AS BIGINT) % 100 < 25 THEN 'low' WHEN CAST(floor(o_totalprice) AS BIGINT) % 100 < 60 THEN 'medium' ELSE 'high' END AS risk_level,
 CAST(floor(o_totalprice) AS BIGINT) % 100 < 25 AS warranty_eligible, o_orderdate AS created_at, o_orderdate AS completed_at FROM {orders}"""
JOBS = """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'queued' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'running' ELSE 'completed' END END AS status,
 6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, CAST(o_orderkey % 5 AS INT) AS retry_count, 3 AS max_retries, o_orderdate AS created_at FROM {orders}"""


def derive(spark, d, text):
    """The same derivation text over the supplied tables in Spark SQL."""
    names = [t for t in ("orders", "customer") if "{" + t + "}" in text]
    return spark.sql(text, **{t: table(spark, d, t) for t in names})


def duck(text):
    return text.format(orders="orders", customer="customer")


def users(spark, d):
    return derive(spark, d, USERS)


def datasets(spark, d):
    return derive(spark, d, DATASETS)


def validations(spark, d):
    return derive(spark, d, VALIDATIONS)


def jobs(spark, d):
    return derive(spark, d, JOBS)


@query("live_rows", f"SELECT id FROM ({duck(DATASETS)}) WHERE deleted_at IS NULL AND status <> 'deleted'")
def _(spark, d):
    return B.live_rows(datasets(spark, d)).select("id")


@query("lookup", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def _(spark, d):
    return B.lookup(table(spark, d, "customer"), "c_mktsegment", "BUILDING", "c_nationkey", 7).select("c_custkey", "c_name")


@query("page", f"""SELECT id, uploaded_at, (SELECT count(*) FROM ({duck(DATASETS)}) WHERE status = 'ready') AS total_count, ceil((SELECT count(*) FROM ({duck(DATASETS)}) WHERE status = 'ready') / 50)::BIGINT AS total_pages
FROM ({duck(DATASETS)}) WHERE status = 'ready' ORDER BY uploaded_at DESC, id LIMIT 50 OFFSET 100""")
def _(spark, d):
    ready = datasets(spark, d).filter("status = 'ready'")
    return B.page(ready, 3, 50, "uploaded_at").select("id", "uploaded_at", "total_count", "total_pages")


@query("list_filter", f"""SELECT id, file_size, (SELECT count(*) FROM ({duck(DATASETS)}) WHERE status = 'ready') AS total_count FROM ({duck(DATASETS)}) WHERE status = 'ready' ORDER BY file_size, id LIMIT 20""")
def _(spark, d):
    return B.list_filter(datasets(spark, d), "ready", "file_size", False, 1, 500).select("id", "file_size", "total_count")


@query("usage_summary", f"""SELECT u.id AS user_id, subscription_tier, coalesce(nd, 0) AS datasets_uploaded, coalesce(done, 0)::BIGINT AS validations_completed, coalesce(rows, 0)::BIGINT AS total_rows_validated,
 CASE WHEN coalesce(done, 0) > 0 THEN coalesce(risk, 0)::BIGINT // done ELSE 0 END::BIGINT AS average_risk_score, coalesce(el, 0)::BIGINT AS warranty_contracts, lim::BIGINT AS validations_limit, (lim - coalesce(nv, 0))::BIGINT AS validations_remaining
FROM (SELECT *, CASE subscription_tier WHEN 'professional' THEN 20 WHEN 'enterprise' THEN 100 ELSE 10 END AS lim FROM ({duck(USERS)})) u
LEFT JOIN (SELECT user_id, count(*) AS nd, sum(row_count) AS rows FROM ({duck(DATASETS)}) GROUP BY 1) x ON x.user_id = u.id
LEFT JOIN (SELECT user_id, count(*) AS nv, count_if(status = 'completed') AS done, sum(risk_score) FILTER (status = 'completed') AS risk, count_if(status = 'completed' AND warranty_eligible) AS el FROM ({duck(VALIDATIONS)}) GROUP BY 1) v ON v.user_id = u.id""")
def _(spark, d):
    return B.usage_summary(users(spark, d), datasets(spark, d), validations(spark, d))


HISTORY = f"""SELECT v.id AS validation_id, coalesce(filename, 'Unknown') AS dataset_name, risk_score, completed_at, row_count FROM ({duck(VALIDATIONS)}) v LEFT JOIN ({duck(DATASETS)}) x ON x.id = v.dataset_id
WHERE v.status = 'completed' AND created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' AND (risk_level IS NULL OR risk_level = 'medium')"""


def history(spark, d):
    return B.validation_history(validations(spark, d), datasets(spark, d), F.lit("1996-01-01").cast("timestamp"), F.lit("1999-12-31").cast("timestamp"), "medium")


@query("validation_history", HISTORY)
def _(spark, d):
    return history(spark, d)


@query("history_trends", f"SELECT count(*) AS validations, coalesce(sum(risk_score)::BIGINT // count(risk_score), 0) AS average_risk_score, coalesce(sum(row_count // 1000), 0)::BIGINT AS total_compute_saved FROM ({HISTORY})")
def _(spark, d):
    return B.history_trends(history(spark, d))


REQUESTS = """SELECT o_orderkey AS request_id, o_orderkey + o_custkey % 2 AS validation_id, o_custkey AS user_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'enterprise' WHEN '2-HIGH' THEN 'premium' WHEN '3-MEDIUM' THEN 'other' ELSE 'standard' END AS warranty_type,
 CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS DECIMAL(12,2)) AS coverage_amount FROM {orders}"""


@query("warranty_requests", f"""SELECT request_id, outcome, CASE WHEN outcome = 'ACCEPTED' THEN CASE WHEN coverage_amount = 0 THEN CASE warranty_type WHEN 'premium' THEN 500000 WHEN 'enterprise' THEN 1000000 ELSE 100000 END ELSE coverage_amount END END::DECIMAL(12,2) AS coverage_amount FROM (
 SELECT r.*, CASE WHEN v.id IS NULL THEN 'NOT_FOUND' WHEN NOT coalesce(warranty_eligible, false) THEN 'NOT_ELIGIBLE' WHEN v.user_id <> r.user_id THEN 'FORBIDDEN' ELSE 'ACCEPTED' END AS outcome FROM ({duck(REQUESTS)}) r LEFT JOIN ({duck(VALIDATIONS)}) v ON v.id = r.validation_id)""")
def _(spark, d):
    return B.warranty_requests(derive(spark, d, REQUESTS), validations(spark, d))


WARRANTIES = """SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'expired' ELSE 'active' END AS status, CAST(o_totalprice AS DECIMAL(12,2)) AS coverage_amount FROM {orders}"""
CLAIMS = """SELECT o_orderkey AS id, o_orderkey AS warranty_id, CASE WHEN o_orderpriority = '5-LOW' THEN o_custkey + 1 ELSE o_custkey END AS user_id, CAST(o_totalprice * (o_custkey % 3) AS DECIMAL(12,2)) AS claim_amount FROM {orders}"""


@query("claim_checks", f"""SELECT c.id AS claim_id, CASE WHEN w.id IS NULL THEN 'NOT_FOUND' WHEN w.user_id <> c.user_id THEN 'FORBIDDEN' WHEN status <> 'active' THEN 'INVALID_STATUS' WHEN claim_amount > coverage_amount THEN 'AMOUNT_EXCEEDED' ELSE 'ACCEPTED' END AS outcome
FROM ({duck(CLAIMS)}) c LEFT JOIN ({duck(WARRANTIES)}) w ON w.id = c.warranty_id""")
def _(spark, d):
    return B.claim_checks(derive(spark, d, CLAIMS), derive(spark, d, WARRANTIES))


@query("claim_precheck", """SELECT o_orderkey AS claim_id, CASE WHEN dev AND day THEN 'ELIGIBLE' WHEN dev OR day THEN 'REQUIRES_REVIEW' ELSE 'DENIED' END AS verdict FROM (
 SELECT o_orderkey, abs(o_custkey % 100 - 50) / 50.0 > 0.2 AS dev, o_custkey % 60 <= 30 AS day FROM orders)""")
def _(spark, d):
    o = table(spark, d, "orders")
    claims = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("warranty_id"), (F.col("o_custkey") % 100).cast("double").alias("actual"),
                      F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 60).cast("int")).alias("filed_at"))
    predictions = o.select(F.col("o_orderkey").alias("warranty_id"), F.lit(50.0).alias("predicted"), F.to_date("o_orderdate").alias("trained_at"))
    return B.claim_precheck(claims, predictions)


@query("queue_order", f"SELECT id, priority FROM ({duck(JOBS)}) WHERE status = 'queued'")
def _(spark, d):
    return B.queue_order(jobs(spark, d)).select("id", "priority")


@query("job_stats", f"""SELECT count(*) AS total, {", ".join(f"count_if(status = '{s}')::BIGINT AS {s}" for s in B.JOB_STATES)} FROM ({duck(JOBS)})""")
def _(spark, d):
    return B.job_stats(jobs(spark, d))


@query("retry_plan", f"SELECT id, CASE WHEN retry_count < 3 THEN 'queued' ELSE 'failed' END AS status, retry_count + CASE WHEN retry_count < 3 THEN 1 ELSE 0 END AS retry_count FROM ({duck(JOBS)}) WHERE status = 'failed'")
def _(spark, d):
    return B.retry_plan(jobs(spark, d)).select("id", "status", "retry_count")


@query("stage_progress", """SELECT l_orderkey AS run_id, 100.0 * count_if(l_linestatus = 'F') / count(*) AS progress, coalesce(arg_min('stage_' || l_linenumber::VARCHAR, l_linenumber) FILTER (l_linestatus <> 'F'), 'completed') AS current_stage FROM lineitem GROUP BY 1""", 6, "progress")
def _(spark, d):
    li = table(spark, d, "lineitem")
    stages = li.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("stage_no"), F.concat(F.lit("stage_"), F.col("l_linenumber").cast("string")).alias("stage_name"),
                       F.when(F.col("l_linestatus") == "F", "completed").otherwise("pending").alias("status"))
    return B.stage_progress(stages)


@query("metric_buckets", """SELECT event_type, le::DOUBLE AS le, count_if(value <= le)::BIGINT AS n, sum(value) AS sum FROM events,
 (VALUES (1::DOUBLE), (5), (10), (30), (60), (120), (300), (600), (1800), (3600), ('inf'::DOUBLE)) b(le) GROUP BY event_type, le""", 2, "sum")
def _(spark, d):
    return B.metric_buckets(table(spark, d, "events"), ["event_type"], "value")
