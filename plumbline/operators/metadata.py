"""Queries over users, datasets, validations, warranties, claims and jobs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Page sizes, tier limits, default covers and claim rules.
DEFAULT_PAGE, MAX_PAGE = 20, 100
TIER_LIMITS = {"professional": 20, "enterprise": 100}
DEFAULT_LIMIT = 10
DEFAULT_COVER = {"standard": 100_000, "premium": 500_000, "enterprise": 1_000_000}
OTHER_COVER = 100_000
CLAIM_DEVIATION, CLAIM_DAYS = 0.20, 30
MAX_RETRIES = 3
JOB_STATES = ["queued", "running", "completed", "failed", "cancelled"]
DURATION_BUCKETS = [1, 5, 10, 30, 60, 120, 300, 600, 1800, 3600]


def live_rows(df: DataFrame, deleted_col: str = "deleted_at", status_col: str = "status") -> DataFrame:
    """Rows that are not soft-deleted, by timestamp or by status."""
    if deleted_col in df.columns:
        df = df.filter(F.col(deleted_col).isNull())
    if status_col in df.columns:
        df = df.filter(F.coalesce(F.col(status_col), F.lit("")) != "deleted")
    return df


def lookup(df: DataFrame, key: str, value, owner_col: str | None = None, owner=None) -> DataFrame:
    """Rows with the key, restricted to their owner if one is given."""
    out = df.filter(F.col(key) == value)
    return out if owner_col is None else out.filter(F.col(owner_col) == owner)


def page_size(size: int) -> int:
    return size if 1 <= size <= MAX_PAGE else DEFAULT_PAGE


def page(df: DataFrame, number: int = 1, size: int = DEFAULT_PAGE, order_col: str = "created_at", id_col: str = "id", descending: bool = True) -> DataFrame:
    """One page in stable order, with the total and the number of pages. The filter belongs before this call."""
    size, number = page_size(size), max(1, number)
    order = F.desc(order_col) if descending else F.asc(order_col)
    rows = df.orderBy(order, id_col).limit(number * size).offset((number - 1) * size)
    total = df.agg(F.count(F.lit(1)).alias("total_count"))
    out = rows.crossJoin(F.broadcast(total))  # one row
    return out.withColumn("total_pages", F.ceil(F.col("total_count") / size).cast("long"))


def list_filter(df: DataFrame, status: str | None = None, sort_by: str = "uploaded_at", descending: bool = True, number: int = 1, size: int = DEFAULT_PAGE, id_col: str = "id") -> DataFrame:
    """Status filter and sort column applied before paging, so totals describe what is shown."""
    if sort_by not in ("uploaded_at", "file_size", "filename"):
        raise ValueError(f"cannot sort by {sort_by}")
    if status is not None:
        df = df.filter(F.col("status") == status)
    return page(df, number, size, sort_by, id_col, descending)


def usage_summary(users: DataFrame, datasets: DataFrame, validations: DataFrame) -> DataFrame:
    """Per user: uploads, completed validations, rows, mean risk, eligible results and what the tier leaves."""
    done = F.col("status") == "completed"
    d = datasets.groupBy("user_id").agg(F.count(F.lit(1)).alias("_d"), F.sum("row_count").alias("_rows"))
    v = validations.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_v"),
        F.count_if(done).alias("_done"),
        F.sum(F.when(done, F.col("risk_score"))).alias("_risk"),
        F.count_if(done & F.coalesce(F.col("warranty_eligible"), F.lit(False))).alias("_eligible"),
    )
    joined = users.join(d, users["id"] == d["user_id"], "left").drop("user_id").join(v, users["id"] == v["user_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    limit = F.lit(DEFAULT_LIMIT)
    for tier, n in TIER_LIMITS.items():
        limit = F.when(F.col("subscription_tier") == tier, n).otherwise(limit)
    return joined.select(
        F.col("id").alias("user_id"),
        "subscription_tier",
        zero("_d").alias("datasets_uploaded"),
        zero("_done").alias("validations_completed"),
        zero("_rows").alias("total_rows_validated"),
        F.when(zero("_done") > 0, F.expr("coalesce(_risk, 0) div _done")).otherwise(0).cast("long").alias("average_risk_score"),
        zero("_eligible").alias("warranty_contracts"),
        limit.cast("long").alias("validations_limit"),
        (limit - zero("_v")).cast("long").alias("validations_remaining"),
    )


def validation_history(
    validations: DataFrame, datasets: DataFrame, start: Column | None = None, end: Column | None = None, level: str | None = None
) -> DataFrame:
    """Completed validations in a date range with their dataset's name; validations without a level pass the level filter."""
    v = validations.filter(F.col("status") == "completed")
    if start is not None:
        v = v.filter(F.col("created_at") >= start)
    if end is not None:
        v = v.filter(F.col("created_at") <= end)
    if level is not None:
        v = v.filter(F.col("risk_level").isNull() | (F.col("risk_level") == level))
    names = datasets.select(F.col("id").alias("dataset_id"), "filename", "row_count")
    joined = v.join(names, "dataset_id", "left")
    return joined.select(
        F.col("id").alias("validation_id"), F.coalesce("filename", F.lit("Unknown")).alias("dataset_name"), "risk_score", "completed_at", "row_count"
    )


def history_trends(history: DataFrame) -> DataFrame:
    """Mean risk (integer division) and rows saved in thousands."""
    n, s = F.count("risk_score"), F.sum("risk_score")
    agg = history.agg(
        F.count(F.lit(1)).alias("validations"), n.alias("_n"), s.alias("_s"), F.sum(F.expr("row_count div 1000")).alias("_saved")
    )
    return agg.select(
        "validations",
        F.when(F.col("_n") > 0, F.expr("_s div _n")).otherwise(0).cast("long").alias("average_risk_score"),
        F.coalesce("_saved", F.lit(0)).cast("long").alias("total_compute_saved"),
    )


def warranty_requests(requests: DataFrame, validations: DataFrame) -> DataFrame:
    """Outcome of each request: not found, not eligible, not the owner, or accepted with its cover."""
    v = validations.select(F.col("id").alias("validation_id"), F.col("user_id").alias("_owner"), "warranty_eligible")
    joined = requests.join(v, "validation_id", "left")
    cover = F.lit(OTHER_COVER)
    for kind, amount in DEFAULT_COVER.items():
        cover = F.when(F.col("warranty_type") == kind, amount).otherwise(cover)
    chosen = F.when(F.coalesce(F.col("coverage_amount"), F.lit(0)) == 0, cover.cast("decimal(12,2)")).otherwise(F.col("coverage_amount"))
    outcome = (
        F.when(F.col("_owner").isNull(), "NOT_FOUND")
        .when(~F.coalesce(F.col("warranty_eligible"), F.lit(False)), "NOT_ELIGIBLE")
        .when(F.col("_owner") != F.col("user_id"), "FORBIDDEN")
        .otherwise("ACCEPTED")
    )
    return joined.withColumn("outcome", outcome).select(
        "request_id", "outcome", F.when(F.col("outcome") == "ACCEPTED", chosen).cast("decimal(12,2)").alias("coverage_amount")
    )


def claim_checks(claims: DataFrame, warranties: DataFrame) -> DataFrame:
    """First failed check of each claim, or accepted."""
    w = warranties.select(F.col("id").alias("warranty_id"), F.col("user_id").alias("_owner"), F.col("status").alias("_status"), "coverage_amount")
    joined = claims.join(w, "warranty_id", "left")
    outcome = (
        F.when(F.col("_owner").isNull(), "NOT_FOUND")
        .when(F.col("_owner") != F.col("user_id"), "FORBIDDEN")
        .when(F.col("_status") != "active", "INVALID_STATUS")
        .when(F.col("claim_amount") > F.col("coverage_amount"), "AMOUNT_EXCEEDED")
        .otherwise("ACCEPTED")
    )
    return joined.select(F.col("id").alias("claim_id"), outcome.alias("outcome"))


def claim_precheck(claims: DataFrame, predictions: DataFrame) -> DataFrame:
    """Deviation above 20 % and filing within 30 days: both eligible, one review, none denied."""
    joined = claims.join(predictions, "warranty_id")
    deviates = F.coalesce(F.try_divide(F.abs(F.col("actual") - F.col("predicted")), F.abs("predicted")) > CLAIM_DEVIATION, F.lit(False))
    timely = F.datediff("filed_at", "trained_at") <= CLAIM_DAYS
    verdict = F.when(deviates & timely, "ELIGIBLE").when(deviates | timely, "REQUIRES_REVIEW").otherwise("DENIED")
    return joined.select(F.col("id").alias("claim_id"), verdict.alias("verdict"))


# --- jobs -----------------------------------------------------------------------------------------------


def queue_order(jobs: DataFrame) -> DataFrame:
    """Waiting jobs, highest priority first, then oldest."""
    return jobs.filter(F.col("status") == "queued").orderBy(F.desc("priority"), "created_at", "id")


def job_stats(jobs: DataFrame) -> DataFrame:
    """Jobs in total and per state; every state has a column."""
    return jobs.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in JOB_STATES]
    )


def retry_plan(jobs: DataFrame) -> DataFrame:
    """Failed jobs with retries left go back to the queue with one more retry counted."""
    left = F.col("retry_count") < F.coalesce(F.col("max_retries"), F.lit(MAX_RETRIES))
    failed = jobs.filter(F.col("status") == "failed")
    return failed.withColumn("status", F.when(left, "queued").otherwise("failed")).withColumn(
        "retry_count", F.col("retry_count") + F.when(left, 1).otherwise(0)
    )


def stage_progress(stages: DataFrame) -> DataFrame:
    """Share of completed stages and the first one still open; a finished run reads ``completed``."""
    open_stage = F.min(F.when(F.col("status") != "completed", F.struct("stage_no", "stage_name")))
    agg = stages.groupBy("run_id").agg(
        (100.0 * F.count_if(F.col("status") == "completed") / F.count(F.lit(1))).alias("progress"), open_stage.alias("_s")
    )
    return agg.select("run_id", "progress", F.coalesce("_s.stage_name", F.lit("completed")).alias("current_stage"))


def metric_buckets(runs: DataFrame, by: Sequence[str], value: str, buckets: Sequence[float] = tuple(DURATION_BUCKETS)) -> DataFrame:
    """Cumulative histogram, count and sum per label set."""
    hits = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in [*buckets, math.inf]])
    agg = runs.groupBy(*by).agg(hits.alias("_h"), F.sum(value).alias("sum"))
    return agg.select(*by, "sum", F.inline("_h"))
