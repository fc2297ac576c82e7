"""Good and bad rows of text files that are written from the supplied tables."""

import uuid

from pyspark.sql import functions as F

from ..operators.materialise import ensure_checkpoint_dir, leaves_with_session
from ..session import table
from ..sources.quarantine import quarantine_summary, read_with_quarantine
from .registry import query

SCHEMA = "event_id long, user_id long, value double, event_type string"


def folder_of(spark):
    return leaves_with_session(spark, f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}")


def broken_lines(spark, d):
    """All events as JSON lines; every 17th is cut short and every 23rd has a word where a number belongs."""
    e = table(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    wrong = F.when(F.col("event_id") % 23 == 0, F.lit("many")).otherwise(F.col("user_id").cast("string"))
    line = F.to_json(F.struct("event_id", "user_id", "value", "event_type"), {"ignoreNullFields": "false"})
    line = F.when(F.col("event_id") % 23 == 0, F.to_json(F.struct("event_id", wrong.alias("user_id"), "value", "event_type"))).otherwise(line)
    line = F.when(F.col("event_id") % 17 == 0, F.substring(line, 1, 20)).otherwise(line)
    path = f"{folder_of(spark)}.jsonl"
    e.select(line.alias("value")).write.text(leaves_with_session(spark, path))
    return read_with_quarantine(spark, path, SCHEMA, folder_of(spark), "jsonl")


BAD = "event_id % 17 = 0 OR event_id % 23 = 0"


@query("quarantine_good_rows", f"SELECT event_id, user_id, value, event_type FROM events WHERE NOT ({BAD})", 9, "value")
def _(spark, d):
    return broken_lines(spark, d)[0]


@query("quarantine_bad_rows", f"SELECT substr('{{\"event_id\":' || event_id, 1, 20) AS head FROM events WHERE {BAD}")
def _(spark, d):
    raw = broken_lines(spark, d)[1]
    return raw.select(F.regexp_extract("raw", r'^(\{"event_id":[0-9]*)', 1).alias("head"))


@query("quarantine_summary", f"SELECT count(*) FILTER (NOT ({BAD})) AS good_rows, count(*) FILTER ({BAD}) AS bad_rows, 100.0 * count(*) FILTER ({BAD}) / count(*) AS bad_pct FROM events", 6, "bad_pct")
def _(spark, d):
    return quarantine_summary(*broken_lines(spark, d))
