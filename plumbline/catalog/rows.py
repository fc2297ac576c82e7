"""Readers, slices and written results."""

import uuid

from pyspark.sql import functions as F

from ..operators.materialise import ensure_checkpoint_dir
from ..operators.rollup import decide
from ..sources import readers as A, sinks as W
from ..session import table
from .fixtures import DIVERSITY_SQL, SCORES_SQL, order_diversity, order_scores
from .registry import query
from .rollup import DECIDE_SQL

ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
ORDERS_SQL = f"SELECT {', '.join(ORDERS_COLS)} FROM orders"


def scratch(spark, suffix: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files/{uuid.uuid4().hex}{suffix}"


def orders(spark, d):
    return table(spark, d, "orders").select(*ORDERS_COLS)


@query("read_csv", ORDERS_SQL)
def _(spark, d):
    path = scratch(spark, ".csv")
    orders(spark, d).write.csv(path, header=True)
    return A.read_dataset(spark, path, schema=orders(spark, d).schema)


@query("read_tsv", ORDERS_SQL)
def _(spark, d):
    path = scratch(spark, ".TSV")
    orders(spark, d).write.csv(path, header=True, sep="\t")
    return A.read_dataset(spark, path, schema=orders(spark, d).schema)


@query("read_jsonl", ORDERS_SQL)
def _(spark, d):
    path = scratch(spark, ".jsonl")
    orders(spark, d).write.json(path)
    return A.read_dataset(spark, path).select(*ORDERS_COLS)


@query("read_parquet", ORDERS_SQL)
def _(spark, d):
    return A.read_dataset(spark, f"{d}/orders.parquet").select(*ORDERS_COLS)


@query("read_arrow", ORDERS_SQL)
def _(spark, d):
    path = scratch(spark, ".arrow")
    W.write_arrow(orders(spark, d), path).agg(F.sum("rows")).collect()
    return A.read_dataset(spark, path)


@query("dataset_metadata", "SELECT 'parquet' AS format, count(*) AS row_count, 6 AS column_count FROM orders")
def _(spark, d):
    return A.dataset_metadata(spark, f"{d}/orders.parquet").select("format", "row_count", "column_count")


@query("slice_rows", "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i FROM orders) WHERE i >= 500 AND i < 900", 2, "o_totalprice")
def _(spark, d):
    return A.slice_rows(orders(spark, d), 500, 900, ["o_totalprice", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("stream_dataset", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    from ..streaming.streams import run_to_table

    stream = A.stream_dataset(spark, d, table(spark, d, "events").schema, pattern="events.parquet")
    return run_to_table(stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "complete")


@query("write_report", f"SELECT validation_id, approved, reason FROM ({DECIDE_SQL})")
def _(spark, d):
    scores = order_scores(spark, d)
    report = W.build_report(decide(scores, order_diversity(spark, d)), scores)
    path = scratch(spark, ".jsonl")
    W.write_report(report, path)
    back = spark.read.schema(report.schema).json(path)
    return back.select("validation_id", "final_decision.approved", "final_decision.reason")


@query("write_sample", "SELECT o_orderkey FROM orders ORDER BY md5(concat_ws('|', o_orderkey::VARCHAR, '42')) LIMIT 500")
def _(spark, d):
    from ..operators.sampling import random_cap

    path = scratch(spark, ".parquet")
    W.write_sample(random_cap(orders(spark, d).select("o_orderkey"), 500, ["o_orderkey"]), path)
    return A.read_dataset(spark, path)
