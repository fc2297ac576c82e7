"""Inputs shared by several query families, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import table

# --- dataset pairs: open against final line status, one validation per return flag -----------------------
# The synthetic side of validation A is collapsed: quantity folded to five values, price to steps of ten.

PAIR_COLS = ["q", "x", "disc", "tax"]
ORDER_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def lineitem_pair(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    broken = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A")
    price = F.col("l_extendedprice") / 1000.0
    base = li.select(
        F.col("l_returnflag").alias("validation_id"),
        F.when(F.col("l_linestatus") == "O", "syn").otherwise("orig").alias("side"),
        F.when(broken, F.col("l_quantity") % 5).otherwise(F.col("l_quantity")).alias("q"),
        F.when(broken, F.floor(price / 10.0) * 10.0).otherwise(price).alias("x"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
        *ORDER_COLS,
    )
    return base


PAIR_SQL = """SELECT l_returnflag AS validation_id, CASE WHEN l_linestatus = 'O' THEN 'syn' ELSE 'orig' END AS side,
 CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN l_quantity % 5 ELSE l_quantity END AS q,
 CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN floor(l_extendedprice / 1000.0 / 10.0) * 10.0 ELSE l_extendedprice / 1000.0 END AS x,
 l_discount AS disc, l_tax AS tax, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem"""

LONG_SQL = " UNION ALL ".join(f"SELECT validation_id, side, '{c}' AS col, {c} AS value FROM p" for c in PAIR_COLS)

# --- validations: one per order, eight scores by arithmetic on the order ---------------------------------

# The eight dimensions, with a multiplier that spreads the derived scores.
DIMENSION_FACTORS = {
    "distribution_fidelity": 7,
    "correlation_preservation": 13,
    "entropy_stability": 29,
    "gradient_health": 31,
    "loss_landscape": 43,
    "spectral_coherence": 57,
    "generalization_gap": 61,
    "statistical_consistency": 79,
}


def order_scores(spark, d) -> DataFrame:
    """(validation_id, dimension, score); telemetry dimensions are missing for status P.

    Scores are multiples of 1/8, so their means do not depend on the order of addition.
    """
    o = table(spark, d, "orders")
    whole = F.floor(F.col("o_totalprice")).cast("long")
    rows = F.array(*[
        F.struct(F.lit(n).alias("dimension"), (((F.col("o_orderkey") * k + whole) % 801) / 8.0).alias("score"))
        for n, k in DIMENSION_FACTORS.items()
    ])
    long = o.select(F.col("o_orderkey").alias("validation_id"), "o_orderstatus", F.inline(rows))
    absent = (F.col("o_orderstatus") == "P") & F.col("dimension").isin("gradient_health", "loss_landscape")
    return long.filter(~absent).select("validation_id", "dimension", "score")


SCORES_SQL = (
    "SELECT o_orderkey AS validation_id, dimension, ((o_orderkey * k + floor(o_totalprice)::BIGINT) % 801) / 8.0 AS score"
    " FROM orders, (VALUES "
    + ", ".join(f"('{n}', {k})" for n, k in DIMENSION_FACTORS.items())
    + ") f(dimension, k) WHERE NOT (o_orderstatus = 'P' AND dimension IN ('gradient_health', 'loss_landscape'))"
)


def order_diversity(spark, d) -> DataFrame:
    """(validation_id, diversity_score, problem_pct, problem_rows)."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("validation_id"),
        ((F.col("o_custkey") * 37 + F.col("o_orderkey")) % 1000 / 10.0).alias("diversity_score"),
        ((F.col("o_custkey") * 11 + F.col("o_orderkey") * 3) % 300 / 10.0).alias("problem_pct"),
        (F.col("o_orderkey") % 5000).alias("problem_rows"),
    )


DIVERSITY_SQL = (
    "SELECT o_orderkey AS validation_id, (o_custkey * 37 + o_orderkey) % 1000 / 10.0 AS diversity_score,"
    " (o_custkey * 11 + o_orderkey * 3) % 300 / 10.0 AS problem_pct, o_orderkey % 5000 AS problem_rows FROM orders"
)
