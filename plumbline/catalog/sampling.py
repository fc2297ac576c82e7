"""Samples and clusters."""

from pyspark.sql import functions as F

from ..operators import clusters as K, sampling as Q
from ..session import table
from .registry import query

H = "md5(concat_ws('|', o_orderkey::VARCHAR, '42'))"


def orders(spark, d):
    return table(spark, d, "orders")


@query("auto_strata", """SELECT col, u AS "unique" FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority']) AS col, unnest([1, 2, 3, 4, 6]) AS p,
 unnest([count(DISTINCT o_orderkey), count(DISTINCT o_custkey), count(DISTINCT o_orderstatus), count(DISTINCT o_totalprice), count(DISTINCT o_orderpriority)]) AS u,
 unnest([true, true, false, true, false]) AS num FROM orders) WHERE (num AND u <= 50) OR (NOT num AND u BETWEEN 2 AND 100) ORDER BY abs(u - 10), p LIMIT 3""")
def _(spark, d):
    return Q.auto_strata(orders(spark, d))


BIN_POINTS = ", ".join(repr(i / 49) for i in range(50))


@query("adaptive_bins", f"""SELECT 'o_totalprice' AS col, unnest(range(50))::INT AS position, unnest(quantile_cont(o_totalprice, [{BIN_POINTS}])) AS edge, NULL::VARCHAR AS value FROM orders
UNION ALL SELECT DISTINCT 'o_orderstatus', NULL, NULL, o_orderstatus FROM orders""", 3, "edge")
def _(spark, d):
    return Q.adaptive_bins(orders(spark, d), ["o_totalprice", "o_orderstatus"])


STRAT = f"""WITH k AS (SELECT *, {H} AS h, count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n, count(*) OVER () AS total FROM orders),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY h) AS i FROM k) WHERE i <= CASE WHEN n = 1 THEN 1 ELSE round_even(1000.0::DOUBLE / total * n, 0) END)
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM p ORDER BY h LIMIT 1000"""


def sample(spark, d):
    return Q.stratified_sample(orders(spark, d).select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"], 1000, ["o_orderkey"])


@query("stratified_sample", STRAT)
def _(spark, d):
    return sample(spark, d)


@query("stratified_sample_binned")
def _(spark, d):
    return Q.stratified_sample(orders(spark, d), ["o_orderstatus", "o_totalprice"], 1000, ["o_orderkey"], bin_numeric=True)


@query("sample_info", f"SELECT (SELECT count(*) FROM orders) AS original_size, count(*) AS sample_size, count(DISTINCT o_orderstatus || o_orderpriority) AS strata, count(*) / (SELECT count(*) FROM orders) AS sample_fraction FROM ({STRAT})", 8, "sample_fraction")
def _(spark, d):
    return Q.sample_info(sample(spark, d), orders(spark, d), ["o_orderstatus", "o_orderpriority"])


@query("random_cap", f"SELECT o_orderkey FROM orders ORDER BY {H} LIMIT 700")
def _(spark, d):
    return Q.random_cap(orders(spark, d).select("o_orderkey"), 700, ["o_orderkey"])


@query("temporal_balance", f"""SELECT o_orderkey, period FROM (SELECT o_orderkey, period, row_number() OVER (PARTITION BY period ORDER BY h) AS i FROM (
 SELECT o_orderkey, date_trunc('quarter', o_orderdate)::TIMESTAMP AS period, {H} AS h FROM orders)) WHERE i <= 20""")
def _(spark, d):
    return Q.temporal_balance(orders(spark, d).select("o_orderkey", "o_orderdate"), "o_orderdate", "quarter", 20, ["o_orderkey"]).drop("o_orderdate")


VALIDATE = f"""WITH s AS (SELECT o_custkey::DOUBLE AS a, o_totalprice AS b, h FROM (SELECT *, {H} AS h FROM orders) ORDER BY h LIMIT 1000),
l AS (SELECT true AS smp, 'o_custkey' AS col, a AS v FROM s UNION ALL SELECT true, 'o_totalprice', b FROM s UNION ALL SELECT false, 'o_custkey', o_custkey FROM orders UNION ALL SELECT false, 'o_totalprice', o_totalprice FROM orders),
m AS (SELECT col, v, count_if(smp) AS cs, count_if(NOT smp) AS co FROM l GROUP BY ALL),
k AS (SELECT col, max(abs(a / ns - b / no)) AS ks FROM (SELECT col, sum(cs) OVER w AS a, sum(co) OVER w AS b, sum(cs) OVER (PARTITION BY col) AS ns, sum(co) OVER (PARTITION BY col) AS no FROM m WINDOW w AS (PARTITION BY col ORDER BY v)) GROUP BY 1)
SELECT avg(100 * (1 - ks)) AS ks_similarity, abs((SELECT corr(a, b) FROM s) - (SELECT corr(o_custkey, o_totalprice) FROM orders)) AS max_correlation_gap FROM k"""


@query("validate_sample", VALIDATE, 6, "ks_similarity max_correlation_gap")
def _(spark, d):
    full = orders(spark, d).select("o_orderkey", "o_custkey", "o_totalprice")
    part = Q.random_cap(full, 1000, ["o_orderkey"])
    return K.validate_sample(part, full, ["o_custkey", "o_totalprice"]).select("ks_similarity", "max_correlation_gap")


@query("validate_sample_full")
def _(spark, d):
    full = orders(spark, d).select("o_orderkey", "o_custkey", "o_totalprice")
    return K.validate_sample(Q.random_cap(full, 1000, ["o_orderkey"]), full, ["o_custkey", "o_totalprice"])


@query("cluster_rows")
def _(spark, d):
    return K.cluster_summary(K.cluster_rows(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"], 5), ["c_acctbal", "c_nationkey"])


@query("cluster_quality")
def _(spark, d):
    return K.cluster_quality(K.cluster_rows(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"], 5))


@query("diversity_sample")
def _(spark, d):
    placed = K.cluster_rows(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"], 5).drop("features")
    return Q.diversity_sample(placed, "cluster_id", 300, ["c_custkey"], ["c_mktsegment", "c_nationkey"], ["c_acctbal"])
