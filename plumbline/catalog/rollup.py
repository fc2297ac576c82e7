"""Score roll-up, verdicts and predictions."""

from pyspark.sql import functions as F

from ..operators import rollup as M
from ..plans.verdict import pair_scores, pair_verdict
from ..session import table
from .fixtures import DIVERSITY_SQL, ORDER_COLS, PAIR_COLS, SCORES_SQL, lineitem_pair, order_diversity, order_scores
from .registry import query

LIMITS = "(VALUES " + ", ".join(f"('{d}', {t})" for d, t in M.THRESHOLDS.items()) + ") t(dimension, threshold)"
GRADED = f"""SELECT *, score >= threshold AS passed, CASE WHEN score >= threshold THEN 'ok' WHEN score >= threshold * 0.8 THEN 'warning' ELSE 'critical' END AS severity
FROM ({SCORES_SQL}) JOIN {LIMITS} USING (dimension)"""
OVERALL = f"""SELECT validation_id, avg(score) AS overall_score, avg(score) < 65 AS collapse_detected, least(100.0, 100.0 * exp(-var_pop(score) / 1000)) AS confidence
FROM ({SCORES_SQL}) GROUP BY 1"""


@query("neutral_dimension", f"""SELECT o_orderkey AS validation_id, t.dimension AS dimension, coalesce(score, threshold::DOUBLE) AS score, threshold::DOUBLE AS threshold, score IS NULL AS neutral
FROM orders CROSS JOIN {LIMITS} LEFT JOIN ({SCORES_SQL}) s ON s.validation_id = o_orderkey AND s.dimension = t.dimension""", 6, "score threshold")
def _(spark, d):
    return M.fill_neutral(order_scores(spark, d))


@query("severity", f"SELECT validation_id, dimension, score, threshold::DOUBLE AS threshold, passed, severity FROM ({GRADED})", 6, "score threshold")
def _(spark, d):
    return M.with_severity(order_scores(spark, d))


@query("overall_score", OVERALL, 6, "overall_score confidence")
def _(spark, d):
    return M.overall_score(order_scores(spark, d))


@query("warnings", f"""WITH g AS ({GRADED}), o AS (SELECT validation_id, avg(score) AS score, count_if(severity <> 'ok') AS bad FROM g GROUP BY 1)
SELECT validation_id, severity AS level, dimension, score FROM g WHERE severity <> 'ok'
UNION ALL SELECT validation_id, 'collapse', NULL, score FROM o WHERE score < 65
UNION ALL SELECT validation_id, 'all_passed', NULL, score FROM o WHERE score >= 65 AND bad = 0""", 6, "score")
def _(spark, d):
    return M.warnings(order_scores(spark, d))


@query("scale_predictions", f"""SELECT validation_id, dimension, scale, score * CASE scale WHEN '10x' THEN 0.95 ELSE 0.95 * 0.95 END::DOUBLE AS predicted_score
FROM ({SCORES_SQL}), (VALUES ('10x'), ('100x')) s(scale)""", 9, "predicted_score")
def _(spark, d):
    return M.scale_predictions(order_scores(spark, d))


API_SQL = f"""SELECT validation_id, trunc(100.0 - avg(score))::INT AS risk_score, {", ".join(
    f"trunc(coalesce(max(score) FILTER (dimension = '{src}'), 0))::INT AS {name}" for name, src in M.API_DIMENSIONS.items())}
FROM ({SCORES_SQL}) GROUP BY 1"""


@query("api_view", f"""SELECT a.*, trunc(diversity_score)::INT AS diversity_retention, CASE WHEN risk_score < 25 THEN 'low' WHEN risk_score < 60 THEN 'medium' ELSE 'high' END AS risk_level,
 risk_score < 25 AS warranty_eligible FROM ({API_SQL}) a JOIN ({DIVERSITY_SQL}) USING (validation_id)""")
def _(spark, d):
    return M.api_view(order_scores(spark, d), order_diversity(spark, d))


DECIDE_SQL = f"""SELECT validation_id, overall_score, diversity_score, reason IS NULL AS approved,
 CASE WHEN reason IS NULL THEN least(95.0, 75.0 + least(overall_score - 65, diversity_score - 50)) ELSE greatest(50.0, 90.0 - greatest(65 - overall_score, 50 - diversity_score, 0)) END AS confidence,
 coalesce(reason, 'all quality metrics passed') AS reason FROM (
 SELECT *, nullif(concat_ws('; ', CASE WHEN overall_score < 65 THEN 'collapse score below threshold' END, CASE WHEN diversity_score < 50 THEN 'diversity score below threshold' END, weak), '') AS reason
 FROM (SELECT validation_id, avg(score) AS overall_score, string_agg('critical dimension ' || dimension, '; ' ORDER BY dimension) FILTER (score < 40) AS weak FROM ({SCORES_SQL}) GROUP BY 1)
 JOIN ({DIVERSITY_SQL}) USING (validation_id))"""


@query("decide", DECIDE_SQL, 6, "overall_score diversity_score confidence")
def _(spark, d):
    return M.decide(order_scores(spark, d), order_diversity(spark, d))


PERF_SQL = f"""SELECT validation_id, 0.85 + overall_score / 100 * 0.1 AS accuracy, 0.82 + overall_score / 100 * 0.08 AS accuracy_low, 0.88 + overall_score / 100 * 0.12 AS accuracy_high,
 least(greatest((100 - overall_score) / 100, 0.0), 1.0) AS collapse_probability FROM ({OVERALL})"""


@query("predicted_performance", PERF_SQL, 10, "accuracy accuracy_low accuracy_high collapse_probability")
def _(spark, d):
    return M.predicted_performance(M.overall_score(order_scores(spark, d)))


TYPES = "(VALUES " + ", ".join(f"('{d}', '{t}')" for d, t in M.COLLAPSE_TYPES.items()) + ") c(dimension, kind)"


@query("collapse_type", f"""SELECT validation_id, CASE WHEN gap < 0 THEN dimension END AS worst_dimension, CASE WHEN gap < 0 THEN kind ELSE 'none' END AS collapse_type FROM (
 SELECT *, score - threshold AS gap, row_number() OVER (PARTITION BY validation_id ORDER BY score - threshold, dimension) AS i FROM ({GRADED})) JOIN {TYPES} USING (dimension) WHERE i = 1""")
def _(spark, d):
    return M.collapse_type(order_scores(spark, d))


# training runs: one per order line of a customer's market segment, as a stand-in for result telemetry
def runs(spark, d):
    o = table(spark, d, "orders")
    size = F.pow(F.lit(10.0), 6.0 + (F.col("o_orderkey") % 40) / 10.0)
    noise = (F.floor(F.col("o_totalprice")).cast("long") % 100) / 10000.0
    return o.select(
        F.col("o_custkey").alias("validation_id"), (F.col("o_orderkey") % 3 + 1).alias("tier"), size.alias("model_size"),
        (0.95 - 3.0 * F.pow(size, F.lit(-0.25)) + noise).alias("performance"), (F.col("o_totalprice") < 200000).alias("collapse_detected"),
    )


RUNS_SQL = """SELECT o_custkey AS validation_id, o_orderkey % 3 + 1 AS tier, pow(10.0::DOUBLE, 6.0::DOUBLE + (o_orderkey % 40) / 10.0::DOUBLE) AS model_size,
 0.95::DOUBLE - 3.0::DOUBLE * pow(pow(10.0::DOUBLE, 6.0::DOUBLE + (o_orderkey % 40) / 10.0::DOUBLE), -0.25::DOUBLE) + (floor(o_totalprice)::BIGINT % 100) / 10000.0::DOUBLE AS performance,
 o_totalprice < 200000 AS collapse_detected FROM orders"""


@query("consensus", f"""SELECT *, CASE WHEN collapsed_share > 0.7 THEN 'high' WHEN collapsed_share > 0.2 THEN 'medium' ELSE 'low' END AS risk FROM (
 SELECT validation_id, count(*) AS models, sum(CASE WHEN collapse_detected THEN tier ELSE 0 END) / sum(tier) AS collapsed_share FROM ({RUNS_SQL}) GROUP BY 1)""", 7, "collapsed_share")
def _(spark, d):
    return M.consensus(runs(spark, d), {1: 1.0, 2: 2.0, 3: 3.0})


@query("scaling_law", f"""WITH r AS ({RUNS_SQL}), l AS (SELECT validation_id, min(performance) AS mn, max(performance) - min(performance) AS span, count(*) AS runs FROM r GROUP BY 1 HAVING count(*) >= 15),
c AS (SELECT validation_id, runs, mn - span * 3.0 * g / 40.0 AS c FROM l, range(1, 41) AS s(g)),
f AS (SELECT validation_id, runs, c, regr_slope(y, x) AS b, regr_intercept(y, x) AS la, regr_r2(y, x) AS r2 FROM (
 SELECT validation_id, runs, c, ln(model_size) AS x, ln(performance - c) AS y FROM c JOIN r USING (validation_id)) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY validation_id ORDER BY r2 DESC, c DESC) AS i FROM f)
SELECT validation_id, runs, exp(la) AS a, b, c, r2, target_size::DOUBLE AS target_size, exp(la) * pow(target_size::DOUBLE, b) + c AS predicted
FROM k, (VALUES (1e9), (1e10), (1e11)) t(target_size) WHERE i = 1""", 5, "a b c r2 predicted target_size")
def _(spark, d):
    return M.scaling_law(runs(spark, d))


ERR_SQL = f"""SELECT validation_id, accuracy - actual AS error, actual BETWEEN accuracy_low AND accuracy_high AS inside
FROM ({PERF_SQL}) JOIN (SELECT o_orderkey AS validation_id, 0.85 + (o_custkey % 100) / 1000.0 AS actual FROM orders) USING (validation_id)"""


def actuals(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("validation_id"), (0.85 + (F.col("o_custkey") % 100) / 1000.0).alias("actual"))


@query("prediction_error", f"SELECT validation_id, error FROM ({ERR_SQL})", 10, "error")
def _(spark, d):
    return M.prediction_error(M.predicted_performance(M.overall_score(order_scores(spark, d))), actuals(spark, d)).drop("inside")


@query("prediction_bias", f"SELECT count(*) AS validations, avg(error) AS bias, avg(abs(error)) AS mean_abs_error, avg(inside::INT) AS inside_share FROM ({ERR_SQL})", 5, "bias mean_abs_error inside_share")
def _(spark, d):
    return M.prediction_bias(M.prediction_error(M.predicted_performance(M.overall_score(order_scores(spark, d))), actuals(spark, d)))


@query("pair_scores")
def _(spark, d):
    return pair_scores(lineitem_pair(spark, d), PAIR_COLS, ORDER_COLS)


@query("pair_verdict")
def verdict(spark, d):
    return pair_verdict(lineitem_pair(spark, d), PAIR_COLS, ORDER_COLS, 1_000_000)
