"""Series, loss curves and telemetry."""

from pyspark.sql import functions as F

from ..operators import series as S
from ..session import table
from .registry import query


def events(spark, d):
    return table(spark, d, "events")


IDX = "SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events"


@query("window_means", f"SELECT event_type, i // 10 AS window, avg(value) AS mean_value FROM ({IDX}) GROUP BY ALL HAVING count(*) = 10", 6, "mean_value")
def _(spark, d):
    return S.window_means(events(spark, d), "event_type", ["ts", "event_id"], "value")


@query("window_means_by_user", """WITH i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, i // 10 AS window, avg(value) AS mean_value FROM i WHERE n >= 10 GROUP BY ALL HAVING count(*) = 10 UNION ALL SELECT user_id, i, value FROM i WHERE n < 10""", 6, "mean_value")
def _(spark, d):
    return S.window_means(events(spark, d), "user_id", ["ts", "event_id"], "value")


# loss curves: a customer's orders in key order are the epochs of one run
def curves(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"), (F.col("o_totalprice") / 100000.0).alias("train_loss"))


CURVE = """SELECT run, epoch, l, row_number() OVER w - 1 AS i, lag(l) OVER w AS p, count(*) OVER (PARTITION BY run) AS n
FROM (SELECT o_custkey AS run, o_orderkey AS epoch, o_totalprice / 100000.0 AS l FROM orders) WINDOW w AS (PARTITION BY run ORDER BY epoch)"""


@query("loss_landscape", f"""SELECT run, epochs, CASE WHEN epochs >= 10 THEN dec END AS decrease_score, CASE WHEN epochs >= 10 THEN smo END AS smoothness, CASE WHEN epochs >= 10 THEN sta END AS stability,
 CASE WHEN epochs < 10 THEN 65.0 ELSE 0.4 * dec + 0.3 * smo + 0.3 * sta END AS score FROM (
 SELECT run, count(*) AS epochs, least(100.0, 100.0 * (arg_min(l, i) - arg_max(l, i))) AS dec, 100.0 * (1 - least(1.0, stddev_pop(l - p) / (avg(abs(l - p)) + 1e-8))) AS smo,
 least(100.0, 100.0 * (1 - stddev_pop(l) FILTER (i >= n - ceil(n / 10)) / (avg(l) FILTER (i >= n - ceil(n / 10)) + 1e-8))) AS sta FROM ({CURVE}) GROUP BY run)""", 5, "decrease_score smoothness stability score")
def _(spark, d):
    return S.loss_landscape(curves(spark, d))


RESULTS = "SELECT c_custkey AS run, (c_custkey % 100) / 10.0 AS spectral_entropy, (c_custkey % 130)::DOUBLE AS frequency_concentration FROM customer"


def results(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("run"), ((F.col("c_custkey") % 100) / 10.0).alias("spectral_entropy"), (F.col("c_custkey") % 130).cast("double").alias("frequency_concentration"))


@query("training_collapse", f"""SELECT run, v AS tail_variance, coalesce(n > 3 AND v > 1.0, false) OR spectral_entropy < 2 OR frequency_concentration > 100 AS collapse_detected
FROM ({RESULTS}) LEFT JOIN (SELECT run, max(n) AS n, var_pop(l) FILTER (i >= n - 5) AS v FROM ({CURVE}) GROUP BY 1) USING (run)""", 6, "tail_variance")
def _(spark, d):
    return S.training_collapse(results(spark, d), curves(spark, d))


# gradient norms: the lines of an order are the layers of one run
def grads(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), "l_linenumber", (F.col("l_quantity") * F.col("l_discount") * 80.0).alias("grad_norm"))


GRADS = "SELECT l_orderkey AS run, l_linenumber, l_quantity * l_discount * 80.0::DOUBLE AS g FROM lineitem"


@query("gradient_health", f"""SELECT run, mean_norm, std_norm, CASE WHEN mean_norm IS NULL THEN 100.0 ELSE (CASE WHEN mean_norm > 1e-5 THEN 100.0 ELSE 50.0 END + CASE WHEN mean_norm < 100 THEN 100.0 ELSE 50.0 END) / 2 END AS score
FROM (SELECT o_orderkey AS run FROM orders) LEFT JOIN (SELECT run, avg(g) AS mean_norm, stddev_pop(g) AS std_norm FROM ({GRADS}) GROUP BY 1) USING (run)""", 5, "mean_norm std_norm score")
def _(spark, d):
    return S.gradient_health(grads(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("run")))


@query("gradient_stats", f"SELECT run, sqrt(sum(g * g)) AS total_norm, max(g) AS max_norm, min(g) AS min_norm, max(g) - min(g) AS norm_range FROM ({GRADS}) GROUP BY 1", 5, "total_norm max_norm min_norm norm_range")
def _(spark, d):
    return S.gradient_stats(grads(spark, d))


@query("best_model", "SELECT o_custkey, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS best_model, max(o_totalprice) AS best_metric FROM orders GROUP BY 1", 2, "best_metric")
def _(spark, d):
    return S.best_model(table(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey", "o_orderkey")


@query("batch_spikes", f"""WITH j AS (SELECT event_type, ts, event_id, value, user_id - lag(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS jump FROM events),
l AS (SELECT event_type, avg(value) + 3 * stddev_samp(value) AS nl, avg(jump) + 3 * stddev_samp(jump) AS jl FROM j GROUP BY 1)
SELECT event_type, ts, event_id, value > nl AS norm_spike, coalesce(jump > jl, false) AS loss_spike FROM j JOIN l USING (event_type) WHERE value > nl OR jump > jl""")
def _(spark, d):
    return S.batch_spikes(events(spark, d), "event_type", ["ts", "event_id"], "value", "user_id")


@query("trend_seasonality", f"""WITH i AS ({IDX}) SELECT event_type, regr_slope(value, i) AS slope, corr(value, l1) AS autocorr_1, corr(value, l7) AS autocorr_7 FROM (
 SELECT event_type, i, value, lag(value, 1) OVER w AS l1, lag(value, 7) OVER w AS l7 FROM i WINDOW w AS (PARTITION BY event_type ORDER BY i)) GROUP BY 1""", 8, "slope autocorr_1 autocorr_7")
def _(spark, d):
    return S.trend_seasonality(events(spark, d), "event_type", ["ts", "event_id"], "value")


@query("stationarity", f"""SELECT event_type, t AS df_stat, t < -2.86 AS stationary FROM (SELECT event_type, regr_slope(y, x) / sqrt((regr_syy(y, x) - regr_slope(y, x) ** 2 * regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS t FROM (
 SELECT event_type, p AS x, value - p AS y FROM (SELECT event_type, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL) GROUP BY 1)""", 5, "df_stat")
def _(spark, d):
    return S.stationarity(events(spark, d), "event_type", ["ts", "event_id"], "value")


@query("ordered_split", "SELECT event_id, i AS row_id, CASE WHEN i < floor(n * 0.95) THEN 'train' ELSE 'validation' END AS split FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)")
def _(spark, d):
    return S.ordered_split(events(spark, d), ["ts", "event_id"]).select("event_id", "row_id", "split")
