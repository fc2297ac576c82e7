"""Two-sample distribution comparison."""

from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators.pairs import stack_pair, trim_to_common
from ..session import table
from .fixtures import LONG_SQL, PAIR_COLS, PAIR_SQL, lineitem_pair
from .registry import query


def core(spark, d):
    return lineitem_pair(spark, d).select("validation_id", "side", *PAIR_COLS)


ECDF = f"""p AS ({PAIR_SQL}), lng AS ({LONG_SQL}),
m AS (SELECT validation_id, col, value, count_if(side = 'syn')::BIGINT AS cs, count_if(side = 'orig')::BIGINT AS co FROM lng GROUP BY ALL),
e AS (SELECT validation_id, col, value, cs, co, sum(cs) OVER w AS cum_s, sum(co) OVER w AS cum_o,
 sum(cs) OVER g AS n_s, sum(co) OVER g AS n_o, lead(value) OVER w AS next_value
 FROM m WINDOW w AS (PARTITION BY validation_id, col ORDER BY value), g AS (PARTITION BY validation_id, col)),
r AS (SELECT validation_id, col, max(n_s) AS n_s, max(n_o) AS n_o, max(abs(cum_s / n_s - cum_o / n_o)) AS ks,
 sum(abs(cum_s / n_s - cum_o / n_o) * (next_value - value)) AS area,
 max(CASE WHEN co > 0 THEN value END) - min(CASE WHEN co > 0 THEN value END) AS range_o,
 sum(cs * (cum_o - co + co / 2.0)) AS u_s, sum((cs + co)::DOUBLE ** 3 - (cs + co)) AS ties,
 sum(CASE WHEN sp > 0 THEN t / n * ((n * ms - b * n_s) ** 2 / n_s + (n * mo - b * n_o) ** 2 / n_o) / sp END) * (max(n) - 1) / max(n) AS a2
 FROM (SELECT *, b * (n - b) - n * t / 4.0 AS sp FROM (SELECT *, (cs + co)::DOUBLE AS t, (n_s + n_o)::DOUBLE AS n,
  (cum_s + cum_o)::DOUBLE - (cs + co) / 2.0 AS b, cum_s - cs / 2.0 AS ms, cum_o - co / 2.0 AS mo FROM e)) GROUP BY ALL)"""


@query("trim_to_common", """SELECT 'syn' AS side, sum(l_quantity) AS q, sum(CASE WHEN l_discount <> 0 THEN l_discount ELSE 0 END) AS disc FROM lineitem WHERE l_linestatus = 'O'
UNION ALL SELECT 'orig', sum(l_quantity), sum(l_discount) FROM lineitem WHERE l_linestatus = 'F'""", 2, "q disc")
def _(spark, d):
    li = table(spark, d, "lineitem")
    syn = li.filter("l_linestatus = 'O'").select("l_quantity", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), "l_tax")
    orig = li.filter("l_linestatus = 'F'").select("l_discount", "l_quantity", "l_extendedprice")
    syn, orig = trim_to_common(syn, orig)
    sums = [F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("disc")]
    return syn.agg(F.lit("syn").alias("side"), *sums).unionByName(orig.agg(F.lit("orig").alias("side"), *sums))


@query("stack_pair", """SELECT l_returnflag AS validation_id, CASE WHEN l_linestatus = 'O' THEN 'syn' ELSE 'orig' END AS side, count(*) AS n,
 sum(l_quantity) AS q, sum(l_tax) AS tax FROM lineitem GROUP BY ALL""", 2, "q tax")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", "l_quantity", "l_tax")
    pair = stack_pair(li.filter("l_linestatus = 'O'"), li.filter("l_linestatus = 'F'"), validation_id="l_returnflag")
    return pair.groupBy("validation_id", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"), F.sum("l_tax").alias("tax"))


@query("ecdf_merge", f"""WITH {ECDF} SELECT validation_id, col, value, cs, co, cum_s::BIGINT AS cum_s, cum_o::BIGINT AS cum_o,
 n_s::BIGINT AS n_s, n_o::BIGINT AS n_o, next_value FROM e""", 6, "value next_value")
def _(spark, d):
    return C.ecdf_merge(core(spark, d), PAIR_COLS).drop("cum_n")


@query("ecdf_summary", f"WITH {ECDF} SELECT validation_id, col, n_s::BIGINT AS n_s, n_o::BIGINT AS n_o, ks, area, range_o, u_s::DOUBLE / n_s / n_o AS u_share, ties / (n_s + n_o)::DOUBLE ** 3 AS tie_share, a2 FROM r", 6,
       "ks area range_o u_share tie_share a2")
def _(spark, d):
    out = C.ecdf_summary(C.ecdf_merge(core(spark, d), PAIR_COLS))
    n = (F.col("n_s") + F.col("n_o")).cast("double")
    return out.withColumn("u_share", F.col("u_s") / F.col("n_s") / F.col("n_o")).withColumn("tie_share", F.col("ties") / n**3).drop("u_s", "ties")


@query("ks_similarity", f"WITH {ECDF} SELECT validation_id, avg(100.0 * (1.0 - ks)) AS ks_similarity FROM r GROUP BY 1", 6, "ks_similarity")
def _(spark, d):
    return C.ks_similarity(C.ecdf_summary(C.ecdf_merge(core(spark, d), PAIR_COLS)))


@query("wasserstein_similarity", f"WITH {ECDF} SELECT validation_id, 100.0 * avg(1.0 - least(1.0, area / (range_o + 1e-8))) AS wasserstein_similarity FROM r GROUP BY 1", 6, "wasserstein_similarity")
def _(spark, d):
    return C.wasserstein_similarity(C.ecdf_summary(C.ecdf_merge(core(spark, d), PAIR_COLS)))


MOMENTS = """mm AS (SELECT validation_id, col, avg(value) FILTER (side = 'syn') AS ms, avg(value) FILTER (side = 'orig') AS mo,
 stddev_samp(value) FILTER (side = 'syn') AS ss, stddev_samp(value) FILTER (side = 'orig') AS so FROM lng GROUP BY ALL),
mom AS (SELECT validation_id, 100.0 * exp(-avg(abs(ms - mo))) AS mean_match, 100.0 * exp(-avg(abs(ss - so))) AS std_match FROM mm GROUP BY 1)"""


@query("moment_match", f"WITH p AS ({PAIR_SQL}), lng AS ({LONG_SQL}), {MOMENTS} SELECT * FROM mom", 6, "mean_match std_match")
def _(spark, d):
    return C.moment_match(core(spark, d), PAIR_COLS)


def histogram_ctes(bins: int, ranges: str) -> str:
    """SQL bins of both sides; the same rule as the operator."""
    where = "FILTER (side = 'syn')" if ranges == "syn" else ""
    keys = "validation_id, side, col" if ranges == "own" else "validation_id, col"
    return f"""rg AS (SELECT {keys}, min(value) {where} AS lo, max(value) {where} AS hi FROM lng GROUP BY ALL),
hb AS (SELECT validation_id, col, side, least(floor((value - lo) / (hi - lo) * {bins}), {bins - 1})::INT AS bin
 FROM lng JOIN (SELECT {keys}, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM rg) USING ({keys})
 WHERE value BETWEEN lo AND hi),
hg AS (SELECT k.validation_id, k.col, k.bin, coalesce(cs, 0) AS cs, coalesce(co, 0) AS co FROM
 (SELECT validation_id, col, bin::INT AS bin FROM (SELECT DISTINCT validation_id, col FROM lng), range({bins}) AS s(bin)) k
 LEFT JOIN (SELECT validation_id, col, bin, count_if(side = 'syn')::BIGINT AS cs, count_if(side = 'orig')::BIGINT AS co FROM hb GROUP BY ALL) c USING (validation_id, col, bin)),
ms AS (SELECT *, cs / (sum(cs) OVER v + 1e-10) AS ps, co / (sum(co) OVER v + 1e-10) AS po FROM hg WINDOW v AS (PARTITION BY validation_id, col)),
sm AS (SELECT *, (ps + 1e-10) / sum(ps + 1e-10) OVER v AS qs, (po + 1e-10) / sum(po + 1e-10) OVER v AS qo FROM ms WINDOW v AS (PARTITION BY validation_id, col)),
hs AS (SELECT validation_id, 100.0 * avg(hi) AS histogram_intersection, avg(kl) AS kl_divergence, 100.0 * exp(-avg(kl)) AS kl_similarity, avg(js) AS js_divergence FROM (
 SELECT validation_id, col, sum(least(ps, po)) AS hi, sum(qs * ln(qs / qo)) AS kl,
  sum(0.5 * qs * ln(qs / ((qs + qo) / 2.0)) + 0.5 * qo * ln(qo / ((qs + qo) / 2.0))) AS js FROM sm GROUP BY ALL) GROUP BY 1)"""


HIST50 = f"p AS ({PAIR_SQL}), lng AS ({LONG_SQL}), {histogram_ctes(50, 'syn')}"


def hist50(spark, d):
    return C.side_histograms(core(spark, d), C.HISTOGRAM_BINS, "syn", PAIR_COLS)


@query("shared_histogram", f"WITH {HIST50} SELECT * FROM hg")
def _(spark, d):
    return hist50(spark, d)


@query("histogram_intersection", f"WITH {HIST50} SELECT validation_id, histogram_intersection FROM hs", 6, "histogram_intersection")
def _(spark, d):
    return C.histogram_intersection(hist50(spark, d))


@query("kl_divergence", f"WITH {HIST50} SELECT validation_id, kl_divergence, kl_similarity FROM hs", 6, "kl_divergence kl_similarity")
def _(spark, d):
    return C.kl_divergence(hist50(spark, d))


@query("js_divergence", f"WITH {HIST50} SELECT validation_id, js_divergence FROM hs", 6, "js_divergence")
def _(spark, d):
    return C.js_divergence(hist50(spark, d))


FIDELITY_SQL = f"""WITH {ECDF}, {MOMENTS}, {histogram_ctes(50, 'syn')},
rk AS (SELECT validation_id, avg(100.0 * (1.0 - ks)) AS ks_similarity, 100.0 * avg(1.0 - least(1.0, area / (range_o + 1e-8))) AS wasserstein_similarity FROM r GROUP BY 1)
SELECT *, score >= 70.0 AS passed FROM (SELECT validation_id, ks_similarity, wasserstein_similarity, mean_match, std_match, histogram_intersection, kl_similarity,
 least(100.0, greatest(0.0, 0.2 * ks_similarity + 0.2 * wasserstein_similarity + 0.15 * mean_match + 0.15 * std_match + 0.15 * histogram_intersection + 0.15 * kl_similarity)) AS score
 FROM rk JOIN mom USING (validation_id) JOIN hs USING (validation_id))"""
FIDELITY_FLOATS = "ks_similarity wasserstein_similarity mean_match std_match histogram_intersection kl_similarity score"


@query("distribution_fidelity", FIDELITY_SQL, 5, FIDELITY_FLOATS)
def fidelity(spark, d):
    return C.distribution_fidelity(core(spark, d), PAIR_COLS)


def chi2_ctes(ranges):
    return f"""p AS ({PAIR_SQL}), lng AS ({LONG_SQL}), {histogram_ctes(20, ranges)},
ch AS (SELECT validation_id, col, sum((cs + 1.0 - e) ** 2 / e) AS chi2 FROM (
 SELECT validation_id, col, cs, (co + 1.0) * sum(cs + 1.0) OVER v / sum(co + 1.0) OVER v AS e FROM hg WINDOW v AS (PARTITION BY validation_id, col)) GROUP BY ALL)"""


@query("chi2_statistic", f"WITH {chi2_ctes('own')} SELECT * FROM ch", 5, "chi2")
def _(spark, d):
    return C.chi2_statistic(core(spark, d), PAIR_COLS)


@query("chi2_statistic_shared", f"WITH {chi2_ctes('both')} SELECT * FROM ch", 5, "chi2")
def _(spark, d):
    return C.chi2_statistic(core(spark, d), PAIR_COLS, shared=True)


@query("anderson_darling_mann_whitney", f"""WITH {ECDF} SELECT validation_id, col, a2, u_s::DOUBLE / n_s / n_o AS u_share,
 abs(u_s - n_s * n_o / 2.0) / sqrt(n_s::DOUBLE * n_o / 12.0 * (n_s + n_o + 1 - ties / ((n_s + n_o)::DOUBLE * (n_s + n_o - 1)))) AS z FROM r""", 5, "a2 u_share z")
def _(spark, d):
    s = C.ecdf_summary(C.ecdf_merge(core(spark, d), PAIR_COLS))
    n1, n2 = F.col("n_s").cast("double"), F.col("n_o").cast("double")
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return s.select("validation_id", "col", "a2", (F.col("u_s") / n1 / n2).alias("u_share"), (F.abs(F.col("u_s") - n1 * n2 / 2.0) / sd).alias("z"))


@query("statistical_consistency")
def _(spark, d):
    return C.statistical_consistency(core(spark, d), PAIR_COLS)


@query("drift", """WITH i AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS r, count(*) OVER () AS n FROM events),
lng AS (SELECT 'value' AS col, value AS v, r >= n // 2 AS late FROM i UNION ALL SELECT 'user_id', user_id, r >= n // 2 FROM i),
m AS (SELECT col, v, count_if(late) AS s, count_if(NOT late) AS o FROM lng GROUP BY ALL)
SELECT col, max(abs(cs / ns - co / no)) AS ks FROM (SELECT col, sum(s) OVER w AS cs, sum(o) OVER w AS co, sum(s) OVER (PARTITION BY col) AS ns, sum(o) OVER (PARTITION BY col) AS no
 FROM m WINDOW w AS (PARTITION BY col ORDER BY v)) GROUP BY col""", 8, "ks")
def _(spark, d):
    return C.drift(table(spark, d, "events"), ["ts", "event_id"], ["value", "user_id"])
