"""Column statistics, quality and diversity."""

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.common import select_numeric
from ..operators.correlation import correlation_pairs, correlation_matrix, spearman_matrix
from ..operators.ordered import quantiles
from ..plans.diversity import diversity_report, diversity_score
from ..session import table
from .registry import query

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART = ["p_size", "p_retailprice"]


def lineitem(spark, d):
    return table(spark, d, "lineitem")


def union_sql(template: str, cols, source: str) -> str:
    return "\nUNION ALL\n".join(template.format(c=c, t=source) for c in cols)


STATS = """SELECT '{c}' AS col, count({c}) AS count, count(*) - count({c}) AS nulls, avg({c}) AS mean,
 stddev_samp({c}) AS std, stddev_pop({c}) AS std_pop, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
 skewness({c}) AS skew, kurtosis({c}) AS kurtosis,
 count(DISTINCT {c}) AS "unique", quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75
FROM {t}"""
STATS_FLOATS = "mean std std_pop min max skew kurtosis q25 median q75"

LI_STATS = union_sql(STATS, NUM, "lineitem")
PART_STATS = union_sql(STATS, PART, "part")

SCORED = """SELECT *, (spread_score + uniqueness_score + balance_score) / 3.0 AS dimension_score FROM (
 SELECT *, CASE WHEN mean = 0 THEN 50.0 ELSE coalesce(least(100.0, 50.0 * std / abs(mean)), 50.0) END AS spread_score,
  CASE WHEN count = 0 THEN 0.0 ELSE least(100.0, 100.0 * "unique" / count) END AS uniqueness_score,
  CASE WHEN q75 = q25 THEN 50.0
   ELSE least(greatest(100.0 * (1.0 - abs((median - q25) - (q75 - median)) / (q75 - q25)), 0.0), 100.0) END AS balance_score,
  abs(skew) AS skew_factor
 FROM ({s}))"""

DIVERSITY = """SELECT row_count, columns, mean_dimension_score, sample_quality,
 0.7 * mean_dimension_score + 0.3 * sample_quality AS diversity_score FROM (
 SELECT max(count + nulls) AS row_count, count(*) AS columns, avg(dimension_score) AS mean_dimension_score,
  0.6 * least(1.0, max(count + nulls) / {target}) * 100.0
  + 0.4 * coalesce(avg(CASE WHEN mean <> 0 THEN least(100.0, 50.0 * std / abs(mean)) END), 50.0) AS sample_quality
 FROM ({scored}))"""


@query("select_numeric", """SELECT * FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)""")
def _(spark, d):
    return select_numeric(lineitem(spark, d))


TEXT_PROFILE = """SELECT '{c}' AS col, count(*) AS row_count, count(*) - count(v) AS null_count, count(DISTINCT v) AS distinct_count,
 min(x) AS min_value, max(x) AS max_value, avg(x) AS mean_value FROM (
 SELECT v, CASE WHEN regexp_full_match(v, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') THEN try_cast(v AS DOUBLE) END AS x
 FROM (SELECT CASE WHEN {c}::VARCHAR NOT IN ('', 'null', 'NULL', 'NA') THEN {c}::VARCHAR END AS v FROM {t}))"""
PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query("profile_columns", union_sql(TEXT_PROFILE, PART_COLS, "part"), 4, "min_value max_value mean_value")
def _(spark, d):
    return P.profile_columns(table(spark, d, "part"))


@query("null_unique_rates", f"""SELECT col, null_count / row_count AS null_rate, distinct_count / row_count AS unique_rate
FROM ({union_sql(TEXT_PROFILE, PART_COLS, "part")})""", 8, "null_rate unique_rate")
def _(spark, d):
    return P.null_unique_rates(P.profile_columns(table(spark, d, "part")))


@query("infer_types", """SELECT * FROM (VALUES ('p_partkey'), ('p_name'), ('p_brand'), ('p_type'), ('p_size'), ('p_retailprice')) AS c(col)
JOIN (""" + union_sql("""SELECT '{c}' AS col, CASE WHEN max(CASE WHEN regexp_full_match({c}::VARCHAR, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') THEN 1 ELSE 0 END) = 1
 THEN 'float64' ELSE 'string' END AS type FROM {t}""", PART_COLS, "part") + ") USING (col)")
def _(spark, d):
    return P.infer_types(table(spark, d, "part"))


@query("normalise_nulls", """SELECT event_id, CASE WHEN v NOT IN ('', 'null', 'NULL', 'NA') THEN v END AS event_type
FROM (SELECT event_id, CASE WHEN value < 2 THEN 'NA' WHEN value < 5 THEN '' ELSE event_type END AS v FROM events)""")
def _(spark, d):
    raw = F.when(F.col("value") < 2, "NA").when(F.col("value") < 5, "").otherwise(F.col("event_type"))
    return P.normalise_nulls(table(spark, d, "events").select("event_id", raw.alias("event_type")))


DUP = "l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"


@query("duplicate_rows", f"""SELECT sum(n)::BIGINT AS row_count, count(*) AS distinct_rows, sum(n - 1)::BIGINT AS duplicate_rows,
 count(*) / sum(n) AS uniqueness FROM (SELECT count(*) AS n FROM lineitem GROUP BY {DUP})""", 8, "uniqueness")
def _(spark, d):
    return P.duplicate_rows(lineitem(spark, d).select(*DUP.split(", ")))


@query("completeness", """SELECT cells, nulls AS null_cells, 1.0 - nulls / cells AS completeness FROM (
 SELECT count(*) * 3 AS cells, (count(*) * 3 - count(l_orderkey) - count(nullif(l_discount, 0)) - count(nullif(l_tax, 0))) AS nulls FROM lineitem)""", 8, "completeness")
def _(spark, d):
    return P.completeness(with_gaps(lineitem(spark, d)).select("l_orderkey", "l_discount", "l_tax"))


def with_gaps(df):
    """Zero discounts and taxes read as missing, which gives the table real null patterns."""
    return df.withColumn("l_discount", F.nullif("l_discount", F.lit(0.0))).withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))


@query("missing_patterns", """SELECT CASE WHEN l_quantity IS NULL THEN '1' ELSE '0' END || CASE WHEN nullif(l_discount, 0) IS NULL THEN '1' ELSE '0' END
 || CASE WHEN nullif(l_tax, 0) IS NULL THEN '1' ELSE '0' END AS pattern, count(*) AS n FROM lineitem GROUP BY 1""")
def _(spark, d):
    return P.missing_patterns(with_gaps(lineitem(spark, d)), ["l_quantity", "l_discount", "l_tax"])


@query("json_profile", "SELECT key, count(*) AS row_count FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def _(spark, d):
    return P.json_profile(table(spark, d, "events"), "props")


@query("json_summary", """SELECT count(*) AS row_count, 0::BIGINT AS bad_rows,
 (SELECT count(DISTINCT key) FROM (SELECT unnest(json_keys(props)) AS key FROM events)) AS column_count FROM events""")
def _(spark, d):
    return P.json_summary(table(spark, d, "events"), "props")


@query("column_stats", LI_STATS, 5, STATS_FLOATS)
def _(spark, d):
    return P.column_stats(lineitem(spark, d), NUM)


@query("column_stats_by_group", "\nUNION ALL\n".join(
    STATS.replace("SELECT", "SELECT l_returnflag,", 1).format(c=c, t="lineitem") + " GROUP BY l_returnflag" for c in NUM), 5, STATS_FLOATS)
def _(spark, d):
    return P.column_stats(lineitem(spark, d), NUM, keys=["l_returnflag"])


@query("quantile_grid", union_sql("""SELECT '{c}' AS col, count(DISTINCT {c}) AS "unique", count({c}) AS count,
 quantile_cont({c}, 0.01) AS p01, quantile_cont({c}, 0.1) AS p10, quantile_cont({c}, 0.9) AS p90, quantile_cont({c}, 0.99) AS p99 FROM {t}""", NUM, "lineitem"), 6, "p01 p10 p90 p99")
def _(spark, d):
    return quantiles(lineitem(spark, d), NUM, {"p01": 0.01, "p10": 0.1, "p90": 0.9, "p99": 0.99})


@query("running_stats", union_sql("""SELECT '{c}' AS col, count({c}) AS count, sum({c}) AS sum, sum({c} * {c}) / 1e9 AS sum_sq, avg({c}) AS mean,
 stddev_pop({c}) AS std, min({c}) AS min, max({c}) AS max FROM {t}""", NUM, "lineitem"), 3, "sum sum_sq mean std min max")
def _(spark, d):
    return P.running_stats(lineitem(spark, d), NUM).drop("q25", "median", "q75").withColumn("sum_sq", F.col("sum_sq") / 1e9)


@query("running_stats_sketch")
def _(spark, d):
    return P.running_stats(lineitem(spark, d), NUM)


@query("column_stats_approx")
def _(spark, d):
    return P.column_stats(lineitem(spark, d), NUM, approx=True)


@query("dimension_scores", "SELECT col, spread_score, uniqueness_score, balance_score, dimension_score, skew_factor FROM ("
       + SCORED.format(s=LI_STATS) + ")", 6, "spread_score uniqueness_score balance_score dimension_score skew_factor")
def _(spark, d):
    out = P.dimension_scores(P.column_stats(lineitem(spark, d), NUM))
    return out.select("col", "spread_score", "uniqueness_score", "balance_score", "dimension_score", "skew_factor")


@query("sample_quality", "SELECT sample_quality FROM (" + DIVERSITY.format(target="1000000.0", scored=SCORED.format(s=LI_STATS)) + ")", 6, "sample_quality")
def _(spark, d):
    stats = P.column_moments(lineitem(spark, d), NUM)
    return P.sample_quality(stats, F.col("count") + F.col("nulls"), 1_000_000)


DIVERSITY_FLOATS = "mean_dimension_score sample_quality diversity_score"


@query("diversity_score", DIVERSITY.format(target="1000000.0", scored=SCORED.format(s=LI_STATS)), 6, DIVERSITY_FLOATS)
def diversity(spark, d):
    return diversity_score(lineitem(spark, d), NUM, target_rows=1_000_000)


@query("diversity_score_part", DIVERSITY.format(target="1000000.0", scored=SCORED.format(s=PART_STATS)), 6, DIVERSITY_FLOATS)
def _(spark, d):
    return diversity_score(table(spark, d, "part"), PART, target_rows=1_000_000)


OUTLIERS = """SELECT '{c}' AS col, lo AS low_fence, hi AS high_fence, count_if({c} < lo OR {c} > hi)::BIGINT AS outliers,
 100.0 * count_if({c} < lo OR {c} > hi) / count({c}) AS outlier_pct,
 max(CASE WHEN {c} < lo OR {c} > hi THEN 5.0 ELSE 0.0 END)::DOUBLE AS outlier_flag_pct
FROM {t}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}))
GROUP BY lo, hi"""


@query("outlier_pct", union_sql(OUTLIERS, ["value", "user_id"], "events"), 6, "low_fence high_fence outlier_pct outlier_flag_pct")
def _(spark, d):
    return P.outlier_pct(table(spark, d, "events"), ["value", "user_id"])


@query("zscore_outliers", union_sql("""SELECT '{c}' AS col, count_if(abs({c} - m) > 3 * s)::BIGINT AS outliers, 100.0 * count_if(abs({c} - m) > 3 * s) / count({c}) AS outlier_pct
FROM {t}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {t})""", ["value", "user_id"], "events"), 6, "outlier_pct")
def _(spark, d):
    return P.zscore_outliers(table(spark, d, "events"), ["value", "user_id"])


@query("quality_score", f"""SELECT 1.0 AS completeness, (SELECT count(*) / sum(n) FROM (SELECT count(*) AS n FROM events GROUP BY ALL)) AS uniqueness,
 1.0 AS validity, (SELECT sum(outliers)::BIGINT FROM ({union_sql(OUTLIERS, ["value", "user_id"], "events")})) AS outlier_count""".replace(
    "(SELECT count(*) AS n FROM events GROUP BY ALL)", "(SELECT count(*) AS n FROM events GROUP BY user_id, value)"), 8, "completeness uniqueness validity")
def _(spark, d):
    return P.quality_score(table(spark, d, "events").select("user_id", "value"))


@query("diversity_findings", f"""WITH s AS ({SCORED.format(s=union_sql(STATS, ["value", "user_id"], "events"))}),
o AS ({union_sql(OUTLIERS, ["value", "user_id"], "events")}),
q AS (SELECT sample_quality FROM ({DIVERSITY.format(target="1000000.0", scored="SELECT * FROM s")})),
f AS (SELECT 'low_diversity' AS kind, col, dimension_score AS value FROM s WHERE dimension_score < 30
 UNION ALL SELECT 'high_skew', col, skew_factor FROM s WHERE skew_factor > 2
 UNION ALL SELECT 'outliers', col, outlier_pct FROM o WHERE outlier_pct > 10
 UNION ALL SELECT 'low_sample_quality', NULL, sample_quality FROM q WHERE sample_quality < 60)
SELECT * FROM f UNION ALL SELECT 'ok', NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM f)""", 6, "value")
def _(spark, d):
    return diversity_report(table(spark, d, "events"), ["value", "user_id"], 1_000_000)


def pairs_sql(fn: str, cols, source: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {fn}({a}, {b}) AS r FROM {source}"
        for i, a in enumerate(cols) for b in cols[i + 1:]
    )


CORR_COLS = ["l_linenumber", *NUM]


@query("correlation_matrix", pairs_sql("corr", CORR_COLS, "lineitem"), 8, "r")
def _(spark, d):
    return correlation_matrix(lineitem(spark, d), CORR_COLS)


@query("correlation_matrix_blocks", pairs_sql("corr", CORR_COLS, "lineitem"), 8, "r")
def _(spark, d):
    return correlation_matrix(lineitem(spark, d), CORR_COLS, max_pairs=1)


@query("correlation_pairs", f"SELECT * FROM ({pairs_sql('corr', CORR_COLS, 'lineitem')}) WHERE abs(r) >= 0.5", 8, "r")
def _(spark, d):
    return correlation_pairs(lineitem(spark, d), CORR_COLS, min_abs=0.5)


RANKED = "(SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in CORR_COLS) + " FROM lineitem)"


@query("spearman_matrix", pairs_sql("corr", CORR_COLS, RANKED), 8, "r")
def _(spark, d):
    return spearman_matrix(lineitem(spark, d), CORR_COLS)


ENT_CAT = """SELECT '{c}' AS col, -sum(n / t * ln(n / t)) AS entropy FROM (SELECT n, sum(n) OVER () AS t FROM (SELECT count(*) AS n FROM {t} GROUP BY {c}))"""
ENT_NUM = """SELECT '{c}' AS col, -sum(n / t * ln(n / t)) AS entropy FROM (SELECT n, sum(n) OVER () AS t FROM (
 SELECT count(*) AS n FROM (SELECT least(floor(({c} - lo) / (hi - lo) * 50), 49) AS b FROM {t}, (SELECT min({c}) AS lo, max({c}) AS hi FROM {t})) GROUP BY b))"""


@query("column_entropy", union_sql(ENT_CAT, ["o_orderstatus", "o_orderpriority"], "orders") + "\nUNION ALL\n" + union_sql(ENT_NUM, ["o_totalprice", "o_custkey"], "orders"), 8, "entropy")
def _(spark, d):
    return P.column_entropy(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey"])


GINI = """SELECT '{c}' AS col, count(*) AS values, 2.0 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*) AS gini
FROM (SELECT n, row_number() OVER (ORDER BY n) AS i FROM (SELECT count(*) AS n FROM {t} GROUP BY {c}))"""


@query("gini", union_sql(GINI, ["o_custkey", "o_orderpriority", "o_totalprice"], "orders"), 8, "gini")
def _(spark, d):
    return P.gini(table(spark, d, "orders"), ["o_custkey", "o_orderpriority", "o_totalprice"])


TOPK = """SELECT '{c}' AS col, sum(CASE WHEN i <= 10 THEN n END) / sum(n) AS concentration_ratio
FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS i FROM (SELECT count(*) AS n FROM {t} GROUP BY {c}))"""


@query("concentration_ratio", union_sql(TOPK, ["o_custkey", "o_orderpriority", "o_totalprice"], "orders"), 8, "concentration_ratio")
def _(spark, d):
    return P.concentration_ratio(table(spark, d, "orders"), 10, ["o_custkey", "o_orderpriority", "o_totalprice"])


RARE_COLS = "l_returnflag, l_linestatus, l_linenumber, l_tax"
RARE = f"SELECT {RARE_COLS}, n, n / sum(n) OVER () AS share FROM (SELECT {RARE_COLS}, count(*) AS n FROM lineitem GROUP BY ALL)"


@query("rare_patterns", f"SELECT * FROM ({RARE}) WHERE share < 0.01", 8, "share")
def _(spark, d):
    return P.rare_patterns(lineitem(spark, d), RARE_COLS.split(", "))


@query("rare_pattern_pct", f"SELECT count_if(share < 0.01)::BIGINT AS rare_patterns, 100.0 * coalesce(sum(CASE WHEN share < 0.01 THEN n END), 0) / sum(n) AS rare_pct FROM ({RARE})", 8, "rare_pct")
def _(spark, d):
    return P.rare_pattern_pct(lineitem(spark, d), RARE_COLS.split(", "))


FLAT = """SELECT '{c}' AS col, sum(n * n) * 50.0 / sum(n) - sum(n) AS chi2, sum(n * n) * 50.0 / sum(n) - sum(n) < 49.0 + 3.0 * sqrt(98.0) AS suspicious FROM (
 SELECT count(*) AS n FROM (SELECT least(floor(({c} - lo) / (hi - lo) * 50), 49) AS b FROM {t}, (SELECT min({c}) AS lo, max({c}) AS hi FROM {t})) GROUP BY b)"""


@query("suspicious_uniformity", union_sql(FLAT, ["o_totalprice", "o_custkey"], "orders"), 6, "chi2")
def _(spark, d):
    return P.flatness(table(spark, d, "orders"), ["o_totalprice", "o_custkey"])


SHAPE = """SELECT '{c}' AS col, skew, kurtosis, peaks, CASE WHEN kurtosis > 3 AND abs(skew) > 2 THEN 'long_tail' WHEN abs(skew) > 1 THEN 'skewed'
 WHEN abs(skew) <= 0.5 AND kurtosis < -1 THEN 'flat' WHEN peaks > 1 THEN 'multimodal' WHEN abs(skew) > 0.5 THEN 'skewed' ELSE 'normal' END AS shape
FROM (SELECT skewness({c}) AS skew, kurtosis({c}) AS kurtosis FROM {t}), (
 SELECT count_if(s > coalesce(l, -1) AND s > coalesce(r, -1) AND s >= 0.1 * top)::BIGINT AS peaks FROM (
  SELECT s, lag(s) OVER (ORDER BY b) AS l, lead(s) OVER (ORDER BY b) AS r, max(s) OVER () AS top FROM (
   SELECT b, avg(n) OVER (ORDER BY b ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM (
    SELECT b, count(v) AS n FROM range(50) AS r(b) LEFT JOIN (
     SELECT least(floor(({c} - lo) / (hi - lo) * 50), 49)::BIGINT AS v FROM {t}, (SELECT min({c}) AS lo, max({c}) AS hi FROM {t})) ON v = b GROUP BY b))))"""


@query("shape_class", union_sql(SHAPE, ["value", "user_id"], "events"), 6, "skew kurtosis")
def _(spark, d):
    return P.shape_class(table(spark, d, "events"), ["value", "user_id"])


@query("dataset_fingerprint", """SELECT count(*) AS row_count, sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR AS hash_a, sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR AS hash_b
FROM (SELECT sha256(o_orderkey::VARCHAR || '|' || o_custkey::VARCHAR || '|' || o_orderstatus || '|' || o_orderpriority) AS h FROM orders)""")
def _(spark, d):
    return P.dataset_fingerprint(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
