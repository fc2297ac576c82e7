"""Responsible rows and regions."""

from pyspark.sql import functions as F

from ..operators import localize as N
from ..operators.near import near_duplicates
from ..session import table
from .compare import PAIR_SQL
from .fixtures import DIVERSITY_SQL, ORDER_COLS, SCORES_SQL, lineitem_pair, order_diversity, order_scores
from .profile import DUP
from .registry import query

KEYS = ", ".join(ORDER_COLS)
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem(spark, d):
    return table(spark, d, "lineitem")


# the inverse of a regularised 2 x 2 covariance, written out
MAHA = f"""WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_samp(l_quantity) + 1e-6 AS a, covar_samp(l_quantity, l_extendedprice) AS b, var_samp(l_extendedprice) + 1e-6 AS c FROM lineitem),
r AS (SELECT {KEYS}, sqrt(greatest(0, ((l_quantity - mx) ** 2 * c - 2 * (l_quantity - mx) * (l_extendedprice - my) * b + (l_extendedprice - my) ** 2 * a) / (a * c - b * b))) AS v FROM lineitem, s)
SELECT {KEYS}, v / max(v) OVER () AS mahalanobis FROM r"""


@query("mahalanobis", MAHA, 6, "mahalanobis")
def _(spark, d):
    return N.mahalanobis(lineitem(spark, d), ["l_quantity", "l_extendedprice"]).select(*ORDER_COLS, "mahalanobis")


MAXZ = "WITH s AS (SELECT " + ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) + 1e-6 AS s{i}" for i, c in enumerate(NUM)) + f""" FROM lineitem),
r AS (SELECT {KEYS}, greatest({", ".join(f"abs({c} - m{i}) / s{i}" for i, c in enumerate(NUM))}) AS v FROM lineitem, s)
SELECT {KEYS}, v / max(v) OVER () AS max_abs_z FROM r"""


@query("max_abs_z", MAXZ, 6, "max_abs_z")
def _(spark, d):
    return N.max_abs_z(lineitem(spark, d), NUM).select(*ORDER_COLS, "max_abs_z")


@query("density_anomaly")
def _(spark, d):
    return N.density_anomaly(lineitem(spark, d).select(*ORDER_COLS, *NUM), NUM, ORDER_COLS)


def scores(spark, d):
    return N.impact_scores(lineitem(spark, d), NUM, ORDER_COLS)


@query("impact_scores")
def _(spark, d):
    return scores(spark, d)


@query("problem_rows")
def _(spark, d):
    return N.problem_rows(scores(spark, d), 0.7)


@query("problem_summary")
def _(spark, d):
    return N.problem_summary(scores(spark, d), 0.7)


@query("top_rows", f"SELECT * FROM ({MAXZ}) ORDER BY max_abs_z DESC, {KEYS} LIMIT 1000", 6, "max_abs_z")
def _(spark, d):
    z = N.max_abs_z(lineitem(spark, d), NUM).select(*ORDER_COLS, "max_abs_z")
    return N.top_rows(z, ORDER_COLS, 1000, "max_abs_z")


ALL_MAXZ = MAXZ.replace(f"SELECT {KEYS}, ", "SELECT l_quantity, ")


@query("drop_problem_rows", f"SELECT count(*) AS n, sum(l_quantity) AS q FROM ({ALL_MAXZ}) WHERE max_abs_z <= 0.9", 2, "q")
def _(spark, d):
    bad = N.max_abs_z(lineitem(spark, d), NUM).filter(F.col("max_abs_z") > 0.9)
    return N.drop_problem_rows(lineitem(spark, d), bad, [*ORDER_COLS, *NUM]).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@query("gradient_impact", f"SELECT {KEYS}, l_extendedprice / max(l_extendedprice) OVER () AS impact FROM lineitem", 8, "impact")
def _(spark, d):
    return N.gradient_impact(lineitem(spark, d).select(*ORDER_COLS, "l_extendedprice"), "l_extendedprice").drop("l_extendedprice")


@query("dimension_attribution", f"""WITH f AS (SELECT dimension, avg(score) AS score FROM ({SCORES_SQL}) GROUP BY 1 HAVING avg(score) < 65),
v AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS col, unnest([var_pop(l_quantity), var_pop(l_extendedprice), var_pop(l_discount), var_pop(l_tax)]) AS x FROM lineitem)
SELECT dimension, score, col, x / (SELECT max(x) FROM v) AS attribution FROM f, v""", 8, "score attribution")
def _(spark, d):
    per = order_scores(spark, d).groupBy("dimension").agg(F.avg("score").alias("score"))
    return N.dimension_attribution(lineitem(spark, d), per, NUM)


@query("localization_findings", f"""SELECT validation_id, CASE WHEN problem_pct > 20 THEN 'regenerate' WHEN problem_pct > 10 THEN 'remove_rows' WHEN problem_pct > 5 THEN 'review' ELSE 'acceptable' END AS kind,
 problem_pct::DOUBLE AS value FROM ({DIVERSITY_SQL})
UNION ALL SELECT validation_id, 'failed_dimensions', count(*)::DOUBLE FROM ({SCORES_SQL}) WHERE score < 65 GROUP BY 1
UNION ALL SELECT validation_id, 'export_and_remove', problem_rows::DOUBLE FROM ({DIVERSITY_SQL}) WHERE problem_rows > 0""", 4, "value")
def _(spark, d):
    return N.localization_findings(order_diversity(spark, d), order_scores(spark, d))


INDEXED = f"SELECT *, row_number() OVER (ORDER BY {KEYS}, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS row_id FROM lineitem"


def regions_sql(gap: int) -> str:
    return f"""WITH f AS (SELECT row_id, l_extendedprice / 105000.0 AS s FROM ({INDEXED}) WHERE l_extendedprice > 80000),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR row_id - b > {gap} THEN 1 ELSE 0 END) OVER (ORDER BY row_id) AS g FROM (SELECT *, lag(row_id) OVER (ORDER BY row_id) AS b FROM f))
SELECT min(row_id) AS row_start, max(row_id) AS row_end, count(*) AS rows, avg(s) AS mean_impact, max(s) AS max_impact,
 CASE WHEN max(s) > 0.9 THEN 'critical' WHEN max(s) > 0.8 THEN 'high' ELSE 'medium' END AS severity FROM g GROUP BY g"""


def flagged(spark, d):
    rows = N.with_row_index(lineitem(spark, d), ORDER_COLS)
    return rows.filter("l_extendedprice > 80000").withColumn("impact", F.col("l_extendedprice") / 105000.0)


@query("problem_regions", regions_sql(1), 8, "mean_impact max_impact")
def _(spark, d):
    return N.problem_regions(flagged(spark, d))


@query("problem_regions_gap", regions_sql(5), 8, "mean_impact max_impact")
def _(spark, d):
    return N.problem_regions(flagged(spark, d), gap=5)


@query("exact_duplicates", f"""SELECT md5(concat_ws('|', l_linenumber::VARCHAR, l_returnflag, l_linestatus, l_suppkey::VARCHAR)) AS content_hash, count(*) AS copies, min(l_orderkey) AS first_id, max(l_orderkey) AS last_id
FROM lineitem GROUP BY l_linenumber, l_returnflag, l_linestatus, l_suppkey HAVING count(*) > 1""")
def _(spark, d):
    return N.exact_duplicates(lineitem(spark, d), ["l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey"], "l_orderkey")


@query("entity_duplicates", """SELECT lower(regexp_replace(p_name, '[^\\p{L}\\p{N}]+', '', 'g')) AS p_name, lower(regexp_replace(p_brand, '[^\\p{L}\\p{N}]+', '', 'g')) AS p_brand, count(*) AS copies
FROM part GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, d):
    return N.entity_duplicates(table(spark, d, "part"), ["p_name", "p_brand"])


def regioned(spark, d):
    return N.with_region(lineitem(spark, d), ORDER_COLS, 500)


@query("with_row_index", INDEXED)
def _(spark, d):
    return N.with_row_index(lineitem(spark, d), ORDER_COLS)


@query("outlier_density", f"""WITH i AS (SELECT ts, event_id, value, user_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id FROM events),
q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, quantile_cont(user_id, 0.25) AS c, quantile_cont(user_id, 0.75) AS e FROM events)
SELECT *, outlier_pct > 5 AS flagged FROM (SELECT row_id // 500 AS region, min(row_id) AS row_start, max(row_id) AS row_end,
 100.0 * count_if(value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) OR user_id < c - 1.5 * (e - c) OR user_id > e + 1.5 * (e - c)) / count(*) AS outlier_pct FROM i, q GROUP BY 1)""", 6, "outlier_pct")
def _(spark, d):
    return N.outlier_density(N.with_region(table(spark, d, "events"), ["ts", "event_id"], 500), ["value", "user_id"], 5.0)


PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:]]


@query("correlation_inconsistency", f"""WITH i AS (SELECT *, row_id // 500 AS region FROM ({INDEXED}))
SELECT region, max(gap) AS max_gap, max(gap) > 0.1 AS flagged FROM ({" UNION ALL ".join(
    f"SELECT region, abs(coalesce(corr({a}, {b}), 0) - (SELECT corr({a}, {b}) FROM lineitem)) AS gap FROM i GROUP BY 1" for a, b in PAIRS)}) GROUP BY 1""", 7, "max_gap")
def _(spark, d):
    return N.correlation_inconsistency(regioned(spark, d), NUM, 0.1)


ABLATE = f"""WITH p AS ({PAIR_SQL}), l AS (SELECT side, l_linenumber AS region, 'q' AS col, q AS v FROM p UNION ALL SELECT side, l_linenumber, 'x', x FROM p),
g AS (SELECT col, min(v) AS lo, max(v) AS hi FROM l GROUP BY 1),
c AS (SELECT side, region, col, least(floor((v - lo) / (hi - lo) * 50), 49)::INT AS bin FROM l JOIN g USING (col)),
t AS (SELECT col, bin, count_if(side = 'syn') AS cs, count_if(side = 'orig') AS co FROM c GROUP BY ALL),
b AS (SELECT *, sum(cs) OVER (PARTITION BY col) AS ts, sum(co) OVER (PARTITION BY col) AS tt FROM t),
r AS (SELECT region, col, bin, count(*) AS n FROM c WHERE side = 'syn' GROUP BY ALL),
s AS (SELECT region, col, sum(n) AS rn FROM r GROUP BY ALL)
SELECT region, before, after, after - before AS improvement, after - before > 0 AS confirmed FROM
 (SELECT region, 100.0 * avg(x) AS after FROM (SELECT s.region, s.col, sum(least((cs - coalesce(n, 0)) / (ts - rn), co / tt)) AS x
  FROM s JOIN b USING (col) LEFT JOIN r ON r.region = s.region AND r.col = s.col AND r.bin = b.bin GROUP BY ALL) GROUP BY 1),
 (SELECT 100.0 * avg(x) AS before FROM (SELECT col, sum(least(cs / ts, co / tt)) AS x FROM b GROUP BY 1))"""


@query("ablate", ABLATE, 6, "before after improvement")
def _(spark, d):
    return N.ablate(lineitem_pair(spark, d), ["q", "x"], "l_linenumber")


@query("root_causes", f"""WITH c AS (SELECT 'duplicates' AS cause, coalesce(sum(n - 1), 0)::BIGINT AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY {DUP})
UNION ALL SELECT 'outliers', count(*) FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem) WHERE abs(l_extendedprice - m) > 2 * s
UNION ALL SELECT 'missing', count(*) FROM lineitem WHERE l_discount = 0)
SELECT cause, rows, 100.0 * rows / sum(rows) OVER () AS pct FROM c""", 6, "pct")
def _(spark, d):
    from ..operators.profile import duplicate_rows, zscore_outliers

    li = lineitem(spark, d)
    duplicates = duplicate_rows(li.select(*DUP.split(", "))).select(F.lit("duplicates").alias("cause"), F.col("duplicate_rows").alias("rows"))
    outliers = zscore_outliers(li, ["l_extendedprice"], 2.0).select(F.lit("outliers").alias("cause"), F.col("outliers").alias("rows"))
    missing = li.agg(F.lit("missing").alias("cause"), F.count_if(F.col("l_discount") == 0).alias("rows"))
    return N.root_causes(duplicates.unionByName(outliers).unionByName(missing))


def near_sql(percent: int) -> str:
    """All pairs that share a shingle, exact similarity, and clusters by reachability."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
sets AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
each AS (SELECT node, n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.node AS a, b.node AS b FROM each a JOIN each b ON a.x = b.x AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
pairs2 AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs UNION ALL SELECT node, node FROM sets),
reach AS (SELECT a, b FROM pairs2 UNION SELECT r.a, x.b FROM reach r JOIN pairs2 x ON r.b = x.a),
label AS (SELECT a AS node, min(b) AS cluster_id FROM reach GROUP BY a),
out AS (SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(sets.node, s.doc_id) AS exact_id, coalesce(label.cluster_id, s.doc_id) AS cluster_id, label.node IS NULL AS alone
    FROM s LEFT JOIN sets ON s.s = sets.s LEFT JOIN label ON label.node = sets.node)
SELECT doc_id, n_shingles, exact_id, cluster_id, CASE WHEN alone THEN 1 ELSE count(*) OVER (PARTITION BY cluster_id, alone) END AS cluster_size, cluster_id = doc_id AS kept FROM out"""


@query("near_duplicates", near_sql(80))
def _(spark, d):
    return near_duplicates(table(spark, d, "documents"))


@query("near_duplicates_95", near_sql(95))
def _(spark, d):
    return near_duplicates(table(spark, d, "documents"), similarity=0.95)
