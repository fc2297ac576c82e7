"""Signature library."""

from pyspark.sql import functions as F

from ..operators import signatures as O
from ..session import table
from .fixtures import DIMENSION_FACTORS, SCORES_SQL, order_scores
from .registry import query

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# vector from per-order scores and line statistics: two statistics present, five missing
VEC_SQL = f"""WITH st AS (SELECT l_orderkey AS validation_id, avg(l_quantity) AS q, avg(l_discount) AS dd, max(l_quantity) AS mq, count(*) AS n FROM lineitem GROUP BY 1),
raw AS (SELECT validation_id, p AS pos, coalesce(score, 50.0) / 100.0 AS v FROM st
 CROSS JOIN (VALUES {", ".join(f"({i}, '{d}')" for i, d in enumerate(DIMENSION_FACTORS))}) d(p, dimension) LEFT JOIN ({SCORES_SQL}) s USING (validation_id, dimension)
 UNION ALL SELECT validation_id, 8, q FROM st UNION ALL SELECT validation_id, 9, dd FROM st UNION ALL SELECT validation_id, 32, mq FROM st UNION ALL SELECT validation_id, 65, n / 10.0 FROM st)
SELECT validation_id, pos, v / (sqrt(sum(v * v) OVER (PARTITION BY validation_id)) + 1e-10) AS value FROM raw"""


@query("signature_vector", f"SELECT * FROM ({VEC_SQL}) WHERE value <> 0", 7, "value")
def _(spark, d):
    st = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("validation_id")).agg(
        F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("dd"), F.max("l_quantity").alias("mq"), F.count(F.lit(1)).alias("n"))
    scores = order_scores(spark, d).groupBy("validation_id").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "score"))).alias("dimension_scores"))
    stats = F.create_map(F.lit("mean"), F.array("q", "dd"), F.lit("max"), F.array("mq"))
    base = st.join(scores, "validation_id", "left").select(
        "validation_id", "dimension_scores", stats.alias("stats"), F.lit(None).cast("double").alias("skewness"), (F.col("n") / 10.0).alias("kurtosis"))
    out = O.signature_vector(base)
    return out.select("validation_id", F.posexplode_outer("vector").alias("pos", "value")).filter("value <> 0")


@query("simple_stats", "SELECT avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max FROM (SELECT unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem)", 4, "mean std min max")
def _(spark, d):
    return O.simple_stats(table(spark, d, "lineitem"), NUM)


@query("signature_id", """SELECT vec_id, substr(sha256(vec_id::VARCHAR || '_' || printf('%.4f', embedding[1]::DOUBLE) || ',' || printf('%.4f', embedding[2]::DOUBLE) || ',' || printf('%.4f', embedding[3]::DOUBLE) || ',' || printf('%.4f', embedding[4]::DOUBLE)), 1, 16) AS signature_id FROM embeddings""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", O.signature_id(F.col("vec_id"), F.col("embedding")).alias("signature_id"))


DIMS = list(DIMENSION_FACTORS.items())


def library(spark, d):
    """Signatures from the embeddings: history derived from the id."""
    e = table(spark, d, "embeddings")
    scores = F.map_from_arrays(
        F.array(*[F.lit(n) for n, _ in DIMS]), F.array(*[((F.col("vec_id") * k + 11) % 1001) / 10.0 for _, k in DIMS]))
    return e.select(
        F.col("vec_id").alias("signature_id"), O.unit(F.col("embedding")).alias("vector"), F.col("label").alias("cluster_id"),
        ((F.col("vec_id") * 37) % 1000 / 10.0).alias("collapse_score"), (F.col("vec_id") % 15).alias("usage_count"),
        ((F.col("vec_id") % 11) / 10.0).alias("prediction_accuracy"), ((F.col("vec_id") % 7) / 10.0).alias("anomaly_score"),
        scores.alias("dimension_scores"))


LIB_SQL = """SELECT vec_id AS signature_id, label AS cluster_id, (vec_id * 37) % 1000 / 10.0 AS collapse_score, vec_id % 15 AS usage_count, (vec_id % 11) / 10.0 AS prediction_accuracy,
 (vec_id % 7) / 10.0 AS anomaly_score FROM embeddings"""
HIST_SQL = f"SELECT vec_id AS signature_id, dimension, ((vec_id * k + 11) % 1001) / 10.0 AS h FROM embeddings, (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {k})' for n, k in DIMS)}) f(dimension, k)"
# the current side lacks two dimensions
CUR_SQL = f"SELECT vec_id AS query_id, dimension, ((vec_id * k + 500) % 1001) / 10.0 AS c FROM embeddings, (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {k})' for n, k in DIMS[:6])}) f(dimension, k)"


def queries_side(spark, d):
    return library(spark, d).select(F.col("signature_id").alias("query_id"), "vector")


def current(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("query_id"), F.map_from_arrays(
        F.array(*[F.lit(n) for n, _ in DIMS[:6]]), F.array(*[((F.col("vec_id") * k + 500) % 1001) / 10.0 for _, k in DIMS[:6]])).alias("current_scores"))


T = 0.3
MATCH_SQL = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS signature_id, list_dot_product(a.e, b.e) / ((sqrt(list_dot_product(a.e, a.e)) + 1e-10) * (sqrt(list_dot_product(b.e, b.e)) + 1e-10)) AS similarity
 FROM v a, v b WHERE a.vec_id <> b.vec_id)
SELECT query_id, signature_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, signature_id) AS rank FROM s WHERE similarity >= {T}) WHERE rank <= 10"""


@query("match_exact", MATCH_SQL, 7, "similarity")
def matches(spark, d):
    return O.match_exact(queries_side(spark, d), library(spark, d), 10, T, exclude_self=True)


@query("match_exact_cells", MATCH_SQL, 7, "similarity")
def _(spark, d):
    return O._rank(O._cell_search(queries_side(spark, d), library(spark, d), 10, T, True), 10)


@query("match_approx")
def _(spark, d):
    return O.match_approx(queries_side(spark, d), library(spark, d), 10, T, exclude_self=True)


@query("match_hybrid")
def _(spark, d):
    return O.match_hybrid(queries_side(spark, d), library(spark, d), 10, T, exclude_self=True)


@query("choose_strategy", "SELECT CASE WHEN count(*) < 1000 THEN 'exact' WHEN count(*) < 10000 THEN 'hybrid' ELSE 'approximate' END AS strategy FROM embeddings")
def _(spark, d):
    n = F.count(F.lit(1))
    return table(spark, d, "embeddings").agg(
        F.when(n < O.EXACT_BELOW, O.choose_strategy(0)).when(n < O.HYBRID_BELOW, O.choose_strategy(O.EXACT_BELOW)).otherwise(O.choose_strategy(O.HYBRID_BELOW)).alias("strategy"))


def assessed(spark, d):
    return O.assess_matches(matches(spark, d), library(spark, d).drop("vector", "cluster_id"), current(spark, d))


ASSESS = f"""m AS ({MATCH_SQL}), l AS ({LIB_SQL}), h AS ({HIST_SQL}), c AS ({CUR_SQL}),
al AS (SELECT query_id, signature_id, avg(CASE WHEN h < 65 AND c < 65 THEN 1.0 WHEN h >= 65 AND c >= 65 THEN 0.8 ELSE 0.3 END) AS alignment FROM m JOIN h USING (signature_id) JOIN c USING (query_id, dimension) GROUP BY ALL),
a AS (SELECT *, least(100.0, 40.0 * similarity + 0.3 * CASE WHEN prediction_accuracy > 0 THEN prediction_accuracy * 100 ELSE 80 END + 0.15 * (70 + 30 * least(1.0, usage_count / 10.0)) + 15.0 * alignment) AS confidence,
 least(100.0, 50.0 * (1 - similarity) + greatest(0, 30 - 3 * usage_count) + 20.0 * anomaly_score) AS uncertainty FROM m JOIN l USING (signature_id) JOIN al USING (query_id, signature_id)),
r AS (SELECT *, CASE WHEN collapse_score < 30 AND confidence > 70 THEN 'CRITICAL' WHEN collapse_score < 50 AND confidence > 60 THEN 'HIGH' WHEN collapse_score < 65 AND confidence > 50 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM a)"""


@query("dimension_alignment", f"WITH {ASSESS} SELECT query_id, signature_id, alignment FROM r", 6, "alignment")
def _(spark, d):
    return assessed(spark, d).select("query_id", "signature_id", "alignment")


@query("assess_matches", f"WITH {ASSESS} SELECT query_id, signature_id, confidence, uncertainty, risk FROM r", 5, "confidence uncertainty")
def _(spark, d):
    return assessed(spark, d).select("query_id", "signature_id", "confidence", "uncertainty", "risk")


EXPLAIN = f"""WITH {ASSESS} SELECT query_id, signature_id, dimension, h AS historical_score, coalesce(c, 75.0) AS current_score, abs(h - coalesce(c, 75.0)) AS difference, abs(h - coalesce(c, 75.0)) < 15 AS matching
FROM m JOIN h USING (signature_id) LEFT JOIN c USING (query_id, dimension)"""


@query("explain_match", f"SELECT query_id, signature_id, dimension, historical_score::DOUBLE AS historical_score, current_score::DOUBLE AS current_score, difference::DOUBLE AS difference FROM ({EXPLAIN})", 4, "historical_score current_score difference")
def _(spark, d):
    return O.explain_match(assessed(spark, d)).drop("matching")


# scores have one decimal, so the limit of 15 points is compared in tenths
@query("match_insights", f"""SELECT query_id, signature_id, n AS matching_dimensions, n > 4 AS strong_match, collapse_score < 50 AS severe_history, usage_count > 5 AS well_validated
FROM (SELECT query_id, signature_id, count_if(matching)::BIGINT AS n FROM ({EXPLAIN.replace("h AS historical_score", "h::DOUBLE AS historical_score").replace("abs(h - coalesce(c, 75.0)) < 15", "abs(h::DOUBLE - coalesce(c::DOUBLE, 75.0::DOUBLE)) < 15.0::DOUBLE")}) GROUP BY ALL) JOIN ({LIB_SQL}) USING (signature_id)""")
def _(spark, d):
    return O.match_insights(assessed(spark, d))


@query("top_failures", f"""SELECT signature_id, dimension, h::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY signature_id ORDER BY h, dimension) AS rank FROM ({HIST_SQL}) WHERE h < 65) WHERE rank <= 3""", 4, "score")
def _(spark, d):
    return O.top_failures(library(spark, d))


@query("match_advice", f"""WITH {ASSESS}, w AS (SELECT signature_id, dimension FROM (SELECT *, row_number() OVER (PARTITION BY signature_id ORDER BY h, dimension) AS i FROM h WHERE h < 65) WHERE i <= 3)
SELECT query_id, signature_id, dimension, CASE WHEN coalesce(c, 75.0) < 65 THEN 'immediate_attention' ELSE 'monitor' END AS advice FROM m JOIN w USING (signature_id) LEFT JOIN c USING (query_id, dimension)
UNION ALL SELECT query_id, signature_id, NULL, 'regenerate' FROM r JOIN (SELECT query_id, avg(c) AS mean FROM c GROUP BY 1) USING (query_id) WHERE collapse_score < 40 AND mean < 60""")
def _(spark, d):
    return O.match_advice(assessed(spark, d))


@query("cluster_signatures")
def _(spark, d):
    return O.cluster_signatures(library(spark, d), 10)


@query("upsert_signatures", f"""SELECT coalesce(l.signature_id, n.id) AS signature_id, coalesce(n.s, l.collapse_score)::DOUBLE AS collapse_score,
 CASE WHEN l.signature_id IS NULL THEN 0 ELSE usage_count + CASE WHEN n.id IS NULL THEN 0 ELSE 1 END END AS usage_count, coalesce(prediction_accuracy, 0)::DOUBLE AS prediction_accuracy
FROM ({LIB_SQL}) l FULL OUTER JOIN (SELECT vec_id * 2 AS id, label * 10.0 AS s FROM embeddings) n ON l.signature_id = n.id""", 4, "collapse_score prediction_accuracy")
def _(spark, d):
    new = table(spark, d, "embeddings").select((F.col("vec_id") * 2).alias("signature_id"), (F.col("label") * 10.0).alias("collapse_score"))
    return O.upsert_signatures(library(spark, d).select("signature_id", "collapse_score", "usage_count", "prediction_accuracy"), new)


@query("accuracy_feedback", f"""WITH f AS (SELECT user_id AS signature_id, (event_id % 101) / 100.0 AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
g AS (SELECT signature_id, max(n) AS n, sum(0.1::DOUBLE * pow(0.9::DOUBLE, n - 1 - i) * a) AS s FROM f GROUP BY 1)
SELECT signature_id, pow(0.9::DOUBLE, coalesce(n, 0)) * prediction_accuracy + coalesce(s, 0) AS prediction_accuracy, usage_count + coalesce(n, 0) AS usage_count FROM ({LIB_SQL}) LEFT JOIN g USING (signature_id)""", 6, "prediction_accuracy")
def _(spark, d):
    feedback = table(spark, d, "events").select(F.col("user_id").alias("signature_id"), "ts", "event_id", ((F.col("event_id") % 101) / 100.0).alias("accuracy"))
    lib = library(spark, d).select("signature_id", "prediction_accuracy", "usage_count")
    return O.accuracy_feedback(lib, feedback, ["ts", "event_id"])


@query("library_stats", f"""SELECT count(*) AS signatures, avg(s) AS mean, stddev_pop(s) AS std, min(s) AS min, max(s) AS max, avg((s < 65)::INT) AS collapse_rate, count(DISTINCT cluster_id) AS clusters,
 count(*) / count(DISTINCT cluster_id) AS avg_cluster_size, quantile_cont(s, 0.5) AS median FROM (SELECT *, collapse_score::DOUBLE AS s FROM ({LIB_SQL}))""", 5, "mean std min max collapse_rate avg_cluster_size median")
def _(spark, d):
    return O.library_stats(library(spark, d))


@query("prescreen_similarity", f"""WITH b AS (SELECT query_id, max(similarity) AS t FROM ({MATCH_SQL}) GROUP BY 1)
SELECT query_id, risk AS risk_score, CASE WHEN t IS NULL THEN true WHEN t > 0.9 THEN false ELSE risk < 70 END AS should_proceed FROM (
 SELECT vec_id AS query_id, t, CASE WHEN t IS NULL THEN 10 WHEN t > 0.9 THEN 85 ELSE trunc(t * 100)::INT END AS risk FROM embeddings LEFT JOIN b ON vec_id = query_id)""")
def _(spark, d):
    return O.prescreen(queries_side(spark, d), matches(spark, d))


@query("prescreen_count", f"""WITH b AS (SELECT query_id, count(*) AS n FROM ({MATCH_SQL}) GROUP BY 1)
SELECT query_id, risk AS risk_score, risk < 75 AS should_proceed FROM (SELECT vec_id AS query_id, CASE WHEN n IS NULL THEN 25 ELSE least(50, 10 * n)::INT END AS risk FROM embeddings LEFT JOIN b ON vec_id = query_id)""")
def _(spark, d):
    return O.prescreen(queries_side(spark, d), matches(spark, d), "count")
