"""A library of collapse signatures: vectors, matching, explanation, upkeep."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import melt, numeric_columns
from .ordered import quantiles, with_row_index
from .products import best_products
from .rollup import THRESHOLDS
from .sampling import random_cap
from .sigindex import MEMBERS, PAIRS, SignatureIndex, pairs_of, temporary_index

# Layout of the raw vector and the limits of the matching rules.
DIMENSIONS = list(THRESHOLDS)
STATISTICS = ["mean", "std", "min", "max", "median", "q25", "q75"]
SLOTS = 8
RAW_LENGTH = 128
FAILED_BELOW = 65.0
MATCH_THRESHOLD = 0.7
TOP_K = 10
EXACT_BELOW = 1_000
HYBRID_BELOW = 10_000
SIMILAR_WITHIN = 15.0
MISSING_CURRENT = 75.0
EMA_ALPHA = 0.1

# A library of more vectors than this comes in cells around pivots; library rows of one product and queries of one task.
LOCAL_ROWS = 20_000
PIVOTS = 128
LIBRARY_BLOCK = 4_096
QUERY_BLOCK = 65_536


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def scaled_to_unit(v: Column) -> Column:
    """Divide by the norm. The one-element array binds the vector once; a plain expression would be worked out
    again for every place it is used, and the norm again for every element."""

    def scale(x: Column) -> Column:
        return F.zip_with(x, F.array_repeat(norm(x) + 1e-10, F.size(x)), lambda a, n: a / n)

    return F.element_at(F.transform(F.array(v), scale), 1)


def unit(v: Column) -> Column:
    """L2-normalised vector of doubles."""
    return scaled_to_unit(v.cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def signature_vector(df: DataFrame, scores: str = "dimension_scores", stats: str = "stats", out: str = "vector") -> DataFrame:
    """Raw features from a scores map, a map of statistic arrays, skewness and kurtosis: 128 slots, unit length.

    A missing dimension counts 50; every statistic owns eight slots whether present or not. Slot i holds the mean over the
    columns i, i + 8, i + 16, ..., so up to eight columns stand for themselves and every further one counts as well.
    """

    def folded(values: Column) -> Column:
        def slot(i: Column) -> Column:
            own = F.filter(values, lambda x, at: at % SLOTS == i)
            return F.when(F.size(own) == 0, 0.0).otherwise(F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.size(own))

        return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), slot)

    names = F.array(*[F.lit(d) for d in DIMENSIONS])
    parts = [F.transform(names, lambda d: F.coalesce(F.try_element_at(scores, d), F.lit(50.0)) / 100.0)]
    for s in STATISTICS:
        values = F.coalesce(F.try_element_at(stats, F.lit(s)), F.array().cast("array<double>"))
        parts.append(folded(values))
    parts.append(F.array(F.coalesce(F.col("skewness"), F.lit(0.0)), F.coalesce(F.col("kurtosis"), F.lit(0.0))))
    used = len(DIMENSIONS) + len(STATISTICS) * SLOTS + 2
    parts.append(F.array_repeat(F.lit(0.0), RAW_LENGTH - used))
    return df.withColumn(out, scaled_to_unit(F.concat(*parts)))


def simple_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean, population std, min and max over all cells of the numeric columns."""
    cols = numeric_columns(df, cols)
    cells = melt(df, [], {c: {"value": F.col(c).cast("double")} for c in cols})
    return cells.agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def signature_id(dataset_id: Column, vector: Column) -> Column:
    """16 hex digits from the dataset id and the leading components."""
    head = F.array_join(F.transform(F.slice(vector, 1, 4), lambda x: F.format_string("%.4f", x.cast("double"))), ",")
    return F.substring(F.sha2(F.concat_ws("_", dataset_id.cast("string"), head), 256), 1, 16)


# --- search ---------------------------------------------------------------------------------------------


def choose_strategy(size: int) -> str:
    if size < EXACT_BELOW:
        return "exact"
    return "hybrid" if size < HYBRID_BELOW else "approximate"


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def _rank(candidates: DataFrame, k: int) -> DataFrame:
    """Final k per query; a query brings at most k rows per block it visited."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "signature_id")
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def match_exact(
    queries: DataFrame, library: DataFrame, k: int = TOP_K, threshold: float = MATCH_THRESHOLD, exclude_self: bool = False
) -> DataFrame:
    """Top k cosine matches at or above the threshold: query_id, signature_id, similarity, rank.

    Inputs have unit vectors in ``vector``. Queries are dealt to tasks and multiplied with the library block by block. A library
    beyond a checked size comes in cells around sampled pivots, and the triangle inequality on angles tells which cells can hold
    a match, so the result is the same. In many dimensions nearly every cell can, so exact search of a whole large library in
    itself compares nearly all pairs: its time grows with the square, what it holds and writes does not.
    """
    if library.limit(LOCAL_ROWS + 1).count() <= LOCAL_ROWS:
        return _rank(best_products(queries, library, k, threshold, exclude_self, None, LIBRARY_BLOCK, QUERY_BLOCK), k)
    return _rank(_cell_search(queries, library, k, threshold, exclude_self), k)


def match_approx(
    queries: DataFrame, library: DataFrame | SignatureIndex, k: int = TOP_K, threshold: float = MATCH_THRESHOLD,
    probes: int = 8, exclude_self: bool = False,
) -> DataFrame:
    """Approximate matches from hash tables of random projections; ``library`` is a stored index, or is indexed first.

    So many queries that the tables would make more pairs than ``sigindex.PAIRS`` are multiplied with the library in blocks
    instead, which finds every match and writes no pairs; a library is then not indexed at all.
    """
    if isinstance(library, SignatureIndex):
        return library.search(queries, k, threshold, exclude_self)
    if k < MEMBERS and pairs_of(queries.count(), library.count(), probes) > PAIRS:
        return _rank(best_products(queries, library, k, threshold, exclude_self), k)
    return temporary_index(library, probes).search(queries, k, threshold, exclude_self)


def match_hybrid(
    queries: DataFrame, library: DataFrame | SignatureIndex, k: int = TOP_K, threshold: float = MATCH_THRESHOLD,
    probes: int = 8, exclude_self: bool = False,
) -> DataFrame:
    """The k best of 3k approximate candidates at or above the threshold."""
    near = match_approx(queries, library, min(3 * k, MEMBERS - 1), 0.0, probes, exclude_self)
    return near.filter((F.col("rank") <= k) & (F.col("similarity") >= threshold))


def _cell_search(queries, library, k, threshold, exclude_self):
    pivots = _stack(random_cap(library.select("signature_id", "vector").filter("vector IS NOT NULL"), PIVOTS, ["signature_id"]).toPandas()["vector"])
    return best_products(queries, library, k, threshold, exclude_self, pivots if len(pivots) else None, LIBRARY_BLOCK, QUERY_BLOCK)


# --- reading a match ------------------------------------------------------------------------------------


def dimension_alignment(historic: Column, current: Column) -> Column:
    """Agreement of two score maps: 1 both failing, 0.8 both passing, 0.3 otherwise; 0.5 without common dimensions."""
    common = F.array_intersect(F.map_keys(historic), F.map_keys(current))

    def one(d: Column) -> Column:
        h, c = F.try_element_at(historic, d), F.try_element_at(current, d)
        return F.when((h < FAILED_BELOW) & (c < FAILED_BELOW), 1.0).when((h >= FAILED_BELOW) & (c >= FAILED_BELOW), 0.8).otherwise(0.3)

    total = F.aggregate(F.transform(common, one), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(common) > 0, total / F.size(common)).otherwise(0.5)


def match_confidence(similarity: Column, accuracy: Column, uses: Column, alignment: Column) -> Column:
    accurate = F.when(accuracy > 0, accuracy * 100.0).otherwise(80.0)
    used = 70.0 + 30.0 * F.least(F.lit(1.0), uses / 10.0)
    return F.least(F.lit(100.0), 0.4 * 100.0 * similarity + 0.3 * accurate + 0.15 * used + 0.15 * 100.0 * alignment)


def match_uncertainty(similarity: Column, uses: Column, anomaly: Column) -> Column:
    return F.least(F.lit(100.0), 50.0 * (1.0 - similarity) + F.greatest(F.lit(0.0), 30.0 - 3.0 * uses) + 20.0 * anomaly)


def match_risk(collapse_score: Column, confidence: Column) -> Column:
    return (
        F.when((collapse_score < 30) & (confidence > 70), "CRITICAL")
        .when((collapse_score < 50) & (confidence > 60), "HIGH")
        .when((collapse_score < 65) & (confidence > 50), "MEDIUM")
        .otherwise("LOW")
    )


def assess_matches(matches: DataFrame, library: DataFrame, current: DataFrame) -> DataFrame:
    """Confidence, uncertainty and risk of every match.

    ``library``: signature_id, collapse_score, prediction_accuracy, usage_count, anomaly_score, dimension_scores;
    ``current``: query_id, current_scores.
    """
    joined = matches.join(library, "signature_id").join(current, "query_id")
    align = dimension_alignment(F.col("dimension_scores"), F.col("current_scores"))
    out = joined.withColumn("alignment", align)
    out = out.withColumn("confidence", match_confidence(F.col("similarity"), F.col("prediction_accuracy"), F.col("usage_count"), F.col("alignment")))
    out = out.withColumn("uncertainty", match_uncertainty(F.col("similarity"), F.col("usage_count"), F.col("anomaly_score")))
    return out.withColumn("risk", match_risk(F.col("collapse_score"), F.col("confidence")))


def explain_match(assessed: DataFrame) -> DataFrame:
    """One row per match and historic dimension: both scores, difference, and whether they agree within 15 points."""
    rows = assessed.select("query_id", "signature_id", "current_scores", F.explode("dimension_scores").alias("dimension", "historical_score"))
    now = F.coalesce(F.try_element_at("current_scores", F.col("dimension")), F.lit(MISSING_CURRENT))
    gap = F.abs(F.col("historical_score") - now)
    return rows.select(
        "query_id", "signature_id", "dimension", "historical_score", now.alias("current_score"), gap.alias("difference"),
        (gap < SIMILAR_WITHIN).alias("matching"),
    )


def match_insights(assessed: DataFrame) -> DataFrame:
    """Key observations per match: many agreeing dimensions, severe history, well-used pattern.

    Rows of one (query, signature) count the agreeing dimensions of all of them; a match without a historic dimension gives no row.
    """

    def agrees(e: Column) -> Column:
        now = F.coalesce(F.try_element_at("current_scores", e["key"]), F.lit(MISSING_CURRENT))
        return F.abs(e["value"] - now) < SIMILAR_WITHIN

    same = Window.partitionBy("query_id", "signature_id")
    agree = F.size(F.filter(F.map_entries("dimension_scores"), agrees))
    facts = assessed.filter("query_id IS NOT NULL AND signature_id IS NOT NULL").select(
        "query_id", "signature_id", "collapse_score", "usage_count",
        F.sum(F.when(F.size("dimension_scores") > 0, agree).cast("long")).over(same).alias("matching_dimensions"),
    ).filter("matching_dimensions IS NOT NULL")
    return facts.select(
        "query_id", "signature_id", "matching_dimensions",
        (F.col("matching_dimensions") > 4).alias("strong_match"),
        (F.col("collapse_score") < 50).alias("severe_history"),
        (F.col("usage_count") > 5).alias("well_validated"),
    )


def top_failures(signatures: DataFrame, n: int = 3) -> DataFrame:
    """Lowest failing dimension scores of every signature; a signature has at most eight dimensions."""
    rows = signatures.select("signature_id", F.explode("dimension_scores").alias("dimension", "score")).filter(F.col("score") < FAILED_BELOW)
    w = Window.partitionBy("signature_id").orderBy("score", "dimension")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def match_advice(assessed: DataFrame) -> DataFrame:
    """At most five rows per match: the three worst historic failures, and regeneration when all signs point to it."""
    failed = F.filter(F.map_entries("dimension_scores"), lambda e: e["value"] < FAILED_BELOW)
    worst = F.slice(F.array_sort(F.transform(failed, lambda e: F.struct(e["value"].alias("s"), e["key"].alias("d")))), 1, 3)

    def advice(e: Column) -> Column:
        now = F.coalesce(F.try_element_at("current_scores", e["d"]), F.lit(MISSING_CURRENT))
        return F.struct(e["d"].alias("dimension"), F.when(now < FAILED_BELOW, "immediate_attention").otherwise("monitor").alias("advice"))

    values = F.map_values("current_scores")
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    again = (F.col("collapse_score") < 40) & (F.size("current_scores") > 0) & (mean < 60)
    regenerate = F.array(F.struct(F.lit(None).cast("string").alias("dimension"), F.lit("regenerate").alias("advice")))
    none = F.array().cast("array<struct<dimension:string,advice:string>>")
    # one list per match, so the matches are found once
    listed = F.concat(F.coalesce(F.transform(worst, advice), none), F.when(again, regenerate).otherwise(none))
    return assessed.select("query_id", "signature_id", F.inline(listed))


# --- upkeep ---------------------------------------------------------------------------------------------


def cluster_signatures(library: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """K-means cluster, one of ``k`` (at least 2), of every signature and its distance to the centre."""
    if library.isEmpty():
        return library.select("signature_id", F.lit(-1).alias("cluster_id"), F.lit(0.0).alias("anomaly_score"))
    ready = library.select("signature_id", "vector", array_to_vector("vector").alias("features"))
    model = KMeans(k=k, maxIter=20, seed=seed).fit(ready)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    placed = model.transform(ready).withColumn("_c", F.element_at(centres, F.col("prediction") + 1))
    gap = F.zip_with("vector", "_c", lambda a, b: a - b)
    return placed.select("signature_id", F.col("prediction").alias("cluster_id"), norm(gap).alias("anomaly_score"))


def upsert_signatures(library: DataFrame, incoming: DataFrame) -> DataFrame:
    """New snapshot: known ids take the new score and count one more use, unknown ids are added."""
    new = incoming.select("signature_id", F.col("collapse_score").alias("_score"), F.lit(True).alias("_new"))
    both = library.join(new, "signature_id", "full_outer")
    known = F.col("usage_count").isNotNull()
    return both.select(
        "signature_id",
        F.coalesce("_score", "collapse_score").alias("collapse_score"),
        F.when(known, F.col("usage_count") + F.when(F.col("_new"), 1).otherwise(0)).otherwise(0).alias("usage_count"),
        F.coalesce("prediction_accuracy", F.lit(0.0)).alias("prediction_accuracy"),
    )


def accuracy_feedback(library: DataFrame, feedback: DataFrame, order_cols: Sequence[str], alpha: float = EMA_ALPHA) -> DataFrame:
    """Exponential moving average of ordered feedback per signature, and one use per feedback.

    The average after n steps is a weighted sum with weights known from the position, so any amount of
    feedback for one signature is a distributed aggregate.
    """
    indexed = with_row_index(feedback.select("signature_id", *order_cols, "accuracy"), order_cols, "_i", ["signature_id"])
    # weights relative to the newest position: position i of n weighs alpha (1 - alpha)^(n - 1 - i)
    totals = feedback.groupBy("signature_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = indexed.join(totals, "signature_id")
    weight = alpha * F.pow(F.lit(1.0 - alpha), F.col("_n") - 1 - F.col("_i"))
    folded = joined.groupBy("signature_id").agg(F.sum(weight * F.col("accuracy")).alias("_sum"), F.first("_n").alias("_n"))
    out = library.join(folded, "signature_id", "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    fresh = F.pow(F.lit(1.0 - alpha), n) * F.col("prediction_accuracy") + F.coalesce("_sum", F.lit(0.0))
    return out.withColumn("prediction_accuracy", fresh).withColumn("usage_count", F.col("usage_count") + n).drop("_sum", "_n")


def library_stats(library: DataFrame) -> DataFrame:
    """Count, spread and median of the collapse scores, share of failures, clusters and their mean size."""
    s = F.col("collapse_score")
    clusters = F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id")))
    base = library.agg(
        F.count(F.lit(1)).alias("signatures"),
        F.avg(s).alias("mean"),
        F.stddev_pop(s).alias("std"),
        F.min(s).alias("min"),
        F.max(s).alias("max"),
        F.avg((s < FAILED_BELOW).cast("double")).alias("collapse_rate"),
        clusters.alias("clusters"),
        (F.count(F.lit(1)) / F.greatest(F.lit(1), clusters)).alias("avg_cluster_size"),
    )
    median = quantiles(library, ["collapse_score"], {"median": 0.5}).select("median")
    return base.crossJoin(F.broadcast(median))  # one row each


def prescreen(queries: DataFrame, matches: DataFrame, mode: str = "similarity") -> DataFrame:
    """Risk before the full validation, from the best similarity or from the number of matches."""
    best = matches.groupBy("query_id").agg(F.max("similarity").alias("_top"), F.count(F.lit(1)).alias("_n"))
    out = queries.select("query_id").join(best, "query_id", "left")
    if mode == "similarity":
        risk = F.when(F.col("_top").isNull(), 10).when(F.col("_top") > 0.9, 85).otherwise((F.col("_top") * 100).cast("int"))
        go = F.when(F.col("_top").isNull(), True).when(F.col("_top") > 0.9, False).otherwise(F.col("risk_score") < 70)
    elif mode == "count":
        risk = F.when(F.col("_n").isNull(), 25).otherwise(F.least(F.lit(50), 10 * F.col("_n"))).cast("int")
        go = F.col("risk_score") < 75
    else:
        raise ValueError(f"unknown mode {mode}")
    return out.withColumn("risk_score", risk).withColumn("should_proceed", go).select("query_id", "risk_score", "should_proceed")
