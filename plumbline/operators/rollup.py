"""From dimension scores to a verdict. Score tables are long: (validation_id, dimension, score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import clamp

KEY = "validation_id"

# The eight dimensions with the score each must reach, and the overall limits.
THRESHOLDS = {
    "distribution_fidelity": 70.0,
    "correlation_preservation": 70.0,
    "entropy_stability": 65.0,
    "gradient_health": 60.0,
    "loss_landscape": 65.0,
    "spectral_coherence": 70.0,
    "generalization_gap": 75.0,
    "statistical_consistency": 70.0,
}
DEFAULT_THRESHOLD = 70.0
OVERALL_THRESHOLD = 65.0
DIVERSITY_THRESHOLD = 50.0
CRITICAL_SCORE = 40.0
WARNING_SHARE = 0.8

# Names of the six dimensions of the public view and where each comes from.
API_DIMENSIONS = {
    "distribution_fidelity": "distribution_fidelity",
    "correlation_preservation": "correlation_preservation",
    "rare_pattern_handling": "statistical_consistency",
    "temporal_stability": "entropy_stability",
    "semantic_coherence": "spectral_coherence",
}

# Collapse types by the dimension that fails worst.
COLLAPSE_TYPES = {
    "distribution_fidelity": "type_a_distribution",
    "entropy_stability": "type_a_distribution",
    "correlation_preservation": "type_b_correlation",
    "statistical_consistency": "type_c_rare_pattern",
    "loss_landscape": "type_d_temporal",
    "gradient_health": "type_d_temporal",
    "spectral_coherence": "type_e_semantic",
    "generalization_gap": "type_e_semantic",
}


def lookup(values: dict, key: Column, default) -> Column:
    """Literal map as a CASE expression."""
    out = F.lit(default)
    for k, v in reversed(values.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def threshold_of(dimension: Column) -> Column:
    return lookup(THRESHOLDS, dimension, DEFAULT_THRESHOLD)


def severity(score: Column, threshold: Column) -> Column:
    return F.when(score >= threshold, "ok").when(score >= threshold * WARNING_SHARE, "warning").otherwise("critical")


def fill_neutral(scores: DataFrame, dimensions: Sequence[str] = tuple(THRESHOLDS)) -> DataFrame:
    """One row per validation and dimension; a dimension without data sits exactly at its threshold.

    The scores of a validation are at most eight, so they are gathered in a map and no join is needed.
    """
    gathered = scores.groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("dimension", "score"))).alias("_m"))
    names = F.array(*[F.lit(d) for d in dimensions])
    rows = gathered.select(KEY, "_m", F.explode(names).alias("dimension"))
    own = F.try_element_at("_m", F.col("dimension"))
    limit = threshold_of(F.col("dimension"))
    return rows.select(
        KEY, "dimension", F.coalesce(own, limit).alias("score"), limit.alias("threshold"), own.isNull().alias("neutral")
    )


def with_severity(scores: DataFrame) -> DataFrame:
    limit = threshold_of(F.col("dimension"))
    return (
        scores.withColumn("threshold", limit)
        .withColumn("passed", F.col("score") >= limit)
        .withColumn("severity", severity(F.col("score"), limit))
    )


def overall_score(scores: DataFrame) -> DataFrame:
    """Mean score, collapse flag and the confidence from how much the dimensions agree."""
    mean = F.avg("score")
    return scores.groupBy(KEY).agg(
        mean.alias("overall_score"),
        (mean < OVERALL_THRESHOLD).alias("collapse_detected"),
        F.least(F.lit(100.0), 100.0 * F.exp(-F.var_pop("score") / 1000.0)).alias("confidence"),
    )


def warnings(scores: DataFrame) -> DataFrame:
    """Rows (validation_id, level, dimension, score): collapse, critical and warning dimensions, or all-passed."""
    graded = with_severity(scores)
    bad = graded.filter(F.col("severity") != "ok").select(KEY, F.col("severity").alias("level"), "dimension", "score")
    per = graded.groupBy(KEY).agg(F.avg("score").alias("score"), F.count_if(F.col("severity") != "ok").alias("_bad"))
    whole = F.lit(None).cast("string").alias("dimension")
    collapsed = per.filter(F.col("score") < OVERALL_THRESHOLD).select(KEY, F.lit("collapse").alias("level"), whole, "score")
    fine = per.filter((F.col("score") >= OVERALL_THRESHOLD) & (F.col("_bad") == 0)).select(
        KEY, F.lit("all_passed").alias("level"), whole, "score"
    )
    return bad.unionByName(collapsed).unionByName(fine)


def scale_predictions(scores: DataFrame) -> DataFrame:
    """Expected score at ten and a hundred times the data: x0.95 per step."""
    steps = F.array(
        F.struct(F.lit("10x").alias("scale"), (F.col("score") * 0.95).alias("predicted_score")),
        F.struct(F.lit("100x").alias("scale"), (F.col("score") * 0.95 * 0.95).alias("predicted_score")),
    )
    return scores.select(KEY, "dimension", F.inline(steps))


def api_view(scores: DataFrame, diversity: DataFrame) -> DataFrame:
    """Public result row: inverse risk score, level, six dimensions, eligibility."""
    part = {n: F.coalesce(F.max(F.when(F.col("dimension") == src, F.col("score"))), F.lit(0.0)) for n, src in API_DIMENSIONS.items()}
    wide = scores.groupBy(KEY).agg(
        (100.0 - F.avg("score")).cast("int").alias("risk_score"), *[c.cast("int").alias(n) for n, c in part.items()]
    )
    out = wide.join(diversity.select(KEY, F.col("diversity_score").cast("int").alias("diversity_retention")), KEY)
    risk = F.col("risk_score")
    return out.withColumn("risk_level", F.when(risk < 25, "low").when(risk < 60, "medium").otherwise("high")).withColumn(
        "warranty_eligible", risk < 25
    )


def decide(scores: DataFrame, diversity: DataFrame, critical: Sequence[str] = tuple(THRESHOLDS)) -> DataFrame:
    """Approve or reject with the reasons and the confidence in the decision."""
    weak = F.when(F.col("dimension").isin(list(critical)) & (F.col("score") < CRITICAL_SCORE), F.struct("dimension", "score"))
    per = scores.groupBy(KEY).agg(F.avg("score").alias("overall_score"), F.array_sort(F.collect_list(weak)).alias("_weak"))
    both = per.join(diversity.select(KEY, "diversity_score"), KEY)
    s, v = F.col("overall_score"), F.col("diversity_score")
    reasons = F.array_compact(F.concat(
        F.array(
            F.when(s < OVERALL_THRESHOLD, F.lit("collapse score below threshold")),
            F.when(v < DIVERSITY_THRESHOLD, F.lit("diversity score below threshold")),
        ),
        F.transform("_weak", lambda w: F.concat(F.lit("critical dimension "), w["dimension"])),
    ))
    ok = F.size("_reasons") == 0
    margin = F.least(s - OVERALL_THRESHOLD, v - DIVERSITY_THRESHOLD)
    worst = F.greatest(OVERALL_THRESHOLD - s, DIVERSITY_THRESHOLD - v, F.lit(0.0))
    confidence = F.when(ok, F.least(F.lit(95.0), 75.0 + margin)).otherwise(F.greatest(F.lit(50.0), 90.0 - worst))
    reason = F.when(ok, "all quality metrics passed").otherwise(F.concat_ws("; ", "_reasons"))
    return both.withColumn("_reasons", reasons).select(
        KEY, "overall_score", "diversity_score", ok.alias("approved"), confidence.alias("confidence"), reason.alias("reason")
    )


def predicted_performance(overall: DataFrame) -> DataFrame:
    s = F.col("overall_score") / 100.0
    return overall.select(
        KEY,
        (0.85 + s * 0.1).alias("accuracy"),
        (0.82 + s * 0.08).alias("accuracy_low"),
        (0.88 + s * 0.12).alias("accuracy_high"),
        clamp((100.0 - F.col("overall_score")) / 100.0, 0.0, 1.0).alias("collapse_probability"),
    )


def collapse_type(scores: DataFrame) -> DataFrame:
    """Category of the dimension furthest below its threshold; ``none`` if all pass."""
    gap = F.col("score") - threshold_of(F.col("dimension"))
    worst = scores.groupBy(KEY).agg(F.min(F.struct(gap.alias("gap"), F.col("dimension").alias("dimension"))).alias("_w"))
    kind = F.when(F.col("_w.gap") >= 0, "none").otherwise(lookup(COLLAPSE_TYPES, F.col("_w.dimension"), "none"))
    return worst.select(KEY, F.when(F.col("_w.gap") < 0, F.col("_w.dimension")).alias("worst_dimension"), kind.alias("collapse_type"))


def consensus(results: DataFrame, weights: dict[int, float]) -> DataFrame:
    """Tier-weighted share of runs that collapsed, and the risk band (above 70 % is high)."""
    w = lookup(weights, F.col("tier"), 1.0)
    share = F.sum(F.when(F.col("collapse_detected"), w).otherwise(0.0)) / F.sum(w)
    out = results.groupBy(KEY).agg(F.count(F.lit(1)).alias("models"), share.alias("collapsed_share"))
    return out.withColumn(
        "risk", F.when(F.col("collapsed_share") > 0.7, "high").when(F.col("collapsed_share") > 0.2, "medium").otherwise("low")
    )


# Sizes the scaling law is extrapolated to, and the runs it needs.
TARGET_SIZES = [1e9, 1e10, 1e11]
MIN_RUNS = 15


def scaling_law(results: DataFrame, sizes: Sequence[float] = tuple(TARGET_SIZES), grid: int = 40, min_runs: int = MIN_RUNS) -> DataFrame:
    """Fit performance = A size^B + C per validation over a grid of C below the worst run; best r^2 wins.

    For a given C the fit is a straight line in logs, so all grid points of all validations are one grouped
    aggregate. The grid multiplies rows by a constant.
    """
    low = results.groupBy(KEY).agg(F.min("performance").alias("_min"), F.max("performance").alias("_max"), F.count(F.lit(1)).alias("runs"))
    fit_for = low.filter((F.col("runs") >= min_runs) & (F.col("_max") > F.col("_min")))
    span = F.col("_max") - F.col("_min")
    # offsets from just under the worst run down to three spans below it
    offset = F.transform(F.sequence(F.lit(1), F.lit(grid)), lambda g: F.col("_min") - F.col("_span") * 3.0 * g / float(grid))
    ranges = fit_for.select(KEY, "runs", "_min", span.alias("_span"))
    points = results.select(KEY, "model_size", "performance").join(ranges, KEY).select(KEY, "runs", "model_size", "performance", F.explode(offset).alias("c"))
    x, y = F.ln("model_size"), F.ln(F.col("performance") - F.col("c"))
    fits = points.groupBy(KEY, "runs", "c").agg(
        F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("_log_a"), F.regr_r2(y, x).alias("r2")
    )
    best = fits.groupBy(KEY, "runs").agg(F.max_by(F.struct("c", "b", "_log_a", "r2"), F.struct("r2", "c")).alias("_f"))
    a = F.exp(F.col("_f._log_a"))
    rows = F.array(*[
        F.struct(F.lit(float(s)).alias("target_size"), (a * F.pow(F.lit(float(s)), F.col("_f.b")) + F.col("_f.c")).alias("predicted"))
        for s in sizes
    ])
    return best.select(KEY, "runs", a.alias("a"), F.col("_f.b").alias("b"), F.col("_f.c").alias("c"), F.col("_f.r2").alias("r2"), F.inline(rows))


def prediction_error(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """Actual against predicted accuracy: error per validation and whether it fell inside the interval."""
    both = predicted.join(actual, KEY)
    return both.select(
        KEY,
        (F.col("accuracy") - F.col("actual")).alias("error"),
        F.col("actual").between(F.col("accuracy_low"), F.col("accuracy_high")).alias("inside"),
    )


def prediction_bias(errors: DataFrame) -> DataFrame:
    return errors.agg(
        F.count(F.lit(1)).alias("validations"),
        F.avg("error").alias("bias"),
        F.avg(F.abs("error")).alias("mean_abs_error"),
        F.avg(F.col("inside").cast("double")).alias("inside_share"),
    )
