"""Ordered operators over series, loss curves and training telemetry.

A series may hold any share of the rows: positions come from bucketed scans, neighbours from equi-joins on
(series, position), and everything else is a grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .common import lookup_join, safe_corr
from .ordered import with_previous, with_row_index

NEUTRAL_LOSS_SCORE = 65.0
NEUTRAL_GRADIENT_SCORE = 100.0


def window_means(series: DataFrame, key: str, order_cols: Sequence[str], value: str, size: int = 10) -> DataFrame:
    """Means of consecutive full windows; a series shorter than one window is returned unchanged."""
    indexed = with_row_index(series.select(key, *order_cols, value), order_cols, "_i", [key])
    lengths = series.groupBy(key).agg(F.count(F.lit(1)).alias("_len"))
    placed = lookup_join(indexed, lengths, [key])
    step = F.when(F.col("_len") < size, F.lit(1)).otherwise(F.lit(size))
    groups = placed.groupBy(key, F.floor(F.col("_i") / step).cast("long").alias("window"), step.alias("_step"))
    return groups.agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") == F.col("_step")
    ).drop("_n", "_step")


def _curve(curves: DataFrame, key: str, step: str, loss: str) -> DataFrame:
    """Position, previous loss and curve length for every point."""
    base = curves.select(key, F.col(step).alias("_step"), F.col(loss).cast("double").alias("_loss"))
    indexed = with_row_index(base, ["_step"], "_i", [key])
    linked = with_previous(indexed, [key], "_i", "_loss", "_prev")
    return lookup_join(linked, base.groupBy(key).agg(F.count(F.lit(1)).alias("_len")), [key])


def loss_landscape(curves: DataFrame, key: str = "run", step: str = "epoch", loss: str = "train_loss") -> DataFrame:
    """Decrease, smoothness and tail stability of every loss curve, 0.4 / 0.3 / 0.3; short curves are neutral."""
    points = _curve(curves, key, step, loss)
    delta = F.col("_loss") - F.col("_prev")
    in_tail = F.col("_i") >= F.col("_len") - F.ceil(F.col("_len") / 10)
    tail = F.when(in_tail, F.col("_loss"))
    agg = points.groupBy(key).agg(
        F.count(F.lit(1)).alias("epochs"),
        (F.min_by("_loss", "_i") - F.max_by("_loss", "_i")).alias("loss_decrease"),
        F.stddev_pop(delta).alias("_sd"),
        F.avg(F.abs(delta)).alias("_md"),
        F.stddev_pop(tail).alias("_st"),
        F.avg(tail).alias("_mt"),
    )
    decrease = F.least(F.lit(100.0), F.col("loss_decrease") * 100.0)
    smooth = 100.0 * (1.0 - F.least(F.lit(1.0), F.col("_sd") / (F.col("_md") + 1e-8)))
    stable = F.least(F.lit(100.0), 100.0 * (1.0 - F.col("_st") / (F.col("_mt") + 1e-8)))
    short = F.col("epochs") < 10
    return agg.select(
        key,
        "epochs",
        F.when(~short, decrease).alias("decrease_score"),
        F.when(~short, smooth).alias("smoothness"),
        F.when(~short, stable).alias("stability"),
        F.when(short, NEUTRAL_LOSS_SCORE).otherwise(0.4 * decrease + 0.3 * smooth + 0.3 * stable).alias("score"),
    )


def training_collapse(results: DataFrame, curves: DataFrame, key: str = "run", step: str = "epoch", loss: str = "train_loss") -> DataFrame:
    """Collapse signals per run: unstable last five losses, low spectral entropy, concentrated spectrum."""
    points = _curve(curves, key, step, loss)
    last = F.when(F.col("_i") >= F.col("_len") - 5, F.col("_loss"))
    tails = points.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.var_pop(last).alias("tail_variance"))
    joined = results.join(tails, key, "left")
    unstable = F.coalesce((F.col("_n") > 3) & (F.col("tail_variance") > 1.0), F.lit(False))
    signal = unstable | (F.col("spectral_entropy") < 2.0) | (F.col("frequency_concentration") > 100.0)
    return joined.select(key, "tail_variance", signal.alias("collapse_detected"))


def gradient_health(grads: DataFrame, runs: DataFrame | None = None, key: str = "run", norm: str = "grad_norm") -> DataFrame:
    """Vanishing and exploding checks of the mean gradient norm; runs without gradients score 100."""
    agg = grads.groupBy(key).agg(F.avg(norm).alias("mean_norm"), F.stddev_pop(norm).alias("std_norm"))
    if runs is not None:
        agg = runs.select(key).distinct().join(agg, key, "left")
    m = F.col("mean_norm")
    vanishing = F.when(m > 1e-5, 100.0).otherwise(50.0)
    exploding = F.when(m < 100.0, 100.0).otherwise(50.0)
    return agg.withColumn("score", F.when(m.isNull(), NEUTRAL_GRADIENT_SCORE).otherwise((vanishing + exploding) / 2.0))


def gradient_stats(grads: DataFrame, key: str = "run", norm: str = "grad_norm") -> DataFrame:
    g = F.col(norm)
    return grads.groupBy(key).agg(
        F.sqrt(F.sum(g * g)).alias("total_norm"), F.max(g).alias("max_norm"), F.min(g).alias("min_norm"), (F.max(g) - F.min(g)).alias("norm_range")
    )


def best_model(results: DataFrame, key: str, metric: str, tiebreak: str, model: str) -> DataFrame:
    """Model with the highest metric per key; the earliest wins a tie."""
    best = F.max_by(F.struct(F.col(model).alias("m"), F.col(metric).alias("v")), F.struct(F.col(metric), -F.col(tiebreak)))
    return results.groupBy(key).agg(best.alias("_b")).select(key, F.col("_b.m").alias("best_model"), F.col("_b.v").alias("best_metric"))


def batch_spikes(telemetry: DataFrame, key: str, step: Sequence[str], norm: str, loss: str, sigmas: float = 3.0) -> DataFrame:
    """Batches whose gradient norm or loss increase lies more than ``sigmas`` deviations above the run's mean."""
    base = telemetry.select(key, *step, norm, loss)
    linked = with_previous(with_row_index(base, step, "_i", [key]), [key], "_i", loss, "_prev")
    jump = linked.withColumn("loss_jump", F.col(loss) - F.col("_prev")).drop("_prev", "_i")
    limits = jump.groupBy(key).agg(
        (F.avg(norm) + sigmas * F.stddev_samp(norm)).alias("_norm_limit"),
        (F.avg("loss_jump") + sigmas * F.stddev_samp("loss_jump")).alias("_jump_limit"),
    )
    joined = lookup_join(jump, limits, [key])
    high = F.coalesce(F.col(norm) > F.col("_norm_limit"), F.lit(False))
    sudden = F.coalesce(F.col("loss_jump") > F.col("_jump_limit"), F.lit(False))
    return joined.filter(high | sudden).select(key, *step, high.alias("norm_spike"), sudden.alias("loss_spike"))


def trend_seasonality(series: DataFrame, key: str, order_cols: Sequence[str], value: str, lags: Sequence[int] = (1, 7)) -> DataFrame:
    """Slope per position and autocorrelation at chosen lags for every series."""
    indexed = with_row_index(series.select(key, *order_cols, value), order_cols, "_i", [key])
    out = indexed.groupBy(key).agg(F.regr_slope(F.col(value).cast("double"), F.col("_i").cast("double")).alias("slope"))
    for k in lags:
        linked = with_previous(indexed.select(key, "_i", value), [key], "_i", value, "_earlier", k)
        out = out.join(linked.groupBy(key).agg(safe_corr(F.col(value).cast("double"), F.col("_earlier").cast("double")).alias(f"autocorr_{k}")), key)
    return out


def stationarity(series: DataFrame, key: str, order_cols: Sequence[str], value: str) -> DataFrame:
    """Dickey-Fuller t statistic without lagged differences: regression of the change on the previous level."""
    indexed = with_row_index(series.select(key, *order_cols, F.col(value).cast("double").alias("_v")), order_cols, "_i", [key])
    linked = with_previous(indexed.select(key, "_i", "_v"), [key], "_i", "_v", "_prev").filter(F.col("_prev").isNotNull())
    y, x = F.col("_v") - F.col("_prev"), F.col("_prev")
    fit = linked.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.regr_slope(y, x).alias("_b"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy")
    )
    error = F.sqrt(F.try_divide(F.col("_syy") - F.col("_b") * F.col("_b") * F.col("_sxx"), (F.col("_n") - 2) * F.col("_sxx")))
    stat = F.when(F.col("_n") > 2, F.try_divide(F.col("_b"), error))
    # 5 % critical value of the Dickey-Fuller law with a constant, large samples
    return fit.select(key, stat.alias("df_stat"), (stat < -2.86).alias("stationary"))


def ordered_split(df: DataFrame, order_cols: Sequence[str], train_share: float = 0.95) -> DataFrame:
    """First rows in order are ``train``, the rest ``validation``."""
    cut = int(df.count() * train_share)
    return with_row_index(df, order_cols).withColumn("split", F.when(F.col("row_id") < cut, "train").otherwise("validation"))
