"""Distribution comparison of two sides, for any number of dataset pairs at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.special import anderson_darling_sigma, chi2_tail, normal_two_sided
from .common import checked_small, clamp, same_key_join
from .histogram import binned, column_ranges, fill_bins
from .ordered import ranked_values, with_row_index
from .pairs import is_orig, is_syn, pair_columns
from .profile import column_moments

KEY = "validation_id"

# Bins, smoothing, thresholds and weights of the two scores.
HISTOGRAM_BINS = 50
CHI2_BINS = 20
SMOOTH = 1e-10
FIDELITY_THRESHOLD = 70.0
CONSISTENCY_THRESHOLD = 70.0
FIDELITY_WEIGHTS = {
    "ks_similarity": 0.20,
    "wasserstein_similarity": 0.20,
    "mean_match": 0.15,
    "std_match": 0.15,
    "histogram_intersection": 0.15,
    "kl_similarity": 0.15,
}
CONSISTENCY_WEIGHTS = {"chi2_consistency": 0.35, "anderson_darling": 0.35, "mann_whitney": 0.30}


def ecdf_merge(pair: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct values of every column with counts (cs, co), running counts and the next value."""
    cols = list(cols or pair_columns(pair))
    merged = ranked_values(pair, cols, {"cs": is_syn(), "co": is_orig()}, [KEY])
    return merged.withColumnsRenamed({"cum_cs": "cum_s", "cum_co": "cum_o", "tot_cs": "n_s", "tot_co": "n_o"})


def ecdf_summary(merged: DataFrame) -> DataFrame:
    """Everything the rank-based scores need, in one aggregate over the merged values.

    Per (validation, column): KS distance, area between the distribution functions, range of the original,
    Mann-Whitney U of the synthetic side, tie sum, and the midrank Anderson-Darling statistic.
    """
    fs, fo = F.try_divide("cum_s", "n_s"), F.try_divide("cum_o", "n_o")  # NULL for an empty side
    gap = F.abs(fs - fo)
    t = (F.col("cs") + F.col("co")).cast("double")
    n = (F.col("n_s") + F.col("n_o")).cast("double")
    below_o = F.col("cum_o") - F.col("co")
    u = F.col("cs") * (below_o + F.col("co") / 2.0)
    # midrank form: B and M count everything below plus half of the tied values
    b = (F.col("cum_s") + F.col("cum_o")).cast("double") - t / 2.0
    ms = F.col("cum_s") - F.col("cs") / 2.0
    mo = F.col("cum_o") - F.col("co") / 2.0
    spread = b * (n - b) - n * t / 4.0

    def term(m: Column, size: Column) -> Column:
        return F.try_divide(F.when(spread > 0, t / n * (n * m - b * size) ** 2 / spread).otherwise(0.0), size)

    out = merged.groupBy(KEY, "col").agg(
        F.first("n_s").alias("n_s"),
        F.first("n_o").alias("n_o"),
        F.max(gap).alias("ks"),
        F.coalesce(F.sum(gap * (F.col("next_value") - F.col("value"))), F.lit(0.0)).alias("area"),
        (F.max(F.when(F.col("co") > 0, F.col("value"))) - F.min(F.when(F.col("co") > 0, F.col("value")))).alias("range_o"),
        F.sum(u).alias("u_s"),
        F.sum(t * t * t - t).alias("ties"),
        F.sum(term(ms, F.col("n_s")) + term(mo, F.col("n_o"))).alias("_a2"),
    )
    total = (F.col("n_s") + F.col("n_o")).cast("double")
    return out.withColumn("a2", F.col("_a2") * (total - 1) / total).drop("_a2")


def ks_similarity(summary: DataFrame) -> DataFrame:
    return summary.groupBy(KEY).agg(F.avg(100.0 * (1.0 - F.col("ks"))).alias("ks_similarity"))


def wasserstein_similarity(summary: DataFrame) -> DataFrame:
    near = 1.0 - F.least(F.lit(1.0), F.col("area") / (F.col("range_o") + 1e-8))
    return summary.groupBy(KEY).agg((100.0 * F.avg(near)).alias("wasserstein_similarity"))


def moment_match(pair: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """100 exp(-mean |difference|) for column means and for column standard deviations."""
    long = column_moments(pair, cols or pair_columns(pair), [KEY, "side"])
    s, o = F.col("side") == "syn", F.col("side") == "orig"
    both = long.groupBy(KEY, "col").agg(
        *[F.max(F.when(w, F.col(m))).alias(f"{m}_{n}") for m in ("mean", "std") for n, w in (("s", s), ("o", o))]
    )
    return both.groupBy(KEY).agg(
        (100.0 * F.exp(-F.avg(F.abs(F.col("mean_s") - F.col("mean_o"))))).alias("mean_match"),
        (100.0 * F.exp(-F.avg(F.abs(F.col("std_s") - F.col("std_o"))))).alias("std_match"),
    )


def side_histograms(
    pair: DataFrame, bins: int, ranges: str = "syn", cols: Sequence[str] | None = None
) -> DataFrame:
    """Counts of both sides per bin: validation_id, col, bin, cs, co.

    ``ranges``: ``syn`` bins both sides on the synthetic range, ``both`` on the joint range, ``own`` each side on its own.
    """
    cols = list(cols or pair_columns(pair))
    if ranges == "own":
        limits, on = column_ranges(pair, cols, [KEY, "side"]), [KEY, "side"]
    else:
        source = pair.filter(F.col("side") == "syn") if ranges == "syn" else pair
        limits, on = column_ranges(source, cols, [KEY]), [KEY]
    flat = binned(pair, cols, limits, on, bins).select(
        KEY, "side", F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"_bin_{c}").alias("bin")) for c in cols]))
    )
    counts = flat.filter(F.col("bin").isNotNull()).groupBy(KEY, "col", "bin").agg(
        F.sum(is_syn()).alias("cs"), F.sum(is_orig()).alias("co")
    )
    filled = fill_bins(counts.withColumn("n", F.lit(1)).select(KEY, "col", "bin", "n"), [KEY], bins).drop("n")
    return same_key_join(filled, counts, [KEY, "col", "bin"], "left").select(
        KEY, "col", "bin", F.coalesce("cs", F.lit(0)).alias("cs"), F.coalesce("co", F.lit(0)).alias("co")
    )


def with_mass(hist: DataFrame) -> DataFrame:
    """Add the share of each side per bin (ps, po) with the guard against an empty side."""
    totals = hist.groupBy(KEY, "col").agg(F.sum("cs").alias("_ts"), F.sum("co").alias("_to"))
    joined = same_key_join(hist, totals, [KEY, "col"])
    return joined.select(
        KEY, "col", "bin", "cs", "co",
        (F.col("cs") / (F.col("_ts") + SMOOTH)).alias("ps"),
        (F.col("co") / (F.col("_to") + SMOOTH)).alias("po"),
    )


def smoothed(mass: DataFrame) -> DataFrame:
    """Shares plus a small constant, normalised again (qs, qo)."""
    totals = mass.groupBy(KEY, "col").agg(F.sum(F.col("ps") + SMOOTH).alias("_s"), F.sum(F.col("po") + SMOOTH).alias("_o"))
    return same_key_join(mass, totals, [KEY, "col"]).select(
        KEY, "col", "bin", ((F.col("ps") + SMOOTH) / F.col("_s")).alias("qs"), ((F.col("po") + SMOOTH) / F.col("_o")).alias("qo")
    )


def histogram_intersection(hist: DataFrame) -> DataFrame:
    per_col = with_mass(hist).groupBy(KEY, "col").agg(F.sum(F.least("ps", "po")).alias("_x"))
    return per_col.groupBy(KEY).agg((100.0 * F.avg("_x")).alias("histogram_intersection"))


def kl_divergence(hist: DataFrame) -> DataFrame:
    """Mean KL(syn || orig) over columns and its score 100 exp(-mean)."""
    per_col = smoothed(with_mass(hist)).groupBy(KEY, "col").agg(F.sum(F.col("qs") * F.ln(F.col("qs") / F.col("qo"))).alias("_x"))
    return per_col.groupBy(KEY).agg(
        F.avg("_x").alias("kl_divergence"), (100.0 * F.exp(-F.avg("_x"))).alias("kl_similarity")
    )


def js_divergence(hist: DataFrame) -> DataFrame:
    """Mean Jensen-Shannon divergence (nats) over columns."""
    mid = (F.col("qs") + F.col("qo")) / 2.0
    part = 0.5 * F.col("qs") * F.ln(F.col("qs") / mid) + 0.5 * F.col("qo") * F.ln(F.col("qo") / mid)
    per_col = smoothed(with_mass(hist)).groupBy(KEY, "col").agg(F.sum(part).alias("_x"))
    return per_col.groupBy(KEY).agg(F.avg("_x").alias("js_divergence"))


def weighted_score(df: DataFrame, weights: dict[str, float], threshold: float) -> DataFrame:
    score = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    return df.withColumn("score", clamp(score, 0.0, 100.0)).withColumn("passed", F.col("score") >= threshold)


def distribution_fidelity(
    pair: DataFrame, cols: Sequence[str] | None = None, summary: DataFrame | None = None
) -> DataFrame:
    """Six part scores, the weighted score and the verdict per validation."""
    cols = list(cols or pair_columns(pair))
    summary = ecdf_summary(ecdf_merge(pair, cols)) if summary is None else summary
    hist = side_histograms(pair, HISTOGRAM_BINS, "syn", cols)
    ranks = summary.groupBy(KEY).agg(
        F.avg(100.0 * (1.0 - F.col("ks"))).alias("ks_similarity"),
        (100.0 * F.avg(1.0 - F.least(F.lit(1.0), F.col("area") / (F.col("range_o") + 1e-8)))).alias("wasserstein_similarity"),
    )
    shares = smoothed_overlap(hist)
    parts = same_key_join(same_key_join(ranks, moment_match(pair, cols), [KEY]), shares, [KEY])
    return weighted_score(parts, FIDELITY_WEIGHTS, FIDELITY_THRESHOLD)


def smoothed_overlap(hist: DataFrame) -> DataFrame:
    """Histogram intersection and KL similarity from one pass over the bin table."""
    mass = with_mass(hist)
    sums = mass.groupBy(KEY, "col").agg(F.sum(F.col("ps") + SMOOTH).alias("_s"), F.sum(F.col("po") + SMOOTH).alias("_o"))
    both = same_key_join(mass, sums, [KEY, "col"])
    qs, qo = (F.col("ps") + SMOOTH) / F.col("_s"), (F.col("po") + SMOOTH) / F.col("_o")
    per_col = both.groupBy(KEY, "col").agg(F.sum(F.least("ps", "po")).alias("_hi"), F.sum(qs * F.ln(qs / qo)).alias("_kl"))
    return per_col.groupBy(KEY).agg(
        (100.0 * F.avg("_hi")).alias("histogram_intersection"), (100.0 * F.exp(-F.avg("_kl"))).alias("kl_similarity")
    )


# --- statistical consistency ----------------------------------------------------------------------------


def chi2_statistic(pair: DataFrame, cols: Sequence[str] | None = None, shared: bool = False) -> DataFrame:
    """Chi-square of the synthetic bin counts against the original's, per column.

    Each side is binned on its own range unless ``shared``. One is added to every count and the expected
    counts are scaled to the observed total.
    """
    hist = side_histograms(pair, CHI2_BINS, "both" if shared else "own", cols)
    s, o = F.col("cs") + 1.0, F.col("co") + 1.0
    totals = hist.groupBy(KEY, "col").agg(F.sum(s).alias("_s"), F.sum(o).alias("_o"))
    expected = o * F.col("_s") / F.col("_o")  # both totals are at least the number of bins
    return same_key_join(hist, totals, [KEY, "col"]).groupBy(KEY, "col").agg(F.sum((s - expected) ** 2 / expected).alias("chi2"))


def attach_probabilities(stats: DataFrame) -> DataFrame:
    """Add p-values to per-column statistics (chi2, a2, u_s, ties, n_s, n_o).

    The table has one row per validation and column. Up to a checked size the tails are evaluated on the
    driver; a larger table is evaluated in Arrow batches on the executors by the same functions.
    """
    schema = stats.select(KEY, "col").schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    out_schema = f"{fields}, chi2_p double, ad_stat double, mwu_p double"
    local = checked_small(stats, 2_000)
    if local is None:
        def batches(it):
            for pdf in it:
                for name, f in (("chi2_p", _chi2_p), ("ad_stat", _ad_stat), ("mwu_p", _mwu_p)):
                    pdf[name] = [f(r) for r in pdf.to_dict("records")]
                yield pdf[[KEY, "col", "chi2_p", "ad_stat", "mwu_p"]]

        return stats.mapInPandas(batches, out_schema)
    rows = [(r[KEY], r["col"], _chi2_p(r), _ad_stat(r), _mwu_p(r)) for r in local.collect()]
    return stats.sparkSession.createDataFrame(rows, out_schema)


def _chi2_p(r) -> float:
    return chi2_tail(r["chi2"], CHI2_BINS - 1)


def _ad_stat(r) -> float | None:
    n1, n2 = int(r["n_s"]), int(r["n_o"])
    if n1 + n2 < 4 or n1 == 0 or n2 == 0:
        return None
    return (r["a2"] - 1.0) / anderson_darling_sigma(n1, n2)


def _mwu_p(r) -> float:
    n1, n2 = float(r["n_s"]), float(r["n_o"])
    n = n1 + n2
    variance = n1 * n2 / 12.0 * ((n + 1) - r["ties"] / (n * (n - 1)))
    if variance <= 0:
        return 1.0
    u = max(r["u_s"], n1 * n2 - r["u_s"])
    return min(1.0, normal_two_sided(max(0.0, u - n1 * n2 / 2.0 - 0.5) / math.sqrt(variance)))


def statistical_consistency(
    pair: DataFrame, cols: Sequence[str] | None = None, summary: DataFrame | None = None, shared: bool = False
) -> DataFrame:
    """Chi-square, Anderson-Darling and Mann-Whitney agreement, weighted .35 / .35 / .30."""
    summary = ecdf_summary(ecdf_merge(pair, cols)) if summary is None else summary
    stats = same_key_join(summary, chi2_statistic(pair, cols, shared), [KEY, "col"])
    probs = attach_probabilities(stats)
    ad = F.coalesce(100.0 * F.exp(-F.col("ad_stat") / 10.0), F.lit(50.0))
    parts = probs.groupBy(KEY).agg(
        (100.0 * F.avg("chi2_p")).alias("chi2_consistency"),
        F.avg(clamp(ad, 0.0, 100.0)).alias("anderson_darling"),
        (100.0 * F.avg("mwu_p")).alias("mann_whitney"),
    )
    return weighted_score(parts, CONSISTENCY_WEIGHTS, CONSISTENCY_THRESHOLD)


def drift(df: DataFrame, order_cols: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """KS distance per column between the first and the second half of the rows in the given order."""
    extra = [c for c in cols if c not in order_cols]
    indexed = with_row_index(df.select(*order_cols, *extra), order_cols)
    n = df.count()
    side = F.when(F.col("row_id") < n // 2, "orig").otherwise("syn")
    pair = indexed.select(F.lit("all").alias(KEY), side.alias("side"), *cols)
    return ecdf_summary(ecdf_merge(pair, cols)).select("col", "ks")
