"""Entropy, mutual information and effective dimension of both sides."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import number, wide_aggregate
from .compare import KEY, side_histograms, weighted_score
from .histogram import binned, column_ranges
from .pairs import is_orig, is_syn, pair_columns
from .profile import entropy_of_counts, rare_patterns

# Bins, smoothing, thresholds and weights.
ENTROPY_BINS = 50
MI_BINS = 10
MI_FLOOR = 1e-6
VARIANCE_SHARE = 0.90
ENTROPY_THRESHOLD = 65.0
ENTROPY_WEIGHTS = {"entropy_score": 0.5, "mi_preservation": 0.2, "dimension_score": 0.3}
RETENTION_DROP = 0.20


def ratio_score(ratio):
    return 100.0 * F.exp(-F.abs(ratio - 1.0))


def column_entropies(pair: DataFrame, cols: Sequence[str] | None = None, shared: bool = False) -> DataFrame:
    """Entropy of each column's 50-bin histogram on both sides: validation_id, col, h_s, h_o."""
    hist = side_histograms(pair, ENTROPY_BINS, "both" if shared else "own", cols)
    hist = hist.withColumn("cs", F.col("cs") + 1e-10).withColumn("co", F.col("co") + 1e-10)
    hs = entropy_of_counts(hist, [KEY, "col"], "cs").withColumnRenamed("entropy", "h_s")
    ho = entropy_of_counts(hist, [KEY, "col"], "co").withColumnRenamed("entropy", "h_o")
    return hs.join(ho, [KEY, "col"])


def entropy_ratio(entropies: DataFrame) -> DataFrame:
    """Ratio of the mean entropies and its score."""
    r = F.avg("h_s") / (F.avg("h_o") + 1e-10)
    out = entropies.groupBy(KEY).agg(r.alias("entropy_ratio"))
    return out.withColumn("entropy_score", ratio_score(F.col("entropy_ratio")))


def diversity_retention(entropies: DataFrame) -> DataFrame:
    """Per column: entropy kept, as a 0..100 score, and the flag for a drop above 20 %."""
    kept = F.when(F.col("h_o") > 0, F.col("h_s") / F.col("h_o")).otherwise(1.0)
    return entropies.select(
        KEY, "col", (100.0 * F.least(F.lit(1.0), kept)).alias("retention"), (kept < 1.0 - RETENTION_DROP).alias("collapsed")
    )


def mutual_information(pair: DataFrame, cols: Sequence[str] | None = None, bins: int = MI_BINS) -> DataFrame:
    """Binned mutual information of neighbouring columns on both sides: validation_id, col, mi_s, mi_o.

    All rows enter one aggregate over (column, bin, bin); bins span the joint range of both sides.
    """
    cols = list(cols or pair_columns(pair))
    nxt = {c: cols[(i + 1) % len(cols)] for i, c in enumerate(cols)}
    cut = binned(pair, cols, column_ranges(pair, cols, [KEY]), [KEY], bins)
    rows = F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(f"_bin_{c}").alias("i"), F.col(f"_bin_{nxt[c]}").alias("j")) for c in cols
    ])
    cells = cut.select(KEY, "side", F.inline(rows)).groupBy(KEY, "side", "col", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    keys = [KEY, "side", "col"]
    h = entropy_of_counts(cells, keys).withColumnRenamed("entropy", "h_ij")
    for axis in ("i", "j"):
        margin = cells.groupBy(*keys, axis).agg(F.sum("n").alias("n"))
        h = h.join(entropy_of_counts(margin, keys).withColumnRenamed("entropy", f"h_{axis}"), keys)
    mi = F.greatest(F.lit(0.0), F.col("h_i") + F.col("h_j") - F.col("h_ij"))
    return h.groupBy(KEY, "col").agg(
        F.max(F.when(F.col("side") == "syn", mi)).alias("mi_s"), F.max(F.when(F.col("side") == "orig", mi)).alias("mi_o")
    )


def mi_preservation(mi: DataFrame) -> DataFrame:
    """Mean ratio score of the column's mutual information; a column with nothing to preserve scores 100."""
    score = F.when(F.col("mi_o") > MI_FLOOR, ratio_score(F.col("mi_s") / (F.col("mi_o") + 1e-10))).otherwise(100.0)
    return mi.groupBy(KEY).agg(F.coalesce(F.avg(score), F.lit(85.0)).alias("mi_preservation"))


def effective_dimensions(pair: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Principal components needed for over 90 % of the variance of each side, and the ratio score.

    Covariances are one aggregate over all rows; each group handed to numpy is one d x d matrix.
    """
    cols = list(cols or pair_columns(pair))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    wide = wide_aggregate(
        pair, [KEY, "side"], [F.covar_samp(number(cols[i]), number(cols[j])).alias(f"_c{k}") for k, (i, j) in enumerate(pairs)]
    )
    packed = wide.select(KEY, "side", F.array(*[F.col(f"_c{k}") for k in range(len(pairs))]).alias("cov"))
    d = len(cols)

    def count_components(batches):
        for pdf in batches:
            counts = []
            for flat in pdf["cov"]:
                m = np.zeros((d, d))
                for (i, j), v in zip(pairs, flat):
                    m[i, j] = m[j, i] = 0.0 if v is None or np.isnan(v) else v
                values = np.clip(np.linalg.eigvalsh(m)[::-1], 0, None)
                total = values.sum()
                share = np.cumsum(values) / total if total > 0 else np.ones(1)
                counts.append(int(np.searchsorted(share, VARIANCE_SHARE, side="right")) + 1)
            yield pd.DataFrame({KEY: pdf[KEY], "side": pdf["side"], "dims": np.minimum(counts, d)})

    kind = pair.schema[KEY].dataType.simpleString()
    dims = packed.mapInPandas(count_components, f"{KEY} {kind}, side string, dims long")
    out = dims.groupBy(KEY).agg(
        F.max(F.when(F.col("side") == "syn", F.col("dims"))).alias("dims_s"),
        F.max(F.when(F.col("side") == "orig", F.col("dims"))).alias("dims_o"),
    )
    return out.withColumn("dimension_score", ratio_score(F.col("dims_s") / F.col("dims_o")))


def entropy_stability(pair: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """0.5 entropy + 0.2 mutual information + 0.3 effective dimension."""
    cols = list(cols or pair_columns(pair))
    parts = (
        entropy_ratio(column_entropies(pair, cols))
        .join(mi_preservation(mutual_information(pair, cols)), KEY)
        .join(effective_dimensions(pair, cols), KEY)
    )
    return weighted_score(parts, ENTROPY_WEIGHTS, ENTROPY_THRESHOLD)


def rare_retention(pair: DataFrame, cols: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """Share of the original's rare value combinations that the synthetic side still contains."""
    orig = rare_patterns(pair.filter(F.col("side") == "orig"), cols, threshold, [KEY]).select(KEY, *cols)
    kept = pair.filter(F.col("side") == "syn").select(KEY, *cols).distinct().withColumn("_kept", F.lit(1))
    return orig.join(kept, [KEY, *cols], "left").groupBy(KEY).agg(
        F.count(F.lit(1)).alias("rare_patterns"), (100.0 * F.count("_kept") / F.count(F.lit(1))).alias("rare_retention")
    )
