"""Power spectra along the row order of both sides."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .compare import KEY, weighted_score
from .ordered import with_row_index
from .pairs import finite

# Scale, thresholds and weights of the spectral score.
DISTANCE_SCALE = 1000.0
SPECTRAL_THRESHOLD = 70.0
SPECTRAL_WEIGHTS = {"spectral_similarity": 0.4, "dominant_frequency_match": 0.3, "spectral_entropy_score": 0.3}
DEFAULT_BLOCK = 65_536
# Rows of the blocks that are transformed at once.
TOGETHER = 65_536


def psd(pair: DataFrame, cols: Sequence[str], order_cols: Sequence[str], block: int = DEFAULT_BLOCK, normalise: bool = False) -> DataFrame:
    """|rfft|^2 per column: validation_id, side, col, freq, power.

    Rows are numbered per side, cut into blocks of ``block`` rows and transformed, short blocks many at once; powers are averaged
    over the blocks. The length is the same for sides of every size: a last block, or a side, shorter than it is padded with
    zeros, and missing values count as zero. ``normalise`` divides by the rows of the blocks, padding left out, so the
    scale depends neither on the block length nor on the number of rows.
    """
    needed = [KEY, "side", *dict.fromkeys([*order_cols, *cols])]
    indexed = with_row_index(pair.select(*needed), order_cols, "_row", [KEY, "side"])
    placed = indexed.select(
        KEY, "side", (F.col("_row") / block).cast("long").alias("_block"), (F.col("_row") % block).cast("int").alias("_at"), *[finite(F.col(c)).alias(c) for c in cols],
    )
    names = list(cols)
    together = max(1, TOGETHER // block)

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        own, which = np.unique(pdf["_block"].to_numpy(), return_inverse=True)
        x = np.zeros((len(own), block, len(names)))
        x[which, pdf["_at"].to_numpy()] = pdf[names].to_numpy(dtype=float)
        power = (np.abs(np.fft.rfft(x, axis=1)) ** 2).sum(axis=0)
        freqs, d = power.shape
        return pd.DataFrame({
            KEY: np.repeat(pdf[KEY].iloc[0], freqs * d),
            "side": pdf["side"].iloc[0],
            "col": np.repeat(names, freqs),
            "freq": np.tile(np.arange(freqs), d),
            "power": power.T.ravel(),
            "_rows": len(pdf),
            "_blocks": len(own),
        })

    kind = pair.schema[KEY].dataType.simpleString()
    parts = placed.withColumn("_some", F.floor(F.col("_block") / together)).groupBy(KEY, "side", "_some").applyInPandas(
        transform, f"{KEY} {kind}, side string, col string, freq long, power double, _rows long, _blocks long"
    )
    power = F.sum("power") / F.sum("_rows" if normalise else "_blocks")
    return parts.groupBy(KEY, "side", "col", "freq").agg(power.alias("power"))


def psd_sides(spectrum: DataFrame) -> DataFrame:
    """Powers of both sides next to each other: validation_id, col, freq, p_s, p_o."""
    return spectrum.groupBy(KEY, "col", "freq").agg(
        F.coalesce(F.max(F.when(F.col("side") == "syn", F.col("power"))), F.lit(0.0)).alias("p_s"),
        F.coalesce(F.max(F.when(F.col("side") == "orig", F.col("power"))), F.lit(0.0)).alias("p_o"),
    )


def spectral_similarity(sides: DataFrame) -> DataFrame:
    out = sides.groupBy(KEY).agg(F.avg(F.abs(F.col("p_s") - F.col("p_o"))).alias("spectral_distance"))
    return out.withColumn("spectral_similarity", 100.0 * F.exp(-F.col("spectral_distance") / DISTANCE_SCALE))


def dominant_frequency_match(sides: DataFrame) -> DataFrame:
    """Share of columns whose strongest frequency (lowest on ties) is the same on both sides."""
    peaks = sides.groupBy(KEY, "col").agg(
        F.max_by(-F.col("freq"), F.struct("p_s", -F.col("freq"))).alias("_s"),
        F.max_by(-F.col("freq"), F.struct("p_o", -F.col("freq"))).alias("_o"),
    )
    return peaks.groupBy(KEY).agg((100.0 * F.avg((F.col("_s") == F.col("_o")).cast("double"))).alias("dominant_frequency_match"))


def spectral_entropy_ratio(sides: DataFrame) -> DataFrame:
    """Ratio of the mean spectral entropies and its score."""
    totals = sides.groupBy(KEY, "col").agg(F.sum("p_s").alias("_ts"), F.sum("p_o").alias("_to"))
    share = sides.join(totals, [KEY, "col"])
    s = F.col("p_s") / F.greatest(F.col("_ts"), F.lit(1e-12))
    o = F.col("p_o") / F.greatest(F.col("_to"), F.lit(1e-12))
    per_col = share.groupBy(KEY, "col").agg(
        (-F.sum(s * F.ln(s + 1e-10))).alias("_hs"), (-F.sum(o * F.ln(o + 1e-10))).alias("_ho")
    )
    out = per_col.groupBy(KEY).agg((F.avg("_hs") / (F.avg("_ho") + 1e-10)).alias("spectral_entropy_ratio"))
    return out.withColumn("spectral_entropy_score", 100.0 * F.exp(-F.abs(F.col("spectral_entropy_ratio") - 1.0)))


def spectral_coherence(
    pair: DataFrame, cols: Sequence[str], order_cols: Sequence[str], block: int = DEFAULT_BLOCK, normalise: bool = False
) -> DataFrame:
    """0.4 similarity + 0.3 dominant frequency + 0.3 entropy, from one spectrum."""
    sides = psd_sides(psd(pair, cols, order_cols, block, normalise))
    totals = Window.partitionBy(KEY, "col")  # at most block / 2 + 1 rows
    s = F.col("p_s") / F.greatest(F.sum("p_s").over(totals), F.lit(1e-12))
    o = F.col("p_o") / F.greatest(F.sum("p_o").over(totals), F.lit(1e-12))
    shares = sides.select(KEY, "col", "freq", "p_s", "p_o", s.alias("_s"), o.alias("_o"))
    per_col = shares.groupBy(KEY, "col").agg(
        F.sum(F.abs(F.col("p_s") - F.col("p_o"))).alias("_gap"),
        F.count(F.lit(1)).alias("_freqs"),
        (
            F.max_by(-F.col("freq"), F.struct("p_s", -F.col("freq"))) == F.max_by(-F.col("freq"), F.struct("p_o", -F.col("freq")))
        ).cast("double").alias("_same"),
        (-F.sum(F.col("_s") * F.ln(F.col("_s") + 1e-10))).alias("_hs"),
        (-F.sum(F.col("_o") * F.ln(F.col("_o") + 1e-10))).alias("_ho"),
    )
    parts = per_col.groupBy(KEY).agg(
        (F.sum("_gap") / F.sum("_freqs")).alias("spectral_distance"),
        (100.0 * F.avg("_same")).alias("dominant_frequency_match"),
        (F.avg("_hs") / (F.avg("_ho") + 1e-10)).alias("spectral_entropy_ratio"),
    ).withColumn("spectral_similarity", 100.0 * F.exp(-F.col("spectral_distance") / DISTANCE_SCALE)).withColumn(
        "spectral_entropy_score", 100.0 * F.exp(-F.abs(F.col("spectral_entropy_ratio") - 1.0))
    )
    return weighted_score(parts, SPECTRAL_WEIGHTS, SPECTRAL_THRESHOLD)


def representation_metrics(vectors: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Energy, softmax entropy, peak-to-mean spectral power and variance of an array column, per key.

    Every row is transformed on its own in Arrow batches; the four results are mergeable aggregates.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def per_row(batches):
        for pdf in batches:
            x = np.stack(pdf[col].to_numpy()).astype(float)
            shifted = np.exp(x - x.max(axis=1, keepdims=True))
            p = shifted / shifted.sum(axis=1, keepdims=True)
            power = np.abs(np.fft.rfft(x, axis=1)) ** 2
            yield pd.DataFrame({
                **{k: pdf[k] for k in keys},
                "cells": x.shape[1],
                "total": x.sum(axis=1),
                "squares": (x * x).sum(axis=1),
                "softmax_entropy": -(p * np.log(p + 1e-10)).sum(axis=1),
                "peak": power.max(axis=1),
                "power": power.sum(axis=1),
                "freqs": power.shape[1],
            })

    fields = "cells long, total double, squares double, softmax_entropy double, peak double, power double, freqs long"
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], fields])
    rows = vectors.select(*keys, col).filter(F.size(col) > 0).mapInPandas(per_row, schema)
    n = F.sum("cells")
    return rows.groupBy(*keys).agg(
        (F.sum("squares") / n).alias("spectral_energy"),
        F.avg("softmax_entropy").alias("spectral_entropy"),
        (F.max("peak") / (F.sum("power") / F.sum("freqs"))).alias("frequency_concentration"),
        ((F.sum("squares") - F.sum("total") * F.sum("total") / n) / (n - 1)).alias("representation_variance"),
    )
