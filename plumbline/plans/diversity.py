"""Diversity of one dataset: statistics, per-column scores, sample quality, overall score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.common import numeric_columns
from ..operators.profile import column_stats, dimension_scores, diversity_findings, outlier_pct, sample_quality, small_or_self

# Fixed value: rows a full-quality sample should have.
TARGET_ROWS = 20_000_000


def diversity_score(
    df: DataFrame, cols: Sequence[str] | None = None, target_rows: int = TARGET_ROWS, keys: Sequence[str] = (), approx: bool = False
) -> DataFrame:
    """0.7 x mean column score + 0.3 x sample quality; 0 when there is nothing numeric."""
    if not numeric_columns(df, cols, exclude=keys):
        return df.groupBy(*keys).agg(F.lit(0.0).alias("diversity_score"))
    scored = dimension_scores(column_stats(df, cols, keys, approx))
    rows = F.col("count") + F.col("nulls")
    spread = F.least(F.lit(100.0), 50.0 * F.col("std") / F.abs(F.col("mean")))
    usable = F.when((F.col("mean") != 0) & F.col("std").isNotNull(), spread)
    out = scored.groupBy(*keys).agg(
        F.max(rows).alias("row_count"),
        F.count(F.lit(1)).alias("columns"),
        F.avg("dimension_score").alias("mean_dimension_score"),
        (
            0.6 * F.least(F.lit(1.0), F.max(rows) / float(target_rows)) * 100.0 + 0.4 * F.coalesce(F.avg(usable), F.lit(50.0))
        ).alias("sample_quality"),
    )
    return out.withColumn("diversity_score", 0.7 * F.col("mean_dimension_score") + 0.3 * F.col("sample_quality"))


def diversity_report(df: DataFrame, cols: Sequence[str] | None = None, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Findings rows of a dataset (the per-column statistics are computed once)."""
    scored = small_or_self(dimension_scores(column_stats(df, cols)))
    outliers = outlier_pct(df, cols)
    quality = sample_quality(scored, F.col("count") + F.col("nulls"), target_rows)
    return diversity_findings(scored, outliers, quality)
