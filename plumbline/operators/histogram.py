"""Equal-width histograms for many columns, sides and datasets in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import lookup_join, number


def bin_index(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin number on [lo, hi], the last bin closed; null outside. A degenerate range is widened by half each way."""
    low = F.when(lo == hi, lo - 0.5).otherwise(lo)
    high = F.when(lo == hi, hi + 0.5).otherwise(hi)
    raw = F.floor((value - low) / (high - low) * bins)
    return F.when((value >= low) & (value <= high), F.least(raw, F.lit(bins - 1))).cast("int")


def column_ranges(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per key with ``_lo_c`` and ``_hi_c`` for every column."""
    aggs = []
    for c in cols:
        aggs += [F.min(number(c)).alias(f"_lo_{c}"), F.max(number(c)).alias(f"_hi_{c}")]
    return df.groupBy(*keys).agg(*aggs)


def binned(df: DataFrame, cols: Sequence[str], ranges: DataFrame, range_keys: Sequence[str], bins: int) -> DataFrame:
    """Add ``_bin_c`` for every column, with ranges looked up per key."""
    ranged = lookup_join(df, ranges, range_keys)
    return ranged.select(
        *df.columns,
        *[bin_index(number(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), bins).alias(f"_bin_{c}") for c in cols],
    )


def shared_histogram(
    df: DataFrame,
    cols: Sequence[str],
    ranges: DataFrame,
    range_keys: Sequence[str],
    bins: int,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Counts per (keys, col, bin), with zero rows for empty bins: keys, col, bin, n."""
    keys = list(keys)
    flat = binned(df, cols, ranges, range_keys, bins).select(
        *keys, F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"_bin_{c}").alias("bin")) for c in cols]))
    )
    counts = flat.filter(F.col("bin").isNotNull()).groupBy(*keys, "col", "bin").agg(F.count(F.lit(1)).alias("n"))
    return fill_bins(counts, keys, bins)


def fill_bins(counts: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Add the missing bins as zeros. Works on the counts (at most ``bins`` rows per key and column)."""
    per_col = counts.groupBy(*keys, "col").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"))
    spine = per_col.select(*keys, "col", "_m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    n = F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0)).cast("long")
    return spine.select(*keys, "col", "bin", n.alias("n"))
