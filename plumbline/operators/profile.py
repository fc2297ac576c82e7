"""Column profiles, quality measures and value-frequency statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checked_small, clamp, lookup_join, melt, number, numeric_columns, row_text, same_key_join, wide_aggregate
from .histogram import bin_index, column_ranges
from .ordered import quantiles, ranked_values

# Strings the CSV profiler counts as missing.
NULL_TOKENS = ["", "null", "NULL", "NA"]

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def normalise_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Replace the missing-value tokens by NULL in string columns."""
    chosen = set(cols or [n for n, t in df.dtypes if t == "string"])
    return df.select(*[
        F.when(~F.col(c).isin(NULL_TOKENS), F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns
    ])


def parsed(value: Column) -> Column:
    """Double value of a string that looks like a number, else NULL."""
    return F.when(value.rlike(NUMBER_PATTERN), F.trim(value).try_cast("double"))


def value_counts(df: DataFrame, cols: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Frequency of every value of every column, as strings: keys, col, value, n. NULL is a value here."""
    cols = list(cols or [c for c in df.columns if c not in keys])
    rows = melt(df, keys, {c: {"value": F.col(c).cast("string")} for c in cols})
    return rows.groupBy(*keys, "col", "value").agg(F.count(F.lit(1)).alias("n"))


def profile_columns(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Per column: rows, nulls, distinct values, and min / max / mean of the values that parse as numbers.

    ``approx`` keeps a HyperLogLog count in the first aggregate instead of shuffling every distinct value.
    """
    df = normalise_nulls(df)
    if approx:
        cols = list(cols or df.columns)
        rows = melt(df, [], {c: {"value": F.col(c).cast("string")} for c in cols})
        v = parsed(F.col("value"))
        return rows.groupBy("col").agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(F.col("value").isNull()).alias("null_count"),
            F.approx_count_distinct("value", 0.01).alias("distinct_count"),
            F.min(v).alias("min_value"),
            F.max(v).alias("max_value"),
            F.avg(v).alias("mean_value"),
        )
    counts = value_counts(df, cols)
    v = parsed(F.col("value"))
    return counts.groupBy("col").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        (F.sum(v * F.col("n")) / F.sum(F.when(v.isNotNull(), F.col("n")))).alias("mean_value"),
    )


def infer_types(df: DataFrame, cols: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
    """``float64`` if any non-null value parses as a number (all of them when ``strict``), else ``string``."""
    df = normalise_nulls(df)
    cols = list(cols or df.columns)
    pick = F.min if strict else F.max
    row = df.agg(*[pick(parsed(F.col(c).cast("string")).isNotNull()).alias(c) for c in cols])
    if strict:
        row = df.agg(*[
            F.min(F.when(F.col(c).isNotNull(), parsed(F.col(c).cast("string")).isNotNull())).alias(c) for c in cols
        ])
    return melt(row, [], {c: {"type": F.when(F.col(c), F.lit("float64")).otherwise(F.lit("string"))} for c in cols})


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, distinct rows, surplus copies, and distinct share."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.count(F.lit(1)) / F.sum("_n"), F.lit(1.0)).alias("uniqueness"),
    )


def completeness(df: DataFrame) -> DataFrame:
    """Share of non-null cells; 1.0 for an empty dataset."""
    df = normalise_nulls(df)
    filled = sum((F.count(F.col(c)) for c in df.columns), F.lit(0))
    cells = F.count(F.lit(1)) * len(df.columns)
    return df.agg(
        cells.alias("cells"),
        (cells - filled).alias("null_cells"),
        F.when(cells > 0, filled / cells).otherwise(1.0).alias("completeness"),
    )


def json_profile(df: DataFrame, col: str) -> DataFrame:
    """Rows in which each top-level key of a JSON column occurs; unreadable rows are skipped."""
    fields = F.from_json(F.col(col), "map<string,string>")
    return df.select(F.explode(F.map_keys(fields)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("row_count"))


def json_summary(df: DataFrame, col: str) -> DataFrame:
    """Readable rows, unreadable rows and distinct top-level keys of a JSON column."""
    fields = F.from_json(F.col(col), "map<string,string>")
    rows = df.select(fields.alias("_f"), F.col(col).alias("_raw"))
    totals = rows.agg(
        F.count("_f").alias("row_count"), F.count_if(F.col("_f").isNull() & F.col("_raw").isNotNull()).alias("bad_rows")
    )
    keys = json_profile(df, col).agg(F.count(F.lit(1)).alias("column_count"))
    return totals.crossJoin(F.broadcast(keys))  # one row on each side


def column_moments(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), extra: dict | None = None) -> DataFrame:
    """count, nulls, mean, std (n-1), std_pop, min, max, skew (G1), kurtosis (G2) per (keys, col) in one scan."""
    aggs = []
    for c in cols:
        v = number(c)
        aggs += [
            F.count(v).alias(f"{c}__count"),
            F.count_if(v.isNull()).alias(f"{c}__nulls"),
            F.avg(v).alias(f"{c}__mean"),
            F.stddev_samp(v).alias(f"{c}__std"),
            F.stddev_pop(v).alias(f"{c}__std_pop"),
            F.min(v).alias(f"{c}__min"),
            F.max(v).alias(f"{c}__max"),
            F.skewness(v).alias(f"{c}__g1"),
            F.kurtosis(v).alias(f"{c}__g2"),
        ]
        for name, make in (extra or {}).items():
            aggs.append(make(v).alias(f"{c}__{name}"))
    wide = wide_aggregate(df, keys, aggs)
    per = {}
    for c in cols:
        n = F.col(f"{c}__count").cast("double")
        g1, g2 = F.col(f"{c}__g1"), F.col(f"{c}__g2")
        per[c] = {k: F.col(f"{c}__{k}") for k in ["count", "nulls", "mean", "std", "std_pop", "min", "max"]}
        per[c]["skew"] = F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))
        per[c]["kurtosis"] = F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
        for name in extra or {}:
            per[c][name] = F.col(f"{c}__{name}")
    return melt(wide, keys, per)


# The quantiles every column report carries.
REPORT_QUANTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def column_stats(df: DataFrame, cols: Sequence[str] | None = None, keys: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Full statistics per (keys, column). ``approx`` answers quantiles and distinct counts from sketches in the same scan."""
    cols = numeric_columns(df, cols, exclude=keys)
    if approx:
        extra = {name: (lambda v, p=p: F.percentile_approx(v, p, 10_000)) for name, p in REPORT_QUANTILES.items()}
        extra["unique"] = lambda v: F.approx_count_distinct(v, 0.01)
        return column_moments(df, cols, keys, extra)
    moments = column_moments(df, cols, keys)
    points = quantiles(df, cols, REPORT_QUANTILES, keys).drop("count")
    return same_key_join(moments, points, [*keys, "col"], "left").withColumn("unique", F.coalesce("unique", F.lit(0)))


def running_stats(df: DataFrame, cols: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Mergeable statistics only (population std), with quantiles read from one KLL sketch per column."""
    cols = numeric_columns(df, cols, exclude=keys)
    aggs = []
    for c in cols:
        v = number(c)
        aggs += [
            F.count(v).alias(f"{c}__count"),
            F.sum(v).alias(f"{c}__sum"),
            F.sum(v * v).alias(f"{c}__sum_sq"),
            F.avg(v).alias(f"{c}__mean"),
            F.stddev_pop(v).alias(f"{c}__std"),
            F.min(v).alias(f"{c}__min"),
            F.max(v).alias(f"{c}__max"),
            F.kll_sketch_agg_double(v).alias(f"{c}__sketch"),
        ]
    wide = df.groupBy(*keys).agg(*aggs)
    per = {}
    for c in cols:
        per[c] = {k: F.col(f"{c}__{k}") for k in ["count", "sum", "sum_sq", "mean", "std", "min", "max"]}
        for name, p in REPORT_QUANTILES.items():
            per[c][name] = F.kll_sketch_get_quantile_double(F.col(f"{c}__sketch"), F.lit(p))
    return melt(wide, keys, per)


# --- diversity scores over a statistics row -------------------------------------------------------------


def spread_score(mean: Column, std: Column) -> Column:
    return F.when(mean == 0, 50.0).otherwise(F.least(F.lit(100.0), 50.0 * std / F.abs(mean)))


def uniqueness_score(unique: Column, count: Column) -> Column:
    return F.least(F.lit(100.0), F.try_divide(100.0 * unique, count))


def balance_score(q25: Column, median: Column, q75: Column) -> Column:
    iqr = q75 - q25
    lean = F.abs((median - q25) - (q75 - median))
    return F.when(iqr == 0, 50.0).otherwise(clamp(100.0 * (1.0 - lean / iqr), 0.0, 100.0))


def dimension_scores(stats: DataFrame) -> DataFrame:
    """Add the three part scores, their mean, and |skew| to a statistics table."""
    spread = F.coalesce(spread_score(F.col("mean"), F.col("std")), F.lit(50.0))
    unique = F.coalesce(uniqueness_score(F.col("unique"), F.col("count")), F.lit(0.0))
    balance = F.coalesce(balance_score(F.col("q25"), F.col("median"), F.col("q75")), F.lit(50.0))
    return (
        stats.withColumn("spread_score", spread)
        .withColumn("uniqueness_score", unique)
        .withColumn("balance_score", balance)
        .withColumn("dimension_score", (F.col("spread_score") + F.col("uniqueness_score") + F.col("balance_score")) / 3.0)
        .withColumn("skew_factor", F.coalesce(F.abs(F.col("skew")), F.lit(0.0)))
    )


def sample_quality(stats: DataFrame, rows: int | Column, target_rows: int, keys: Sequence[str] = ()) -> DataFrame:
    """Row-count adequacy and mean relative spread, 60 / 40."""
    n = rows if isinstance(rows, Column) else F.lit(rows)
    spread = F.least(F.lit(100.0), 50.0 * F.col("std") / F.abs(F.col("mean")))
    usable = F.when((F.col("mean") != 0) & F.col("std").isNotNull(), spread)
    size_part = F.least(F.lit(1.0), F.max(n) / F.lit(float(target_rows))) * 100.0
    return stats.groupBy(*keys).agg(
        (0.6 * size_part + 0.4 * F.coalesce(F.avg(usable), F.lit(50.0))).alias("sample_quality")
    )


def outlier_pct(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5, ranked: DataFrame | None = None) -> DataFrame:
    """Exact share of values outside the quartile fences, from the distinct-value counts."""
    cols = numeric_columns(df, cols)
    ranked = ranked_values(df, cols) if ranked is None else ranked
    points = quantiles(df, cols, REPORT_QUANTILES, ranked=ranked)
    limits = points.select(
        "col",
        (F.col("q25") - k * (F.col("q75") - F.col("q25"))).alias("low_fence"),
        (F.col("q75") + k * (F.col("q75") - F.col("q25"))).alias("high_fence"),
    )
    outside = (F.col("value") < F.col("low_fence")) | (F.col("value") > F.col("high_fence"))
    joined = lookup_join(ranked, limits, ["col"])
    return joined.groupBy("col").agg(
        F.first("low_fence").alias("low_fence"),
        F.first("high_fence").alias("high_fence"),
        F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("outliers"),
        (100.0 * F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)) / F.sum("n")).alias("outlier_pct"),
        F.max(F.when(outside, 5.0).otherwise(0.0)).alias("outlier_flag_pct"),
    )


def zscore_outliers(df: DataFrame, cols: Sequence[str] | None = None, limit: float = 3.0) -> DataFrame:
    """Share of values further than ``limit`` standard deviations from the column mean."""
    cols = numeric_columns(df, cols)
    base = df.agg(*[f(number(c)).alias(f"_{p}_{c}") for c in cols for f, p in ((F.avg, "m"), (F.stddev_samp, "s"))])
    joined = df.crossJoin(F.broadcast(base))  # a global aggregate: always one row
    wide = joined.agg(
        *[F.count(number(c)).alias(f"{c}__n") for c in cols],
        *[
            F.count_if(F.abs(number(c) - F.col(f"_m_{c}")) > limit * F.col(f"_s_{c}")).alias(f"{c}__out")
            for c in cols
        ],
    )
    per = {
        c: {"outliers": F.col(f"{c}__out"), "outlier_pct": F.try_divide(100.0 * F.col(f"{c}__out"), F.col(f"{c}__n"))}
        for c in cols
    }
    return melt(wide, [], per)


def quality_score(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Completeness, uniqueness, castable share and outlier count of a dataset, computed, in one row."""
    numeric = numeric_columns(df, cols)
    outliers = outlier_pct(df, numeric).agg(F.sum("outliers").alias("outlier_count"))
    text = [F.col(c).cast("string") for c in numeric]
    valid = sum((F.count_if(parsed(c).isNotNull()) for c in text), F.lit(0))
    present = sum((F.count(c) for c in text), F.lit(0))
    validity = df.agg(F.when(present > 0, valid / present).otherwise(1.0).alias("validity"))
    parts = [completeness(df).select("completeness"), duplicate_rows(df).select("uniqueness"), validity, outliers]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def null_unique_rates(profile: DataFrame) -> DataFrame:
    """null_rate and unique_rate per column from a profile."""
    return profile.select(
        "col",
        (F.col("null_count") / F.col("row_count")).alias("null_rate"),
        (F.col("distinct_count") / F.col("row_count")).alias("unique_rate"),
    )


# --- value concentration --------------------------------------------------------------------------------


def column_entropy(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 50) -> DataFrame:
    """Shannon entropy (nats): numeric columns by equal-width bin, others by value."""
    cols = list(cols or df.columns)
    numeric = [c for c in cols if c in numeric_columns(df)]
    exprs = {c: F.col(c).cast("string") for c in cols}
    if numeric:
        df = df.crossJoin(F.broadcast(column_ranges(df, numeric, [])))  # one row
        for c in numeric:
            exprs[c] = bin_index(number(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), bins).cast("string")
    counts = melt(df, [], {c: {"value": e} for c, e in exprs.items()}).filter(F.col("value").isNotNull())
    counts = counts.groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    return entropy_of_counts(counts, ["col"])


def entropy_of_counts(counts: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """-sum p ln p = ln N - (sum n ln n) / N per key, without joining the total back."""
    c = F.col(n).cast("double")
    total = F.sum(c)
    return counts.groupBy(*keys).agg(
        (F.ln(total) - F.sum(F.when(c > 0, c * F.ln(c)).otherwise(0.0)) / total).alias("entropy")
    )


def frequency_of_frequencies(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """How many values of each column occur ``n`` times: col, n, values. At most about sqrt(2 * rows) rows per column."""
    counts = value_counts(df, cols).filter(F.col("value").isNotNull())
    return counts.groupBy("col", "n").agg(F.count(F.lit(1)).alias("values"))


def gini(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Gini concentration of the value frequencies of each column."""
    freq = frequency_of_frequencies(df, cols)
    up = Window.partitionBy("col").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("values").over(up), F.lit(0))
    m = F.col("values")
    rank_sum = freq.withColumn("_ranks", m * below + m * (m + 1) / 2)
    total, k = F.sum(F.col("n") * m), F.sum(m)
    return rank_sum.groupBy("col").agg(
        k.alias("values"),
        (2.0 * F.sum(F.col("_ranks") * F.col("n")) / (k * total) - (k + 1) / k).alias("gini"),
    )


def concentration_ratio(df: DataFrame, k: int, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of rows held by the ``k`` most frequent values of each column."""
    freq = frequency_of_frequencies(df, cols)
    down = Window.partitionBy("col").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum("values").over(down), F.lit(0))
    use = freq.withColumn("_use", F.greatest(F.lit(0), F.least(F.col("values"), F.lit(k) - taken)))
    return use.groupBy("col").agg(
        (F.sum(F.col("_use") * F.col("n")) / F.sum(F.col("values") * F.col("n"))).alias("concentration_ratio")
    )


def pattern_counts(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Count and share of every combination of values."""
    counts = df.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    joined = lookup_join(counts, totals, keys) if keys else counts.crossJoin(F.broadcast(totals))
    return joined.withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def rare_patterns(df: DataFrame, cols: Sequence[str], threshold: float = 0.01, keys: Sequence[str] = ()) -> DataFrame:
    """Value combinations whose share lies below the threshold."""
    return pattern_counts(df, cols, keys).filter(F.col("share") < threshold)


def rare_pattern_pct(df: DataFrame, cols: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """Number of rare combinations and percentage of rows inside them."""
    rare = F.col("share") < threshold
    return pattern_counts(df, cols).agg(
        F.count_if(rare).alias("rare_patterns"),
        (100.0 * F.coalesce(F.sum(F.when(rare, F.col("n"))), F.lit(0)) / F.sum("n")).alias("rare_pct"),
    )


def flatness(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 50) -> DataFrame:
    """Chi-square statistic of each column's histogram against a flat one, and the near-flat flag."""
    from .histogram import shared_histogram

    cols = numeric_columns(df, cols)
    hist = shared_histogram(df, cols, column_ranges(df, cols, []), [], bins)
    out = hist.groupBy("col").agg(
        (F.sum(F.col("n") * F.col("n")) * float(bins) / F.sum("n") - F.sum("n")).alias("chi2"),
        F.sum("n").alias("_total"),
    )
    # a flat column has chi2 near its degrees of freedom; mean + 3 sd of that law is 3*sqrt(2*dof) above it
    dof = float(bins - 1)
    limit = dof + 3.0 * (2.0 * dof) ** 0.5
    return out.withColumn("suspicious", F.col("chi2") < limit).drop("_total")


def shape_class(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 50) -> DataFrame:
    """normal / skewed / long_tail / multimodal / flat per column from moments and histogram peaks.

    A peak is a bin of the 3-bin running mean above both neighbours and above a tenth of the tallest.
    """
    from .histogram import shared_histogram

    cols = numeric_columns(df, cols)
    hist = shared_histogram(df, cols, column_ranges(df, cols, []), [], bins)
    per_col = Window.partitionBy("col").orderBy("bin")  # exactly ``bins`` rows per column
    smooth = hist.withColumn("_s", F.avg("n").over(per_col.rowsBetween(-1, 1)))
    left = F.coalesce(F.lag("_s").over(per_col), F.lit(-1.0))
    right = F.coalesce(F.lead("_s").over(per_col), F.lit(-1.0))
    marked = smooth.select("col", "_s", ((F.col("_s") > left) & (F.col("_s") > right)).alias("_peak"))
    tall = marked.withColumn("_top", F.max("_s").over(Window.partitionBy("col")))
    peaks = tall.groupBy("col").agg(F.count_if(F.col("_peak") & (F.col("_s") >= 0.1 * F.col("_top"))).alias("peaks"))
    moments = column_moments(df, cols).select("col", "skew", "kurtosis")
    a = F.abs(F.col("skew"))
    label = (
        F.when((F.col("kurtosis") > 3) & (a > 2), "long_tail")
        .when(a > 1, "skewed")
        .when((a <= 0.5) & (F.col("kurtosis") < -1.0), "flat")
        .when(F.col("peaks") > 1, "multimodal")
        .when(a > 0.5, "skewed")
        .otherwise("normal")
    )
    return moments.join(peaks, "col").select("col", "skew", "kurtosis", "peaks", label.alias("shape"))


def missing_patterns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null-mask combinations (1 = missing, in column order) with their row counts."""
    cols = list(cols or df.columns)
    mask = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    return df.groupBy(mask.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def dataset_fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Order-insensitive content hash: row count and the sums of two slices of each row's SHA-256."""
    cols = list(cols or df.columns)
    digest = F.sha2(row_text(cols), 256)
    # the sum of rows below 16^15 stays inside decimal(38,0) for 10^19 rows
    part = [F.sum(F.conv(F.substring(digest, s, 15), 16, 10).cast("decimal(38,0)")).cast("string") for s in (1, 16)]
    return df.agg(F.count(F.lit(1)).alias("row_count"), part[0].alias("hash_a"), part[1].alias("hash_b"))


def diversity_findings(scored: DataFrame, outliers: DataFrame, quality: DataFrame) -> DataFrame:
    """Rows (kind, col, value) for every diversity problem, or one ``ok`` row."""
    found = (
        scored.filter(F.col("dimension_score") < 30).select(F.lit("low_diversity").alias("kind"), "col", F.col("dimension_score").alias("value"))
        .unionByName(scored.filter(F.col("skew_factor") > 2).select(F.lit("high_skew").alias("kind"), "col", F.col("skew_factor").alias("value")))
        .unionByName(outliers.filter(F.col("outlier_pct") > 10).select(F.lit("outliers").alias("kind"), "col", F.col("outlier_pct").alias("value")))
        .unionByName(
            quality.filter(F.col("sample_quality") < 60).select(
                F.lit("low_sample_quality").alias("kind"), F.lit(None).cast("string").alias("col"), F.col("sample_quality").alias("value")
            )
        )
    )
    none = found.agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == 0)
    ok = none.select(F.lit("ok").alias("kind"), F.lit(None).cast("string").alias("col"), F.lit(None).cast("double").alias("value"))
    return found.unionByName(ok)


def small_or_self(df: DataFrame) -> DataFrame:
    """Reuse a per-column aggregate in several branches without computing it again."""
    local = checked_small(df)
    return df if local is None else local
