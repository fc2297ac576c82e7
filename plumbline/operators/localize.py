"""Which rows and regions are responsible for a problem."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import melt, number, row_text, wide_aggregate
from .correlation import correlation_matrix
from .histogram import binned, column_ranges
from .materialise import materialise
from .neighbours import with_neighbour_distance
from .ordered import quantiles, with_previous, with_row_index, with_running_sums

# Weights, limits and regularisation of the impact score.
WEIGHTS = (0.4, 0.3, 0.3)
IMPACT_THRESHOLD = 0.8
TOP_ROWS = 1000
NEIGHBOURS = 20
EPSILON = 1e-6
FAILED_BELOW = 65.0

# Beyond this many columns the quadratic form is evaluated in Arrow batches instead of one long expression.
MAX_EXPRESSION_COLUMNS = 24


def _moments(df: DataFrame, cols: Sequence[str]):
    """Column means and covariance matrix: d + d(d+1)/2 numbers from one scan."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    exprs = [F.avg(number(c)).alias(f"_m{i}") for i, c in enumerate(cols)]
    exprs += [F.covar_samp(number(cols[i]), number(cols[j])).alias(f"_c{i}_{j}") for i, j in pairs]
    row = wide_aggregate(df, [], exprs).head()
    mean = np.array([row[f"_m{i}"] or 0.0 for i in range(len(cols))])
    cov = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"_c{i}_{j}"] or 0.0
    return mean, cov


def divide_by_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale non-negative score columns by their largest value."""
    tops = df.agg(*[F.max(c).alias(f"_top_{c}") for c in cols])
    joined = df.crossJoin(F.broadcast(tops))  # a global aggregate: one row
    scaled = {c: F.when(F.col(f"_top_{c}") > 0, F.col(c) / F.col(f"_top_{c}")).otherwise(F.col(c)) for c in cols}
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def with_mahalanobis(df: DataFrame, cols: Sequence[str], out: str = "mahalanobis") -> DataFrame:
    """Distance to the mean under the regularised covariance, before scaling."""
    mean, cov = _moments(df, cols)
    try:
        precision = np.linalg.inv(cov + EPSILON * np.eye(len(cols)))
    except np.linalg.LinAlgError:
        precision = np.eye(len(cols))
    if len(cols) <= MAX_EXPRESSION_COLUMNS:
        d = [F.coalesce(number(c), F.lit(float(m))) - float(m) for c, m in zip(cols, mean)]
        form = F.lit(0.0)
        for i in range(len(cols)):
            inner = F.lit(float(precision[i, i])) * d[i]
            for j in range(i + 1, len(cols)):
                inner = inner + F.lit(2.0 * float(precision[i, j])) * d[j]
            form = form + d[i] * inner
        return df.withColumn(out, F.sqrt(F.greatest(form, F.lit(0.0))))

    @F.pandas_udf("double")
    def distance(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()) - mean
        x = np.nan_to_num(x)
        return pd.Series(np.sqrt(np.clip(np.einsum("ij,jk,ik->i", x, precision, x), 0, None)))

    return df.withColumn(out, distance(F.array(*[F.coalesce(number(c), F.lit(float(m))) for c, m in zip(cols, mean)])))


def mahalanobis(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return divide_by_max(with_mahalanobis(df, cols), ["mahalanobis"])


def with_max_abs_z(df: DataFrame, cols: Sequence[str], out: str = "max_abs_z") -> DataFrame:
    """Largest |z| over the columns, before scaling."""
    row = df.agg(*[f(number(c)).alias(f"{p}{i}") for i, c in enumerate(cols) for p, f in (("m", F.avg), ("s", F.stddev_samp))]).head()
    z = []
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0
        z.append(F.abs(F.coalesce(number(c), F.lit(m)) - m) / (s + EPSILON))
    return df.withColumn(out, F.greatest(*z) if len(z) > 1 else z[0])


def max_abs_z(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return divide_by_max(with_max_abs_z(df, cols), ["max_abs_z"])


def with_density(df: DataFrame, cols: Sequence[str], id_cols: Sequence[str], out: str = "density") -> DataFrame:
    """Mean distance to the nearest other rows of the whole table, as an anomaly score before scaling.

    A row is never its own neighbour, also where ids repeat; missing values count as zero.
    """
    n = df.count()
    scored = with_neighbour_distance(df, cols, max(1, min(NEIGHBOURS, n // 10, n - 1)), out)
    return scored.withColumn(out, 1.0 / (1.0 / (F.col(out) + EPSILON) + EPSILON))


def density_anomaly(df: DataFrame, cols: Sequence[str], id_cols: Sequence[str]) -> DataFrame:
    return divide_by_max(materialise(with_density(df, cols, id_cols)), ["density"])


def impact_scores(df: DataFrame, cols: Sequence[str], id_cols: Sequence[str]) -> DataFrame:
    """0.4 Mahalanobis + 0.3 density + 0.3 largest |z|, each scaled by its maximum."""
    keep = list(dict.fromkeys([*id_cols, *cols]))
    raw = with_density(with_max_abs_z(with_mahalanobis(df.select(*keep), cols), cols), cols, id_cols)
    # the three raw scores are read twice (maximum, then scaling) and are the costly part
    raw = materialise(raw.select(*id_cols, "mahalanobis", "density", "max_abs_z"))
    scaled = divide_by_max(raw, ["mahalanobis", "density", "max_abs_z"])
    a, b, c = WEIGHTS
    return scaled.withColumn("impact", a * F.col("mahalanobis") + b * F.col("density") + c * F.col("max_abs_z"))


def problem_rows(scores: DataFrame, threshold: float = IMPACT_THRESHOLD) -> DataFrame:
    return scores.filter(F.col("impact") > threshold)


def problem_summary(scores: DataFrame, threshold: float = IMPACT_THRESHOLD) -> DataFrame:
    hit = F.count_if(F.col("impact") > threshold)
    return scores.agg(
        F.count(F.lit(1)).alias("row_count"), hit.alias("problem_rows"), F.try_divide(100.0 * hit, F.count(F.lit(1))).alias("problem_pct")
    )


def top_rows(scores: DataFrame, id_cols: Sequence[str], k: int = TOP_ROWS, by: str = "impact") -> DataFrame:
    """The k rows with the largest score; ties by id."""
    return scores.orderBy(F.desc(by), *id_cols).limit(k)


def drop_problem_rows(df: DataFrame, bad: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows that are not flagged."""
    return df.join(bad.select(*on), list(on), "left_anti")


def gradient_impact(norms: DataFrame, norm_col: str = "grad_norm") -> DataFrame:
    """Gradient norm of each row over the largest one."""
    return divide_by_max(norms.withColumn("impact", F.col(norm_col)), ["impact"])


def dimension_attribution(df: DataFrame, scores: DataFrame, cols: Sequence[str]) -> DataFrame:
    """For every failed dimension: population variance of each column over the largest one."""
    wide = df.agg(*[F.var_pop(number(c)).alias(c) for c in cols])
    top = F.greatest(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])
    shares = melt(wide, [], {c: {"attribution": F.when(top > 0, F.col(c) / top).otherwise(0.0)} for c in cols})
    failed = scores.filter(F.col("score") < FAILED_BELOW)
    return failed.crossJoin(F.broadcast(shares)).select(*scores.columns, "col", "attribution")  # one row per column


def localization_findings(summary: DataFrame, scores: DataFrame, key: str = "validation_id") -> DataFrame:
    """Rows (key, kind, value): the share band, the number of failed dimensions, and the action."""
    pct = F.col("problem_pct")
    band = F.when(pct > 20, "regenerate").when(pct > 10, "remove_rows").when(pct > 5, "review").otherwise("acceptable")
    failed = scores.filter(F.col("score") < FAILED_BELOW).groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("value"))
    bands = summary.select(key, band.alias("kind"), pct.cast("double").alias("value"))
    action = summary.filter(F.col("problem_rows") > 0).select(key, F.lit("export_and_remove").alias("kind"), F.col("problem_rows").cast("double").alias("value"))
    return bands.unionByName(failed.select(key, F.lit("failed_dimensions").alias("kind"), "value")).unionByName(action)


# --- regions --------------------------------------------------------------------------------------------


def problem_regions(flagged: DataFrame, row_col: str = "row_id", score_col: str = "impact", gap: int = 1) -> DataFrame:
    """Merge flagged rows at most ``gap`` apart into regions with size and severity.

    Positions, predecessors and the running number of region starts all come from bucketed scans, so the
    flagged rows may be any share of the data.
    """
    rows = flagged.select(F.col(row_col).alias("row_id"), F.col(score_col).cast("double").alias("_score"))
    indexed = with_row_index(rows, ["row_id"], "_i")
    linked = with_previous(indexed, [], "_i", "row_id", "_before")
    starts = linked.withColumn("_new", F.when(F.col("_before").isNull() | (F.col("row_id") - F.col("_before") > gap), 1).otherwise(0))
    numbered = with_running_sums(starts.drop("_before", "_i"), ["row_id"], {"_region": F.col("_new")})
    regions = numbered.groupBy("_region").agg(
        F.min("row_id").alias("row_start"),
        F.max("row_id").alias("row_end"),
        F.count(F.lit(1)).alias("rows"),
        F.avg("_score").alias("mean_impact"),
        F.max("_score").alias("max_impact"),
    )
    level = F.when(F.col("max_impact") > 0.9, "critical").when(F.col("max_impact") > 0.8, "high").otherwise("medium")
    return regions.drop("_region").withColumn("severity", level)


def exact_duplicates(df: DataFrame, cols: Sequence[str], id_col: str) -> DataFrame:
    """Groups of identical rows: hash of the content, copies, first and last id."""
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))
    return groups.filter(F.col("copies") > 1).withColumn("content_hash", F.md5(row_text(cols))).select("content_hash", "copies", "first_id", "last_id")


def entity_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entities that occur more than once after case, space and punctuation are ignored."""
    normal = [F.lower(F.regexp_replace(F.col(k).cast("string"), r"[^\p{L}\p{N}]+", "")).alias(k) for k in keys]
    named = df.select(*normal).filter(" OR ".join(f"`{k}` != ''" for k in keys))
    return named.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def with_region(df: DataFrame, order_cols: Sequence[str], size: int) -> DataFrame:
    """Number rows in order and cut them into regions of ``size`` rows."""
    return with_row_index(df, order_cols).withColumn("region", F.floor(F.col("row_id") / size).cast("long"))


def outlier_density(regioned: DataFrame, cols: Sequence[str], limit_pct: float = 10.0, k: float = 1.5) -> DataFrame:
    """Share of rows per region with a value outside any column's quartile fences."""
    points = quantiles(regioned, cols, {"q25": 0.25, "q75": 0.75})
    fences = {r["col"]: (r["q25"] - k * (r["q75"] - r["q25"]), r["q75"] + k * (r["q75"] - r["q25"])) for r in points.collect()}
    outside = F.lit(False)
    for c in cols:
        low, high = fences[c]
        outside = outside | F.coalesce((number(c) < low) | (number(c) > high), F.lit(False))
    out = regioned.groupBy("region").agg(
        F.min("row_id").alias("row_start"),
        F.max("row_id").alias("row_end"),
        (100.0 * F.count_if(outside) / F.count(F.lit(1))).alias("outlier_pct"),
    )
    return out.withColumn("flagged", F.col("outlier_pct") > limit_pct)


def correlation_inconsistency(regioned: DataFrame, cols: Sequence[str], limit: float = 0.3) -> DataFrame:
    """Per region: largest gap between its correlations and the global ones."""
    whole = correlation_matrix(regioned, cols).select("col_a", "col_b", F.col("r").alias("_global"))
    local = correlation_matrix(regioned, cols, ["region"])
    both = local.join(F.broadcast(whole), ["col_a", "col_b"])  # one row per column pair
    gap = F.abs(F.coalesce(F.col("r"), F.lit(0.0)) - F.coalesce(F.col("_global"), F.lit(0.0)))
    out = both.groupBy("region").agg(F.max(gap).alias("max_gap"))
    return out.withColumn("flagged", F.col("max_gap") > limit)


def ablate(pair: DataFrame, cols: Sequence[str], region_col: str = "region", bins: int = 50) -> DataFrame:
    """Histogram intersection of the pair with each synthetic region left out in turn.

    Counts per region on fixed edges are subtracted from the totals: one scan for all regions, and no
    region is ever rebuilt as a dataset.
    """
    cut = binned(pair, cols, column_ranges(pair, cols, []), [], bins)
    rows = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"_bin_{c}").alias("bin")) for c in cols])
    cells = cut.select("side", F.col(region_col).alias("region"), F.inline(rows)).filter(F.col("bin").isNotNull())
    by_region = cells.filter(F.col("side") == "syn").groupBy("region", "col", "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("col", "bin").agg(F.count_if(F.col("side") == "syn").alias("cs"), F.count_if(F.col("side") == "orig").alias("co"))
    sums = totals.groupBy("col").agg(F.sum("cs").alias("ts"), F.sum("co").alias("to"))
    base = totals.join(sums, "col")  # columns x bins rows
    before = base.groupBy("col").agg(F.sum(F.least(F.col("cs") / F.col("ts"), F.col("co") / F.col("to"))).alias("_x"))
    before = before.agg((100.0 * F.avg("_x")).alias("before"))
    sizes = by_region.groupBy("region", "col").agg(F.sum("n").alias("rn"))
    grid = sizes.join(F.broadcast(base), "col")  # every region against at most columns x bins cells
    left = grid.join(by_region, ["region", "col", "bin"], "left")
    share = F.try_divide(F.col("cs") - F.coalesce("n", F.lit(0)), F.col("ts") - F.col("rn"))
    per_col = left.groupBy("region", "col").agg(F.sum(F.least(F.coalesce(share, F.lit(0.0)), F.col("co") / F.col("to"))).alias("_x"))
    after = per_col.groupBy("region").agg((100.0 * F.avg("_x")).alias("after"))
    out = after.crossJoin(F.broadcast(before))  # one row
    return out.withColumn("improvement", F.col("after") - F.col("before")).withColumn("confirmed", F.col("improvement") > 0)


def root_causes(counts: DataFrame) -> DataFrame:
    """Share of each cause among all flagged rows: cause, rows, pct."""
    total = counts.agg(F.sum("rows").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(  # one row
        "cause", "rows", F.coalesce(F.try_divide(100.0 * F.col("rows"), F.col("_total")), F.lit(0.0)).alias("pct")
    )
