"""Pearson and rank correlation, and how well one dataset keeps another's correlation structure."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import checked_small, number, numeric_columns, safe_corr, wide_aggregate
from .materialise import materialise
from .ordered import ranked_values

# Fixed value: correlation preservation passes at this score.
CORRELATION_THRESHOLD = 70.0


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None, keys: Sequence[str] = (), max_pairs: int = 15) -> DataFrame:
    """Upper triangle in long form: keys, col_a, col_b, r. Each pair skips rows where either value is missing.

    Few pairs use built-in ``corr`` aggregates inside generated code. More pairs would leave generated code,
    so they use per-batch matrix products whose partial sums are added by Spark, in one scan.
    """
    cols = numeric_columns(df, cols, exclude=keys)
    pairs = list(combinations(cols, 2))
    if len(pairs) > max_pairs:
        return _block_correlation(df, cols, keys)
    exprs = [safe_corr(number(a), number(b)).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)]
    wide = wide_aggregate(df, keys, exprs)
    rows = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"_r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return wide.select(*keys, F.inline(F.array(*rows)))


def _block_correlation(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    d = len(cols)
    # any constant near the data keeps the products small; the result does not depend on it
    centre = df.agg(*[F.coalesce(F.avg(number(c)), F.lit(0.0)).alias(c) for c in cols]).head()
    shift = np.array([centre[c] for c in cols])
    upper_a, upper_b = np.triu_indices(d, k=1)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]
            for key, part in groups:
                x = part[list(cols)].to_numpy(dtype=float) - shift
                seen = ~np.isnan(x)
                x0, m = np.where(seen, x, 0.0), seen.astype(float)
                full = [m.T @ m, x0.T @ m, m.T @ x0, (x0 * x0).T @ m, m.T @ (x0 * x0), x0.T @ x0]
                flat = np.concatenate([f[upper_a, upper_b] for f in full])
                key = key if isinstance(key, tuple) else (key,)
                yield pd.DataFrame([[*key, flat.tolist()]], columns=[*keys, "sums"])

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "sums array<double>"])
    partial = df.select(*keys, *[number(c).alias(c) for c in cols]).mapInPandas(products, schema)
    pairs = len(upper_a)
    long = partial.select(*keys, F.posexplode("sums").alias("_i", "_v")).groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"))
    part = (F.col("_i") / pairs).cast("int")
    by_pair = long.groupBy(*keys, (F.col("_i") % pairs).alias("_p")).agg(
        *[F.sum(F.when(part == i, F.col("_v"))).alias(f"s{i}") for i in range(6)]
    )
    n, sx, sy, sxx, syy, sxy = [F.col(f"s{i}") for i in range(6)]
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    r = F.when((vx > 0) & (vy > 0), (n * sxy - sx * sy) / F.sqrt(vx) / F.sqrt(vy))
    names = F.array(*[F.struct(F.lit(cols[a]).alias("a"), F.lit(cols[b]).alias("b")) for a, b in zip(upper_a, upper_b)])
    return by_pair.withColumn("_n", F.element_at(names, F.col("_p") + 1)).select(
        *keys, F.col("_n.a").alias("col_a"), F.col("_n.b").alias("col_b"), r.alias("r")
    )


def correlation_pairs(df: DataFrame, cols: Sequence[str] | None = None, min_abs: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs whose |r| reaches the limit."""
    return correlation_matrix(df, cols, keys).filter(F.abs(F.col("r")) >= min_abs)


def mid_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace every value by its average rank.

    Ranks of distinct values are broadcast when their number is checked to be small. Otherwise the values
    shared by many rows are few by construction and are broadcast, and the rest joins without hot keys.
    """
    # read once per column, so it is written once
    ranked = materialise(ranked_values(df, cols).select(
        "col", "value", "n", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias("_rank")
    ))
    out = df.select(*[number(c).alias(c) for c in cols])
    for c in cols:
        ranks = ranked.filter(F.col("col") == c).select(F.col("value").alias(c), "n", F.col("_rank").alias(f"_rank_{c}"))
        local = checked_small(ranks)
        if local is not None:
            out = out.join(F.broadcast(local.drop("n")), c, "left")
            continue
        total = df.count()
        # at most 10 000 values can each hold more than 1/10 000 of the rows
        frequent = checked_small(ranks.filter(F.col("n") > total / 10_000.0).drop("n").withColumnRenamed(f"_rank_{c}", "_hot"), 10_000)
        out = out.join(F.broadcast(frequent), c, "left")
        key = F.when(F.col("_hot").isNull(), F.col(c))
        rest = ranks.filter(F.col("n") <= total / 10_000.0).drop("n").withColumnRenamed(c, "_join")
        salted = out.withColumn("_join", key)
        cold = salted.filter(F.col("_hot").isNull()).join(rest, "_join", "left")
        hot = salted.filter(F.col("_hot").isNotNull()).withColumn(f"_rank_{c}", F.col("_hot"))
        out = hot.unionByName(cold.select(*hot.columns)).drop("_hot", "_join")
    return out.select(*[F.col(f"_rank_{c}").alias(c) for c in cols])


def spearman_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of average ranks."""
    cols = numeric_columns(df, cols)
    return correlation_matrix(mid_ranks(df, cols), cols)


# --- comparison of two sides ----------------------------------------------------------------------------


def correlation_sides(pair: DataFrame, cols: Sequence[str], key: str = "validation_id") -> DataFrame:
    """r of both sides per column pair: key, col_a, col_b, r_s, r_o (undefined correlations read as 0)."""
    long = correlation_matrix(pair, cols, [key, "side"])
    r = F.coalesce(F.when(~F.isnan("r"), F.col("r")), F.lit(0.0))
    return long.groupBy(key, "col_a", "col_b").agg(
        F.max(F.when(F.col("side") == "syn", r)).alias("r_s"), F.max(F.when(F.col("side") == "orig", r)).alias("r_o")
    )


def constant_columns(pair: DataFrame, cols: Sequence[str], key: str = "validation_id") -> DataFrame:
    """Squared diagonal terms: a constant column has no correlation with itself (0 instead of 1)."""
    differs = [
        F.when(F.stddev_pop(F.when(F.col("side") == "syn", number(c))) > 0, 1.0).otherwise(0.0)
        - F.when(F.stddev_pop(F.when(F.col("side") == "orig", number(c))) > 0, 1.0).otherwise(0.0)
        for c in cols
    ]
    live = sum((F.when(F.stddev_pop(F.when(F.col("side") == "orig", number(c))) > 0, 1.0).otherwise(0.0) for c in cols), F.lit(0.0))
    return pair.groupBy(key).agg(
        sum((x * x for x in differs), F.lit(0.0)).alias("diag_diff"), live.alias("diag_orig")
    )


def frobenius_similarity(sides: DataFrame, diagonal: DataFrame, key: str = "validation_id") -> DataFrame:
    """100 x (1 - min(1, |C_s - C_o| / |C_o|)), full matrices including the diagonal."""
    sums = sides.groupBy(key).agg(
        (2 * F.sum((F.col("r_s") - F.col("r_o")) ** 2)).alias("_d"), (2 * F.sum(F.col("r_o") ** 2)).alias("_o")
    )
    both = sums.join(diagonal, key)
    ratio = F.sqrt(F.col("_d") + F.col("diag_diff")) / (F.sqrt(F.col("_o") + F.col("diag_orig")) + 1e-8)
    return both.select(key, (100.0 * (1.0 - F.least(F.lit(1.0), ratio))).alias("frobenius_similarity"))


def corr_of_corr(sides: DataFrame, key: str = "validation_id") -> DataFrame:
    """Pearson correlation of the two upper triangles, mapped to 0..100; a single pair scores 100."""
    flat = (F.stddev_pop("r_s") < 1e-9) | (F.stddev_pop("r_o") < 1e-9)
    r = safe_corr(F.col("r_s"), F.col("r_o"))
    r = F.when(flat | r.isNull() | F.isnan(r), 0.0).otherwise(r)
    score = F.when(F.count(F.lit(1)) <= 1, 100.0).otherwise((r + 1.0) / 2.0 * 100.0)
    return sides.groupBy(key).agg(score.alias("corr_of_corr"))


def top_correlations_preserved(sides: DataFrame, key: str = "validation_id") -> DataFrame:
    """Overlap of the k strongest pairs of both sides, k = max(10, pairs / 10); up to ten pairs score 100."""
    by_s = Window.partitionBy(key).orderBy(F.desc(F.abs("r_s")), "col_a", "col_b")  # at most d(d-1)/2 rows
    by_o = Window.partitionBy(key).orderBy(F.desc(F.abs("r_o")), "col_a", "col_b")
    m = F.count(F.lit(1)).over(Window.partitionBy(key))
    ranked = sides.select(key, F.row_number().over(by_s).alias("_s"), F.row_number().over(by_o).alias("_o"), m.alias("_m"))
    k = F.greatest(F.lit(10), F.floor(F.col("_m") / 10))
    marked = ranked.withColumn("_k", k).withColumn("_hit", (F.col("_s") <= k) & (F.col("_o") <= k))
    score = F.when(F.first("_m") <= 10, 100.0).otherwise(100.0 * F.count_if("_hit") / F.first("_k"))
    return marked.groupBy(key).agg(score.alias("top_correlations_preserved"))


def correlation_preservation(pair: DataFrame, cols: Sequence[str], key: str = "validation_id") -> DataFrame:
    """0.4 Frobenius + 0.4 correlation of correlations + 0.2 top pairs."""
    sides = correlation_sides(pair, cols, key)
    parts = (
        frobenius_similarity(sides, constant_columns(pair, cols, key), key)
        .join(corr_of_corr(sides, key), key)
        .join(top_correlations_preserved(sides, key), key)
    )
    score = 0.4 * F.col("frobenius_similarity") + 0.4 * F.col("corr_of_corr") + 0.2 * F.col("top_correlations_preserved")
    return parts.withColumn("score", score).withColumn("passed", F.col("score") >= CORRELATION_THRESHOLD)
