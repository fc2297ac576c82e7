"""Reproducible samples: hash order instead of a random generator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import lookup_join, number, numeric_columns, row_text, same_key_join
from .ordered import default_buckets, quantiles


def hash_key(id_cols: Sequence[str], seed: int = 42) -> Column:
    """A stable random-looking order of rows: md5 of the identifying columns and the seed."""
    return F.md5(F.concat_ws("|", row_text(id_cols), F.lit(str(seed))))


def unit_hash(digest: Column) -> Column:
    """Uniform number in [0, 1) from the leading hex digits, ordered like the digest."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def lowest_hashes(df: DataFrame, keys: Sequence[str], quota: Column, sizes: DataFrame, digest: str = "_h") -> DataFrame:
    """Exactly ``quota`` rows per key with the lowest digest.

    Rows are counted per digest range: fine ranges up to the point where uniform digests fill the quota, doubling
    ranges beyond it. Only rows of ranges that start below the quota are numbered, so with distinct digests the ordered
    step handles about the sample, not the group, and with repeated ones the sample is still whole. Rows of one digest
    are ordered by a hash of all their columns.
    """
    margin = F.least(F.lit(1.0), (quota + 10.0 * F.sqrt(quota) + 50.0) / F.col("_size"))
    slots = default_buckets(df)
    place = unit_hash(F.col(digest)) / margin
    slot = F.when(place < 1, F.floor(place * slots)).otherwise(slots + F.floor(F.log2(F.greatest(place, F.lit(1.0))))).cast("int")
    cut = lookup_join(df, sizes, keys).withColumn("_slot", slot)
    # number the kept rows inside digest ranges, then shift by the sizes of the earlier ranges
    per_slot = cut.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"), F.first(quota).alias("_limit"))
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slot.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_start") < F.col("_limit"))
    near = lookup_join(cut, starts.select(*keys, "_slot", "_start"), [*keys, "_slot"])
    every = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    inside = Window.partitionBy(*keys, "_slot").orderBy(digest, F.xxhash64(*every))
    ranked = near.withColumn("_pos", F.row_number().over(inside))
    return ranked.filter(F.col("_start") + F.col("_pos") <= quota).drop("_slot", "_start", "_pos")


def random_cap(df: DataFrame, n: int, id_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows without replacement (all rows if there are fewer)."""
    sizes = df.agg(F.count(F.lit(1)).alias("_size"))
    hashed = df.withColumn("_h", hash_key(id_cols, seed))
    return lowest_hashes(hashed, [], F.lit(float(n)), sizes).select(*df.columns)


def balanced_sample(pair: DataFrame, n: int, id_cols: Sequence[str], keys: Sequence[str], seed: int = 42) -> DataFrame:
    """The same number of rows, at most ``n``, from each side of every pair, with the digest kept as ``_h``."""
    hashed = pair.withColumn("_h", hash_key(id_cols, seed))
    sizes = pair.groupBy(*keys, "side").agg(F.count(F.lit(1)).alias("_size"))
    smallest = sizes.groupBy(*keys).agg(F.least(F.min("_size"), F.lit(n)).cast("double").alias("_quota"))
    quotas = same_key_join(sizes, smallest, keys) if keys else sizes.crossJoin(F.broadcast(smallest))
    return lowest_hashes(hashed, [*keys, "side"], F.col("_quota"), quotas).drop("_size", "_quota")


def auto_strata(df: DataFrame, limit: int = 3) -> DataFrame:
    """Columns fit for stratification: text with 2..100 values, numbers with up to 50; closest to ten first.

    Distinct counts are needed only up to 100, so each column keeps a bounded set while scanning:
    an approximate count decides first and only the survivors are counted exactly.
    """
    kinds = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema.fields}
    wanted = [c for c, t in kinds.items() if t or isinstance(df.schema[c].dataType, T.StringType)]
    rough = df.agg(*[F.approx_count_distinct(c, 0.05).alias(c) for c in wanted]).head()
    low = [c for c in wanted if rough[c] <= 200]
    rows = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in low])
    order = {c: i for i, c in enumerate(df.columns)}
    counts = (
        df.select(F.inline(rows)).filter(F.col("value").isNotNull()).groupBy("col", "value").agg(F.lit(1).alias("_one"))
        .groupBy("col").agg(F.count(F.lit(1)).alias("unique"))
    )
    numeric = F.col("col").isin([c for c in low if kinds[c]] or [""])
    place = F.create_map(*[x for c in low for x in (F.lit(c), F.lit(order[c]))])
    fit = counts.filter((numeric & (F.col("unique") <= 50)) | (~numeric & F.col("unique").between(2, 100)))
    ranked = fit.withColumn("_d", F.abs(F.col("unique") - 10)).withColumn("_p", place[F.col("col")])
    return ranked.orderBy("_d", "_p").limit(limit).select("col", "unique")


def adaptive_bins(df: DataFrame, cols: Sequence[str], bins: int = 50) -> DataFrame:
    """Quantile edges of numeric columns and distinct values of the others: col, position, edge, value."""
    numeric = numeric_columns(df.select(*cols))
    probs = {f"_q{i}": i / (bins - 1) for i in range(bins)}
    parts = []
    if numeric:
        wide = quantiles(df, numeric, probs)
        rows = F.array(*[F.struct(F.lit(i).alias("position"), F.col(f"_q{i}").alias("edge")) for i in range(bins)])
        parts.append(wide.select("col", F.inline(rows)).withColumn("value", F.lit(None).cast("string")))
    for c in cols:
        if c not in numeric:
            values = df.select(F.col(c).alias("value")).distinct()
            parts.append(values.select(
                F.lit(c).alias("col"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("double").alias("edge"), "value"
            ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_numeric_bins(df: DataFrame, cols: Sequence[str], bins: int = 50) -> DataFrame:
    """Add ``c_bin`` for numeric columns from their quantile edges, to stratify by value range."""
    from .ordered import bucketize, quantile_edges

    numeric = numeric_columns(df.select(*cols))
    edges = quantile_edges(df, {c: number(c) for c in numeric}, bins)
    prepared = df.select("*", *[number(c).alias(f"_v_{c}") for c in numeric])
    cut = bucketize(prepared, {f"_v_{c}": f"{c}_bin" for c in numeric}, {f"_v_{c}": edges[c][0] for c in numeric})
    return cut.drop(*[f"_v_{c}" for c in numeric])


def stratified_sample(df: DataFrame, keys: Sequence[str], target: int, id_cols: Sequence[str], seed: int = 42, bin_numeric: bool = False) -> DataFrame:
    """Proportional sample: round-half-even(fraction x size) rows per stratum, singletons kept, then cut to ``target``.

    Rows with a missing key belong to no stratum and are left out.
    """
    columns = df.columns
    if bin_numeric:
        df = with_numeric_bins(df, keys)
        numeric = numeric_columns(df.select(*keys))
        keys = [f"{c}_bin" if c in numeric else c for c in keys]
    total = df.count()
    keyed = df.dropna(subset=list(keys)).withColumn("_h", hash_key(id_cols, seed))
    sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    fraction = target / total if total else 0.0
    quota = F.when(F.col("_size") == 1, 1.0).otherwise(F.bround(F.lit(fraction) * F.col("_size"), 0)).cast("double")
    sizes = sizes.withColumn("_quota", F.least(quota, F.col("_size").cast("double")))
    picked = lowest_hashes(keyed, keys, F.col("_quota"), sizes).select(*columns, "_h")
    # rounding exceeds the target by at most one row per stratum; the surplus with the largest digests goes
    surplus = picked.agg(F.count(F.lit(1)).alias("_size"))
    return lowest_hashes(picked, [], F.lit(float(target)), surplus).select(*columns)


def sample_info(sample: DataFrame, full: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sizes, sampled share and number of strata."""
    n = full.agg(F.count(F.lit(1)).alias("original_size"))
    s = sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("sample_size"), F.count(F.lit(1)).alias("strata")
    )
    both = n.crossJoin(F.broadcast(s))  # one row each
    return both.withColumn("sample_fraction", F.try_divide("sample_size", "original_size"))


def temporal_balance(df: DataFrame, time_col: str, period: str, per_period: int, id_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """The same number of rows from every period."""
    cut = df.withColumn("period", F.date_trunc(period, F.col(time_col))).withColumn("_h", hash_key(id_cols, seed))
    sizes = cut.groupBy("period").agg(F.count(F.lit(1)).alias("_size"))
    return lowest_hashes(cut, ["period"], F.lit(float(per_period)), sizes).drop("_h", "_size")


def diversity_sample(
    df: DataFrame,
    cluster_col: str,
    target: int,
    id_cols: Sequence[str],
    rare_cols: Sequence[str],
    value_cols: Sequence[str],
    rare_threshold: float = 0.01,
    rare_factor: int = 3,
    outlier_share: float = 0.001,
) -> DataFrame:
    """Cluster-proportional rows, plus rare combinations repeated, plus the most extreme rows, tagged by origin."""
    from .profile import pattern_counts

    base = stratified_sample(df, [cluster_col], target, id_cols).withColumn("origin", F.lit("cluster"))
    rare = pattern_counts(df, rare_cols).filter(F.col("share") < rare_threshold).select(*rare_cols)
    # rare combinations hold few rows each, so this join has no hot key
    extra = df.join(rare, list(rare_cols), "left_semi").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(rare_factor))))
    stats = df.agg(*[f(number(c)).alias(f"_{p}_{c}") for c in value_cols for p, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = [F.abs(number(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-6) for c in value_cols]
    score = F.greatest(*z) if len(z) > 1 else z[0]
    scored = df.crossJoin(F.broadcast(stats)).withColumn("_z", score)  # one row of statistics
    limit = quantiles(scored, ["_z"], {"_cut": 1.0 - outlier_share}).select("_cut")
    extreme = scored.crossJoin(F.broadcast(limit)).filter(F.col("_z") > F.col("_cut"))
    return base.unionByName(
        extra.select(*df.columns, F.lit("rare").alias("origin"))
    ).unionByName(extreme.select(*df.columns, F.lit("outlier").alias("origin")))
