"""How well a classifier tells the two sides apart: random forests of all validations, grown together by grouped aggregates."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .compare import KEY
from .common import lookup_join, same_key_join
from .materialise import written
from .sampling import balanced_sample, unit_hash

# Forest shape, split, row limit per side, weights and threshold.
TREES, DEPTH = 10, 5
TEST_SHARE = 0.3
ROWS_PER_SIDE = 10_000
GAP_THRESHOLD = 75.0
#: Value ranges per column between which a tree can split.
BINS = 32
#: Room for the nodes of a tree, numbered from 1; forests that may be broadcast.
NODES = 2 << DEPTH
BROADCAST_FORESTS = 2000
#: Chances that a row is drawn at most 0, 1, 2, ... times for a tree (Poisson with mean 1).
DRAWN = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]


def drawn(tree: Column, digest: Column) -> Column:
    """How often a tree learns from a row, by a hash of both."""
    u = F.pmod(F.xxhash64(tree, digest), F.lit(1 << 30)) / float(1 << 30)
    return sum(((u >= limit).cast("int") for limit in DRAWN), F.lit(0))


def leaf(bins: Column, splits: Column, tree: Column, depth: int) -> Column:
    """The node (root 1, children 2n and 2n + 1) of ``tree`` that a row of ``bins`` reaches after ``depth`` levels of ``splits``, an
    array of struct(column, cut) by tree and node; where a node is not split, its left child."""

    def step(node):
        split = F.get(splits, tree * NODES + node)
        return node * 2 + F.coalesce((F.get(bins, split["column"]) > split["cut"]).cast("int"), F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), lambda node, _: step(node)) if depth else F.lit(1)


def column_cuts(rows: DataFrame, columns: int) -> DataFrame:
    """Per validation the quantiles of every column of the taught rows."""
    points = ", ".join(repr(k / BINS) for k in range(1, BINS))
    return rows.filter("NOT test").groupBy(KEY).agg(*[F.expr(f"percentile(x[{i}], array({points}))").alias(f"_q{i}") for i in range(columns)])


def allowed_columns(columns: int) -> Column:
    """About sqrt(columns) columns that a node of a tree may split by: fixed draws, looked up by tree and node."""
    count = math.ceil(columns**0.5)
    rng = random.Random(42)
    draws = [sorted(rng.sample(range(columns), count)) for _ in range(TREES * NODES)]
    text = ", ".join(f"array({', '.join(map(str, d))})" for d in draws)
    return F.expr(f"get(array({text}), tree * {NODES} + node)")


def best_splits(counts: DataFrame) -> DataFrame:
    """validation, tree, node, column, cut: the split of every node with the greatest fall of Gini impurity.

    ``counts`` has one row (n, ones) per validation, tree, node, column and bin; ties go to the lower column and cut.
    """
    place = Window.partitionBy(KEY, "tree", "node", "column")
    upto = place.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.select("*", F.sum("n").over(upto).alias("left"), F.sum("ones").over(upto).alias("left_ones"), F.sum("n").over(place).alias("all"), F.sum("ones").over(place).alias("all_ones"))
    purity = lambda k, m: k * (m - k) / m.cast("double")
    rest, rest_ones = F.col("all") - F.col("left"), F.col("all_ones") - F.col("left_ones")
    gains = sums.filter("left < all").withColumn("gain", purity(F.col("all_ones"), F.col("all")) - purity(F.col("left_ones"), F.col("left")) - purity(rest_ones, rest))
    best = gains.filter("gain > 1e-9").groupBy(KEY, "tree", "node").agg(F.min(F.struct((-F.round("gain", 9)).alias("loss"), "column", "bin")).alias("best"))
    return best.select(KEY, "tree", "node", F.col("best.column").alias("column"), F.col("best.bin").alias("cut"))


def by_node(rows: DataFrame, keys: DataFrame, name: str, value: Column) -> DataFrame:
    """One row per validation: array ``name`` of ``value`` by tree and node, null where ``rows`` has none."""
    grid = keys.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(TREES * NODES - 1))))
    filled = same_key_join(grid, rows.select(KEY, (F.col("tree") * NODES + F.col("node")).alias("at"), value.alias("value")), [KEY, "at"], "left")
    return filled.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda v: v["value"]).alias(name))


def with_forest(rows: DataFrame, forests: DataFrame) -> DataFrame:
    """``rows`` beside their validation's forest (about 10 KB), broadcast if there are few."""
    forests = written(forests)
    return same_key_join(rows, F.broadcast(forests) if forests.count() <= BROADCAST_FORESTS else forests, [KEY])


def grown_forests(taught: DataFrame, columns: int) -> DataFrame:
    """One row per validation: ``splits`` and ``shares`` (of label 1), arrays by tree and node.

    ``taught`` has validation, digest, label and bins. All nodes of a level of all trees of all validations are split by one
    grouped count over (tree, node, column, bin), at most TREES * 2 ** level * sqrt(columns) * BINS groups a validation.
    """
    keys = written(taught.select(KEY).distinct())
    each = taught.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).withColumn("w", drawn(F.col("tree"), F.col("digest")))
    each = written(each.filter("w > 0").select(KEY, "tree", "w", "label", "bins"))
    split = F.struct("column", "cut")
    splits, rows, allowed = None, each.withColumn("node", F.lit(1)), allowed_columns(columns)
    for level in range(DEPTH):
        cells = rows.withColumn("column", F.explode(allowed)).withColumn("bin", F.get("bins", F.col("column")))
        counts = cells.groupBy(KEY, "tree", "node", "column", "bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("label")).alias("ones"))
        found = best_splits(counts)
        splits = written(found if splits is None else splits.unionByName(found))
        rows = with_forest(each, by_node(splits, keys, "splits", split)).withColumn("node", leaf(F.col("bins"), F.col("splits"), F.col("tree"), level + 1)).drop("splits")
    leaves = rows.groupBy(KEY, "tree", "node").agg((F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias("share"))
    return same_key_join(by_node(splits, keys, "splits", split), by_node(leaves, keys, "shares", F.col("share")), [KEY])


def votes() -> Column:
    """Mean share of label 1 over the trees beside a row; a leaf that no taught row reached says 0.5."""

    def vote(tree):
        at = tree * NODES + leaf(F.col("bins"), F.col("splits"), tree, DEPTH)
        return F.coalesce(F.get("shares", at), F.lit(0.5))

    return F.aggregate(F.sequence(F.lit(0), F.lit(TREES - 1)), F.lit(0.0), lambda total, tree: total + vote(tree)) / float(TREES)


def distinguishability(pair: DataFrame, cols: Sequence[str], id_cols: Sequence[str], rows_per_side: int = ROWS_PER_SIDE) -> DataFrame:
    """Train and test accuracy of a random forest on balanced samples, per validation.

    A forest learns from at most ``rows_per_side`` rows a side; the forests of all validations grow level by level in the same
    grouped aggregates, so no validation is a task of its own. Columns are cut at quantiles of the taught rows; draws of rows
    and columns come from hashes, so reruns agree. Missing values count as zero. Without rows on either side of the split, or
    without columns, accuracy is 0.5.
    """
    cols = list(cols)
    sample = balanced_sample(pair, rows_per_side, id_cols, [KEY])
    value = lambda c: F.when(F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) < float("inf"), F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    # a second digest decides the split, so it does not depend on which rows were sampled
    digest = F.md5(F.concat(F.lit("split"), F.col("_h"), F.col("side")))
    rows = written(sample.select(
        KEY, F.concat("_h", "side").alias("digest"), F.when(F.col("side") == "syn", 0).otherwise(1).alias("label"), (unit_hash(digest) < TEST_SHARE).alias("test"),
        F.array(*[value(c) for c in cols]).cast("array<double>").alias("x"),
    ))
    known = rows.select(KEY).distinct()
    if not cols:
        half = F.lit(0.5)
        return known.select(KEY, half.alias("train_accuracy"), half.alias("test_accuracy"), F.lit(0.0).alias("distinguishability"))
    cuts = written(column_cuts(rows, len(cols)))
    binned = lookup_join(rows, cuts, [KEY])
    below = lambda i: F.size(F.filter(f"_q{i}", lambda q: q < F.element_at("x", i + 1)))
    bins = [below(i) for i in range(len(cols))]
    ready = written(binned.select(KEY, "digest", "label", "test", F.array(*bins).alias("bins")))
    judged = with_forest(ready, grown_forests(ready.filter("NOT test"), len(cols))).withColumn("hit", (votes() > 0.5) == (F.col("label") == 1))
    hits = judged.groupBy(KEY).agg(*[F.avg(F.when(F.col("test") == part, F.col("hit").cast("double"))).alias(name) for name, part in (("train_accuracy", False), ("test_accuracy", True))])
    # a validation without taught rows has no forest
    return known.join(hits.withColumnRenamed(KEY, "_key"), F.col(KEY).eqNullSafe(F.col("_key")), "left").select(
        KEY, F.coalesce("train_accuracy", F.lit(0.5)).alias("train_accuracy"), F.coalesce("test_accuracy", F.lit(0.5)).alias("test_accuracy"),
    ).withColumn("distinguishability", (F.col("test_accuracy") - 0.5) * 2.0)


def generalization_gap(accuracies: DataFrame) -> DataFrame:
    """0.7 indistinguishability + 0.3 train-test agreement."""
    apart = (1.0 - F.col("distinguishability")) * 100.0
    gap = F.abs(F.col("train_accuracy") - F.col("test_accuracy"))
    steady = 100.0 * (1.0 - F.least(F.lit(1.0), gap * 10.0))
    return accuracies.withColumn("indistinguishability_score", apart).withColumn("gap_score", steady).withColumn(
        "score", 0.7 * apart + 0.3 * steady
    ).withColumn("passed", F.col("score") >= GAP_THRESHOLD)
