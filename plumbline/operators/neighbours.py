"""Distances to the k nearest rows among all rows of a table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import spread, wide_aggregate
from .materialise import materialise
from .pairs import finite

# Points of a cell, and the most cells the driver keeps boxes of; beyond it cells hold more points.
CELL_POINTS = 4_096
MAX_CELLS = 4_096
SAMPLED_PER_CELL = 16
# Points of a block inside a task, and questions that one task answers about a cell.
BLOCK = 128
QUESTIONS = 20_000
# Copies of one point beyond this many are dealt over tasks when the result returns to the rows.
HOT_ROWS = 10_000
SALTS = 1_024


def cut_tree(x: np.ndarray, size: int) -> list[tuple[int, float, int, int]]:
    """Nodes (column, cut, below, not below) that halve the widest column down to ``size`` points; a leaf is (-1, 0, cell, 0)."""
    nodes: list = [None]
    todo, cells = [(0, np.arange(len(x)))], 0
    while todo:
        at, own = todo.pop()
        part = x[own]
        wide = np.ptp(part, axis=0) if len(own) else np.zeros(x.shape[1])
        c = int(np.argmax(wide))
        if len(own) <= size or not wide[c] > 0:
            nodes[at] = (-1, 0.0, cells, 0)
            cells += 1
            continue
        values = part[:, c]
        cut = np.partition(values, len(values) // 2)[len(values) // 2]
        if cut == values.min():
            cut = values[values > cut].min()
        nodes[at] = (c, float(cut), len(nodes), len(nodes) + 1)
        todo += [(len(nodes), own[values < cut]), (len(nodes) + 1, own[values >= cut])]
        nodes += [None, None]
    return nodes


def cell_of(nodes, x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int32)
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, own = todo.pop()
        c, cut, low, high = nodes[at]
        if c < 0:
            out[own] = low
        elif len(own):
            below = x[own, c] < cut
            todo += [(low, own[below]), (high, own[~below])]
    return out


def blocks(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Indices of at most ``size`` points each, by halving the widest column."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(own)
            continue
        c = int(np.argmax(np.ptp(x[own], axis=0)))
        order = np.argpartition(x[own, c], len(own) // 2)
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return out


def gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every box."""
    out = np.zeros((len(x), len(low)))
    for c in range(x.shape[1]):
        v = x[:, c, None]
        out += np.maximum(np.maximum(low[:, c] - v, v - high[:, c]), 0.0) ** 2
    return out


def reaches(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every point to the furthest corner of every box."""
    out = np.zeros((len(x), len(low)))
    for c in range(x.shape[1]):
        v = x[:, c, None]
        out += np.maximum(np.abs(low[:, c] - v), np.abs(high[:, c] - v)) ** 2
    return out


def nearest(points: np.ndarray, weights: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
    """Ascending squared distances of every asked point to its k nearest points, infinite where there are fewer; a point counts ``weights`` times."""
    out = np.full((len(asked), k), np.inf)
    if not len(points):
        return out
    plain = int(weights.max()) == 1
    stored = blocks(points, BLOCK)
    low, high = np.stack([points[b].min(axis=0) for b in stored]), np.stack([points[b].max(axis=0) for b in stored])
    for own in blocks(asked, BLOCK):
        if not len(own):
            continue
        x, best, times = asked[own], np.full((len(own), k), np.inf), np.ones((len(own), k), int)
        apart, radius = gaps(x, low, high), np.full(len(own), np.inf)
        closest = apart.min(axis=0)
        for b in np.argsort(closest, kind="stable"):
            if closest[b] > radius.max() * (1 + 1e-9):
                break
            rows = np.flatnonzero(apart[:, b] <= radius * (1 + 1e-9))
            if not len(rows):
                continue
            there, w = points[stored[b]], weights[stored[b]]
            d2 = np.zeros((len(rows), len(there)))
            for c in range(x.shape[1]):
                d2 += (x[rows, c, None] - there[None, :, c]) ** 2
            if plain:
                near = np.partition(d2, k - 1, axis=1)[:, :k] if d2.shape[1] > k else d2
                best[rows] = np.sort(np.concatenate([best[rows], near], axis=1), axis=1)[:, :k]
                radius[rows] = best[rows, -1]
                continue
            near = np.argpartition(d2, k - 1, axis=1)[:, :k] if d2.shape[1] > k else np.broadcast_to(np.arange(d2.shape[1]), d2.shape)
            both = np.concatenate([best[rows], np.take_along_axis(d2, near, axis=1)], axis=1)
            count = np.concatenate([times[rows], w[near]], axis=1)
            order = np.argsort(both, axis=1, kind="stable")[:, :k]
            best[rows], times[rows] = np.take_along_axis(both, order, axis=1), np.take_along_axis(count, order, axis=1)
            enough = np.argmax(np.cumsum(times[rows], axis=1) >= k, axis=1)  # k points are always enough, at worst infinite ones
            radius[rows] = best[rows, enough]
        if not plain:
            at = (np.cumsum(times, axis=1)[:, :, None] <= np.arange(k)).sum(axis=1)
            best = np.take_along_axis(best, at, axis=1)
        out[own] = best
    return out


def with_neighbour_distance(df: DataFrame, cols: Sequence[str], k: int, out: str) -> DataFrame:
    """Mean distance of every row to its ``k`` nearest other rows, in ``out``; infinite for a single row.

    Equal rows are one point with a count. Points are dealt to cells (boxes of about equal size, cut at a sample); each is
    compared with its own cell, and then with every cell whose box is nearer than its k-th neighbour so far, so the result
    is exact. Questions to one cell are dealt over tasks. Missing values count as zero.
    """
    spark = df.sparkSession
    names = [f"_x{i}" for i in range(len(cols))]
    columns = ", ".join(f"{c} double" for c in names)
    source = spread(df)
    rows = source.select(*source.columns, *[finite(F.col(c)).alias(n) for c, n in zip(cols, names)])
    want = k + 1  # the row itself is among its nearest, at distance zero
    counted = materialise(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies")))
    points = counted.select(*names, F.least("_copies", F.lit(want)).cast("int").alias("_w"), F.monotonically_increasing_id().alias("_p"))
    total = counted.count()
    cells = max(1, min(MAX_CELLS, -(-total // CELL_POINTS)))
    share = min(1.0, SAMPLED_PER_CELL * cells / max(1, total))
    picked = points.filter(F.pmod(F.xxhash64(*names), F.lit(1 << 30)) < int(share * (1 << 30)))
    # the sample only says where to cut
    nodes = cut_tree(picked.select(*names).toPandas().to_numpy(dtype=float), SAMPLED_PER_CELL) if cells > 1 else [(-1, 0.0, 0, 0)]

    def place(batches):
        for pdf in batches:
            pdf["_cell"] = cell_of(nodes, pdf[names].to_numpy(dtype=float))
            yield pdf

    located = materialise(points.mapInPandas(place, f"{columns}, _w int, _p long, _cell int"))
    edges = [f(n).alias(f"{p}{n}") for n in names for p, f in (("l", F.min), ("h", F.max))]
    boxes = wide_aggregate(located, ["_cell"], [F.sum("_w").alias("_n"), *edges]).toPandas()  # at most a few thousand cells
    number = boxes["_cell"].to_numpy(dtype=int)
    low, high = (boxes[[f"{p}{n}" for n in names]].to_numpy(dtype=float) for p in "lh")
    sizes = boxes["_n"].to_numpy(dtype=int)

    def values(pdf):
        return pdf[names].to_numpy(dtype=float)

    def lists(d2):
        return [row[np.isfinite(row)] for row in np.sqrt(d2)]

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        points, weights = values(pdf), pdf["_w"].to_numpy()
        pdf = pdf[pdf["_w"] < want]  # of more copies each has distance zero and nothing to ask
        x, others = values(pdf), [number[:0]] * len(pdf)
        with np.errstate(over="ignore"):
            d2 = nearest(points, weights, x, want)
            for own in blocks(x, 256):  # bounds the table of points and boxes
                if not len(own):
                    continue
                part, radius = x[own], d2[own, -1]
                open_ = ~np.isfinite(radius)
                if open_.any():
                    far = reaches(part[open_], low, high)
                    order = np.argsort(far, axis=1)
                    enough = np.argmax(np.cumsum(sizes[order], axis=1) >= want, axis=1)
                    bound = np.take_along_axis(far, order, axis=1)[np.arange(len(far)), enough]
                    radius[open_] = np.where(sizes.sum() >= want, bound, np.inf)
                # only cells that the box around these points reaches are compared with each of them
                between = np.maximum(np.maximum(low - part.max(axis=0), part.min(axis=0) - high), 0.0)
                reached = np.flatnonzero(((between**2).sum(axis=1) <= radius.max() * (1 + 1e-9)) & (number != at(pdf)))
                hit = (gaps(part, low[reached], high[reached]) <= radius[:, None] * (1 + 1e-9)) & (radius > 0)[:, None]
                for i in np.flatnonzero(hit.any(axis=1)):
                    others[own[i]] = number[reached[hit[i]]]
        closed = np.array([not len(o) for o in others], bool)
        near = [[] if c else row for c, row in zip(closed, lists(d2))]
        columns = {"_near": near, "_others": others}  # also of no rows they are columns of lists
        return pdf[[*names, "_p"]].assign(_mean=np.where(closed, np.sqrt(d2).sum(axis=1) / k, np.nan), **{c: pd.Series(v, pdf.index, object) for c, v in columns.items()})

    def at(pdf):
        return pdf["_cell"].iloc[0]

    found = materialise(located.groupBy("_cell").applyInPandas(inside, f"{columns}, _p long, _mean double, _near array<double>, _others array<int>"))
    asks = found.select(*names, "_p", F.explode("_others").alias("_cell"))
    chunks = asks.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / QUESTIONS).cast("int").alias("_chunks"))  # at most one row per cell
    asked = asks.join(F.broadcast(chunks), "_cell").withColumn("_chunk", F.pmod(F.xxhash64("_p"), "_chunks")).drop("_chunks")
    copies = F.explode(F.sequence(F.lit(0), F.col("_deal") - 1).cast("array<bigint>")).alias("_chunk")
    targets = located.join(F.broadcast(chunks.toDF("_cell", "_deal")), "_cell").select("_cell", *names, "_w", copies)

    def outside(target: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        with np.errstate(over="ignore"):
            d2 = nearest(values(target), target["_w"].to_numpy(), values(ask), want)
        return ask[["_p"]].assign(_near=lists(d2))

    keys = ["_cell", "_chunk"]
    more = targets.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(outside, "_p long, _near array<double>")
    # a point without a cell to ask is done; its mean is infinite where there are too few points
    closed = found.filter(F.size("_others") == 0).select("_p", F.col("_mean").alias(out))
    open_ = found.filter(F.size("_others") > 0).select("_p", "_near").unionByName(more)
    merged = open_.groupBy("_p").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_near"))), 1, want).alias("_near"))
    mean = F.aggregate("_near", F.lit(0.0), lambda s, v: s + v) / k
    sure = closed.unionByName(merged.select("_p", F.when(F.size("_near") < want, F.lit(float("inf"))).otherwise(mean).alias(out)))
    scored = located.filter(F.col("_w") < want).select(*names, "_p").join(sure, "_p").drop("_p").withColumn("_salt", F.lit(0))
    # a point with more than k copies has distance zero; rows of frequent points are dealt over tasks and meet no score
    hot = counted.filter(F.col("_copies") > max(HOT_ROWS, k)).select(*names, F.lit(True).alias("_hot"))
    salt = 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    keyed = rows.join(F.broadcast(hot), names, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0))  # a hot point per HOT_ROWS rows
    joined = keyed.join(scored, [*names, "_salt"], "left")
    return joined.select(*source.columns, F.coalesce(F.col(out), F.lit(0.0)).alias(out))
