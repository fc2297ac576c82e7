"""Near-duplicate documents by SetSketch registers over word shingles."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.common import same_key_join
from ..operators.ordered import with_row_index
from .common import WordHasher, components, lower_ascii, mix, releasing, segments, stored, text_buffer

#: Registers of a sketch, base of their exponential scale and rate of the exponential hash values.
REGISTERS, BASE, RATE, TOP = 256, 1.001, 20.0, (1 << 16) - 2
#: A pair at the threshold may miss all bands with at most this probability.
MISS = 1e-5
#: Standard deviations below the threshold at which the likelihood estimate gives a candidate up.
SLACK = 4.5
#: Members of one bucket that meet in one block of register comparisons; larger buckets become pairs of blocks.
BUCKET_BLOCK = 2048
#: Nodes that may be broadcast as a list of numbers (8 bytes each); more are joined by shuffle.
BROADCAST_NODES = 1_000_000


def words_by_space() -> WordHasher:
    """Words are runs without ASCII white space; A-Z count as a-z."""
    keep = np.ones(256, bool)
    keep[[9, 10, 11, 12, 13, 32]] = False
    return WordHasher(keep, lower_ascii())


def shingle_sets(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Per text: the sorted distinct 64-bit hashes of its ``size``-word shingles; fewer words are one shingle."""
    starts, ends, text = hasher.spans(data, offsets)
    words = hasher.hashes(data, starts, ends)
    n = len(offsets) - 1
    first, last = np.searchsorted(text, np.arange(n)), np.searchsorted(text, np.arange(n), "right")
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        rolled = rolled * np.uint64(0x9FB21C651E98DF25) + words[j : j + len(rolled)]
    rolled = mix(rolled)
    sets = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= size:
            sets.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            few = np.uint64(b - a)
            for w in words[a:b]:
                few = mix(np.array([few], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + w)[0]
            sets.append(np.array([few], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of each set as big-endian 16-bit numbers, one row per set; zeros for an empty set.

    Every element has a Poisson process of rate m whose points fall on registers at random, so a register sees each
    element's first point at exponential time, independent of the others. A register keeps the least time on an
    exponential scale. Points beyond a time by which all registers are filled are never made.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    least = np.full((len(sets), m), np.inf)
    todo, margin = np.flatnonzero(sizes), 4.0
    while len(todo):
        elements = np.concatenate([sets[i] for i in todo])
        row = np.repeat(todo, sizes[todo])
        limit = np.zeros(len(sets))
        limit[todo] = (math.log(m) + margin) / sizes[todo]
        time, step = np.zeros(len(elements)), 0
        flat = least.reshape(-1)
        while len(elements):
            step += 1
            point = mix(elements + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((point >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / m
            live = time <= limit[row]
            elements, row, time, point = elements[live], row[live], time[live], point[live]
            np.minimum.at(flat, row * m + (point & np.uint64(m - 1)).astype(np.int64), time)
        todo = todo[np.isinf(least[todo]).any(1)]
        margin *= 2
    level = np.floor(1 - np.log(np.where(np.isinf(least), 1, least) / RATE) / math.log(BASE))
    level = np.where(sizes[:, None] > 0, np.clip(level, 0, TOP + 1), 0)
    return level.astype(">u2")


def estimate(up, down, n_a, n_b, m: int = REGISTERS) -> np.ndarray:
    """Jaccard similarity of two sets by maximum likelihood, from the numbers of registers in which the first sketch is
    larger (``up``) or smaller (``down``) and the sizes of the sets."""
    up, down, n_a, n_b = (np.asarray(x, float) for x in (up, down, n_a, n_b))
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    low, high = np.zeros(len(up)), np.minimum(u / v, v / u)

    def likelihood(j):
        chance = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)
        p, q = chance(u - v * j), chance(v - u * j)
        return up * np.log(p) + down * np.log(q) + (m - up - down) * np.log(np.maximum(1 - p - q, 1e-12))

    for _ in range(40):  # the likelihood has one maximum
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        left = likelihood(a) > likelihood(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def band_rows(threshold: float, m: int = REGISTERS) -> int:
    """Registers per band: the most for which a pair at the threshold is missed with probability ``MISS`` at most."""
    return max([r for r in range(1, 33) if (1 - threshold**r) ** (m // r) <= MISS], default=1)


def least_estimate(threshold: float, m: int = REGISTERS) -> float:
    return threshold - SLACK * math.sqrt(threshold * (1 - threshold) / m)


def sketches(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, n (shingles), digest (of the set), regs (registers) of every document."""

    def sketch(batches):
        hasher = words_by_space()
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in segments(offsets):
                sets = shingle_sets(hasher, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]), pa.array([r.tobytes() for r in registers(sets)])],
                    names=["doc_id", "n", "digest", "regs"])

    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(releasing(sketch), "doc_id long, n long, digest binary, regs binary")


def sets_of(documents: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, n and shingles of the documents whose doc_id is among ``nodes``."""

    def build(batches):
        hasher = words_by_space()
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in segments(offsets):
                sets = shingle_sets(hasher, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    texts = documents.select(F.col("doc_id").alias("node"), F.col("text").cast("binary").alias("text")).join(wanted, "node", "left_semi")
    return texts.mapInArrow(releasing(build), "node long, shingles array<long>")


def estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose likelihood estimate from registers does not rule out the threshold."""

    @F.pandas_udf("boolean")
    def likely(regs_a, regs_b, n_a, n_b):
        import pandas as pd

        a = np.frombuffer(b"".join(regs_a), ">u2").reshape(len(regs_a), -1)
        b = np.frombuffer(b"".join(regs_b), ">u2").reshape(len(regs_b), -1)
        return pd.Series(estimate((a > b).sum(1), (a < b).sum(1), n_a, n_b) >= least_estimate(threshold))

    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("regs_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("regs_b"))
    close = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9
    return pairs.join(one, "a").join(two, "b").filter(close).filter(likely("regs_a", "regs_b", "n_a", "n_b")).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |intersection| >= percent * |union| of their whole sets."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(two, "b").join(one, "a").filter(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select("a", "b").distinct()


def pairs_in_buckets(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs of members of one bucket with different labels that the estimate does not rule out.

    rows: bucket, band, left and right (block numbers), chunk, node, n, label, regs. Members of blocks ``left`` and ``right`` are
    compared register by register in array work; a pair leaves the task only if it is likely, and only from the first
    band that its registers share.
    """
    least, r = least_estimate(threshold), band_rows(threshold)

    def compare(batches):
        def likely(table, one, two):
            """Of the pairs (one, two) of row numbers: those that meet here first and are not ruled out."""
            n, label, band = (table[c].to_numpy() for c in ("n", "label", "band"))
            keep = (label[one] != label[two]) & (np.minimum(n[one], n[two]) >= threshold * np.maximum(n[one], n[two]) - 1e-9)
            one, two = one[keep], two[keep]
            if not len(one):
                return
            regs = np.frombuffer(b"".join(table["regs"].to_pylist()), ">u2").reshape(len(n), -1).astype(np.uint16)
            for k in range(0, len(one), 1 << 14):
                i, j = one[k : k + (1 << 14)], two[k : k + (1 << 14)]
                x, y = regs[i], regs[j]
                up, down = (x > y).sum(1), (x < y).sum(1)
                shared = (x == y)[:, : REGISTERS // r * r].reshape(len(i), -1, r).all(2)
                yes = (shared.argmax(1) == band[i]) & (estimate(up, down, n[i], n[j]) >= least)
                yield i[yes], j[yes]

        def flush(table):
            """Pairs within each run of equal keys; a run is one block or a pair of blocks."""
            key = np.stack([table[c].to_numpy() for c in ("bucket", "left", "right")], 1)
            edges = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
            chunk, left, right, node = (table[c].to_numpy() for c in ("chunk", "left", "right", "node"))
            waiting, size = [], 0
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                for i in range(a, b):
                    if left[i] == right[i]:
                        two = np.arange(i + 1, b)
                    elif chunk[i] == left[i]:
                        two = a + np.flatnonzero(chunk[a:b] == right[i])
                    else:
                        continue
                    waiting.append((np.full(len(two), i), two))
                    size += len(two)
                    if size >= 1 << 20 or (i == b - 1 == len(key) - 1):
                        yield from waiting_pairs(table, node, waiting)
                        waiting, size = [], 0
            if waiting:
                yield from waiting_pairs(table, node, waiting)

        def waiting_pairs(table, node, waiting):
            one, two = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
            for i, j in likely(table, one, two):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            if not table.num_rows:
                continue
            key = np.stack([table[c].to_numpy() for c in ("bucket", "left", "right")], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            if last:
                yield from flush(table.slice(0, last).combine_chunks())
            held = table.slice(last)
        if held is not None and held.num_rows:
            yield from flush(held.combine_chunks())

    dealt = rows.select("bucket", "band", "left", "right", "chunk", "node", "n", "label", "regs").repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right", "node")
    return dealt.mapInArrow(releasing(compare), "a long, b long").distinct()


def linked(documents: DataFrame, percent: int = 85, size: int = 5) -> DataFrame:
    """Near-duplicate components: one row per document with doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets. Equal sets are one node, named
    by their least doc_id, however many documents hold them. Nodes that share a band of registers meet: first each with its
    bucket's least node, then, once components are known, with the members of other components. Candidates pass the
    likelihood estimate and are confirmed on whole sets. A null or wordless text is linked with nothing. Rows with the same
    doc_id are one document; a row without doc_id is linked with nothing, is kept and has no component_id.
    """
    threshold = percent / 100
    docs = documents.select("doc_id", "text")
    rows = stored(sketches(docs, size))
    nodes = stored(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("regs").alias("regs")))
    r = band_rows(threshold)
    banded = nodes.select("node", F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 1 + 2 * r * i, 2 * r)) for i in range(REGISTERS // r)])).alias("band", "bucket"))
    shared = stored(banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).filter("pivot != other").select("bucket", "pivot"))
    members = stored(banded.join(shared, "bucket"))
    pairs = stored(members.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    sets = stored(sets_of(docs, members.select("node").distinct(), size))
    star = stored(verified(estimated(pairs, nodes, threshold), sets, percent))
    # rows of one doc_id with different texts are one document
    same = rows.filter("n > 0 AND doc_id IS NOT NULL").join(nodes.select("digest", "node"), "digest").filter("node != doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    links = star.unionByName(same)
    labels = components(links)

    labelled = members.join(labels, "node", "left").select("bucket", "band", "node", F.coalesce("label", "node").alias("label"))
    open_ = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).filter("low != high")
    open_ = open_.select("bucket", F.ceil(F.col("size") / BUCKET_BLOCK).cast("int").alias("blocks"))
    met = labelled.join(open_, "bucket").join(nodes.select("node", "n", "regs"), "node").withColumn("chunk", F.pmod(F.hash("node"), "blocks"))
    met = met.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("left", F.least("chunk", "k")).withColumn("right", F.greatest("chunk", "k"))
    rest = stored(pairs_in_buckets(met, threshold).join(pairs, ["a", "b"], "left_anti"))
    links = stored(links.unionByName(verified(rest, sets, percent)))
    labels = components(links)
    named = rows.join(labels, rows.doc_id == labels.node, "left")
    component = F.coalesce("label", "doc_id")
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(documents: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The documents that stay when one of each near-duplicate group is kept, with their own columns.

    Of rows that repeat a doc_id (also a null one) with the same text one stays; rows of one doc_id with different texts are
    one document. Each row without doc_id is a document of its own, under a number that no doc_id has.
    """
    rows = stored(documents.withColumn("_row", F.monotonically_increasing_id()).withColumn("_text", F.sha2("text", 256)))
    again = rows.groupBy("doc_id", "_text").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    copies = same_key_join(rows.select("doc_id", "_text", "_row"), again, ["doc_id", "_text"]).filter("_row != _first").select("_row")
    once = rows.join(stored(copies), "_row", "left_anti")
    found = once.agg(F.count_if(F.col("doc_id").isNull()).alias("n"), F.min("doc_id").cast("long").alias("low"), F.max("doc_id").cast("long").alias("high")).head()
    named = once.withColumn("_id", F.col("doc_id").cast("long"))
    if found["n"]:
        low, high = found["low"] or 0, found["high"] or 0
        start = high + 1 if high + found["n"] < 2**63 else low - found["n"]
        if start < -(2**63):
            raise ValueError("no numbers are left for the rows without doc_id")
        numbers = stored(with_row_index(once.filter("doc_id IS NULL").select("_row"), ["_row"], "_at").select("_row", (F.lit(start) + F.col("_at")).alias("_made")))
        named = once.join(numbers, "_row", "left").withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), "_made"))
    gone = linked(named.select(F.col("_id").alias("doc_id"), "text"), percent, size).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return named.join(gone, named["_id"] == F.col("_gone"), "left_anti").select(*documents.columns)
