"""Near-duplicate texts and their clusters: MinHash bands, exact Jaccard similarity, connected components. JVM expressions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from .materialise import written

#: Words of a shingle, hashes of a band, and bands. Two texts of similarity 0.8 share no band with probability
#: (1 - 0.8 ** ROWS) ** BANDS, about 3 in a hundred thousand; texts of higher similarity are missed less often still.
SHINGLE, ROWS, BANDS = 5, 4, 20
#: Rounds in which a bucket's members meet one of them, before those of different components meet each other.
CENTRES = 6
#: Standard deviations by which the agreement of two sketches may fall short of the similarity.
SHORT = 5.0
#: Nodes whose keys (24 bytes each) may be broadcast to find their texts.
BROADCAST_ROWS = 500_000
WORD = r"[^\x20\x09-\x0D]+"


def shingle_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of the shingles of a text in ascending order; a shorter text is one shingle, no words none."""
    words = F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))

    def of(w):
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1)))
        return F.when(F.size(w) > 0, F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, F.lit(SHINGLE))))))).otherwise(F.array().cast("array<long>"))

    # the words are named twice, so they go through a lambda that works them out once
    return F.coalesce(F.element_at(F.transform(F.array(words), of), 1), F.array().cast("array<long>"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) is connected with.

    Large-star and small-star steps in turn: every node hands its larger neighbours, then its smaller ones, to the smallest
    node it knows, until nothing changes. Rounds grow with the logarithm of a component's size. A step's result is written;
    only two numbers that tell whether the links changed come to the driver.
    """
    def star(links, at, to):
        """Per node ``at`` the least of itself and its neighbours ``to``, beside every link."""
        least = links.groupBy(at).agg(F.least(F.min(to), F.col(at)).alias("m"))
        return links.join(least, at)

    links = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = links.agg(F.count("*"), F.lit(None)).head()
    while mark[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both, "a", "b").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = written(large.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        small = star(down, "a", "b")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        links = written(small.filter("a != b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == mark:
            break
        mark = now
    labels = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())


def sketched(rows: DataFrame) -> DataFrame:
    """id, text_hash, size, finger (four sums that identify the set) and buckets (one per band) of the texts with words.

    Shingles are folded where they lie; only sums and minima move. Rows that repeat an id and a text fold into one row, so
    counts and sums are divided by their number.
    """
    each = rows.select("id", "text_hash", F.posexplode(shingle_hashes(F.col("text"))).alias("at", "h"))
    low = (1 << 32) - 1
    again = F.xxhash64("h", F.lit(1))
    sums = [F.col("h").bitwiseAND(low), F.shiftrightunsigned("h", 32), again.bitwiseAND(low), F.shiftrightunsigned(again, 32)]
    halves = [half for k in range(ROWS * BANDS // 2) for half in (F.xxhash64("h", F.lit(2 + k)).bitwiseAND(low), F.shiftrightunsigned(F.xxhash64("h", F.lit(2 + k)), 32))]
    minima = [F.min(half).alias(f"m{k}") for k, half in enumerate(halves)]
    found = each.groupBy("id", "text_hash").agg(F.count_if(F.col("at") == 0).alias("copies"), F.count("*").alias("n"), *[F.sum(x).alias(f"s{k}") for k, x in enumerate(sums)], *minima)
    finger = F.struct(*[F.expr(f"s{k} div copies").alias(f"f{k}") for k in range(4)])
    # a band keeps 16 bits of each minimum, which is enough to compare sketches
    bands = [F.struct(F.xxhash64(*own).alias("bucket"), F.array(*[F.col(c).bitwiseAND(0x7FFF).cast("short") for c in own]).alias("bits")) for own in ([f"m{b * ROWS + r}" for r in range(ROWS)] for b in range(BANDS))]
    return found.select("id", "text_hash", F.expr("n div copies").alias("size"), finger.alias("finger"), F.transform(F.array(*bands), lambda b: b["bucket"]).alias("buckets"), F.flatten(F.transform(F.array(*bands), lambda b: b["bits"])).alias("sketch"))


def overlaps(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``similarity``, the exact Jaccard similarity of their sets."""
    one, two = (nodes.select(F.col("node").alias(c), F.col("shingles").alias(f"_{c}")) for c in ("a", "b"))
    both = F.size(F.array_intersect("_a", "_b"))
    found = pairs.join(one, "a").join(two, "b").withColumn("_both", both)
    return found.withColumn("similarity", F.col("_both") / (F.size("_a") + F.size("_b") - F.col("_both"))).drop("_a", "_b", "_both")


def sets_of(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """node and shingles of ``nodes`` (node, id, text_hash), worked out again from the one row that stands for each."""
    wanted = written(nodes.select("node", "id", "text_hash"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return written(rows.join(wanted, ["id", "text_hash"]).dropDuplicates(["node"]).select("node", shingle_hashes(F.col("text")).alias("shingles")))


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (node, label) after more links (a, b) between nodes: components of the labels they join."""
    if not links.limit(1).count():
        return label
    one, two = (label.select(F.col("node").alias(c), F.col("label").alias(f"to_{c}")) for c in ("a", "b"))
    joined = links.join(one, "a").join(two, "b").filter("to_a != to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
    moved = components(joined).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return written(label.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def clustered(nodes: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """node, label of the ``nodes`` (node, id, text_hash, size, buckets, sketch) that share a bucket: the clusters of distinct sets.

    In each round the least of a bucket's members that was not yet its centre meets the members of other components, so a
    group of near copies joins in a few rounds without meeting pair by pair. What then still lies in different components of
    one bucket meets if sizes and sketches allow the similarity; every link is checked on the full sets, which are made for
    nodes that share a bucket only.
    """
    bands = nodes.select("node", "size", F.posexplode("buckets").alias("band", "bucket"))
    full = bands.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter("n > 1").select("band", "bucket")
    members = written(bands.join(full, ["band", "bucket"]))
    inside = written(members.select("node").distinct())
    sets = sets_of(nodes.join(inside, "node", "left_semi"), rows)
    label = inside.withColumn("label", F.col("node"))
    linked = lambda pairs: overlaps(pairs, sets).filter(F.col("similarity") >= similarity - 1e-12)
    alike = lambda a, b: F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9
    for _ in range(CENTRES):
        named = members.join(label, "node")
        mixed = named.groupBy("band", "bucket").agg(F.min(F.struct("node", "size", "label")).alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("band", "bucket", "c")
        open_ = written(named.join(mixed, ["band", "bucket"]))
        if not open_.limit(1).count():
            return label
        pairs = open_.filter((F.col("label") != F.col("c.label")) & alike(F.col("size"), F.col("c.size"))).select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()
        label = merged(label, written(linked(pairs)))
        members = open_.filter("node != c.node").select("node", "size", "band", "bucket")
    named = members.join(label, "node")
    mixed = named.groupBy("band", "bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("band", "bucket")
    open_ = written(named.join(mixed, ["band", "bucket"]).join(nodes.select("node", "sketch"), "node"))
    one, two = (open_.select("band", "bucket", F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("label").alias(f"label_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in ("a", "b"))
    same = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, x: total + x)
    n = ROWS * BANDS
    least = n * similarity - SHORT * (n * similarity * (1 - similarity)) ** 0.5
    meet = (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & alike(F.col("size_a"), F.col("size_b")) & (same >= least)
    rest = one.join(two, (one["band"] == two["band"]) & (one["bucket"] == two["bucket"]) & meet).select("a", "b").distinct()
    return merged(label, written(linked(rest)))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row per row of ``df``: its id, n_shingles, exact_id (least id with the same shingles), cluster_id (least id
    reachable by links), cluster_size and kept (cluster_id is its own id).

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles is ``similarity`` or more; letters A-Z
    count as lower case, and a text of fewer words is one shingle. Candidates come from MinHash bands and every link is
    checked on the full sets. A null or empty text, and a row without id, is a cluster of its own; rows that repeat an id and
    a text are one member each of the same cluster. Texts with equal sets are one node however many there are.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketch = written(sketched(rows.filter("id IS NOT NULL")))
    nodes = sketch.groupBy("finger", "size").agg(F.min(F.struct("id", "text_hash")).alias("least"), F.first("buckets").alias("buckets"), F.first("sketch").alias("sketch"))
    nodes = written(nodes.select(F.xxhash64("finger", "size").alias("node"), "least.id", "least.text_hash", "finger", "size", "buckets", "sketch"))
    label = clustered(nodes, rows, similarity)
    named = nodes.select("finger", "size", "node", F.col("id").alias("exact")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = named.join(named.groupBy("label").agg(F.min("exact").alias("cluster")), "label").select("finger", "size", "exact", "cluster")
    of_row = written(sketch.select("id", "text_hash", "finger", "size").join(named, ["finger", "size"]).select("id", "text_hash", "size", "exact", "cluster"))
    found = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")).join(of_row, ["id", "text_hash"], "left")
    found = written(found.select("id", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("exact", "id").alias("exact"), F.coalesce("cluster", "id").alias("cluster"), F.col("cluster").isNull().alias("alone")))
    sizes = found.filter("NOT alone").groupBy("cluster").agg(F.count("*").alias("members"))
    out = found.join(sizes, "cluster", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.col("exact").alias("exact_id"), F.col("cluster").alias("cluster_id"),
        F.when(F.col("alone"), 1).otherwise(F.col("members")).cast("long").alias("cluster_size"), F.coalesce(F.col("cluster") == F.col("id"), F.lit(True)).alias("kept"))
