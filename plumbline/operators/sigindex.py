"""A stored index for approximate search among unit vectors: hash tables of random projections that grow with the library."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import same_key_join
from .materialise import ensure_checkpoint_dir, leaves_with_session, written
from .products import best_products

#: Vectors that a bucket holds on average if they were spread evenly, and the share of matches that may be missed.
BUCKET, MISSED = 8, 0.02
#: Copies of one vector that are kept as members: as many as a search may return, and the query itself.
MEMBERS = 101
SEED = 7
#: Pairs that a search may look at one by one; beyond them products in blocks are cheaper, and nothing is written per pair.
PAIRS = 2_000_000


def shape_of(size: int, similarity: float, probes: int) -> tuple[int, int]:
    """(bits, tables) for a library of ``size`` vectors: buckets stay of one size, and the tables are so many that a pair at
    ``similarity`` meets in one of them but for a chance of ``MISSED``.

    A bit agrees with chance 1 - angle / pi; a query looks into its own bucket and into those that differ in one of its
    ``probes`` least certain bits. The vectors a query meets grow like a power of the library's size below one.
    """
    bits = max(4, math.ceil(math.log2(max(2, size) / BUCKET)))
    agree = 1 - math.acos(similarity) / math.pi
    met = agree**bits + min(probes, bits) * agree ** (bits - 1) * (1 - agree)
    return bits, max(1, math.ceil(math.log(MISSED) / math.log(1 - met)))


def pairs_of(queries: int, size: int, probes: int, similarity: float = 0.7) -> float:
    """Pairs that ``queries`` meet in an index of ``size`` vectors, if these were spread evenly."""
    bits, tables = shape_of(size, similarity, probes)
    return queries * min(1.0 * size, tables * (1 + min(probes, bits)) * size / 2**bits)


@dataclass
class SignatureIndex:
    """Tables in ``folder``: meta (one row), vectors (node, vector), members (node, signature_id) and codes (node, code, by table).

    Equal vectors are one node, so a vector that fills a third of the library is met once.
    """

    spark: SparkSession
    folder: str
    bits: int
    tables: int
    dims: int
    size: int
    probes: int

    @classmethod
    def build(cls, library: DataFrame, folder: str, similarity: float = 0.7, probes: int = 8) -> SignatureIndex:
        """Write the index of ``library`` (signature_id, vector) to ``folder``; an empty library has dims 0."""
        spark = library.sparkSession
        rows = written(library.select("signature_id", F.col("vector").cast("array<double>").alias("vector")).filter("vector IS NOT NULL"))
        nodes = rows.groupBy("vector").agg(F.min("signature_id").alias("node"))
        nodes.write.mode("overwrite").parquet(f"{folder}/vectors")
        nodes = spark.read.parquet(f"{folder}/vectors")
        order = Window.partitionBy("node").orderBy("signature_id")
        members = rows.join(nodes, "vector").select("node", "signature_id", F.row_number().over(order).alias("place")).filter(F.col("place") <= MEMBERS)
        members.select("node", "signature_id").write.mode("overwrite").parquet(f"{folder}/members")
        facts = nodes.agg(F.count("*").alias("size"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dims")).head()
        bits, tables = shape_of(facts["size"], similarity, probes)
        index = cls(spark, folder, bits, tables, facts["dims"], facts["size"], probes)
        index.coded(nodes, 0).select("node", "table", "code").repartition("table").write.mode("overwrite").partitionBy("table").parquet(f"{folder}/codes")
        meta = spark.range(1).select(*[F.lit(getattr(index, k)).alias(k) for k in ("bits", "tables", "dims", "size", "probes")])
        meta.write.mode("overwrite").parquet(f"{folder}/meta")
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SignatureIndex:
        return cls(spark, folder, **spark.read.parquet(f"{folder}/meta").head().asDict())

    def coded(self, nodes: DataFrame, probes: int) -> DataFrame:
        """node, table, code of every node: its own bucket and those beyond its ``probes`` least certain bits.

        All projections of a batch of vectors are one matrix product; planes come from a fixed seed.
        """
        bits, tables, dims = self.bits, self.tables, self.dims
        kind = nodes.schema["node"].dataType.simpleString()

        def code(batches):
            planes = np.random.default_rng(SEED).standard_normal((dims, tables * bits))
            weight = 1 << np.arange(bits, dtype=np.int64)
            for pdf in batches:
                for start in range(0, len(pdf), 512):
                    part = pdf.iloc[start : start + 512]
                    sides = (np.stack(part["vector"].to_numpy()).astype(float) @ planes).reshape(len(part), tables, bits)
                    own = ((sides > 0) * weight).sum(2)[:, :, None]
                    if probes:
                        unsure = np.argsort(np.abs(sides), axis=2, kind="stable")[:, :, :probes]
                        own = np.concatenate([own, own ^ weight[unsure]], 2)
                    each = own.shape[2]
                    yield pd.DataFrame({
                        "node": np.repeat(part["node"].to_numpy(), tables * each), "table": np.tile(np.repeat(np.arange(tables, dtype=np.int32), each), len(part)), "code": own.reshape(-1)})

        return nodes.filter(F.size("vector") == dims).mapInPandas(code, f"node {kind}, table int, code long")

    def candidates(self, queries: DataFrame) -> DataFrame:
        """Distinct (query, node) that share a bucket; ``queries``: node, vector."""
        kind = self.spark.read.parquet(f"{self.folder}/vectors").schema["node"].dataType.simpleString()
        codes = self.spark.read.schema(f"node {kind}, code long, table int").parquet(f"{self.folder}/codes")
        asked = self.coded(queries, self.probes).withColumnRenamed("node", "query")
        return asked.join(codes, ["table", "code"]).select("query", "node").distinct()

    def meets_many(self, queries: DataFrame) -> bool:
        """Whether the buckets would make more than ``PAIRS`` pairs with ``queries`` (node, vector), counted by bucket sizes."""
        codes = self.spark.read.schema("code long, table int").parquet(f"{self.folder}/codes").groupBy("table", "code").agg(F.count("*").alias("_there"))
        asked = self.coded(queries, self.probes).groupBy("table", "code").agg(F.count("*").alias("_here"))
        met = asked.join(codes, ["table", "code"]).agg(F.sum(F.col("_here").cast("double") * F.col("_there")).alias("met")).head()["met"]
        return (met or 0) > PAIRS

    def search(self, queries: DataFrame, k: int, threshold: float, exclude_self: bool = False) -> DataFrame:
        """query_id, signature_id, similarity, rank: at most ``k`` (up to 100) matches per query at or above ``threshold``.

        ``queries``: query_id, vector. Similarities of candidates are exact; equal ones go to the smaller id. Queries that
        meet more than ``PAIRS`` pairs in the tables are multiplied with all stored vectors in blocks, which misses none.
        """
        if k >= MEMBERS:
            raise ValueError(f"an index answers up to {MEMBERS - 1} matches a query")
        queries = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).filter("vector IS NOT NULL")
        nodes = written(queries.groupBy("vector").agg(F.min("query_id").alias("node")))
        least = self.size * nodes.count() * self.tables * (1 + min(self.probes, self.bits)) / 2**self.bits
        if self.dims and (least > PAIRS or self.meets_many(nodes)):
            stored = self.spark.read.parquet(f"{self.folder}/members").join(self.spark.read.parquet(f"{self.folder}/vectors"), "node")
            same = F.size("vector") == self.dims
            found = best_products(queries.filter(same), stored.filter(same), k, threshold, exclude_self)
            return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "signature_id"))).filter(F.col("rank") <= k)
        names = queries.join(nodes, "vector").select("query_id", F.col("node").alias("query"))
        library = self.spark.read.parquet(f"{self.folder}/vectors")
        pairs = self.candidates(nodes).join(nodes.select(F.col("node").alias("query"), F.col("vector").alias("_q")), "query").join(library.withColumnRenamed("vector", "_l"), "node")
        similarity = F.aggregate(F.zip_with("_q", "_l", lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)
        scored = pairs.select("query", "node", similarity.alias("similarity")).filter(F.col("similarity") >= threshold)
        # members of one node are equally near, so k + 1 nodes hold the k best with the query itself left out
        near = scored.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "node"))).filter(F.col("_n") <= k + 1).drop("_n")
        found = near.join(self.spark.read.parquet(f"{self.folder}/members"), "node")
        found = same_key_join(found, names, ["query"])
        if exclude_self:
            found = found.filter(F.col("query_id") != F.col("signature_id"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "signature_id"))
        return found.select("query_id", "signature_id", "similarity", rank.alias("rank")).filter(F.col("rank") <= k)


def temporary_index(library: DataFrame, probes: int = 8) -> SignatureIndex:
    """An index in the checkpoint folder that goes when the session ends."""
    spark = library.sparkSession
    return SignatureIndex.build(library, leaves_with_session(spark, f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"), probes=probes)
