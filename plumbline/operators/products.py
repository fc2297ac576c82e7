"""Best matches of many vectors among many, by matrix products of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

# Library rows and queries that one product holds, queries of one task, and the fewest queries worth a task.
LIBRARY_BLOCK = 4_096
QUERY_STEP = 512
QUERY_BLOCK = 65_536
LEAST_QUERIES = 512
# Matches that wait until they are merged into the best ones, and from which on a block is multiplied again in double.
WAITING = 200_000
MANY = 20_000


def matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors of a list column as rows; a missing component is NaN."""
    width = np.unique(np.diff(column.offsets.to_numpy()))
    if len(width) > 1:
        raise ValueError(f"vectors of different lengths: {width.tolist()}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Best:
    """The ``k`` best matches so far of every row of ``x``.

    Single precision with a margin for its error says which pairs may be among them; those are worked out in double.
    """

    def __init__(self, x: np.ndarray, names: np.ndarray, k: int, threshold: float, exclude_self: bool):
        self.x, self.names, self.k, self.threshold, self.exclude_self = x, names, k, threshold, exclude_self
        self.single = x.astype(np.float32)
        self.longest = np.sqrt(np.nanmax((x * x).sum(axis=1), initial=1.0))
        self.least = np.full(len(x), float(threshold))  # what a further match has to reach
        self.found, self.waiting, self.met = [], 0, 0

    def meet(self, y: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Compare the queries at ``rows`` with a block of the library."""
        single = y.astype(np.float32).T
        margin = (y.shape[1] + 8) * 2.0**-22 * self.longest * np.sqrt(np.nanmax((y * y).sum(axis=1), initial=1.0))
        for start in range(0, len(rows), QUERY_STEP):
            own = rows[start : start + QUERY_STEP]
            least = (self.least[own] - margin).astype(np.float32)
            r, c = np.nonzero(self.single[own] @ single >= least[:, None])
            if not len(r):
                continue
            if len(r) > MANY:
                sims = (self.x[own] @ y.T)[r, c]
            else:
                sims = np.einsum("ij,ij->i", self.x[own[r]], y[c])
            r = own[r]
            keep = (sims >= self.threshold) & (np.round(sims, 9) >= self.least[r])
            if self.exclude_self:
                keep &= self.names[r] != ids[c]
            self.found.append((r[keep], ids[c[keep]], sims[keep]))
            self.waiting += int(keep.sum())
            if self.waiting > WAITING:
                self.merge()

    def merge(self) -> None:
        rows, ids, sims = (np.concatenate(parts) for parts in zip(*self.found)) if self.found else (np.empty(0, int), np.empty(0, int), np.empty(0))
        rounded = np.round(sims, 9)
        order = np.lexsort((ids, -rounded, rows))
        rows = rows[order]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        place = np.arange(len(rows)) - np.repeat(first, np.diff(first, append=len(rows)))
        last = place == self.k - 1
        self.least[rows[last]] = np.maximum(self.threshold, rounded[order[last]])
        order, rows = order[place < self.k], rows[place < self.k]
        self.found, self.waiting = [(rows, ids[order], sims[order])], 0


def cell_of(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return (x @ pivots.T).argmax(axis=1).astype(np.int32)


def best_products(
    queries: DataFrame, library: DataFrame, k: int, threshold: float, exclude_self: bool = False, pivots: np.ndarray | None = None,
    library_block: int = LIBRARY_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, signature_id, similarity: the ``k`` best products of every query row at or above the threshold.

    Queries are dealt to tasks, at most about ``query_block`` to one; the library streams past each of them in blocks, so what
    a task holds does not depend on the library, and the library is copied as often as there are tasks, not queries. Of equal
    vectors only the ``k + 1`` smallest ids can count. With ``pivots``, vectors of unit length, the library comes cell by cell,
    and a block that the triangle inequality on angles puts out of a query's reach is not multiplied. Null vectors match nothing.
    """
    vector = F.col("vector").cast("array<double>").alias("vector")
    asked = queries.select("query_id", vector).filter("vector IS NOT NULL")
    stored = library.select("signature_id", vector).filter("vector IS NOT NULL")
    kinds = [f.dataType.simpleString() for f in (asked.schema["query_id"], stored.schema["signature_id"])]
    count = asked.count()
    tasks = max(1, -(-count // query_block), min(2 * asked.sparkSession.sparkContext.defaultParallelism, -(-count // LEAST_QUERIES)))
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("signature_id"))
    stored = stored.withColumn("_place", place).filter(F.col("_place") <= k + 1).drop("_place")

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("_cell", pa.array(cell_of(matrix(batch.column("vector")), pivots)))

    if pivots is None:
        stored = stored.withColumn("_cell", F.lit(0))
    else:
        stored = stored.mapInArrow(placed, f"signature_id {kinds[1]}, vector array<double>, _cell int")
    left = asked.select(
        F.pmod(F.xxhash64("query_id", "vector"), F.lit(tasks)).cast("int").alias("_task"), F.lit(-1).alias("_cell"),
        "query_id", F.lit(None).cast(kinds[1]).alias("signature_id"), "vector",
    )
    right = stored.select(
        F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("_task"), "_cell",
        F.lit(None).cast(kinds[0]).alias("query_id"), "signature_id", "vector",
    )
    dealt = left.unionByName(right).repartitionById(tasks, F.col("_task")).sortWithinPartitions("_cell").drop("_task")

    def search(batches):
        names, vectors, best = [], [], None
        for batch in batches:
            cells = batch.column("_cell").to_numpy()
            asked_here = int(np.searchsorted(cells, 0))
            if asked_here:
                names.append(batch.column("query_id").slice(0, asked_here))
                vectors.append(matrix(batch.column("vector").slice(0, asked_here)))
            if not names:
                return  # a library without a question
            if asked_here == batch.num_rows:
                continue
            if best is None:
                names, x = pa.concat_arrays(names), np.concatenate(vectors)
                vectors = angles = None
                best = Best(x, names.to_pandas().to_numpy(), k, threshold, exclude_self)
                if pivots is not None:
                    angles = np.arccos(np.clip(x @ pivots.T, -1, 1)).astype(np.float32)
            y, ids = matrix(batch.column("vector").slice(asked_here)), batch.column("signature_id").slice(asked_here).to_pandas().to_numpy()
            cells = cells[asked_here:]
            start = 0
            while start < len(y):
                # the first blocks are small: soon only pairs better than the k-th count
                end = min(start + min(library_block, max(256, best.met)), int(np.searchsorted(cells, cells[start], "right")))
                block, rows = y[start:end], np.arange(len(best.x))
                if pivots is not None:
                    near = np.clip(block @ pivots[cells[start]], -1, 1)
                    reach = np.arccos(np.clip(best.least, -1, 1)) + 1e-6
                    rows = rows[~(angles[:, cells[start]] - np.arccos(near.min()) > reach)]
                best.meet(block, ids[start:end], rows)
                best.met += end - start
                start = end
        if best is not None:
            best.merge()
            rows, found, sims = best.found[0]
            for start in range(0, len(rows), 10_000):
                own = slice(start, start + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(rows[own])), pa.array(found[own], type=batch.schema.field("signature_id").type, from_pandas=True), pa.array(sims[own])],
                    names=["query_id", "signature_id", "similarity"],
                )

    return dealt.mapInArrow(search, f"query_id {kinds[0]}, signature_id {kinds[1]}, similarity double")
