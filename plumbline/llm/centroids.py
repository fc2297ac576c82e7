"""Centroid clustering on integer vectors, in JVM expressions alone."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: Greatest absolute integer component: 64 squared differences of such numbers still fit a 64-bit distance.
MOST = 1 << 27


def integer_vectors(embeddings: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and v, the components as floor(scale * x), of vectors with exactly ``dims`` components, none null or non-finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = embeddings.filter((F.size("embedding") == dims) & finite)
    return whole.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[tuple[int, ...]]:
    """The k vectors whose ``seed:vec_id`` has the least hashes, in that order: a top k, so no more than k rows move."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("v", place.alias("place")).orderBy(F.asc_nulls_last("place"), "v").limit(k).collect()
    return [tuple(r.v) for r in rows]


def nearest(centroids: list[tuple[int, ...]]) -> Column:
    """struct(distance, cluster) of the centroid at the least squared distance from column ``v``, ties to the smaller number."""

    def distance(centroid):
        literal = ", ".join(f"{x}L" for x in centroid)
        return f"aggregate(zip_with(v, array({literal}), (x, c) -> (x - c) * (x - c)), 0L, (total, d) -> total + d)"

    # one text instead of a call for each of the thousand literals
    return F.expr(f"array_min(array({', '.join(f'struct({distance(c)} AS distance, {i} AS cluster)' for i, c in enumerate(centroids))}))")


def moved(vectors: DataFrame, centroids: list[tuple[int, ...]], dims: int) -> list[tuple[int, ...]]:
    """Centroids at the exact floor of their vectors' means; one without vectors stays. At most k rows of sums leave the tasks."""
    own = vectors.select(nearest(centroids)["cluster"].alias("cluster"), "v")
    sums = own.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)])
    out = list(centroids)
    for row in sums.collect():
        out[row["cluster"]] = tuple(row[f"s{i}"] // row["n"] for i in range(dims))
    return out


def cluster_vectors(embeddings: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """Assign every vector (vec_id, embedding) to one of ``k`` centroids; integer arithmetic throughout, so reruns agree.

    Components become floor(scale * x). Centroids start as the vectors whose ``seed:vec_id`` has the least SHA-256 (equal
    hashes: by components; a null vec_id comes last) and move ``rounds`` times to the componentwise floor of their vectors'
    mean. Vectors that are null, of another length, or hold a null or non-finite component are left out. Repeated rows are
    vectors like any other; fewer vectors than ``k`` give fewer centroids, none gives no rows. Other columns are ignored.
    A component beyond 2^27 raises: its squared distances need not fit 64 bits.

    Only the quantised vectors are written; each round reads them once and sends at most k rows of partial sums a task.
    Returns vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.
    """
    vectors = stored(integer_vectors(embeddings, dims, scale))
    ends = vectors.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).head()
    if ends.low is not None and max(-ends.low, ends.high) > MOST:
        raise ValueError(f"components reach {max(-ends.low, ends.high)}; squared distances are sure to fit 64 bits up to {MOST}")
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return vectors.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    for _ in range(rounds):
        centroids = moved(vectors, centroids, dims)
    assigned = stored(vectors.select("vec_id", nearest(centroids).alias("near")).select("vec_id", "near.cluster", "near.distance"))
    inertia = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return assigned.select(
        "vec_id", "cluster", "distance", of([inertia.get(i, 0) for i in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(digests).alias("centroid_sha256"),
    )


def cluster_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> str:
    """DuckDB SQL with the rows of ``cluster_vectors``; a common table per round."""
    parts = [f"""vectors AS (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
             f"""c0 AS (SELECT CAST(row_number() OVER (ORDER BY place NULLS LAST, v) - 1 AS INTEGER) AS cluster, v
        FROM (SELECT sha256('{seed}:' || vec_id) AS place, v FROM vectors ORDER BY place NULLS LAST, v LIMIT {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (SELECT row_id, vec_id, v, near.cluster AS cluster, near.distance AS distance FROM (
            SELECT row_id, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'distance': distance, 'cluster': cluster}}) AS near FROM (
                SELECT row_id, vec_id, x.v AS v, cluster, list_sum(list_transform(range(1, {dims + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) AS distance
                FROM vectors x, c{r} c) GROUP BY row_id))""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS (SELECT c{r}.cluster, coalesce(moved.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
                SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
                    SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY cluster, i) GROUP BY cluster) moved ON moved.cluster = c{r}.cluster)""")
    return f"""WITH {', '.join(parts)}
        SELECT vec_id, a.cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
            CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"""
