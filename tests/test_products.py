import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import products, sigindex, signatures as O
from plumbline.operators.sigindex import SignatureIndex


@pytest.fixture(scope="module")
def vectors(spark):
    """Clustered unit vectors, a third of them copies of one."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(10, 16))[rng.integers(0, 10, 400)] + 0.4 * rng.normal(size=(400, 16))
    x[::3] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "signature_id long, vector array<double>")
    return x, df, df.withColumnRenamed("signature_id", "query_id")


def brute(x, k, t):
    sims = np.round(x @ x.T, 9)
    np.fill_diagonal(sims, -2)
    order = [np.lexsort((np.arange(len(x)), -s))[:k] for s in sims]
    return {(q, int(i)) for q, own in enumerate(order) for i in own if sims[q, i] >= t}


def pairs(df):
    return {(r["query_id"], r["signature_id"]) for r in df.collect()}


def test_many_queries_are_multiplied_in_blocks(vectors, spark, tmp_path, monkeypatch):
    x, lib, queries = vectors
    want = brute(x, 7, 0.3)
    SignatureIndex.build(lib, str(tmp_path / "index"))
    monkeypatch.setattr(sigindex, "PAIRS", 100)
    monkeypatch.setattr(O, "PAIRS", 100)
    assert pairs(O.match_approx(queries, lib, 7, 0.3, exclude_self=True)) == want
    assert pairs(O.match_approx(queries, SignatureIndex.open(spark, str(tmp_path / "index")), 7, 0.3, exclude_self=True)) == want
    assert pairs(O.match_hybrid(queries, lib, 7, 0.3, exclude_self=True)) == want


def test_pairs_are_counted_by_buckets(vectors, spark, tmp_path, monkeypatch):
    _, lib, queries = vectors
    index = SignatureIndex.build(lib, str(tmp_path / "index"))
    asked = queries.limit(20).withColumnRenamed("query_id", "node")
    monkeypatch.setattr(sigindex, "PAIRS", 10)
    assert index.meets_many(asked)
    monkeypatch.setattr(sigindex, "PAIRS", 10**6)
    assert not index.meets_many(asked)


def test_null_and_repeated_rows(vectors, spark, monkeypatch):
    x, lib, queries = vectors
    none = spark.createDataFrame([(1000, None)], "signature_id long, vector array<double>")
    more = lib.union(none)
    want = brute(x, 5, 0.7)
    asked = more.withColumnRenamed("signature_id", "query_id")
    assert pairs(O.match_exact(asked, more, 5, 0.7, exclude_self=True)) == want
    monkeypatch.setattr(O, "LOCAL_ROWS", 10)
    assert pairs(O.match_exact(asked, more, 5, 0.7, exclude_self=True)) == want
    twice = O.match_exact(queries.filter("query_id = 4"), lib.union(lib), 6, 0.7, exclude_self=True).collect()
    once = O.match_exact(queries.filter("query_id = 4"), lib, 3, 0.7, exclude_self=True).collect()
    assert sorted((r["signature_id"], r["rank"]) for r in twice) == sorted((r["signature_id"], 2 * r["rank"] - i) for r in once for i in (0, 1))


def test_a_task_holds_few_matches_of_a_large_near_group(monkeypatch):
    monkeypatch.setattr(products, "WAITING", 2_000)
    rng = np.random.default_rng(4)
    x = rng.normal(size=8) + 1e-5 * rng.normal(size=(3000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    best = products.Best(x[:600], np.arange(600), 5, 0.3, True)
    for start in range(0, len(x), 256):
        best.meet(x[start : start + 256], np.arange(start, min(start + 256, len(x))), np.arange(600))
    best.merge()
    rows, ids, _ = best.found[0]
    assert len(rows) == 3000
    assert {(int(r), int(i)) for r, i in zip(rows, ids) if r < 600} == {p for p in brute(x, 5, 0.3) if p[0] < 600}


def test_matches_are_found_once(vectors):
    _, lib, queries = vectors
    scores = F.create_map(F.lit("a"), F.lit(10.0), F.lit("b"), F.lit(90.0))
    facts = lib.select("signature_id", F.lit(30.0).alias("collapse_score"), F.lit(1).alias("usage_count"), F.lit(0.5).alias("prediction_accuracy"), F.lit(0.1).alias("anomaly_score"), scores.alias("dimension_scores"))
    now = queries.select("query_id", F.create_map(F.lit("a"), F.lit(20.0)).alias("current_scores"))
    assessed = O.assess_matches(O.match_exact(queries, lib, 3, 0.7, exclude_self=True), facts, now)
    for what, rows in ((O.match_advice, 2), (O.match_insights, 1)):
        out = what(assessed)
        assert out._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
        assert out.count() == rows * assessed.count()
    assert {r["matching_dimensions"] for r in O.match_insights(assessed).collect()} == {1}
