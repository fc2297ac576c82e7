import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import signatures as O
from plumbline.operators.sigindex import SignatureIndex


def test_risk_bands(spark):
    df = spark.createDataFrame([(20.0, 80.0, "CRITICAL"), (45.0, 70.0, "HIGH"), (60.0, 55.0, "MEDIUM"), (80.0, 90.0, "LOW")], "s double, c double, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", O.match_risk(F.col("s"), F.col("c"))).collect())


def test_strategy():
    assert [O.choose_strategy(n) for n in (500, 5000, 50000)] == ["exact", "hybrid", "approximate"]


@pytest.fixture(scope="module")
def vectors(spark):
    """Clustered unit vectors; a third are copies of one vector."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 16))[rng.integers(0, 12, 300)] + 0.4 * rng.normal(size=(300, 16))
    x[::3] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "signature_id long, vector array<double>")
    return x, df, df.withColumnRenamed("signature_id", "query_id")


def brute(x, k, t):
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    out = set()
    for q in range(len(x)):
        order = np.lexsort((np.arange(len(x)), -np.round(sims[q], 9)))[:k]
        out |= {(q, int(i)) for i in order if sims[q, i] >= t}
    return out


def pairs(df):
    return {(r["query_id"], r["signature_id"]) for r in df.collect()}


def test_exact_search_both_ways(vectors, monkeypatch):
    x, lib, queries = vectors
    want = brute(x, 5, 0.7)
    assert pairs(O.match_exact(queries, lib, 5, 0.7, exclude_self=True)) == want
    monkeypatch.setattr(O, "LOCAL_ROWS", 10)
    monkeypatch.setattr(O, "PIVOTS", 20)
    monkeypatch.setattr(O, "LIBRARY_BLOCK", 40)
    monkeypatch.setattr(O, "QUERY_BLOCK", 50)
    assert pairs(O.match_exact(queries, lib, 5, 0.7, exclude_self=True)) == want


def test_approximate_recall(vectors):
    x, lib, queries = vectors
    want = brute(x, 5, 0.7)
    for search in (O.match_approx, O.match_hybrid):
        found = pairs(search(queries, lib, 5, 0.7, 8, True))
        assert len(found & want) >= 0.9 * len(want)


@pytest.mark.parametrize("size", [2_000, 16_000])
def test_index_recall_and_comparisons(spark, tmp_path, size):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(size, 32))
    x[size // 2 :] = x[: size // 2] + 0.75 * rng.normal(size=(size // 2, 32))  # near pairs around a cosine of 0.8, far from all else
    x[-size // 4 :] = x[-1]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lib = spark.createDataFrame(pd.DataFrame({"signature_id": range(size), "vector": list(x)}))
    SignatureIndex.build(lib, str(tmp_path / "index"))
    index = SignatureIndex.open(spark, str(tmp_path / "index"))
    asked = list(range(0, size, size // 200))
    queries = lib.filter(F.col("signature_id") % (size // 200) == 0).withColumnRenamed("signature_id", "query_id")
    sims = x[asked] @ x.T
    want = set()
    for row, q in enumerate(asked):
        sims[row, q] = -2
        order = np.lexsort((np.arange(size), -np.round(sims[row], 9)))[:5]
        want |= {(q, int(i)) for i in order if sims[row, i] >= 0.7}
    found = pairs(O.match_approx(queries, index, 5, 0.7, exclude_self=True))
    assert len(want) > 200 and len(found & want) >= 0.9 * len(want) and found <= {(q, i) for q in asked for i in range(size)}
    met = index.candidates(queries.withColumnRenamed("query_id", "node")).count() / len(asked)
    assert met <= 6 * size**0.65  # a power below one of the library's size


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "signature_id long, vector array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert O.match_approx(some, none, 5, 0.7).collect() == []
    lib = some.withColumnRenamed("query_id", "signature_id")
    assert {(r["query_id"], r["signature_id"]) for r in O.match_approx(some, lib, 5, 0.7).collect()} == {(1, 1)}


def test_vector_layout(spark):
    df = spark.sql("select map('distribution_fidelity', 100D) as dimension_scores, map('std', array(2D, 3D)) as stats, 0.5D as skewness, cast(null as double) as kurtosis")
    v = np.array(O.signature_vector(df).head()["vector"])
    raw = np.zeros(128)
    raw[:8] = [1.0] + [0.5] * 7
    raw[16:18] = [2, 3]
    raw[64] = 0.5
    assert np.allclose(v, raw / np.linalg.norm(raw))


def test_columns_after_the_eighth_count(spark):
    values = [float(i * i) for i in range(1, 20)]
    rows = [({}, {"mean": values}), ({}, {"mean": values[:-1] + [7.0]}), ({}, {"mean": values[:8] + [-1.0] + values[9:]})]
    df = spark.createDataFrame([(*r, 0.0, 0.0) for r in rows], "dimension_scores map<string,double>, stats map<string,array<double>>, skewness double, kurtosis double")
    got = [np.array(r["vector"]) for r in O.signature_vector(df).collect()]
    raw = np.zeros(128)
    raw[:8] = 0.5
    raw[8:16] = [np.mean(values[i::8]) for i in range(8)]
    assert np.allclose(got[0], raw / np.linalg.norm(raw))
    assert not np.allclose(got[0], got[1]) and not np.allclose(got[0], got[2])


def test_a_small_library_is_clustered_too(spark):
    x = [[1.0, 0.0], [0.99, 0.01], [0.0, 1.0], [0.01, 0.99]]
    lib = spark.createDataFrame(list(enumerate(x)), "signature_id long, vector array<double>")
    got = {r["signature_id"]: r["cluster_id"] for r in O.cluster_signatures(lib, 2).collect()}
    assert got[0] == got[1] != got[2] == got[3] and min(got.values()) >= 0
    assert O.cluster_signatures(lib, 10).filter("cluster_id >= 0").count() == 4
    assert O.cluster_signatures(lib.limit(0), 2).count() == 0


def test_accuracy_feedback_is_a_moving_average(spark):
    lib = spark.createDataFrame([(1, 0.5, 2), (2, 0.9, 0)], "signature_id long, prediction_accuracy double, usage_count long")
    values = [0.2, 0.9, 0.4, 0.7, 1.0]
    feedback = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "signature_id long, at long, accuracy double")
    acc = 0.5
    for v in values:
        acc = 0.1 * v + 0.9 * acc
    got = {r["signature_id"]: r for r in O.accuracy_feedback(lib, feedback, ["at"]).collect()}
    assert got[1]["prediction_accuracy"] == pytest.approx(acc) and got[1]["usage_count"] == 7
    assert got[2]["prediction_accuracy"] == pytest.approx(0.9)


def test_alignment_without_common_dimensions(spark):
    df = spark.sql("select map('a', 10D) as h, map('b', 10D) as c, map('a', 20D) as e")
    row = df.select(O.dimension_alignment(F.col("h"), F.col("c")).alias("none"), O.dimension_alignment(F.col("h"), F.col("e")).alias("both")).head()
    assert (row["none"], row["both"]) == (0.5, 1.0)
