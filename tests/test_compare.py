import math

import numpy as np
import pandas as pd
import pytest

from plumbline.functions.special import anderson_darling_sigma, chi2_tail, normal_two_sided
from plumbline.operators import compare as C
from plumbline.operators.correlation import correlation_matrix, correlation_preservation
from plumbline.operators.entropy import effective_dimensions, entropy_stability
from plumbline.operators.pairs import stack_pair, trim_to_common


def frame(spark, seed, n=400, shift=0.0, d=3):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(rng.normal(shift, 1, (n, d)), columns=[f"f{i}" for i in range(d)])


def make_pair(spark, syn, orig):
    return stack_pair(spark.createDataFrame(syn), spark.createDataFrame(orig))


def test_special_values():
    assert chi2_tail(30.14352720564616, 19) == pytest.approx(0.05, rel=1e-9)
    assert chi2_tail(3.0, 2) == pytest.approx(math.exp(-1.5))
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    # limit of the standard deviation for large samples
    assert anderson_darling_sigma(5000, 5000) == pytest.approx(math.sqrt(2 * (math.pi**2 - 9) / 3), rel=5e-3)


def test_identical_pair_is_perfect(spark):
    data = frame(spark, 42)
    pair = make_pair(spark, data, data)
    cols = ["f0", "f1", "f2"]
    f = C.distribution_fidelity(pair, cols).head()
    for name in C.FIDELITY_WEIGHTS:
        assert f[name] == pytest.approx(100.0, abs=1e-6)
    assert f["passed"]
    assert correlation_preservation(pair, cols).head()["score"] == pytest.approx(100.0, abs=1e-5)
    assert entropy_stability(pair, cols).head()["score"] == pytest.approx(100.0, abs=1e-5)
    s = C.statistical_consistency(pair, cols).head()
    assert s["chi2_consistency"] == pytest.approx(100.0) and s["mann_whitney"] == pytest.approx(100.0)


def test_rank_statistics_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 12, 60).astype(float), rng.integers(2, 15, 45).astype(float)
    pair = make_pair(spark, pd.DataFrame({"f": x}), pd.DataFrame({"f": y}))
    row = C.ecdf_summary(C.ecdf_merge(pair, ["f"])).head()
    grid = np.unique(np.concatenate([x, y]))
    fx, fy = [(x <= g).mean() for g in grid], [(y <= g).mean() for g in grid]
    assert row["ks"] == pytest.approx(np.abs(np.subtract(fx, fy)).max())
    assert row["area"] == pytest.approx(np.sum(np.abs(np.subtract(fx, fy))[:-1] * np.diff(grid)))
    u = sum((a > y).sum() + 0.5 * (a == y).sum() for a in x)
    assert row["u_s"] == pytest.approx(u)
    # midrank Anderson-Darling, straight from its definition
    z, n = np.concatenate([x, y]), len(x) + len(y)
    a2 = 0.0
    for s in (x, y):
        for g in grid:
            l, f = (z == g).sum(), (s == g).sum()
            b, m = (z < g).sum() + l / 2, (s < g).sum() + f / 2
            if b * (n - b) - n * l / 4 > 0:
                a2 += l / n * (n * m - len(s) * b) ** 2 / (b * (n - b) - n * l / 4) / len(s)
    assert row["a2"] == pytest.approx(a2 * (n - 1) / n)


def test_collapsed_pair_scores_lower(spark):
    good = frame(spark, 1, 500)
    tiled = pd.concat([good.head(5)] * 100, ignore_index=True)
    healthy = C.distribution_fidelity(make_pair(spark, frame(spark, 2, 500), good)).head()["score"]
    collapsed = C.distribution_fidelity(make_pair(spark, tiled, good)).head()["score"]
    assert collapsed < healthy


def test_partitioning_does_not_matter(spark):
    pair = make_pair(spark, frame(spark, 5), frame(spark, 6, shift=0.3))
    a = C.distribution_fidelity(pair.repartition(1)).head().asDict()
    b = C.distribution_fidelity(pair.orderBy("f0").repartition(7)).head().asDict()
    assert {k: pytest.approx(v) for k, v in a.items()} == b


def test_edges(spark):
    data = frame(spark, 1, 50)
    data.iloc[0, 0] = np.nan
    pair = make_pair(spark, data, frame(spark, 2, 50))
    assert 0 <= C.distribution_fidelity(pair).head()["score"] <= 100
    constant = pd.DataFrame(np.ones((50, 3)), columns=["f0", "f1", "f2"])
    flat = make_pair(spark, constant, frame(spark, 2, 50))
    assert 0 <= correlation_preservation(flat, ["f0", "f1", "f2"]).head()["score"] <= 100
    with pytest.raises(ValueError):
        trim_to_common(spark.createDataFrame(data).filter("1 = 0"), spark.createDataFrame(data))
    syn, orig = trim_to_common(spark.createDataFrame(frame(spark, 1, 10, d=3)), spark.createDataFrame(frame(spark, 1, 10, d=5)))
    assert syn.columns == orig.columns == ["f0", "f1", "f2"]


def test_correlation_paths_agree_with_missing_values(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame(rng.normal(size=(300, 4)), columns=list("abcd"))
    data["b"] += data["a"]
    df = spark.createDataFrame(data.mask(rng.random(data.shape) < 0.1))
    plain = {(r[0], r[1]): r[2] for r in correlation_matrix(df, list("abcd")).collect()}
    blocks = {(r[0], r[1]): r[2] for r in correlation_matrix(df, list("abcd"), max_pairs=0).collect()}
    assert plain.keys() == blocks.keys()
    for k in plain:
        assert plain[k] == pytest.approx(blocks[k], abs=1e-9)


def test_effective_dimensions(spark):
    rng = np.random.default_rng(1)
    orig = pd.DataFrame(rng.normal(size=(500, 4)), columns=list("abcd"))
    syn = orig.copy()
    syn["b"], syn["c"], syn["d"] = syn["a"], syn["a"], syn["a"]
    row = effective_dimensions(make_pair(spark, syn, orig), list("abcd")).head()
    assert (row["dims_s"], row["dims_o"]) == (1, 4)
