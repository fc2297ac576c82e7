import random

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import localize as N
from plumbline.operators.near import components, near_duplicates


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame(rng.normal(size=(600, 3)), columns=list("abc"))
    pdf["b"] += 0.5 * pdf["a"]
    pdf.loc[0, list("abc")] = [9.0, -9.0, 9.0]
    pdf["id"] = range(len(pdf))
    return pdf, spark.createDataFrame(pdf)


def test_mahalanobis_matches_numpy(rows, monkeypatch):
    pdf, df = rows
    x = pdf[list("abc")].to_numpy()
    p = np.linalg.inv(np.cov(x.T) + 1e-6 * np.eye(3))
    d = x - x.mean(axis=0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", d, p, d))
    got = N.mahalanobis(df, list("abc")).toPandas().sort_values("id")["mahalanobis"]
    assert np.allclose(got, want / want.max())
    monkeypatch.setattr(N, "MAX_EXPRESSION_COLUMNS", 1)
    again = N.mahalanobis(df, list("abc")).toPandas().sort_values("id")["mahalanobis"]
    assert np.allclose(again, got)


def test_density_matches_brute_force(rows):
    pdf, df = rows
    got = N.with_density(df, list("abc"), ["id"]).toPandas().sort_values("id")["density"].to_numpy()
    x = pdf[list("abc")].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    mean = np.sort(d, axis=1)[:, :20].mean(axis=1)
    assert np.allclose(got, 1 / (1 / (mean + 1e-6) + 1e-6))


def test_outlier_ranks_first(rows):
    _, df = rows
    scores = N.impact_scores(df, list("abc"), ["id"])
    assert N.top_rows(scores, ["id"], 1).head()["id"] == 0
    assert N.problem_summary(scores).head()["problem_rows"] == 1


def test_regions(spark):
    flagged = spark.createDataFrame([(i, 0.85) for i in [1, 2, 3, 7, 9, 20]], "row_id long, impact double")
    strict = sorted((r["row_start"], r["row_end"], r["rows"]) for r in N.problem_regions(flagged).collect())
    assert strict == [(1, 3, 3), (7, 7, 1), (9, 9, 1), (20, 20, 1)]
    merged = sorted((r["row_start"], r["row_end"], r["rows"]) for r in N.problem_regions(flagged, gap=4).collect())
    assert merged == [(1, 9, 5), (20, 20, 1)]


def test_ablation_confirms_the_bad_region(spark):
    rng = np.random.default_rng(4)
    orig = pd.DataFrame({"side": "orig", "region": 0, "x": rng.normal(size=900)})
    good = pd.DataFrame({"side": "syn", "region": 1, "x": rng.normal(size=900)})
    bad = pd.DataFrame({"side": "syn", "region": 2, "x": np.full(300, 2.5)})
    got = {r["region"]: r for r in N.ablate(spark.createDataFrame(pd.concat([orig, good, bad])), ["x"]).collect()}
    assert got[2]["confirmed"] and not got[1]["confirmed"]


def test_density_counts_a_small_dense_group_and_copies(spark, monkeypatch):
    from plumbline.operators import neighbours

    monkeypatch.setattr(neighbours, "CELL_POINTS", 200)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUESTIONS", 50)
    monkeypatch.setattr(neighbours, "HOT_ROWS", 100)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 3)) * [100.0, 10.0, 1.0]
    x[:30] = [900.0, 0.0, 0.0] + rng.normal(size=(30, 3)) * 0.01  # too few to be met by a sample of 1000
    x[30:400] = x[30]
    x[400:410] = x[400]
    pdf = pd.DataFrame(x, columns=list("abc")).assign(id=range(len(x)))
    pdf.loc[3999, "b"] = np.nan
    got = N.with_density(spark.createDataFrame(pdf).repartition(5), list("abc"), ["id"]).toPandas().sort_values("id")
    x = np.nan_to_num(pdf[list("abc")].to_numpy())
    near = np.empty(len(x))
    for start in range(0, len(x), 500):
        d = np.sqrt(((x[start : start + 500, None] - x[None]) ** 2).sum(-1))
        near[start : start + 500] = np.sort(d, axis=1)[:, 1:21].mean(axis=1)
    assert list(got["id"]) == list(range(len(x)))
    np.testing.assert_allclose(got["density"], 1 / (1 / (near + 1e-6) + 1e-6), rtol=1e-9)


def test_near_duplicates_of_odd_rows(spark):
    text = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, text(1)), (1, text(1)), (2, text(1).upper()), (3, text(1).replace("w1x59", "end")), (4, None), (5, ""), (None, text(1)), (6, "one two"), (7, "One  two"), (8, "one three"), (9, text(9, 30_000)), (10, text(9, 30_000) + " more")]
    frame = spark.createDataFrame([(i, t, 1, [2]) for i, t in rows], "doc_id long, text string, size int, buckets array<int>").repartition(5)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.exact_id, r.cluster_id, r.cluster_size, r.kept) for r in near_duplicates(frame).collect()))
    assert got == [
        (False, 1, 56, 1, 1, 4, True), (False, 1, 56, 1, 1, 4, True), (False, 2, 56, 1, 1, 4, False), (False, 3, 56, 3, 1, 4, False), (False, 4, 0, 4, 4, 1, True), (False, 5, 0, 5, 5, 1, True),
        (False, 6, 1, 6, 6, 2, True), (False, 7, 1, 6, 6, 2, False), (False, 8, 1, 8, 8, 1, True), (False, 9, 29_996, 9, 9, 2, True), (False, 10, 29_997, 10, 9, 2, False), (True, 0, 0, None, None, 1, True)]
    assert near_duplicates(frame.filter("doc_id > 99")).collect() == []


def test_near_duplicates_of_a_large_mutated_group(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(rng.choice("uvwxyz") * 3 if rng.random() < 0.012 else w for w in base) for _ in range(250)]
    texts += [" ".join(base[:100] + [f"t{k}_{i}" for i in range(60)]) for k in range(40)]  # share a passage, are not near
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    same = sum(r.cluster_id == root(r.doc_id) for r in got)
    assert same >= 0.95 * len(texts) and len({root(i) for i in range(len(texts))}) < len(texts)
    # no cluster joins what the exact similarity does not
    assert all(root(r.cluster_id) == root(r.doc_id) for r in got)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, i) for i in range(900, 990)] + [(5, 5), (3, 2)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 201)}, **{i: 900 for i in [1000, *range(900, 990)]}}
