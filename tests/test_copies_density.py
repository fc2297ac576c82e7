import numpy as np
import pandas as pd

from plumbline.operators import localize as N, neighbours


def test_copies_count_without_being_repeated(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    rng = np.random.default_rng(7)
    x, w = rng.normal(size=(300, 3)), rng.integers(1, 9, 300)
    for weights, k in ((w, 11), (np.ones(300, int), 11), (w, 5000)):
        d = np.sort(np.repeat(((x[:, None] - x[None]) ** 2).sum(-1), weights, axis=1), axis=1)[:, :k]
        got = neighbours.nearest(x, weights, x, k)
        np.testing.assert_allclose(got[:, : d.shape[1]], d, atol=1e-12)
        assert np.isinf(got[:, d.shape[1] :]).all()


def test_density_of_a_table_of_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_POINTS", 40)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2)).repeat(rng.integers(1, 40, 300), axis=0)
    pdf = pd.DataFrame(x, columns=list("ab")).assign(id=range(len(x)))
    got = N.with_density(spark.createDataFrame(pdf).repartition(4), list("ab"), ["id"]).toPandas().sort_values("id")
    near = np.array([np.sort(np.sqrt(((p - x) ** 2).sum(-1)))[1:21].mean() for p in x])
    np.testing.assert_allclose(got["density"], 1 / (1 / (near + 1e-6) + 1e-6), rtol=1e-9, atol=1e-9)
    assert 0 < (near == 0).sum() < len(x)


def test_density_where_every_row_has_many_copies(spark):
    frame = spark.range(200).selectExpr("id", "cast(id % 4 as double) AS a")
    assert {r["density"] for r in N.with_density(frame, ["a"], ["id"]).collect()} == {1 / (1 / 1e-6 + 1e-6)}
