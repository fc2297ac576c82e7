import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators.ordered import quantiles, with_previous, with_row_index, with_running_sums


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one order value, and one group holds most rows."""
    rng = np.random.default_rng(7)
    n = 6000
    k = np.where(rng.random(n) < 0.35, 5.0, rng.normal(0, 10, n).round(1))
    g = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n))
    pdf = pd.DataFrame({"g": g, "k": k, "id": rng.permutation(n), "v": rng.integers(0, 9, n)})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_row_index_follows_the_order(skewed):
    pdf, df = skewed
    got = with_row_index(df, ["k", "id"], n_buckets=16).toPandas().sort_values("row_id")
    want = pdf.sort_values(["k", "id"])
    assert got["row_id"].tolist() == list(range(len(pdf)))
    assert got["id"].tolist() == want["id"].tolist()


def test_row_index_per_group(skewed):
    pdf, df = skewed
    got = with_row_index(df, ["k", "id"], "i", ["g"], n_buckets=16).toPandas().sort_values(["g", "i"])
    want = pdf.sort_values(["g", "k", "id"])
    assert got["id"].tolist() == want["id"].tolist()
    assert (got.groupby("g")["i"].max() + 1).to_dict() == pdf.groupby("g").size().to_dict()


def test_running_sums(skewed):
    pdf, df = skewed
    got = with_running_sums(df, ["k", "id"], {"s": F.col("v")}, ["g"], 12).toPandas().sort_values(["g", "k", "id"])
    want = pdf.sort_values(["g", "k", "id"]).groupby("g")["v"].cumsum()
    assert got["s"].tolist() == want.tolist()


def test_hot_value_is_cut_again(skewed):
    from plumbline.operators.ordered import with_order_bucket

    pdf, df = skewed
    largest = with_order_bucket(df, ["k", "id"], n_buckets=16).groupBy("_bucket").count().agg(F.max("count")).head()[0]
    assert largest < len(pdf) / 8


def test_quantiles_match_numpy(skewed):
    pdf, df = skewed
    got = {r["col"]: r for r in quantiles(df, ["k", "v"], {"a": 0.1, "b": 0.5, "c": 0.975}).collect()}
    for c in ("k", "v"):
        for name, p in (("a", 0.1), ("b", 0.5), ("c", 0.975)):
            assert got[c][name] == pytest.approx(np.quantile(pdf[c], p))
        assert got[c]["unique"] == pdf[c].nunique()


def test_previous(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 7.0)], "g string, i long, v double")
    got = {(r["g"], r["i"]): r["p"] for r in with_previous(df, ["g"], "i", "v", "p").collect()}
    assert got == {("a", 0): None, ("a", 1): 1.0, ("b", 0): None}


def test_no_window_without_partitions_over_data(skewed):
    _, df = skewed
    plan = with_row_index(df, ["k", "id"], n_buckets=16)._jdf.queryExecution().optimizedPlan().toString()
    # the only unpartitioned prefix runs over bucket totals, after an aggregate
    assert "row_number" not in plan.replace("_bucket", "")


def test_single_row_and_empty(spark):
    df = spark.createDataFrame([(1.0, 1)], "k double, id long")
    assert [r["row_id"] for r in with_row_index(df, ["k", "id"]).collect()] == [0]
    assert with_row_index(df.filter("id > 5"), ["k", "id"]).count() == 0


def test_long_strings_keep_their_order_and_share_buckets(spark):
    from plumbline.operators.ordered import with_order_bucket, with_row_index

    names = [f"Customer#{i:012d}" for i in range(0, 60000, 3)] + ["Customer#000000000009"] * 20000 + [None] * 20000 + ["", "Customer#", "zz"]
    rows = [(v, (i * 7919) % 1009, i) for i, v in enumerate(names)]
    df = spark.createDataFrame(rows, "name string, b int, c int").repartition(8)
    cut = with_order_bucket(df, ["name", "b", "c"])
    assert cut.groupBy("_bucket").count().agg({"count": "max"}).head()[0] < 8000
    got = [r.c for r in with_row_index(df, ["name", "b", "c"]).orderBy("row_id").collect()]
    assert got == [c for _, _, c in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1], r[2]))]
