"""Cases in which a cap, a prefix or a null key used to drop part of a result."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.special import anderson_darling_sigma, harmonic
from plumbline.operators.classifier import distinguishability
from plumbline.operators.common import lookup_join, wide_aggregate
from plumbline.operators.entropy import effective_dimensions
from plumbline.operators.pairs import stack_pair
from plumbline.operators.localize import exact_duplicates
from plumbline.operators.profile import column_stats, dataset_fingerprint
from plumbline.operators.sampling import balanced_sample, random_cap
from plumbline.operators.spectral import psd
from plumbline.sources.sinks import build_report, write_problem_rows


def test_wide_aggregate_keeps_the_null_group(spark):
    df = spark.createDataFrame([("x", 1.0), (None, 2.0), (None, 3.0)], "g string, v double")
    out = wide_aggregate(df, ["g"], [F.sum("v").alias(f"s{i}") for i in range(401)])
    assert {r["g"]: (r["s0"], r["s400"]) for r in out.collect()} == {"x": (1.0, 1.0), None: (5.0, 5.0)}


def test_null_keys_meet_their_aggregates(spark):
    df = spark.createDataFrame([("x", 1.0), (None, 2.0), (None, 4.0)], "g string, v double")
    sizes = df.groupBy("g").agg(F.count("*").alias("n"))
    assert sorted((r["g"] or "", r["n"]) for r in lookup_join(df, sizes, ["g"]).collect()) == [("", 2), ("", 2), ("x", 1)]
    assert sorted((r["g"] or "", r["n"]) for r in lookup_join(df, sizes, ["g"], max_rows=1).collect()) == [("", 2), ("", 2), ("x", 1)]
    stats = {r["g"]: r for r in column_stats(df, ["v"], ["g"]).collect()}
    assert (stats[None]["unique"], stats[None]["median"]) == (2, 3.0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_samples_are_whole_when_ids_repeat(spark, seed):
    df = spark.range(20_000).select(F.when(F.col("id") % 20 == 0, F.col("id")).otherwise(-1).alias("id"), F.col("id").alias("v"))
    rows = random_cap(df, 1000, ["id"], seed).collect()
    assert len(rows) == 1000 and len({r["v"] for r in rows}) == 1000


def test_samples_of_distinct_ids_have_the_lowest_digests(spark):
    df = spark.range(5000)
    digest = df.withColumn("h", F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit("42"))))
    want = {r["id"] for r in digest.orderBy("h").limit(300).collect()}
    assert {r["id"] for r in random_cap(df, 300, ["id"]).collect()} == want


@pytest.mark.parametrize("n", [0, 3, 10])
def test_samples_of_tiny_tables(spark, n):
    assert random_cap(spark.range(n), 5, ["id"]).count() == min(n, 5)


def test_balanced_sample_of_a_null_validation(spark):
    rows = [(None, s, i) for s, k in (("syn", 7), ("orig", 4)) for i in range(k)]
    pair = spark.createDataFrame(rows, "validation_id string, side string, id long")
    assert {r["side"]: r["count"] for r in balanced_sample(pair, 100, ["id"], ["validation_id"]).groupBy("side").count().collect()} == {"syn": 4, "orig": 4}


def test_one_null_counts_as_zero_in_a_spectrum(spark):
    def spectrum(gap):
        rows = [("v", side, i, gap if i == 5 and side == "syn" else float(np.sin(i))) for side in ("syn", "orig") for i in range(100)]
        pair = spark.createDataFrame(rows, "validation_id string, side string, id long, x double")
        return psd(pair, ["x"], ["id"]).orderBy("side", "freq").toPandas()["power"].to_numpy()

    with_null = spectrum(None)
    assert np.isfinite(with_null).all() and with_null.sum() > 0
    np.testing.assert_allclose(with_null, spectrum(0.0))


def test_spectrum_has_one_length_at_every_size(spark):
    rng = np.random.default_rng(7)
    values = {"short": rng.normal(size=24), "even": rng.normal(size=64), "long": rng.normal(size=150)}
    rows = [(v, "syn", i, float(y)) for v, x in values.items() for i, y in enumerate(x)]
    pair = spark.createDataFrame(rows, "validation_id string, side string, id long, x double")
    for normalise in (False, True):
        got = psd(pair, ["x"], ["id"], 64, normalise).orderBy("freq").toPandas()
        for v, x in values.items():
            blocks = [np.pad(x[i : i + 64], (0, 64 - len(x[i : i + 64]))) for i in range(0, len(x), 64)]
            power = np.sum([np.abs(np.fft.rfft(b)) ** 2 for b in blocks], axis=0)
            np.testing.assert_allclose(got[got["validation_id"] == v]["power"], power / (len(x) if normalise else len(blocks)))


def test_anderson_darling_by_one_formula():
    for n in (4, 7, 50):
        g = sum(1 / ((n - i) * j) for i in range(1, n) for j in range(i + 1, n))
        assert harmonic(n - 1, 2) - 2 * harmonic(n - 1) / n == pytest.approx(g, rel=1e-10)
        assert harmonic(n) == pytest.approx(sum(1 / i for i in range(1, n + 1)), rel=1e-11)
    half = 5_000_000
    assert anderson_darling_sigma(half, half) == pytest.approx(anderson_darling_sigma(half + 1, half + 1), rel=1e-9)


def side_by_side(spark, x, y):
    data = pd.DataFrame(x, columns=[f"f{i}" for i in range(x.shape[1])]).assign(validation_id="v", side=np.where(y == 1, "orig", "syn"), row=range(len(y)))
    return spark.createDataFrame(data), [f"f{i}" for i in range(x.shape[1])]


def test_forest_tells_apart_only_what_differs(spark):
    rng = np.random.default_rng(5)
    y = np.repeat([0.0, 1.0], 1000)
    noise = rng.normal(size=(2000, 4))
    shifted = noise + np.array([0, 0, 3.0, 0]) * y[:, None]
    accuracy = lambda x: distinguishability(*side_by_side(spark, x, y), ["row"]).head()["test_accuracy"]
    assert accuracy(shifted) > 0.85
    assert 0.4 < accuracy(noise) < 0.6
    assert accuracy(np.ones((2000, 4))) == pytest.approx(0.5, abs=0.1)


def test_forest_is_as_good_as_the_library_forest(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(9)
    y = np.repeat([0.0, 1.0], 6000)
    x = rng.normal(size=(12000, 6))
    x[:, 1] += 0.9 * y
    x[:, 4] *= 1 + y
    pair, names = side_by_side(spark, x, y)
    ours = distinguishability(pair, names, ["row"]).head()
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(pair.selectExpr("*", "double(side = 'orig') AS label"))
    taught, held = rows.randomSplit([0.7, 0.3], 42)
    judged = RandomForestClassifier(numTrees=10, maxDepth=5, seed=42).fit(taught).transform(held)
    assert ours["test_accuracy"] == pytest.approx(judged.selectExpr("avg(double(prediction = label))").head()[0], abs=0.02)


def test_forest_of_odd_pairs(spark):
    shape = "validation_id string, side string, row long, x double"
    rows = [(None, s, i, float(i) + 50 * (s == "syn")) for s in ("syn", "orig") for i in range(40)] + [("one", "syn", 1, None), ("one", "orig", 1, float("inf"))] + [("half", "syn", 1, 1.0)]
    out = {r["validation_id"]: r for r in distinguishability(spark.createDataFrame(rows, shape), ["x"], ["row"]).collect()}
    assert out[None]["train_accuracy"] > 0.9 and 0 <= out["one"]["test_accuracy"] <= 1 and "half" in out
    assert distinguishability(spark.createDataFrame([], shape), ["x"], ["row"]).collect() == []
    assert distinguishability(spark.createDataFrame(rows, shape), [], ["row"]).filter("test_accuracy != 0.5").collect() == []


def test_three_hundred_validations_in_one_call(spark):
    ids = spark.range(300).select(F.col("id").cast("string").alias("validation_id"))
    rows = ids.crossJoin(spark.range(20).withColumnRenamed("id", "row")).crossJoin(spark.createDataFrame([("syn",), ("orig",)], "side string"))
    pair = rows.withColumn("x", F.col("row") + F.when(F.col("side") == "syn", 100.0).otherwise(0.0)).withColumn("y", F.lit(None).cast("double"))
    out = distinguishability(pair, ["x", "y"], ["row"]).collect()
    assert len(out) == 300 and np.mean([r["train_accuracy"] for r in out]) > 0.9


def test_effective_dimensions_of_sixty_columns(spark):
    data = pd.DataFrame(np.random.default_rng(1).normal(size=(500, 60)), columns=[f"f{i}" for i in range(60)])
    frame = spark.createDataFrame(data)
    out = effective_dimensions(stack_pair(frame, frame)).head().asDict()
    assert any(isinstance(v, (int, float)) and v > 45 for v in out.values())


@pytest.mark.parametrize("other", [("a", "b|c"), ("a\\|b", "c"), ("a|b|c", None), (None, "a|b|c")])
def test_rows_with_other_fields_have_other_hashes(spark, other):
    schema = "x string, y string"
    prints = [dataset_fingerprint(spark.createDataFrame([r], schema)).head() for r in (("a|b", "c"), other)]
    assert prints[0] != prints[1]
    twice = spark.createDataFrame([(i, *r) for i, r in enumerate([("a|b", "c"), other] * 2)], "id long, " + schema)
    assert exact_duplicates(twice, ["x", "y"], "id").select("content_hash").distinct().count() == 2


def test_null_is_not_its_mark(spark):
    prints = [dataset_fingerprint(spark.createDataFrame([(v,)], "x string")).head() for v in (None, "\\N", "N")]
    assert len({p["hash_a"] for p in prints}) == 3


def test_a_report_counts_all_rows_and_the_table_holds_them(spark, tmp_path):
    decision = spark.createDataFrame([("v", True, 0.9, "r", 80.0, 70.0)], "validation_id string, approved boolean, confidence double, reason string, overall_score double, diversity_score double")
    scores = spark.createDataFrame([("v", "d", 1.0)], "validation_id string, dimension string, score double")
    top = spark.range(250).select(F.lit("v").alias("validation_id"), F.col("id").alias("row_id"), (F.col("id") % 10).cast("double").alias("impact"))
    place = build_report(decision, scores, top).head()["localization"]
    assert place["listed_rows"] == 250
    assert place["row_ids"] == [i for k in range(9, 5, -1) for i in range(k, 250, 10)]
    write_problem_rows(top, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 250
