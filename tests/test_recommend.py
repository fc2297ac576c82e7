import pytest
from pyspark.sql import functions as F

from plumbline.operators import recommend as P

SCHEMA = (
    "validation_id long, rec_id string, priority int, impact double, success_probability double, variance double, total_usd double, roi double,"
    " risk_adjusted double, duration_days double, effort_hours double, feasibility double, complexity double, novelty double,"
    " dependencies array<string>, conflicts array<string>, synergies map<string,double>"
)


def rec(i, roi, usd=100.0, days=1.0, deps=(), conflicts=(), synergies=None, priority=2, impact=12.0):
    return (1, i, priority, impact, 0.8, 4.0, usd, roi, impact * 0.8, days, 8.0, 0.9, 0.2, 0.1, list(deps), list(conflicts), synergies or {})


def chosen(df):
    return [r["rec_id"] for r in df.orderBy("position").collect()]


def test_greedy_respects_links_and_caps(spark):
    rows = [rec("a", 0.9, conflicts=["c"]), rec("b", 0.8, deps=["z"]), rec("c", 0.7, conflicts=["a"]), rec("d", 0.6, usd=900.0), rec("e", 0.5, deps=["a"])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert chosen(P.select_plan(df)) == ["a", "d", "e"]
    assert chosen(P.select_plan(df, budget_usd=500.0)) == ["a", "e"]
    assert chosen(P.select_plan(df, limit=1)) == ["a"]


def test_execution_order_with_dependencies_and_synergy(spark):
    rows = [
        rec("a", 0.9, deps=["b"], priority=1), rec("b", 0.8, priority=3), rec("c", 0.7, priority=2),
        rec("d", 0.6, priority=2, synergies={"c": 2.0}), rec("e", 0.5, priority=2, impact=20.0),
    ]
    plan = spark.createDataFrame(rows, SCHEMA).withColumn("position", F.expr("ascii(rec_id) - 96"))
    got = [r["rec_id"] for r in P.execution_order(plan).orderBy("step").collect()]
    assert got == ["e", "c", "d", "b", "a"]


def test_plan_totals_with_synergy(spark):
    rows = [rec("a", 0.9, impact=10.0), rec("b", 0.8, impact=20.0, synergies={"a": 1.5})]
    plan = P.select_plan(spark.createDataFrame(rows, SCHEMA))
    overall = spark.createDataFrame([(1, 50.0)], "validation_id long, overall_score double")
    t = P.plan_totals(plan, overall).head()
    assert t["expected_impact"] == pytest.approx(10 + 20 * 1.5)
    assert t["success_probability"] == pytest.approx(0.64)
    assert t["projected_score"] == pytest.approx(90.0)
    assert t["total_duration_days"] == pytest.approx(1.4)
