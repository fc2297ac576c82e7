"""Fixes for many validations at once: candidates, costs, selection under a budget, order, totals.

A validation has at most five candidates (two templates and three situational fixes), so everything that is
sequential by nature happens inside one short array per validation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY = "validation_id"
FAILED_BELOW = 65.0
MAX_RECOMMENDATIONS = 10

# Priorities, hourly rates, templates and situational fixes of the reference catalogue.
PRIORITIES = {"critical": 1, "high": 2, "medium": 3, "low": 4}
USD_PER_HOUR = 100.0
USD_PER_GPU_HOUR = 2.0
PARALLEL_SHARE = 0.7

TEMPLATES = [
    # dimension, id, title, category, base impact, effort hours, dollar cost
    ("distribution_fidelity", "dist_Adva", "Advanced Data Augmentation", "data_augmentation", 15.0, 12.0, 300.0),
    ("correlation_preservation", "corr_Copu", "Copula-Based Generation", "feature_engineering", 12.0, 16.0, 400.0),
]
TEMPLATE_COSTS = {"gpu_hours": 5.0, "feasibility": 0.85, "complexity": 0.5, "novelty": 0.3}

LOCALIZATION_FIX = {
    "rec_id": "loc_001", "title": "Remove Problematic Data Samples", "category": "data_cleaning",
    "effort_hours": 2.0, "dollar_cost": 50.0, "gpu_hours": 0.5, "feasibility": 1.0, "complexity": 0.1, "novelty": 0.1,
    "duration_days": 0.5, "success_probability": 0.95, "variance": 25.0,
}
CRITICAL_FIX = {
    "rec_id": "crit_001", "title": "CRITICAL: Full Dataset Regeneration", "category": "dataset_regeneration",
    "effort_hours": 80.0, "dollar_cost": 5000.0, "gpu_hours": 100.0, "feasibility": 0.7, "complexity": 0.8, "novelty": 0.3,
    "duration_days": 14.0, "success_probability": 0.75, "variance": 400.0,
    "impact": 70.0, "impact_low": 50.0, "impact_high": 90.0, "priority": 1,
}
DIVERSITY_FIX = {
    "rec_id": "div_001", "title": "Enhance Dataset Diversity", "category": "data_augmentation",
    "effort_hours": 16.0, "dollar_cost": 400.0, "gpu_hours": 10.0, "feasibility": 0.9, "complexity": 0.4, "novelty": 0.2,
    "duration_days": 3.0, "success_probability": 0.85, "variance": 36.0,
    "impact": 15.0, "impact_low": 10.0, "impact_high": 22.0, "priority": 2,
}
DIVERSITY_SYNERGIES = {"dist_001": 1.2, "ent_001": 1.15}

FIELDS = [
    "rec_id", "title", "category", "priority", "impact", "impact_low", "impact_high", "success_probability", "variance",
    "effort_hours", "dollar_cost", "gpu_hours", "feasibility", "complexity", "novelty", "duration_days",
    "dependencies", "conflicts", "synergies",
]


def _no_links() -> dict[str, Column]:
    return {
        "dependencies": F.array().cast("array<string>"),
        "conflicts": F.array().cast("array<string>"),
        "synergies": F.create_map().cast("map<string,double>"),
    }


def _fix(values: dict, **columns: Column) -> list[Column]:
    cols = {k: F.lit(v) for k, v in values.items()} | _no_links() | columns
    return [cols[f].alias(f) for f in FIELDS]


def dimension_fixes(scores: DataFrame) -> DataFrame:
    """Template fixes for failed dimensions; the impact grows with the distance below 65."""
    spark = scores.sparkSession
    templates = spark.createDataFrame(
        TEMPLATES, "dimension string, rec_id string, title string, category string, base double, effort_hours double, dollar_cost double"
    )
    hit = scores.filter(F.col("score") < FAILED_BELOW).join(F.broadcast(templates), "dimension")  # fixed two-row table
    impact = F.col("base") * (1.0 + (FAILED_BELOW - F.col("score")) / 100.0)
    cols = {k: F.lit(v) for k, v in TEMPLATE_COSTS.items()} | _no_links() | {
        "rec_id": F.col("rec_id"), "title": F.col("title"), "category": F.col("category"),
        "priority": F.when(F.col("score") < 50, 2).otherwise(3),
        "impact": impact, "impact_low": impact * 0.7, "impact_high": impact * 1.3,
        "success_probability": F.lit(0.8), "variance": F.lit(100.0),
        "effort_hours": F.col("effort_hours"), "dollar_cost": F.col("dollar_cost"), "duration_days": F.col("effort_hours") / 8.0,
    }
    return hit.select(KEY, *[cols[f].alias(f) for f in FIELDS])


def localization_fix(summary: DataFrame) -> DataFrame:
    """Removal of flagged rows when they exceed 5 %."""
    p = F.col("problem_pct").cast("double")
    return summary.filter(p > 5).select(KEY, *_fix(
        LOCALIZATION_FIX,
        priority=F.when(p > 20, 1).otherwise(2),
        impact=F.least(F.lit(30.0), p * 1.5), impact_low=F.least(F.lit(20.0), p), impact_high=F.least(F.lit(40.0), p * 2),
    ))


def critical_fix(overall: DataFrame) -> DataFrame:
    """Regeneration for an overall score below 30."""
    return overall.filter((F.col("overall_score") < 50) & (F.col("overall_score") < 30)).select(KEY, *_fix(CRITICAL_FIX))


def diversity_fix(diversity: DataFrame) -> DataFrame:
    """Diversity work for a diversity score below 60."""
    synergies = F.create_map(*[F.lit(x) for kv in DIVERSITY_SYNERGIES.items() for x in kv])
    return diversity.filter(F.col("diversity_score") < 60).select(KEY, *_fix(DIVERSITY_FIX, synergies=synergies))


def candidates(scores: DataFrame, overall: DataFrame, diversity: DataFrame, localization: DataFrame) -> DataFrame:
    """All candidate fixes of all validations."""
    parts = [dimension_fixes(scores), localization_fix(localization), critical_fix(overall), diversity_fix(diversity)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def predict_impact(recs: DataFrame) -> DataFrame:
    """Heuristic prediction: bounds at 70 % and 130 %, variance from their width, 80 % success."""
    i = F.col("impact")
    return (
        recs.withColumn("impact_low", i * 0.7)
        .withColumn("impact_high", i * 1.3)
        .withColumn("variance", F.pow((i * 1.3 - i * 0.7) / 4.0, F.lit(2.0)))
        .withColumn("success_probability", F.lit(0.8))
    )


def with_costs(recs: DataFrame) -> DataFrame:
    """Add total cost, return on investment and risk-adjusted impact."""
    usd = F.col("dollar_cost") + USD_PER_HOUR * F.col("effort_hours") + USD_PER_GPU_HOUR * F.col("gpu_hours")
    return recs.withColumn("total_usd", usd).withColumn("roi", F.col("impact") / F.greatest(F.lit(1.0), usd)).withColumn(
        "risk_adjusted", F.col("impact") * F.col("success_probability")
    )


def success_probability(feasibility: Column, std: Column, complexity: Column, novelty: Column) -> Column:
    p = feasibility - F.least(F.lit(0.3), std / 20.0) - 0.2 * complexity - 0.15 * novelty
    return F.greatest(F.lit(0.1), F.least(F.lit(0.99), p))


def within_budget(recs: DataFrame, budget_usd: float | None = None, days: float | None = None) -> DataFrame:
    """Candidates that fit the caps on their own."""
    if budget_usd is not None:
        recs = recs.filter(F.col("total_usd") <= budget_usd)
    if days is not None:
        recs = recs.filter(F.col("duration_days") <= days)
    return recs


OBJECTIVES = {"max_impact": "risk_adjusted", "min_cost": "-total_usd", "balanced": "roi"}


def select_plan(
    recs: DataFrame,
    objective: str = "balanced",
    budget_usd: float | None = None,
    days: float | None = None,
    limit: int | Column = MAX_RECOMMENDATIONS,
) -> DataFrame:
    """Greedy choice per validation in objective order under running caps, dependencies and conflicts.

    The fold runs over the short candidate array of one validation. Adds ``position`` (1-based choice order).
    """
    rank = {"max_impact": F.col("risk_adjusted"), "min_cost": -F.col("total_usd")}.get(objective, F.col("roi"))
    kinds = {f.name: f.dataType.simpleString() for f in recs.schema.fields}
    payload = F.struct(*[c for c in recs.columns if c != KEY])
    # highest objective first; equal ones by id
    item = F.struct((-rank).alias("o"), F.col("rec_id").alias("i"), payload.alias("r"))
    per = recs.withColumn("_item", item)
    limit_col = limit if isinstance(limit, Column) else F.lit(limit)
    grouped = per.groupBy(KEY).agg(F.collect_list("_item").alias("_items"), F.first(limit_col).alias("_limit"))
    ordered = F.array_sort("_items", lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0))
    row_type = recs.drop(KEY).schema.simpleString()
    state_type = f"struct<rows:array<{row_type}>,ids:array<string>,cost:double,days:double>"
    start = F.struct(
        F.array().alias("rows"), F.array().alias("ids"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("days")
    ).cast(state_type)

    def step(s: Column, x: Column) -> Column:
        r = x["r"]
        fits = F.size(s["ids"]) < F.col("_limit")
        if budget_usd is not None:
            fits = fits & (s["cost"] + r["total_usd"] <= budget_usd)
        if days is not None:
            fits = fits & (s["days"] + r["duration_days"] <= days)
        fits = fits & (F.size(F.array_except(r["dependencies"], s["ids"])) == 0)
        fits = fits & ~F.arrays_overlap(r["conflicts"], s["ids"])
        taken = F.struct(
            F.concat(s["rows"], F.array(r)).alias("rows"),
            F.concat(s["ids"], F.array(r["rec_id"])).alias("ids"),
            (s["cost"] + r["total_usd"]).alias("cost"),
            (s["days"] + r["duration_days"]).alias("days"),
        )
        return F.when(fits, taken.cast(state_type)).otherwise(s)

    plan = grouped.withColumn("_plan", F.aggregate(ordered, start, step))
    # the outer form keeps the optimizer from adding filters that would run the fold again
    out = plan.select(KEY, F.posexplode_outer("_plan.rows").alias("_p", "_r")).filter(F.col("_r").isNotNull())
    return out.select(KEY, (F.col("_p") + 1).alias("position"), *[F.col(f"_r.{c}").alias(c) for c in kinds if c != KEY])


def simple_priority(recs: DataFrame, limit: int = MAX_RECOMMENDATIONS) -> DataFrame:
    """First fixes by priority, then impact; a validation has a handful of rows."""
    w = Window.partitionBy(KEY).orderBy("priority", F.desc("impact"), "rec_id")
    return recs.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def execution_order(plan: DataFrame) -> DataFrame:
    """Topological order per plan; among the available fixes the one with the best priority, impact and synergy.

    A fold over the at most ten fixes of one plan: every step moves the best available fix to the result.
    """
    item = F.struct("position", "rec_id", "priority", "risk_adjusted", "dependencies", "synergies")
    grouped = plan.groupBy(KEY).agg(F.collect_list(item).alias("_items"))
    ids = F.transform("_items", lambda x: x["rec_id"])
    steps = F.sequence(F.lit(1), F.size("_items"))

    def step(done: Column, _: Column) -> Column:
        def ready(x: Column) -> Column:
            missing = F.array_except(F.array_intersect(x["dependencies"], ids), done)
            return ~F.array_contains(done, x["rec_id"]) & (F.size(missing) == 0)

        def scored(x: Column) -> Column:
            bonus = F.aggregate(done, F.lit(0.0), lambda s, p: s + 50.0 * F.coalesce(F.try_element_at(x["synergies"], p), F.lit(0.0)))
            return F.struct(
                ((5 - x["priority"]) * 100.0 + x["risk_adjusted"] + bonus).alias("s"), (-x["position"]).alias("p"), x["rec_id"].alias("i")
            )

        best = F.array_max(F.transform(F.filter("_items", ready), scored))["i"]
        return F.when(best.isNull(), done).otherwise(F.concat(done, F.array(best)))

    ordered = F.aggregate(steps, F.array().cast("array<string>"), step)
    out = grouped.select(KEY, F.posexplode_outer(ordered).alias("_p", "rec_id")).filter(F.col("rec_id").isNotNull())
    return out.select(KEY, (F.col("_p") + 1).cast("int").alias("step"), "rec_id")


def plan_totals(plan: DataFrame, overall: DataFrame) -> DataFrame:
    """Expected impact with synergies of earlier choices, bounds, success, cost, effort, duration, projected score."""
    short = plan.groupBy(KEY).agg(
        F.collect_list(F.struct("position", "rec_id", "impact", "synergies")).alias("_items"),
        F.sum("variance").alias("_variance"),
        F.count(F.lit(1)).alias("recommendations"),
        F.exp(F.sum(F.ln("success_probability"))).alias("success_probability"),
        F.sum("total_usd").alias("total_cost_usd"),
        F.sum("effort_hours").alias("total_effort_hours"),
        (F.sum("duration_days") * PARALLEL_SHARE).alias("total_duration_days"),
    )

    def boosted(x: Column) -> Column:
        earlier = F.filter("_items", lambda y: y["position"] < x["position"])
        factor = F.aggregate(earlier, F.lit(1.0), lambda m, y: m * F.coalesce(F.try_element_at(x["synergies"], y["rec_id"]), F.lit(1.0)))
        return x["impact"] * factor

    impact = F.aggregate(F.transform("_items", boosted), F.lit(0.0), lambda s, x: s + x)
    out = short.withColumn("expected_impact", impact)
    spread = 1.96 * F.sqrt("_variance")
    out = out.withColumn("impact_low", F.greatest(F.lit(0.0), F.col("expected_impact") - spread)).withColumn(
        "impact_high", F.least(F.lit(100.0), F.col("expected_impact") + spread)
    )
    scored = out.join(overall.select(KEY, "overall_score"), KEY)
    return scored.withColumn("projected_score", F.least(F.lit(100.0), F.col("overall_score") + F.col("expected_impact"))).drop(
        "_items", "_variance", "overall_score"
    )


def quick_wins(plan: DataFrame) -> DataFrame:
    """Under two days, more than ten points, feasibility above 0.8."""
    return plan.filter((F.col("duration_days") < 2) & (F.col("impact") > 10) & (F.col("feasibility") > 0.8))


def alternative_plans(recs: DataFrame, plan: DataFrame, objective: str = "balanced") -> DataFrame:
    """Cheapest and strongest plan of the same size without caps: size, impact, cost."""
    sizes = plan.groupBy(KEY).agg(F.count(F.lit(1)).alias("_size"))
    sized = recs.join(sizes, KEY)
    out = None
    for other in ("min_cost", "max_impact"):
        if other == objective:
            continue
        chosen = select_plan(sized, other, limit=F.col("_size"))
        totals = plan_totals(chosen, chosen.select(KEY).distinct().withColumn("overall_score", F.lit(0.0)))
        row = totals.select(
            KEY, F.lit(other).alias("objective"), "recommendations", F.col("expected_impact").alias("total_impact"), F.col("total_cost_usd").alias("total_cost")
        )
        out = row if out is None else out.unionByName(row)
    return out


def plan_summary(plan: DataFrame, overall: DataFrame) -> DataFrame:
    """Severity band, counts per priority, standout fixes and the risk of the plan."""
    per = plan.groupBy(KEY).agg(
        *[F.count_if(F.col("priority") == v).alias(f"{k}_count") for k, v in PRIORITIES.items()],
        F.max_by("rec_id", F.struct(F.col("impact"), -F.col("position"))).alias("highest_impact"),
        F.min_by("rec_id", F.struct(F.col("duration_days"), F.col("position"))).alias("quickest"),
        F.max_by("rec_id", F.struct(F.col("roi"), -F.col("position"))).alias("best_roi"),
        F.count_if(F.col("complexity") > 0.7).alias("high_complexity"),
        F.count_if(F.col("feasibility") < 0.6).alias("low_feasibility"),
        F.count_if(F.col("novelty") > 0.5).alias("novel"),
        F.exp(F.sum(F.ln("success_probability"))).alias("success_probability"),
    )
    s, p = F.col("overall_score"), F.col("success_probability")
    band = F.when(s < 30, "CRITICAL").when(s < 50, "SEVERE").when(s < 65, "MODERATE").otherwise("MINOR")
    # the product is compared a hair above the limit so that float noise does not move a plan between bands
    risk = F.when(p > 0.8 + 1e-9, "LOW").when(p > 0.6 + 1e-9, "MEDIUM").otherwise("HIGH")
    return per.join(overall.select(KEY, "overall_score"), KEY).withColumn("severity", band).withColumn("risk", risk).drop("overall_score")


def fix_priority(gains: DataFrame) -> DataFrame:
    """Priority 1..4 from the drop in risk a fix brings."""
    g = F.col("risk_drop")
    return gains.withColumn("priority", F.when(g > 20, 1).when(g >= 10, 2).when(g >= 5, 3).otherwise(4))


def clip_to_sigma(df: DataFrame, cols: Sequence[str], sigmas: float = 3.0) -> DataFrame:
    """Pull values further than ``sigmas`` deviations from the mean back to that distance."""
    return _sigma_limits(df, cols, sigmas, lambda c, lo, hi: F.greatest(F.least(F.col(c), hi), lo))


def drop_beyond_sigma(df: DataFrame, cols: Sequence[str], sigmas: float = 5.0) -> DataFrame:
    """Remove rows with a value further than ``sigmas`` deviations from the column mean."""
    limits = _limits(df, cols, sigmas)
    keep = F.lit(True)
    for c in cols:
        lo, hi = limits[c]
        keep = keep & F.coalesce(F.col(c).between(lo, hi), F.lit(True))
    return df.filter(keep)


def _limits(df: DataFrame, cols: Sequence[str], sigmas: float) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(c).alias(f"{p}_{c}") for c in cols for p, f in (("m", F.avg), ("s", F.stddev_samp))]).head()
    return {c: (row[f"m_{c}"] - sigmas * row[f"s_{c}"], row[f"m_{c}"] + sigmas * row[f"s_{c}"]) for c in cols}


def _sigma_limits(df, cols, sigmas, make):
    limits = _limits(df, cols, sigmas)
    return df.select(*[make(c, F.lit(limits[c][0]), F.lit(limits[c][1])).alias(c) if c in limits else F.col(c) for c in df.columns])
