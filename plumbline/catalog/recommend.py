"""Fix planning."""

from pyspark.sql import functions as F

from ..operators import recommend as P, rollup as M
from ..session import table
from .fixtures import DIVERSITY_SQL, SCORES_SQL, order_diversity, order_scores
from .registry import query

OVER = f"SELECT validation_id, avg(score) AS overall_score FROM ({SCORES_SQL}) GROUP BY 1"
T_ROWS = ", ".join(f"('{t[0]}', '{t[1]}', {t[4]}, {t[5]}, {t[6]})" for t in P.TEMPLATES)
CAND_SQL = f"""SELECT validation_id, rec_id, priority, impact::DOUBLE AS impact, impact_low::DOUBLE AS impact_low, impact_high::DOUBLE AS impact_high, p::DOUBLE AS success_probability, variance::DOUBLE AS variance,
 hours::DOUBLE AS effort_hours, usd::DOUBLE AS dollar_cost, gpu::DOUBLE AS gpu_hours, feas::DOUBLE AS feasibility, cx::DOUBLE AS complexity, nov::DOUBLE AS novelty, days::DOUBLE AS duration_days FROM (
 SELECT validation_id, rec_id, CASE WHEN score < 50 THEN 2 ELSE 3 END AS priority, base * (1 + (65 - score) / 100) AS impact, base * (1 + (65 - score) / 100) * 0.7 AS impact_low,
  base * (1 + (65 - score) / 100) * 1.3 AS impact_high, 0.8 AS p, 100 AS variance, hours, usd, 5 AS gpu, 0.85 AS feas, 0.5 AS cx, 0.3 AS nov, hours / 8 AS days
 FROM ({SCORES_SQL}) JOIN (VALUES {T_ROWS}) t(dimension, rec_id, base, hours, usd) USING (dimension) WHERE score < 65
 UNION ALL SELECT validation_id, 'loc_001', CASE WHEN problem_pct > 20 THEN 1 ELSE 2 END, least(30, problem_pct * 1.5), least(20, problem_pct), least(40, problem_pct * 2), 0.95, 25, 2, 50, 0.5, 1, 0.1, 0.1, 0.5 FROM ({DIVERSITY_SQL}) WHERE problem_pct > 5
 UNION ALL SELECT validation_id, 'crit_001', 1, 70, 50, 90, 0.75, 400, 80, 5000, 100, 0.7, 0.8, 0.3, 14 FROM ({OVER}) WHERE overall_score < 30
 UNION ALL SELECT validation_id, 'div_001', 2, 15, 10, 22, 0.85, 36, 16, 400, 10, 0.9, 0.4, 0.2, 3 FROM ({DIVERSITY_SQL}) WHERE diversity_score < 60)"""
CAND_FLOATS = "impact impact_low impact_high success_probability variance effort_hours dollar_cost gpu_hours feasibility complexity novelty duration_days"
FLAT = ["validation_id", "rec_id", "priority", *CAND_FLOATS.split()]


def overall(spark, d):
    return M.overall_score(order_scores(spark, d)).select("validation_id", "overall_score")


def cands(spark, d):
    div = order_diversity(spark, d)
    return P.candidates(order_scores(spark, d), overall(spark, d), div, div)


@query("recommendation_candidates", CAND_SQL, 6, CAND_FLOATS)
def _(spark, d):
    return cands(spark, d).select(*FLAT)


@query("localization_fix", f"SELECT * FROM ({CAND_SQL}) WHERE rec_id = 'loc_001'", 6, CAND_FLOATS)
def _(spark, d):
    return P.localization_fix(order_diversity(spark, d)).select(*FLAT)


@query("critical_fix", f"SELECT * FROM ({CAND_SQL}) WHERE rec_id = 'crit_001'", 6, CAND_FLOATS)
def _(spark, d):
    return P.critical_fix(overall(spark, d)).select(*FLAT)


@query("diversity_fix", f"SELECT * FROM ({CAND_SQL}) WHERE rec_id = 'div_001'", 6, CAND_FLOATS)
def _(spark, d):
    return P.diversity_fix(order_diversity(spark, d)).select(*FLAT)


PRED_SQL = f"""SELECT * REPLACE (impact * 0.7 AS impact_low, impact * 1.3 AS impact_high, ((impact * 1.3 - impact * 0.7) / 4) ** 2 AS variance, 0.8 AS success_probability) FROM ({CAND_SQL})"""


@query("predict_impact", f"SELECT validation_id, rec_id, impact_low, impact_high, variance, success_probability::DOUBLE AS success_probability FROM ({PRED_SQL})", 7, "impact_low impact_high variance success_probability")
def _(spark, d):
    return P.predict_impact(cands(spark, d)).select("validation_id", "rec_id", "impact_low", "impact_high", "variance", "success_probability")


COST_SQL = f"""SELECT *, impact / greatest(1, total_usd) AS roi, impact * success_probability AS risk_adjusted FROM (
 SELECT *, dollar_cost + 100 * effort_hours + 2 * gpu_hours AS total_usd FROM ({PRED_SQL}))"""


def costed(spark, d):
    return P.with_costs(P.predict_impact(cands(spark, d)))


@query("recommendation_costs", f"SELECT validation_id, rec_id, total_usd, roi, risk_adjusted FROM ({COST_SQL})", 6, "total_usd roi risk_adjusted")
def _(spark, d):
    return costed(spark, d).select("validation_id", "rec_id", "total_usd", "roi", "risk_adjusted")


@query("success_probability", f"""SELECT validation_id, rec_id, greatest(0.1, least(0.99, feasibility - least(0.3, sqrt(variance) / 20) - 0.2 * complexity - 0.15 * novelty)) AS success_probability FROM ({CAND_SQL})""", 6, "success_probability")
def _(spark, d):
    p = P.success_probability(F.col("feasibility"), F.sqrt("variance"), F.col("complexity"), F.col("novelty"))
    return cands(spark, d).select("validation_id", "rec_id", p.alias("success_probability"))


BUDGET, DAYS = 4000.0, 6.0


@query("within_budget", f"SELECT validation_id, rec_id FROM ({COST_SQL}) WHERE total_usd <= {BUDGET} AND duration_days <= {DAYS}")
def _(spark, d):
    return P.within_budget(costed(spark, d), BUDGET, DAYS).select("validation_id", "rec_id")


def plan(spark, d, objective="balanced"):
    return P.select_plan(P.within_budget(costed(spark, d), BUDGET, DAYS), objective, BUDGET, DAYS)


# the greedy fold as recursion over the rank of each candidate (at most five per validation)
def greedy_sql(order: str) -> str:
    return f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY validation_id ORDER BY {order}, rec_id) AS i FROM ({COST_SQL}) WHERE total_usd <= {BUDGET} AND duration_days <= {DAYS}),
g AS (SELECT validation_id, 0::BIGINT AS i, NULL::VARCHAR AS rec_id, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS days, 0::BIGINT AS position, false AS taken FROM (SELECT DISTINCT validation_id FROM c)
 UNION ALL SELECT c.validation_id, c.i, c.rec_id, CASE WHEN f THEN cost + total_usd ELSE cost END, CASE WHEN f THEN days + duration_days ELSE days END, CASE WHEN f THEN position + 1 ELSE position END, f
 FROM (SELECT c.*, g.cost, g.days, g.position, (g.cost + c.total_usd <= {BUDGET} AND g.days + c.duration_days <= {DAYS} AND g.position < 10) AS f FROM g JOIN c ON c.validation_id = g.validation_id AND c.i = g.i + 1) c),
pl AS (SELECT c.*, g.position FROM g JOIN c USING (validation_id, i) WHERE taken)"""


BALANCED = greedy_sql("-roi")


@query("select_plan_balanced", f"{BALANCED} SELECT validation_id, position::INT AS position, rec_id FROM pl")
def _(spark, d):
    return plan(spark, d).select("validation_id", "position", "rec_id")


@query("select_plan_max_impact", f"{greedy_sql('-risk_adjusted')} SELECT validation_id, position::INT AS position, rec_id FROM pl")
def _(spark, d):
    return plan(spark, d, "max_impact").select("validation_id", "position", "rec_id")


@query("select_plan_min_cost", f"{greedy_sql('total_usd')} SELECT validation_id, position::INT AS position, rec_id FROM pl")
def _(spark, d):
    return plan(spark, d, "min_cost").select("validation_id", "position", "rec_id")


@query("simple_priority", f"SELECT * FROM (SELECT validation_id, rec_id, row_number() OVER (PARTITION BY validation_id ORDER BY priority, impact DESC, rec_id)::INT AS position FROM ({COST_SQL})) WHERE position <= 3")
def _(spark, d):
    return P.simple_priority(costed(spark, d), 3).select("validation_id", "rec_id", "position")


# no dependencies and no synergies among these candidates, so the order is by priority and impact
@query("execution_order", f"{BALANCED} SELECT validation_id, row_number() OVER (PARTITION BY validation_id ORDER BY (5 - priority) * 100 + risk_adjusted DESC, position)::INT AS step, rec_id FROM pl")
def _(spark, d):
    return P.execution_order(plan(spark, d))


TOTALS = f"""{BALANCED}, t AS (SELECT validation_id, count(*) AS recommendations, sum(impact) AS expected_impact, sqrt(sum(variance)) AS sd, exp(sum(ln(success_probability))) AS success_probability,
 sum(total_usd) AS total_cost_usd, sum(effort_hours) AS total_effort_hours, sum(duration_days) * 0.7 AS total_duration_days FROM pl GROUP BY 1)
SELECT validation_id, recommendations, expected_impact, success_probability, total_cost_usd, total_effort_hours, total_duration_days,
 greatest(0, expected_impact - 1.96 * sd) AS impact_low, least(100, expected_impact + 1.96 * sd) AS impact_high, least(100, overall_score + expected_impact) AS projected_score FROM t JOIN ({OVER}) USING (validation_id)"""


@query("plan_totals", TOTALS, 7, "expected_impact success_probability total_cost_usd total_effort_hours total_duration_days impact_low impact_high projected_score")
def _(spark, d):
    return P.plan_totals(plan(spark, d), overall(spark, d))


@query("quick_wins", f"{BALANCED} SELECT validation_id, rec_id FROM pl WHERE duration_days < 2 AND impact > 10 AND feasibility > 0.8")
def _(spark, d):
    return P.quick_wins(plan(spark, d)).select("validation_id", "rec_id")


def top_of(order):
    return f"SELECT *, row_number() OVER (PARTITION BY validation_id ORDER BY {order}, rec_id) AS i FROM c JOIN n USING (validation_id)"


@query("alternative_plans", f"""{BALANCED}, n AS (SELECT validation_id, count(*) AS size FROM pl GROUP BY 1)
SELECT validation_id, 'min_cost' AS objective, count(*) AS recommendations, sum(impact) AS total_impact, sum(total_usd) AS total_cost FROM ({top_of("total_usd").replace("AS i", "AS k")}) WHERE k <= size GROUP BY 1
UNION ALL SELECT validation_id, 'max_impact', count(*), sum(impact), sum(total_usd) FROM ({top_of("-risk_adjusted").replace("AS i", "AS k")}) WHERE k <= size GROUP BY 1""", 5, "total_impact total_cost")
def _(spark, d):
    return P.alternative_plans(P.within_budget(costed(spark, d), BUDGET, DAYS), plan(spark, d))


@query("plan_summary", f"""{BALANCED}, s AS (SELECT validation_id, count_if(priority = 1)::BIGINT AS critical_count, count_if(priority = 2)::BIGINT AS high_count, count_if(priority = 3)::BIGINT AS medium_count, count_if(priority = 4)::BIGINT AS low_count,
 first(rec_id ORDER BY impact DESC, position) AS highest_impact, first(rec_id ORDER BY duration_days, position) AS quickest, first(rec_id ORDER BY roi DESC, position) AS best_roi,
 count_if(complexity > 0.7)::BIGINT AS high_complexity, count_if(feasibility < 0.6)::BIGINT AS low_feasibility, count_if(novelty > 0.5)::BIGINT AS novel, exp(sum(ln(success_probability))) AS success_probability FROM pl GROUP BY 1)
SELECT s.*, CASE WHEN overall_score < 30 THEN 'CRITICAL' WHEN overall_score < 50 THEN 'SEVERE' WHEN overall_score < 65 THEN 'MODERATE' ELSE 'MINOR' END AS severity,
 CASE WHEN success_probability > 0.8 + 1e-9 THEN 'LOW' WHEN success_probability > 0.6 + 1e-9 THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM s JOIN ({OVER}) USING (validation_id)""", 6, "success_probability")
def _(spark, d):
    return P.plan_summary(plan(spark, d), overall(spark, d))


@query("fix_priority", f"SELECT validation_id, rec_id, CASE WHEN g > 20 THEN 1 WHEN g >= 10 THEN 2 WHEN g >= 5 THEN 3 ELSE 4 END AS priority FROM (SELECT validation_id, rec_id, impact * success_probability AS g FROM ({CAND_SQL}))")
def _(spark, d):
    gains = cands(spark, d).select("validation_id", "rec_id", (F.col("impact") * F.col("success_probability")).alias("risk_drop"))
    return P.fix_priority(gains).drop("risk_drop")


@query("clip_to_sigma", "SELECT event_id, least(greatest(value, m - 3 * s), m + 3 * s) AS value FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)", 6, "value")
def _(spark, d):
    return P.clip_to_sigma(table(spark, d, "events").select("event_id", "value"), ["value"])


@query("drop_beyond_sigma", "SELECT event_id FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) WHERE abs(value - m) <= 5 * s")
def _(spark, d):
    return P.drop_beyond_sigma(table(spark, d, "events").select("event_id", "value"), ["value"]).select("event_id")
