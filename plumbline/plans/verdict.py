"""Full comparison of many dataset pairs: eight dimensions, roll-up, decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.classifier import distinguishability, generalization_gap
from ..operators.compare import KEY, distribution_fidelity, ecdf_merge, ecdf_summary, statistical_consistency
from ..operators.correlation import correlation_preservation
from ..operators.entropy import entropy_stability
from ..operators.common import checked_small
from ..operators.rollup import decide, fill_neutral, overall_score, with_severity
from ..operators.spectral import spectral_coherence
from .diversity import diversity_score


def pair_scores(
    pair: DataFrame,
    cols: Sequence[str],
    order_cols: Sequence[str],
    telemetry: DataFrame | None = None,
    normalise_spectrum: bool = True,
) -> DataFrame:
    """Scores of every validation in long form, severity included.

    The merged value table feeds both rank-based dimensions; it is summarised once to one row per validation
    and column. ``telemetry`` carries (validation_id, dimension, score) rows of the two training dimensions;
    without it they are neutral.
    """
    summary = ecdf_summary(ecdf_merge(pair, cols))
    local = checked_small(summary)
    summary = summary if local is None else local
    parts = {
        "distribution_fidelity": distribution_fidelity(pair, cols, summary),
        "correlation_preservation": correlation_preservation(pair, cols),
        "entropy_stability": entropy_stability(pair, cols),
        "spectral_coherence": spectral_coherence(pair, cols, order_cols, normalise=normalise_spectrum),
        "generalization_gap": generalization_gap(distinguishability(pair, cols, order_cols)),
        "statistical_consistency": statistical_consistency(pair, cols, summary),
    }
    scores = None
    for name, df in parts.items():
        rows = df.select(KEY, F.lit(name).alias("dimension"), "score")
        scores = rows if scores is None else scores.unionByName(rows)
    if telemetry is not None:
        scores = scores.unionByName(telemetry.select(KEY, "dimension", "score"))
    return with_severity(fill_neutral(scores).drop("threshold"))


def pair_verdict(pair: DataFrame, cols: Sequence[str], order_cols: Sequence[str], target_rows: int, telemetry: DataFrame | None = None) -> DataFrame:
    """Overall score, diversity of the synthetic side, decision and reasons per validation."""
    scores = pair_scores(pair, cols, order_cols, telemetry)
    local = checked_small(scores)  # eight rows per validation, read by three aggregates
    scores = scores if local is None else local
    diversity = diversity_score(pair.filter(F.col("side") == "syn"), cols, target_rows, [KEY])
    decision = decide(scores, diversity)
    return decision.join(overall_score(scores).select(KEY, "collapse_detected", F.col("confidence").alias("agreement")), KEY)
