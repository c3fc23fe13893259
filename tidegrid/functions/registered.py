"""The scores and costs of expr.py for SQL users, as temporary functions that the optimizer sees through."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .expr import CostProfile

_UNIT = "greatest(0D, least(1D, {}))"


def _definitions(profile: CostProfile) -> dict[str, str]:
    multiplier = "CASE h " + " ".join(f"WHEN {hours} THEN {by}D" for hours, by in profile.multipliers) + f" ELSE {dict(profile.multipliers).get(1, 1.0)}D END"
    risen = lambda c, ref, beta: f"(1 + {beta}D * least(3D, abs({c}) / {ref}D))"
    infra = f"CASE WHEN notional > 1e-9D THEN {profile.infra_usd_per_hour!r}D * h / notional * 1e4D ELSE {profile.infra_bps_per_hour}D * h END"
    parts = (
        f"{profile.fee_bps}D * {multiplier}",
        f"greatest(0D, ({profile.slippage_bps}D + 0.1D * spread_bps) * {multiplier} * (1 + {profile.liquidity}D * (1 - {_UNIT.format('liquidity')})))",
        f"{profile.impact_bps}D * {multiplier} * (1 + {profile.turnover}D * turnover) * (1 + 0.5D * greatest(0D, vol))",
        f"abs(funding) * {profile.funding}D * h * 1e4D",
        infra,
    )
    return {
        "quality_score(confidence DOUBLE, tier DOUBLE, freshness DOUBLE, coverage DOUBLE)": f"0.3D * confidence + 0.25D * {_UNIT.format('(6 - tier) / 5')} + 0.25D * freshness + 0.2D * coverage",
        "turnover_estimate(h DOUBLE, vol DOUBLE, liquidity DOUBLE, spread_bps DOUBLE, funding DOUBLE)": f"greatest(0.01D, least(3D, 0.35D / greatest(1D, sqrt(h)) * {risen('vol', 0.02, 0.8)} * (1 + 0.5D * (1 - {_UNIT.format('liquidity')})) * {risen('spread_bps', 8.0, 0.25)} * {risen('funding', 0.0005, 0.1)}))",
        "cost_bps(h DOUBLE, vol DOUBLE, liquidity DOUBLE, turnover DOUBLE, spread_bps DOUBLE, funding DOUBLE, notional DOUBLE)": " + ".join(f"({p})" for p in parts),
    }


def register(spark: SparkSession, profile: CostProfile = CostProfile()) -> None:
    """Creates quality_score, turnover_estimate and cost_bps in the session."""
    for signature, body in _definitions(profile).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS DOUBLE RETURN {body}")
