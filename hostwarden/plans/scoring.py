"""The whole scoring pipeline: heuristics, gate, correlation, anomaly, intel, rules, severity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from hostwarden.config import Config
from hostwarden.operators import anomaly_features, correlation, feedback as fb, heuristics, isolation_forest, sigma, threat_intel
from hostwarden.operators.heuristics import DEFAULT_RULES, HeuristicRule
from hostwarden.operators.patterns import DEFAULT_PATTERNS, Pattern
from hostwarden.schema import FEATURES
from hostwarden.session import stage as write_stage
from hostwarden.sources.sigma_rules import active_rules


@dataclass(frozen=True)
class Intel:
    """Provider tables; a missing one is skipped."""

    abuse: DataFrame | None = None
    geo: DataFrame | None = None
    otx: DataFrame | None = None
    malware: DataFrame | None = None
    custom: Mapping[str, DataFrame] = field(default_factory=dict)


def score_events(
    events: DataFrame,
    cfg: Config = Config(),
    sigma_rules: Sequence[dict] | None = None,
    model: DataFrame | None = None,
    intel: Intel | None = None,
    heuristic_rules: Sequence[HeuristicRule] = DEFAULT_RULES,
    patterns: Sequence[Pattern] = DEFAULT_PATTERNS,
    feedback: DataFrame | None = None,
    gate: bool = True,
    include_related: bool = False,
    staged: bool = True,
) -> DataFrame:
    """Score events in the fixed stage order; later stages only see events with heuristic points unless ``gate`` is off.

    ``staged`` writes the result of the stages that several consumers read (heuristics, correlation)
    to the shared folder, so that wide inputs are not recomputed. ``include_related`` adds the
    related entity IDs of every event; their number is always there as ``related_count``. Rules are the shipped ones and
    those of the folder ``cfg.sigma_rules_dir``, or exactly ``sigma_rules``.
    """
    keep = write_stage if staged else (lambda df, name: df)
    if feedback is not None:
        weights = fb.weight_map(fb.stats(feedback), [r.name for r in heuristic_rules])
        scored = heuristics.score(events.crossJoin(F.broadcast(weights)), heuristic_rules, F.col("weights")).drop("weights")
    else:
        scored = heuristics.score(events, heuristic_rules)
    if gate:
        scored = heuristics.gate(scored)
    scored = gated = keep(scored, "heuristic")

    if cfg.correlator.enabled:
        scored = correlation.correlate(scored, cfg.correlator, patterns)
        if include_related:
            scored = correlation.correlated_with(keep(scored, "correlated"), cfg.correlator)
    else:
        scored = scored.withColumns({
            "source_count": F.lit(0), "multiplier": F.lit(None).cast("double"), "related_count": F.lit(0),
            "patterns": F.array().cast("array<string>"), "pattern_bonus": F.lit(0.0),
        })

    if cfg.anomaly.enabled and model is not None:
        # Both stages are keyed by (seq, host), so the wide rows are shuffled once for both joins.
        points = isolation_forest.score(anomaly_features.features(gated, cfg.anomaly.window_sec), model, cfg.anomaly)
        columns = scored.columns
        scored = scored.join(points.select("host_id", "seq", "anomaly_score"), ["seq", "host_id"]).select(*columns, "anomaly_score")
    else:
        scored = scored.withColumn("anomaly_score", F.lit(0.0))
    scored = scored.withColumn("anomaly_bonus", isolation_forest.bonus(F.col("anomaly_score")))

    if intel is not None:
        scored = threat_intel.enrich(scored, intel.abuse, intel.geo, intel.otx, intel.malware, intel.custom, threat_intel.distinct_addresses(gated))
    else:
        scored = scored.withColumns({
            "threat_intel": F.lit(None).cast("struct<geoip:struct<country_code:string>>"), "intel_bonus": F.lit(0.0),
        })
    scored = sigma.evaluate(scored, active_rules(events.sparkSession, cfg.sigma_rules_dir) if sigma_rules is None else sigma_rules)
    return heuristics.with_severity(scored.withColumn("score", total_score()))


def total_score() -> Column:
    return (
        correlation.effective_score(F.col("heuristic_score"))
        + F.col("anomaly_bonus") + F.col("intel_bonus") + F.col("sigma_bonus")
    )


def train_model(events: DataFrame, cfg: Config = Config()) -> DataFrame | None:
    """Fit the anomaly model on a baseline range of events; None below the minimum number of rows."""
    baseline = write_stage(heuristics.gate(heuristics.score(events)), "baseline")
    features = write_stage(anomaly_features.features(baseline, cfg.anomaly.window_sec), "features")
    model = isolation_forest.fit(features, cfg.anomaly)
    return None if model is None else write_stage(model, "model")
