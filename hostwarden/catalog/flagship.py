"""The full pipeline over the derived telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hostwarden.catalog.base import ev
from hostwarden.operators import threat_intel as I
from hostwarden.plans.scoring import Intel, score_events, train_model
from hostwarden.session import stage
from hostwarden.sources import sample_tables as T

_SCORED: dict[tuple[str, str], DataFrame] = {}


def intel_tables(events: DataFrame) -> Intel:
    seen = stage(T.addresses(events), "seen")
    return Intel(T.intel_abuse(events, seen), T.intel_geo(events, seen), I.flatten_pulses(T.intel_otx(events, seen)), T.intel_malware(events))


def scored_events(spark: SparkSession, sf_dir: str, with_model: bool = True) -> DataFrame:
    """Every gated event, scored; the anomaly model is trained on the same range."""
    events = ev(spark, sf_dir)
    model = train_model(events) if with_model else None
    return score_events(events, model=model, intel=intel_tables(events))


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's output without a model, stored once per session for the reports and sinks."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SCORED:
        _SCORED[key] = stage(scored_events(spark, sf_dir, with_model=False), "scored")
    return _SCORED[key]
