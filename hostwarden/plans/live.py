"""Reports over a running stream: the risk state is read from its state store, decayed to the time asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostwarden.config import Thresholds
from hostwarden.functions import expr as X
from hostwarden.operators.risk_state import KEY, SEC, tick


def entities(spark: SparkSession, checkpoint: str, as_of_us: int, th: Thresholds = Thresholds(), operator_id: int = 0, batch_id: int | None = None) -> DataFrame:
    """Entities of a stream that ends in ``track_risk``, as ``risk_state.snapshot`` gives them.

    ``as_of_us`` must not be before the stream's newest event. ``operator_id`` numbers the stateful operators from the sink
    backwards; ``batch_id`` reads an earlier committed micro-batch. The query may be running.
    """
    reader = spark.read.format("statestore").option("operatorId", operator_id).option("stateVarName", "memories")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    held = reader.load(checkpoint).select("key.host_id", "list_element.*")
    rows = held.where("risk IS NOT NULL").select(*KEY, "risk.*")
    line_us, per = th.tick_sec * SEC, th.decay_per_tick
    now, blocked = tick(F.lit(as_of_us), th), F.col("state") == 4
    empty = F.col("line") + F.greatest(F.ceil(F.col("score") / per), F.lit(1))
    old = F.call_function("div", F.col("last_us") + th.evict_after_sec * SEC, F.lit(line_us)) + 1
    score = F.when(blocked, F.col("score")).otherwise(F.greatest(F.col("score") - F.greatest(now - F.col("line"), F.lit(0)) * per, F.lit(0.0)))
    present = rows.where(blocked | (now < F.greatest(empty, old)))
    return present.select(
        *KEY, "source", score.alias("score"), F.when(blocked, 4).otherwise(X.classify_state(score, th)).alias("state"),
        F.col("first_us").alias("first_seen_us"), F.col("last_us").alias("last_event_us"), F.col("events").alias("event_count"),
    ).withColumn("state_label", X.state_label(F.col("state")))
