"""Score drift against a training baseline, and the retraining decision."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from hostwarden.config import AnomalyConfig
from hostwarden.functions import expr as X
from hostwarden.operators import scan

SEC = 1_000_000


def baseline(scores: DataFrame, score_col: str = "anomaly_score") -> DataFrame:
    """One row: mean and population stddev of the training scores."""
    mean, std = X.mean_stddev(F.col(score_col))
    return scores.agg(F.count(F.lit(1)).alias("n"), mean.alias("base_mean"), std.alias("base_std"))


def recent(scores: DataFrame, window: int = 200) -> DataFrame:
    """The last ``window`` scores."""
    return scores.orderBy(F.desc("ts"), F.desc("seq")).limit(window)


def test(scores: DataFrame, base: DataFrame, cfg: AnomalyConfig = AnomalyConfig(), score_col: str = "anomaly_score") -> DataFrame:
    """One row: recent mean, drift in baseline stddevs, and whether it exceeds the limit."""
    now = recent(scores, cfg.drift_window_size).agg(
        F.count(F.lit(1)).alias("recent_n"), F.avg(score_col).alias("recent_mean")
    )
    usable = (F.col("base_std") != 0) & (F.col("recent_n") > 0)
    shift = F.abs(F.col("recent_mean") - F.col("base_mean"))
    return base.crossJoin(now).select(
        "base_mean", "base_std", "recent_n", "recent_mean",
        F.when(usable, shift / F.col("base_std")).otherwise(0.0).alias("drift_sigma"),
        F.coalesce(usable & (shift > cfg.drift_threshold * F.col("base_std")), F.lit(False)).alias("drifted"),
    )


def checks(
    scores: DataFrame, feedback: DataFrame, cfg: AnomalyConfig = AnomalyConfig(), score_col: str = "anomaly_score",
) -> DataFrame:
    """One row per host and check time, with what a check may need of the scores and labels before it.

    ``rank`` scores so far and their sums ``s1`` and ``s2`` (of squares), the same sums as they stood ``drift_window_size`` scores ago
    (``w1``) and ``max_buffer`` scores ago (``b1``, ``b2``), and all ``labels`` and ``fps`` so far. Everything is looked up in running
    sums at the check times.
    """
    width = cfg.check_interval_min * 60 * SEC
    rows = scores.select("host_id", X.micros("ts").alias("us"), "seq", F.col(score_col).cast("double").alias("v")).withColumn(
        "chunk", scan.time_chunk(F.col("us"), 60)
    )
    ranked = scan.running(rows, ["host_id"], ["us", "seq"], "chunk", sums={"rank": F.lit(1), "s1": F.col("v"), "s2": F.col("v") * F.col("v")})
    # A check at time c sees the scores before c.
    at = scan.int_div(F.col("us"), width) + 1
    last = ranked.groupBy("host_id", at.alias("check_no")).agg(
        F.max_by(F.struct("rank", "s1", "s2"), F.struct("us", "seq")).alias("l")
    ).select("host_id", "check_no", "l.*")
    before = ranked.select("host_id", "rank", "s1", "s2")
    window = before.select("host_id", (F.col("rank") + cfg.drift_window_size).alias("rank"), F.col("s1").alias("w1"))
    buffer = before.select("host_id", (F.col("rank") + cfg.max_buffer).alias("rank"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    known = last.join(window, ["host_id", "rank"], "left").join(buffer, ["host_id", "rank"], "left").fillna(0.0, ["w1", "b1", "b2"])
    fp = F.coalesce(F.col("false_positive"), F.lit(False)).cast("int")
    labels = feedback.groupBy((scan.int_div(X.micros("ts"), width) + 1).alias("check_no")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(fp).alias("f")
    )
    spans = known.groupBy("host_id").agg(F.min("check_no").alias("lo"), F.max("check_no").alias("hi"))
    grid = spans.select("host_id", F.explode(F.sequence("lo", "hi")).alias("check_no"))
    zero = F.lit(0).cast("bigint")
    # Labels are not tied to a host: one running total over the check times, by days.
    counted = labels.unionByName(grid.select("check_no", zero.alias("n"), zero.alias("f")).distinct()).groupBy("check_no").agg(
        F.sum("n").alias("n"), F.sum("f").alias("f")
    ).withColumns({"all": F.lit(0), "day": scan.int_div(F.col("check_no"), 288)})
    totals = scan.running(counted, ["all"], ["check_no"], "day", sums={"labels": F.col("n"), "fps": F.col("f")}).select("check_no", "labels", "fps")
    upto = Window.partitionBy("host_id").orderBy("check_no").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("rank").isNotNull(), F.struct("rank", "s1", "s2", "w1", "b1", "b2")), ignorenulls=True).over(upto)
    joined = grid.join(known, ["host_id", "check_no"], "left").join(totals, "check_no")
    return joined.select(
        "host_id", "check_no", F.timestamp_micros(F.col("check_no") * width).alias("check_ts"), seen.alias("k"), "labels", "fps"
    ).select("host_id", "check_no", "check_ts", "k.*", "labels", "fps")


def retrain_decisions(check_table: DataFrame, base: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """Checks that retrain, with the reason.

    A retrain makes the last ``max_buffer`` scores the new baseline and empties the window, so the next checks see only scores
    after it; a retrain for false positives is followed by three quiet checks. This is a fold over a host's checks: one small row per check
    interval. ``base`` is the first baseline (``baseline``), the scores are taken as they are: a renewed model's own
    scores only exist where it runs (``streaming.jobs.drift_handler``).
    """
    first = base.select("base_mean", "base_std")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("check_no")
        mean, std = float(group["base_mean"].iat[0] or 0.0), float(group["base_std"].iat[0] or 0.0)
        since, since_sum, last_fp, out = 0, 0.0, None, []
        for row in group.itertuples(index=False):
            held = min(row.rank - since, cfg.drift_window_size)
            earlier = row.w1 if row.rank - cfg.drift_window_size >= since else since_sum
            shift = abs((row.s1 - earlier) / held - mean) if held and std else 0.0
            drifted = bool(std) and shift > cfg.drift_threshold * std
            rate = row.fps / row.labels if row.labels else 0.0
            due = bool(row.labels >= cfg.min_feedback and rate > cfg.fp_rate_threshold and (last_fp is None or row.check_no - last_fp > 3))
            out.append((shift / std if std else 0.0, drifted, rate, due))
            if due:
                last_fp = row.check_no
            if (drifted or due) and row.rank >= cfg.min_training_rows:
                n = min(row.rank, cfg.max_buffer)
                mean = (row.s1 - row.b1) / n
                std = max((row.s2 - row.b2) / n - mean * mean, 0.0) ** 0.5
                since, since_sum = row.rank, row.s1
        return group[["host_id", "check_ts"]].assign(**{c: [o[k] for o in out] for k, c in enumerate(("drift_sigma", "drifted", "fp_rate", "fp_due"))})

    folded = check_table.crossJoin(F.broadcast(first)).groupBy("host_id").applyInPandas(
        fold, "host_id string, check_ts timestamp, drift_sigma double, drifted boolean, fp_rate double, fp_due boolean",
    )
    return folded.where(F.col("drifted") | F.col("fp_due")).select(
        "host_id", "check_ts", "drift_sigma", "fp_rate", "drifted", "fp_due",
        F.concat_ws(
            " + ",
            F.when(F.col("drifted"), F.format_string("score mean shifted %.1fσ", "drift_sigma")),
            F.when(F.col("fp_due"), F.format_string("FP rate %.0f%%", F.col("fp_rate") * 100)),
        ).alias("reason"),
    )
