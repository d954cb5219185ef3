"""Analyst feedback: label counts, weights and the false-positive rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

ALPHA = 2.0


def stats(feedback: DataFrame) -> DataFrame:
    """Total, true and false positives per rule name."""
    fp = F.coalesce(F.col("false_positive"), F.lit(False)).cast("int")
    return feedback.groupBy("rule_name").agg(
        F.count(F.lit(1)).alias("total"), F.sum(1 - fp).alias("true_positives"), F.sum(fp).alias("false_positives")
    )


def weight_factor() -> Column:
    """Share of a rule's base weight that its false positives leave; 1 without labels."""
    return F.when(F.col("total") > 0, F.pow(1 - F.col("false_positives") / F.col("total"), F.lit(ALPHA))).otherwise(1.0)


def effective_weights(rules: DataFrame, stats_table: DataFrame) -> DataFrame:
    """``rules(rule_name, base_weight)`` with ``effective_weight``."""
    return rules.join(stats_table, "rule_name", "left").select(
        *rules.columns, (F.col("base_weight") * F.coalesce(weight_factor(), F.lit(1.0))).alias("effective_weight")
    )


def weight_map(stats_table: DataFrame, rule_names: Sequence[str]) -> DataFrame:
    """One row with a map of the factors of the given rules (at most one entry per rule)."""
    return stats_table.where(F.col("rule_name").isin(*rule_names)).agg(
        F.map_from_entries(F.collect_list(F.struct("rule_name", weight_factor()))).alias("weights")
    )


def fp_rate(feedback: DataFrame, min_labels: int = 10, threshold: float = 0.3) -> DataFrame:
    """One row: labels, false positives, rate (0 without labels) and whether the rate is exceeded."""
    fp = F.coalesce(F.col("false_positive"), F.lit(False)).cast("int")
    totals = feedback.agg(F.count(F.lit(1)).alias("labels"), F.coalesce(F.sum(fp), F.lit(0)).alias("false_positives"))
    rate = F.when(F.col("labels") > 0, F.col("false_positives") / F.col("labels")).otherwise(0.0)
    return totals.withColumn("fp_rate", rate).withColumn(
        "exceeded", (F.col("labels") >= min_labels) & (F.col("fp_rate") > threshold)
    )
