"""Per-process correlation: source multiplier, live-node patterns and related entities.

A node is the latest event of an entity under one (host, pid). It is live from its event until
the entity's next event or until the time window has passed. Instead of listing the live nodes of
every event, each node adds to a set of counters when it starts and subtracts when it ends, so the
cost is linear in the events however dense a process is.

Rows are cut into slices of the prune interval (5 min). A slice also receives the rows of the last
window before it, which makes every slice self-contained: one shuffle by (host, pid, slice), and a
busy pid is spread over as many tasks as it has slices. Sorts begin with the pid (see ``scan``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostwarden.config import CorrelatorConfig
from hostwarden.functions import expr as X
from hostwarden.operators.patterns import BEACON, DEFAULT_PATTERNS, Pattern, node_flags
from hostwarden.operators.scan import int_div

SEC = 1_000_000
BEACON_HISTORY = 20
SOURCE_BITS = {"process": 1, "network": 2, "filesystem": 4, "resource": 8}
OTHER_SOURCE_BIT = 16


def has_pid() -> Column:
    return F.coalesce(F.col("pid"), F.lit(0)) != 0


def _slice_us(cfg: CorrelatorConfig) -> int:
    if cfg.retention_sec % cfg.prune_every_sec or cfg.time_window_sec > cfg.prune_every_sec:
        raise ValueError("retention must be a multiple of the prune interval, and the window no longer than it")
    return cfg.prune_every_sec * SEC


def _keyed(events: DataFrame, cfg: CorrelatorConfig) -> DataFrame:
    """Events with a pid, plus their time in microseconds and their slice."""
    us = X.micros("ts")
    return events.where(has_pid()).withColumns(
        {"_us": us, "_slice": int_div(us, _slice_us(cfg))}
    )


def source_count(events: DataFrame, cfg: CorrelatorConfig = CorrelatorConfig()) -> DataFrame:
    """Sources seen under (host, pid) in the slices before each slice and not yet pruned, as a bit mask."""
    back = cfg.retention_sec // cfg.prune_every_sec
    seen = _keyed(events, cfg).groupBy("host_id", "pid", "_slice").agg(F.bit_or(_source_bit()).alias("mask"))
    return (
        seen.select("host_id", "pid", "mask", F.explode(F.array(*[F.col("_slice") + i for i in range(1, back + 1)])).alias("_slice"))
        .groupBy("host_id", "pid", "_slice").agg(F.bit_or("mask").alias("_carry_mask"))
    )


def is_regular(times: Column) -> Column:
    """Beacon test over ascending times in microseconds: at least 5, mean gap at least 1 s, stddev < 15 % of the mean."""

    def of_gaps(gaps: Column, mean: Column) -> Column:
        spread = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + F.pow(g - mean, F.lit(2))) / F.size(gaps)
        return (mean >= 1) & (F.sqrt(spread) < mean * 0.15)

    def of_times(t: Column) -> Column:
        n = F.size(t)
        gaps = F.zip_with(F.slice(t, F.lit(2), n - 1), F.slice(t, F.lit(1), n - 1), lambda b, a: (b - a) / F.lit(1e6))
        mean = lambda g: F.aggregate(g, F.lit(0.0), lambda acc, v: acc + v) / F.size(g)
        return F.when(n >= 5, X.let(gaps, lambda g: X.let(mean(g), lambda m: of_gaps(g, m)))).otherwise(False)

    return X.let(times, of_times)


def beacon_flags(events: DataFrame, cfg: CorrelatorConfig = CorrelatorConfig()) -> DataFrame:
    """Add to each network event with an address: ``beacon_now``, and ``beacon_next``, the same test after the next prune.

    The history is the last 20 times of (pid, address) that the prune of the current slice kept. It lies in
    this slice and the ones within retention, of which at most the last 20 times per slice matter, so only
    those are copied forward.
    """
    width, back = _slice_us(cfg), cfg.retention_sec // cfg.prune_every_sec
    key = ["pid", "_slice", "host_id", "remote_addr"]
    latest_first = Window.partitionBy(*key).orderBy(F.desc("_us"), F.desc("seq"))
    own = _keyed(events, cfg)
    times = own.select(*key, "_us", "seq").withColumn("_rank", F.row_number().over(latest_first)).where(
        F.col("_rank") <= BEACON_HISTORY
    )
    copies = times.select(
        "host_id", "pid", "remote_addr",
        F.explode(F.array(*[F.col("_slice") + i for i in range(1, back + 1)])).alias("_slice"), "_us", "seq",
    )
    rows = own.select(*key, "_us", "seq", F.struct(*own.columns).alias("_row")).unionByName(
        copies, allowMissingColumns=True
    )
    history = F.collect_list("_us").over(
        Window.partitionBy(*key).orderBy("_us", "seq").rowsBetween(1 - BEACON_HISTORY, 0)
    )
    kept = rows.withColumn("_times", history).where(F.col("_row").isNotNull())

    def after(prune_start: Column) -> Column:
        held = F.filter("_times", lambda t: t > prune_start - F.lit(cfg.retention_sec * SEC))
        return F.when(F.size("_times") >= 5, is_regular(held)).otherwise(False)

    return kept.select(
        "_row.*",
        after(F.col("_slice") * width).alias("beacon_now"),
        after((F.col("_slice") + 1) * width).alias("beacon_next"),
    )


def _with_beacons(events: DataFrame, cfg: CorrelatorConfig) -> DataFrame:
    """Keyed events with beacon columns; only addressed network events take the extra shuffle."""
    addressed = (F.col("source") == "network") & (F.coalesce(F.col("remote_addr"), F.lit("")) != "")
    flagged = beacon_flags(events.where(addressed), cfg)
    plain = _keyed(events.where(~addressed), cfg)
    return flagged.unionByName(plain, allowMissingColumns=True)


def _source_bit() -> Column:
    bit = F.lit(OTHER_SOURCE_BIT)
    for name, value in SOURCE_BITS.items():
        bit = F.when(F.col("source") == name, value).otherwise(bit)
    return bit


def live_counts(
    events: DataFrame, cfg: CorrelatorConfig, patterns: Sequence[Pattern]
) -> tuple[DataFrame, list[str]]:
    """Per event with a pid: the number of live nodes per counter (itself included) and the sources seen.

    Only keys, times and node flags travel through the shuffle; the result is keyed by (host, seq).
    """
    width, window = _slice_us(cfg), cfg.time_window_sec * SEC
    flags = node_flags(patterns)
    names = list(flags)
    narrow = events.where(has_pid()).select(
        "host_id", "seq", "ts", "pid", "entity_id", "source", "remote_addr",
        *[c.alias(f"_f_{n}") for n, c in flags.items()],
    )
    base = _with_beacons(narrow, cfg)
    # A row belongs to its own slice, and to the next one when it may still be live there.
    next_slice = F.when(
        int_div(F.col("_us") + window - 1, width) > F.col("_slice"), F.col("_slice") + 1
    )
    placed = base.select(
        "host_id", "pid", "seq", "_us", "entity_id", "remote_addr", "beacon_now", "beacon_next", _source_bit().alias("_bit"),
        "_slice", *[f"_f_{n}" for n in names], F.explode(F.array_compact(F.array(F.col("_slice"), next_slice))).alias("_at"),
    ).withColumn("_own", F.col("_at") == F.col("_slice")).drop("_slice")
    placed = placed.repartition("pid", "_at", "host_id")
    per_entity = Window.partitionBy("pid", "_at", "host_id", "entity_id").orderBy("_us", "seq")
    per_addr = Window.partitionBy("pid", "_at", "host_id", "remote_addr").orderBy("_us", "seq")
    following = F.struct("_us", "seq")
    placed = placed.withColumns({
        "_next": F.lead(following).over(per_entity),
        "_next_addr": F.when(F.col("beacon_now").isNotNull(), F.lead(following).over(per_addr)),
        "_beacon": F.when(F.col("_own"), F.col("beacon_now")).otherwise(F.col("beacon_next")).cast("int"),
    })

    def ending(nxt: str) -> Column:
        """When the node stops counting: at its replacement (just before it), or at expiry (before all rows of that instant)."""
        replaced = F.col(nxt)["_us"] < F.col("_us") + window
        return F.when(
            replaced, F.struct(F.col(nxt)["_us"].alias("t"), F.col(nxt)["seq"].alias("s"))
        ).otherwise(F.struct((F.col("_us") + window).alias("t"), F.lit(-(2**63)).cast("bigint").alias("s")))

    def step(at: Column, sub: int, node: int, beacon: int) -> Column:
        return F.struct(
            at["t"].alias("t"), at["s"].alias("s"), F.lit(sub).alias("sub"),
            F.lit(node).alias("node"), F.lit(beacon).alias("beacon"),
        )

    start = F.struct(F.col("_us").alias("t"), F.col("seq").alias("s"))
    steps = F.array_compact(F.array(
        step(start, 1, 1, 1),
        step(ending("_next"), 0, -1, 0),
        F.when(F.col("_beacon") == 1, step(ending("_next_addr"), 0, 0, -1)),
    ))
    moves = placed.select(
        "host_id", "pid", "_at", "seq", "_own", "_bit", F.coalesce("_beacon", F.lit(0)).alias("_beacon"),
        *[f"_f_{n}" for n in names], F.inline(steps),
    ).where(int_div(F.col("t"), width) <= F.col("_at"))
    is_own = F.col("_own") & (F.col("sub") == 1)
    order = Window.partitionBy("pid", "_at", "host_id").orderBy("t", "s", "sub").rowsBetween(Window.unboundedPreceding, 0)
    counted = moves.select(
        "host_id", "pid", "_at", "seq", is_own.alias("_is_own"),
        *[F.sum(F.when(F.col(f"_f_{n}"), F.col("node")).otherwise(0)).over(order).alias(f"_n_{n}") for n in names],
        F.sum(F.when(F.col("_beacon") == 1, F.col("beacon")).otherwise(0)).over(order).alias(f"_n_{BEACON}"),
        F.sum("node").over(order).alias("_n_nodes"),
        F.bit_or(F.when(is_own, F.col("_bit"))).over(order).alias("_mask"),
    ).where("_is_own")
    carry = source_count(narrow, cfg).withColumnRenamed("_slice", "_at")
    joined = counted.join(carry, ["pid", "_at", "host_id"], "left")
    counters = [f"_n_{n}" for n in (*names, BEACON, "nodes")]
    out = joined.select(
        "host_id", "seq", *counters,
        F.bit_count(F.col("_mask").bitwiseOR(F.coalesce("_carry_mask", F.lit(0)))).alias("source_count"),
    )
    return out, counters


def multiplier(sources: Column, cfg: CorrelatorConfig = CorrelatorConfig()) -> Column:
    return F.when(sources >= 3, cfg.three_source_mult).when(sources >= 2, cfg.two_source_mult).otherwise(1.0)


def correlate(
    events: DataFrame, cfg: CorrelatorConfig = CorrelatorConfig(), patterns: Sequence[Pattern] = DEFAULT_PATTERNS
) -> DataFrame:
    """Add ``source_count, multiplier, related_count, patterns, pattern_bonus``.

    Events without a pid skip the stage; they are split off before the shuffle because they would
    otherwise all share one key. Their multiplier is null.
    """
    found = correlations(events, cfg, patterns)
    joined = events.join(found, ["seq", "host_id"], "left")
    return joined.select(
        *events.columns,
        F.coalesce("source_count", F.lit(0)).alias("source_count"),
        "multiplier",
        F.coalesce("related_count", F.lit(0)).alias("related_count"),
        F.coalesce("patterns", F.array().cast("array<string>")).alias("patterns"),
        F.coalesce("pattern_bonus", F.lit(0.0)).alias("pattern_bonus"),
    )


def correlations(
    events: DataFrame, cfg: CorrelatorConfig = CorrelatorConfig(), patterns: Sequence[Pattern] = DEFAULT_PATTERNS
) -> DataFrame:
    """The correlation columns of the events with a pid, keyed by (host_id, seq)."""
    counted, counters = live_counts(events, cfg, patterns)
    live = {c.removeprefix("_n_"): F.col(c) for c in counters}
    hits = [(p, p.test(live)) for p in patterns]
    return counted.select(
        "host_id", "seq", "source_count",
        multiplier(F.col("source_count"), cfg).alias("multiplier"),
        (F.col("_n_nodes") - 1).cast("int").alias("related_count"),
        F.array_compact(F.array(*[F.when(t, p.name) for p, t in hits])).alias("patterns"),
        reduce(add, [F.when(t, p.bonus).otherwise(0.0) for p, t in hits], F.lit(0.0)).alias("pattern_bonus"),
    )


def related_pairs(events: DataFrame, cfg: CorrelatorConfig = CorrelatorConfig(), near: DataFrame | None = None) -> DataFrame:
    """One row per (event, related entity): same pid, other entity, live within the window.

    An interval join on window-wide buckets; every matching pair is an output row, there is no
    intermediate larger than about twice the result. With ``near(host_id, entity_id)`` only pairs with an end among these
    entities are built, from events of the pids that touched one of them.
    """
    if near is not None:
        near = near.select("host_id", "entity_id").distinct()
        reached = events.where(has_pid()).join(near, ["host_id", "entity_id"], "left_semi").select("host_id", "pid").distinct()
        events = events.join(reached, ["host_id", "pid"], "left_semi")
    width, window = _slice_us(cfg), cfg.time_window_sec * SEC
    narrow = _keyed(events, cfg).select("host_id", "pid", "seq", "_us", "_slice", "entity_id")
    # Rows early in a slice are also visible to the slice before, as possible replacements.
    prior = F.when(int_div(F.col("_us") - window, width) < F.col("_slice"), F.col("_slice") - 1)
    placed = narrow.select("*", F.explode(F.array_compact(F.array(F.col("_slice"), prior))).alias("_at"))
    per_entity = Window.partitionBy("host_id", "pid", "_at", "entity_id").orderBy("_us", "seq")
    nodes = placed.withColumn("_next", F.lead(F.struct("_us", "seq")).over(per_entity)).where(
        F.col("_at") == F.col("_slice")
    )
    until = F.least(F.col("_us") + window, F.coalesce(F.col("_next._us"), F.col("_us") + window))
    spans = nodes.select(
        "host_id", "pid", F.col("entity_id").alias("related_id"), F.col("seq").alias("n_seq"),
        F.col("_us").alias("n_us"), "_next",
        F.explode(F.sequence(int_div(F.col("_us"), window), int_div(until, window))).alias("_bucket"),
    )
    probes = narrow.select(
        "host_id", "pid", "seq", "_us", "entity_id", int_div(F.col("_us"), window).alias("_bucket")
    )
    here, there = F.struct("_us", "seq"), F.struct("n_us", "n_seq")
    live = (
        (F.col("entity_id") != F.col("related_id")) & (there < here)
        & (F.col("n_us") > F.col("_us") - window) & (F.col("_next").isNull() | (here < F.col("_next")))
    )
    if near is None:
        joined = probes.join(spans, ["host_id", "pid", "_bucket"])
    else:
        ends = near.withColumnRenamed("entity_id", "related_id")
        joined = probes.join(near, ["host_id", "entity_id"], "left_semi").join(spans, ["host_id", "pid", "_bucket"]).unionByName(
            probes.join(near, ["host_id", "entity_id"], "left_anti").join(spans.join(ends, ["host_id", "related_id"], "left_semi"), ["host_id", "pid", "_bucket"])
        )
    return joined.where(live).select(
        "host_id", "pid", "seq", F.timestamp_micros("_us").alias("ts"), "entity_id", "related_id"
    )


def correlated_with(events: DataFrame, cfg: CorrelatorConfig = CorrelatorConfig()) -> DataFrame:
    """Add ``correlated_with``: the related entity IDs of each event, sorted."""
    lists = related_pairs(events, cfg).groupBy("host_id", "seq").agg(
        F.array_sort(F.collect_list("related_id")).alias("correlated_with")
    )
    empty = F.array().cast("array<string>")
    return events.join(lists, ["host_id", "seq"], "left").withColumn(
        "correlated_with", F.coalesce("correlated_with", empty)
    )


def effective_score(base: Column) -> Column:
    """Score after the multiplier and the pattern bonuses."""
    return base * F.greatest(F.coalesce("multiplier", F.lit(1.0)), F.lit(1.0)) + F.col("pattern_bonus")
