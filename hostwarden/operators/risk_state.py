"""Per-entity risk score with linear decay, as a batch operator.

Score after the n-th event of an entity: ``s_n = x_n + max(0, s_{n-1} - d_n)``, where ``d_n`` is the
decay of the 30 s grid lines since the previous event. With running sums ``X`` of the scores and
``T`` of the decay this is ``s_n = X_n - T_n - min_{j<=n}(X_{j-1} - T_j)``: one running sum and one
running minimum. BLOCKED is absorbing, so from the first ``s_n >= blocked`` on the score only grows.

Both are evaluated per (entity, time chunk) with carries from the earlier chunks (see ``scan``), so
an entity that owns a large share of all events is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostwarden.config import Thresholds
from hostwarden.functions import expr as X
from hostwarden.operators import scan

CHUNK_SEC = 600
KEY = ["host_id", "entity_id"]
SEC = 1_000_000


def tick(us: Column, th: Thresholds) -> Column:
    """Number of decay grid lines at or before a time; a line at an event's own instant precedes it."""
    return scan.int_div(us, th.tick_sec * SEC)


def _base(scored: DataFrame, th: Thresholds, score_col: str, payload: tuple[str, ...]) -> DataFrame:
    us = X.micros("ts")
    rows = scored.select(
        *KEY, "seq", us.alias("us"), F.col(score_col).cast("double").alias("x"), "source", *payload
    )
    rows = rows.withColumn("chunk", scan.time_chunk(F.col("us"), CHUNK_SEC))
    return rows.repartition(*KEY, "chunk").withColumn("t", tick(F.col("us"), th) * F.lit(th.decay_per_tick))


def track(
    scored: DataFrame, th: Thresholds = Thresholds(), score_col: str = "score", payload: tuple[str, ...] = ()
) -> DataFrame:
    """Risk state after every event.

    Columns: the key, ``seq, us, x, source``, ``payload``, ``score, state``; the previous event's
    ``prev_us, prev_score, prev_blocked``; ``before_score, before_state`` (previous score decayed to this event);
    ``next_us``; ``fresh`` (first event of an incarnation).
    """
    order = ["us", "seq"]
    base = _base(scored, th, score_col, payload)
    within = Window.partitionBy(*KEY, "chunk").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)

    local = base.withColumn("lx", F.sum("x").over(upto)).withColumn("ly", F.col("lx") - F.col("x") - F.col("t"))
    sums = local.groupBy(*KEY, "chunk").agg(F.sum("x").alias("sx"), F.min("ly").alias("sy"))
    carry = sums.withColumn("px", F.coalesce(F.sum("sx").over(before), F.lit(0.0)))
    carry = carry.withColumn("py", F.min(F.col("px") + F.col("sy")).over(before)).select(*KEY, "chunk", "px", "py")
    free = local.join(carry, [*KEY, "chunk"]).withColumns({
        "X": F.col("px") + F.col("lx"),
        "low": F.least(F.col("py"), F.col("px") + F.min("ly").over(upto)),
    }).withColumn("s", F.col("X") - F.col("t") - F.col("low"))

    # First blocking event, and the neighbours across chunk borders.
    hit = F.when(F.col("s") >= th.blocked, F.struct("us", "seq", (F.col("s") - F.col("X")).alias("lift")))
    edge = F.struct("us", "seq", "s", "X")
    marks = free.groupBy(*KEY, "chunk").agg(
        F.min(hit).alias("hit"), F.max(edge).alias("last"), F.min("us").alias("first_us")
    )
    per_key = Window.partitionBy(*KEY).orderBy("chunk")
    marks = marks.select(
        *KEY, "chunk",
        F.min("hit").over(per_key.rowsBetween(Window.unboundedPreceding, 0)).alias("block"),
        F.lag("last").over(per_key).alias("carry_prev"),
        F.lead("first_us").over(per_key).alias("carry_next"),
    )
    rows = free.join(marks, [*KEY, "chunk"]).withColumns({
        "prev": F.coalesce(F.lag(edge).over(within), F.col("carry_prev")),
        "next_us": F.coalesce(F.lead("us").over(within), F.col("carry_next")),
    })

    def blocked_at(row_us: Column, row_seq: Column) -> Column:
        at = F.struct(row_us.alias("us"), row_seq.alias("seq"))
        from_here = at >= F.struct(F.col("block.us").alias("us"), F.col("block.seq").alias("seq"))
        return F.col("block").isNotNull() & from_here

    rows = rows.withColumns({
        "blocked": blocked_at(F.col("us"), F.col("seq")),
        "prev_blocked": F.col("prev").isNotNull() & blocked_at(F.col("prev.us"), F.col("prev.seq")),
    })
    rows = rows.withColumns({
        "score": F.when(F.col("blocked"), F.col("X") + F.col("block.lift")).otherwise(F.col("s")),
        "prev_us": F.col("prev.us"),
        "prev_score": F.when(F.col("prev_blocked"), F.col("prev.X") + F.col("block.lift")).otherwise(F.col("prev.s")),
    })
    steps = tick(F.col("us"), th) - tick(F.col("prev_us"), th)
    decayed = F.greatest(F.col("prev_score") - steps * th.decay_per_tick, F.lit(0.0))
    rows = rows.withColumns({
        "state": F.when(F.col("blocked"), 4).otherwise(X.classify_state(F.col("score"), th)),
        "evicted_before": F.col("prev").isNotNull() & ~F.col("prev_blocked") & evicted(
            F.col("prev_score"), F.col("prev_us"), F.col("us"), th
        ),
    })
    rows = rows.withColumns({
        "fresh": F.col("prev").isNull() | F.col("evicted_before"),
        "before_score": F.when(F.col("prev_blocked"), F.col("prev_score")).otherwise(F.coalesce(decayed, F.lit(0.0))),
    })
    return rows.select(
        *KEY, "chunk", "seq", "us", "x", "source", *payload, "score", "state", "prev_us", "prev_score", "prev_blocked",
        "before_score",
        F.when(F.col("prev_blocked"), 4).otherwise(X.classify_state(F.col("before_score"), th)).alias("before_state"),
        "next_us", "fresh",
    )


def evicted(score: Column, last_us: Column, now_us: Column, th: Thresholds) -> Column:
    """Has an unblocked entity been dropped by ``now``: a grid line with score 0, more than 10 min after its last event."""
    lines = tick(now_us, th) - tick(last_us, th)
    needed = F.greatest(F.ceil(score / F.lit(th.decay_per_tick)), F.lit(1))
    return (lines >= needed) & (tick(now_us, th) * (th.tick_sec * SEC) - last_us > th.evict_after_sec * SEC)


def event_transitions(tracked: DataFrame) -> DataFrame:
    """State changes caused by events."""
    return tracked.where(F.col("state") != F.col("before_state")).select(
        *KEY, "us", "seq", F.col("before_state").alias("from_state"), F.col("state").alias("to_state"),
        "score", F.lit("event").alias("cause"),
    )


def decay_transitions(tracked: DataFrame, until_us: int | None = None, th: Thresholds = Thresholds()) -> DataFrame:
    """State changes caused by decay: one per grid line at which the state changes, until the next event.

    ``until_us`` bounds the decay after an entity's last event (default: until nothing can change any more).
    """
    per_tick = th.decay_per_tick

    def leaves(threshold: float) -> Column:
        return F.when(
            F.col("score") >= threshold, F.floor((F.col("score") - threshold) / per_tick).cast("bigint") + 1
        )

    end = F.coalesce("next_us", F.lit(until_us).cast("bigint"))
    lines = tick(end, th) - tick(F.col("us"), th)
    ks = F.array_distinct(F.array_compact(F.array(leaves(th.threat), leaves(th.suspicious), leaves(th.watching))))
    steps = tracked.where(F.col("state") < 4).select("*", F.explode(ks).alias("k")).where(
        F.coalesce(F.col("k") <= lines, F.lit(True))
    )

    def at(k: Column) -> Column:
        return F.greatest(F.col("score") - k * per_tick, F.lit(0.0))

    return steps.select(
        *KEY, ((tick(F.col("us"), th) + F.col("k")) * (th.tick_sec * SEC)).alias("us"), "seq",
        X.classify_state(at(F.col("k") - 1), th).alias("from_state"),
        X.classify_state(at(F.col("k")), th).alias("to_state"),
        at(F.col("k")).alias("score"), F.lit("decay").alias("cause"),
    )


def transitions(tracked: DataFrame, until_us: int | None = None, th: Thresholds = Thresholds()) -> DataFrame:
    """All state changes with text labels."""
    both = event_transitions(tracked).unionByName(decay_transitions(tracked, until_us, th))
    return both.withColumns({
        "from_label": X.state_label(F.col("from_state")), "to_label": X.state_label(F.col("to_state")),
    })


def with_incarnation(tracked: DataFrame) -> DataFrame:
    """Add ``born_us, born_seq`` (the event that started the current incarnation), ``event_count`` and ``first_source``."""
    birth = F.when(F.col("fresh"), F.struct("us", "seq", "source"))
    born = scan.running(tracked, KEY, ["us", "seq"], "chunk", maxs={"_born": birth})
    counted = born.withColumns({
        "born_us": F.col("_born.us"), "born_seq": F.col("_born.seq"), "first_source": F.col("_born.source"),
    }).drop("_born")
    return scan.running(
        counted, [*KEY, "born_us", "born_seq"], ["us", "seq"], "chunk", sums={"event_count": F.lit(1)}
    )


def snapshot(tracked: DataFrame, as_of_us: int, th: Thresholds = Thresholds()) -> DataFrame:
    """Entities as of a time: decayed to it, evicted ones left out.

    Fresh starts number an entity's incarnations; each is aggregated map-side, and the newest one is kept.
    """
    seen = tracked.where(F.col("us") <= as_of_us).select(*KEY, "chunk", "us", "seq", "source", "score", "state", "fresh")
    numbered = scan.running(
        seen, KEY, ["us", "seq"], "chunk", sums={"incarnation": F.col("fresh").cast("int")},
    )
    order = F.struct("us", "seq")
    per = numbered.groupBy(*KEY, "incarnation").agg(
        F.count(F.lit(1)).alias("event_count"), F.min("us").alias("first_seen_us"), F.min_by("source", order).alias("source"),
        F.max_by(F.struct("us", "score", "state"), order).alias("last"),
    )
    newest = per.groupBy(*KEY).agg(
        F.max_by(F.struct("event_count", "first_seen_us", "source", "last"), "incarnation").alias("e")
    ).select(*KEY, "e.*")
    now, blocked = F.lit(as_of_us), F.col("last.state") == 4
    lines = tick(now, th) - tick(F.col("last.us"), th)
    present = newest.where(blocked | ~evicted(F.col("last.score"), F.col("last.us"), now, th))
    score = F.when(blocked, F.col("last.score")).otherwise(
        F.greatest(F.col("last.score") - lines * th.decay_per_tick, F.lit(0.0))
    )
    return present.select(
        *KEY, "source", score.alias("score"), F.when(blocked, 4).otherwise(X.classify_state(score, th)).alias("state"),
        "first_seen_us", F.col("last.us").alias("last_event_us"), "event_count",
    ).withColumn("state_label", X.state_label(F.col("state")))


def merge_details(scored: DataFrame, tracked: DataFrame, columns: list[str]) -> DataFrame:
    """Last non-missing value per detail column over an entity's current incarnation."""
    births = tracked.where(F.col("fresh")).groupBy(*KEY).agg(F.max(F.struct("us", "seq")).alias("born"))
    at = F.struct(X.micros("ts").alias("us"), F.col("seq").alias("seq"))
    rows = scored.join(births, KEY).where(at >= F.col("born"))
    return rows.groupBy(*KEY).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("ts", "seq"))).alias(c) for c in columns]
    )
