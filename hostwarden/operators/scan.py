"""Running aggregates over ordered keys without putting a whole key into one task.

A key's rows are cut into time chunks. Per chunk a small summary row is aggregated, the
summaries are prefix-combined per key, and each chunk adds its carry to its own running
values. A hot key is thus spread over as many tasks as it has chunks; only summary rows,
one per (key, chunk), are ever ordered per key.

Rows are sorted by chunk before key: Spark compares eight bytes of the first sort column without reading the rows, and a
host name, often the same in all of them, would make it read both rows in every comparison.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def time_chunk(us: Column, seconds: int) -> Column:
    return int_div(us, seconds * 1_000_000)


def int_div(value: Column, by: int) -> Column:
    """Integer division, without the detour through double that ``/`` takes."""
    return F.call_function("div", value, F.lit(by))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: str,
    sums: dict[str, Column] | None = None,
    maxs: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running sums, maxima and minima per key in the given order.

    ``chunk`` must not decrease along ``order`` within a key.
    """
    sums, maxs, mins = sums or {}, maxs or {}, mins or {}
    work = df.select(
        "*",
        *[F.coalesce(c, F.lit(0)).alias(f"_in_{n}") for n, c in sums.items()],
        *[c.alias(f"_in_{n}") for n, c in {**maxs, **mins}.items()],
    )
    combine = {**{n: F.sum for n in sums}, **{n: F.max for n in maxs}, **{n: F.min for n in mins}}
    summary = work.groupBy(*keys, chunk).agg(*[f(f"_in_{n}").alias(f"_s_{n}") for n, f in combine.items()])
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, chunk, *[f(f"_s_{n}").over(before).alias(f"_c_{n}") for n, f in combine.items()])
    within = Window.partitionBy(chunk, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = work.join(carry, [chunk, *keys])
    out = []
    for n in combine:
        local, carried = combine[n](f"_in_{n}").over(within), F.col(f"_c_{n}")
        if n in sums:
            out.append((local + F.coalesce(carried, F.lit(0))).alias(n))
        else:
            out.append((F.greatest if n in maxs else F.least)(local, carried).alias(n))
    return joined.select(*df.columns, *out)


def lag_values(
    df: DataFrame, keys: list[str], order: list[str], chunk: str, cols: dict[str, str], offset: int = 1
) -> DataFrame:
    """Add the previous (offset 1) or next (offset -1) row's columns per key, across chunks."""
    forward = offset > 0
    edge = F.max_by if forward else F.min_by
    summary = df.groupBy(*keys, chunk).agg(
        edge(F.struct(*cols.keys()), F.struct(*order)).alias("_edge")
    )
    over_chunks = Window.partitionBy(*keys).orderBy(chunk)
    neighbour = (F.lag if forward else F.lead)("_edge", 1).over(over_chunks)
    carry = summary.select(*keys, chunk, neighbour.alias("_edge"))
    within = Window.partitionBy(chunk, *keys).orderBy(*order)
    step = F.lag if forward else F.lead
    joined = df.join(carry, [chunk, *keys])
    local = step(F.struct(*cols.keys()), 1).over(within)
    picked = joined.select(*df.columns, F.coalesce(local, F.col("_edge")).alias("_nb"))
    return picked.select(*df.columns, *[F.col("_nb")[src].alias(dst) for src, dst in cols.items()])


def _jumps(times: np.ndarray, gap: int) -> np.ndarray:
    """For each time the position of the next one at least ``gap`` later; its own position if there is none."""
    after = np.searchsorted(times, times + gap)
    return np.where(after < len(times), after, np.arange(len(times)))


def spaced(rows: DataFrame, keys: list[str], gap: int, chunk: int, at: str = "us") -> DataFrame:
    """The times a greedy walk keeps: the first of each key, then always the next one at least ``gap`` after the last kept.

    Whether a time is kept depends on all before it, yet no key is walked as a whole. Inside a chunk of time every
    time jumps to the next it would keep; jumps are composed by doubling, which tells for each place where a walk may enter the
    chunk (its first ``gap``, or what follows) the last time it keeps there. These entries, one small row a chunk, are
    followed from chunk to chunk; then each chunk walks from its own entry. Returns distinct ``keys`` and ``at``.
    """
    types = dict(rows.dtypes)
    key_ddl = ", ".join(f"{k} {types[k]}" for k in keys)
    times = rows.select(*keys, F.col(at).cast("bigint").alias(at)).distinct().withColumn("chunk", int_div(F.col(at), chunk))

    def entries(group: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(group[at].to_numpy(np.int64))
        last = _jumps(t, gap)
        while not np.array_equal(further := last[last], last):
            last = further
        begin = int(group["chunk"].iat[0]) * chunk
        open_ = min(int(np.searchsorted(t, begin + gap)) + 1, len(t))
        return group.iloc[:1][[*keys, "chunk"]].assign(entry=[t[:open_].tolist()], exit=[t[last[:open_]].tolist()])

    def followed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        last, before = None, []
        for entry, leave in zip(group["entry"], group["exit"]):
            before.append(last)
            at_ = 0 if last is None else int(np.searchsorted(np.asarray(entry), last + gap))
            last = int(leave[at_]) if at_ < len(entry) else last
        return group[[*keys, "chunk"]].assign(last=pd.array(before, "Int64"))

    def walked(group: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(group[at].to_numpy(np.int64))
        jump, last = _jumps(t, gap), group["last"].iat[0]
        here, kept = 0 if pd.isna(last) else int(np.searchsorted(t, int(last) + gap)), []
        while here < len(t):
            kept.append(int(t[here]))
            if jump[here] == here:
                break
            here = int(jump[here])
        return group.iloc[np.zeros(len(kept), np.int64)][keys].reset_index(drop=True).assign(**{at: kept})

    summary = times.groupBy(*keys, "chunk").applyInPandas(entries, f"{key_ddl}, chunk bigint, entry array<bigint>, exit array<bigint>")
    carry = summary.groupBy(*keys).applyInPandas(followed, f"{key_ddl}, chunk bigint, last bigint")
    return times.join(carry, [*keys, "chunk"]).groupBy(*keys, "chunk").applyInPandas(walked, f"{key_ddl}, {at} bigint")
