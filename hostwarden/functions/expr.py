"""Scalar column functions. All but ``entropy`` of whole texts are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

SEVERITY_LABELS = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
STATE_LABELS = ("CLEAN", "WATCHING", "SUSPICIOUS", "THREAT", "BLOCKED")
LEVEL_BONUS = {"critical": 60.0, "high": 40.0, "medium": 25.0, "low": 10.0}
OTHER_LEVEL_BONUS = 5.0


def any_of(predicates: Iterable[Column]) -> Column:
    """OR over predicates; an empty list is false."""
    items = list(predicates)
    return reduce(or_, items) if items else F.lit(False)


def contains_any(col: Column, needles: Iterable[str]) -> Column:
    return any_of(col.contains(n) for n in needles)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def micros(ts: Column | str) -> Column:
    """Timestamp to microseconds since the epoch."""
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def entropy(col: Column, texts: bool = False) -> Column:
    """Shannon entropy in bits over the characters of a string; 0 for the empty string.

    Each distinct character is counted by removing it from the string. With ``texts``, for whole texts, a string is read once,
    however many distinct characters it has, in Arrow batches.
    """
    if texts:
        return F.pandas_udf(_entropies, "double")(col)
    n = F.length(col)
    bits = F.aggregate(
        F.array_distinct(F.split(col, "")),
        F.lit(0.0),
        lambda acc, c: acc - _plogp((n - F.length(F.replace(col, c, F.lit("")))) / n),
    )
    return F.when(n > 0, bits).when(n == 0, 0.0)


def _entropies(texts: pd.Series) -> pd.Series:
    return texts.map(_bits, na_action="ignore").astype("float64")


def _bits(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)[1]
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum()) + 0.0


def _plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


def is_high_entropy_name(col: Column) -> Column:
    """Longer than 8 bytes with entropy above 3.5; null is false."""
    return F.coalesce(F.when(F.octet_length(col) > 8, entropy(col) > 3.5), F.lit(False))


def name_matches(col: Column, patterns: Iterable[str]) -> Column:
    """Exact, case-sensitive name list in which a trailing ``*`` means prefix."""
    pats = list(patterns)
    exact = [p for p in pats if not p.endswith("*")]
    tests = [col.startswith(p[:-1]) for p in pats if p.endswith("*")]
    if exact:
        tests.insert(0, col.isin(exact))
    return F.coalesce(any_of(tests), F.lit(False))


def is_private_ip(col: Column, strict_rfc1918: bool = False) -> Column:
    """Private IPv4 by prefix. The default also accepts every ``172.2*`` address."""
    if strict_rfc1918:
        return col.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)")
    # fixed values: address prefixes treated as private
    prefixes = ("10.", "192.168.", "172.16.", "172.17.", "172.18.", "172.19.", "172.2", "172.30.", "172.31.")
    return any_of(col.startswith(p) for p in prefixes)


def severity_rank(score: Column) -> Column:
    return (
        F.when(score >= 70, 4).when(score >= 50, 3).when(score >= 30, 2).when(score >= 15, 1).otherwise(0)
    )


def _label(rank: Column, labels: tuple[str, ...]) -> Column:
    table = F.array(*[F.lit(x) for x in labels])
    return F.when(rank.between(0, len(labels) - 1), F.get(table, rank)).otherwise("UNKNOWN")


def severity_label(rank: Column) -> Column:
    return _label(rank, SEVERITY_LABELS)


def state_label(rank: Column) -> Column:
    return _label(rank, STATE_LABELS)


def classify_state(score: Column, th) -> Column:
    """Risk score to state rank 0..4."""
    return (
        F.when(score >= th.blocked, 4).when(score >= th.threat, 3)
        .when(score >= th.suspicious, 2).when(score >= th.watching, 1).otherwise(0)
    )


def level_bonus(level: Column) -> Column:
    """Rule level to bonus points; case-sensitive, anything else gets the small default."""
    out = F.lit(OTHER_LEVEL_BONUS)
    for name, points in LEVEL_BONUS.items():
        out = F.when(level == name, points).otherwise(out)
    return out


def number_text(col: Column) -> Column:
    """Double to its shortest text: no trailing ``.0``, exponent form from 1e6 up and below 1e-4."""
    s = col.cast("string")
    plain = F.regexp_replace(s, r"\.0$", "")
    mag = F.abs(col)
    sign = F.when(col < 0, "-").otherwise("")
    body = F.regexp_replace(s, "^-", "")
    # decimal text 1234567.5 -> 1.2345675e+06
    digits = F.regexp_replace(F.regexp_replace(body, r"\.0$", ""), r"\.", "")
    frac = F.regexp_replace(F.substring(digits, 2, 400), "0+$", "")
    millions = F.concat(
        sign, F.substring(digits, 1, 1), F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(""), F.lit("e+06")
    )
    # exponent text 1.5E-7 -> 1.5e-07
    mant = F.regexp_replace(F.regexp_extract(s, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    exp = F.regexp_extract(s, r"E(-?\d+)$", 1)
    exp_text = F.concat(
        F.when(exp.startswith("-"), "-").otherwise("+"), F.lpad(F.regexp_replace(exp, "-", ""), 2, "0")
    )
    long_exp = F.concat(F.when(exp.startswith("-"), "-").otherwise("+"), F.regexp_replace(exp, "-", ""))
    scientific = F.concat(
        mant, F.lit("e"), F.when(F.length(F.regexp_replace(exp, "-", "")) < 2, exp_text).otherwise(long_exp)
    )
    # 1.234E-4 -> 0.0001234
    small = F.concat(sign, F.lit("0.000"), F.regexp_replace(F.regexp_extract(body, r"^([0-9.]+)E", 1), r"(\.0$)|\.", ""))
    return (
        F.when((mag == 0) | ((mag >= 1e-3) & (mag < 1e6)), plain)
        .when((mag >= 1e-4) & (mag < 1e-3), small)
        .when((mag >= 1e6) & (mag < 1e7), millions)
        .when(F.isnan(col), "NaN")
        .when(mag == float("inf"), F.concat(F.when(col > 0, "+").otherwise("-"), F.lit("Inf")))
        .otherwise(scientific)
    )


def expected_path_length(n: Column) -> Column:
    """Average unsuccessful-search depth of a binary tree over ``n`` rows."""
    x = n.cast("double")
    return (
        F.when(x <= 1, 0.0).when(x == 2, 1.0)
        .otherwise(2.0 * (F.ln(x - 1) + 0.5772156649) - 2.0 * (x - 1) / x)
    )


def mean_stddev(col: Column) -> tuple[Column, Column]:
    """Aggregates: mean (0 when empty) and population stddev (0 below two values)."""
    return F.coalesce(F.avg(col), F.lit(0.0)), F.when(F.count(col) < 2, 0.0).otherwise(F.stddev_pop(col))


def score_percent(score: Column) -> Column:
    """Truncate to int and clamp to 0..100."""
    return F.least(F.greatest(score.cast("bigint"), F.lit(0)), F.lit(100)).cast("int")


def anomaly_percent(score: Column) -> Column:
    return (score * 100).cast("int")


def short_id(col: Column) -> Column:
    """First 30 bytes of an ID, with an ellipsis when cut (IDs are ASCII)."""
    return F.when(F.octet_length(col) <= 30, col).otherwise(F.concat(F.substring(col, 1, 30), F.lit("...")))


def uptime_text(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    h, m, sec = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return (
        F.when(h > 0, F.format_string("%dh %dm %ds", h, m, sec))
        .when(m > 0, F.format_string("%dm %ds", m, sec))
        .otherwise(F.format_string("%ds", sec))
    )


def relative_time(ts: Column, now: Column) -> Column:
    d = micros(now) - micros(ts)
    return (
        F.when(d < 1_000_000, "now")
        .when(d < 60_000_000, F.format_string("%ds ago", F.floor(d / 1_000_000)))
        .when(d < 3_600_000_000, F.format_string("%dm ago", F.floor(d / 60_000_000)))
        .otherwise(F.format_string("%dh ago", F.floor(d / 3_600_000_000)))
    )


def join_list(col: Column) -> Column:
    return F.concat_ws(", ", col)


def country_of(threat_intel: Column) -> Column:
    return F.coalesce(threat_intel["geoip"]["country_code"], F.lit(""))


def round6(col: Column) -> Column:
    return F.round(col.cast("double"), 6)
