"""Threat-intelligence enrichment by joins against provider tables.

Providers are looked up once per distinct address, then one join brings the result to the events.
Rows without an address get a spread-out key that matches nothing, so nulls do not pile up in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from hostwarden.functions import expr as X
from hostwarden.operators import scan
from hostwarden.session import stage

# fixed values: countries that add risk
HIGH_RISK_COUNTRIES = ("KP", "IR", "RU", "CN", "SY", "CU", "VE")
V4_PREFIX = "00000000000000000000ffff"


def ip_key(ip: Column) -> Column:
    """An address as 32 hex digits that sort like the address; IPv4 in its mapped IPv6 form; null when invalid."""
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    v4 = F.concat(F.lit(V4_PREFIX), F.array_join(
        F.transform(F.split(ip, r"\."), lambda p: F.lpad(F.lower(F.hex(p.cast("int"))), 2, "0")), ""
    ))

    def groups(text: Column) -> Column:
        """Colon-separated groups, each padded to four digits."""
        return F.transform(F.filter(F.split(text, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))

    def assemble(p: Column) -> Column:
        missing = 8 - F.size(p["left"]) - F.size(p["right"])
        fits = F.when(p["halves"] == 1, missing == 0).otherwise((p["halves"] == 2) & (missing >= 1))
        zeros = F.repeat(F.lit("0000"), F.greatest(missing, F.lit(0)))
        return F.when(fits, F.concat(F.array_join(p["left"], ""), zeros, F.array_join(p["right"], "")))

    v6 = X.let(F.split(F.lower(ip), "::"), lambda h: X.let(
        F.struct(
            groups(h[0]).alias("left"), groups(F.coalesce(F.get(h, F.lit(1)), F.lit(""))).alias("right"), F.size(h).alias("halves")
        ),
        assemble,
    ))
    return (
        F.when(ip.rlike(rf"^{octet}(\.{octet}){{3}}$"), v4)
        .when(ip.rlike(r"^(?=.*:)(?!.*:::)(?!.*[0-9A-Fa-f]{5})[0-9A-Fa-f:]+$"), v6)
    )


def latest_entries(cache: DataFrame, key: str) -> DataFrame:
    """One row per key: the entry that expires last."""
    rest = [c for c in cache.columns if c != key]
    return cache.groupBy(key).agg(F.max_by(F.struct(*rest), "expires").alias("_r")).select(key, "_r.*")


def flatten_pulses(raw: DataFrame) -> DataFrame:
    """Raw pulse lists to count, names and all tags."""
    return raw.select(
        "ip", F.size("pulse_list").alias("pulse_count"), F.col("pulse_list.name").alias("pulses"),
        F.flatten("pulse_list.tags").alias("tags"), "expires",
    )


_SEGMENT = "lo string, hi string, country_code string, country string, city string"
#: Ranges that one task sweeps, and the most tasks whose borders the driver holds.
_SWEEP_ROWS, _SWEEP_PARTS = 50_000, 1024
#: Hex digits that name a block of 65,536 addresses.
_BLOCK_DIGITS = 28


def _sweep(rows: pd.DataFrame, begin: int, end: int) -> list[tuple]:
    """Disjoint segments of ``[begin, end)`` with the narrowest of the ranges over each; of equal widths the later start, then by content."""
    content = ["country_code", "country", "city"]
    spans = [(int(lo, 16), int(hi, 16), tuple("" if pd.isna(v) else v for v in rest), k) for k, (lo, hi, *rest) in enumerate(rows[["lo", "hi", *content]].itertuples(index=False))]
    points = sorted({max(lo, begin) for lo, *_ in spans} | {min(hi + 1, end) for _, hi, *_ in spans})
    spans.sort()
    heap: list[tuple] = []
    at, out = 0, []
    for point, following in zip(points, points[1:]):
        while at < len(spans) and max(spans[at][0], begin) <= point:
            lo, hi, rest, k = spans[at]
            heapq.heappush(heap, (hi - lo, -lo, rest, k, hi))
            at += 1
        while heap and heap[0][4] < point:
            heapq.heappop(heap)
        if not heap:
            continue
        owner = heap[0][3]
        if out and out[-1][2] == owner and out[-1][1] == point - 1:
            out[-1] = (out[-1][0], following - 1, owner)
        else:
            out.append((point, following - 1, owner))
    return out


def segments(ranges: DataFrame) -> DataFrame:
    """Ranges that may nest and overlap, as disjoint segments ``lo, hi`` (hex keys) with the narrowest range over each.

    The key space is cut into parts of about equally many range starts; each part sweeps the ranges over it, once in order,
    so a range over many others costs one row a part. Bad addresses and ends before starts give no segment.
    """
    keyed = ranges.select(ip_key(F.col("ip_from")).alias("lo"), ip_key(F.col("ip_to")).alias("hi"), "country_code", "country", "city").where("lo <= hi")
    keyed = stage(keyed, "ranges")
    count = keyed.count()
    parts = min(max(-(-count // _SWEEP_ROWS), 1), _SWEEP_PARTS)
    borders: list[str] = []
    if parts > 1:
        sample = sorted(r["lo"] for r in keyed.select("lo").sample(min(1.0, 100.0 * parts / count), 7).collect())
        borders = sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if sample else []
    edges = [0, *(int(b, 16) for b in borders), 1 << 128]

    def part_of(key: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(b) for b in borders]).cast("array<string>"), lambda b: b <= F.col(key)))

    def swept(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iat[0])
        found = _sweep(group, edges[part], edges[part + 1])
        owners = group.iloc[[k for *_, k in found]][["country_code", "country", "city"]].reset_index(drop=True)
        return owners.assign(lo=[f"{lo:032x}" for lo, _, _ in found], hi=[f"{hi:032x}" for _, hi, _ in found])[["lo", "hi", "country_code", "country", "city"]]

    placed = keyed.select("*", F.explode(F.sequence(part_of("lo"), part_of("hi"))).alias("part"))
    return placed.groupBy("part").applyInPandas(swept, _SEGMENT)


def geo_lookup(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """Narrowest range containing each address (``ip``).

    The ranges become disjoint segments, so an address has at most one: the last that starts at or before it. Addresses and segment starts
    are merged in key order by blocks of 65,536 keys, each block knowing the last start before it.
    """
    starts = stage(segments(ranges), "segments")
    wanted = addresses.select("ip", ip_key(F.col("ip")).alias("k")).where("k IS NOT NULL")
    segment = F.struct("lo", "hi", "country_code", "country", "city")
    rows = starts.select(F.col("lo").alias("k"), F.lit(0).alias("is_ip"), segment.alias("start")).unionByName(wanted.select("k", F.lit(1).alias("is_ip"), "ip"), allowMissingColumns=True)
    rows = rows.withColumns({"all": F.lit(0), "block": F.substring("k", 1, _BLOCK_DIGITS)})
    merged = scan.running(rows, ["all"], ["k", "is_ip"], "block", maxs={"g": F.col("start")})
    return merged.where((F.col("is_ip") == 1) & (F.col("k") <= F.col("g.hi"))).select(
        "ip", "g.country_code", "g.country", "g.city", F.col("g.country_code").isin(*HIGH_RISK_COUNTRIES).alias("high_risk_country")
    )


def lookup_table(
    addresses: DataFrame, abuse: DataFrame | None, geo: DataFrame | None, otx: DataFrame | None,
    custom: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """All providers' answers per address, as nullable structs with their expiry."""
    out = addresses.select("ip")
    if abuse is not None:
        a = latest_entries(abuse, "ip").select("ip", F.struct(
            "abuse_score", "country", "total_reports", "is_whitelisted", "isp"
        ).alias("abuseipdb"), F.col("expires").alias("abuse_expires"))
        out = out.join(a, "ip", "left")
    if geo is not None:
        g = geo_lookup(addresses, geo).select("ip", F.struct("country_code", "country", "city", "high_risk_country").alias("geoip"))
        out = out.join(g, "ip", "left")
    if otx is not None:
        o = latest_entries(otx, "ip").select("ip", F.struct("pulse_count", "pulses", "tags").alias("otx"), F.col("expires").alias("otx_expires"))
        out = out.join(o, "ip", "left")
    for name, table in (custom or {}).items():
        rest = [c for c in table.columns if c != "ip"]
        out = out.join(table.select("ip", F.struct(*rest).alias(name)), "ip", "left")
    return out


def register_provider(providers: Mapping[str, DataFrame], name: str, table: DataFrame) -> dict[str, DataFrame]:
    """Provider tables with one more, keyed by ``ip``. Columns ``abuse_score`` and ``high_risk_country`` add risk."""
    return {**providers, name: table}


def _spread(value: Column, seq: Column) -> Column:
    """A join key that is never null: keyless rows are spread over many values that match nothing."""
    return F.when(value.isNotNull() & (value != ""), value).otherwise(F.concat(F.lit("\u0001"), F.pmod(seq, F.lit(997)).cast("string")))


def enrich(
    events: DataFrame, abuse: DataFrame | None = None, geo: DataFrame | None = None, otx: DataFrame | None = None,
    malware: DataFrame | None = None, custom: Mapping[str, DataFrame] | None = None, addresses: DataFrame | None = None,
) -> DataFrame:
    """Add ``threat_intel`` (one nullable struct per provider) and ``intel_bonus``.

    ``addresses`` (``ip``, distinct) may name the addresses to look up where they are cheaper to have than from ``events``; it
    must hold all of theirs. The answers and the hashes are written tables: their true size decides how the wide
    events meet them, which need not be shuffled for a few of them.
    """
    wanted = stage(distinct_addresses(events) if addresses is None else addresses, "addresses")
    answers = stage(lookup_table(wanted, abuse, geo, otx, custom), "answers")
    return attach(events, answers, None if malware is None else stage(malware, "malware"), tuple(custom or ()))


def distinct_addresses(events: DataFrame) -> DataFrame:
    """The remote addresses of these events, as ``ip``."""
    return events.where(F.coalesce("remote_addr", F.lit("")) != "").select(F.col("remote_addr").alias("ip")).distinct()


def attach(events: DataFrame, table: DataFrame, malware: DataFrame | None = None, custom: tuple[str, ...] = ()) -> DataFrame:
    """As ``enrich``, from answers already looked up: ``table`` is a ``lookup_table``. Works on a stream as well."""
    keyed = events.withColumn("_ip", _spread(F.col("remote_addr"), F.col("seq")))
    joined = keyed.join(table.withColumnRenamed("ip", "_ip"), "_ip", "left")
    fields, bonus = [], F.lit(0.0)

    def points(flag: Column, value: float) -> Column:
        return F.when(F.coalesce(flag, F.lit(False)), value).otherwise(0.0)

    if "abuseipdb" in table.columns:
        valid = F.when(F.col("ts") < F.col("abuse_expires"), F.col("abuseipdb"))
        fields.append(valid.alias("abuseipdb"))
        bonus = bonus + points(valid["abuse_score"] > 50, 20.0)
    if "geoip" in table.columns:
        fields.append(F.col("geoip"))
        bonus = bonus + points(F.col("geoip.high_risk_country"), 15.0)
    if "otx" in table.columns:
        fields.append(F.when(F.col("ts") < F.col("otx_expires"), F.col("otx")).alias("otx"))
    for name in custom:
        fields.append(F.col(name))
        inner = table.schema[name].dataType.names
        if "abuse_score" in inner:
            bonus = bonus + points(F.col(f"{name}.abuse_score") > 50, 20.0)
        if "high_risk_country" in inner:
            bonus = bonus + points(F.col(f"{name}.high_risk_country"), 15.0)
    if malware is not None:
        known = malware.dropDuplicates(["sha256"]).select(
            F.col("sha256").alias("_hash"), F.struct("family", "tags", "file_type", "first_seen").alias("_m")
        )
        joined = joined.withColumn("_hash", _spread(F.col("new_hash"), F.col("seq"))).join(known, "_hash", "left")
        checked = F.when(F.length("new_hash") == 64, F.struct(
            F.col("_m").isNotNull().alias("known_malware"), F.col("_m.family").alias("family"), F.col("_m.tags").alias("tags"),
            F.col("_m.file_type").alias("file_type"), F.col("_m.first_seen").alias("first_seen"),
        ))
        fields.append(checked.alias("malware_check"))
        bonus = bonus + points(checked["known_malware"], 80.0)
    intel = F.struct(*fields) if fields else F.lit(None).cast("struct<none:string>")
    return joined.select(*events.columns, intel.alias("threat_intel"), bonus.alias("intel_bonus"))


def lookup_ip(ip: str, abuse: DataFrame, geo: DataFrame, otx: DataFrame, now=None) -> DataFrame:
    """Everything known about one address."""
    spark = abuse.sparkSession
    one = spark.range(1).select(F.lit(ip).alias("ip"))
    only = F.col("ip") == ip
    row = lookup_table(one, abuse.where(only), geo, otx.where(only))
    if now is None:
        return row.drop("abuse_expires", "otx_expires")
    at = F.lit(now).cast("timestamp")
    return row.withColumns({
        "abuseipdb": F.when(at < F.col("abuse_expires"), F.col("abuseipdb")),
        "otx": F.when(at < F.col("otx_expires"), F.col("otx")),
    }).drop("abuse_expires", "otx_expires")


def refresh_cache(cache: DataFrame, answers: DataFrame, now, ttl_minutes: int = 1440) -> DataFrame:
    """Cache contents after a lookup round: new answers get a fresh expiry, expired rows go."""
    at = F.lit(now).cast("timestamp")
    fresh = answers.withColumn("expires", at + F.expr(f"interval {ttl_minutes} minutes"))
    kept = cache.where(F.col("expires") > at).join(answers.select("provider", "ip").distinct(), ["provider", "ip"], "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def country(threat_intel: Column) -> Column:
    return X.country_of(threat_intel)
