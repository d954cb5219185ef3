"""Threat intelligence."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostwarden.catalog.base import add, ev, r6, us, with_ev
from hostwarden.functions import expr as X
from hostwarden.operators import threat_intel as I
from hostwarden.sources import sample_tables as T

_IPNUM = "(CAST(split_part({c}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({c}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({c}, '.', 3) AS BIGINT) * 256 + CAST(split_part({c}, '.', 4) AS BIGINT))"
TABLES = f"""
ad AS (SELECT remote_addr AS ip, count(*) AS n, min(us) AS first_us FROM ev WHERE remote_addr IS NOT NULL GROUP BY remote_addr),
abuse AS (SELECT ip, (n % 100)::DOUBLE AS abuse_score, 'US' AS country, n AS total_reports, (n % 2 = 0) AS is_whitelisted, 'isp-' || (n % 7) AS isp, first_us + 1800000000 AS expires FROM ad),
nets AS (SELECT DISTINCT regexp_replace(ip, '\\.[0-9]+$', '') AS net FROM ad),
geo AS (SELECT net || '.0' AS ip_from, net || '.1' AS ip_to, (['RU','US','CN','DE','IR'])[strlen(net) % 5 + 1] AS country_code, 'City ' || net AS city FROM nets
        UNION ALL SELECT net || '.0', net || '.255', 'SE', 'Region ' || net FROM nets),
otx AS (SELECT ip, 1 + n % 3 AS pulse_count, list_transform(range(1, 2 + n % 3), lambda i: 'pulse-' || i) AS pulses,
          flatten(list_transform(range(1, 2 + n % 3), lambda i: ['tag-' || i, 'net-' || (n % 5)])) AS tags, first_us + 1800000000 AS expires FROM ad WHERE n % 4 <> 1),
mal AS (SELECT DISTINCT new_hash AS sha256, 'family-' || (strlen(path) % 3) AS family FROM ev WHERE kind = 'file_modified' AND new_hash = sha256(path || '#1')),
gl AS (SELECT ip, country_code, city FROM (SELECT ad.ip, g.country_code, g.city, row_number() OVER (PARTITION BY ad.ip ORDER BY {_IPNUM.format(c='g.ip_to')} - {_IPNUM.format(c='g.ip_from')}) AS rn
       FROM ad JOIN geo g ON {_IPNUM.format(c='ad.ip')} BETWEEN {_IPNUM.format(c='g.ip_from')} AND {_IPNUM.format(c='g.ip_to')}) WHERE rn = 1)"""
RISKY = "('KP','IR','RU','CN','SY','CU','VE')"
INTEL_BONUS_SQL = (
    f"(CASE WHEN e.us < a.expires AND a.abuse_score > 50 THEN 20 ELSE 0 END + CASE WHEN g.country_code IN {RISKY} THEN 15 ELSE 0 END + CASE WHEN m.sha256 IS NOT NULL THEN 80 ELSE 0 END)"
)
INTEL_JOIN = "LEFT JOIN abuse a ON a.ip = e.remote_addr LEFT JOIN gl g ON g.ip = e.remote_addr LEFT JOIN otx o ON o.ip = e.remote_addr LEFT JOIN mal m ON m.sha256 = e.new_hash"


def tables(spark, sf):
    e = ev(spark, sf)
    return T.intel_abuse(e), T.intel_geo(e), I.flatten_pulses(T.intel_otx(e)), T.intel_malware(e)


def enriched(spark, sf):
    return I.enrich(ev(spark, sf), *tables(spark, sf))


add(
    "s7_intel_abuse", lambda spark, sf: T.intel_abuse(ev(spark, sf)).select("ip", "abuse_score", "total_reports", "isp", us("expires")),
    with_ev("SELECT ip, abuse_score, total_reports, isp, expires AS us FROM abuse", TABLES),
)
add("s7_intel_geo", lambda spark, sf: T.intel_geo(ev(spark, sf)).select("ip_from", "ip_to", "country_code", "city"), with_ev("SELECT ip_from, ip_to, country_code, city FROM geo", TABLES))
add("s7_intel_malware", lambda spark, sf: T.intel_malware(ev(spark, sf)).select("sha256", "family"), with_ev("SELECT sha256, family FROM mal", TABLES))
add(
    "s8_feedback", lambda spark, sf: T.feedback(ev(spark, sf)).select("entity_id", "rule_name", F.col("false_positive").cast("int").alias("fp"), us("ts")),
    with_ev(
        "SELECT entity_id, CASE kind WHEN 'new_process' THEN 'suspicious_path' WHEN 'suspicious_port' THEN 'suspicious_port' WHEN 'file_modified' THEN 'critical_file_modified' WHEN 'cpu_abuse' THEN 'cpu_abuse' "
        "ELSE kind END AS rule_name, CAST(seq % 3 = 0 AS INTEGER) AS fp, us FROM ev"
    ),
)
add(
    "i1_ip_reputation",
    lambda spark, sf: I.enrich(ev(spark, sf), abuse=tables(spark, sf)[0]).select("seq", F.col("threat_intel.abuseipdb.abuse_score").alias("abuse_score"), "intel_bonus"),
    with_ev(
        "SELECT seq, CASE WHEN e.us < a.expires THEN abuse_score END AS abuse_score, CASE WHEN e.us < a.expires AND abuse_score > 50 THEN 20.0 ELSE 0.0 END AS intel_bonus "
        "FROM ev e LEFT JOIN abuse a ON a.ip = e.remote_addr", TABLES,
    ),
)
add(
    "i2_geoip",
    lambda spark, sf: I.enrich(ev(spark, sf), geo=tables(spark, sf)[1]).select("seq", F.col("threat_intel.geoip.country_code").alias("cc"), F.col("threat_intel.geoip.city").alias("city"), "intel_bonus"),
    with_ev(f"SELECT seq, country_code AS cc, city, CASE WHEN country_code IN {RISKY} THEN 15.0 ELSE 0.0 END AS intel_bonus FROM ev e LEFT JOIN gl ON gl.ip = e.remote_addr", TABLES),
)
add(
    "i3_otx_pulses",
    lambda spark, sf: tables(spark, sf)[2].select("ip", "pulse_count", F.concat_ws(",", "pulses").alias("pulses"), F.concat_ws(",", "tags").alias("tags")),
    with_ev("SELECT ip, pulse_count, array_to_string(pulses, ',') AS pulses, array_to_string(tags, ',') AS tags FROM otx", TABLES),
)
add(
    "i4_malware_hash",
    lambda spark, sf: I.enrich(ev(spark, sf), malware=tables(spark, sf)[3]).select(
        "seq", F.col("threat_intel.malware_check.known_malware").cast("int").alias("known"), F.col("threat_intel.malware_check.family").alias("family"), "intel_bonus"
    ),
    with_ev(
        "SELECT seq, CASE WHEN strlen(new_hash) = 64 THEN CAST(m.sha256 IS NOT NULL AS INTEGER) END AS known, m.family, CASE WHEN m.sha256 IS NOT NULL THEN 80.0 ELSE 0.0 END AS intel_bonus "
        "FROM ev e LEFT JOIN mal m ON m.sha256 = e.new_hash", TABLES,
    ),
)
add(
    "i5_threat_intel",
    lambda spark, sf: enriched(spark, sf).select(
        "seq", "intel_bonus", F.col("threat_intel.abuseipdb").isNotNull().cast("int").alias("has_abuse"), F.col("threat_intel.geoip").isNotNull().cast("int").alias("has_geo"),
        F.col("threat_intel.otx").isNotNull().cast("int").alias("has_otx"), F.col("threat_intel.malware_check").isNotNull().cast("int").alias("has_malware"),
    ),
    with_ev(
        f"SELECT seq, CAST({INTEL_BONUS_SQL} AS DOUBLE) AS intel_bonus, CAST(coalesce(e.us < a.expires, false) AS INTEGER) AS has_abuse, CAST(g.ip IS NOT NULL AS INTEGER) AS has_geo, "
        f"CAST(coalesce(e.us < o.expires, false) AS INTEGER) AS has_otx, CAST(e.new_hash IS NOT NULL AS INTEGER) AS has_malware FROM ev e {INTEL_JOIN}", TABLES,
    ),
)
add(
    "i6_expired_entries",
    lambda spark, sf: enriched(spark, sf).where("remote_addr is not null and threat_intel.abuseipdb is null").groupBy("remote_addr").agg(F.count(F.lit(1)).alias("misses")),
    with_ev("SELECT remote_addr, count(*) AS misses FROM ev e LEFT JOIN abuse a ON a.ip = e.remote_addr WHERE remote_addr IS NOT NULL AND NOT coalesce(e.us < a.expires, false) GROUP BY remote_addr", TABLES),
)
add(
    "i7_ip_lookup",
    lambda spark, sf: I.lookup_ip("10.0.0.1", *tables(spark, sf)[:3]).select("ip", "abuseipdb.abuse_score", "geoip.country_code", "otx.pulse_count"),
    with_ev("SELECT a.ip, abuse_score, country_code, pulse_count FROM abuse a LEFT JOIN gl USING (ip) LEFT JOIN otx USING (ip) WHERE a.ip = '10.0.0.1'", TABLES),
)
add(
    "i8_country", lambda spark, sf: enriched(spark, sf).select("seq", X.country_of(F.col("threat_intel")).alias("country")),
    with_ev("SELECT seq, coalesce(country_code, '') AS country FROM ev e LEFT JOIN gl ON gl.ip = e.remote_addr", TABLES),
)
add(
    "u3_register_provider",
    lambda spark, sf: I.enrich(ev(spark, sf), custom=I.register_provider(
        {}, "inhouse", ev(spark, sf).where("remote_addr is not null").groupBy(F.col("remote_addr").alias("ip")).agg((F.count(F.lit(1)) % 100).cast("double").alias("abuse_score"))
    )).select("seq", "intel_bonus", F.col("threat_intel.inhouse.abuse_score").alias("s")),
    with_ev("SELECT seq, CASE WHEN abuse_score > 50 THEN 20.0 ELSE 0.0 END AS intel_bonus, abuse_score AS s FROM ev e LEFT JOIN abuse a ON a.ip = e.remote_addr", TABLES),
)
_NOW = 1704067200000000 + 1_900_000_000
add(
    "k8_intel_cache",
    lambda spark, sf: I.refresh_cache(
        tables(spark, sf)[0].select(F.lit("abuseipdb").alias("provider"), "ip", F.col("abuse_score").cast("string").alias("data"), "expires"),
        ev(spark, sf).where("remote_addr like '10.%'").select(F.lit("abuseipdb").alias("provider"), F.col("remote_addr").alias("ip"), F.lit("fresh").alias("data")).distinct(),
        F.timestamp_micros(F.lit(_NOW)),
    ).select("ip", F.when(F.col("data") == "fresh", "fresh").otherwise("kept").alias("what"), us("expires")),
    with_ev(
        f"SELECT ip, 'kept' AS what, expires AS us FROM abuse WHERE expires > {_NOW} AND ip NOT LIKE '10.%' UNION ALL SELECT ip, 'fresh', {_NOW} + 86400000000 FROM ad WHERE ip LIKE '10.%'", TABLES,
    ),
)
