"""Unpacking of JSON rows."""

from __future__ import annotations

from hostwarden.catalog import reporting


def test_a_json_row_is_read_once(spark):
    """All fields come from one reading of the text; numbers and arrays stay as they are written, what is missing is null."""
    rows = spark.createDataFrame([(1, '{"a":1.50,"b":["x","y"],"c":{"d":"t","e":true},"f":""}'), (2, "{}"), (3, None)], "seq bigint, data string")
    found = reporting._read(rows, "data", reporting._strings("a", "b", "f", c=reporting._strings("d", "e"))).select("seq", "j.a", "j.b", "j.c.d", "j.c.e", "j.f")
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == {1: ("1.5", '["x","y"]', "t", "true", ""), 2: (None,) * 5, 3: (None,) * 5}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_feed_and_payloads_do_not_search_their_text_by_field(spark, monkeypatch, make_events):
    """The queries' plans hold one reading of the JSON text and no search for single fields."""
    from pyspark.sql import functions as F

    from hostwarden.catalog.base import QUERIES

    events = make_events([{"seq": 1, "source": "process"}]).withColumns({
        "score": F.lit(50.0), "severity": F.lit(3), "severity_label": F.lit("HIGH"), "patterns": F.array(F.lit("p")), "sigma_rules": F.array().cast("array<string>"),
        "anomaly_score": F.lit(0.0), "multiplier": F.lit(None).cast("double"), "threat_intel": F.lit(None).cast("struct<geoip:struct<country_code:string>>"),
    })
    monkeypatch.setattr(reporting, "scored_table", lambda spark, sf: events)
    for name in ("k2_webhook_payloads", "k4_live_feed"):
        found = QUERIES[name](spark, "unused")
        row = found.first()
        assert (row["score"], row["multiplier"], row["patterns"], row["sigma_rules"]) == (50.0, 0.0, '["p"]', "[]")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and "get_json_object" not in plan
