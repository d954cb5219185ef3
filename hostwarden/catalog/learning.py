"""Anomaly features, isolation forest and drift."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from hostwarden.catalog.base import add, ev, r6, us, with_ev
from hostwarden.catalog.correlating import FEEDBACK
from hostwarden.config import AnomalyConfig
from hostwarden.operators import anomaly_features as A, drift as D, isolation_forest as IF
from hostwarden.session import stage
from hostwarden.sources import sample_tables as T

CFG = AnomalyConfig()
_FEATURES: dict = {}


def features(spark, sf):
    return A.extract(ev(spark, sf))


def feature_table(spark, sf):
    """Features stored once per session: fitting and scoring read them several times."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FEATURES:
        _FEATURES[key] = stage(features(spark, sf).select("host_id", "seq", "ts", *A.FEATURES), "features")
    return _FEATURES[key]


W = 300_000_000
FEAT = f"""
nt0 AS (SELECT *, CASE WHEN us - lag(us) OVER w >= {W} OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS starts FROM ev WHERE source = 'network' WINDOW w AS (PARTITION BY pid ORDER BY us, seq)),
nt AS (SELECT *, sum(starts) OVER (PARTITION BY pid ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS sess FROM nt0),
cur AS (SELECT e.seq, e.us, e.pid, arg_max(n.sess, (n.us, n.seq)) AS sess, max(n.us) AS last_us FROM ev e JOIN nt n ON n.pid = e.pid AND (n.us < e.us OR (n.us = e.us AND n.seq <= e.seq)) GROUP BY e.seq, e.us, e.pid),
act AS (SELECT c.seq, count(*) AS conns, count(DISTINCT n.remote_addr) AS ips, count(DISTINCT n.remote_port) AS ports FROM cur c JOIN nt n ON n.pid = c.pid AND n.sess = c.sess
          AND (n.us < c.us OR (n.us = c.us AND n.seq <= c.seq)) WHERE c.last_us > c.us - {W} GROUP BY c.seq),
gap AS (SELECT e.seq, (max(n.us) - min(n.us)) / 1000000.0 / (count(*) - 1) AS avg_interval FROM ev e JOIN nt n ON n.pid = e.pid AND (n.us < e.us OR (n.us = e.us AND n.seq <= e.seq)) AND n.us > e.us - {W}
        GROUP BY e.seq HAVING count(*) >= 2),
rate AS (SELECT seq, count(*) FILTER (source = 'process') OVER w / 5.0 AS procs, count(*) FILTER (source = 'filesystem') OVER w / 5.0 AS files FROM ev WINDOW w AS (ORDER BY us RANGE BETWEEN {W - 1} PRECEDING AND CURRENT ROW)),
feat AS (SELECT e.seq, e.us, coalesce(conns, 0) / 5.0 AS conn_per_min, coalesce(ips, 0)::DOUBLE AS unique_ips, coalesce(ports, 0)::DOUBLE AS unique_ports_f, coalesce(avg_interval, 0) AS avg_interval,
           procs AS proc_per_min, files AS file_mods_per_min FROM ev e LEFT JOIN act USING (seq) LEFT JOIN gap USING (seq) JOIN rate USING (seq))"""
GATED_FEAT = re.sub(r"\b(nt0|nt|cur|act|gap|rate|feat)\b", r"g_\1", re.sub(r"\bev\b", "ge", FEAT))  # the same over events that pass the gate
for _id, _col in zip(("a1", "a2", "a3", "a4", "a5", "a6"), A.FEATURES):
    add(f"{_id}_{_col}", lambda spark, sf, c=_col: features(spark, sf).select("seq", r6(F.col(c) + 1e-9, c)), with_ev(f"SELECT seq, round({_col} + 1e-9, 6) AS {_col} FROM feat", FEAT))
_ALL = ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in A.FEATURES)  # the offset moves exact halves off the rounding edge
add("a7_features", lambda spark, sf: features(spark, sf).select("seq", *[r6(F.col(c) + 1e-9, c) for c in A.FEATURES]), with_ev(f"SELECT seq, {_ALL} FROM feat", FEAT))


def forest_sql(table: str, prefix: str = "", points: str | None = None) -> str:
    """The forest over the features of ``table``, level by level, as tables ``smp``, ``nodes`` and ``paths`` (mean path of every row of
    ``points``, by default of the table itself)."""
    p = prefix
    levels = [f"{p}m0 AS (SELECT tree_id, 0::BIGINT AS node_id, f FROM {p}smp)"]
    for d in range(9):
        levels.append(
            f"{p}s{d} AS (SELECT *, low + share * (high - low) AS split, size > 1 AND low < high AND {d} < 8 AS cut FROM (SELECT tree_id, node_id, count(*) AS size, any_value(attr) AS attr, any_value(share) AS share, min(f[attr + 1]) AS low, max(f[attr + 1]) AS high "
            f"FROM {p}m{d} JOIN {p}dice USING (tree_id, node_id) GROUP BY tree_id, node_id))"
        )
        levels.append(f"{p}m{d + 1} AS (SELECT tree_id, 2 * node_id + CASE WHEN f[attr + 1] < split THEN 1 ELSE 2 END AS node_id, f FROM {p}m{d} JOIN {p}s{d} USING (tree_id, node_id) WHERE cut)")
    nodes = " UNION ALL ".join(
        f"SELECT tree_id, node_id, CASE WHEN cut THEN attr ELSE -1 END AS attr, CASE WHEN cut THEN split ELSE 0 END AS split, CASE WHEN cut THEN 2 * node_id + 1 ELSE -1 END AS l, CASE WHEN cut THEN 2 * node_id + 2 ELSE -1 END AS r, size, {d} AS depth FROM {p}s{d}"
        for d in range(9)
    )
    return f"""
{p}vec AS (SELECT seq, us, [{", ".join(A.FEATURES)}] AS f FROM {table}),
{p}drw AS (SELECT seq, f, CAST('0x' || substr(h, 1, 15) AS HUGEINT) AS a, CAST('0x' || substr(h, 17, 15) AS HUGEINT) AS b FROM (SELECT *, md5('{CFG.seed}:h0:' || seq) AS h FROM {p}vec)),
{p}smp AS (SELECT t AS tree_id, seq, f FROM {p}drw, range({CFG.num_trees}) g(t) QUALIFY row_number() OVER (PARTITION BY t ORDER BY (a + t * b) % {1 << 60}, seq) <= {CFG.sample_size}),
{p}dice AS (SELECT tree_id, node_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 6 AS attr, CAST('0x' || substr(h, 9, 12) AS BIGINT) / {float(1 << 48)}::DOUBLE AS share
  FROM (SELECT t AS tree_id, i AS node_id, md5('{CFG.seed}:' || t || ':' || i) AS h FROM range({CFG.num_trees}) g(t), range(511) k(i))),
{", ".join(levels)},
{p}nodes AS ({nodes}),
{p}pts AS (SELECT seq, us, [{", ".join(A.FEATURES)}] AS f FROM {points or table}),
{p}walk AS (SELECT seq, f, tree_id, 0::BIGINT AS node_id, false AS done FROM {p}pts, (SELECT DISTINCT tree_id FROM {p}nodes)
  UNION ALL SELECT seq, f, w.tree_id, CASE WHEN attr < 0 THEN w.node_id WHEN f[attr + 1] < split THEN l ELSE r END, attr < 0 FROM {p}walk w JOIN {p}nodes n ON n.tree_id = w.tree_id AND n.node_id = w.node_id WHERE NOT done),
{p}paths AS (SELECT seq, avg(depth + CASE WHEN size <= 1 THEN 0 WHEN size = 2 THEN 1 ELSE 2 * (ln(size - 1) + 0.5772156649) - 2 * (size - 1) / size::DOUBLE END) AS path
  FROM {p}walk JOIN {p}nodes USING (tree_id, node_id) WHERE done GROUP BY seq),
{p}anomaly AS (SELECT seq, path, pow(2.0, -path / {IF.path_constant(CFG.sample_size)!r}) AS anomaly_score FROM {p}paths)"""


def forest(select: str, table: str = "feat", *ctes: str) -> str:
    return with_ev(select, FEAT, *ctes, forest_sql(table)).replace("WITH ", "WITH RECURSIVE ", 1)


def nodes(model):
    return model.select("tree_id", "node_id", "attr", r6(F.col("split") + 1e-9, "split"), "left", "right", "size", "depth")


NODES_SQL = 'SELECT tree_id, node_id, attr, round(split + 1e-9, 6) AS split, l AS "left", r AS "right", size, depth FROM nodes'
LAST = "lastf AS (SELECT * FROM feat ORDER BY us DESC, seq DESC LIMIT 1000)"
add(
    "a8_subsample_sizes", lambda spark, sf: IF.subsamples(feature_table(spark, sf), CFG).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n")),
    "SELECT t AS tree_id, least(256, (SELECT count(*) FROM events)) AS n FROM range(100) r(t)",
)
add("a8_subsample_rows", lambda spark, sf: IF.samples(feature_table(spark, sf), CFG).select("tree_id", "seq"), forest("SELECT tree_id, seq FROM smp"))
add(
    "a9_tree_leaf_rows", lambda spark, sf: IF.fit(feature_table(spark, sf), CFG).where("attr = -1").groupBy("tree_id").agg(F.sum("size").alias("n")),
    "SELECT t AS tree_id, least(256, (SELECT count(*) FROM events)) AS n FROM range(100) r(t)",
)
add("a9_forest", lambda spark, sf: nodes(IF.fit(feature_table(spark, sf), CFG)), forest(NODES_SQL))
add(
    "a10_path_length", lambda spark, sf: IF.path_length(feature_table(spark, sf), IF.fit(feature_table(spark, sf), CFG), CFG).select("seq", r6("path_length", "path_length")),
    forest("SELECT seq, round(path, 6) AS path_length FROM paths"),
)
add(
    "a11_forest_score", lambda spark, sf: IF.score(feature_table(spark, sf), IF.fit(feature_table(spark, sf), CFG), CFG).select("seq", r6("anomaly_score", "anomaly_score")),
    forest("SELECT seq, round(anomaly_score, 6) AS anomaly_score FROM anomaly"),
)
add(
    "a12_untrained_score", lambda spark, sf: IF.score(feature_table(spark, sf), IF.fit(feature_table(spark, sf), CFG, min_rows=10**12), CFG).select("seq", "anomaly_score"),
    "SELECT event_id AS seq, 0.0::DOUBLE AS anomaly_score FROM events",
)
add(
    "a13_bonus", lambda spark, sf: ev(spark, sf).select("seq", IF.bonus((F.col("seq") % 101) / 100.0).alias("bonus")),
    with_ev("SELECT seq, CASE WHEN seq % 101 > 95 THEN 50.0 WHEN seq % 101 > 85 THEN 30.0 WHEN seq % 101 > 70 THEN 15.0 ELSE 0.0 END AS bonus FROM ev"),
)
add("a14_retraining_rows", lambda spark, sf: IF.retraining_rows(feature_table(spark, sf), 1000).select("seq", us("ts")), with_ev("SELECT seq, us FROM ev ORDER BY us DESC, seq DESC LIMIT 1000"))
add(
    "a15_retrain",
    lambda spark, sf: IF.fit(IF.retraining_rows(feature_table(spark, sf), 1000), CFG).where("attr = -1").groupBy("tree_id").agg(F.sum("size").alias("n")),
    "SELECT t AS tree_id, least(256, (SELECT count(*) FROM events)) AS n FROM range(100) r(t)",
)
add("a15_retrained_forest", lambda spark, sf: nodes(IF.fit(IF.retraining_rows(feature_table(spark, sf), 1000), CFG)), forest(NODES_SQL, "lastf", LAST))
# A score that drifts with time, so that the drift tests have something to find.
_T0 = 1704067200000000


def scores(spark, sf):
    drifting = (F.col("seq") * 37 % 100) / 500.0 + (F.unix_micros("ts") - _T0) / 7.2e9
    return ev(spark, sf).select("host_id", "seq", "ts", drifting.alias("anomaly_score"))


def base(spark, sf):
    return D.baseline(scores(spark, sf).where(F.unix_micros("ts") < _T0 + 1_200_000_000))


SC = f"""
sc AS (SELECT seq, us, (seq * 37 % 100) / 500.0 + (us - {_T0}) / 7.2e9 AS v FROM ev),
bs AS (SELECT count(*) AS n, coalesce(avg(v), 0) AS m, CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(v) END AS s FROM sc WHERE us < {_T0 + 1_200_000_000})"""
add(
    "a16_drift_baseline", lambda spark, sf: base(spark, sf).select("n", r6("base_mean", "mean"), r6("base_std", "std")),
    with_ev("SELECT n, round(m, 6) AS mean, round(s, 6) AS std FROM bs", SC),
)
_RECENT = "(SELECT avg(v) AS r FROM (SELECT v FROM sc ORDER BY us DESC, seq DESC LIMIT 200))"
add(
    "a17_drift_test", lambda spark, sf: D.test(scores(spark, sf), base(spark, sf), CFG).select(F.col("drifted").cast("int").alias("drifted"), r6("recent_mean", "recent_mean")),
    with_ev(f"SELECT CASE WHEN s <> 0 AND abs(r - m) > 2 * s THEN 1 ELSE 0 END AS drifted, round(r, 6) AS recent_mean FROM bs, {_RECENT}", SC),
)
add(
    "a18_drift_magnitude", lambda spark, sf: D.test(scores(spark, sf), base(spark, sf), CFG).select(r6("drift_sigma", "sigma")),
    with_ev(f"SELECT round(abs(r - m) / s, 6) AS sigma FROM bs, {_RECENT}", SC),
)
CHECKS = """
rk AS (SELECT *, row_number() OVER w AS rank, sum(v) OVER w AS s1, sum(v * v) OVER w AS s2 FROM sc WINDOW w AS (ORDER BY us, seq ROWS UNBOUNDED PRECEDING)),
ck AS (SELECT us // 300000000 + 1 AS check_no, max(rank) AS last_rank FROM rk GROUP BY ALL),
grid AS (SELECT unnest(range((SELECT min(check_no) FROM ck), (SELECT max(check_no) FROM ck) + 1)) AS check_no),
cl AS (SELECT g.check_no, (SELECT max(last_rank) FROM ck c WHERE c.check_no <= g.check_no) AS rank, (SELECT count(*) FROM fbk f WHERE f.us < g.check_no * 300000000) AS labels,
         (SELECT count(*) FILTER (fp) FROM fbk f WHERE f.us < g.check_no * 300000000) AS fps FROM grid g),
cf AS (SELECT c.check_no, c.rank, r.s1, r.s2, coalesce(w.s1, 0) AS w1, coalesce(b.s1, 0) AS b1, coalesce(b.s2, 0) AS b2, CASE WHEN labels > 0 THEN fps / labels::DOUBLE ELSE 0 END AS fp_rate,
         labels >= 10 AND fps / labels::DOUBLE > 0.3 AS fp_high, row_number() OVER (ORDER BY c.check_no) AS rn
       FROM cl c JOIN rk r ON r.rank = c.rank LEFT JOIN rk w ON w.rank = c.rank - 200 LEFT JOIN rk b ON b.rank = c.rank - 1000),
fold AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS check_no, m::DOUBLE AS m, s::DOUBLE AS s, 0::BIGINT AS since, 0::DOUBLE AS since_sum, NULL::BIGINT AS last_no, 0::DOUBLE AS sigma, false AS drifted, false AS due, 0::DOUBLE AS fp_rate FROM bs
  UNION ALL
  SELECT rn, check_no, CASE WHEN renewed THEN (s1 - b1) / least(rank, 1000) ELSE m END, CASE WHEN renewed THEN sqrt(greatest((s2 - b2) / least(rank, 1000) - pow((s1 - b1) / least(rank, 1000), 2), 0)) ELSE s END,
    CASE WHEN renewed THEN rank ELSE since END, CASE WHEN renewed THEN s1 ELSE since_sum END, CASE WHEN due THEN check_no ELSE last_no END, sigma, drifted, due, fp_rate
  FROM (SELECT *, (drifted OR due) AND rank >= 10 AS renewed FROM (SELECT *, sigma > 2 AS drifted, fp_high AND (last_no IS NULL OR check_no - last_no > 3) AS due FROM (
    SELECT c.*, f.m, f.s, f.since, f.since_sum, f.last_no,
      CASE WHEN f.s <> 0 AND c.rank > f.since THEN abs((c.s1 - CASE WHEN c.rank - 200 >= f.since THEN c.w1 ELSE f.since_sum END) / least(c.rank - f.since, 200) - f.m) / f.s ELSE 0 END AS sigma
    FROM fold f JOIN cf c ON c.rn = f.rn + 1))))"""


def decisions(spark, sf):
    return D.retrain_decisions(D.checks(scores(spark, sf), T.feedback(ev(spark, sf)), CFG), base(spark, sf), CFG)


add(
    "a19_retrain_decisions",
    lambda spark, sf: decisions(spark, sf).select(
        us("check_ts"), r6("drift_sigma", "sigma"), r6("fp_rate", "fp_rate"), F.col("drifted").cast("int").alias("drifted"), F.col("fp_due").cast("int").alias("fp_due"), "reason"
    ),
    with_ev(
        "SELECT check_no * 300000000 AS us, round(sigma, 6) AS sigma, round(fp_rate, 6) AS fp_rate, CAST(drifted AS INTEGER) AS drifted, CAST(due AS INTEGER) AS fp_due, "
        "concat_ws(' + ', CASE WHEN drifted THEN 'score mean shifted ' || printf('%.1f', sigma) || 'σ' END, CASE WHEN due THEN 'FP rate ' || printf('%.0f', fp_rate * 100) || '%' END) AS reason "
        "FROM fold WHERE drifted OR due", SC, FEEDBACK, CHECKS,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
add(
    "a20_training_samples", lambda spark, sf: feature_table(spark, sf).agg(F.count(F.lit(1)).alias("samples"), (F.count(F.lit(1)) >= 10).cast("int").alias("trainable")),
    "SELECT count(*) AS samples, CAST(count(*) >= 10 AS INTEGER) AS trainable FROM events",
)
