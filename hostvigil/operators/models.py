"""Scores of frames: learned stages, smoothing and cooldowns, attribution, and all stages in order.

What depends on a host's earlier frames is a scan (see `ladder`): hosts run side by side, each in order of time with a
state of fixed size, and no history is held. All else is column expressions and windows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostvigil.catalogue import LAYER_OF, LAYERS, MODELLED, SEVERITIES, TRENDS, WORSE_UP
from hostvigil.operators import hosts
from hostvigil.operators import ladder as L
from hostvigil.operators import state as S
from hostvigil.operators.frames import DERIVED_SQL, FRAME_SQL, OFF_TIES, SPARSE, coverage_sql, derive_cross_layer, frames_of, limit_of, risk_floor, severity_name, with_rules, worst_hit
from hostvigil.operators.incidents import BLIND_BELOW, cards, evidence, incident_table
from hostvigil.registry import query
from hostvigil.sources.fixtures import fixture
from hostvigil.sources.scratch import materialize

DENSE = ["gw_rtt_ms", "gw_jitter_ms", "gw_loss_rate", "dns_p50_ms", "dns_p95_ms", "dns_fail_rate", "https_ttfb_ms", "https_tcp_ms", "https_tls_ms", "https_total_ms", "https_fail_rate", "path_rtt_ms", "wifi_rssi_dbm", "wifi_tx_retry_rate", "wifi_link_mbps", "os_cpu_pct", "os_retrans_rate"]
LEARNED = [f for f in DENSE if f in MODELLED]


def ewma_moments(rows: DataFrame) -> DataFrame:
    """`rows` (host_id, ts, value) with the moments of the values so far under a bounded learning rate."""

    def step(m: list[float], batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for x in batch.column("value").to_pylist():
            if x is not None:
                m[0] += 1
                rate = min(L.RATE_MOST, max(L.RATE_LEAST, 1 / m[0])) if m[0] > 1 else 1.0
                gap = x - m[1]
                m[1] += rate * gap
                m[2] = (1 - rate) * (m[2] + rate * gap * gap)
            out.append((m[1], m[2]))
        return [pa.array(c, pa.float64()) for c in zip(*out)]

    return L.scan(rows, lambda: [0.0, 0.0, 0.0], step, [T.StructField("mean", T.DoubleType()), T.StructField("var", T.DoubleType())])


def learned_frames(frames: DataFrame, features: list[str] = LEARNED) -> DataFrame:
    return frames.select("host_id", "tick", "ts", *[F.col(f).cast("double").alias(f) for f in features])


def l1_rows(climbed: DataFrame, features: list[str] = LEARNED) -> DataFrame:
    """A row a frame and feature: smoothed contribution, CUSUM, and whether a shift for the worse has built up."""
    each = F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("l1").alias("contribution"), F.col("cusum_high")))
    rows = climbed.select("host_id", "tick", "ts", each.alias("e")).select("host_id", "tick", "ts", "e.feature", "e.contribution", "e.cusum_high")
    return rows.withColumn("shifted", F.coalesce((F.col("cusum_high") >= L.CUSUM_SHIFT).cast("int"), F.lit(0)))


def l2_rows(climbed: DataFrame) -> DataFrame:
    """A row a frame and layer: error, score and relative error; the error of a layer with a value missing is null."""
    each = F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in L.ORDER]).alias("layer"), F.col("l2_rmse").alias("rmse"), F.col("l2_score").alias("score"), F.col("l2_relative").alias("relative")))
    return climbed.select("host_id", "tick", "ts", each.alias("e")).select("host_id", "tick", "ts", "e.*")


def drift_rows(climbed: DataFrame) -> DataFrame:
    """A row a feature on every check: PSI, whether it drifted, how much, and what follows."""
    rows = climbed.filter("drift IS NOT NULL").select("host_id", "ts", F.col("drift_frame").alias("frame"), F.explode("drift").alias("d")).select("host_id", "d.feature", "ts", "frame", "d.psi", "d.n_reference", "d.n_recent", "d.ready", "d.drifted")
    return rows.withColumns({"severity": F.when(F.col("drifted"), F.when(F.col("psi") >= 2 * L.DRIFT_PSI, "significant").otherwise("moderate")), "action": F.when(F.col("drifted"), "relearn_baseline")})


def combine(values: Column) -> Column:
    """Anomaly of an array of contributions: the largest, and a share of the next three."""
    def of(s: Column) -> Column:
        rest = sum((F.coalesce(F.get(s, k), F.lit(0.0)) for k in (1, 2, 3)), F.lit(0.0))
        return F.when(F.size(s) == 0, 0.0).otherwise(F.least(F.lit(1.0), (F.get(s, 0) + 0.35 * rest / 3) / 3))

    # as a variable, the sorted array is made once and not for each of its places
    return F.get(F.transform(F.array(F.sort_array(F.filter(values, lambda x: x > 0.01), asc=False)), of), 0)


def combine_all(values: list[Column]) -> Column:
    """`combine` of columns, in code that is compiled: a contribution that doesn't count adds as much as one that isn't there."""
    s = F.sort_array(F.array(*[F.when(v > 0.01, v).otherwise(F.lit(0.0)) for v in values]), asc=False)
    rest = sum((F.get(s, F.lit(k)) if k < len(values) else F.lit(0.0) for k in (1, 2, 3)), F.lit(0.0))
    return F.least(F.lit(1.0), (F.get(s, F.lit(0)) + 0.35 * rest / 3) / 3) if values else F.lit(0.0)


_SMOOTHED = [T.StructField(n, T.DoubleType()) for n in ("risk", "smoothed", "health")]


def smooth_scores(scores: DataFrame) -> DataFrame:
    """Published risk, smoothed risk and health per frame."""

    def step(r: S.Risk, rows: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for raw, floor, coverage, l1, l2 in zip(*[rows.column(c).to_pylist() for c in ("risk_raw", "risk_floor", "coverage", "l1_anomaly", "l2_anomaly")], strict=True):
            risk = r.step(raw, floor, coverage)
            out.append((risk, r.risk, r.step_health(l1, l2, risk, floor)))
        return [pa.array(c, pa.float64()) for c in zip(*out)]

    num = scores.select("host_id", "tick", "ts", *[F.col(c).cast("double").alias(c) for c in ("risk_raw", "risk_floor", "coverage", "l1_anomaly", "l2_anomaly")])
    return L.scan(num, S.Risk, step, _SMOOTHED).select("host_id", "tick", "ts", "risk", "smoothed", "health")


def forecast_scores(frames: DataFrame) -> DataFrame:
    """`frames` with risk_5m, risk_15m and health: the raw risks l3_5m and l3_15m smoothed, never under the rules' floor; a
    blind frame publishes the floor. Health looks at the nearer risk. A host's frames must be in one partition."""

    def step(state: tuple[S.Risk, S.Risk], rows: pa.RecordBatch) -> list[pa.Array]:
        near, far = state
        out = []
        for a, b, floor, coverage, l1, l2 in zip(*[rows.column(c).to_pylist() for c in ("l3_5m", "l3_15m", "risk_floor", "coverage", "l1_anomaly", "l2_anomaly")], strict=True):
            soon, later = near.step(a, floor, coverage), far.step(b, floor, coverage)
            out.append((soon, later, near.step_health(l1, l2, soon, floor)))
        return [pa.array(c, pa.float64()) for c in zip(*out)]

    return L.scan(frames, lambda: (S.Risk(), S.Risk()), step, [T.StructField(n, T.DoubleType()) for n in ("risk_5m", "risk_15m", "health")], dealt=True)


def greedy_cooldown(events: DataFrame, seconds: float, keys: list[str], escalates: bool = False) -> DataFrame:
    """Events with `kept`: none of the same key was kept within `seconds` (or it is more severe than the last kept). The
    first key is host_id; a host's events are read in order of time, with a cooldown for each of its other keys."""

    def step(found: dict[tuple, S.Cooldown], rows: pa.RecordBatch) -> list[pa.Array]:
        others = zip(*(rows.column(k).to_pylist() for k in keys[1:])) if keys[1:] else iter(lambda: (), None)
        return [pa.array([found.setdefault(k, S.Cooldown(seconds)).step(ts, int(rank), escalates) for k, ts, rank in zip(others, rows.column("ts").to_pylist(), rows.column("rank").to_pylist())], pa.bool_())]

    return L.scan(events, dict, step, [T.StructField("kept", T.BooleanType())])


# ---- queries with recursion as oracle -------------------------------------------------------------------------------
_ROWS = "(SELECT host_id, tick, ts, gw_rtt_ms AS x, row_number() OVER (PARTITION BY host_id ORDER BY ts) AS i FROM samples_dense)"
_STEP = "least(0.05, greatest(0.002, 1.0 / r.i))"


@query(
    f"""SELECT host_id, tick, 'gw_rtt_ms' AS feature, round(mean, 6) AS mean, round(var, 6) AS var FROM (WITH RECURSIVE r AS (SELECT * FROM {_ROWS}), m AS (SELECT host_id, tick, i, x AS mean, CAST(0 AS DOUBLE) AS var FROM r WHERE i = 1
    UNION ALL SELECT r.host_id, r.tick, r.i, m.mean + {_STEP} * (r.x - m.mean), (1 - {_STEP}) * (m.var + {_STEP} * (r.x - m.mean) * (r.x - m.mean)) FROM m JOIN r ON r.host_id = m.host_id AND r.i = m.i + 1) SELECT * FROM m)""",
    "samples_dense",
    name="ewma_moments",
)
def _ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "samples_dense").select("host_id", "tick", "ts", F.lit("gw_rtt_ms").alias("feature"), F.col("gw_rtt_ms").cast("double").alias("value"))
    return ewma_moments(rows).select("host_id", "tick", "feature", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@query(
    """SELECT host_id, tick, round(high, 6) AS high, round(low, 6) AS low FROM (WITH RECURSIVE r AS (SELECT host_id, tick, (gw_rtt_ms - 2.5) AS z, row_number() OVER (PARTITION BY host_id ORDER BY ts) AS i FROM samples_dense),
    m AS (SELECT host_id, tick, i, greatest(0.0, least(6.0, z - 0.5)) AS high, greatest(0.0, least(6.0, -z - 0.5)) AS low FROM r WHERE i = 1 UNION ALL SELECT r.host_id, r.tick, r.i, greatest(0.0, least(6.0, m.high + r.z - 0.5)), greatest(0.0, least(6.0, m.low - r.z - 0.5)) FROM m JOIN r ON r.host_id = m.host_id AND r.i = m.i + 1) SELECT * FROM m)""",
    "samples_dense",
)
def cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided CUSUM of a given z."""

    def step(c: list[float], rows: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for z in rows.column("z").to_pylist():
            c[:] = [max(0.0, min(L.CUSUM_LIMIT, x + y - L.CUSUM_K)) for x, y in zip(c, (z, -z))]
            out.append(tuple(round(x, 6) for x in c))
        return [pa.array(v, pa.float64()) for v in zip(*out)]

    rows = fixture(spark, sf_dir, "samples_dense").select("host_id", "tick", "ts", (F.col("gw_rtt_ms") - 2.5).cast("double").alias("z"))
    return L.scan(rows, lambda: [0.0, 0.0], step, [T.StructField(n, T.DoubleType()) for n in ("high", "low")]).select("host_id", "tick", "high", "low")


_SMOOTH_SQL = """(WITH RECURSIVE r AS (SELECT host_id, tick, CAST(risk_raw AS DOUBLE) AS p, CAST(risk_floor AS DOUBLE) AS f, CAST(coverage AS DOUBLE) AS c, CAST(l1_anomaly AS DOUBLE) AS a, CAST(l2_anomaly AS DOUBLE) AS b, row_number() OVER (PARTITION BY host_id ORDER BY ts) AS i FROM score_series),
  m AS (SELECT DISTINCT host_id, CAST(0 AS BIGINT) AS tick, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS risk, CAST(0 AS DOUBLE) AS smoothed, CAST(100 AS DOUBLE) AS health FROM r
  UNION ALL SELECT x.host_id, x.tick, x.i, x.risk, x.s, least(100, greatest(0, x.h + 0.4 * (100 * (1 - greatest(x.f, least(1, 0.65 * x.a + 0.25 * x.b + 0.35 * x.risk))) - x.h))) FROM (
    SELECT r.*, m.health AS h, m.smoothed + 0.35 * (least(1, greatest(0, r.p)) - m.smoothed) AS s, CASE WHEN r.c < 0.15 THEN r.f ELSE greatest(r.f, m.smoothed + 0.35 * (least(1, greatest(0, r.p)) - m.smoothed)) END AS risk FROM m JOIN r ON r.host_id = m.host_id AND r.i = m.i + 1) x)
  SELECT * FROM m WHERE i > 0)"""


@query(f"SELECT host_id, tick, round(risk, 6) AS risk, round(smoothed, 6) AS smoothed FROM {_SMOOTH_SQL}", "score_series")
def risk_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smooth_scores(fixture(spark, sf_dir, "score_series")).select("host_id", "tick", F.round("risk", 6).alias("risk"), F.round("smoothed", 6).alias("smoothed"))


@query(f"SELECT host_id, tick, round(health, 5) AS health FROM {_SMOOTH_SQL}", "score_series")
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smooth_scores(fixture(spark, sf_dir, "score_series")).select("host_id", "tick", F.round("health", 5).alias("health"))


_EVENTS = "(SELECT host_id, primary_layer AS layer, ts, CASE WHEN risk_raw >= 0.75 THEN 3 ELSE 2 END AS rank, row_number() OVER (PARTITION BY host_id, primary_layer ORDER BY ts) AS i FROM score_series WHERE risk_raw >= 0.5)"


def _cooldown_sql(seconds: int, escalates: bool) -> str:
    keep = f"r.ts - m.last >= {seconds}" + (" OR r.rank > m.lr" if escalates else "")
    return f"""(WITH RECURSIVE r AS (SELECT * FROM {_EVENTS}), m AS (SELECT host_id, layer, ts, rank, i, ts AS last, rank AS lr, true AS kept FROM r WHERE i = 1
    UNION ALL SELECT r.host_id, r.layer, r.ts, r.rank, r.i, CASE WHEN {keep} THEN r.ts ELSE m.last END, CASE WHEN {keep} THEN r.rank ELSE m.lr END, {keep} FROM m JOIN r ON r.host_id = m.host_id AND r.layer = m.layer AND r.i = m.i + 1) SELECT * FROM m)"""


def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixture(spark, sf_dir, "score_series").filter("risk_raw >= 0.5")
    return s.select(F.col("host_id").cast("long").alias("host_id"), F.col("primary_layer").alias("layer"), "ts", F.when(F.col("risk_raw") >= 0.75, 3).otherwise(2).alias("rank"))


@query(f"SELECT host_id, layer, ts FROM {_cooldown_sql(1800, False)} WHERE kept", "score_series", name="greedy_cooldown")
def _greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy_cooldown(alert_events(spark, sf_dir), 1800, ["host_id", "layer"]).filter("kept").select("host_id", "layer", "ts")


# The settings of a host: on or off, least severity, quiet hours from and to (equal: none).
_SETTINGS = {"enabled": "host_id % 5 <> 4", "least": "CASE WHEN host_id % 3 = 0 THEN 1 ELSE 2 END", "quiet_from": "CASE WHEN host_id % 4 = 1 THEN 9 ELSE 22 END", "quiet_to": "CASE WHEN host_id % 4 = 1 THEN 9 ELSE 2 END"}


def held_back(events: DataFrame, settings: DataFrame) -> DataFrame:
    """host_id, layer, ts, rank and `outcome`: disabled, below floor or quiet hours (critical ones pass), the first that
    applies; null for events that only a cooldown can hold back. `events` may be a stream."""
    e = events.join(settings, "host_id")
    hour = F.hour(F.timestamp_seconds("ts"))
    inside = F.when(F.col("quiet_from") == F.col("quiet_to"), False).when(F.col("quiet_from") < F.col("quiet_to"), (hour >= F.col("quiet_from")) & (hour < F.col("quiet_to"))).otherwise((hour >= F.col("quiet_from")) | (hour < F.col("quiet_to")))
    e = e.withColumn("outcome", F.when(~F.col("enabled"), "disabled").when(F.col("rank") < F.col("least"), "below floor").when(inside & (F.col("rank") < 3), "quiet hours"))
    return e.select("host_id", "layer", "ts", "rank", "outcome")


#: Seconds between two notifications of a layer, but for more severe ones.
NOTIFY_COOLDOWN = 900


def notification_outcomes(events: DataFrame, settings: DataFrame) -> DataFrame:
    """`outcome` of every event: what holds it back (see `held_back`), cooldown (unless more severe than the last one sent), or sent."""
    e = held_back(events, settings)
    sent = greedy_cooldown(e.filter("outcome IS NULL").drop("outcome"), NOTIFY_COOLDOWN, ["host_id", "layer"], True)
    return e.filter("outcome IS NOT NULL").unionByName(sent.select("host_id", "layer", "ts", "rank", F.when(F.col("kept"), "sent").otherwise("cooldown").alias("outcome")))


_NOTED = f"""(SELECT host_id, primary_layer AS layer, ts, CASE WHEN risk_raw >= 0.75 THEN 3 WHEN risk_raw >= 0.5 THEN 2 ELSE 1 END AS rank, (CAST(ts AS BIGINT) // 3600) % 24 AS hour, {', '.join(f'{v} AS {k}' for k, v in _SETTINGS.items())} FROM score_series WHERE risk_raw >= 0.25)"""
_QUIET = "CASE WHEN quiet_from = quiet_to THEN false WHEN quiet_from < quiet_to THEN hour >= quiet_from AND hour < quiet_to ELSE hour >= quiet_from OR hour < quiet_to END"


@query(
    f"""SELECT * FROM (WITH RECURSIVE e AS (SELECT host_id, layer, ts, rank, CASE WHEN NOT enabled THEN 'disabled' WHEN rank < least THEN 'below floor' WHEN {_QUIET} AND rank < 3 THEN 'quiet hours' END AS outcome FROM {_NOTED}),
    r AS (SELECT *, row_number() OVER (PARTITION BY host_id, layer ORDER BY ts) AS i FROM e WHERE outcome IS NULL),
    m AS (SELECT host_id, layer, ts, rank, i, ts AS last, rank AS lr, true AS kept FROM r WHERE i = 1 UNION ALL
      SELECT r.host_id, r.layer, r.ts, r.rank, r.i, CASE WHEN r.ts - m.last >= 900 OR r.rank > m.lr THEN r.ts ELSE m.last END, CASE WHEN r.ts - m.last >= 900 OR r.rank > m.lr THEN r.rank ELSE m.lr END, r.ts - m.last >= 900 OR r.rank > m.lr FROM m JOIN r ON r.host_id = m.host_id AND r.layer = m.layer AND r.i = m.i + 1)
    SELECT host_id, layer, ts, outcome FROM e WHERE outcome IS NOT NULL UNION ALL SELECT host_id, layer, ts, CASE WHEN kept THEN 'sent' ELSE 'cooldown' END FROM m)""",
    "score_series",
)
def notification_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, settings = noted_events(spark, sf_dir)
    return notification_outcomes(events, settings).select("host_id", "layer", "ts", "outcome")


def noted_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events of severity watch or more, and the settings of each host."""
    s = fixture(spark, sf_dir, "score_series").filter("risk_raw >= 0.25")
    events = s.select(F.col("host_id").cast("long").alias("host_id"), F.col("primary_layer").alias("layer"), "ts", F.when(F.col("risk_raw") >= 0.75, 3).when(F.col("risk_raw") >= 0.5, 2).otherwise(1).alias("rank"))
    return events, events.select("host_id").distinct().select("host_id", *[F.expr(v).alias(k) for k, v in _SETTINGS.items()])


# Scoring only: a table of baselines by hour, learned from the first half of the view's time, joined to the frames after it.
_SEASONAL = {"gw_rtt_ms": 1.0, "wifi_rssi_dbm": -1.0}


def baseline_scores(learned: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` (host_id, tick, ts, feature, value) with z: against the hour's moments where 12 values are known, else those of
    all hours with a wider spread; 0 under 4 values; positive is worse."""
    hour = (F.floor(F.col("ts") / 3600) % 24).alias("hour")
    stats = lambda p: [F.avg("value").alias(f"{p}_mean"), F.stddev_pop("value").alias(f"{p}_std"), F.count("value").alias(f"{p}_n")]
    by_hour = learned.groupBy("host_id", "feature", hour).agg(*stats("hour"))
    overall = learned.groupBy("host_id", "feature").agg(*stats("all"))
    f = rows.withColumn("hour", hour).join(overall, ["host_id", "feature"], "left").join(by_hour, ["host_id", "feature", "hour"], "left")
    known = F.coalesce(F.col("hour_n"), F.lit(0)) >= 12
    pick = lambda c: F.when(known, F.col(f"hour_{c}")).otherwise(F.col(f"all_{c}"))
    spread = F.greatest(pick("std"), 0.25 * F.abs(pick("mean")), F.lit(1e-6)) * F.when(known, 1.0).otherwise(2.5)
    sign = F.element_at(F.create_map(*[F.lit(x) for kv in _SEASONAL.items() for x in kv]), F.col("feature"))
    return f.withColumn("z", F.when(F.coalesce(pick("n"), F.lit(0)) >= 4, sign * (F.col("value") - pick("mean")) / spread).otherwise(0.0))


def _seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture(spark, sf_dir, "samples_dense")
    low, high = d.agg(F.min("ts"), F.max("ts")).first()
    cut = (low or 0.0) + ((high or 0.0) - (low or 0.0)) / 2
    rows = d.select("host_id", "tick", "ts", *[F.col(f).cast("double").alias(f) for f in _SEASONAL]).unpivot(["host_id", "tick", "ts"], list(_SEASONAL), "feature", "value")
    return baseline_scores(rows.filter(F.col("ts") < cut), rows.filter(F.col("ts") >= cut))


_SEASONAL_SQL = f"""(WITH d AS ({' UNION ALL '.join(f"SELECT host_id, tick, ts, '{f}' AS feature, CAST({f} AS DOUBLE) AS x, {s} AS sign, CAST(floor(ts / 3600) AS BIGINT) % 24 AS h FROM samples_dense" for f, s in _SEASONAL.items())}), c AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS cut FROM samples_dense),
  old AS (SELECT d.* FROM d, c WHERE ts < cut), new AS (SELECT d.* FROM d, c WHERE ts >= cut),
  m AS (SELECT n.*, (SELECT count(*) FROM old o WHERE o.host_id = n.host_id AND o.feature = n.feature AND o.h = n.h) AS hn FROM (SELECT DISTINCT host_id, feature, h FROM new) n),
  b AS (SELECT m.host_id, m.feature, m.h, any_value(hn) AS hn, avg(o.x) AS mu, stddev_pop(o.x) AS sd, count(o.x) AS k FROM m LEFT JOIN old o ON o.host_id = m.host_id AND o.feature = m.feature AND (o.h = m.h OR m.hn < 12) GROUP BY 1, 2, 3)
  SELECT new.host_id, new.tick, new.feature, CASE WHEN k >= 4 THEN sign * (x - mu) / (greatest(sd, 0.25 * abs(mu), 1e-6) * CASE WHEN hn >= 12 THEN 1 ELSE 2.5 END) ELSE 0 END AS z FROM new JOIN b ON b.host_id = new.host_id AND b.feature = new.feature AND b.h = new.h)"""


@query(f"SELECT host_id, tick, feature, round(z + 1.37e-8, 6) AS score FROM {_SEASONAL_SQL}", "samples_dense")
def seasonal_baseline_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seasonal(spark, sf_dir).select("host_id", "tick", "feature", F.round(F.col("z") + 1.37e-8, 6).alias("score"))


@query(f"SELECT host_id, tick, feature, round(least(12, greatest(0, z - 1.5)) + 1.37e-8, 6) AS score FROM {_SEASONAL_SQL}", "samples_dense")
def l1_score_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions at once, without smoothing, while learning is paused."""
    z = F.least(F.lit(L.MAX_CONTRIBUTION), F.greatest(F.lit(0.0), F.col("z") - L.DEADBAND))
    return _seasonal(spark, sf_dir).select("host_id", "tick", "feature", F.round(z + 1.37e-8, 6).alias("score"))


@query(
    """SELECT event_id, coalesce(json_extract_string(props, '$.k'), '-') AS k, coalesce(json_extract_string(props, '$.none'), 'fallback') AS missing, CASE WHEN json_valid(broken) THEN json_extract_string(broken, '$.k') ELSE 'fallback' END AS broken
    FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN concat(props, 'x') WHEN 1 THEN substr(props, 1, length(props) - 1) ELSE props END AS broken FROM events)""",
)
def json_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of JSON texts, of keys that aren't there, and of texts that are broken at their end."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    broken = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("x"))).when(F.col("event_id") % 3 == 1, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    # inside of brackets, as the parser stops at the end of a value and doesn't look at what follows
    inside = lambda c: F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    of = lambda c, key: F.try_variant_get(inside(c), f"$[0].{key}", "string")
    return e.select("event_id", F.coalesce(of(F.col("props"), "k"), F.lit("-")).alias("k"), F.coalesce(of(F.col("props"), "none"), F.lit("fallback")).alias("missing"), F.coalesce(of(broken, "k"), F.lit("fallback")).alias("broken"))


# ---- attribution ------------------------------------------------------------------------------------------------------
CHAIN = ["wifi", "os", "gateway", "path", "remote_https"]


def attribute_sql(have: list[str]) -> dict[str, str]:
    """SQL of the excess score of each layer, from columns l1_<layer>, l2_<layer>, features, ratios and z columns."""
    from hostvigil.catalogue import RULES, SEVERITIES

    raw = {}
    for x in LAYERS:
        hits = " + ".join(f"CASE WHEN ({r.condition}) AND ({r.layer}) = '{x}' THEN {1.4 * (SEVERITIES.index(r.severity) + 1) / 4.0}e0 ELSE 0e0 END" for r in RULES)
        s = f"(coalesce(l1_{x}, 0e0) + 0.6e0 * coalesce(l2_{x}, 0e0) + {hits})"
        if x == "vpn":
            s = f"CASE WHEN coalesce(vpn_active, 0) >= 1 THEN {s} ELSE 0e0 END"
        if x == "wifi":
            s = f"CASE WHEN coalesce(wifi_rssi_dbm, wifi_tx_retry_rate, wifi_link_mbps) IS NOT NULL THEN {s} ELSE 0e0 END"
        raw[x] = s
    return raw


def _votes(raw: dict[str, str]) -> list[tuple[str, dict[str, str]]]:
    """Stages of columns: raw scores, dampened ones, votes between layers, silenced ones."""
    from hostvigil.catalogue import RULES

    damp = {}
    for i, x in enumerate(CHAIN):
        above = f"greatest(0e0, {', '.join(f'raw_{u}' for u in CHAIN[:i])})" if i else "0e0"
        damp[x] = f"greatest(0e0, raw_{x} - 0.75e0 * {above})"
    damp["dns"] = "greatest(0e0, raw_dns - 0.5e0 * greatest(raw_wifi, raw_gateway))"
    damp["vpn"] = "greatest(0e0, raw_vpn - 0.75e0 * raw_path)"
    quiet_gw, quiet_path = "(gw_rtt_ms IS NOT NULL AND coalesce(gw_rtt_ms_15m_z, 0e0) < 1.5)", "(coalesce(path_rtt_ms_15m_z, 0e0) < 1.5)"
    extra = "x_remote_minus_path_ms"
    tunnel = f"(coalesce(vpn_active, 0) >= 1 AND coalesce({extra}, 0e0) <> 0 AND {quiet_path})"
    share = f"least(0.6e0, {extra} / 400e0)"
    vote = {
        "wifi": "d_wifi + CASE WHEN x_wifi_pressure > 0.4 THEN least(0.5e0, (x_wifi_pressure - 0.4e0) * 1.5e0) ELSE 0e0 END",
        "os": "d_os",
        "dns": "d_dns + CASE WHEN x_dns_share > 0.35 THEN least(0.5e0, (x_dns_share - 0.35e0) * 2e0) ELSE 0e0 END",
        "gateway": "d_gateway",
        "path": f"d_path + CASE WHEN x_path_minus_gateway_ms IS NOT NULL AND {quiet_gw} THEN least(0.6e0, x_path_minus_gateway_ms / 120e0) ELSE 0e0 END",
        "remote_https": f"CASE WHEN {tunnel} THEN greatest(0e0, d_remote_https + {share} - {share} * 0.5e0) WHEN {extra} IS NOT NULL AND {quiet_path} THEN d_remote_https + {share} ELSE d_remote_https END",
        "vpn": f"d_vpn + CASE WHEN {tunnel} THEN {share} + CASE WHEN coalesce(os_retrans_rate, 0e0) >= 0.03 THEN least(0.3e0, os_retrans_rate * 3e0) ELSE 0e0 END ELSE 0e0 END",
    }
    silent = {x: f"CASE WHEN {' OR '.join(f'(coalesce({r.condition}, false) AND ({r.layer}) <> {chr(39)}{x}{chr(39)})' for r in RULES if x in r.suppresses) or 'false'} THEN 0e0 ELSE v_{x} END" for x in LAYERS}
    return [("raw", raw), ("d", damp), ("v", vote), ("a", silent)]


def attribution_stages() -> list[dict[str, str]]:
    stages = [{f"{p}_{x}": cols[x] for x in LAYERS} for p, cols in _votes(attribute_sql([]))]
    ranked = "greatest(" + ", ".join(f"a_{x}" for x in LAYERS) + ")"
    first = "CASE " + " ".join(f"WHEN a_{x} = top THEN '{x}'" for x in LAYERS) + " END"
    total = " + ".join(f"greatest(a_{x}, 0e0)" for x in LAYERS)
    second = "greatest(" + ", ".join(f"CASE WHEN lead = '{x}' THEN -1e0 ELSE a_{x} END" for x in LAYERS) + ")"
    runner = "CASE " + " ".join(f"WHEN lead <> '{x}' AND a_{x} = top2 THEN '{x}'" for x in LAYERS) + " END"
    return [*stages, {"top": ranked}, {"lead": first}, {"top2": second}, {"primary_layer": "CASE WHEN top > 0 THEN lead END", "secondary_layer": f"CASE WHEN top > 0 AND top2 > 0 AND top - top2 <= 0.15 THEN {runner} END", "confidence": f"CASE WHEN top > 0 THEN top / ({total}) ELSE 0e0 END"}]


def attribute(frames: DataFrame) -> DataFrame:
    """primary_layer, secondary_layer and confidence; a_<layer> are the layers' scores."""
    for stage in attribution_stages():
        frames = frames.withColumns({k: F.expr(v) for k, v in stage.items()})
    return frames


_TOY = {x: f"CAST((tick * {7 + 2 * k}) % 11 AS DOUBLE) / 10" for k, x in enumerate(LAYERS)}
TOY_COLUMNS = {f"l1_{x}": v for x, v in _TOY.items()} | {f"l2_{x}": f"({v}) / 2" for x, v in _TOY.items()} | {"gw_rtt_ms_15m_z": "CAST(tick % 4 AS DOUBLE)", "path_rtt_ms_15m_z": "CAST(tick % 3 AS DOUBLE)"}


def _attribution_oracle() -> str:
    sql = f"(SELECT *, {', '.join(f'{v} AS {k}' for k, v in (TOY_COLUMNS | DERIVED_SQL).items())} FROM {FRAME_SQL})"
    for stage in attribution_stages():
        sql = f"(SELECT *, {', '.join(f'{v} AS {k}' for k, v in stage.items())} FROM {sql})"
    return f"SELECT host_id, tick, primary_layer, secondary_layer, round(confidence, 6) AS confidence FROM {sql}"


@query(_attribution_oracle(), "samples_sparse")
def attribute_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derive_cross_layer(frames_of(spark, sf_dir)).withColumns({k: F.expr(v) for k, v in TOY_COLUMNS.items()})
    return attribute(f).select("host_id", "tick", "primary_layer", "secondary_layer", F.round("confidence", 6).alias("confidence"))


# ---- the learned stages ---------------------------------------------------------------------------------------------
def _climbed(spark: SparkSession, sf_dir: str, stages: tuple[str, ...], adapt: bool = False, wanted: tuple[str, ...] = ()) -> DataFrame:
    """The learned stages over the carried values of the dense view; of what they add, the `wanted` columns."""
    return L.climb(learned_frames(fixture(spark, sf_dir, "samples_dense")), LEARNED, adapt, stages, limits=[limit_of(f) for f in LEARNED], keep=["host_id", "tick", "ts"], wanted=set(wanted))


def _lanes_sql() -> str:
    """A row a frame and feature of the dense view, with the carried value: what the recursions below step through."""
    each = " UNION ALL ".join(
        f"SELECT host_id, tick, ts, '{f}' AS feature, {1 if WORSE_UP[f] else -1} AS sign, CASE WHEN ts - last_value(CASE WHEN {f} IS NOT NULL THEN ts END IGNORE NULLS) OVER w <= {limit_of(f)} THEN CAST(last_value({f} IGNORE NULLS) OVER w AS DOUBLE) END AS x, CAST(floor(ts / 3600) AS BIGINT) % 24 + 1 AS h, row_number() OVER w AS i FROM samples_dense WINDOW w AS (PARTITION BY host_id ORDER BY ts)"
        for f in LEARNED
    )
    return f"({each})"


def _l1_oracle() -> str:
    """The recursion of a feature's baseline: 24 hours (lists hn, hm, hv) and all hours (n, mu, v)."""
    zeros = "list_transform(range(24), lambda k: CAST(0 AS DOUBLE))"
    put = lambda table, value: f"list_transform(range(24), lambda k: CASE WHEN k + 1 = h THEN {value} ELSE {table}[k + 1] END)"
    rate = lambda n: f"CASE WHEN {n} > 1 THEN least(0.05, greatest(0.002, 1 / {n})) ELSE 1 END"
    moved = lambda n, m, v: (f"{n} + 1", f"{m} + ({rate(f'({n} + 1)')}) * (x - {m})", f"CASE WHEN {n} + 1 > 1 THEN (1 - ({rate(f'({n} + 1)')})) * ({v} + ({rate(f'({n} + 1)')}) * (x - {m}) * (x - {m})) ELSE {v} END")
    hour, every = moved("nh", "mh", "vh"), moved("n", "mu", "v")
    take = lambda new, old: f"CASE WHEN take THEN {new} ELSE {old} END"
    return f"""SELECT host_id, tick, ts, feature, round(smooth + {OFF_TIES}, 6) AS contribution, round(high + {OFF_TIES}, 6) AS cusum_high, CAST(high >= 4.5 AS INT) AS shifted FROM (
    WITH RECURSIVE r AS MATERIALIZED (SELECT * FROM {_lanes_sql()}),
    m AS (SELECT DISTINCT host_id, feature, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS tick, CAST(0 AS DOUBLE) AS ts, {zeros} AS hn, {zeros} AS hm, {zeros} AS hv, CAST(0 AS DOUBLE) AS n, CAST(0 AS DOUBLE) AS mu, CAST(0 AS DOUBLE) AS v, CAST(0 AS DOUBLE) AS smooth, CAST(0 AS DOUBLE) AS high, CAST(0 AS DOUBLE) AS low, CAST(0 AS DOUBLE) AS frozen FROM r
    UNION ALL SELECT host_id, feature, i, tick, ts, {take(put('hn', hour[0]), 'hn')}, {take(put('hm', hour[1]), 'hm')}, {take(put('hv', hour[2]), 'hv')}, {take(every[0], 'n')}, {take(every[1], 'mu')}, {take(every[2], 'v')}, smooth + 0.3 * (now - smooth), least(6, greatest(0, high + z - 0.5)), least(6, greatest(0, low - z - 0.5)), CASE WHEN take THEN 0 ELSE frozen + 1 END
    FROM (SELECT *, NOT (n >= 30 AND frozen < 240 AND now >= 1.5) AS take FROM (SELECT *, least(12, greatest(0, z - 1.5)) AS now FROM (
      SELECT *, CASE WHEN CASE WHEN nh >= 12 THEN nh ELSE n END < 4 THEN 0 WHEN nh >= 12 THEN sign * (x - mh) / greatest(sqrt(vh), greatest(0.25 * abs(mh), 1e-6)) ELSE sign * (x - mu) / (2.5 * greatest(sqrt(v), greatest(0.25 * abs(mu), 1e-6))) END AS z FROM (
        SELECT r.*, m.hn, m.hm, m.hv, m.hn[r.h] AS nh, m.hm[r.h] AS mh, m.hv[r.h] AS vh, m.n, m.mu, m.v, m.smooth, m.high, m.low, m.frozen FROM m JOIN r ON r.host_id = m.host_id AND r.feature = m.feature AND r.i = m.i + 1)))))
    SELECT * FROM m WHERE i > 0)"""


#: A drift check of every feature on every 60th frame; after a drift at value r the reference is the recent values, followed
#: by what falls out of them once more.
_CHECKS = f"""(WITH RECURSIVE r AS MATERIALIZED (SELECT * FROM {_lanes_sql()}),
  xs AS MATERIALIZED (SELECT host_id, feature, list(x ORDER BY i) FILTER (x IS NOT NULL) AS xs FROM r GROUP BY 1, 2),
  c AS MATERIALIZED (SELECT * FROM (SELECT host_id, feature, ts, i, count(x) OVER (PARTITION BY host_id, feature ORDER BY i) AS k FROM r) WHERE i % {L.DRIFT_EVERY} = 0),
  m AS (SELECT host_id, feature, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS ts, CAST(0 AS DOUBLE) AS last, CAST(0 AS BIGINT) AS reset_at, CAST(0 AS DOUBLE) AS psi, CAST(0 AS BIGINT) AS n_reference, CAST(0 AS BIGINT) AS n_recent, false AS drifted FROM xs
  UNION ALL SELECT host_id, feature, i, ts, CASE WHEN drifted THEN ts ELSE last END, CASE WHEN drifted THEN k ELSE reset_at END, now, CASE WHEN drifted THEN n_recent ELSE n_reference END, n_recent, drifted
  FROM (SELECT *, due AND now >= {L.DRIFT_PSI} AS drifted FROM (SELECT *, CASE WHEN due THEN list_sum(list_transform(range(len(edges) + 1), lambda j: (q(recent, edges, j) - q(reference, edges, j)) * ln(q(recent, edges, j) / q(reference, edges, j)))) ELSE psi END AS now FROM (
    SELECT *, CASE WHEN due THEN list_sort(list_distinct(list_transform(range(1, 10), lambda e: o[CAST(floor(e * (n_reference - 1) / 10) AS BIGINT) + 1] * (1 - (e * (n_reference - 1) / 10 - floor(e * (n_reference - 1) / 10))) + o[least(CAST(floor(e * (n_reference - 1) / 10) AS BIGINT) + 2, n_reference)] * (e * (n_reference - 1) / 10 - floor(e * (n_reference - 1) / 10))))) END AS edges FROM (
      SELECT *, list_sort(reference) AS o, n_reference >= {L.DRIFT_MIN} AND n_recent >= {L.DRIFT_MIN} AND ts - last >= {L.DRIFT_COOLDOWN} AS due FROM (SELECT *, len(reference) AS n_reference, len(recent) AS n_recent FROM (
        SELECT c.*, m.last, m.reset_at, m.psi, xs[greatest(1, k - {L.RECENT_SIZE - 1}) : k] AS recent,
          CASE WHEN k <= {L.RECENT_SIZE} AND m.reset_at = 0 THEN [] WHEN m.reset_at = 0 THEN xs[greatest(1, k - {L.RECENT_SIZE + L.REFERENCE_SIZE - 1}) : k - {L.RECENT_SIZE}]
          ELSE list_concat(xs[greatest(1, m.reset_at - {L.RECENT_SIZE - 1}) : m.reset_at], CASE WHEN k > {L.RECENT_SIZE} THEN xs[greatest(1, m.reset_at - {L.RECENT_SIZE - 1}) : k - {L.RECENT_SIZE}] ELSE [] END)[-{L.REFERENCE_SIZE}:] END AS reference
        FROM m JOIN c ON c.host_id = m.host_id AND c.feature = m.feature AND c.i = m.i + {L.DRIFT_EVERY} JOIN xs ON xs.host_id = c.host_id AND xs.feature = c.feature)))))))
  SELECT *, n_reference >= {L.DRIFT_MIN} AND n_recent >= {L.DRIFT_MIN} AS ready FROM m WHERE i > 0)"""
for _list in ("recent", "reference"):  # the share of a list's values between two edges
    _CHECKS = _CHECKS.replace(f"q({_list}, edges, j)", f"greatest(len(list_filter({_list}, lambda y: (j = 0 OR y > edges[j]) AND (j = len(edges) OR y <= edges[j + 1]))) / len({_list}), 1e-4)")
_DRIFT_ROWS = f"""(SELECT host_id, feature, ts, CAST(i AS INT) AS frame, round(psi + {OFF_TIES}, 6) AS psi, CAST(n_reference AS INT) AS n_reference, CAST(n_recent AS INT) AS n_recent, ready, drifted, CASE WHEN drifted THEN CASE WHEN psi >= {2 * L.DRIFT_PSI} THEN 'significant' ELSE 'moderate' END END AS severity, CASE WHEN drifted THEN 'relearn_baseline' END AS action FROM {_CHECKS})"""


@query(_l1_oracle(), "samples_dense")
def l1_observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = l1_rows(_climbed(spark, sf_dir, ("l1",), wanted=("l1", "cusum_high")))
    return rows.select("host_id", "tick", "ts", "feature", *[F.round(F.col(c) + OFF_TIES, 6).alias(c) for c in ("contribution", "cusum_high")], "shifted")


@query()
def l2_observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l2_rows(_climbed(spark, sf_dir, ("l2",), wanted=("l2_rmse", "l2_score", "l2_relative")))


@query()
def l2_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest of the layers' scores and of the net over the layers' relative errors."""
    return _climbed(spark, sf_dir, ("l2",), wanted=("l2_score", "l2_anomaly")).select("host_id", "tick", "ts", "l2_anomaly", *[F.get("l2_score", F.lit(k)).alias(f"l2_{x}") for k, x in enumerate(L.ORDER)])


@query(f"SELECT * FROM {_DRIFT_ROWS}", "samples_dense", name="drift_monitor")
def dense_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of every feature of the dense view."""
    return drift_rows(_climbed(spark, sf_dir, ("drift",), wanted=("drift_frame", "drift"))).withColumn("psi", F.round(F.col("psi") + OFF_TIES, 6))


@query(f"SELECT * FROM (SELECT host_id, feature, arg_max(psi, frame) AS psi, arg_max(n_reference, frame) AS n_reference, arg_max(n_recent, frame) AS n_recent, arg_max(ready, frame) AS ready, count(*) FILTER (WHERE drifted) AS events FROM {_DRIFT_ROWS} GROUP BY 1, 2) WHERE psi > 1e-6 OR ready", "samples_dense")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last state of each (host, feature) that is ready or has been measured."""
    last = dense_drift(spark, sf_dir).groupBy("host_id", "feature").agg(*[F.max_by(c, "frame").alias(c) for c in ("psi", "n_reference", "n_recent", "ready")], F.count_if("drifted").alias("events"))
    return last.filter("psi > 1e-6 OR ready")


@query(f"SELECT host_id, ts, feature, psi, action FROM {_DRIFT_ROWS} ORDER BY ts DESC, host_id, feature LIMIT 50", "samples_dense")
def recent_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest drift checks: ts, feature, PSI and, where a feature drifted, what follows."""
    return dense_drift(spark, sf_dir).select("host_id", "ts", "feature", "psi", "action").orderBy(F.desc("ts"), "host_id", "feature").limit(50)


@query()
def drift_adaptation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions and layer errors where what drifts is learned anew from the next frame on; `drifted` names it."""
    climbed = _climbed(spark, sf_dir, ("l1", "l2", "drift"), True, ("drift", "l1", "l2_rmse", "l2_anomaly"))
    return climbed.select("host_id", "tick", "ts", F.transform(F.filter("drift", lambda d: d["drifted"]), lambda d: d["feature"]).alias("drifted"), "l1", "l2_rmse", "l2_anomaly")


# ---- all stages in order -----------------------------------------------------------------------------------------
_NEEDED = sorted({*SPARSE, *TRENDS, "os_cpu_pct", "os_iface_type", "os_on_battery"})
_STATE = ["watched", "published"]
#: What a frame is judged by, of what the learned stages add.
_LEARNED = ["l1", "l2_score", "l2_anomaly", "drift"]


def samples_of(samples: DataFrame, have: list[str]) -> tuple[DataFrame, list[str], Callable[[], hosts.Watched]]:
    """host_id, tick, ts and all names that the stages ask for; these names; a host's first state."""
    names = sorted({*have, *_NEEDED})
    features = [f for f in names if f in MODELLED and f in have]
    rows = samples.select("host_id", "tick", "ts", *[(F.col(c) if c in have else F.lit(None)).cast("double").alias(c) for c in names])
    return rows, names, lambda: hosts.Watched(names, features, TRENDS, [limit_of(f) for f in names])


def judged(frames: DataFrame, names: list[str], features: list[str], models: dict | None) -> DataFrame:
    """What a frame tells by itself: ratios, coverage, rules, anomalies of the layers, forecast, attribution."""
    from hostvigil.operators.forecast import predict

    f = frames.withColumn("coverage", F.expr(coverage_sql(names)["coverage"]))
    pulls = [F.coalesce(F.get("l1", F.lit(k)), F.lit(0.0)) for k in range(len(features))]
    layer = lambda x: combine_all([c for c, n in zip(pulls, features) if LAYER_OF[n] == x])
    f = f.withColumns({"l1_anomaly": combine_all(pulls)} | {f"l1_{x}": layer(x) for x in LAYERS} | {f"l2_{x}": F.get("l2_score", F.lit(L.ORDER.index(x))) if x in L.ORDER else F.lit(0.0) for x in LAYERS})
    f = with_rules(derive_cross_layer(f))
    f = f.withColumns({"risk_floor": risk_floor(F.col("hits")), "worst": F.coalesce(worst_hit(F.col("hits"))["rank"], F.lit(-1)), "rules": F.transform("hits", lambda h: h["rule"]), "drifted": F.transform(F.filter("drift", lambda d: d["drifted"]), lambda d: d["feature"])})
    f = attribute(f.withColumns(predict(f, models or {})))
    f = f.withColumn("evidence", evidence(F.col("primary_layer"), F.col("hits"), features, pulls))
    return f.drop("hits", "drift", "l1", "cusum_high", "l2_rmse", "l2_score", "l2_relative", "drift_frame")


def carded(frames: DataFrame) -> DataFrame:
    """The result of scoring: severity, and the card of a frame that has something to tell."""
    shown = (F.col("coverage") >= BLIND_BELOW) & F.col("primary_layer").isNotNull() & (F.col("rank") >= 1)
    f = cards(frames, "primary_layer")
    card = [F.when(shown, F.col(c)).alias(c) for c in ("template_id", "title", "summary", "evidence", "remediation")]
    layers = F.create_map(*[x for n in LAYERS for x in (F.lit(n), F.round(f"a_{n}", 6))]).alias("layer_scores")
    kept = [F.col(c) for c in _STATE if c in frames.columns]
    return f.select("host_id", "tick", "ts", "health", "risk_5m", "risk_15m", severity_name(F.col("rank")).alias("severity"), "l1_anomaly", "l2_anomaly", "primary_layer", "secondary_layer", F.round("confidence", 3).alias("confidence"), layers, "warming_up", "coverage", "rules", *card, "drifted", "opened", "closed", "incident", "rises", *kept)


def _fresh(rows: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return rows.column("ts").to_numpy(), np.stack([rows.column(f"fresh_{c}").to_numpy(zero_copy_only=False).astype(float) for c in names], 1)


def _packed(rows: pa.RecordBatch, names: list[str], measured: list[str]) -> tuple[np.ndarray, np.ndarray]:
    x = np.full((len(rows), len(names)), np.nan)
    if measured:
        x[:, [names.index(n) for n in measured]] = rows.column("packed").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    return rows.column("ts").to_numpy(), x


def _publish(state: hosts.Published, rows: pa.RecordBatch) -> list[pa.Array]:
    return state.step([rows.column(c).to_pylist() for c in state.INPUT])


def judged_frames(samples: DataFrame, have: list[str], models: dict | None = None, state: DataFrame | None = None) -> DataFrame:
    """Every frame with its carried and rolling values, anomalies, rules, forecast and attribution: all that comes before
    the smoothing of risks. A host's frames are in one partition."""
    rows, names, start = samples_of(samples, have)
    features = start().features
    if state is not None:
        rows = L.by_host(rows.withColumnsRenamed({c: f"fresh_{c}" for c in names}).unionByName(state.select("host_id", *_STATE), allowMissingColumns=True))
        f = L.scan(rows, start, lambda s, r: s.step(*_fresh(r, names)), hosts.Watched.added(names, TRENDS), True, ["host_id", "tick", "ts", *_STATE], _STATE[0])
    else:
        kept = ["host_id", "tick", "ts"]
        measured = [n for n in names if n in have]
        rows = L.climb(rows.select(*kept, *measured), features, limits=[limit_of(f) for f in features], keep=kept, wanted=set(_LEARNED), packed=measured).select(*kept, "packed", *_LEARNED)
        f = L.scan(rows, start, lambda s, r: s.trail(*_packed(r, names, measured))[1], hosts.Watched.trailed(names, TRENDS), True, [*kept, *_LEARNED], ordered=True)
    return judged(f, names, features, models)


def _scored(samples: DataFrame, have: list[str], models: dict | None, state: DataFrame | None = None) -> DataFrame:
    f = judged_frames(samples, have, models, state).withColumn("known", F.col("primary_layer").isNotNull())
    return carded(L.scan(f, hosts.Published, _publish, hosts.Published.ADDED, True, None, None if state is None else _STATE[1], state is None))


def score_frames(samples: DataFrame, have: list[str], models: dict | None = None) -> DataFrame:
    """Scores, severity, health, attribution, cards, incidents and drift of every frame of sparse samples.

    Stages: carried and rolling values and the learned stages with their adaptation to drift (one scan), rules, forecast
    (`models` by horizon, else the heuristic), attribution, then its smoothing, severity and incident (a second scan), card.
    All scans read each host in order of time; the frames pass through them whole, so nothing is joined back.
    """
    return _scored(samples, have, models)


def score_slice(samples: DataFrame, have: list[str], state: DataFrame | None = None, models: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """`score_frames` for the next samples of some hosts, and the hosts' states after them (host_id, watched, published).

    `state` is what an earlier call gave back; a host that isn't in it starts anew, one without samples keeps its state, and
    samples up to the last one that a host's state has seen are left out. So new samples cost no replay of old ones, and a
    long history can be scored slice by slice: the rows are those of one run. A state of other names or features is refused.
    """
    spark = samples.sparkSession
    known = state if state is not None else spark.createDataFrame([], "host_id long, watched binary, published binary")
    out = materialize(_scored(samples, have, models, known))
    return out.filter("ts IS NOT NULL").drop(*_STATE), out.filter("ts IS NULL").select("host_id", *_STATE)


@query(name="score_frames")
def _score_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_frames(fixture(spark, sf_dir, "samples_dense"), DENSE)


@query()
def scored_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incidents of score_frames, each with its card as of the last escalation."""
    scores = score_frames(fixture(spark, sf_dir, "samples_sparse"), SPARSE)
    return incident_table(scores.withColumns({"blind": F.col("coverage") < BLIND_BELOW, "risk": F.col("risk_15m"), "rank": F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), F.col("severity")).cast("int") - 1}))
