"""Dense frames from sparse samples: carry-forward, rolling statistics, ratios, coverage, rules, severity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostvigil.catalogue import LAYER_OF, LAYERS, MODELLED, RULES, SEVERITIES, STALENESS
from hostvigil.operators.ladder import scan
from hostvigil.operators.trailing import Trailing
from hostvigil.registry import query
from hostvigil.sources.fixtures import fixture

#: The features that the sparse test view has.
SPARSE = ["gw_rtt_ms", "gw_jitter_ms", "gw_loss_rate", "dns_p50_ms", "dns_fail_rate", "https_ttfb_ms", "https_tcp_ms", "https_tls_ms", "https_fail_rate", "path_rtt_ms", "os_retrans_rate", "wifi_rssi_dbm", "wifi_tx_retry_rate", "wifi_link_mbps", "captive_portal", "vpn_active"]


def limit_of(feature: str) -> int:
    return STALENESS.get(LAYER_OF.get(feature, ""), 180)


def carry_forward(samples: DataFrame, features: list[str]) -> DataFrame:
    """Each feature's last value while it is no older than its layer's staleness; the fresh one stays as fresh_<name>."""
    until_now = Window.partitionBy("host_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = {f"fresh_{f}": F.col(f).cast("double") for f in features}
    for f in features:
        at = F.last(F.when(F.col(f).isNotNull(), F.col("ts")), ignorenulls=True).over(until_now)
        out[f] = F.when(F.col("ts") - at <= limit_of(f), F.last(F.col(f).cast("double"), ignorenulls=True).over(until_now))
    return samples.withColumns(out)


def rolling(frames: DataFrame, features: list[str], widths: tuple[tuple[str, int], ...] = (("1m", 60), ("5m", 300), ("15m", 900))) -> DataFrame:
    """<f>_{1m,5m,15m}_{n,mean,std}, _{5m,15m}_{slope,z} from the fresh values, while a carried value exists.

    One scan of a host's frames in order of time (see `trailing`), whatever the number of features and widths.
    """
    names = [(f, f"{w}_{k}") for f in features for w, seconds in widths for k in ("n", "mean", "std", "slope", "z")[: 3 if seconds <= 60 else 5]]
    place = {f: i for i, f in enumerate(features)}

    def step(state: Trailing, rows: pa.RecordBatch) -> list[pa.Array]:
        table = lambda prefix: np.stack([rows.column(f"{prefix}{f}").to_numpy(zero_copy_only=False).astype(float) for f in features], 1)
        got = state.roll(rows.column("ts").to_numpy(), table("fresh_"), table(""))
        return [pa.array(got[k][:, place[f]], pa.float64(), from_pandas=True) for f, k in names]

    return scan(frames, lambda: Trailing([], len(features), widths), step, [T.StructField(f"{f}_{k}", T.DoubleType()) for f, k in names])


# The ratios between layers, in SQL that both engines read.
DERIVED_SQL = {
    "x_remote_over_gateway": "CASE WHEN https_ttfb_ms IS NOT NULL AND gw_rtt_ms IS NOT NULL THEN https_ttfb_ms / greatest(gw_rtt_ms, 1e0) END",
    "x_path_minus_gateway_ms": "CASE WHEN path_rtt_ms IS NOT NULL AND gw_rtt_ms IS NOT NULL THEN greatest(0e0, path_rtt_ms - gw_rtt_ms) END",
    "x_remote_minus_path_ms": "CASE WHEN https_ttfb_ms IS NOT NULL AND path_rtt_ms IS NOT NULL THEN greatest(0e0, https_ttfb_ms - path_rtt_ms) END",
    "x_dns_share": "CASE WHEN dns_p50_ms IS NOT NULL AND https_ttfb_ms IS NOT NULL THEN dns_p50_ms / greatest(dns_p50_ms + https_ttfb_ms, 1e0) END",
    "x_tls_share": "CASE WHEN https_tcp_ms + https_tls_ms > 0 THEN https_tls_ms / (https_tcp_ms + https_tls_ms) END",
    "x_wifi_weakness": "CASE WHEN wifi_rssi_dbm IS NOT NULL THEN least(1e0, greatest(0e0, (-wifi_rssi_dbm - 40e0) / 50e0)) END",
    "x_wifi_pressure": "CASE WHEN wifi_rssi_dbm IS NOT NULL AND wifi_tx_retry_rate IS NOT NULL THEN least(1e0, greatest(0e0, (-wifi_rssi_dbm - 40e0) / 50e0)) * 0.5e0 + wifi_tx_retry_rate * 0.5e0 END",
    "x_link_headroom": "CASE WHEN wifi_link_mbps > 0 THEN least(1e0, wifi_link_mbps / 300e0) END",
    "x_failure_pressure": "greatest(gw_loss_rate, dns_fail_rate, https_fail_rate)",
    "x_failure_breadth": "CASE WHEN coalesce(gw_loss_rate, dns_fail_rate, https_fail_rate) IS NOT NULL THEN CAST((CASE WHEN gw_loss_rate > 0.1 THEN 1 ELSE 0 END + CASE WHEN dns_fail_rate > 0.1 THEN 1 ELSE 0 END + CASE WHEN https_fail_rate > 0.1 THEN 1 ELSE 0 END) AS DOUBLE) / (CASE WHEN gw_loss_rate IS NULL THEN 0 ELSE 1 END + CASE WHEN dns_fail_rate IS NULL THEN 0 ELSE 1 END + CASE WHEN https_fail_rate IS NULL THEN 0 ELSE 1 END) END",
}


def derive_cross_layer(frames: DataFrame) -> DataFrame:
    return frames.withColumns({k: F.expr(v) for k, v in DERIVED_SQL.items()})


def _present(features: list[str], have: list[str]) -> str:
    terms = [f"CASE WHEN {f} IS NULL THEN 0 ELSE 1 END" for f in features if f in have]
    return f"(({' + '.join(terms) or '0'}) / {len(features)}e0)"


def coverage_sql(have: list[str]) -> dict[str, str]:
    """Share of the modelled features present, over all and per layer."""
    out = {"coverage": _present(MODELLED, have)}
    for layer in LAYERS:
        out[f"coverage_{layer}"] = _present([f for f in MODELLED if LAYER_OF[f] == layer], have)
    return out


def with_rules(frames: DataFrame) -> DataFrame:
    """`hits`: array of (rule, layer, severity, rank, floor, suppresses), in the order of the rules."""
    hit = [
        F.when(
            F.expr(r.condition),
            F.struct(F.lit(r.id).alias("rule"), F.expr(r.layer).alias("layer"), F.lit(r.severity).alias("severity"), F.lit(SEVERITIES.index(r.severity)).alias("rank"), F.lit(float(r.floor)).alias("floor"), F.array(*[F.lit(x) for x in r.suppresses]).cast("array<string>").alias("suppresses")),
        )
        for r in RULES
    ]
    return frames.withColumn("hits", F.array_compact(F.array(*hit)))


def suppressed(hits: Column) -> Column:
    """Layers that some hit silences; its own layer is exempt."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.array_remove(h["suppresses"], h["layer"]))))


def risk_floor(hits: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(hits, lambda h: h["floor"])), F.lit(0.0))


def worst_hit(hits: Column) -> Column:
    """Highest severity, then floor; the first of equals."""
    start = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(-1).alias("rank"), F.lit(-1.0).alias("floor"))
    better = lambda a, h: (h["rank"] > a["rank"]) | ((h["rank"] == a["rank"]) & (h["floor"] > a["floor"]))
    return F.aggregate(hits, start, lambda a, h: F.when(better(a, h), F.struct(h["rule"].alias("rule"), h["rank"].alias("rank"), h["floor"].alias("floor"))).otherwise(a))


def band_rank(p: Column) -> Column:
    """0 info, 1 watch, 2 risk, 3 critical."""
    return F.when(p >= 0.75, 3).when(p >= 0.5, 2).when(p >= 0.25, 1).otherwise(0)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def frames_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carry_forward(fixture(spark, sf_dir, "samples_sparse"), SPARSE)


# ---- oracle text -------------------------------------------------------------------------------------------------
_CARRY = ", ".join(
    f"CASE WHEN ts - last_value(CASE WHEN {f} IS NOT NULL THEN ts END IGNORE NULLS) OVER w <= {limit_of(f)} THEN CAST(last_value({f} IGNORE NULLS) OVER w AS DOUBLE) END AS {f}, CAST({f} AS DOUBLE) AS fresh_{f}" for f in SPARSE
)
FRAME_SQL = f"(SELECT host_id, tick, ts, {_CARRY} FROM samples_sparse WINDOW w AS (PARTITION BY host_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
_HIT_SQL = {r.id: f"coalesce({r.condition}, false)" for r in RULES}
_R6 = lambda names: [F.round(n, 6).alias(n) for n in names]
#: Added before rounding in checks, so that values with few binary digits do not lie on a rounding edge.
OFF_TIES = 1.37e-8
_ROLL = ["gw_rtt_ms", "dns_p50_ms", "https_ttfb_ms"]


@query(f"SELECT host_id, tick, {', '.join(f'round({f}, 6) AS {f}' for f in SPARSE)} FROM {FRAME_SQL}", "samples_sparse", name="carry_forward")
def _carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_of(spark, sf_dir).select("host_id", "tick", *_R6(SPARSE))


def _rolling_query(columns: dict[str, str], name: str) -> None:
    """columns: result -> DuckDB expression over windows w60, w300, w900 of FRAME_SQL."""
    windows = ", ".join(f"w{s} AS (PARTITION BY host_id ORDER BY ts RANGE BETWEEN {s} PRECEDING AND CURRENT ROW)" for s in (60, 300, 900))
    sql = f"SELECT host_id, tick, {', '.join(f'round({x} + {OFF_TIES}, 6) AS {c}' for c, x in columns.items())} FROM (SELECT *, (ts - min(ts) OVER (PARTITION BY host_id)) / 60.0 AS minute FROM {FRAME_SQL}) WINDOW {windows}"

    @query(sql, "samples_sparse", name=name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rolling(frames_of(spark, sf_dir), _ROLL).select("host_id", "tick", *[F.round(F.col(c) + OFF_TIES, 6).alias(c) for c in columns])


_S = (("1m", 60), ("5m", 300), ("15m", 900))
_ALIVE = "CASE WHEN {f} IS NOT NULL AND count(fresh_{f}) OVER w{s} > 0 THEN {x} END"
_rolling_query({f"{f}_{n}_{k}": _ALIVE.format(f=f, s=s, x=x.format(f=f, s=s)) for f in _ROLL for n, s in _S for k, x in (("mean", "avg(fresh_{f}) OVER w{s}"), ("std", "coalesce(stddev_samp(fresh_{f}) OVER w{s}, 0)"))}, "rolling_mean_std")
_T = "CASE WHEN fresh_{f} IS NOT NULL THEN minute END"
_rolling_query(
    {f"{f}_{n}_slope": _ALIVE.format(f=f, s=s, x=f"CASE WHEN count(fresh_{f}) OVER w{s} >= 3 AND var_pop({_T.format(f=f)}) OVER w{s} * count(fresh_{f}) OVER w{s} > 1e-9 THEN covar_pop(fresh_{f}, minute) OVER w{s} / var_pop({_T.format(f=f)}) OVER w{s} ELSE 0 END") for f in _ROLL for n, s in _S[1:]},
    "rolling_slope",
)
_rolling_query(
    {f"{f}_{n}_z": _ALIVE.format(f=f, s=s, x=f"CASE WHEN count(fresh_{f}) OVER w{s} >= 4 THEN ({f} - avg(fresh_{f}) OVER w{s}) / greatest(coalesce(stddev_samp(fresh_{f}) OVER w{s}, 0), 1e-6, abs(avg(fresh_{f}) OVER w{s}) * 0.02) ELSE 0 END") for f in _ROLL for n, s in _S[1:]},
    "rolling_z",
)


@query(f"SELECT host_id, tick, {', '.join(f'round({x}, 6) AS {c}' for c, x in DERIVED_SQL.items())} FROM {FRAME_SQL}", "samples_sparse", name="derive_cross_layer")
def _derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_cross_layer(frames_of(spark, sf_dir)).select("host_id", "tick", *_R6(DERIVED_SQL))


@query(f"SELECT host_id, tick, {', '.join(f'round({x}, 6) AS {c}' for c, x in coverage_sql(SPARSE).items())} FROM {FRAME_SQL}", "samples_sparse", name="coverage")
def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_of(spark, sf_dir).select("host_id", "tick", *[F.round(F.expr(x), 6).alias(c) for c, x in coverage_sql(SPARSE).items()])


@query("SELECT host_id, tick, CAST((CAST(ts AS BIGINT) // 3600) % 24 AS INT) AS hour_of_day, CAST((CAST(ts AS BIGINT) // 86400 + 3) % 7 AS INT) AS day_of_week FROM samples_sparse", "samples_sparse")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_seconds("ts")
    return fixture(spark, sf_dir, "samples_sparse").select("host_id", "tick", F.hour(at).alias("hour_of_day"), F.weekday(at).alias("day_of_week"))


@query(f"SELECT host_id, tick, concat_ws(',', {', '.join(f'''CASE WHEN {c} THEN '{k}' END''' for k, c in _HIT_SQL.items())}) AS rules FROM {FRAME_SQL}", "samples_sparse")
def l0_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rules(frames_of(spark, sf_dir)).select("host_id", "tick", F.array_join(F.transform("hits", lambda h: h["rule"]), ",").alias("rules"))


def _silenced(layer: str) -> str:
    by = [f"({_HIT_SQL[r.id]} AND ({r.layer}) <> '{layer}')" for r in RULES if layer in r.suppresses]
    return " OR ".join(by) or "false"


@query(f"SELECT host_id, tick, concat_ws(',', {', '.join(f'''CASE WHEN {_silenced(x)} THEN '{x}' END''' for x in sorted(LAYERS))}) AS layers FROM {FRAME_SQL}", "samples_sparse")
def suppressed_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rules(frames_of(spark, sf_dir)).select("host_id", "tick", F.array_join(F.array_sort(suppressed(F.col("hits"))), ",").alias("layers"))


_FLOOR = f"greatest(0.0, {', '.join(f'CASE WHEN {_HIT_SQL[r.id]} THEN {r.floor} ELSE 0.0 END' for r in RULES)})"
_RANK = f"greatest(-1, {', '.join(f'CASE WHEN {_HIT_SQL[r.id]} THEN {SEVERITIES.index(r.severity)} ELSE -1 END' for r in RULES)})"
_WORST = " ".join(f"WHEN {_HIT_SQL[r.id]} THEN '{r.id}'" for r in sorted(RULES, key=lambda r: (-SEVERITIES.index(r.severity), -r.floor)))


@query(f"SELECT host_id, tick, CAST({_FLOOR} AS DOUBLE) AS floor FROM {FRAME_SQL}", "samples_sparse", name="risk_floor")
def _risk_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rules(frames_of(spark, sf_dir)).select("host_id", "tick", risk_floor(F.col("hits")).alias("floor"))


@query(f"SELECT host_id, tick, CASE {_WORST} END AS rule FROM {FRAME_SQL}", "samples_sparse", name="worst_hit")
def _worst_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rules(frames_of(spark, sf_dir)).select("host_id", "tick", worst_hit(F.col("hits"))["rule"].alias("rule"))


_BAND = "CASE WHEN p >= 0.75 THEN 3 WHEN p >= 0.5 THEN 2 WHEN p >= 0.25 THEN 1 ELSE 0 END"
_NAME = "['info', 'watch', 'risk', 'critical'][{} + 1]"


@query(f"SELECT host_id, tick, {_NAME.format(f'greatest({_BAND}, r)')} AS severity FROM (SELECT host_id, tick, coalesce(gw_loss_rate, 0) AS p, {_RANK} AS r FROM {FRAME_SQL})", "samples_sparse")
def severity_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = with_rules(frames_of(spark, sf_dir))
    rank = F.greatest(band_rank(F.coalesce("gw_loss_rate", F.lit(0.0))), worst_hit(F.col("hits"))["rank"])
    return f.select("host_id", "tick", severity_name(rank).alias("severity"))


@query(f"SELECT host_id, tick, CAST(row_number() OVER (PARTITION BY host_id ORDER BY ts) < 120 AS INT) AS warming_up FROM samples_dense", "samples_dense")
def warm_up_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("host_id").orderBy("ts"))
    return fixture(spark, sf_dir, "samples_dense").select("host_id", "tick", (n < 120).cast("int").alias("warming_up"))
