"""Reading, writing, checking and merging samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostvigil.catalogue import FEATURES, NAMES, samples_schema
from hostvigil.registry import query
from hostvigil.sources import store
from hostvigil.sources.fixtures import fixture
from hostvigil.sources.scratch import scratch_path


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Samples from JSON lines: unknown keys are ignored, absent ones are null."""
    return spark.read.schema(samples_schema()).json(path)


def write_jsonl(samples: DataFrame, path: str) -> None:
    """Samples as JSON lines without their null fields."""
    samples.write.option("ignoreNullFields", "true").json(path)


def upsert(samples: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The last arrival of each key."""
    last = Window.partitionBy(*keys).orderBy(F.col(arrival).desc())
    return samples.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def validate(observations: DataFrame) -> DataFrame:
    """host_id, ts, feature, value of known features with finite numbers, clamped to the catalogue's range.

    `value` may be text; what is no number, not finite or of an unknown feature is rejected.
    """
    spark = observations.sparkSession
    dim = spark.createDataFrame([(f[0], f[5], f[6]) for f in FEATURES], "feature string, clip_min double, clip_max double")
    number = observations.withColumn("value", F.expr("try_cast(value AS double)"))
    finite = number.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    known = finite.join(F.broadcast(dim), "feature")  # 39 rows
    return known.select("host_id", "ts", "feature", F.least(F.greatest("value", "clip_min"), "clip_max").alias("value"))


def assemble(observations: DataFrame, features: list[str], seconds: int = 60) -> DataFrame:
    """One sparse sample per host and tick of `seconds`: the last value of each feature that arrived in it."""
    tick = (F.floor(F.col("ts") / seconds) * seconds).cast("double").alias("tick_ts")
    return observations.groupBy("host_id", tick).pivot("feature", features).agg(F.max_by("value", "arrival"))


def long_form(samples: DataFrame, features: list[str]) -> DataFrame:
    """host_id, tick, ts, feature, value of the values that are there."""
    return samples.unpivot(["host_id", "tick", "ts"], features, "feature", "value").filter("value IS NOT NULL")


_SHOWN = ["gw_rtt_ms", "dns_p50_ms", "https_ttfb_ms", "path_rtt_ms", "wifi_rssi_dbm", "captive_portal"]
_LONG = " UNION ALL ".join(f"SELECT host_id, tick, ts, '{f}' AS feature, {f} AS value FROM samples_sparse WHERE {f} IS NOT NULL" for f in _SHOWN)


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "samples-jsonl")
    write_jsonl(fixture(spark, sf_dir, "samples_sparse"), path)
    return read_jsonl(spark, path)


@query(f"SELECT host_id, ts, {', '.join(f'round({f}, 6) AS {f}' for f in _SHOWN)} FROM samples_sparse", "samples_sparse")
def scan_samples_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir).select("host_id", "ts", *[F.round(f, 6).alias(f) for f in _SHOWN])


@query("SELECT host_id, count(*) AS n, count(gw_rtt_ms) AS n_gw, count(dns_p50_ms) AS n_dns, count(captive_portal) AS n_portal, CAST(0 AS BIGINT) AS n_cpu FROM samples_sparse GROUP BY host_id", "samples_sparse")
def sink_samples_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c, name: F.count(c).alias(name)
    return _round_trip(spark, sf_dir).groupBy("host_id").agg(F.count("*").alias("n"), n("gw_rtt_ms", "n_gw"), n("dns_p50_ms", "n_dns"), n("captive_portal", "n_portal"), n("os_cpu_pct", "n_cpu"))


@query("SELECT host_id, ts, round(gw_rtt_ms, 6) AS gw_rtt_ms FROM (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY ts DESC) AS n FROM samples_sparse) WHERE n <= 20", "samples_sparse")
def scan_recent_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 samples of each host, oldest first."""
    newest = Window.partitionBy("host_id").orderBy(F.desc("ts"))
    rows = fixture(spark, sf_dir, "samples_sparse").withColumn("n", F.row_number().over(newest)).filter("n <= 20")
    return rows.orderBy("host_id", "ts").select("host_id", "ts", F.round("gw_rtt_ms", 6).alias("gw_rtt_ms"))


@query("SELECT host_id, ts, round(risk_raw, 6) AS risk_raw FROM score_series WHERE ts >= 1704072000 ORDER BY ts, host_id LIMIT 500", "score_series")
def scan_scores_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = fixture(spark, sf_dir, "score_series").filter("ts >= 1704072000")
    return scores.orderBy("ts", "host_id").limit(500).select("host_id", "ts", F.round("risk_raw", 6).alias("risk_raw"))


@query("SELECT host_id, ts, CASE WHEN tick % 5 = 0 THEN round(gw_rtt_ms + 1, 6) ELSE round(gw_rtt_ms, 6) END AS gw_rtt_ms, CAST(CASE WHEN tick % 5 = 0 THEN tick + 1000000 ELSE tick END AS BIGINT) AS arrival FROM samples_sparse", "samples_sparse")
def upsert_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = fixture(spark, sf_dir, "samples_sparse").select("host_id", "ts", "tick", "gw_rtt_ms", F.col("tick").cast("long").alias("arrival"))
    again = first.filter("tick % 5 = 0").withColumns({"gw_rtt_ms": F.col("gw_rtt_ms") + 1, "arrival": F.col("arrival") + 1_000_000})
    path = scratch_path(spark, "upserted")
    for rows in (first, again):  # what comes again replaces what is stored
        store.put(rows, path, ["host_id", "ts"], "arrival")
    return store.read(spark, path).select("host_id", "ts", F.round("gw_rtt_ms", 6).alias("gw_rtt_ms"), "arrival")


@query(
    f"SELECT host_id, CAST(floor(ts / 60) * 60 AS DOUBLE) AS tick_ts, {', '.join(f'''round(arg_max(value, tick) FILTER (WHERE feature = '{f}'), 6) AS {f}''' for f in _SHOWN)} FROM ({_LONG}) GROUP BY 1, 2",
    "samples_sparse",
)
def assemble_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long_form(fixture(spark, sf_dir, "samples_sparse"), _SHOWN).withColumn("arrival", F.col("tick"))
    return assemble(rows, _SHOWN).select("host_id", "tick_ts", *[F.round(f, 6).alias(f) for f in _SHOWN])


_CLIP = " ".join(f"WHEN feature = '{f[0]}' THEN least(greatest(v, {f[5]}), {f[6]})" for f in FEATURES if f[5] is not None)


@query(
    f"""SELECT host_id, ts, feature, round(CASE {_CLIP} ELSE v END, 6) AS value FROM (
      SELECT host_id, ts, CASE WHEN tick % 83 = 0 THEN 'no_such' ELSE feature END AS feature, TRY_CAST(CASE WHEN tick % 97 = 0 THEN 'NaN' WHEN tick % 89 = 0 THEN 'n/a' ELSE CAST(value * 1.5 AS VARCHAR) END AS DOUBLE) AS v FROM ({_LONG}))
    WHERE v IS NOT NULL AND NOT isnan(v) AND feature <> 'no_such'""",
    "samples_sparse",
)
def validate_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long_form(fixture(spark, sf_dir, "samples_sparse"), _SHOWN)
    broken = F.expr("CASE WHEN tick % 97 = 0 THEN 'NaN' WHEN tick % 89 = 0 THEN 'n/a' ELSE CAST(value * 1.5 AS STRING) END")
    rows = rows.select("host_id", "ts", F.when(F.col("tick") % 83 == 0, "no_such").otherwise(F.col("feature")).alias("feature"), broken.alias("value"))
    return validate(rows).withColumn("value", F.round("value", 6))
