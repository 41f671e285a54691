"""Views over the driver's tables that stand for telemetry; one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIXTURES: dict[str, str] = {
    "samples_sparse": """
WITH e AS (
  SELECT user_id % 16 AS host_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
         CAST(row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS BIGINT) AS tick
  FROM events)
SELECT host_id, tick, CAST(1704067200 + 15 * tick AS DOUBLE) AS ts,
  CASE WHEN event_type = 'click'    THEN value END               AS gw_rtt_ms,
  CASE WHEN event_type = 'click'    THEN value / 10 END          AS gw_jitter_ms,
  CASE WHEN event_type = 'click'    THEN k / 99 END              AS gw_loss_rate,
  CASE WHEN event_type = 'view'     THEN value END               AS dns_p50_ms,
  CASE WHEN event_type = 'view'     THEN k / 99 END              AS dns_fail_rate,
  CASE WHEN event_type = 'purchase' THEN value * 3 END           AS https_ttfb_ms,
  CASE WHEN event_type = 'purchase' THEN value END               AS https_tcp_ms,
  CASE WHEN event_type = 'purchase' THEN value * 1.5 END         AS https_tls_ms,
  CASE WHEN event_type = 'purchase' THEN k / 99 END              AS https_fail_rate,
  CASE WHEN event_type = 'error'    THEN value * 2 END           AS path_rtt_ms,
  CASE WHEN event_type = 'error'    THEN k / 990 END             AS os_retrans_rate,
  CASE WHEN event_type = 'signup'   THEN -40 - k * 0.5 END       AS wifi_rssi_dbm,
  CASE WHEN event_type = 'signup'   THEN least(value / 200, 1.0) END AS wifi_tx_retry_rate,
  CASE WHEN event_type = 'signup'   THEN 6 + k * 3 END           AS wifi_link_mbps,
  CASE WHEN event_type = 'signup' AND k = 0 THEN 1.0 END         AS captive_portal,
  CASE WHEN event_type = 'error' AND host_id % 4 = 0 THEN 1.0 END AS vpn_active
FROM e
""",
    "samples_dense": """
WITH l AS (
  SELECT l_suppkey % 16 AS host_id, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t,
         CAST(row_number() OVER (PARTITION BY l_suppkey % 16
           ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS tick
  FROM lineitem)
SELECT host_id, tick, CAST(1704067200 + 15 * tick AS DOUBLE) AS ts,
  q / 10 AS gw_rtt_ms, q / 100 AS gw_jitter_ms, d AS gw_loss_rate,
  p / 2000 AS dns_p50_ms, p / 1000 AS dns_p95_ms, t AS dns_fail_rate,
  p / 1000 AS https_ttfb_ms, q AS https_tcp_ms, q * 1.2 AS https_tls_ms,
  p / 800 AS https_total_ms, t AS https_fail_rate, p / 4000 AS path_rtt_ms,
  -45 - q * 0.3 AS wifi_rssi_dbm, d AS wifi_tx_retry_rate, 300 - q AS wifi_link_mbps,
  q + 20 AS os_cpu_pct, t / 10 AS os_retrans_rate
FROM l
""",
    "bad_windows": """
WITH e AS (
  SELECT user_id % 16 AS host_id,
         CAST(row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS BIGINT) AS tick
  FROM events)
SELECT host_id, CAST(floor(tick / 200.0) AS BIGINT) AS window_id,
       min(CAST(1704067200 + 15 * tick AS DOUBLE)) AS start_ts,
       max(CAST(1704067200 + 15 * tick AS DOUBLE)) AS end_ts
FROM e WHERE tick % 200 BETWEEN 100 AND 159
GROUP BY host_id, CAST(floor(tick / 200.0) AS BIGINT)
""",
    "score_series": """
WITH e AS (
  SELECT user_id % 16 AS host_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
         CAST(row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS BIGINT) AS tick
  FROM events)
SELECT host_id, tick, CAST(1704067200 + 15 * tick AS DOUBLE) AS ts,
  least(value / 250, 1.0) AS l1_anomaly, k / 99 AS l2_anomaly,
  CASE WHEN tick % 60 >= 30 THEN 0.5 + k / 200 ELSE k / 300 END AS risk_raw,
  CASE WHEN k >= 97 THEN 0.9 ELSE 0.0 END AS risk_floor,
  CASE WHEN k = 50 THEN 0.1 ELSE 0.8 END AS coverage,
  CASE event_type WHEN 'click' THEN 'gateway' WHEN 'view' THEN 'dns' WHEN 'purchase' THEN 'remote_https'
       WHEN 'error' THEN 'path' ELSE 'wifi' END AS primary_layer,
  CAST(CASE WHEN k >= 60 THEN 1 ELSE 0 END AS DOUBLE) AS outcome
FROM e
""",
    "probe_log": """
SELECT e.event_id AS probe_id, e.user_id % 16 AS host_id, e.event_type AS collector,
       concat('target-', CAST(e.user_id % 50 AS VARCHAR(20))) AS target,
       CAST(regexp_extract(e.props, '([0-9]+)', 1) AS DOUBLE) < 80 AS ok,
       e.value AS duration_ms, d.text AS detail, e.ts AS ts
FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id % 200
""",
    "counters": """
WITH l AS (
  SELECT l_suppkey % 16 AS host_id, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS n,
         CAST(row_number() OVER (PARTITION BY l_suppkey % 16
           ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS tick
  FROM lineitem)
SELECT host_id, tick,
  sum(q * 10) OVER w AS packets_recv, sum(q * 8) OVER w AS packets_sent,
  sum(n) OVER w AS dropin, sum(n % 3) OVER w AS dropout, sum(n % 2) OVER w AS errout
FROM l
WINDOW w AS (PARTITION BY host_id, CAST(floor(tick / 500.0) AS BIGINT) ORDER BY tick
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""",
    "traces": """
SELECT o_custkey % 16 AS host_id, l_orderkey AS trace_id, o_orderdate AS ts,
       CAST(row_number() OVER (PARTITION BY l_orderkey
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS BIGINT) AS hop_index,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS rtt_ms,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE concat('10.0.', CAST(l_suppkey % 8 AS VARCHAR(8)), '.', CAST(l_linenumber AS VARCHAR(8))) END AS address
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
""",
}
TABLES = {"samples_sparse": ["events"], "samples_dense": ["lineitem"], "bad_windows": ["events"], "score_series": ["events"], "probe_log": ["events", "documents"], "counters": ["lineitem"], "traces": ["lineitem", "orders"]}


#: Bytes of text that may be broadcast.
FEW_BYTES = 32 << 20


def probe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that probes tell: they go to every task unless their texts are long."""
    few = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id > -200 AND doc_id < 200").select("doc_id", "text")  # what a remainder by 200 can be
    size = few.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    return F.broadcast(few) if size <= FEW_BYTES else few


def fixture(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """The view as a DataFrame; tables that are `given` aren't read."""
    text = FIXTURES[name]
    for t in TABLES[name]:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {t} ", f"{word} {{{t}}} ").replace(f"{word} {t}\n", f"{word} {{{t}}}\n").replace(f"{word} {t})", f"{word} {{{t}}})")
    if name == "probe_log" and "documents" not in given:
        given["documents"] = probe_texts(spark, sf_dir)
    return spark.sql(text, **{t: given[t] if t in given else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]})


def probes_and_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """`probe_log` in two parts, to deal its rows before they get their texts: without `detail`, and `_key` with detail,
    which stands beside the rows whose probe_id has this remainder by 200."""
    texts = probe_texts(spark, sf_dir)
    bare = fixture(spark, sf_dir, "probe_log", documents=spark.createDataFrame([], texts.schema)).drop("detail")
    return bare, texts.select(F.col("doc_id").alias("_key"), F.col("text").alias("detail"))
