"""Queries over probe bursts, traces, counters and tool output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostvigil.functions.privacy import hash_to_number
from hostvigil.plans.tables import _SALT, _hmac_sql
from hostvigil.registry import query, sql_query
from hostvigil.sources.fixtures import fixture

TIMEOUT_MS = 2000.0


def nearest_rank(sorted_values: Column, q: float) -> Column:
    """sorted[round half even(q * (n - 1))]; null for an empty array."""
    n = F.size(sorted_values)
    return F.when(n > 0, F.get(sorted_values, F.bround(F.lit(q) * (n - 1), 0).cast("int")))


def dns_burst(probes: DataFrame, keys: list[str], timeout: float = TIMEOUT_MS) -> DataFrame:
    """fail_rate, p50 and p95 of the successes; the timeout where all failed."""
    ok = F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("duration_ms"))))  # a burst is a handful of probes
    burst = probes.groupBy(*keys).agg(F.avg((~F.col("ok")).cast("double")).alias("fail_rate"), ok.alias("d"))
    pick = lambda q: F.coalesce(nearest_rank(F.col("d"), q), F.lit(timeout))
    return burst.select(*keys, "fail_rate", pick(0.5).alias("p50_ms"), pick(0.95).alias("p95_ms"))


_BURST = "CAST(floor(probe_id / {k}.0) AS BIGINT)"
_NEAREST = "d[CAST(round_even({q} * (len(d) - 1), 0) AS INT) + 1]"


@query(
    f"""SELECT host_id, burst, round(fail_rate, 6) AS fail_rate, round(coalesce({_NEAREST.format(q=0.5)}, {TIMEOUT_MS}), 6) AS p50_ms, round(coalesce({_NEAREST.format(q=0.95)}, {TIMEOUT_MS}), 6) AS p95_ms
    FROM (SELECT host_id, {_BURST.format(k=64)} AS burst, avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END) AS fail_rate, coalesce(list_sort(list(duration_ms) FILTER (WHERE ok)), []) AS d FROM probe_log GROUP BY 1, 2)""",
    "probe_log",
    name="dns_burst",
)
def _dns_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "probe_log").withColumn("burst", F.expr(_BURST.format(k=64)))
    return dns_burst(rows, ["host_id", "burst"]).select("host_id", "burst", *[F.round(c, 6).alias(c) for c in ("fail_rate", "p50_ms", "p95_ms")])


PHASES = ["dns_ms", "tcp_ms", "tls_ms", "ttfb_ms", "total_ms"]


def https_burst(probes: DataFrame, keys: list[str], timeout: float = TIMEOUT_MS) -> DataFrame:
    """Failure rate and the nearest-rank 90th percentile of each phase over the successes of a burst; where all failed, the
    timeout as time to the first byte and in total, and nothing for the other phases. A phase that wasn't timed is null."""
    ok = {p: F.array_sort(F.collect_list(F.when(F.col("ok"), F.col(p)))) for p in PHASES}  # a burst is a handful of probes
    burst = probes.groupBy(*keys).agg(F.avg((~F.col("ok")).cast("double")).alias("fail_rate"), F.coalesce(F.max("ok"), F.lit(False)).alias("any_ok"), *[c.alias(p) for p, c in ok.items()])
    failed = {p: F.lit(timeout if p in ("ttfb_ms", "total_ms") else None).cast("double") for p in PHASES}
    return burst.select(*keys, "fail_rate", *[F.when(F.col("any_ok"), nearest_rank(F.col(p), 0.9)).otherwise(failed[p]).alias(p) for p in PHASES])


#: Phases of the probes of the view: shares of their duration, no TLS for every fourth, no name lookup timed for every sixth.
_PHASES = """SELECT *, duration_ms - tcp_ms - tls_ms - coalesce(dns_ms, 0) AS ttfb_ms, duration_ms AS total_ms FROM (SELECT *, CASE WHEN probe_id % 6 <> 5 THEN duration_ms * (1 + probe_id % 5) / 20.0 END AS dns_ms,
    duration_ms * (1 + probe_id % 3) / 15.0 AS tcp_ms, CASE WHEN probe_id % 4 = 0 THEN 0e0 ELSE duration_ms * (1 + probe_id % 7) / 35.0 END AS tls_ms FROM {})"""


@query(
    f"""SELECT * FROM (WITH p AS (SELECT *, {_BURST.format(k=48)} AS burst FROM ({_PHASES.format('probe_log')})),
    long AS (SELECT host_id, burst, phase, ms FROM p UNPIVOT (ms FOR phase IN ({", ".join(PHASES)})) WHERE ok),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY host_id, burst, phase ORDER BY ms) - 1 AS place, count(*) OVER (PARTITION BY host_id, burst, phase) AS n FROM long),
    best AS (SELECT host_id, burst, {", ".join(f"max(ms) FILTER (WHERE phase = '{p}') AS {p}" for p in PHASES)} FROM ranked WHERE place = round_even(0.9 * (n - 1), 0) GROUP BY 1, 2)
    SELECT r.host_id, r.burst, round(fail_rate, 6) AS fail_rate, {", ".join(f"round({p}, 6) AS {p}" for p in PHASES[:3])}, {", ".join(f"round(CASE WHEN fail_rate = 1 THEN {TIMEOUT_MS} ELSE {p} END, 6) AS {p}" for p in PHASES[3:])}
    FROM (SELECT host_id, burst, avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END) AS fail_rate FROM p GROUP BY 1, 2) r LEFT JOIN best b ON b.host_id = r.host_id AND b.burst = r.burst)""",
    "probe_log",
    name="https_burst",
)
def _https_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_PHASES.format("{probes}"), probes=fixture(spark, sf_dir, "probe_log")).withColumn("burst", F.expr(_BURST.format(k=48)))
    return https_burst(rows, ["host_id", "burst"]).select("host_id", "burst", *[F.round(c, 6).alias(c) for c in ("fail_rate", *PHASES)])


@query(
    f"""SELECT * FROM (WITH b AS (SELECT host_id, trace_id, 1 - count(rtt_ms) / 4.0 AS loss, avg(rtt_ms) AS mean, list(rtt_ms) FILTER (WHERE rtt_ms IS NOT NULL) AS d FROM traces WHERE hop_index <= 4 GROUP BY 1, 2),
    c AS (SELECT *, coalesce(max(CASE WHEN mean IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY host_id ORDER BY trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS ever FROM b)
    SELECT host_id, trace_id, round(loss, 6) AS loss_rate, round(coalesce(mean, {TIMEOUT_MS}), 6) AS rtt_ms, round(CASE WHEN mean IS NULL OR len(d) < 2 THEN 0.0 ELSE list_avg(list_transform(d, lambda x: abs(x - mean))) END, 6) AS jitter_ms FROM c WHERE ever = 1)""",
    "traces",
)
def gateway_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss, mean round trip and mean absolute deviation per burst of four; nothing before the first answer."""
    rows = fixture(spark, sf_dir, "traces").filter("hop_index <= 4")
    b = rows.groupBy("host_id", "trace_id").agg((1 - F.count("rtt_ms") / 4.0).alias("loss"), F.avg("rtt_ms").alias("mean"), F.collect_list("rtt_ms").alias("d"))
    ever = F.max(F.col("mean").isNotNull()).over(Window.partitionBy("host_id").orderBy("trace_id").rowsBetween(Window.unboundedPreceding, 0))
    spread = F.aggregate("d", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("mean"))) / F.size("d")
    jitter = F.when(F.col("mean").isNull() | (F.size("d") < 2), 0.0).otherwise(spread)
    out = b.withColumn("ever", ever).filter("ever")
    return out.select("host_id", "trace_id", F.round("loss", 6).alias("loss_rate"), F.round(F.coalesce("mean", F.lit(TIMEOUT_MS)), 6).alias("rtt_ms"), F.round(jitter, 6).alias("jitter_ms"))


def trace_summary(hops: DataFrame, salt: bytes = _SALT) -> DataFrame:
    """Per trace: responsive hops, unresponsive share, last and second round trip, salted signature of the addresses."""
    answered = F.when(F.col("rtt_ms").isNotNull(), F.col("hop_index"))
    route = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hop_index", F.coalesce("address", F.lit("*")).alias("a")))), lambda x: x["a"]), ">")
    return hops.groupBy("host_id", "trace_id").agg(
        F.count("rtt_ms").alias("hops"),
        F.round(1 - F.count("rtt_ms") / F.count("*"), 6).alias("unresponsive"),
        F.round(F.max_by("rtt_ms", answered), 6).alias("rtt_ms"),
        F.round(F.max(F.when(F.col("hop_index") == 2, F.col("rtt_ms"))), 6).alias("second_hop_ms"),
        hash_to_number(route, salt).alias("signature"),
    )


_TRACE = f"SELECT * EXCLUDE (route), CAST(('0x' || {_hmac_sql('route')})::BIGINT AS DOUBLE) AS signature FROM (SELECT host_id, trace_id, count(rtt_ms) AS hops, round(1 - count(rtt_ms) / count(*), 6) AS unresponsive, round(arg_max(rtt_ms, CASE WHEN rtt_ms IS NOT NULL THEN hop_index END), 6) AS rtt_ms, round(max(CASE WHEN hop_index = 2 THEN rtt_ms END), 6) AS second_hop_ms, string_agg(coalesce(address, '*'), '>' ORDER BY hop_index) AS route FROM traces GROUP BY host_id, trace_id)"


@query(_TRACE, "traces", name="trace_summary")
def _trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_summary(fixture(spark, sf_dir, "traces"))


@query(f"SELECT host_id, trace_id, CAST(coalesce(signature <> lag(signature) OVER (PARTITION BY host_id ORDER BY trace_id), false) AS INT) AS path_changed FROM ({_TRACE})", "traces")
def path_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("signature").over(Window.partitionBy("host_id").orderBy("trace_id"))
    return trace_summary(fixture(spark, sf_dir, "traces")).select("host_id", "trace_id", F.coalesce(F.col("signature") != before, F.lit(False)).cast("int").alias("path_changed"))


@query(
    "SELECT host_id, round(d[CAST(round_even(0.9 * (len(d) - 1), 0) AS INT) + 1], 6) AS p90 FROM (SELECT host_id, list_sort(list(rtt_ms) FILTER (WHERE rtt_ms IS NOT NULL)) AS d FROM traces GROUP BY host_id)",
    "traces",
)
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By counts of distinct values, so that no task gathers a host's rows in an array."""
    counts = fixture(spark, sf_dir, "traces").filter("rtt_ms IS NOT NULL").groupBy("host_id", "rtt_ms").agg(F.count("*").alias("n"))
    w = Window.partitionBy("host_id")
    up_to = F.sum("n").over(w.orderBy("rtt_ms"))
    ranked = counts.select("host_id", "rtt_ms", up_to.alias("up"), F.bround(F.lit(0.9) * (F.sum("n").over(w) - 1), 0).alias("at"))
    return ranked.filter("up > at").groupBy("host_id").agg(F.round(F.min("rtt_ms"), 6).alias("p90"))


sql_query("percentile_linear", "SELECT host_id, round(percentile(rtt_ms, 0.9), 6) AS p90 FROM <traces> GROUP BY host_id", "traces", duck={"percentile(": "quantile_cont("})
sql_query(
    "counter_rates",
    """SELECT host_id, tick, round(CASE WHEN r > 0 THEN di / r ELSE 0.0 END, 6) AS rx_drop_rate, round(CASE WHEN s > 0 THEN dout / s ELSE 0.0 END, 6) AS tx_drop_rate, round(CASE WHEN s > 0 THEN e / s ELSE 0.0 END, 6) AS tx_err_rate FROM (
    SELECT host_id, tick, CAST(packets_recv - lag(packets_recv) OVER w AS DOUBLE) AS r, CAST(packets_sent - lag(packets_sent) OVER w AS DOUBLE) AS s, CAST(dropin - lag(dropin) OVER w AS DOUBLE) AS di, CAST(dropout - lag(dropout) OVER w AS DOUBLE) AS dout, CAST(errout - lag(errout) OVER w AS DOUBLE) AS e
    FROM <counters> WINDOW w AS (PARTITION BY host_id ORDER BY tick)) WHERE least(r, s, di, dout, e) >= 0""",
    "counters",
)
sql_query(
    "retrans_rate",
    """SELECT host_id, tick, round(d / s, 6) AS retrans_rate FROM (SELECT host_id, tick, CAST(errout - lag(errout) OVER w AS DOUBLE) AS d, CAST(packets_sent - lag(packets_sent) OVER w AS DOUBLE) AS s
    FROM (SELECT * FROM <counters> WHERE tick % 4 = 1) WINDOW w AS (PARTITION BY host_id ORDER BY tick)) WHERE s > 0 AND d >= 0""",
    "counters",
)
sql_query(
    "roam_count",
    """SELECT host_id, tick, CASE WHEN ap IS NOT NULL AND before IS NOT NULL AND ap <> before THEN 1 ELSE 0 END AS roamed FROM (
    SELECT host_id, tick, ap, last_value(ap, true) OVER (PARTITION BY host_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM (SELECT host_id, tick, CASE WHEN wifi_rssi_dbm IS NOT NULL THEN CAST(floor(wifi_link_mbps / 100) AS INT) END AS ap FROM <samples_sparse>))""",
    "samples_sparse",
    duck={"last_value(ap, true)": "last_value(ap IGNORE NULLS)"},
)
sql_query("signal_pct_to_dbm", "SELECT host_id, tick, round(coalesce(wifi_rssi_dbm, least(-50.0, greatest(-100.0, os_cpu_pct / 2 - 100))), 6) AS dbm FROM (SELECT host_id, tick, os_cpu_pct, CASE WHEN tick % 3 = 0 THEN wifi_rssi_dbm END AS wifi_rssi_dbm FROM <samples_dense>)", "samples_dense")
sql_query(
    "wifi_band_channel",
    """SELECT l_orderkey, l_linenumber, channel, mhz, CASE WHEN channel BETWEEN 1 AND 14 THEN 2.4e0 WHEN channel BETWEEN 32 AND 177 THEN 5.0e0 ELSE 6.0e0 END AS band_of_channel, CASE WHEN mhz < 3000 THEN 2.4e0 WHEN mhz < 5960 THEN 5.0e0 ELSE 6.0e0 END AS band_of_mhz,
    CASE WHEN mhz = 2484 THEN 14 WHEN mhz BETWEEN 2412 AND 2472 THEN CAST(floor((mhz - 2407) / 5.0) AS INT) WHEN mhz BETWEEN 5160 AND 5885 THEN CAST(floor((mhz - 5000) / 5.0) AS INT) WHEN mhz BETWEEN 5955 AND 7115 THEN CAST(floor((mhz - 5950) / 5.0) AS INT) ELSE 0 END AS channel_of_mhz
    FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 200 AS INT) AS channel, CAST(2400 + (l_partkey * 7) % 4800 AS INT) AS mhz FROM <lineitem>)""",
    tables="lineitem",
)
# Name parts of tunnel, radio and wired interfaces.
VPN_HINTS = ["tun", "tap", "wg", "ppp", "utun", "ipsec", "vpn", "wireguard", "openvpn", "nordlynx", "zt", "tailscale", "proton"]
WIFI_HINTS = ["wi-fi", "wifi", "wlan", "wlp", "airport", "en0", "wl"]
ETHERNET_HINTS = ["ethernet", "eth", "enp", "eno", "ens", "lan"]
_NAME = "CASE CAST(user_id % 9 AS INT) WHEN 0 THEN 'utun3' WHEN 1 THEN 'Wi-Fi' WHEN 2 THEN 'eth0' WHEN 3 THEN 'enp4s0' WHEN 4 THEN 'wlan1' WHEN 5 THEN 'bridge9' WHEN 6 THEN 'Tailscale' WHEN 7 THEN 'EN0' END"
sql_query(
    "classify_interface",
    f"""SELECT event_id, CASE WHEN n IS NULL THEN 2 WHEN regexp_like(n, '{"|".join(VPN_HINTS)}') THEN 2 WHEN regexp_like(n, '{"|".join(WIFI_HINTS)}') THEN 1 WHEN regexp_like(n, '{"|".join(ETHERNET_HINTS)}') THEN 0 ELSE 2 END AS iface_type,
    coalesce(regexp_like(n, '{"|".join(VPN_HINTS)}'), false) AS is_vpn FROM (SELECT event_id, lower({_NAME}) AS n FROM <events>)""",
    tables="events",
    duck={"regexp_like(": "regexp_matches("},
)
_RAW = "CASE CAST(page_id % 7 AS INT) WHEN 0 THEN concat('HTTP/1.1 200 OK', chr(13), chr(10), chr(13), chr(10), html) WHEN 1 THEN concat('HTTP/1.1 302 Found', chr(13), chr(10), chr(13), chr(10)) WHEN 2 THEN 'garbage' WHEN 3 THEN concat('HTTP/1.0 200 OK', chr(13), chr(10), chr(13), chr(10), 'Success') WHEN 4 THEN 'HTTP/1.1 200 OK' WHEN 5 THEN '' END"
sql_query(
    "classify_portal_response",
    f"""SELECT page_id, CASE WHEN raw IS NULL OR raw = '' THEN NULL WHEN status = '' THEN 1 WHEN status <> '200' THEN 1 WHEN cut = 0 THEN NULL WHEN trim(substr(raw, cut + 4)) = '' THEN NULL WHEN contains(lower(substr(raw, cut + 4)), 'success') THEN 0 ELSE 1 END AS intercepted
    FROM (SELECT page_id, raw, regexp_extract(raw, '^HTTP/[^ ]* ([0-9]+)', 1) AS status, instr(raw, concat(chr(13), chr(10), chr(13), chr(10))) AS cut FROM (SELECT page_id, {_RAW} AS raw FROM <pages>))""",
    tables="pages",
)

# Tool output built from the traces, one text per trace.
_PING = "SELECT host_id, trace_id, array_join(array_sort(collect_list(concat(lpad(CAST(hop_index AS VARCHAR(4)), 3, '0'), CASE WHEN rtt_ms IS NULL THEN ' Request timed out.' WHEN rtt_ms < 5 THEN ': bytes=32 time<1ms TTL=64' ELSE concat(': bytes=32 time=', CAST(rtt_ms AS VARCHAR(20)), 'ms TTL=64') END))), chr(10)) AS output FROM <traces> GROUP BY host_id, trace_id"
_DUCK_TEXT = {"array_join(array_sort(collect_list(": "array_to_string(list_sort(list("}
sql_query(
    "ingest_ping_logs",
    f"""SELECT host_id, trace_id, count(ms) AS replies, round(avg(ms), 6) AS mean_ms, round(min(ms), 6) AS min_ms FROM (
    SELECT host_id, trace_id, CASE WHEN line LIKE '%time<1ms%' THEN 0.5e0 WHEN regexp_extract(line, 'time=([0-9.]+) ?ms', 1) <> '' THEN CAST(regexp_extract(line, 'time=([0-9.]+) ?ms', 1) AS DOUBLE) END AS ms
    FROM (SELECT host_id, trace_id, explode(split(output, chr(10))) AS line FROM ({_PING}))) GROUP BY host_id, trace_id""",
    "traces",
    duck=_DUCK_TEXT | {"explode(split(output, chr(10)))": "unnest(string_split(output, chr(10)))"},
)
_TRACEROUTE = "SELECT host_id, trace_id, array_join(array_sort(collect_list(concat(lpad(CAST(hop_index AS VARCHAR(4)), 3, ' '), CASE WHEN rtt_ms IS NULL THEN '  *  *  *' ELSE concat('  ', address, '  ', CAST(rtt_ms + 1 AS VARCHAR(20)), ' ms  ', CAST(rtt_ms AS VARCHAR(20)), ' ms') END))), chr(10)) AS output FROM <traces> GROUP BY host_id, trace_id"
sql_query(
    "ingest_traceroute_logs",
    f"""SELECT host_id, trace_id, CAST(regexp_extract(line, '^ *([0-9]+) ', 1) AS INT) AS hop, nullif(regexp_extract(line, '([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)', 1), '') AS address, round(array_min(transform(regexp_extract_all(line, '([0-9.]+) ms', 1), x -> CAST(x AS DOUBLE))), 6) AS min_ms
    FROM (SELECT host_id, trace_id, explode(split(output, chr(10))) AS line FROM ({_TRACEROUTE})) WHERE line LIKE '%*%' OR line LIKE '% ms%'""",
    "traces",
    duck=_DUCK_TEXT | {"explode(split(output, chr(10)))": "unnest(string_split(output, chr(10)))", "array_min(transform(regexp_extract_all(line, '([0-9.]+) ms', 1), x -> CAST(x AS DOUBLE)))": "list_min(list_transform(regexp_extract_all(line, '([0-9.]+) ms', 1), lambda x: CAST(x AS DOUBLE)))"},
)


def wifi_fields(logs: DataFrame, salt: bytes = _SALT) -> DataFrame:
    """`logs` (tool, output and any more) with rssi_dbm, link_mbps, noise_dbm, channel, band_ghz, retry_rate and ap (the access
    point's salted hash) from the output of netsh, airport or iw; all null where the interface isn't connected."""

    def pick(*patterns: str) -> Column:
        return F.coalesce(*[F.get(F.regexp_extract_all("output", F.lit(p), F.lit(1)), 0) for p in patterns])

    def number(*patterns: str) -> Column:  # a pattern that isn't found gives an empty text, which is no number
        return (pick(*patterns) if patterns[1:] else F.regexp_extract("output", patterns[0], 1)).try_cast("double")

    key = lambda k: rf"(?im)^\s*{k}\s*:\s*(-?[0-9.]+)"
    mac = "([0-9a-fA-F:]{17})"
    percent = F.greatest(F.lit(-100.0), F.least(F.lit(-50.0), number(key("signal")) / 2 - 100))
    read = {
        "netsh": {
            "rssi": F.coalesce(number(key("rssi")), percent),
            "link": number(key(r"receive rate \(mbps\)"), key(r"transmit rate \(mbps\)")),
            "channel": number(key("channel")),
            "band": number(key("band")),
            "ap": pick(rf"(?im)^\s*(?:ap )?bssid\s*:\s*{mac}"),
        },
        "airport": {"rssi": number(key("agrCtlRSSI")), "link": number(key("lastTxRate")), "noise": number(key("agrCtlNoise")), "channel": number(key("channel")), "ap": pick(rf"(?im)^\s*bssid\s*:\s*{mac}")},
        "iw": {
            "rssi": number(r"signal:\s*(-?[0-9]+)\s*dBm"),
            "link": number(r"tx bitrate:\s*([0-9.]+)\s*MBit/s"),
            "ap": pick(rf"Connected to {mac}"),
            "mhz": number(r"freq:\s*([0-9]+)"),
            "packets": number(r"tx packets:\s*([0-9]+)"),
            "retries": number(r"tx retries:\s*([0-9]+)"),
            "failed": number(r"tx failed:\s*([0-9]+)"),
        },
    }
    names = list(dict.fromkeys(n for fields in read.values() for n in fields))
    up = {"netsh": F.lower(pick(r"(?im)^\s*state\s*:\s*(\w+)")).isin("connected", "associated")}
    # what a tool's text tells is read once into a struct, and columns are worked out from its fields
    told = F
    for tool, fields in read.items():
        values = F.struct(*[fields.get(n, F.lit(None)).cast("string" if n == "ap" else "double").alias(n) for n in names])
        told = told.when((F.col("tool") == tool) & up.get(tool, ~F.contains("output", F.lit("Not connected"))), values)
    rows = logs.select(F.struct("*").alias("log"), told.alias("told"))
    of = {n: F.col(f"told.{n}") for n in names}
    mhz, packets = of["mhz"], of["packets"]
    of_mhz = F.when(mhz == 2484, 14).when(mhz.between(2412, 2472), (mhz - 2407) / 5).when(mhz.between(5160, 5885), (mhz - 5000) / 5).when(mhz.between(5955, 7115), (mhz - 5950) / 5).otherwise(0)
    channel = F.coalesce(of["channel"], F.when(mhz.isNotNull(), F.floor(of_mhz)).cast("double"))
    band = F.coalesce(of["band"], F.when(mhz < 3000, 2.4).when(mhz < 5960, 5.0).when(mhz.isNotNull(), 6.0))
    of_channel = F.when(channel.between(1, 14), 2.4).when(channel.between(32, 177), 5.0).when(channel.isNotNull(), 6.0)
    retries = F.least(F.lit(1.0), (of["retries"] + F.coalesce(of["failed"], F.lit(0.0))) / packets)
    return rows.select(
        "log.*",
        of["rssi"].alias("rssi_dbm"),
        of["link"].alias("link_mbps"),
        of["noise"].alias("noise_dbm"),
        channel.alias("channel"),
        F.coalesce(band, of_channel).alias("band_ghz"),
        F.when(packets > 0, retries).alias("retry_rate"),
        F.when(of["ap"].isNotNull(), hash_to_number(of["ap"], salt)).alias("ap"),
    )


#: Tool output built from the samples, one text a frame: signal only in percent on some, not connected on others.
_WIFI = """SELECT host_id, tick, tool, CASE tool
    WHEN 'netsh' THEN concat('    Name : Wi-Fi', n, '    State : ', CASE WHEN tick % 9 = 0 THEN 'disconnected' ELSE 'connected' END, n, '    AP BSSID : ', ap, n, '    Band : 5 GHz', n, '    Channel : 36', n, '    Receive rate (Mbps) : ', mbps, n, CASE WHEN tick % 2 = 0 THEN concat('    Rssi : ', dbm) ELSE concat('    Signal : ', pct, '%') END)
    WHEN 'airport' THEN concat('     agrCtlRSSI: ', dbm, n, '     agrCtlNoise: -90', n, '           state: running', n, '     lastTxRate: ', mbps, n, '          BSSID: ', ap, n, '        channel: 149,80')
    ELSE CASE WHEN tick % 15 = 2 THEN 'Not connected.' ELSE concat('Connected to ', ap, ' (on wlan0)', n, '	freq: ', 2412 + 5 * (tick % 8), n, '	signal: ', dbm, ' dBm', n, '	tx bitrate: ', mbps, '.0 MBit/s', n, '	tx packets:	', tick % 90, n, '	tx retries:	', tick % 40, n, '	tx failed:	', tick % 7) END END AS output
    FROM (SELECT host_id, tick, chr(10) AS n, CASE CAST(tick % 3 AS INT) WHEN 0 THEN 'netsh' WHEN 1 THEN 'airport' ELSE 'iw' END AS tool, concat('aa:bb:cc:dd:ee:', lpad(CAST(host_id AS VARCHAR(9)), 2, '0')) AS ap, CAST(tick % 101 AS INT) AS pct,
    CAST(round(wifi_rssi_dbm) AS INT) AS dbm, CAST(round(wifi_link_mbps) AS INT) AS mbps FROM {samples})"""


@query(
    f"""SELECT host_id, tick, tool, CASE WHEN up THEN dbm END AS rssi_dbm, CASE WHEN up THEN mbps END AS link_mbps, CASE WHEN tool = 'airport' THEN -90e0 END AS noise_dbm,
    CASE WHEN up THEN CASE tool WHEN 'netsh' THEN 36e0 WHEN 'airport' THEN 149e0 ELSE tick % 8 + 1e0 END END AS channel, CASE WHEN up THEN CASE tool WHEN 'iw' THEN 2.4e0 ELSE 5e0 END END AS band_ghz,
    CASE WHEN up AND tool = 'iw' AND tick % 90 > 0 THEN round(least(1e0, (tick % 40 + tick % 7) / (tick % 90)), 6) END AS retry_rate, CASE WHEN up THEN CAST(('0x' || {_hmac_sql("mac")})::BIGINT AS DOUBLE) END AS ap
    FROM (SELECT host_id, tick, ['netsh', 'airport', 'iw'][CAST(tick % 3 AS INT) + 1] AS tool, NOT (tick % 9 = 0 OR tick % 15 = 2) AS up, 'aa:bb:cc:dd:ee:' || lpad(host_id::VARCHAR, 2, '0') AS mac,
    CASE WHEN tick % 3 = 0 AND tick % 2 = 1 THEN least(-50e0, greatest(-100e0, tick % 101 / 2e0 - 100)) ELSE CAST(round(wifi_rssi_dbm) AS DOUBLE) END AS dbm, CAST(round(wifi_link_mbps) AS DOUBLE) AS mbps FROM samples_dense)""",
    "samples_dense",
)
def ingest_wifi_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three tools say of an interface. The oracle takes the values from the samples, not from the texts."""
    logs = spark.sql(_WIFI, samples=fixture(spark, sf_dir, "samples_dense"))
    return wifi_fields(logs).drop("output").withColumn("retry_rate", F.round("retry_rate", 6))
