"""Queries that judge scores against labelled windows, and other numeric summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostvigil.catalogue import LAYER_OF
from hostvigil.operators.incidents import _INCIDENTS_SQL, incidents_of
from hostvigil.operators.intervals import interval_join
from hostvigil.operators.models import combine, greedy_cooldown
from hostvigil.registry import query, sql_query
from hostvigil.sources.fixtures import fixture


def label_horizon(samples: DataFrame, windows: DataFrame, seconds: float) -> DataFrame:
    """`label`: 1 if the row lies in a bad window of its host or one starts within `seconds`; rows never multiply.

    Both sides meet by host and hour, so a window reaches only the rows near it.
    """
    hour = 3600.0
    w = windows.select(F.col("host_id").alias("h"), "start_ts", "end_ts", F.explode(F.sequence(F.floor((F.col("start_ts") - seconds) / hour), F.floor(F.col("end_ts") / hour))).alias("bin"))
    s = samples.withColumn("_bin", F.floor(F.col("ts") / hour))
    on = (F.col("host_id") == F.col("h")) & (F.col("_bin") == F.col("bin")) & (F.col("ts") <= F.col("end_ts")) & (F.col("start_ts") <= F.col("ts") + seconds)
    hit = s.join(w, on, "left_semi").select("host_id", "ts").distinct().withColumn("label", F.lit(1))
    return samples.join(hit, ["host_id", "ts"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


_LABEL = "CAST(EXISTS (SELECT 1 FROM bad_windows b WHERE b.host_id = s.host_id AND s.ts <= b.end_ts AND b.start_ts <= s.ts + {h}) AS INT)"


@query(f"SELECT host_id, ts, {_LABEL.format(h=300)} AS bad_5m, {_LABEL.format(h=900)} AS bad_15m FROM samples_sparse s", "samples_sparse bad_windows", name="label_horizon")
def _label_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixture(spark, sf_dir, "samples_sparse").select("host_id", "ts")
    w = fixture(spark, sf_dir, "bad_windows")
    near = label_horizon(s, w, 300.0).withColumnRenamed("label", "bad_5m")
    return near.join(label_horizon(s, w, 900.0).withColumnRenamed("label", "bad_15m"), ["host_id", "ts"])


@query(f"SELECT host_id, ts, {_LABEL.format(h=0)} AS bad FROM samples_sparse s", "samples_sparse bad_windows")
def in_bad_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_horizon(fixture(spark, sf_dir, "samples_sparse").select("host_id", "ts"), fixture(spark, sf_dir, "bad_windows"), 0.0).withColumnRenamed("label", "bad")


@query(
    "SELECT CASE CAST(b.window_id % 3 AS INT) WHEN 0 THEN 'bad' WHEN 1 THEN 'ok' ELSE 'unsure' END AS verdict, CAST(s.risk_raw >= 0.5 AS INT) AS alerted, count(*) AS n FROM score_series s JOIN bad_windows b ON s.host_id = b.host_id AND s.ts BETWEEN b.start_ts AND b.end_ts GROUP BY 1, 2",
    "score_series bad_windows",
)
def label_feedback_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixture(spark, sf_dir, "score_series").select("host_id", "ts", "risk_raw")
    b = fixture(spark, sf_dir, "bad_windows").select("host_id", "window_id", "start_ts", "end_ts")
    verdict = F.when(F.col("window_id") % 3 == 0, "bad").when(F.col("window_id") % 3 == 1, "ok").otherwise("unsure").alias("verdict")
    joined = interval_join(s, b, "ts", "start_ts", "end_ts")
    return joined.groupBy(verdict, (F.col("risk_raw") >= 0.5).cast("int").alias("alerted")).agg(F.count("*").alias("n"))


sql_query(
    "combine_anomaly",
    """SELECT host_id, tick, round(CASE WHEN size(s) = 0 THEN 0e0 ELSE least(1e0, (s[0] + 0.35e0 * (coalesce(get(s, 1), 0e0) + coalesce(get(s, 2), 0e0) + coalesce(get(s, 3), 0e0)) / 3) / 3) END + 1.37e-8, 6) AS anomaly FROM (
    SELECT host_id, tick, reverse(array_sort(filter(array(gw_rtt_ms / 10, gw_loss_rate, dns_p50_ms / 20, dns_fail_rate, https_fail_rate, os_retrans_rate), x -> x > 0.01))) AS s FROM <samples_dense>)""",
    "samples_dense",
    duck={"size(s)": "len(s)", "s[0]": "s[1]", "get(s, 1)": "s[2]", "get(s, 2)": "s[3]", "get(s, 3)": "s[4]", "reverse(array_sort(filter(array(": "list_reverse_sort(list_filter(([", "os_retrans_rate), x -> x > 0.01)))": "os_retrans_rate]), lambda x: x > 0.01))"},
)
_EDGES = ", ".join(f"{k / 10}" for k in range(1, 10))
sql_query(
    "psi",
    f"""SELECT host_id, round(sum((a - e) * ln(a / e)), 6) AS psi FROM (SELECT host_id, greatest(CAST(na AS DOUBLE) / sum(na) OVER (PARTITION BY host_id), 1e-4) AS a, greatest(CAST(ne AS DOUBLE) / sum(ne) OVER (PARTITION BY host_id), 1e-4) AS e FROM (
      SELECT host_id, bin, sum(recent) AS na, sum(1 - recent) AS ne FROM (SELECT d.host_id, size(filter(edges, q -> d.p > q)) AS bin, d.recent FROM (SELECT host_id, dns_p50_ms AS p, CASE WHEN tick % 3 = 0 THEN 1 ELSE 0 END AS recent FROM <samples_dense>) d
      JOIN (SELECT host_id, percentile(dns_p50_ms, array({_EDGES})) AS edges FROM <samples_dense> WHERE tick % 3 <> 0 GROUP BY host_id) q ON q.host_id = d.host_id) GROUP BY host_id, bin)) GROUP BY host_id""",
    "samples_dense",
    duck={"size(filter(edges, q -> d.p > q))": "len(list_filter(edges, lambda q: d.p > q))", f"percentile(dns_p50_ms, array({_EDGES}))": f"quantile_cont(dns_p50_ms, [{_EDGES}])"},
)
_M = "round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END, 6) AS precision_, round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CAST(tp + fp AS DOUBLE) / n, 6) AS alert_fraction"
sql_query(
    "binary_metrics",
    f"""SELECT threshold, {_M} FROM (SELECT threshold, sum(CASE WHEN p >= threshold AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p >= threshold AND y = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN p < threshold AND y = 1 THEN 1 ELSE 0 END) AS fn, count(*) AS n
    FROM (SELECT CAST(risk_raw AS DOUBLE) AS p, outcome AS y, explode(array(0.25e0, 0.5e0, 0.75e0)) AS threshold FROM <score_series>) GROUP BY threshold)""",
    "score_series",
    duck={"explode(array(0.25e0, 0.5e0, 0.75e0))": "unnest([0.25e0, 0.5e0, 0.75e0])"},
)
sql_query("brier", "SELECT host_id, round(coalesce(avg(pow(risk_raw - outcome, 2)), 0), 6) AS brier FROM <score_series> GROUP BY host_id", "score_series")
_BINS = "SELECT CAST(least(floor(p * 10 + 1e-9), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM (SELECT CAST(risk_raw AS DOUBLE) AS p, outcome AS y FROM <score_series>) GROUP BY 1"
sql_query("reliability_bins", _BINS, "score_series")
sql_query("ece", f"SELECT round(sum(n * abs(mean_p - mean_y)) / sum(n), 5) AS ece FROM ({_BINS})", "score_series")


@query("SELECT lead, count(*) AS n, round(CAST(sum(count(*)) OVER (ORDER BY lead) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share FROM (SELECT end_ts - start_ts AS lead FROM bad_windows) GROUP BY lead", "bad_windows")
def lead_time_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the windows with at most each lead. Leads are whole frames, so the ranked table has a row a lead, not a window."""
    leads = fixture(spark, sf_dir, "bad_windows").select((F.col("end_ts") - F.col("start_ts")).alias("lead")).groupBy("lead").agg(F.count("*").alias("n"))
    up, every = Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return leads.select("lead", "n", F.round(F.sum("n").over(up) / F.sum("n").over(every), 6).alias("share"))




# ---- runs: a run is a host; hosts of remainder 3 by 4 count as benign ones, without a bad window -----------------------
ALERT_COOLDOWN, WARM_TICKS, PRECURSOR = 1800, 120, 1800
EXPECTED = ["gateway", "dns", "remote_https", "path", "wifi"]


def alerts_of(incidents: DataFrame) -> DataFrame:
    """The incidents that alert: none of the same host and layer alerted within the cool-down."""
    events = incidents.select("host_id", "primary_layer", F.col("started_at").alias("ts"), F.lit(0).alias("rank"))
    return greedy_cooldown(events, ALERT_COOLDOWN, ["host_id", "primary_layer"]).filter("kept")


def run_outcomes(scores: DataFrame, windows: DataFrame, incidents: DataFrame) -> DataFrame:
    """A row a run: frames after the warm-up, peaks in bad and in quiet times, alerts, detection, lead, predicted layer.

    The predicted layer is that of the first incident, or of the last one opened in a bad window.
    """
    impact = windows.groupBy("host_id").agg(F.min("start_ts").alias("impact"))
    s = label_horizon(scores, windows, 0.0).join(impact, "host_id", "left")
    quiet = (F.col("label") == 0) & (F.col("impact").isNull() | (F.col("ts") < F.col("impact") - PRECURSOR) | (F.col("ts") >= F.col("impact")))
    runs = s.groupBy("host_id").agg(
        F.count("*").alias("frames"),
        F.max(F.when(F.col("label") == 1, F.col("risk"))).alias("peak_bad"),
        F.max(F.when(quiet, F.col("risk"))).alias("peak_quiet"),
        F.greatest(F.lit(1.0), F.max("ts") - F.min("ts")).alias("seconds"),
        F.first("impact").alias("impact"),
    )
    opened = label_horizon(incidents.withColumn("ts", F.col("started_at")), windows, 0.0)
    layer = opened.groupBy("host_id").agg(F.coalesce(F.max_by("primary_layer", F.when(F.col("label") == 1, F.col("ts"))), F.min_by("primary_layer", "ts")).alias("layer"))
    alerts = alerts_of(incidents).groupBy("host_id").agg(F.count("*").alias("alerts"), F.min("ts").alias("first_alert"))
    out = runs.join(alerts, "host_id", "left").join(layer, "host_id", "left")
    expected = F.element_at(F.array(*[F.lit(x) for x in EXPECTED]), (F.col("host_id") % len(EXPECTED) + 1).cast("int"))
    out = out.withColumns({"alerts": F.coalesce("alerts", F.lit(0)), "benign": F.col("impact").isNull(), "expected": F.when(F.col("impact").isNotNull(), expected)})
    detected = ~F.col("benign") & F.col("first_alert").isNotNull()
    return out.withColumns({"detected": detected, "lead": F.when(detected, F.greatest(F.lit(0.0), F.col("impact") - F.col("first_alert"))), "layer_correct": F.col("layer") == F.col("expected"), "alerts_per_day": F.col("alerts") * 86400 / F.col("seconds")})


def eval_summary(runs: DataFrame) -> DataFrame:
    """One row: how many runs and faults, and the five measures that the gates look at."""
    fault = ~F.col("benign")
    mean = lambda x: F.coalesce(F.avg(x), F.lit(0.0))
    return runs.agg(
        F.count("*").alias("runs"),
        F.count_if(fault).alias("faults"),
        mean(F.when(fault, F.col("detected").cast("double"))).alias("detection_rate"),
        F.coalesce(F.percentile(F.when(fault & F.col("detected"), F.col("lead")), F.lit(0.5)), F.lit(0.0)).alias("median_lead"),
        mean(F.when(fault, F.col("layer_correct").cast("double"))).alias("layer_accuracy"),
        mean(F.when(F.col("alerts") > 0, fault.cast("double"))).alias("precision_"),
        mean(F.when(F.col("benign"), F.col("alerts_per_day"))).alias("benign_alerts_per_day"),
    )


# What each measure must reach.
GATES = [("median_lead", 300.0, "at least"), ("detection_rate", 0.9, "at least"), ("layer_accuracy", 0.6, "at least"), ("precision_", 0.5, "at least"), ("benign_alerts_per_day", 2.0, "at most")]


def eval_gates(summary: DataFrame) -> DataFrame:
    each = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).alias("target"), (F.col(m) >= t if way == "at least" else F.col(m) <= t).cast("int").alias("passed")) for m, t, way in GATES]
    return summary.select(F.explode(F.array(*each)).alias("g")).select("g.*")


def _fixture_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = fixture(spark, sf_dir, "score_series").filter(f"tick >= {WARM_TICKS}").select("host_id", "ts", F.col("risk_raw").cast("double").alias("risk"))
    return run_outcomes(scores, fixture(spark, sf_dir, "bad_windows").filter("host_id % 4 <> 3"), incidents_of(spark, sf_dir))


_RUNS = f"""(WITH RECURSIVE w AS (SELECT * FROM bad_windows WHERE host_id % 4 <> 3), inc AS (SELECT * FROM {_INCIDENTS_SQL}),
  ev AS (SELECT host_id, primary_layer AS layer, started_at AS ts, row_number() OVER (PARTITION BY host_id, primary_layer ORDER BY started_at) AS i FROM inc),
  cool AS (SELECT host_id, layer, ts, i, ts AS last, true AS kept FROM ev WHERE i = 1 UNION ALL SELECT e.host_id, e.layer, e.ts, e.i, CASE WHEN e.ts - c.last >= {ALERT_COOLDOWN} THEN e.ts ELSE c.last END, e.ts - c.last >= {ALERT_COOLDOWN} FROM cool c JOIN ev e ON e.host_id = c.host_id AND e.layer = c.layer AND e.i = c.i + 1),
  al AS (SELECT host_id, count(*) AS alerts, min(ts) AS first_alert FROM cool WHERE kept GROUP BY host_id),
  im AS (SELECT host_id, min(start_ts) AS impact FROM w GROUP BY host_id),
  fr AS (SELECT s.host_id, s.ts, CAST(s.risk_raw AS DOUBLE) AS risk, im.impact, EXISTS (SELECT 1 FROM w WHERE w.host_id = s.host_id AND s.ts BETWEEN w.start_ts AND w.end_ts) AS bad FROM score_series s LEFT JOIN im ON im.host_id = s.host_id WHERE s.tick >= {WARM_TICKS}),
  ru AS (SELECT host_id, count(*) AS frames, max(risk) FILTER (WHERE bad) AS peak_bad, max(risk) FILTER (WHERE NOT bad AND (impact IS NULL OR NOT (ts >= impact - {PRECURSOR} AND ts < impact))) AS peak_quiet, greatest(1, max(ts) - min(ts)) AS seconds, any_value(impact) AS impact FROM fr GROUP BY host_id),
  op AS (SELECT inc.host_id, started_at, primary_layer, EXISTS (SELECT 1 FROM w WHERE w.host_id = inc.host_id AND started_at BETWEEN w.start_ts AND w.end_ts) AS bad FROM inc),
  la AS (SELECT host_id, coalesce(arg_max(primary_layer, started_at) FILTER (WHERE bad), arg_min(primary_layer, started_at)) AS layer FROM op GROUP BY host_id)
  SELECT ru.*, coalesce(al.alerts, 0) AS alerts, al.first_alert, la.layer, ru.impact IS NOT NULL AND al.first_alert IS NOT NULL AS detected, CASE WHEN ru.impact IS NOT NULL AND al.first_alert IS NOT NULL THEN greatest(0, ru.impact - al.first_alert) END AS lead,
    CASE WHEN ru.impact IS NOT NULL THEN la.layer = {EXPECTED!r}[CAST(ru.host_id % {len(EXPECTED)} AS INT) + 1] END AS correct FROM ru LEFT JOIN al ON al.host_id = ru.host_id LEFT JOIN la ON la.host_id = ru.host_id)"""
_SUMMARY = f"""(SELECT count(*) AS runs, count(*) FILTER (WHERE impact IS NOT NULL) AS faults, coalesce(avg(CAST(detected AS INT)) FILTER (WHERE impact IS NOT NULL), 0) AS detection_rate, coalesce(median(lead), 0) AS median_lead,
  coalesce(avg(CAST(correct AS INT)), 0) AS layer_accuracy, coalesce(avg(CASE WHEN impact IS NOT NULL THEN 1 ELSE 0 END) FILTER (WHERE alerts > 0), 0) AS precision_, coalesce(avg(alerts * 86400 / seconds) FILTER (WHERE impact IS NULL), 0) AS benign_alerts_per_day FROM {_RUNS})"""
_MEASURES = [m for m, _, _ in GATES]


@query(f"SELECT host_id, frames, round(peak_bad, 6) AS peak_bad, round(peak_quiet, 6) AS peak_quiet, alerts, first_alert, CAST(detected AS INT) AS detected, CAST(lead AS DOUBLE) AS lead, layer, CAST(correct AS INT) AS layer_correct FROM {_RUNS}", "score_series bad_windows", name="run_outcomes")
def _run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _fixture_runs(spark, sf_dir)
    return r.select("host_id", "frames", F.round("peak_bad", 6).alias("peak_bad"), F.round("peak_quiet", 6).alias("peak_quiet"), "alerts", "first_alert", F.col("detected").cast("int").alias("detected"), "lead", "layer", F.col("layer_correct").cast("int").alias("layer_correct"))


@query(f"SELECT runs, faults, {', '.join(f'round({m}, 6) AS {m}' for m in _MEASURES)} FROM {_SUMMARY}", "score_series bad_windows", name="eval_summary")
def _eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_summary(_fixture_runs(spark, sf_dir)).select("runs", "faults", *[F.round(m, 6).alias(m) for m in _MEASURES])


@query(" UNION ALL ".join(f"SELECT '{m}' AS metric, round({m}, 6) AS value, CAST({t} AS DOUBLE) AS target, CAST({m} {'>=' if way == 'at least' else '<='} {t} AS INT) AS passed FROM {_SUMMARY}" for m, t, way in GATES), "score_series bad_windows", name="eval_gates")
def _eval_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary's measures against their targets."""
    return eval_gates(eval_summary(_fixture_runs(spark, sf_dir))).withColumn("value", F.round("value", 6))


@query(
    f"SELECT s.host_id, count(*) AS samples, round((max(s.ts) - min(s.ts)) / 3600, 6) AS span_hours, round(min(100 * (1 - s.risk_raw)), 4) AS lowest_health, any_value(coalesce(i.opened, 0)) AS opened FROM score_series s LEFT JOIN (SELECT host_id, count(*) AS opened FROM {_INCIDENTS_SQL} GROUP BY host_id) i ON i.host_id = s.host_id GROUP BY s.host_id",
    "score_series",
)
def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, span, lowest health and incidents opened of each run."""
    s = fixture(spark, sf_dir, "score_series").groupBy("host_id").agg(F.count("*").alias("samples"), F.round((F.max("ts") - F.min("ts")) / 3600, 6).alias("span_hours"), F.round(F.min(100 * (1 - F.col("risk_raw"))), 4).alias("lowest_health"))
    opened = incidents_of(spark, sf_dir).groupBy("host_id").agg(F.count("*").alias("opened"))
    return s.join(opened, "host_id", "left").withColumn("opened", F.coalesce("opened", F.lit(0)))


# Fixed values of the check: contributions of features from what the frames hold.
_PULLS = {"gw_rtt_ms": "gw_rtt_ms / 10", "gw_loss_rate": "gw_loss_rate", "dns_p50_ms": "dns_p50_ms / 20", "dns_fail_rate": "dns_fail_rate", "https_ttfb_ms": "https_ttfb_ms / 90", "https_tcp_ms": "https_tcp_ms / 60", "https_fail_rate": "https_fail_rate", "path_rtt_ms": "path_rtt_ms / 30", "wifi_tx_retry_rate": "wifi_tx_retry_rate", "os_cpu_pct": "os_cpu_pct / 50", "os_retrans_rate": "os_retrans_rate"}


@query(
    f"""SELECT host_id, tick, layer, round(least(1, (max(c) + 0.35 * coalesce(sum(c) FILTER (WHERE rank BETWEEN 2 AND 4), 0) / 3) / 3) + 1.37e-8, 6) AS anomaly FROM (SELECT *, row_number() OVER (PARTITION BY host_id, tick, layer ORDER BY c DESC) AS rank FROM (
    {' UNION ALL '.join(f"SELECT host_id, tick, '{LAYER_OF[f]}' AS layer, CAST({x} AS DOUBLE) AS c FROM samples_dense" for f, x in _PULLS.items())}) WHERE c > 0.01) GROUP BY host_id, tick, layer""",
    "samples_dense",
)
def layer_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly of every layer that has a contribution, from contributions that are given."""
    d = fixture(spark, sf_dir, "samples_dense")
    layers = sorted({LAYER_OF[f] for f in _PULLS})
    each = [F.struct(F.lit(x).alias("layer"), combine(F.array(*[F.expr(p).cast("double") for f, p in _PULLS.items() if LAYER_OF[f] == x])).alias("anomaly")) for x in layers]
    rows = d.select("host_id", "tick", F.explode(F.array(*each)).alias("e")).select("host_id", "tick", "e.*").filter("anomaly > 0")
    return rows.withColumn("anomaly", F.round(F.col("anomaly") + 1.37e-8, 6))
