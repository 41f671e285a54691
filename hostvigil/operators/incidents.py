"""Incidents from scores: hysteresis, roll-up, cards, texts, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from hostvigil.catalogue import FEATURES, LAYER_OF, LAYERS, REMEDIATIONS, SEVERITIES, TEMPLATES, TEXTS, TITLES
from hostvigil.operators.frames import FRAME_SQL, SPARSE, band_rank, derive_cross_layer, frames_of, severity_name
from hostvigil.operators.intervals import interval_join
from hostvigil.registry import query, sql_query
from hostvigil.sources.fixtures import fixture

OPEN_AFTER, CLOSE_AFTER = 6, 20
BLIND_BELOW = 0.15


def by_host() -> WindowSpec:
    return Window.partitionBy("host_id").orderBy("ts")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(fixture(spark, sf_dir, "score_series"))


def published(s: DataFrame) -> DataFrame:
    """Score rows with published risk, severity rank and a blind flag."""
    blind = F.col("coverage") < BLIND_BELOW
    floor, raw = F.col("risk_floor").cast("double"), F.col("risk_raw").cast("double")
    return s.withColumn("risk", F.when(blind, floor).otherwise(F.greatest(floor, raw))).withColumns({"blind": blind, "rank": band_rank(F.col("risk"))})


def alert_runs(scores: DataFrame) -> DataFrame:
    """`above`, `below`: length of the current run of frames at risk or more, and under it; a blind frame ends the run above only."""
    state = F.when(F.col("blind"), 2).when(F.col("rank") >= 2, 1).otherwise(0)
    s = scores.withColumn("_s", state)
    # a run above is broken by any other frame; a run below only by an alerting one
    up = s.withColumn("_up", F.sum((F.col("_s") != 1).cast("int")).over(by_host()))
    runs = up.withColumn("_down", F.sum((F.col("_s") == 1).cast("int")).over(by_host()))
    above = F.sum((F.col("_s") == 1).cast("int")).over(Window.partitionBy("host_id", "_up").orderBy("ts"))
    below = F.sum((F.col("_s") == 0).cast("int")).over(Window.partitionBy("host_id", "_down").orderBy("ts"))
    return runs.withColumn("above", F.when(F.col("_s") == 1, above).otherwise(0)).withColumn("below", F.when(F.col("_s") == 1, 0).otherwise(below)).drop("_s", "_up", "_down")


def hysteresis(runs: DataFrame, card: Column) -> DataFrame:
    """`incident`: number of the incident that is open after the frame, or null; `opened`, `closed`: whether it opens or closes here."""
    event = F.when(~F.col("blind") & (F.col("above") >= OPEN_AFTER) & card, "O").when(~F.col("blind") & (F.col("below") >= CLOSE_AFTER), "C")
    s = runs.withColumn("_e", F.last(event, ignorenulls=True).over(by_host()))
    before = F.coalesce(F.lag("_e").over(by_host()), F.lit("C"))
    s = s.withColumn("opened", (F.coalesce(F.col("_e"), F.lit("C")) == "O") & (before == "C")).withColumn("closed", (F.coalesce(F.col("_e"), F.lit("C")) == "C") & (before == "O"))
    number = F.sum(F.col("opened").cast("int")).over(by_host())
    return s.withColumn("incident", F.when((F.col("_e") == "O") | F.col("closed"), number)).drop("_e")


def rollup(states: DataFrame) -> DataFrame:
    """A row per incident; its layer is that of the last rise of severity."""
    w = Window.partitionBy("host_id", "incident").orderBy("ts")
    s = states.filter("incident IS NOT NULL AND NOT blind").withColumn("_top", F.max("rank").over(w))
    rise = F.coalesce(F.col("_top") > F.lag("_top").over(w), F.lit(True))
    s = s.withColumn("_rise", F.when(rise, F.col("ts")))
    return s.groupBy("host_id", "incident").agg(
        F.min("ts").alias("started_at"),
        F.max(F.when(F.col("closed"), F.col("ts"))).alias("ended_at"),
        F.max("risk").alias("peak_risk"),
        F.max("rank").alias("rank"),
        F.max_by("primary_layer", "_rise").alias("primary_layer"),
    )


def incidents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents_in(fixture(spark, sf_dir, "score_series"))


def incidents_in(scores: DataFrame) -> DataFrame:
    return rollup(hysteresis(alert_runs(published(scores)), F.lit(True)))


# ---- oracle text -------------------------------------------------------------------------------------------------
_RISK = "CASE WHEN coverage < 0.15 THEN risk_floor ELSE greatest(risk_floor, risk_raw) END"
SCORED_SQL = f"(SELECT *, CASE WHEN risk >= 0.75 THEN 3 WHEN risk >= 0.5 THEN 2 WHEN risk >= 0.25 THEN 1 ELSE 0 END AS rank FROM (SELECT *, CAST({_RISK} AS DOUBLE) AS risk, coverage < 0.15 AS blind FROM score_series))"
# step by step, as a recursion over the frames of a host: what the windows must equal
STATES_SQL = f"""(WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY ts) AS i FROM {SCORED_SQL}),
 m AS (SELECT host_id, i, ts, risk, rank, blind, primary_layer, 0 AS above, 0 AS below, 0 AS open, 0 AS num, false AS opened, false AS closed FROM (SELECT *, 0 AS z FROM (SELECT DISTINCT host_id FROM r)) h, LATERAL (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS ts, CAST(0 AS DOUBLE) AS risk, 0 AS rank, false AS blind, '' AS primary_layer) z
 UNION ALL SELECT x.host_id, x.i, x.ts, x.risk, x.rank, x.blind, x.primary_layer, x.a, x.b, CASE WHEN x.blind THEN m.open WHEN m.open = 0 AND x.a >= {OPEN_AFTER} THEN 1 WHEN m.open = 1 AND x.b >= {CLOSE_AFTER} THEN 0 ELSE m.open END,
 CASE WHEN NOT x.blind AND m.open = 0 AND x.a >= {OPEN_AFTER} THEN m.num + 1 ELSE m.num END, NOT x.blind AND m.open = 0 AND x.a >= {OPEN_AFTER}, NOT x.blind AND m.open = 1 AND x.b >= {CLOSE_AFTER}
 FROM m JOIN LATERAL (SELECT r.*, CASE WHEN r.blind THEN 0 WHEN r.rank >= 2 THEN m.above + 1 ELSE 0 END AS a, CASE WHEN r.blind THEN m.below WHEN r.rank >= 2 THEN 0 ELSE m.below + 1 END AS b FROM r WHERE r.host_id = m.host_id AND r.i = m.i + 1) x ON true)
 SELECT *, CASE WHEN open = 1 OR closed THEN num END AS incident FROM m WHERE i > 0)"""
_INCIDENTS_SQL = f"""(SELECT host_id, incident, min(ts) AS started_at, max(CASE WHEN closed THEN ts END) AS ended_at, max(risk) AS peak_risk, max(rank) AS rank, arg_max(primary_layer, rise) AS primary_layer FROM (
 SELECT *, CASE WHEN top > coalesce(lag(top) OVER (PARTITION BY host_id, incident ORDER BY ts), -1) THEN ts END AS rise FROM (SELECT *, max(rank) OVER (PARTITION BY host_id, incident ORDER BY ts) AS top FROM {STATES_SQL} WHERE incident IS NOT NULL AND NOT blind)) GROUP BY host_id, incident)"""


@query(f"SELECT host_id, ts, CAST(above AS BIGINT) AS above, CAST(below AS BIGINT) AS below FROM {STATES_SQL}", "score_series", name="alert_runs")
def _alert_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_runs(scored(spark, sf_dir)).select("host_id", "ts", F.col("above").cast("long").alias("above"), F.col("below").cast("long").alias("below"))


@query(f"SELECT host_id, ts, CAST(opened AS INT) AS opened, CAST(closed AS INT) AS closed, CAST(incident AS BIGINT) AS incident FROM {STATES_SQL}", "score_series")
def incident_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = hysteresis(alert_runs(scored(spark, sf_dir)), F.lit(True))
    return s.select("host_id", "ts", F.col("opened").cast("int").alias("opened"), F.col("closed").cast("int").alias("closed"), "incident")


@query(f"SELECT host_id, CAST(incident AS BIGINT) AS incident, started_at, ended_at FROM {_INCIDENTS_SQL} WHERE started_at >= 1704070000 OR ended_at IS NULL ORDER BY started_at DESC, host_id LIMIT 40", "score_series")
def recent_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents_of(spark, sf_dir).filter("started_at >= 1704070000 OR ended_at IS NULL").orderBy(F.desc("started_at"), "host_id").limit(40).select("host_id", "incident", "started_at", "ended_at")


@query(
    f"""SELECT s.host_id, s.ts, round(s.risk_raw, 6) AS risk_raw, i.incident AS open_incident FROM (SELECT host_id, max(ts) AS ts, arg_max(risk_raw, ts) AS risk_raw FROM score_series GROUP BY host_id) s
    LEFT JOIN (SELECT host_id, CAST(incident AS BIGINT) AS incident FROM {_INCIDENTS_SQL} WHERE ended_at IS NULL) i ON s.host_id = i.host_id""",
    "score_series",
)
def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest score and open incident of each host."""
    latest = fixture(spark, sf_dir, "score_series").groupBy("host_id").agg(F.max("ts").alias("ts"), F.round(F.max_by("risk_raw", "ts"), 6).alias("risk_raw"))
    open_ = incidents_of(spark, sf_dir).filter("ended_at IS NULL").select("host_id", F.col("incident").alias("open_incident"))
    return latest.join(open_, "host_id", "left")


@query(f"SELECT s.host_id, s.ts, count(i.incident) AS incidents FROM score_series s LEFT JOIN {_INCIDENTS_SQL} i ON s.host_id = i.host_id AND s.ts >= i.started_at AND s.ts <= coalesce(i.ended_at, 1e12) WHERE s.ts >= 1704070000 GROUP BY s.host_id, s.ts", "score_series")
def timeline_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixture(spark, sf_dir, "score_series").filter("ts >= 1704070000").select("host_id", "ts")
    inside = interval_join(s, incidents_of(spark, sf_dir), "ts", "started_at", "ended_at").groupBy("host_id", "ts").agg(F.count("*").alias("n"))
    return s.join(inside, ["host_id", "ts"], "left").select("host_id", "ts", F.coalesce("n", F.lit(0)).alias("incidents"))


@query(
    f"""SELECT l.host_id, l.window_id, max(i.incident) AS incident FROM (SELECT host_id, window_id, end_ts AS at FROM bad_windows) l
    LEFT JOIN (SELECT host_id, CAST(incident AS BIGINT) AS incident, started_at, ended_at FROM {_INCIDENTS_SQL}) i ON l.host_id = i.host_id AND i.started_at <= l.at AND (i.ended_at IS NULL OR l.at < i.ended_at) GROUP BY 1, 2""",
    "score_series bad_windows",
)
def label_attach_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label goes to the newest incident that is open at its time."""
    labels = fixture(spark, sf_dir, "bad_windows").select("host_id", "window_id", F.col("end_ts").alias("at"))
    found = interval_join(labels, incidents_of(spark, sf_dir), "at", "started_at", "ended_at").filter("ended_at IS NULL OR at < ended_at")
    newest = found.groupBy("host_id", "window_id").agg(F.max_by("incident", "started_at").alias("incident"))
    return labels.join(newest, ["host_id", "window_id"], "left").select("host_id", "window_id", "incident")


RISE_COOLDOWN = 120
_RISES = f"(SELECT host_id, ts, row_number() OVER (PARTITION BY host_id ORDER BY ts) AS i FROM (SELECT host_id, ts, rank, lag(rank) OVER (PARTITION BY host_id ORDER BY ts) AS before FROM {SCORED_SQL}) WHERE rank > before AND rank >= 1)"


@query(
    f"""SELECT host_id, ts FROM (WITH RECURSIVE r AS (SELECT * FROM {_RISES}), m AS (SELECT host_id, ts, i, ts AS last, true AS kept FROM r WHERE i = 1
    UNION ALL SELECT r.host_id, r.ts, r.i, CASE WHEN r.ts - m.last >= {RISE_COOLDOWN} THEN r.ts ELSE m.last END, r.ts - m.last >= {RISE_COOLDOWN} FROM m JOIN r ON r.host_id = m.host_id AND r.i = m.i + 1) SELECT * FROM m) WHERE kept""",
    "score_series",
)
def severity_rises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rises of severity to watch or more, at most one in RISE_COOLDOWN seconds."""
    from hostvigil.operators.models import greedy_cooldown

    rises = scored(spark, sf_dir).withColumn("before", F.lag("rank").over(by_host())).filter("rank > before AND rank >= 1")
    return greedy_cooldown(rises.select("host_id", "ts", "rank"), RISE_COOLDOWN, ["host_id"]).filter("kept").select("host_id", "ts")


BUCKETS = 48


@query(
    f"""SELECT * FROM (WITH s AS (SELECT host_id, least(100, 100 * (1 - CAST(risk_raw AS DOUBLE))) AS health, risk_raw >= 0.5 AS high, row_number() OVER (PARTITION BY host_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY host_id) AS n FROM score_series),
    b AS (SELECT host_id, n, c, CAST(floor(c * n / {BUCKETS}.0) AS BIGINT) AS lo, greatest(CAST(floor(c * n / {BUCKETS}.0) AS BIGINT) + 1, CAST(floor((c + 1) * n / {BUCKETS}.0) AS BIGINT)) AS hi FROM (SELECT DISTINCT host_id, n FROM s), (SELECT unnest(range({BUCKETS})) AS c))
    SELECT b.host_id, CAST(b.c AS BIGINT) AS bucket, round(min(s.health), 6) AS health, CAST(sum(CAST(s.high AS INT)) AS BIGINT) AS elevated FROM b JOIN s ON s.host_id = b.host_id AND s.i >= b.lo AND s.i < b.hi GROUP BY 1, 2)""",
    "score_series",
)
def timeline_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst health and the elevated readings of BUCKETS equal stretches of each host's series, of a reading at least."""
    place = F.row_number().over(by_host()) - 1
    s = fixture(spark, sf_dir, "score_series").select("host_id", F.least(F.lit(100.0), 100 * (1 - F.col("risk_raw").cast("double"))).alias("health"), (F.col("risk_raw") >= 0.5).cast("long").alias("high"), place.alias("i"), F.count("*").over(Window.partitionBy("host_id")).alias("n"))
    lo = lambda c: F.floor(c * F.col("n") / float(BUCKETS))
    # the stretches that hold a reading: with fewer readings than stretches a reading is in several
    about = F.sequence(F.greatest(F.lit(0), F.floor(F.col("i") * float(BUCKETS) / F.col("n")) - 1), F.least(F.lit(BUCKETS - 1), F.ceil((F.col("i") + 1) * float(BUCKETS) / F.col("n"))))
    dealt = s.withColumn("bucket", F.explode(about)).filter((F.col("i") >= lo(F.col("bucket"))) & (F.col("i") < F.greatest(lo(F.col("bucket")) + 1, lo(F.col("bucket") + 1))))
    return dealt.groupBy("host_id", F.col("bucket").cast("long").alias("bucket")).agg(F.round(F.min("health"), 6).alias("health"), F.sum("high").alias("elevated"))


sql_query("round_score_fields", "SELECT host_id, ts, bround(l1_anomaly, 2) AS l1_anomaly, bround(l2_anomaly, 4) AS l2_anomaly, bround(risk_raw * 100, 3) AS health FROM (SELECT host_id, ts, CAST(l1_anomaly AS DOUBLE) + 1e-7 AS l1_anomaly, l2_anomaly + 1e-7 AS l2_anomaly, risk_raw + 1e-7 AS risk_raw FROM <score_series>)", "score_series", duck={"bround(": "round_even("})
sql_query(
    "notification_text",
    "SELECT host_id, ts, concat(upper(substr(primary_layer, 1, 1)), substr(primary_layer, 2), CASE WHEN risk_raw >= 0.75 THEN ' is failing' ELSE ' is at risk' END) AS title, concat('Risk ', CAST(CAST(floor(risk_raw * 100) AS INT) AS VARCHAR(9)), '%. Try: ', CASE primary_layer WHEN 'dns' THEN 'flush_dns' WHEN 'gateway' THEN 'restart_gateway' ELSE 'wait_and_watch' END) AS body FROM <score_series> WHERE risk_raw >= 0.5",
    "score_series",
)

# ---- cards -------------------------------------------------------------------------------------------------------
# What a text may show: SQL value and decimals.
RENDERED = {
    "rssi": ("coalesce(wifi_rssi_dbm, 0)", 0), "retries": ("coalesce(wifi_tx_retry_rate, 0) * 100", 0), "link": ("coalesce(wifi_link_mbps, 0)", 0), "gw_rtt": ("coalesce(gw_rtt_ms, 0)", 0), "gw_loss": ("coalesce(gw_loss_rate, 0) * 100", 0),
    "gw_jitter": ("coalesce(gw_jitter_ms, 0)", 0), "dns_p50": ("coalesce(dns_p50_ms, 0)", 0), "dns_fail": ("coalesce(dns_fail_rate, 0) * 100", 0), "ttfb": ("coalesce(https_ttfb_ms, 0)", 0), "tls": ("coalesce(https_tls_ms, 0)", 0),
    "https_fail": ("coalesce(https_fail_rate, 0) * 100", 0), "path_extra": ("coalesce(x_path_minus_gateway_ms, 0)", 0), "remote_extra": ("coalesce(x_remote_minus_path_ms, 0)", 0), "cpu": ("coalesce(os_cpu_pct, 0)", 0), "retrans": ("coalesce(os_retrans_rate, 0) * 100", 1),
    "path_rtt": ("coalesce(path_rtt_ms, 0)", 0), "band": ("coalesce(wifi_band_ghz, 0)", 1), "risk": ("coalesce(risk_15m, 0) * 100", 0), "layer": ("layer", None), "secondary": ("coalesce(secondary_layer, 'none')", None),
}
_ABSENT = {"wifi_band_ghz": "double", "wifi_roam_count": "double", "path_changed": "double", "os_cpu_pct": "double", "risk_15m": "double", "secondary_layer": "string"}


def template_sql(layer: str) -> str:
    """Template id: for each layer the first that holds, the most specific first; 'os.generic' for any other layer."""
    out = []
    for x in LAYERS:
        for t in sorted((t for t in TEMPLATES if t[1] == x), key=lambda t: -t[2]):
            out.append(f"WHEN {layer} = '{x}' AND ({t[3]}) THEN '{t[0]}'")
    return f"CASE {' '.join(out)} ELSE 'os.generic' END"


def _shown(name: str) -> str:
    value, places = RENDERED[name]
    if places is None:
        return value
    return f"CAST(bround({value} + 1e-7, 1) AS VARCHAR(30))" if places else f"CAST(CAST(bround({value} + 1e-7, 0) AS BIGINT) AS VARCHAR(30))"


def render_sql(template: str) -> str:
    """The template's text with its values put in."""
    out = []
    for t, body in TEXTS.items():
        parts, rest = [], body
        while "{" in rest:
            a, rest = rest.split("{", 1)
            name, rest = rest.split("}", 1)
            parts += [f"'{a}'", _shown(name)]
        out.append(f"WHEN '{t}' THEN concat({', '.join([*parts, f'{chr(39)}{rest}{chr(39)}'])})")
    return f"CASE {template} {' '.join(out)} END"


def remediations_sql(template: str) -> str:
    return f"CASE {template} " + " ".join(f"WHEN '{t[0]}' THEN '{' '.join(REMEDIATIONS[r] for r in t[4][:3])}'" for t in TEMPLATES) + " END"


def cards(frames: DataFrame, layer: str) -> DataFrame:
    """template_id, summary, remediation of every frame for the layer in column `layer`."""
    for c, kind in _ABSENT.items():
        if c not in frames.columns:
            frames = frames.withColumn(c, F.lit(None).cast(kind))
    if layer != "layer":
        frames = frames.withColumn("layer", F.col(layer))
    f = derive_cross_layer(frames).withColumn("template_id", F.expr(template_sql("layer")))
    by_template = lambda texts: F.element_at(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]), F.col("template_id"))
    advice = {t[0]: " ".join(REMEDIATIONS[r] for r in t[4][:3]) for t in TEMPLATES}
    return f.withColumn("summary", F.expr(render_sql("template_id"))).withColumns({"title": by_template(TITLES), "remediation": by_template(advice)})


#: What a card shows of a rule or a feature.
EVIDENCE = "array<struct<name string, value double, unit string, comparison string>>"


def evidence(layer: Column, hits: Column, features: list[str], contributions: list[Column]) -> Column:
    """The layer's rules, then its features by contribution until there are four, but one feature at least if any is off.

    `contributions` are in the order of `features`; the features' values are columns of these names. Only the features of the
    frame's layer that are off are looked at."""
    rules = F.transform(F.filter(hits, lambda h: h["layer"] == layer), lambda h: F.struct(h["rule"].alias("name"), h["floor"].alias("value"), F.lit("risk").alias("unit"), h["severity"].alias("comparison")))
    unit = {f[0]: f[2] for f in FEATURES}
    each: dict[str, list[Column]] = {}
    for f, c in zip(features, contributions):
        told = F.struct((-c).alias("c"), F.lit(f).alias("name"), F.round(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), 3).alias("value"), F.lit(unit[f]).alias("unit"))
        each.setdefault(LAYER_OF[f], []).append(F.when(c > 0, told))
    mine = F.array().cast("array<struct<c: double, name: string, value: double, unit: string>>")
    for x, rows in each.items():
        mine = F.when(layer == x, F.array(*rows)).otherwise(mine)
    shown = F.transform(F.array_sort(F.array_compact(mine)), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), x["unit"].alias("unit"), F.concat(F.format_number(-x["c"], 1), F.lit(" over the usual range")).alias("comparison")))
    return F.concat(rules, F.slice(shown, F.lit(1), F.greatest(F.lit(1), 4 - F.size(rules)))).cast(EVIDENCE)


#: What an incident tells as of its last escalation that had a card, and as of its opening.
TOLD = ["primary_layer", "template_id", "title", "summary", "evidence", "remediation"]
OPENED_WITH = ["secondary_layer", "confidence"]


def incident_table(frames: DataFrame) -> DataFrame:
    """A row an incident from frames with host_id, ts, incident, opened, closed, rises (a more severe frame with a card),
    blind, rank, risk and the columns of a card. Frames that measure next to nothing don't count."""
    some = [c for c in TOLD if c in frames.columns]
    first = [c for c in OPENED_WITH if c in frames.columns]
    out = frames.filter("incident IS NOT NULL AND NOT blind").groupBy("host_id", "incident").agg(
        F.min("ts").alias("started_at"),
        F.max(F.when(F.col("closed"), F.col("ts"))).alias("ended_at"),
        F.max("risk").alias("peak_risk"),
        F.max("rank").alias("rank"),
        F.max_by(F.struct(*some), F.when(F.col("rises"), F.col("ts"))).alias("_card"),
        *([F.max_by(F.struct(*first), F.when(F.col("opened"), F.col("ts"))).alias("_first")] if first else []),
    )
    return out.select("host_id", "incident", "started_at", "ended_at", "peak_risk", severity_name(F.col("rank")).alias("severity"), *[F.col(f"_card.{c}").alias(c) for c in some], *[F.col(f"_first.{c}").alias(c) for c in first])


_LAYER = "CASE WHEN wifi_rssi_dbm <= -75 THEN 'wifi' WHEN dns_fail_rate >= 0.5 THEN 'dns' WHEN gw_loss_rate >= 0.5 THEN 'gateway' WHEN https_ttfb_ms >= 300 THEN 'remote_https' WHEN path_rtt_ms >= 150 THEN 'path' ELSE 'os' END"
from hostvigil.operators.frames import DERIVED_SQL  # noqa: E402

_CARD_FRAME = f"(SELECT *, {_LAYER} AS layer, {', '.join(f'CAST(NULL AS {dict(double="DOUBLE", string="VARCHAR")[kind]}) AS {c}' for c, kind in _ABSENT.items())}, {', '.join(f'{x} AS {k}' for k, x in DERIVED_SQL.items())} FROM {FRAME_SQL})"
_CARD = f"(SELECT *, {render_sql('template_id')} AS summary, {remediations_sql('template_id')} AS remediation FROM (SELECT *, {template_sql('layer')} AS template_id FROM {_CARD_FRAME}))".replace("bround(", "round_even(")


def _card_query(name: str, columns: list[str]) -> None:
    @query(f"SELECT host_id, tick, {', '.join(columns)} FROM {_CARD}", "samples_sparse", name=name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cards(frames_of(spark, sf_dir).withColumn("layer", F.expr(_LAYER)), "layer").select("host_id", "tick", *columns)


_card_query("template_select", ["layer", "template_id"])
_card_query("template_render", ["summary"])
_card_query("remediation_lookup", ["template_id", "remediation"])
assert set(TEXTS) == set(TITLES) == {t[0] for t in TEMPLATES} and len(SEVERITIES) == 4 and SPARSE


@query(f"SELECT host_id, CAST(incident AS BIGINT) AS incident, started_at FROM {_INCIDENTS_SQL} WHERE ended_at IS NULL", "score_series")
def active_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents_of(spark, sf_dir).filter("ended_at IS NULL").select("host_id", "incident", "started_at")


@query(f"SELECT host_id, CAST(incident AS BIGINT) AS incident, started_at, ended_at FROM {_INCIDENTS_SQL} WHERE incident = 1", "score_series")
def get_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incident of a given number, for every host."""
    return incidents_of(spark, sf_dir).filter("incident = 1").select("host_id", "incident", "started_at", "ended_at")
