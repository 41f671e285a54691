"""Cards and incidents of given scores: the score view tells severity and layer, the sparse view what was measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostvigil.catalogue import LAYER_OF, REMEDIATIONS, RULES, TEMPLATES, TEXTS, TITLES
from hostvigil.operators.forecast import _PULL
from hostvigil.operators.frames import DERIVED_SQL, FRAME_SQL, frames_of, severity_name, with_rules
from hostvigil.operators.incidents import _ABSENT, _INCIDENTS_SQL, RENDERED, SCORED_SQL, STATES_SQL, alert_runs, cards, evidence, hysteresis, incident_table, scored
from hostvigil.registry import query

_TOLD = ["title", "template_id", "summary", "remediation"]


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the card and the evidence of each frame."""
    f = with_rules(frames_of(spark, sf_dir))
    s = scored(spark, sf_dir).select("host_id", "tick", "risk", "rank", "blind", "primary_layer", F.lit(None).cast("string").alias("secondary_layer"))
    f = f.join(s, ["host_id", "tick"])
    f = f.withColumn("evidence", evidence(F.col("primary_layer"), F.col("hits"), list(_PULL), [F.expr(x) for x in _PULL.values()]))
    return cards(f, "primary_layer")


# The oracle picks the template by the highest of those that hold, puts values in one after the other, and ranks evidence
# as rows.
def _cards_sql(frames: str) -> str:
    """host_id, tick and the card of each row of `frames`, which has measured values, ratios and `layer`."""
    holds = " UNION ALL ".join(f"SELECT host_id, tick, '{t[0]}' AS id, {100 * t[2] - k} AS place FROM b WHERE layer = '{t[1]}' AND ({t[3]})" for k, t in enumerate(TEMPLATES))
    rows = ", ".join(f"('{t[0]}', '{TITLES[t[0]]}', '{TEXTS[t[0]]}', '{' '.join(REMEDIATIONS[r] for r in t[4][:3])}')" for t in TEMPLATES)
    text = "body"
    for name, (value, places) in RENDERED.items():
        shown = value if places is None else f"CAST(round_even({value} + 1e-7, 1) AS VARCHAR)" if places else f"CAST(CAST(round_even({value} + 1e-7, 0) AS BIGINT) AS VARCHAR)"
        text = f"replace({text}, '{{{name}}}', {shown})"
    rules = " UNION ALL ".join(f"SELECT host_id, tick, 0 AS kind, CAST({k} AS DOUBLE) AS place, '{r.id}' AS name, CAST({r.floor} AS DOUBLE) AS value FROM b WHERE ({r.condition}) AND ({r.layer}) = layer" for k, r in enumerate(RULES))
    pulls = " UNION ALL ".join(f"SELECT host_id, tick, 1, -({x}), '{f}', round(coalesce({f}, 0), 3) FROM b WHERE ({x}) > 0 AND layer = '{LAYER_OF[f]}'" for f, x in _PULL.items())
    return f"""(WITH b AS MATERIALIZED ({frames}), e AS ({rules} UNION ALL {pulls}),
      r AS (SELECT *, row_number() OVER (PARTITION BY host_id, tick, kind ORDER BY place, name) AS rank, count(*) FILTER (WHERE kind = 0) OVER (PARTITION BY host_id, tick) AS rules FROM e),
      shown AS (SELECT host_id, tick, string_agg(concat(name, '=', CAST(round(value, 3) AS DECIMAL(18, 3))), ',' ORDER BY kind, rank) AS evidence FROM r WHERE kind = 0 OR rank <= greatest(1, 4 - rules) GROUP BY 1, 2),
      picked AS (SELECT host_id, tick, coalesce(arg_max(id, place), 'os.generic') AS template_id FROM ({holds}) GROUP BY 1, 2)
    SELECT b.host_id, b.tick, title, p.template_id, {text} AS summary, advice AS remediation, coalesce(evidence, '') AS evidence FROM b JOIN picked p ON p.host_id = b.host_id AND p.tick = b.tick
    JOIN (VALUES {rows}) AS t(template_id, title, body, advice) ON t.template_id = p.template_id LEFT JOIN shown s ON s.host_id = b.host_id AND s.tick = b.tick)"""


_NULLS = ", ".join(f"CAST(NULL AS {dict(double='DOUBLE', string='VARCHAR')[kind]}) AS {c}" for c, kind in _ABSENT.items())
_MEASURED = f"SELECT f.*, {_NULLS}, {', '.join(f'{x} AS {k}' for k, x in DERIVED_SQL.items())}, s.primary_layer AS layer, s.rank, s.risk, s.blind FROM {FRAME_SQL} f JOIN {SCORED_SQL} s ON s.host_id = f.host_id AND s.tick = f.tick"


def _joined_evidence() -> Column:
    return F.array_join(F.transform("evidence", lambda e: F.concat(e["name"], F.lit("="), e["value"].cast("decimal(18,3)").cast("string"))), ",").alias("evidence")


@query(f"SELECT c.host_id, c.tick, ['info', 'watch', 'risk', 'critical'][s.rank + 1] AS severity, c.title, c.template_id, c.summary, c.remediation, c.evidence FROM {_cards_sql(_MEASURED + ' WHERE NOT s.blind AND s.rank >= 1')} c JOIN {SCORED_SQL} s ON s.host_id = c.host_id AND s.tick = c.tick", "samples_sparse score_series")
def incident_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of frames of severity watch or more that measure enough and have a layer to blame."""
    f = told(spark, sf_dir).filter(~F.col("blind") & F.col("primary_layer").isNotNull() & (F.col("rank") >= 1))
    return f.select("host_id", "tick", severity_name(F.col("rank")).alias("severity"), *_TOLD, _joined_evidence())


_RISEN = f"(SELECT host_id, incident, max(ts) AS ts FROM (SELECT *, max(rank) OVER (PARTITION BY host_id, incident ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {STATES_SQL} WHERE incident IS NOT NULL AND NOT blind) WHERE rank > coalesce(before, -1) GROUP BY 1, 2)"


@query(
    f"""SELECT * FROM (WITH risen AS MATERIALIZED {_RISEN} SELECT i.host_id, CAST(i.incident AS BIGINT) AS incident, i.started_at, i.ended_at, round(i.peak_risk, 6) AS peak_risk, ['info', 'watch', 'risk', 'critical'][i.rank + 1] AS severity, i.primary_layer, c.title, c.template_id, c.summary, c.remediation, c.evidence
    FROM {_INCIDENTS_SQL} i JOIN risen r ON r.host_id = i.host_id AND r.incident = i.incident JOIN samples_sparse x ON x.host_id = r.host_id AND x.ts = r.ts JOIN {_cards_sql(_MEASURED + ' WHERE f.ts IN (SELECT ts FROM risen)')} c ON c.host_id = x.host_id AND c.tick = x.tick)""",
    "samples_sparse score_series",
)
def incident_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with their card as of the last escalation."""
    s = hysteresis(alert_runs(told(spark, sf_dir)), F.lit(True))
    top = F.max(F.when(F.col("incident").isNotNull() & ~F.col("blind"), F.col("rank")))
    before = top.over(Window.partitionBy("host_id", "incident").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("rises", ~F.col("blind") & (F.col("rank") > F.coalesce(before, F.lit(-1))))
    return incident_table(s.drop("secondary_layer")).select("host_id", "incident", "started_at", "ended_at", F.round("peak_risk", 6).alias("peak_risk"), "severity", "primary_layer", *_TOLD, _joined_evidence())

