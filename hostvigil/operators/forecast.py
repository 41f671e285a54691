"""The forecast: 67 inputs in a fixed order, a logistic model a horizon, training, and what a card shows as evidence."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvigil.catalogue import DERIVED, LAYER_OF, LAYERS, MODELLED, RULES, TRENDS
from hostvigil.operators.frames import DERIVED_SQL, FRAME_SQL, OFF_TIES, SPARSE, coverage_sql, derive_cross_layer, frames_of, rolling, with_rules
from hostvigil.operators.models import TOY_COLUMNS
from hostvigil.operators.saved import layout_of
from hostvigil.registry import query
from hostvigil.sources.fixtures import fixture
from hostvigil.sources.scratch import materialize, scratch_path

# The inputs in order, and the horizons in minutes.
LAYOUT = ["l1_anomaly", "l2_anomaly", "coverage", *[f"l1_{x}" for x in LAYERS], *[f"l2_{x}" for x in LAYERS], *[f"{f}_{s}" for f in TRENDS for s in ("5m_z", "5m_slope_n", "15m_z")], *DERIVED, "vpn_active", "captive_portal", "on_battery", "is_wifi"]
HORIZONS = (5, 15)


def clipped(x: Column, limit: float) -> Column:
    """Null, NaN and infinities are 0, the rest is clipped."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), x)))


def vector(frames: DataFrame) -> dict[str, Column]:
    """The inputs of LAYOUT from frames with anomalies, rolling statistics and ratios; absent columns count as 0."""
    have = set(frames.columns)
    col = lambda c, other=0.0: F.coalesce(F.col(c).cast("double"), F.lit(other)) if c in have else F.lit(other)
    out = {c: col(c) for c in LAYOUT[: 3 + 2 * len(LAYERS)]}
    for f in TRENDS:
        out[f"{f}_5m_z"] = clipped(col(f"{f}_5m_z"), 12.0)
        out[f"{f}_5m_slope_n"] = clipped(col(f"{f}_5m_slope") / F.greatest(F.abs(col(f"{f}_5m_mean")), F.lit(1e-3)), 20.0)
        out[f"{f}_15m_z"] = clipped(col(f"{f}_15m_z"), 12.0)
    out |= {c: clipped(col(c), 1000.0) for c in DERIVED}
    out |= {"vpn_active": col("vpn_active"), "captive_portal": col("captive_portal"), "on_battery": col("os_on_battery"), "is_wifi": (col("os_iface_type", 2.0) == 1.0).cast("double")}
    return {c: out[c] for c in LAYOUT}


class Forecast:
    """A logistic model of one horizon over standardised inputs."""

    def __init__(self, weights: list[float], bias: float, mean: list[float], scale: list[float], layout: list[str] = LAYOUT):
        if layout != LAYOUT:
            raise ValueError("the model was trained on other inputs or another order of them; train it again")
        self.weights, self.bias, self.mean, self.scale = list(weights), bias, list(mean), list(scale)

    def parts(self, inputs: dict[str, Column]) -> list[Column]:
        """What each input adds to the logit."""
        return [(x - F.lit(m)) / F.lit(s) * F.lit(w) for x, w, m, s in zip(inputs.values(), self.weights, self.mean, self.scale, strict=True)]

    def risk(self, inputs: dict[str, Column]) -> Column:
        logit = F.aggregate(F.array(*self.parts(inputs)), F.lit(0.0), lambda a, x: a + x) + F.lit(self.bias)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))

    def to_dict(self) -> dict:
        return {"layout": LAYOUT, "weights": self.weights, "bias": self.bias, "mean": self.mean, "scale": self.scale}


def heuristic_risk(frames: DataFrame, horizon: int) -> Column:
    """The forecast without a model: the anomalies now, and the steepest relative climb of a trend."""
    have = set(frames.columns)
    climbs = [F.when(F.abs(F.col(f"{f}_5m_mean")) > 1e-6, F.col(f"{f}_5m_slope") / F.abs(F.col(f"{f}_5m_mean"))) for f in TRENDS if f"{f}_5m_slope" in have]
    trend = F.coalesce(F.greatest(*climbs, F.lit(0.0)), F.lit(0.0)) if climbs else F.lit(0.0)
    base = 0.6 * F.col("l1_anomaly") + 0.4 * F.col("l2_anomaly")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (0.7 * base + 0.3 * F.least(F.lit(1.0), trend / 0.10)) * (1.0 if horizon >= 15 else 0.85)))


def predict(frames: DataFrame, models: dict[int, Forecast]) -> dict[str, Column]:
    """l3_5m and l3_15m: of each horizon's model, or the heuristic where there is none."""
    inputs = vector(frames) if models else {}
    return {f"l3_{h}m": models[h].risk(inputs) if h in models else heuristic_risk(frames, h) for h in HORIZONS}


# ---- queries over frames with anomalies that are given -----------------------------------------------------------------
_GIVEN = {"l1_anomaly": "CAST(tick % 10 AS DOUBLE) / 10", "l2_anomaly": "CAST(tick % 7 AS DOUBLE) / 10"} | {k: v for k, v in TOY_COLUMNS.items() if k[:3] in ("l1_", "l2_")}


def forecast_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = rolling(frames_of(spark, sf_dir), TRENDS)
    return derive_cross_layer(frames.withColumns({k: F.expr(v) for k, v in (_GIVEN | {"coverage": coverage_sql(SPARSE)["coverage"]}).items()}))


def _sql_clip(x: str, limit: float) -> str:
    return f"CASE WHEN ({x}) IS NULL OR isnan({x}) OR isinf({x}) THEN 0 ELSE least({limit}, greatest(-{limit}, {x})) END"


def _vector_oracle() -> str:
    """The inputs in DuckDB's own words, from the frames' windows; and the steepest relative climb of a frame."""
    rolled, terms, climbs = [], {}, []
    for f in TRENDS:
        t = f"CASE WHEN fresh_{f} IS NOT NULL THEN minute END"
        for name, w in (("5", "w300"), ("15", "w900")):
            n = f"count(fresh_{f}) OVER {w}"
            rolled.append(f"CASE WHEN {f} IS NOT NULL AND {n} > 0 THEN CASE WHEN {n} >= 4 THEN ({f} - avg(fresh_{f}) OVER {w}) / greatest(coalesce(stddev_samp(fresh_{f}) OVER {w}, 0), 1e-6, 0.02 * abs(avg(fresh_{f}) OVER {w})) ELSE 0 END END AS z{name}_{f}")
        n = f"count(fresh_{f}) OVER w300"
        alive = f"{f} IS NOT NULL AND {n} > 0"
        rolled += [f"CASE WHEN {alive} THEN CASE WHEN {n} >= 3 AND var_pop({t}) OVER w300 * {n} > 1e-9 THEN covar_pop(fresh_{f}, minute) OVER w300 / var_pop({t}) OVER w300 ELSE 0 END END AS s_{f}", f"CASE WHEN {alive} THEN abs(avg(fresh_{f}) OVER w300) END AS m_{f}"]
        climbs.append(f"CASE WHEN m_{f} > 1e-6 THEN s_{f} / m_{f} END")
        slope = f"(s_{f} / greatest(m_{f}, 1e-3))"
        terms |= {f"{f}_5m_z": _sql_clip(f"z5_{f}", 12.0), f"{f}_5m_slope_n": _sql_clip(slope, 20.0), f"{f}_15m_z": _sql_clip(f"z15_{f}", 12.0)}
    given = {c: f"coalesce({c}, 0)" for c in LAYOUT[: 3 + 2 * len(LAYERS)]}
    flags = {"vpn_active": "coalesce(vpn_active, 0)", "captive_portal": "coalesce(captive_portal, 0)", "on_battery": "0", "is_wifi": "0"}
    terms = given | terms | {c: _sql_clip(c, 1000.0) for c in DERIVED} | flags
    columns = ", ".join(f"{v} AS {k}" for k, v in (_GIVEN | {"coverage": coverage_sql(SPARSE)["coverage"]} | DERIVED_SQL).items())
    windows = ", ".join(f"w{s} AS (PARTITION BY host_id ORDER BY ts RANGE BETWEEN {s} PRECEDING AND CURRENT ROW)" for s in (300, 900))
    frames = f"(SELECT *, {columns}, (ts - min(ts) OVER (PARTITION BY host_id)) / 60.0 AS minute FROM {FRAME_SQL})"
    return f"(SELECT host_id, tick, ts, greatest(0, {', '.join(climbs)}) AS climb, {', '.join(f'CAST({terms[c]} AS DOUBLE) AS {c}' for c in LAYOUT)} FROM (SELECT *, {', '.join(rolled)} FROM {frames} WINDOW {windows}))"


_VECTOR = _vector_oracle()
_ROUNDED = ", ".join(f"round({c} + {OFF_TIES}, 5) AS {c}" for c in LAYOUT)


@query(f"SELECT host_id, tick, {_ROUNDED} FROM {_VECTOR}", "samples_sparse")
def l3_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 67 inputs of the forecast."""
    f = forecast_frames(spark, sf_dir)
    return f.select("host_id", "tick", *[F.round(x + OFF_TIES, 5).alias(c) for c, x in vector(f).items()])


def example_model() -> Forecast:
    """A model by rule, for queries that predict with given weights: training gives real ones (`l3_train`)."""
    n = len(LAYOUT)
    return Forecast([((7 * k) % 19 - 9) / 60 for k in range(n)], -0.3, [(k % 5) / 10 for k in range(n)], [1.0 + (k % 3) for k in range(n)])


_SHARES = [f"(({c}) - {m}) / {s} * {w}" for c, w, m, s in zip(LAYOUT, example_model().weights, example_model().mean, example_model().scale)]
_HEURISTIC = "least(1, greatest(0, (0.7 * (0.6 * l1_anomaly + 0.4 * l2_anomaly) + 0.3 * least(1, climb / 0.10)) * {gain}))"


@query(f"SELECT host_id, tick, round(1 / (1 + exp(-least(30, greatest(-30, {' + '.join(_SHARES)} - 0.3)))) + {OFF_TIES}, 5) AS risk_15m, round({_HEURISTIC.format(gain=0.85)} + {OFF_TIES}, 5) AS risk_5m FROM {_VECTOR}", "samples_sparse")
def l3_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a model of the 15-minute horizon only: the other falls back to the heuristic."""
    f = forecast_frames(spark, sf_dir)
    p = predict(f, {15: example_model()})
    return f.select("host_id", "tick", F.round(p["l3_15m"] + OFF_TIES, 5).alias("risk_15m"), F.round(p["l3_5m"] + OFF_TIES, 5).alias("risk_5m"))


@query(f"SELECT host_id, tick, round({_HEURISTIC.format(gain=1)} + {OFF_TIES}, 5) AS risk_15m FROM {_VECTOR}", "samples_sparse", name="heuristic_risk")
def _heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecast_frames(spark, sf_dir)
    return f.select("host_id", "tick", F.round(heuristic_risk(f, 15) + OFF_TIES, 5).alias("risk_15m"))


_PAIRS = " UNION ALL ".join(f"SELECT host_id, tick, '{c}' AS input, {x} AS c FROM v" for c, x in zip(LAYOUT, _SHARES))


@query(f"SELECT host_id, tick, CAST(rank AS BIGINT) AS rank, input FROM (SELECT host_id, tick, input, row_number() OVER (PARTITION BY host_id, tick ORDER BY round(abs(c), 7) DESC, input) AS rank FROM (WITH v AS (SELECT * FROM {_VECTOR}) {_PAIRS})) WHERE rank <= 5", "samples_sparse")
def top_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five inputs that move a frame's forecast most."""
    f = forecast_frames(spark, sf_dir)
    f = f.select("host_id", "tick", *[x.alias(c) for c, x in vector(f).items()])
    parts = example_model().parts({c: F.col(c) for c in LAYOUT})
    ranked = F.slice(F.array_sort(F.array(*[F.struct((-F.round(F.abs(p), 7)).alias("size"), F.lit(c).alias("input")) for c, p in zip(LAYOUT, parts)])), 1, 5)
    return f.select("host_id", "tick", F.posexplode(ranked).alias("rank", "e")).select("host_id", "tick", (F.col("rank") + 1).cast("long").alias("rank"), "e.input")


_BAD = "CAST(EXISTS (SELECT 1 FROM bad_windows b WHERE b.host_id = v.host_id AND v.ts <= b.end_ts AND b.start_ts <= v.ts + {s}) AS INT)"


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host_id, tick, side, y_5, y_15 and the inputs of every frame after the warm-up."""
    from hostvigil.plans.evaluation import label_horizon

    f = forecast_frames(spark, sf_dir)
    rows = materialize(f.select("host_id", "tick", "ts", *[x.alias(c) for c, x in vector(f).items()]).filter("tick > 120"))
    windows = fixture(spark, sf_dir, "bad_windows")
    for h in HORIZONS:
        rows = label_horizon(rows, windows, 60.0 * h).withColumnRenamed("label", f"y_{h}")
    return rows.withColumn("side", F.when(F.col("host_id") % 4 == 0, "holdout").otherwise("train")).select("host_id", "tick", "side", "y_5", "y_15", *LAYOUT)


@query(f"SELECT host_id, tick, CASE WHEN host_id % 4 = 0 THEN 'holdout' ELSE 'train' END AS side, {_BAD.format(s=300)} AS y_5, {_BAD.format(s=900)} AS y_15, {_ROUNDED} FROM {_VECTOR} v WHERE tick > 120", "samples_sparse bad_windows")
def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_rows(spark, sf_dir).select("host_id", "tick", "side", "y_5", "y_15", *[F.round(F.col(c) + OFF_TIES, 5).alias(c) for c in LAYOUT])


def train(rows: DataFrame, label: str) -> Forecast:
    """Class-weighted logistic regression over standardised inputs; the bias is corrected for the weighting."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    moments = rows.agg(F.count("*").alias("n"), F.sum(label).alias("y"), *[F.avg(c).alias(f"m_{c}") for c in LAYOUT], *[F.stddev_pop(c).alias(f"s_{c}") for c in LAYOUT]).first()
    n, positive = float(moments["n"]), float(moments["y"] or 0)
    mean = [moments[f"m_{c}"] or 0.0 for c in LAYOUT]
    scale = [s if s and s >= 1e-6 else 1.0 for s in (moments[f"s_{c}"] for c in LAYOUT)]
    if not 0 < positive < n:  # nothing to tell apart
        return Forecast([0.0] * len(LAYOUT), 30.0 if n and positive == n else -30.0, mean, scale)
    weight = (n - positive) / positive
    ready = rows.select(F.col(label).cast("double").alias("y"), F.when(F.col(label) == 1, weight).otherwise(1.0).alias("w"), *[((F.col(c) - m) / s).alias(c) for c, m, s in zip(LAYOUT, mean, scale)])
    model = LogisticRegression(labelCol="y", weightCol="w", regParam=1e-3, standardization=False, maxIter=60).fit(VectorAssembler(inputCols=LAYOUT, outputCol="features").transform(ready))
    return Forecast([float(x) for x in model.coefficients], float(model.intercept) - math.log(weight), mean, scale)


_MODEL = "horizon int, layout string, input array<string>, weight array<double>, mean array<double>, scale array<double>, bias double"


def save_models(spark: SparkSession, models: dict[int, Forecast], path: str) -> None:
    """A row a horizon, with the inputs in order and a digest of them."""
    rows = [(h, layout_of("forecast", LAYOUT), LAYOUT, m.weights, m.mean, m.scale, m.bias) for h, m in models.items()]
    spark.createDataFrame(rows, _MODEL).coalesce(1).write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> dict[int, Forecast]:
    """The saved models by horizon; those of other inputs, of another order or another version are refused."""
    rows = spark.read.schema(_MODEL).parquet(path).collect()  # a row a horizon
    if any(r["layout"] != layout_of("forecast", LAYOUT) for r in rows):
        raise ValueError("the models were trained on other inputs or another order of them; train them again")
    return {r["horizon"]: Forecast(r["weight"], r["bias"], r["mean"], r["scale"], r["input"]) for r in rows}


def observed_training_rows(samples: DataFrame, have: list[str], windows: DataFrame) -> DataFrame:
    """As `training_rows`, with the anomalies that the learned stages found in these samples."""
    from hostvigil.operators.hosts import WARM_AFTER
    from hostvigil.operators.models import judged_frames
    from hostvigil.plans.evaluation import label_horizon

    f = judged_frames(samples, have)
    rows = materialize(f.select("host_id", "tick", "ts", *[x.alias(c) for c, x in vector(f).items()]).filter(F.col("tick") > WARM_AFTER))
    for h in HORIZONS:
        rows = label_horizon(rows, windows, 60.0 * h).withColumnRenamed("label", f"y_{h}")
    return rows.withColumn("side", F.when(F.col("host_id") % 4 == 0, "holdout").otherwise("train"))


def train_all(rows: DataFrame) -> dict[int, Forecast]:
    """A model a horizon from the training hosts."""
    return {h: train(rows.filter("side = 'train'"), f"y_{h}") for h in HORIZONS}


def measured(model: Forecast, rows: DataFrame, label: str) -> DataFrame:
    """One row: n, brier, ece (ten equal bins), precision_ and recall at one half, of labelled rows."""
    p = rows.select(model.risk({c: F.col(c) for c in LAYOUT}).alias("p"), F.col(label).cast("double").alias("y"))
    hit = (F.col("p") >= 0.5).cast("double")
    bins = p.withColumns({"hit": hit, "bin": F.least(F.lit(9), F.floor(F.col("p") * 10))}).groupBy("bin").agg(F.count("*").alias("n"), F.sum("p").alias("p"), F.sum("y").alias("y"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("e"), F.sum("hit").alias("hit"), F.sum(F.col("hit") * F.col("y")).alias("both"))
    share = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0))
    return bins.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), share("e", "n").alias("brier"), share(F.abs(F.col("p") - F.col("y")), F.col("n")).alias("ece"), share("both", "hit").alias("precision_"), share("both", "y").alias("recall"))


@query()
def l3_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of the anomalies found in the view, saved and loaded again; metrics on the holdout hosts and the twelve
    heaviest inputs."""
    rows = materialize(observed_training_rows(fixture(spark, sf_dir, "samples_sparse"), SPARSE, fixture(spark, sf_dir, "bad_windows")))
    path = scratch_path(spark, "forecast")
    save_models(spark, train_all(rows), path)
    out = []
    for h, model in sorted(load_models(spark, path).items()):
        top = np.argsort(-np.abs(model.weights))[:12].tolist()
        heaviest = F.lit(", ".join(f"{LAYOUT[k]} {model.weights[k]:.3f}" for k in top)).alias("heaviest")
        out.append(measured(model, rows.filter("side = 'holdout'"), f"y_{h}").select(F.lit(h).alias("horizon"), "*", heaviest))
    return out[0].unionByName(out[1])


# ---- evidence ---------------------------------------------------------------------------------------------------------
def evidence(layer: Column, hits: Column, contributions: list[tuple[str, Column]]) -> Column:
    """What a card shows: the layer's rules, then its features by contribution until there are four, but one at least."""
    rules = F.transform(F.filter(hits, lambda h: h["layer"] == layer), lambda h: h["rule"])
    mine = F.filter(F.array(*[F.struct((-c).alias("c"), F.lit(f).alias("f"), F.lit(LAYER_OF[f]).alias("layer")) for f, c in contributions]), lambda x: (x["c"] < 0) & (x["layer"] == layer))
    ranked = F.transform(F.array_sort(mine), lambda x: x["f"])
    return F.concat(rules, F.slice(ranked, F.lit(1), F.greatest(F.lit(1), 4 - F.size(rules))))


_PULL = {f: f"CAST(round(CASE WHEN {f} IS NULL THEN 0 ELSE abs({f}) - floor(abs({f}) / 3) * 3 - 1 END, 6) AS DOUBLE)" for f in SPARSE if f in MODELLED}
_AT = f"{LAYERS!r}[CAST(tick % {len(LAYERS)} AS INT) + 1]"


def _evidence_oracle() -> str:
    rules = " UNION ALL ".join(f"SELECT host_id, tick, 0 AS kind, {k} AS place, CAST(0 AS DOUBLE) AS c, '{r.id}' AS name FROM f WHERE ({r.condition}) AND ({r.layer}) = at_" for k, r in enumerate(RULES))
    pulls = " UNION ALL ".join(f"SELECT host_id, tick, 1, 0, -({x}), '{f}' FROM f WHERE ({x}) > 0 AND '{LAYER_OF[f]}' = at_" for f, x in _PULL.items())
    return f"""WITH f AS (SELECT *, {_AT} AS at_ FROM {FRAME_SQL}), e AS ({rules} UNION ALL {pulls}), n AS (SELECT *, row_number() OVER (PARTITION BY host_id, tick, kind ORDER BY place, c, name) AS rank, count(*) FILTER (WHERE kind = 0) OVER (PARTITION BY host_id, tick) AS rules FROM e)
    SELECT f.host_id, f.tick, f.at_ AS layer, coalesce(string_agg(n.name, ',' ORDER BY kind, rank), '') AS evidence FROM f LEFT JOIN n ON n.host_id = f.host_id AND n.tick = f.tick AND (kind = 0 OR rank <= greatest(1, 4 - rules)) GROUP BY 1, 2, 3"""


@query(f"SELECT * FROM ({_evidence_oracle()})", "samples_sparse")
def evidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of every frame for a layer and contributions that are given."""
    f = with_rules(frames_of(spark, sf_dir)).withColumn("at_", F.element_at(F.array(*[F.lit(x) for x in LAYERS]), (F.col("tick") % len(LAYERS) + 1).cast("int")))
    return f.select("host_id", "tick", F.col("at_").alias("layer"), F.array_join(evidence(F.col("at_"), F.col("hits"), [(k, F.expr(v)) for k, v in _PULL.items()]), ",").alias("evidence"))
