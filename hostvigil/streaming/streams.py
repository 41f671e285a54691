"""Continuous forms of the operators: keyed state in Structured Streaming, with the step functions of the batch form.

Each registered query writes its test view as files in order of time, runs the stream over them to the end
(availableNow) and returns the sink as a table. Event time has a watermark: rows more than WATERMARK late are dropped
before they reach a state (the batch form recomputes them), and a key that is silent for IDLE_S beyond it times out,
which ends its state. A stream that is stopped goes on from its checkpoint with the states as they were.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvigil.catalogue import LAYER_OF, LAYERS
from hostvigil.operators import state as S
from hostvigil.operators.frames import FRAME_SQL, SPARSE, limit_of
from hostvigil.operators.ladder import Ladder
from hostvigil.operators.incidents import CLOSE_AFTER, OPEN_AFTER, STATES_SQL, scored
from hostvigil.operators.models import _SMOOTH_SQL, NOTIFY_COOLDOWN, held_back, noted_events
from hostvigil.registry import ORACLES, query
from hostvigil.sources.fixtures import fixture
from hostvigil.sources.scratch import materialize, scratch_path
from hostvigil.sources.store import bucket_of, exists

WATERMARK = "2 minutes"
IDLE_S = 3600
SLICES = 3
#: Rows of a file of the replayed source.
FILE_ROWS = 1_000_000


def replay(rows: DataFrame, transform: Callable[[DataFrame], DataFrame], mode: str = "append", into: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Rows as a stream in SLICES batches in order of ts; what `transform` emits, with the batch that emitted it in _batch.
    With `into` each batch goes there, and nothing comes back."""
    spark = rows.sparkSession
    source, sink, marks = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-checkpoint"))
    low, high, n = rows.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    low, high = low or 0.0, high or 0.0
    files = -(-n // (SLICES * FILE_ROWS)) or 1  # of each slice
    for k in range(SLICES):
        a, b = (low + (high - low) * x / SLICES for x in (k, k + 1))
        part = rows.filter((F.col("ts") >= a) & ((F.col("ts") < b) if k < SLICES - 1 else F.lit(True)))
        part.repartition(files).write.mode("append").parquet(source)
    stream = transform(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(source))

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{sink}/b={n}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(into or write).start()
    run.awaitTermination()
    if into:
        return None
    return spark.read.option("recursiveFileLookup", "true").parquet(sink)


def keyed(stream: DataFrame, keys: list[str], start: Callable[[], object], step, output: str, gone: Callable[[object, tuple], pd.DataFrame] | None = None, idle: Callable[[object], float] | None = None) -> DataFrame:
    """`step(state, rows by ts) -> frame` per key; the state is kept as JSON of the object's fields (or as it dumps itself).

    `gone(state, key)` gives the rows of a key that fell silent, from the second of event time that `idle(state)` names
    (by default IDLE_S after its last row); its state ends there.
    """

    def read(text: str) -> object:
        s = start()
        if hasattr(s, "loads"):
            return s.loads(text)
        for k, v in json.loads(text).items():
            setattr(s, k, v)
        return s

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            s = read(state.get[0])
            state.remove()
            if gone:
                yield gone(s, key)
            return
        s = read(state.get[0]) if state.exists else start()
        rows = pd.concat(list(parts)).sort_values("ts")
        out = step(s, rows)
        state.update((s.dumps() if hasattr(s, "dumps") else json.dumps(asdict(s)),))
        until = idle(s) if idle else float(rows["ts"].iloc[-1]) + IDLE_S
        state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))
        yield out

    timed = stream.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", WATERMARK)
    return timed.groupBy(*keys).applyInPandasWithState(run, output, "state string", "append", "EventTimeTimeout")


class HostLadder:
    """A host's learned stages as a stream's state."""

    def __init__(self, features: list[str]):
        self.features, self.ladder = features, Ladder(features)

    def dumps(self) -> str:
        return base64.b64encode(self.ladder.dump()).decode()

    def loads(self, text: str) -> HostLadder:
        self.ladder = Ladder.load(base64.b64decode(text), self.features)
        return self

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        added = self.ladder.frames(rows["ts"].to_numpy(float), rows[self.features].to_numpy(float))
        return pd.DataFrame({"host_id": rows["host_id"].to_numpy(), "tick": rows["tick"].to_numpy(), "l1": added[0], "l2_anomaly": added[5], "drifted": [",".join(d["feature"] for d in x or [] if d["drifted"]) for x in added[7]]})


def ladder_stream(stream: DataFrame, features: list[str]) -> DataFrame:
    """host_id, tick, l1 (contributions), l2_anomaly and drifted of every frame of a stream of host_id, tick, ts and features."""
    return keyed(stream, ["host_id"], lambda: HostLadder(features), lambda s, rows: s.step(rows), "host_id long, tick long, l1 array<double>, l2_anomaly double, drifted string")


def _risk_step(s: S.Risk, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for h, t, raw, floor, cover, a, b in rows[["host_id", "tick", "risk_raw", "risk_floor", "coverage", "l1_anomaly", "l2_anomaly"]].itertuples(index=False, name=None):
        risk = s.step(raw, floor, cover)
        out.append((h, t, risk, s.step_health(a, b, risk, floor)))
    return pd.DataFrame(out, columns=["host_id", "tick", "risk", "health"])


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixture(spark, sf_dir, "score_series")
    return s.select(F.col("host_id").cast("long").alias("host_id"), F.col("tick").cast("long").alias("tick"), "ts", *[F.col(c).cast("double").alias(c) for c in ("risk_raw", "risk_floor", "coverage", "l1_anomaly", "l2_anomaly")])


@query(f"SELECT host_id, tick, round(risk, 6) AS risk, round(health, 5) AS health FROM {_SMOOTH_SQL}", "score_series")
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replay(_numbers(spark, sf_dir), lambda s: keyed(s, ["host_id"], S.Risk, _risk_step, "host_id long, tick long, risk double, health double"))
    return out.select("host_id", "tick", F.round("risk", 6).alias("risk"), F.round("health", 5).alias("health"))


@query("SELECT host_id, CAST(round(ts / 300) * 300 AS BIGINT) AS bucket_ts, count(*) AS n, round(avg(gw_rtt_ms) + 1.37e-8, 6) AS gw_rtt_ms_avg, round(max(gw_rtt_ms), 6) AS gw_rtt_ms_max FROM samples_sparse GROUP BY 1, 2", "samples_sparse")
def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute windows around each multiple of 300 s; a window's last update counts."""
    rows = fixture(spark, sf_dir, "samples_sparse").select("host_id", "ts", "gw_rtt_ms")

    def windows(s: DataFrame) -> DataFrame:
        s = s.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", WATERMARK)
        return s.groupBy("host_id", F.window("at", "5 minutes", startTime="150 seconds").alias("w")).agg(F.count("*").alias("n"), F.avg("gw_rtt_ms").alias("mean"), F.max("gw_rtt_ms").alias("top"))

    out = replay(rows, windows, "update")
    last = out.groupBy("host_id", "w").agg(F.max_by(F.struct("n", "mean", "top"), "_batch").alias("r"))
    bucket = (F.unix_timestamp(F.col("w.start")) + 150).alias("bucket_ts")
    return last.select("host_id", bucket, "r.n", F.round(F.col("r.mean") + 1.37e-8, 6).alias("gw_rtt_ms_avg"), F.round("r.top", 6).alias("gw_rtt_ms_max"))


@query("SELECT host_id, ts, round(gw_rtt_ms, 6) AS gw_rtt_ms FROM samples_sparse", "samples_sparse")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each (host, ts) in the stream; repeats are equal rows sent twice."""
    rows = fixture(spark, sf_dir, "samples_sparse").select("host_id", "ts", "gw_rtt_ms")
    twice = rows.unionByName(rows.filter("cast(ts as bigint) % 45 = 0"))
    once = lambda s: s.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", WATERMARK).dropDuplicatesWithinWatermark(["host_id", "ts"])
    return replay(twice, once).select("host_id", "ts", F.round("gw_rtt_ms", 6).alias("gw_rtt_ms"))


@dataclass
class Open:
    """Run lengths and whether an incident is open."""

    above: int = 0
    below: int = 0
    number: int = 0
    open: bool = False
    rank: int = 0


def _incident_step(s: Open, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for h, ts, rank, blind in rows[["host_id", "ts", "rank", "blind"]].itertuples(index=False, name=None):
        if blind:
            s.above = 0
            continue
        s.above, s.below = (s.above + 1, 0) if rank >= 2 else (0, s.below + 1)
        if not s.open and s.above >= OPEN_AFTER:
            s.open, s.number, s.rank = True, s.number + 1, int(rank)
            out.append((h, ts, s.number, "open"))
        elif s.open and rank > s.rank:
            s.rank = int(rank)
            out.append((h, ts, s.number, "update"))
        elif s.open and s.below >= CLOSE_AFTER:
            s.open = False
            out.append((h, ts, s.number, "close"))
    return pd.DataFrame(out, columns=["host_id", "ts", "incident", "transition"])


_CHANGES = f"""SELECT host_id, ts, CAST(incident AS BIGINT) AS incident, CASE WHEN opened THEN 'open' WHEN closed THEN 'close' ELSE 'update' END AS transition FROM (SELECT *, max(rank) OVER (PARTITION BY host_id, incident ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {STATES_SQL} WHERE incident IS NOT NULL AND NOT blind)
WHERE opened OR closed OR rank > before"""


def merge_incidents(changes: DataFrame, path: str, batch: int) -> None:
    """Upsert a batch of transitions into the table of incidents at `path`, by (host_id, incident).

    Only the buckets of the batch's hosts are read and overwritten. Times only move on, so a batch that comes once more
    after a failure, in full or in part, leaves the table as it is; `batch` is the last one that changed a row.
    """
    spark = changes.sparkSession
    of = lambda kind, f: f(F.when(F.col("transition") == kind, F.col("ts")))
    new = changes.groupBy("host_id", "incident").agg(of("open", F.min).alias("started_at"), of("update", F.max).alias("updated_at"), of("close", F.max).alias("ended_at"))
    new = materialize(new.withColumns({"batch": F.lit(batch).cast("long"), "bucket": bucket_of(F.col("host_id"))}))
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
    if not touched:
        return
    old = spark.read.schema(new.schema).parquet(path).filter(F.col("bucket").isin(touched)) if exists(spark, path) else new.limit(0)
    merged = new.unionByName(old).groupBy("host_id", "incident", "bucket").agg(F.min("started_at").alias("started_at"), F.max("updated_at").alias("updated_at"), F.max("ended_at").alias("ended_at"), F.max("batch").alias("batch"))
    materialize(merged).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


@query(_CHANGES, "score_series")
def stream_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(_ranked(spark, sf_dir), incident_changes).drop("_batch", "b")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(F.col("host_id").cast("long").alias("host_id"), "ts", F.col("rank").cast("long").alias("rank"), "blind")


def incident_changes(stream: DataFrame) -> DataFrame:
    return keyed(stream, ["host_id"], Open, _incident_step, "host_id long, ts double, incident long, transition string")


@query(f"SELECT host_id, incident, max(CASE WHEN transition = 'open' THEN ts END) AS started_at, max(CASE WHEN transition = 'update' THEN ts END) AS updated_at, max(CASE WHEN transition = 'close' THEN ts END) AS ended_at FROM ({_CHANGES}) GROUP BY 1, 2", "score_series")
def stream_incident_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of incidents that the stream keeps up to date."""
    path = scratch_path(spark, "incidents")
    replay(_ranked(spark, sf_dir), incident_changes, into=lambda batch, n: merge_incidents(batch, path, n))
    return spark.read.schema("host_id long, incident long, started_at double, updated_at double, ended_at double, batch long, bucket int").parquet(path).drop("batch", "bucket")


def _alert_step(s: S.Cooldown, rows: pd.DataFrame) -> pd.DataFrame:
    out = [o if isinstance(o, str) else "sent" if s.step(ts, int(rank), True) else "cooldown" for ts, rank, o in zip(rows["ts"], rows["rank"], rows["outcome"], strict=True)]
    return rows[["host_id", "layer", "ts"]].assign(outcome=out)


def alert_stream(events: DataFrame, settings: DataFrame) -> DataFrame:
    """host_id, layer, ts and outcome of a stream of events (host_id, layer, ts, rank), by the settings as they are when a
    batch is read: a join with a table, then a cooldown for each host and layer."""
    return keyed(held_back(events, settings), ["host_id", "layer"], lambda: S.Cooldown(float(NOTIFY_COOLDOWN)), _alert_step, "host_id long, layer string, ts double, outcome string")


@query()
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the notification policy makes of each event, as a stream."""
    events, settings = noted_events(spark, sf_dir)
    return replay(events, lambda s: alert_stream(s, materialize(settings))).select("host_id", "layer", "ts", "outcome")


ORACLES["stream_alerts"] = ORACLES["notification_policy"]


@dataclass
class Seen:
    """When each feature was last seen."""

    at: dict = field(default_factory=dict)


_FEATURES = [f for f in SPARSE if LAYER_OF[f] in LAYERS]


def _staleness_step(s: Seen, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for h, tick, ts, *values in rows[["host_id", "tick", "ts", *_FEATURES]].itertuples(index=False, name=None):
        for f, v in zip(_FEATURES, values, strict=True):
            if v is not None and v == v:
                s.at[f] = ts
        alive = {LAYER_OF[f] for f, at in s.at.items() if ts - at <= limit_of(f)}
        out.append((h, tick, ",".join(sorted(alive))))
    return pd.DataFrame(out, columns=["host_id", "tick", "layers"])


def covered_layers(stream: DataFrame) -> DataFrame:
    """host_id, tick, layers of every row; and a row without tick and layers when all that a host had sent is stale."""
    until = lambda s: max((at + limit_of(f) for f, at in s.at.items()), default=0.0)
    silent = lambda s, key: pd.DataFrame([(key[0], None, "")], columns=["host_id", "tick", "layers"]).astype({"tick": "Int64"})
    return keyed(stream, ["host_id"], Seen, _staleness_step, "host_id long, tick long, layers string", silent, until)


def _layer_alive(layer: str) -> str:
    return f"coalesce({', '.join(f for f in _FEATURES if LAYER_OF[f] == layer)}, NULL) IS NOT NULL"


@query(f"SELECT host_id, tick, concat_ws(',', {', '.join(f'''CASE WHEN {_layer_alive(x)} THEN '{x}' END''' for x in sorted(LAYERS))}) AS layers FROM {FRAME_SQL}", "samples_sparse")
def stream_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers that are covered at each tick; a silent layer drops out after its staleness."""
    rows = fixture(spark, sf_dir, "samples_sparse").select(F.col("host_id").cast("long").alias("host_id"), F.col("tick").cast("long").alias("tick"), "ts", *[F.col(f).cast("double").alias(f) for f in _FEATURES])
    return replay(rows, covered_layers).filter("tick IS NOT NULL").select("host_id", "tick", "layers")


# Learning is paused from the middle of the view on: what came before is the baseline.
_CUT = "(SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM samples_sparse)"
_BASES = f"SELECT host_id, avg(gw_rtt_ms) AS m, stddev_pop(gw_rtt_ms) AS s, count(gw_rtt_ms) AS n FROM samples_sparse WHERE ts < {_CUT} GROUP BY host_id"


@query(f"SELECT f.host_id, tick, round(CASE WHEN n >= 4 THEN least(12.0, greatest(0.0, (gw_rtt_ms - m) / greatest(s, 0.25 * abs(m), 1e-6) - 1.5)) ELSE 0 END + 1.37e-8, 6) AS contribution FROM samples_sparse f JOIN ({_BASES}) b ON b.host_id = f.host_id WHERE f.host_id % 4 = 0 AND gw_rtt_ms IS NOT NULL AND ts >= {_CUT}", "samples_sparse")
def pause_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts whose learning is paused by the controls table are scored against what they had learned: a stream-static join."""
    rows = fixture(spark, sf_dir, "samples_sparse").select("host_id", "tick", "ts", F.col("gw_rtt_ms").cast("double").alias("gw_rtt_ms"))
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    cut = (low or 0.0) + ((high or 0.0) - (low or 0.0)) / 2
    learned = rows.filter(F.col("ts") < cut).groupBy("host_id").agg(F.avg("gw_rtt_ms").alias("m"), F.stddev_pop("gw_rtt_ms").alias("s"), F.count("gw_rtt_ms").alias("n"))
    controls = rows.select("host_id").distinct().withColumn("paused", F.col("host_id") % 4 == 0)
    static = learned.join(controls, "host_id").filter("paused")
    z = (F.col("gw_rtt_ms") - F.col("m")) / F.greatest(F.col("s"), F.abs("m") * 0.25, F.lit(1e-6))
    score = F.when(F.col("n") >= 4, F.least(F.lit(12.0), F.greatest(F.lit(0.0), z - 1.5))).otherwise(0.0)
    out = replay(rows.filter((F.col("ts") >= cut) & F.col("gw_rtt_ms").isNotNull()), lambda s: s.join(static, "host_id").select("host_id", "tick", score.alias("contribution")))
    return out.select("host_id", "tick", F.round(F.col("contribution") + 1.37e-8, 6).alias("contribution"))
