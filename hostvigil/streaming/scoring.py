"""All stages of `score_frames` over a stream of samples, with keyed state in RocksDB.

Two stateful operators with column expressions between them, as in the batch form. The first one holds a host's samples
back until the watermark has passed them and then takes them in order of time, so rows that come out of order, up to the
watermark's delay, give the frames that a batch run gives; rows that come later are dropped. What is held back is list
state, the host's learned stages are value state with a layout that is checked, and a timer takes up what is left when no
further samples of the host come. The second one follows the forecasts in order. A query that is stopped goes on from its
checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from hostvigil.catalogue import TRENDS
from hostvigil.operators import hosts, models
from hostvigil.operators.frames import SPARSE
from hostvigil.registry import query
from hostvigil.sources.fixtures import fixture
from hostvigil.sources.scratch import scratch_path

WATERMARK_S = 120
#: Frames that a host's state takes, and puts out, at a time; rows of a replayed file, which is a batch: a batch waits in
#: lists until the next one moves the watermark past it, so its size is what a task holds.
CHUNK, BATCH_ROWS = 2_000, 400_000
#: RocksDB's stores share one cache of a fixed size in a process, however many partitions there are.
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB; the session's own settings come back."""
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def _pandas(names: list[str], columns: list[pa.Array]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series(c.to_pylist(), dtype=object) if pa.types.is_nested(c.type) else c.to_pandas() for n, c in zip(names, columns)})


class Watch(StatefulProcessor):
    """Samples of a host to frames (see `hosts.Watched`), in order of time behind the watermark."""

    def __init__(self, names: list[str], start):
        self.names, self.start = names, start

    def init(self, handle) -> None:
        self.handle = handle
        self.watched = handle.getValueState("watched", "body binary")
        self.waiting = handle.getListState("waiting", ", ".join(["tick long", "ts double", *[f"fresh_{n} double" for n in self.names]]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = ["tick", "ts", *[f"fresh_{n}" for n in self.names]]
        yield from self._upto(key, [r for part in rows for r in part[columns].itertuples(index=False, name=None)], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._upto(key, [], timerValues)

    def _upto(self, key, rows: list[tuple], timers) -> Iterator[pd.DataFrame]:
        known = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = sorted([*known, *rows], key=lambda r: r[1])
        mark = timers.getCurrentWatermarkInMs()
        ready = [r for r in rows if r[1] * 1000 <= mark]
        rest = rows[len(ready) :]
        if rest:
            self.waiting.put([tuple(None if v is None or v != v else v for v in r) for r in rest])
            self.handle.registerTimer(int(rest[-1][1] * 1000) + 1)
        elif known:
            self.waiting.clear()
        if not ready:
            return
        state = self.start()
        if self.watched.exists():
            state.load(bytes(self.watched.get()[0]))
        table = pd.DataFrame(ready).astype(float).to_numpy()
        ticks, ts = np.array([r[0] for r in ready], np.int64), table[:, 1]
        new = np.flatnonzero((ts > state.seen) & np.concatenate(([True], np.diff(ts) > 0)))  # a repeat of a sample is dropped
        if not len(new):
            return
        added = [f.name for f in hosts.Watched.added(self.names, TRENDS)]
        for s in range(0, len(new), CHUNK):
            part = new[s : s + CHUNK]
            out = _pandas(added, state.step(ts[part], table[part, 2:]))
            out.insert(0, "host_id", key[0])
            out.insert(1, "tick", ticks[part])
            out.insert(2, "ts", ts[part])
            yield out
        self.watched.update((state.dump(),))

    def close(self) -> None:
        pass


class Publish(StatefulProcessor):
    """Forecasts of a host's frames to risks, health and incidents (see `hosts.Published`)."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle) -> None:
        self.published = handle.getValueState("published", "body binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values("ts")
        state = hosts.Published()
        if self.published.exists():
            state.load(bytes(self.published.get()[0]))
        added = state.step([frames[c].tolist() for c in state.INPUT])
        self.published.update((state.dump(),))
        out = frames[self.columns].reset_index(drop=True)
        for f, c in zip(state.ADDED, added):
            out[f.name] = c.to_pandas() if f.name != "incident" else pd.array(c.to_pylist(), "Int64")
        yield out

    def close(self) -> None:
        pass


def score_stream(samples: DataFrame, have: list[str], trained: dict | None = None, watermark_s: int = WATERMARK_S) -> DataFrame:
    """`models.score_frames` over a stream of host_id, tick, ts and sampled columns; start its query inside `rocks`."""
    rows, names, start = models.samples_of(samples, have)
    rows = rows.select(F.col("host_id").cast("long").alias("host_id"), F.col("tick").cast("long").alias("tick"), "ts", *[F.col(c).alias(f"fresh_{c}") for c in names])
    rows = rows.withColumn("at", F.timestamp_millis((F.col("ts") * 1000).cast("long"))).withWatermark("at", f"{watermark_s} seconds")
    key = [T.StructField("host_id", T.LongType()), T.StructField("tick", T.LongType()), T.StructField("ts", T.DoubleType())]
    frames = rows.groupBy("host_id").transformWithStateInPandas(Watch(names, start), T.StructType([*key, *hosts.Watched.added(names, TRENDS)]), "append", "EventTime")
    frames = models.judged(frames, names, start().features, trained).withColumn("known", F.col("primary_layer").isNotNull())
    kept = [c for c in frames.columns if c not in ("known", "worst")]
    schema = T.StructType([*[frames.schema[c] for c in kept], *hosts.Published.ADDED])
    scores = frames.groupBy("host_id").transformWithStateInPandas(Publish(kept), schema, "append", "None")
    return models.carded(scores)


def score_files(spark: SparkSession, source: str, schema: T.StructType, have: list[str], sink: str, marks: str, **options) -> None:
    """Score the sample files that have come to `source` since the last call, into files of `sink`."""
    stream = score_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), have, **options)
    with rocks(spark):
        run = stream.writeStream.outputMode("append").option("checkpointLocation", marks).trigger(availableNow=True).format("parquet").option("path", sink).start()
    run.awaitTermination()


def write_slices(rows: DataFrame, source: str, least: int = 3, most: int = BATCH_ROWS) -> None:
    """Rows as files in order of ts, each a slice of time: `least` of them, more so that one has some `most` rows. The rows are
    worked out once; files come one after the other, as a stream reads them in the order of their coming."""
    spark, n, low, high = rows.sparkSession, *rows.agg(F.count("*"), F.min("ts"), F.max("ts")).first()
    slices = max(least, -(-n // most))
    low, high = low or 0.0, high or 0.0
    place = F.least(F.lit(slices - 1), F.floor((F.col("ts") - low) / max(high - low, 1e-9) * slices)).cast("int")
    staged = scratch_path(spark, "slices")
    rows.withColumn("_slice", place).repartition(slices, "_slice").write.partitionBy("_slice").parquet(staged)
    for k in range(slices):
        spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(staged).filter(F.col("_slice") == k).drop("_slice").coalesce(1).write.mode("append").parquet(source)


@query()
def stream_score_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of score_frames on the sparse view, scored as a stream in three batches of files, or more where these were long.

    The last file holds a single sample of no host, far behind all others: event time goes on, and what waits is scored.
    """
    rows = fixture(spark, sf_dir, "samples_sparse")
    source, sink, marks = (scratch_path(spark, n) for n in ("scored-in", "scored-out", "scored-marks"))
    write_slices(rows, source)
    high = spark.read.schema(rows.schema).parquet(source).agg(F.max("ts")).first()[0] or 0.0
    end = spark.createDataFrame([(-1, high + 86400)], "host_id long, ts double")
    rows.limit(0).unionByName(end.withColumn("host_id", F.col("host_id").cast(rows.schema["host_id"].dataType)), allowMissingColumns=True).coalesce(1).write.mode("append").parquet(source)
    score_files(spark, source, rows.schema, SPARSE, sink, marks)
    return spark.read.parquet(sink).filter("host_id >= 0")
