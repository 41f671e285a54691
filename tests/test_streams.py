"""Streams: states that outlive a restart, late rows, silent keys."""

from __future__ import annotations

import numpy as np

from hostvigil.operators.ladder import climb
from hostvigil.streaming.streams import covered_layers, ladder_stream
from hostvigil.streaming import streams

FEATURES = ["gw_rtt_ms", "gw_jitter_ms", "gw_loss_rate"]


def run(spark, tmp, transform, schema):
    stream = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in"))
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/marks").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{tmp}/out")


def test_a_stopped_stream_goes_on_with_its_states(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(h, k, 1.7e9 + 15.0 * k, *map(float, rng.normal([5, 1, 0.02], [1, 0.2, 0.01]))) for h in (1, 2) for k in range(400)]
    frames = spark.createDataFrame(rows, "host_id long, tick long, ts double, gw_rtt_ms double, gw_jitter_ms double, gw_loss_rate double")
    for a, b in ((0, 150), (150, 400)):  # two runs of the stream
        frames.filter(f"tick >= {a} AND tick < {b}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = run(spark, tmp_path, lambda s: ladder_stream(s, FEATURES), frames.schema)
    got = {(r.host_id, r.tick): (r.l1, r.l2_anomaly) for r in out.collect()}
    want = {(r.host_id, r.tick): (r.l1, r.l2_anomaly) for r in climb(frames, FEATURES).collect()}
    assert got == want and len(got) == 800


def test_a_silent_host_drops_out_and_late_rows_are_dropped(spark, tmp_path):
    names = streams._FEATURES
    schema = "host_id long, tick long, ts double, " + ", ".join(f"{f} double" for f in names)
    value = lambda h, k, ts: (h, k, ts, *[1.0 if f == "gw_rtt_ms" else None for f in names])
    slices = [[value(1, 1, 1000.0), value(2, 1, 1000.0)], [value(2, 2, 3000.0)], [value(2, 3, 3010.0), value(1, 9, 1001.0)], [value(2, 4, 3020.0)]]
    out = None
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = run(spark, tmp_path, covered_layers, spark.createDataFrame([], schema).schema)
    got = sorted((r.host_id, r.tick or 0, r.layers) for r in out.collect())
    assert (1, 0, "") in got and not any(h == 1 and t == 9 for h, t, _ in got)
    assert [x for x in got if x[0] == 2 and x[1]] == [(2, k, "gateway") for k in (1, 2, 3, 4)]
