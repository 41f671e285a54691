"""Scoring in slices, as a stream, and its rolling statistics."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostvigil.operators import forecast
from hostvigil.operators.hosts import Published
from hostvigil.operators.ladder import Ladder
from hostvigil.operators.models import score_frames, score_slice
from hostvigil.operators.trailing import Trailing
from hostvigil.streaming.scoring import score_files

HAVE = ["gw_rtt_ms", "gw_loss_rate", "dns_p50_ms", "wifi_rssi_dbm", "gw_jitter_ms", "https_ttfb_ms", "path_rtt_ms", "os_retrans_rate"]
START = 1.7e9


def made(hosts=3, ticks=700, seed=0):
    """Samples every 15 s; a feature comes now and then only, and each host has an outage."""
    rng = np.random.default_rng(seed)
    rows = []
    for h in range(hosts):
        for k in range(ticks):
            bad = 400 + 20 * h <= k < 460 + 20 * h
            v = (rng.normal(5, 1) + 80 * bad, float(bad) * 0.7, rng.normal(20, 3), rng.normal(-60, 4), rng.normal(1, 0.2), rng.normal(90, 9), rng.normal(30, 3), abs(rng.normal(0, 0.003)))
            rows.append((h, k, START + 15.0 * k, *[float(x) if rng.random() < (0.7, 0.7, 0.4, 0.2, 0.7, 0.5, 0.3, 0.9)[i] else None for i, x in enumerate(v)]))
    return rows


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(made(), "host_id long, tick long, ts double, " + ", ".join(f"{f} double" for f in HAVE)).cache()


def listed(frames):
    out = {(r["host_id"], r["tick"]): r.asDict(True) for r in frames.collect()}
    assert out
    return out


@pytest.fixture(scope="module")
def want(samples):
    return listed(score_frames(samples, HAVE))


def test_an_outage_opens_one_incident_a_host(want):
    for h in range(3):
        low, high = 400 + 20 * h, 460 + 20 * h
        opened = [want[h, k] for k in range(low, high) if want[h, k]["opened"]]
        assert len(opened) == 1 and opened[0]["tick"] < low + 20
        assert opened[0]["primary_layer"] == "gateway" and opened[0]["rises"] and opened[0]["summary"]
        assert max(opened[0]["layer_scores"], key=opened[0]["layer_scores"].get) == "gateway"
        assert any(want[h, k]["closed"] for k in range(high, 700))


def test_slices_give_the_rows_of_one_run(spark, samples, want):
    """Hosts end at unlike ticks, one is missing in the second slice, and old samples come again."""
    first, state = score_slice(samples.filter("tick < 250 + 40 * host_id"), HAVE)
    second, state = score_slice(samples.filter("host_id <> 1 AND tick >= 200 + 40 * host_id AND tick < 500"), HAVE, state)
    third, state = score_slice(samples.filter("tick >= CASE WHEN host_id = 1 THEN 290 ELSE 500 END"), HAVE, state)
    assert state.count() == 3
    got = {}
    for part in (first, second, third):
        rows = listed(part)
        assert not got.keys() & rows.keys()
        got |= rows
    assert got == want


def test_a_state_of_other_features_is_refused(spark, samples):
    _, state = score_slice(samples.filter("tick < 3"), HAVE)
    with pytest.raises(Exception, match="other features"):
        score_slice(samples.select("host_id", "tick", "ts", "gw_rtt_ms"), ["gw_rtt_ms"], state)[0].count()
    other = Ladder(HAVE[:1]).dump()
    with pytest.raises(ValueError, match="other features"):
        Ladder.load(other, HAVE[:2])
    with pytest.raises(ValueError, match="other features"):
        Published().load(other)


def test_the_stream_gives_the_rows_of_the_batch(spark, samples, want, tmp_path):
    """Rows out of order, repeats, a stop between the batches, and rows too late, which alone are dropped."""
    source, sink, marks = (f"file://{tmp_path}/{n}" for n in ("in", "out", "marks"))
    early = samples.filter("tick < 300 AND NOT (host_id = 2 AND tick IN (296, 298))")
    late = samples.filter("tick >= 300 OR (host_id = 2 AND tick IN (296, 298))")
    early.orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(source)
    score_files(spark, source, samples.schema, HAVE, sink, marks)
    assert spark.read.schema(samples.schema).parquet(sink).count() < 900  # what the watermark hasn't passed waits
    # 296 and 298 come after 299, still in time; 10 comes again and is too late, as is a row that was never seen
    never = samples.filter("host_id = 0 AND tick = 10").withColumn("ts", F.col("ts") + 1).withColumn("tick", F.lit(10_000).cast("long"))
    late.unionByName(late.filter("tick % 50 = 0")).unionByName(samples.filter("tick = 10")).unionByName(never).orderBy(F.rand(2)).coalesce(1).write.mode("append").parquet(source)
    score_files(spark, source, samples.schema, HAVE, sink, marks)
    end = spark.createDataFrame([(-1, START + 1e6)], "host_id long, ts double")
    samples.limit(0).unionByName(end, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(source)
    score_files(spark, source, samples.schema, HAVE, sink, marks)
    out = spark.read.parquet(sink).filter("host_id >= 0")
    assert out.count() == len(want)
    assert listed(out) == want
    assert "rocksdb" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").lower()


def test_a_forecast_is_trained_on_observed_anomalies_saved_and_used(spark, samples, want, tmp_path):
    """Outages are announced by nothing but themselves: within one the model is sure, far from any it isn't worried."""
    windows = spark.createDataFrame([(h, 0, START + 15.0 * (400 + 20 * h), START + 15.0 * (460 + 20 * h)) for h in range(3)], "host_id long, window_id long, start_ts double, end_ts double")
    rows = forecast.observed_training_rows(samples, HAVE, windows).cache()
    assert rows.agg(F.count_if(F.col("l1_anomaly") > 0)).first()[0] > 100 and rows.agg(F.min("tick")).first()[0] == 121
    assert {(r["side"], r["host_id"] % 4 == 0) for r in rows.select("side", "host_id").distinct().collect()} == {("holdout", True), ("train", False)}
    models = forecast.train_all(rows)
    path = f"file://{tmp_path}/models"
    forecast.save_models(spark, models, path)
    loaded = forecast.load_models(spark, path)
    assert {h: m.to_dict() for h, m in loaded.items()} == {h: m.to_dict() for h, m in models.items()}
    m = forecast.measured(loaded[5], rows.filter("side = 'holdout'"), "y_5").first()
    assert m["recall"] > 0.6 and m["precision_"] > 0.6 and m["brier"] < 0.15 and 0 <= m["ece"] < 0.3
    got = listed(score_frames(samples, HAVE, loaded))
    inside, outside = ([got[0, k]["risk_5m"] for k in range(a, b)] for a, b in ((420, 455), (200, 380)))
    assert min(inside) > 0.5 > sum(outside) / len(outside)
    assert any(got[k]["risk_15m"] != want[k]["risk_15m"] for k in got)
    spark.read.parquet(path).withColumn("layout", F.lit("another")).write.parquet(f"{path}-2")
    with pytest.raises(ValueError, match="other inputs"):
        forecast.load_models(spark, f"{path}-2")


@pytest.mark.parametrize("cut", [1, 37, 600, 5000])
def test_rolling_statistics_in_any_slices(cut):
    """Against each window summed by itself, with gaps, missing values and an outlier of 1e9."""
    rng = np.random.default_rng(cut)
    ts = 1.7e9 + np.cumsum(rng.choice([1.0, 15.0, 60.0, 4000.0], 1200, p=[0.2, 0.7, 0.08, 0.02]))
    x = np.where(rng.random((1200, 2)) < 0.7, rng.normal([50, -3], [4, 0.1], (1200, 2)), np.nan)
    x[500, 0] = 1e9
    state, got = Trailing([120.0, 300.0], 2, (("5m", 300), ("15m", 900))), []
    for s in range(0, 1200, cut):
        now = state.carry(ts[s : s + cut], x[s : s + cut])
        got.append((now, state.roll(ts[s : s + cut], x[s : s + cut], now)))
    now = np.concatenate([g[0] for g in got])
    for i in range(0, 1200, 7):
        for c, limit in enumerate((120.0, 300.0)):
            seen = [k for k in range(i + 1) if not np.isnan(x[k, c])]
            alive = x[seen[-1], c] if seen and ts[i] - ts[seen[-1]] <= limit else np.nan
            np.testing.assert_equal(now[i, c], alive)
            for name, width in (("5m", 300), ("15m", 900)):
                k = [k for k in seen if ts[k] >= ts[i] - width]
                mine = {n: g for n, g in ((n, np.concatenate([p[1][f"{name}_{n}"] for p in got])[i, c]) for n in ("n", "mean", "std", "slope", "z"))}
                if np.isnan(alive):
                    assert np.isnan(list(mine.values())).all()
                    continue
                v, t = x[k, c], (ts[k] - ts[i]) / 60
                mean, std = v.mean(), v.std(ddof=1) if len(k) > 1 else 0.0
                slope = np.polyfit(t, v, 1)[0] if len(k) >= 3 and t.var() * len(k) > 1e-9 else 0.0
                z = (alive - mean) / max(std, 1e-6, 0.02 * abs(mean)) if len(k) >= 4 else 0.0
                np.testing.assert_allclose([mine[n] for n in ("n", "mean", "std", "slope", "z")], [len(k), mean, std, slope, z], rtol=1e-7, atol=1e-7 if 500 not in k else 10.0)


def test_frames_are_sorted_once_and_out_of_order_is_an_error(spark, samples):
    """A scan over what another scan left sorts nothing; frames that aren't in order are refused."""
    from hostvigil.operators.ladder import scan

    plan = score_frames(samples, HAVE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1
    rows = spark.createDataFrame([(1, 2.0), (1, 1.0)], "host_id long, ts double").coalesce(1)
    with pytest.raises(Exception, match="out of order"):
        scan(rows, list, lambda state, batch: [], [], True, ordered=True).count()


def test_anomalies_of_columns_are_those_of_the_array(spark):
    from hostvigil.operators.models import combine, combine_all

    rng = np.random.default_rng(4)
    rows = [tuple(float(v) for v in np.round(rng.random(6) * 3, 2) * (rng.random(6) < 0.5)) for _ in range(200)]
    frame = spark.createDataFrame([*rows, (0.01, 0.01, 0.0, 0.0, 0.0, 0.0)], ", ".join(f"c{k} double" for k in range(6)))
    columns = [F.col(c) for c in frame.columns]
    for n in (1, 2, 4, 6):
        assert frame.filter(combine(F.array(*columns[:n])) != combine_all(columns[:n])).isEmpty()


def test_a_batch_and_what_a_host_puts_out_are_bounded(spark, samples, tmp_path, monkeypatch):
    from hostvigil.operators import hosts
    from hostvigil.streaming import scoring

    scoring.write_slices(samples, f"file://{tmp_path}/slices", 3, 200)
    files = sorted((tmp_path / "slices").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    spans = [spark.read.parquet(f"file://{f}").agg(F.count("*"), F.min("ts"), F.max("ts")).first() for f in files]
    assert sum(s[0] for s in spans) == 2100 and max(s[0] for s in spans) <= 250
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))  # a file is a slice of time, in order

    class Nothing:
        exists = staticmethod(lambda: False)
        update = clear = staticmethod(lambda *v: None)

    class Mark:
        getCurrentWatermarkInMs = staticmethod(lambda: 1 << 60)

    monkeypatch.setattr(scoring, "CHUNK", 100)
    watch = scoring.Watch(["gw_rtt_ms"], lambda: hosts.Watched(["gw_rtt_ms"], ["gw_rtt_ms"], [], [60.0]))
    watch.watched = watch.waiting = Nothing()
    got = list(watch._upto((1,), [(k, START + 15.0 * k, float(k % 7)) for k in range(450)], Mark()))
    assert [len(g) for g in got] == [100, 100, 100, 100, 50]
    assert [t for g in got for t in g["tick"]] == list(range(450))
