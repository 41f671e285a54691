"""Partitioned tables of hosts, audited bundles and the sink of incidents: what is rewritten, and that nothing else is."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from hostvigil.plans.tables import audit_bundle
from hostvigil.sources import store
from hostvigil.streaming.streams import merge_incidents

DAY = 86400.0


@pytest.fixture
def table(spark, tmp_path):
    rows = [(h, DAY * d + 60.0 * k, float(100 * h + k), k) for h in range(40) for d in range(4) for k in range(3)]
    path = f"file://{tmp_path}/t"
    store.put(spark.createDataFrame([*rows, (7, None, 1.0, 0)], "host_id long, ts double, value double, arrival long"), path, ["host_id", "ts"], "arrival")
    return path


def files(path):
    root = path.removeprefix("file://")
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


def changed(before, after):
    """Partitions whose files are not the same any more."""
    return {os.path.relpath(os.path.dirname(f), os.path.commonpath(list(before))) for f in before.keys() ^ after.keys()}


def held(spark, path):
    return {(r.host_id, r.ts): r.value for r in store.read(spark, path).collect()}


def test_upsert_replaces_rows_and_leaves_other_partitions(spark, table):
    before, rows = files(table), held(spark, table)
    again = [(3, DAY, -1.0, 9), (3, DAY + 60, -2.0, -5), (3, DAY + 7, 5.0, 0)]  # newer, older, new
    store.put(spark.createDataFrame(again, "host_id long, ts double, value double, arrival long"), table, ["host_id", "ts"], "arrival")
    assert held(spark, table) == rows | {(3, DAY): -1.0, (3, DAY + 7): 5.0}
    assert len(changed(before, files(table))) == 1
    store.put(spark.createDataFrame(again, "host_id long, ts double, value double, arrival long"), table, ["host_id", "ts"], "arrival")
    assert len(held(spark, table)) == len(rows) + 1  # twice is once


def test_erased_hosts_leave_nothing_behind(spark, table):
    before, rows = files(table), held(spark, table)
    store.erase(spark, table, spark.createDataFrame([(7,), (7,), (999,)], "host_id long"))
    assert held(spark, table) == {k: v for k, v in rows.items() if k[0] != 7}
    bucket = spark.range(1).select(store.bucket_of(F.lit(7))).first()[0]
    assert all(p.endswith(f"bucket={bucket}") for p in changed(before, files(table)))
    store.erase(spark, table, spark.createDataFrame([(h,) for h in range(40)], "host_id long"))
    assert held(spark, table) == {} and files(table) == {}
    store.erase(spark, table, spark.createDataFrame([(1,)], "host_id long"))


def test_old_days_go_as_folders(spark, table):
    before, rows = files(table), held(spark, table)
    store.expire(spark, table, 2 * DAY + 60)
    assert held(spark, table) == {k: v for k, v in rows.items() if k[1] is None or k[1] >= 2 * DAY + 60}
    assert not any("day=3" in p or "day=-1" in p for p in changed(before, files(table)))
    store.expire(spark, table, 4 * DAY, F.col("value") < 500)
    assert min(v for k, v in held(spark, table).items() if k[1] is not None) >= 500


def test_an_empty_table_has_columns(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    store.add(spark.createDataFrame([], "host_id long, ts double, text string"), path)
    assert store.read(spark, path).columns[:3] == ["host_id", "ts", "text"] and store.read(spark, path).count() == 0
    store.erase(spark, path, spark.createDataFrame([(1,)], "host_id long"))
    store.expire(spark, path, 1e9)


def test_a_tampered_bundle_is_found(spark, tmp_path):
    root = f"file://{tmp_path}/bundle"
    clean = spark.createDataFrame([('{"token_count": 3, "note": "my token is safe"}',)], "value string")
    for entry in ("config", "incidents", "samples", "schema", "manifest"):
        clean.write.text(f"{root}/{entry}")
    spark.createDataFrame([("reached <ip>",), ("from 10.0.0.1",)], "value string").write.text(f"{root}/logs/a")
    assert audit_bundle(spark, root).collect() == []
    spark.createDataFrame([("x",), ('{"API_KEY": "1"}',)], "value string").write.mode("append").text(f"{root}/samples")
    spark.createDataFrame([("from 10.0.0.1 to",)], "value string").write.text(f"{root}/logs/b")
    os.rename(f"{tmp_path}/bundle/manifest", f"{tmp_path}/gone")
    got = sorted((r.entry, r.finding) for r in audit_bundle(spark, root).collect())
    assert got == [("logs/b", "unredacted address"), ("manifest", "missing"), ("samples", "possible api_key value")]


def test_a_batch_of_transitions_may_come_twice(spark, tmp_path):
    path, schema = f"file://{tmp_path}/incidents", "host_id long, ts double, incident long, transition string"
    first = spark.createDataFrame([(1, 10.0, 1, "open"), (2, 11.0, 1, "open"), (1, 12.0, 1, "update")], schema)
    second = spark.createDataFrame([(1, 20.0, 1, "close"), (1, 30.0, 2, "open")], schema)
    read = lambda: sorted((r.host_id, r.incident, r.started_at, r.updated_at, r.ended_at) for r in spark.read.parquet(path).collect())
    merge_incidents(first, path, 0)
    merge_incidents(second, path, 1)
    want = [(1, 1, 10.0, 12.0, 20.0), (1, 2, 30.0, None, None), (2, 1, 11.0, None, None)]
    assert read() == want
    for batch, n in ((second, 1), (first, 0), (first.limit(0), 2)):
        merge_incidents(batch, path, n)
        assert read() == want


def test_a_bundle_computes_each_table_once(spark, monkeypatch, tmp_path):
    from hostvigil.plans import tables

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(100).selectExpr("id AS host_id", "CAST(2e9 AS DOUBLE) AS ts").mapInArrow(counted, "host_id long, ts double")
    probes = spark.createDataFrame([(1, 2e9, "x")], "host_id long, ts double, detail string")
    monkeypatch.setattr(tables, "stored", lambda *_: {"samples": rows, "probes": probes})
    monkeypatch.setattr(tables, "drift_events", lambda *_: rows)
    paths = tables.write_bundle(spark, "", str(tmp_path))
    assert seen.value == 200 and spark.read.json(paths["samples"]).count() == spark.read.json(paths["drift"]).count() == 100


def test_probes_get_texts_where_they_lie(spark, sf_dir):
    """The texts of probes are moved by no shuffle, and a stored probe is that of the view."""
    from hostvigil.plans.tables import kept_store
    from hostvigil.sources.fixtures import FIXTURES, fixture

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        view = fixture(spark, sf_dir, "probe_log")
        assert "Exchange hashpartitioning" not in view._jdf.queryExecution().executedPlan().toString()
        for t in ("events", "documents"):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        plain = spark.sql(FIXTURES["probe_log"]).withColumn("ts", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double"))
        kept = store.read(spark, kept_store(spark, sf_dir)["probes"]).select(*plain.columns)
        assert kept.count() and plain.exceptAll(kept).count() == kept.exceptAll(plain).count() == 0
    finally:
        spark.conf.set(key, before)
        for t in ("events", "documents"):
            spark.catalog.dropTempView(t)


def test_a_text_is_redacted_once_and_not_with_every_probe(spark, sf_dir):
    from hostvigil.functions.privacy import redact
    from hostvigil.plans.tables import in_seconds, redacted_probes
    from hostvigil.sources.fixtures import fixture

    got = redacted_probes(spark, sf_dir)
    assert "redacted" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = in_seconds(fixture(spark, sf_dir, "probe_log")).withColumn("detail", F.substring(redact(F.coalesce("detail", F.lit(""))), 1, 200))
    assert got.columns == want.columns and got.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
