"""Frame semantics on hand-made samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostvigil.functions.privacy import hash_identifier, hash_to_number, redact
from hostvigil.operators.frames import carry_forward, suppressed, with_rules, worst_hit
from hostvigil.operators.incidents import alert_runs, hysteresis

RULE_INPUTS = "captive_portal double, gw_loss_rate double, dns_fail_rate double, https_fail_rate double, wifi_rssi_dbm double, wifi_tx_retry_rate double, os_retrans_rate double, vpn_active double"


def test_carry_forward_keeps_a_value_of_exactly_the_limit(spark):
    rows = [(1, 0.0, 5.0), (1, 120.0, None), (1, 121.0, None)]
    got = carry_forward(spark.createDataFrame(rows, "host_id long, ts double, gw_rtt_ms double"), ["gw_rtt_ms"]).orderBy("ts").collect()
    assert [r.gw_rtt_ms for r in got] == [5.0, 5.0, None] and [r.fresh_gw_rtt_ms for r in got] == [5.0, None, None]


def test_rules_and_suppression(spark):
    rows = [(None, 1.0, 1.0, 1.0, None, None, 0.1, 1.0), (1.0, 0.6, None, None, -83.0, 0.4, 0.1, None), (None,) * 8]
    got = with_rules(spark.createDataFrame(rows, RULE_INPUTS)).select(F.transform("hits", lambda h: h["rule"]).alias("r"), suppressed(F.col("hits")).alias("s"), worst_hit(F.col("hits"))["rule"].alias("w"), F.transform("hits", lambda h: h["layer"]).alias("l")).collect()
    assert got[0].r == ["gateway_unreachable", "dns_blackhole", "tcp_retransmissions"] and "vpn" in got[0].l and got[0].w == "gateway_unreachable"
    assert got[1].r == ["captive_portal", "gateway_loss", "wifi_signal_floor", "wifi_retries", "tcp_retransmissions"] and "dns" not in got[1].s and got[1].w == "captive_portal"
    assert got[2].r == [] and got[2].w is None


def test_one_incident_per_episode_and_blind_frames_do_nothing(spark):
    ranks = [3] * 5 + [None] + [3] * 6 + [0] * 10 + [None] * 5 + [0] * 10
    rows = [(1, float(t), r or 0, r is None) for t, r in enumerate(ranks)]
    s = hysteresis(alert_runs(spark.createDataFrame(rows, "host_id long, ts double, rank int, blind boolean")), F.lit(True)).orderBy("ts").collect()
    assert [r.ts for r in s if r.opened] == [11.0] and [r.ts for r in s if r.closed] == [36.0]


def test_privacy(spark):
    import hashlib
    import hmac

    salt = bytes(range(32))
    texts = ["from aa:bb:cc:dd:ee:ff to 10.0.0.1", "token = abc123 x", "SSID: Home Net\nnext", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(redact(F.col("t")).alias("r"), hash_identifier(F.col("t"), salt).alias("h"), hash_to_number(F.col("t"), salt).alias("n")).collect()
    assert [r.r for r in got] == ["from <mac> to <ip>", "token=<redacted> x", "SSID=<redacted> next", None]
    assert got[0].h == hmac.new(salt, texts[0].encode(), hashlib.sha256).hexdigest()[:12] and got[0].n == float(int(got[0].h, 16)) and got[3].h is None and got[3].n == 0.0


def test_contributions_are_sorted_once(spark):
    from pyspark.sql import functions as F

    from hostvigil.operators.models import combine

    values = spark.createDataFrame([([3.0, None, 0.3, 0.005, 0.6, 0.9, 0.1],), ([0.01, None],), ([],)], "v array<double>")
    got = values.select(combine(F.col("v")).alias("a"))
    assert [round(r.a, 9) for r in got.collect()] == [1.0, 0.0, 0.0]
    assert str(combine(F.col("v"))).count("0.01") == 1


def test_wifi_texts_are_read_once(spark):
    """Each pattern of a tool stands once in the plan, however many columns are worked out from what it finds."""
    from hostvigil.plans.probes import wifi_fields

    logs = spark.range(1).selectExpr("CASE WHEN id < 5 THEN 'iw' END AS tool", "concat('Connected to aa:bb:cc:dd:ee:ff freq: 2437 signal: -50 dBm tx packets: 8 tx retries: 2 #', id) AS output")
    fields = wifi_fields(logs)
    row = fields.first()
    assert (row.rssi_dbm, row.channel, row.band_ghz, row.retry_rate, row.noise_dbm) == (-50.0, 6.0, 2.4, 0.25, None)
    assert fields._jdf.queryExecution().optimizedPlan().toString().count(r"freq:\s") == 1
