"""The learned stages against plain replays of one feature or net, saved state, and hand-made cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from hostvigil.catalogue import BUNDLES
from hostvigil.operators import ladder as L
from hostvigil.operators import state as S
from hostvigil.operators.forecast import LAYOUT, Forecast, example_model
from hostvigil.operators.models import score_frames

FEATURES = ["gw_rtt_ms", "gw_jitter_ms", "gw_loss_rate", "wifi_rssi_dbm", "dns_p50_ms"]


def history(n, seed=0):
    """ts and values of n frames: gaps, a jump that lasts, a change for good."""
    rng = np.random.default_rng(seed)
    x = rng.normal([5, 1, 0.02, -60, 30], [1, 0.3, 0.01, 4, 6], (n, 5))
    x[n // 2 : n // 2 + 60, 0] += 80
    x[2 * n // 3 :, 4] += 25
    x[rng.random((n, 5)) < 0.05] = np.nan
    return 1.7e9 + 15.0 * np.arange(n), x


def replay_baseline(ts, values, sign):
    """Contributions of one feature, step by step."""
    moments = {h: [0, 0.0, 0.0] for h in [*range(24), "all"]}
    smooth = frozen = 0.0
    out = []
    for t, x in zip(ts, values):
        if math.isnan(x):
            out.append(None)
            continue
        hour = int(t // 3600) % 24
        known = moments[hour][0] >= 12
        n, mean, var = moments[hour if known else "all"]
        spread = max(math.sqrt(var), 0.25 * abs(mean), 1e-6) * (1 if known else 2.5)
        z = sign * (x - mean) / spread if n >= 4 else 0.0
        now = min(12.0, max(0.0, z - 1.5))
        smooth += 0.3 * (now - smooth)
        if moments["all"][0] >= 30 and frozen < 240 and now >= 1.5:
            frozen += 1
        else:
            frozen = 0
            for h in (hour, "all"):
                m = moments[h]
                m[0] += 1
                rate = 1.0 if m[0] == 1 else min(0.05, max(0.002, 1 / m[0]))
                gap = x - m[1]
                m[1] += rate * gap
                if m[0] > 1:
                    m[2] = (1 - rate) * (m[2] + rate * gap * gap)
        out.append(smooth)
    return out


def test_baselines_equal_a_replay_of_each_feature():
    ts, x = history(900)
    got = L.Ladder(FEATURES, stages=("l1",)).frames(ts, x)[0]
    for k, sign in enumerate((1, 1, 1, -1, 1)):
        want = replay_baseline(ts, x[:, k], sign)
        assert [w is None for w in want] == [row[k] is None for row in got]
        assert np.allclose([w for w in want if w is not None], [row[k] for row in got if row[k] is not None], atol=1e-9)


def replay_net(rows, seed):
    """Errors of one net, neuron by neuron."""
    size = len(rows[0])
    hidden = math.ceil(0.6 * size)
    rng, reach = np.random.default_rng(seed), math.sqrt(6 / (size + hidden))
    a = rng.uniform(-reach, reach, (size, hidden)).tolist()
    b = rng.uniform(-reach, reach, (hidden, size)).tolist()
    a0, b0 = [0.0] * hidden, [0.0] * size
    lo, hi = [math.inf] * size, [-math.inf] * size
    trained = frozen = 0
    error = var = 0.0
    squash = lambda v: 1 / (1 + math.exp(-max(-30, min(30, v))))
    out = []
    for raw in rows:
        if any(map(math.isnan, raw)):
            out.append(None)
            continue
        warm = trained >= 210
        if not warm:
            lo, hi = [min(p, q) for p, q in zip(lo, raw)], [max(p, q) for p, q in zip(hi, raw)]
        x = [min(1, max(0, (v - (p if math.isfinite(p) else 0)) / (q - p if math.isfinite(q - p) and q - p > 1e-9 else 1))) for v, p, q in zip(raw, lo, hi)]
        h = [squash(sum(x[i] * a[i][j] for i in range(size)) + a0[j]) for j in range(hidden)]
        y = [squash(sum(h[j] * b[j][i] for j in range(hidden)) + b0[i]) for i in range(size)]
        rmse = math.sqrt(sum((p - q) ** 2 for p, q in zip(y, x)) / size)
        out.append(rmse)
        usual = max(1e-3, error + 3 * math.sqrt(var), 1.5 * error)
        if warm and frozen < 240 and min(1, (rmse / usual - 1) / 2) >= 0.2:
            frozen += 1
            continue
        frozen = 0
        if warm:
            lo, hi = [min(p, q) for p, q in zip(lo, raw)], [max(p, q) for p, q in zip(hi, raw)]
        d = [(p - q) * p * (1 - p) for p, q in zip(y, x)]
        e = [sum(d[i] * b[j][i] for i in range(size)) * h[j] * (1 - h[j]) for j in range(hidden)]
        for j in range(hidden):
            for i in range(size):
                b[j][i] -= 0.4 * h[j] * d[i]
                a[i][j] -= 0.4 * x[i] * e[j]
            a0[j] -= 0.4 * e[j]
        b0 = [p - 0.4 * q for p, q in zip(b0, d)]
        trained += 1
        if trained > 120:
            rate = max(0.01, min(0.2, 1 / (trained - 120)))
            gap = rmse - error
            error += rate * gap
            var = (1 - rate) * (var + rate * gap * gap)
    return out


def test_nets_equal_a_replay_neuron_by_neuron():
    ts, x = history(500)
    got = L.Ladder(FEATURES, stages=("l2",)).frames(ts, x)[2]
    k = L.ORDER.index("gateway")
    assert BUNDLES["gateway"] == FEATURES[:3]
    want = replay_net(x[:, :3].tolist(), L.net_seed("gateway"))
    assert [w is None for w in want] == [row[k] is None for row in got]
    assert np.allclose([w for w in want if w is not None], [row[k] for row in got if row[k] is not None], atol=1e-7)


def test_a_saved_ladder_goes_on_where_it_stopped():
    ts, x = history(900)
    whole = L.Ladder(FEATURES).frames(ts, x)
    first = L.Ladder(FEATURES)
    a = first.frames(ts[:433], x[:433])
    b = L.Ladder.load(first.dump(), FEATURES).frames(ts[433:], x[433:])
    assert whole == [p + q for p, q in zip(a, b)]
    with pytest.raises(ValueError):
        L.Ladder.load(first.dump(), FEATURES[1:])


def test_drift_relearns_once_per_cooldown_and_starts_anew():
    ts, x = history(1500)
    added = L.Ladder(FEATURES).frames(ts, x)
    hits = [(i, d["feature"]) for i, checks in enumerate(added[7]) if checks for d in checks if d["drifted"]]
    dns = [i for i, f in hits if f == "dns_p50_ms"]
    assert dns and all(b - a >= 120 for a, b in zip(dns, dns[1:])) and all((i + 1) % L.DRIFT_EVERY == 0 for i, _ in hits)
    i = next(i for i in dns if not math.isnan(x[i + 1, 4]))
    assert added[0][i + 1][4] == 0.0  # a new baseline has no contribution yet


def test_paused_learning_changes_nothing():
    ts, x = history(300)
    ladder = L.Ladder(FEATURES)
    ladder.frames(ts[:200], x[:200])
    before = ladder.dump()
    ladder.frames(ts[200:], x[200:], np.zeros(100, bool))
    assert ladder.dump() == before


def test_psi_tells_shifts_apart():
    rng = np.random.default_rng(0)
    a = rng.normal(size=480)
    assert L.psi(a, rng.normal(size=240)) < 0.1 < 0.25 < L.psi(a, rng.normal(2, 1, 240))
    assert L.psi(a[:1], a) == 0.0


@given(st.lists(st.floats(0, 1), min_size=30, max_size=60))
def test_risk_and_health_stay_in_range(raw):
    r = S.Risk()
    for p in raw:
        risk = r.step(p, 0.0, 1.0)
        assert 0 <= risk <= 1 and 0 <= r.step_health(p, p, risk, 0.0) <= 100


def test_blind_frame_publishes_the_floor_but_keeps_smoothing():
    r = S.Risk()
    assert r.step(1.0, 0.2, 0.1) == 0.2 and r.risk == 0.35


def test_cooldown_counts_from_the_last_kept_event():
    c = S.Cooldown(100.0)
    assert [c.step(t) for t in (0, 60, 120, 180, 230)] == [True, False, True, False, True]
    c = S.Cooldown(100.0)
    assert [c.step(0, 1, True), c.step(10, 1, True), c.step(20, 2, True)] == [True, False, True]


def test_another_layout_is_refused():
    m = example_model().to_dict()
    assert len(LAYOUT) == 67 and Forecast(**m).weights == m["weights"]
    with pytest.raises(ValueError):
        Forecast(**(m | {"layout": LAYOUT[::-1]}))


def test_all_stages(spark):
    """A host that is well, then loses its gateway, then is well again; another that is silent."""
    rows = [(1, k, 1.7e9 + 15.0 * k, 4.0 + 0.1 * (k % 5), 0.0 if k < 200 or k > 260 else 1.0, 20.0, 0.0, 1.0) for k in range(330)]
    rows += [(2, k, 1.7e9 + 15.0 * k, None, None, None, None, None) for k in range(5)]
    have = ["gw_rtt_ms", "gw_loss_rate", "dns_p50_ms", "dns_fail_rate", "gw_jitter_ms"]
    out = score_frames(spark.createDataFrame(rows, f"host_id long, tick long, ts double, {', '.join(f'{c} double' for c in have)}"), have)
    got = {(r.host_id, r.tick): r for r in out.collect()}
    assert len(got) == 335
    assert got[1, 199].severity == "info" and got[1, 230].severity == "critical" and got[1, 230].risk_15m >= 0.95
    assert got[1, 230].primary_layer == "gateway" and got[1, 230].template_id == "gateway.unreachable" and got[1, 199].template_id is None
    assert [t for (h, t), r in got.items() if h == 1 and r.opened] == [205] and [t for (h, t), r in got.items() if h == 1 and r.closed]
    assert got[1, 230].health < 20 < got[1, 329].health and got[1, 10].warming_up and not got[1, 150].warming_up
    assert all(r.coverage == 0 and r.severity == "info" and not r.opened for (h, _), r in got.items() if h == 2)


def test_drift_takes_frames_in_blocks_as_one_by_one():
    """Blocks up to a check leave the windows that single frames leave, with gaps, full rings and paused frames."""
    ts, x = history(1300, 3)
    learn = np.random.default_rng(1).random(1300) < 0.9
    whole, single = L.Ladder(FEATURES, stages=("drift",)), L.Ladder(FEATURES, stages=("drift",))
    blocks = []
    take = whole.drift.frames_of
    whole.drift.frames_of = lambda rows, t: blocks.append(len(rows)) or take(rows, t)
    got = whole.frames(ts, x, learn)
    want = [single.frames(ts[i : i + 1], x[i : i + 1], learn[i : i + 1]) for i in range(1300)]
    assert got[7] == [w[7][0] for w in want] and got[6] == [w[6][0] for w in want]
    assert len(blocks) <= 1300 * 0.95 / L.DRIFT_EVERY + 2 and max(blocks) == L.DRIFT_EVERY
    assert np.array_equal(whole.drift.reference.values, single.drift.reference.values)


def test_nets_without_their_inputs_cost_nothing(monkeypatch):
    ts, x = history(200)
    calls, step = [], L.Net.frame
    monkeypatch.setattr(L.Net, "frame", lambda self, inputs, learn=True: calls.append(len(inputs)) or step(self, inputs, learn))
    L.Ladder(FEATURES, stages=("l2",)).frames(ts, x)
    full = int((~np.isnan(x[:, :3]).any(1)).sum())
    assert sorted(calls) == [3] * full + [6] * 200  # of six layers only the gateway is measured; the last is the joint net


def test_few_hosts_share_no_partition(spark):
    for kind in ("int", "bigint"):
        frames = L.by_host(spark.range(16).selectExpr(f"CAST(id AS {kind}) AS host_id"))
        assert frames.rdd.glom().map(len).filter(lambda n: n > 1).isEmpty()


def test_windows_are_those_of_a_slice_and_need_one_shuffle(spark):
    """Checks against plain slices of the values; no value is copied: the plan has one exchange and no join."""
    from hostvigil.operators.windows import check_windows

    ts, x = history(400, 5)
    rows = [(1, float(t), *(None if math.isnan(v) else float(v) for v in r)) for t, r in zip(ts, x[:, :2])]
    out = check_windows(spark.createDataFrame(rows, "host_id long, ts double, a double, b double"), ["a", "b"], None, 7, 30, 50, 20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
    want = {}
    for k, f in enumerate("ab"):
        for i in range(6, 400, 7):
            seen = [v for v in x[: i + 1, k].tolist() if not math.isnan(v)]
            recent, reference = seen[-30:], seen[-80:-30]
            if min(len(recent), len(reference)) >= 20:
                want[f, ts[i]] = (len(recent), len(reference), np.mean(recent), np.mean(reference), float(L.psi(np.array(reference), np.array(recent))))
    got = {(r.feature, r.ts): tuple(r)[3:] for r in out.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_drift_reads_sorted_windows(monkeypatch):
    """Shares of bins are places in sorted windows, of which the values aren't compared with every edge; they are the plain counts."""
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 12, (480, 3)) / 10, rng.integers(0, 15, (240, 3)) / 10
    a[:, 2] = 1.0
    want = []
    for x, y in zip(a.T, b.T):
        edges = np.quantile(x, np.arange(1, 10) / 10)
        share = lambda v: np.maximum(np.diff([0, *[(v <= e).sum() for e in edges], len(v)]) / len(v), 1e-4)
        want.append(float(np.sum((share(y) - share(x)) * np.log(share(y) / share(x)))))
    monkeypatch.setattr(np, "count_nonzero", None)
    assert np.allclose(L.psi(a, b), want, rtol=0, atol=1e-9)


def test_rings_take_whole_rows(monkeypatch):
    """Rows without gaps go in whole, and give what single values give."""
    rng = np.random.default_rng(9)
    blocks = [rng.normal(size=(n, 4)) for n in (3, 5, 7, 1, 7, 4)]
    whole, single = L.Rings(7, 4), [L.Rings(7, 1) for _ in range(4)]
    want = []
    for x in blocks:
        gap = [np.insert(x[:, k : k + 1], len(x), np.nan, 0) for k in range(4)]  # a frame without a value
        want.append(np.concatenate([r.push(g)[: len(x)] for r, g in zip(single, gap)], 1))
    monkeypatch.setattr(np, "nonzero", None)
    for x, w in zip(blocks, want):
        assert np.array_equal(whole.push(x), w, equal_nan=True)
    assert all(np.array_equal(whole.of(k), single[k].of(0)) for k in range(4))


def test_the_jvm_takes_the_steps_of_the_plain_numbers(spark):
    """Frames pass no Python, and what they learn is what a ladder learns, to the last bit, with gaps, pauses and limits."""
    learn = np.random.default_rng(2).random(1500) < 0.95
    rows, want = [], {}
    for h in (1, 2):
        ts, x = history(1500, h)
        rows += [(h, i, float(t), bool(b), *(None if math.isnan(v) else float(v) for v in r)) for i, (t, b, r) in enumerate(zip(ts, learn, x))]
        want[h] = L.Ladder(FEATURES).frames(ts, x, learn)
    frames = spark.createDataFrame(rows, f"host_id long, tick long, ts double, learn boolean, {', '.join(f'{f} double' for f in FEATURES)}")
    out = L.climb(frames, FEATURES, learn="learn", keep=["host_id", "tick", "ts"], packed=FEATURES[:2])
    assert "Python" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan
    got = {(r.host_id, r.tick): r for r in out.collect()}
    assert len(got) == 3000 and any(d["drifted"] for checks in want[1][7] if checks for d in checks)
    for h in (1, 2):
        for i, f in enumerate(L.ADDED[:7]):
            assert [got[h, k][f.name] for k in range(1500)] == want[h][i], f.name
        for k, checks in enumerate(want[h][7]):
            mine = got[h, k]["drift"]
            assert (mine is None) == (checks is None)
            for a, b in zip(mine or [], checks or []):
                assert a["psi"] == pytest.approx(b["psi"], abs=1e-12) and {**a.asDict(), "psi": 0} == {**b, "psi": 0}
    assert all(got[r[0], r[1]]["packed"] == list(r[4:6]) for r in rows)
    near = {(r.host_id, r.tick): r.l1 for r in L.climb(frames, FEATURES, limits=[30.0] * 5, wanted={"l1"}).collect()}
    assert all((near[h, k][0] is None) == all(rows[(h - 1) * 1500 + j][4] is None for j in range(max(0, k - 2), k + 1)) for h in (1, 2) for k in range(1500))


@pytest.mark.parametrize("x", [0.0, 1e-9, 0.3, -0.3465, 0.34657, 0.5, -1.0397, 1.04, 7.7, -29.99, 30.0])
def test_the_exponential_is_that_of_the_jvm(spark, x):
    assert L._exp(x) == spark._jvm.StrictMath.exp(x) and abs(L._exp(x) / math.exp(x) - 1) < 1e-15
