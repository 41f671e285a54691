"""The learned stages of a host as array recurrences over all of its features: baselines, autoencoders, drift.

A host's frames are read once, in order of time, by a task that carries arrays of fixed size from frame to frame and
from batch to batch, so no history is ever held; hosts run side by side. Every array has a column a feature (or a layer
a net), so a frame costs a fixed number of array operations however many features there are. `Ladder.dump` and `load`
carry the state over to a later slice of the frames or to a stream (see `saved`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hostvigil.catalogue import BUNDLES, LAYER_OF, WORSE_UP
from hostvigil.operators import native, saved

# Rates and limits of the models.
RATE_LEAST, RATE_MOST = 0.002, 0.05
SMOOTHING, DEADBAND, MAX_CONTRIBUTION = 0.3, 1.5, 12.0
FREEZE_AT, FREEZE_COUNT, FREEZE_STEPS = 1.5, 30, 240
CUSUM_K, CUSUM_LIMIT, CUSUM_SHIFT = 0.5, 6.0, 4.5
BUCKET_WARM, COLD_SPREAD, SPREAD_FLOOR = 12, 2.5, 0.25
HIDDEN, LEARNING, SETTLE, NET_WARM, NET_FREEZE = 0.6, 0.4, 120, 210, 0.2
REFERENCE_SIZE, RECENT_SIZE, DRIFT_MIN, DRIFT_EVERY, DRIFT_PSI, DRIFT_COOLDOWN = 480, 240, 120, 60, 0.25, 1800.0
OUTPUT_SEED = 99

ORDER = sorted(BUNDLES)
HOURS = 24


class Baselines:
    """Moments by hour of day (rows 0 to 23) and over all hours (row 24), contributions and shifts; a column a feature."""

    def __init__(self, worse_up: list[bool]):
        k = len(worse_up)
        self.sign = np.where(worse_up, 1.0, -1.0)
        self.count, self.mean, self.var = (np.zeros((HOURS + 1, k)) for _ in range(3))
        self.smooth, self.high, self.low, self.frozen = (np.zeros(k) for _ in range(4))

    def forget(self, which: np.ndarray) -> None:
        """The baselines of these features start anew."""
        for table in (self.count, self.mean, self.var):
            table[:, which] = 0.0
        for row in (self.smooth, self.high, self.low, self.frozen):
            row[which] = 0.0

    def frames(self, x: np.ndarray, hours: list[int], learn: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Smoothed contributions and CUSUM of some frames (NaN: absent), each judged by the past; then what looks usual is
        learned. Features don't depend on each other, so each steps through the frames of an hour in plain numbers."""
        out, highs = np.full(x.shape, np.nan), np.full(x.shape, np.nan)
        cuts = [0, *[i for i in range(1, len(hours)) if hours[i] != hours[i - 1]], len(hours)]
        for a, b in zip(cuts, cuts[1:]):
            for k in np.flatnonzero(~np.isnan(x[a:b]).all(0)).tolist():
                out[a:b, k], highs[a:b, k] = self._hour(k, x[a:b, k].tolist(), hours[a], learn[a:b])
        return out, highs

    def _hour(self, k: int, values: list[float], hour: int, learn: list[bool]) -> tuple[list[float], list[float]]:
        sign, smooth, high, low, frozen = (row[k].item() for row in (self.sign, self.smooth, self.high, self.low, self.frozen))
        (n, mean, var), (n_all, mean_all, var_all) = ([table[row, k].item() for table in (self.count, self.mean, self.var)] for row in (hour, HOURS))
        contributions, highs = [], []
        for v, learns in zip(values, learn):
            if v != v:
                contributions.append(v)
                highs.append(v)
                continue
            # distance from the usual in spreads, positive for worse: against the hour if it is known, else all hours
            gap, gap_all = v - mean, v - mean_all
            if n >= BUCKET_WARM:
                spread, least = math.sqrt(var) if var > 0.0 else 0.0, SPREAD_FLOOR * abs(mean)
                spread = least if least > spread else spread
                z = sign * gap / (spread if spread > 1e-6 else 1e-6)
            elif n_all >= 4:
                spread, least = math.sqrt(var_all) if var_all > 0.0 else 0.0, SPREAD_FLOOR * abs(mean_all)
                spread = least if least > spread else spread
                z = sign * gap_all / (COLD_SPREAD * (spread if spread > 1e-6 else 1e-6))
            else:
                z = 0.0
            now = z - DEADBAND
            now = 0.0 if now < 0.0 else MAX_CONTRIBUTION if now > MAX_CONTRIBUTION else now
            if not learns:
                contributions.append(now)
                highs.append(high)
                continue
            smooth += SMOOTHING * (now - smooth)
            high = high + z - CUSUM_K
            high = 0.0 if high < 0.0 else CUSUM_LIMIT if high > CUSUM_LIMIT else high
            low = low - z - CUSUM_K
            low = 0.0 if low < 0.0 else CUSUM_LIMIT if low > CUSUM_LIMIT else low
            contributions.append(smooth)
            highs.append(high)
            if now >= FREEZE_AT and frozen < FREEZE_STEPS and n_all >= FREEZE_COUNT:
                frozen += 1.0
                continue
            frozen = 0.0
            n += 1.0
            n_all += 1.0
            if n > 1.0:
                rate = 1 / n
                rate = RATE_LEAST if rate < RATE_LEAST else RATE_MOST if rate > RATE_MOST else rate
                mean += rate * gap
                var = (1 - rate) * (var + rate * gap * gap)
            else:
                mean += gap
            if n_all > 1.0:
                rate = 1 / n_all
                rate = RATE_LEAST if rate < RATE_LEAST else RATE_MOST if rate > RATE_MOST else rate
                mean_all += rate * gap_all
                var_all = (1 - rate) * (var_all + rate * gap_all * gap_all)
            else:
                mean_all += gap_all
        for row, moments in ((hour, (n, mean, var)), (HOURS, (n_all, mean_all, var_all))):
            self.count[row, k], self.mean[row, k], self.var[row, k] = moments
        self.smooth[k], self.high[k], self.low[k], self.frozen[k] = smooth, high, low, frozen
        return contributions, highs

    def shifted(self) -> np.ndarray:
        return self.high >= CUSUM_SHIFT


#: fdlibm's exponential, as java.lang.StrictMath has it (see `native`): the same bits on every machine.
_LN2_HI, _LN2_LO, _PER_LN2 = 6.93147180369123816490e-01, 1.90821492927058770002e-10, 1.44269504088896338700e00
_P1, _P2, _P3, _P4, _P5 = 1.66666666666666019037e-01, -2.77777777770155933842e-03, 6.61375632143793436117e-05, -1.65339022054652515390e-06, 4.13813679705723846039e-08
_HALF_LN2, _MORE_LN2 = (float.fromhex(v) for v in ("0x1.62e43p-2", "0x1.0a2b2p+0"))
_POWERS = {k: math.ldexp(1.0, k) for k in range(-64, 65)}


def _exp(x: float) -> float:
    """Of an x from -30 to 30."""
    size = -x if x < 0.0 else x
    if size < _HALF_LN2:
        if size < 2.0**-28:
            return 1.0 + x
        t = x * x
        c = x - t * (_P1 + t * (_P2 + t * (_P3 + t * (_P4 + t * _P5))))
        return 1.0 - ((x * c) / (c - 2.0) - x)
    k = (1 if x > 0.0 else -1) if size < _MORE_LN2 else int(_PER_LN2 * x + (0.5 if x > 0.0 else -0.5))
    hi, lo = x - k * _LN2_HI, k * _LN2_LO
    x = hi - lo
    t = x * x
    c = x - t * (_P1 + t * (_P2 + t * (_P3 + t * (_P4 + t * _P5))))
    return (1.0 - ((lo - (x * c) / (2.0 - c)) - hi)) * _POWERS[k]


def _squash(x: float) -> float:
    return 1 / (1 + _exp(30.0 if x < -30 else -30.0 if x > 30 else -x))


class Net:
    """A net of `Nets` in plain numbers, a list a hidden unit: with so few, an array operation costs more than its sums."""

    def __init__(self, nets: Nets, i: int):
        self.nets, self.i = nets, i
        n, h = int(nets.sizes[i]), int(nets.hidden[i])
        self.into, self.into0 = nets.into[i, :n, :h].T.tolist(), nets.into0[i, :h].tolist()
        self.back, self.back0 = nets.back[i, :h, :n].tolist(), nets.back0[i, :n].tolist()
        self.least, self.most = nets.least[i, :n].tolist(), nets.most[i, :n].tolist()
        self.trained, self.frozen, self.error, self.spread = (table[i].item() for table in (nets.trained, nets.frozen, nets.error, nets.spread))

    def put_back(self) -> None:
        nets, i = self.nets, self.i
        n, h = int(nets.sizes[i]), int(nets.hidden[i])
        nets.into[i, :n, :h], nets.into0[i, :h] = np.array(self.into).T, self.into0
        nets.back[i, :h, :n], nets.back0[i, :n] = self.back, self.back0
        nets.least[i, :n], nets.most[i, :n] = self.least, self.most
        nets.trained[i], nets.frozen[i], nets.error[i], nets.spread[i] = self.trained, self.frozen, self.error, self.spread

    def usual(self) -> float:
        """The error that passes as usual."""
        return max(1e-3, self.error + 3 * math.sqrt(self.spread) if self.spread > 0 else self.error, 1.5 * self.error)

    def frame(self, x: list[float], learn: bool = True) -> tuple[float, float, float]:
        """The error of rebuilding the inputs, judged before learning; behind it 0 up to the usual error, 1 from three times it
        (0 while the net settles), and the error by the usual one."""
        warm = self.trained >= NET_WARM
        if learn and not warm:
            self._widen(x)
        scaled, wider = [], False
        for v, low, high in zip(x, self.least, self.most):
            span = high - low
            if 1e-9 < span < math.inf:
                v = (v - low) / span
                if v < 0.0 or v > 1.0:
                    wider = True
            else:
                wider = True
                v = v - low if math.isfinite(low) else v
            scaled.append(0.0 if v < 0.0 else 1.0 if v > 1.0 else v)
        inner = [_squash(math.sumprod(row, scaled) + b) for row, b in zip(self.into, self.into0)]
        outer = [_squash(math.sumprod(column, inner) + b) for column, b in zip(zip(*self.back), self.back0)]
        gap = [p - q for p, q in zip(outer, scaled)]
        rmse = math.sqrt(math.sumprod(gap, gap) / len(gap))
        usual = self.usual()
        if learn:
            if warm and self.frozen < FREEZE_STEPS and (rmse / usual - 1) / 2 >= NET_FREEZE:
                self.frozen += 1.0
            else:
                self.frozen = 0.0
                if warm and wider:
                    self._widen(x)
                self._learn(scaled, inner, outer, gap)
                self.trained += 1.0
                if self.trained > SETTLE:
                    rate = min(max(1 / (self.trained - SETTLE), 0.01), 0.2)
                    off = rmse - self.error
                    self.error += rate * off
                    self.spread = (1 - rate) * (self.spread + rate * off * off)
                    usual = self.usual()
        excess = (rmse / usual - 1) / 2 if self.trained >= NET_WARM else 0.0
        return rmse, 0.0 if excess < 0.0 else 1.0 if excess > 1.0 else excess, rmse / usual

    def _learn(self, scaled: list[float], inner: list[float], outer: list[float], gap: list[float]) -> None:
        slope = [g * y * (1 - y) for g, y in zip(gap, outer)]
        below = [LEARNING * math.sumprod(row, slope) * h * (1 - h) for row, h in zip(self.back, inner)]
        step = [LEARNING * s for s in slope]
        self.back = [[w - h * s for w, s in zip(row, step)] for row, h in zip(self.back, inner)]
        self.back0 = [w - s for w, s in zip(self.back0, step)]
        self.into = [[w - b * v for w, v in zip(row, scaled)] for row, b in zip(self.into, below)]
        self.into0 = [w - b for w, b in zip(self.into0, below)]

    def _widen(self, x: list[float]) -> None:
        self.least, self.most = list(map(min, self.least, x)), list(map(max, self.most, x))


class Nets:
    """Small sigmoid autoencoders side by side, padded to one shape; the padding stays zero."""

    def __init__(self, sizes: list[int], seeds: list[int]):
        self.sizes = np.array(sizes)
        self.hidden = np.maximum(1, np.minimum(self.sizes, np.ceil(self.sizes * HIDDEN).astype(int)))
        k, wide, deep = len(sizes), int(self.sizes.max()), int(self.hidden.max())
        self.into, self.into0 = np.zeros((k, wide, deep)), np.zeros((k, deep))
        self.back, self.back0 = np.zeros((k, deep, wide)), np.zeros((k, wide))
        self.least, self.most = np.full((k, wide), np.inf), np.full((k, wide), -np.inf)
        self.trained, self.frozen, self.error, self.spread = (np.zeros(k) for _ in range(4))
        for i, seed in enumerate(seeds):
            self.restart(i, seed)

    def restart(self, i: int, seed: int = 0) -> None:
        n, h = int(self.sizes[i]), int(self.hidden[i])
        rng, reach = np.random.default_rng(seed), np.sqrt(6 / (n + h))
        for table in (self.into, self.into0, self.back, self.back0, self.trained, self.frozen, self.error, self.spread):
            table[i] = 0
        self.into[i, :n, :h] = rng.uniform(-reach, reach, (n, h))
        self.back[i, :h, :n] = rng.uniform(-reach, reach, (h, n))
        self.least[i], self.most[i] = np.inf, -np.inf

    def each(self) -> list[Net]:
        """The nets in plain numbers; `put_back` brings home what they learned."""
        return [Net(self, i) for i in range(len(self.sizes))]


_PLACES = np.arange(1, 10)[:, None]


def psi(reference: np.ndarray, recent: np.ndarray) -> np.ndarray:
    """Population stability index over the reference's decile edges, a column a feature."""
    if len(reference) < 2 or len(recent) < 2:
        return np.zeros(reference.shape[1:])
    ordered, other = (np.sort(np.ascontiguousarray(v.reshape(len(v), -1).T), 1) for v in (reference, recent))  # a row a feature
    n = len(reference)
    place = _PLACES * (n - 1) / 10
    low = np.floor(place).astype(int)[:, 0]
    part = place - low[:, None]
    edges = ordered.T[low] * (1 - part) + ordered.T[np.minimum(low + 1, n - 1)] * part
    shares = []
    for values in (ordered, other):  # a bin holds what is over its lower edge, up to the upper one; of equal edges none
        upto = np.zeros((len(edges) + 2, len(values)))
        upto[-1] = values.shape[1]
        for k, (row, at) in enumerate(zip(values, edges.T)):
            upto[1:-1, k] = row.searchsorted(at, "right")
        shares.append(np.maximum(np.diff(upto, axis=0) / values.shape[1], 1e-4))
    return np.sum((shares[1] - shares[0]) * np.log(shares[1] / shares[0]), 0).reshape(reference.shape[1:])


class Rings:
    """The last `size` values of each feature; a column a feature."""

    def __init__(self, size: int, k: int):
        self.values, self.count, self.at = np.zeros((size, k)), np.zeros(k, np.int64), np.zeros(k, np.int64)

    def push(self, x: np.ndarray) -> np.ndarray:
        """Add up to `size` rows (NaN: no value). Gives what falls out, where and as long as something does."""
        size, here = len(self.values), ~np.isnan(x)
        if here.all() and len(self.at) and (self.at == self.at[0]).all() and (self.count == self.count[0]).all():  # whole rows
            n, seen, first = len(x), int(self.count[0]), int(self.at[0])
            at = (first + np.arange(n)) % size
            out = self.values[at]
            out[: max(0, size - seen)] = np.nan
            self.values[at] = x
            self.at[:], self.count[:] = (first + n) % size, min(seen + n, size)
            return out
        row, col = np.nonzero(here)
        rank = (np.cumsum(here, 0) - 1)[row, col]
        at = (self.at[col] + rank) % size
        out = np.full(x.shape, np.nan)
        out[row, col] = np.where(self.count[col] + rank >= size, self.values[at, col], np.nan)
        self.values[at, col] = x[row, col]
        n = here.sum(0)
        self.at = (self.at + n) % size
        self.count = np.minimum(self.count + n, size)
        return out

    def of(self, k: int) -> np.ndarray:
        """Oldest first."""
        full = self.count[k] == len(self.values)
        return np.roll(self.values[:, k], -self.at[k]) if full else self.values[: self.count[k], k]

    def take(self, k: int, values: np.ndarray) -> None:
        self.values[: len(values), k] = values
        self.count[k] = len(values)
        self.at[k] = len(values) % len(self.values)


class Drift:
    """Recent values and, before them, reference values of each feature; where they part, the recent ones are the new reference."""

    def __init__(self, k: int):
        self.reference, self.recent = Rings(REFERENCE_SIZE, k), Rings(RECENT_SIZE, k)
        self.last, self.psi, self.frames = np.zeros(k), np.zeros(k), 0

    def frames_of(self, x: np.ndarray, ts: float) -> np.ndarray | None:
        """Take some frames, at most up to the next check, of which ts is the last one's time; on a check (every DRIFT_EVERY-th
        frame) which features drifted, else nothing."""
        self.frames += len(x)
        self.reference.push(self.recent.push(x))
        if not len(x) or self.frames % DRIFT_EVERY:
            return None
        due = self.ready() & (ts - self.last >= DRIFT_COOLDOWN)
        drifted = np.zeros(x.shape[1], bool)
        sizes = np.stack((self.reference.count, self.recent.count), 1)
        for n, m in {tuple(v) for v in sizes[due].tolist()}:  # features of windows of the same sizes at once
            at = np.flatnonzero(due & (sizes == (n, m)).all(1))
            self.psi[at] = psi(self.reference.values[:n, at], self.recent.values[:m, at])
            for k in at[self.psi[at] >= DRIFT_PSI].tolist():
                drifted[k] = True
                self.reference.take(k, self.recent.of(k))
                self.last[k] = ts
        return drifted

    def ready(self) -> np.ndarray:
        return np.minimum(self.reference.count, self.recent.count) >= DRIFT_MIN


def net_seed(layer: str) -> int:
    """Seed of a layer's first net: its place among all layer names in order, from 1."""
    return sorted(set(LAYER_OF.values())).index(layer) + 1


#: What a ladder adds to a frame; arrays are in the order of the features, `nets` in that of ORDER.
NET = T.ArrayType(T.DoubleType())
CHECK = T.ArrayType(T.StructType([T.StructField("feature", T.StringType()), T.StructField("psi", T.DoubleType()), T.StructField("n_reference", T.IntegerType()), T.StructField("n_recent", T.IntegerType()), T.StructField("ready", T.BooleanType()), T.StructField("drifted", T.BooleanType())]))
ADDED = [T.StructField(n, NET) for n in ("l1", "cusum_high", "l2_rmse", "l2_score", "l2_relative")] + [T.StructField("l2_anomaly", T.DoubleType()), T.StructField("drift_frame", T.IntegerType()), T.StructField("drift", CHECK)]


class Ladder:
    """A host's learned stages. `adapt`: a feature that drifts has its baseline and its layer's net start anew."""

    def __init__(self, features: list[str], adapt: bool = True, stages: tuple[str, ...] = ("l1", "l2", "drift")):
        self.features, self.adapt, self.stages = features, adapt, stages
        self.baselines = Baselines([WORSE_UP[f] for f in features])
        self.place = [[features.index(f) if f in features else -1 for f in BUNDLES[x]] for x in ORDER]
        self.nets = Nets([len(p) for p in self.place], [net_seed(x) for x in ORDER])
        self.output = Nets([len(ORDER)], [OUTPUT_SEED])
        self.drift = Drift(len(features))

    def frames(self, ts: np.ndarray, x: np.ndarray, learn: np.ndarray | None = None) -> list[list]:
        """What to add for each of some frames in order of time; x has a row a frame and a column a feature."""
        return [column.to_pylist() for column in self.columns(ts, x, learn)]

    def columns(self, ts: np.ndarray, x: np.ndarray, learn: np.ndarray | None = None) -> list[pa.Array]:
        """`frames` as the columns of ADDED. The stages take turns over the frames up to a drift check, where what drifted starts
        anew; in between they don't depend on each other."""
        n = len(x)
        learns = np.ones(n, bool) if learn is None else np.asarray(learn, bool)
        hours = ((ts // 3600).astype(np.int64) % HOURS).tolist()
        l1, high = np.full(x.shape, np.nan), np.full(x.shape, np.nan)
        rmse, score, relative = np.full((n, len(ORDER)), np.nan), np.zeros((n, len(ORDER))), np.ones((n, len(ORDER)))
        joint = np.zeros(n)
        checks: dict[int, list[dict]] = {}
        nets, output = self.nets.each(), self.output.each()[0]
        # a check is due behind each DRIFT_EVERY-th frame that is learned from
        counted = self.drift.frames + np.cumsum(learns)
        due = np.flatnonzero(learns & (counted % DRIFT_EVERY == 0)) + 1 if "drift" in self.stages else np.zeros(0, np.int64)
        cuts = [0, *due.tolist(), *([n] if not len(due) or due[-1] < n else [])]
        for a, b in zip(cuts, cuts[1:]):
            lessons = learns[a:b].tolist()
            if "l1" in self.stages:
                l1[a:b], high[a:b] = self.baselines.frames(x[a:b], hours[a:b], lessons)
            if "l2" in self.stages:
                for k, (net, place) in enumerate(zip(nets, self.place)):
                    if min(place) >= 0:  # else an input isn't measured at all
                        for i, inputs in enumerate(x[a:b, place].tolist(), a):
                            if not any(map(math.isnan, inputs)):
                                rmse[i, k], score[i, k], relative[i, k] = net.frame(inputs, lessons[i - a])
                np.minimum(relative[a:b], 5.0, out=relative[a:b])
                joint[a:b] = [output.frame(inputs, lesson)[1] for inputs, lesson in zip(relative[a:b].tolist(), lessons)]
            if "drift" in self.stages:
                drifted = self.drift.frames_of(x[a:b][learns[a:b]], float(ts[b - 1]))
                if drifted is not None:
                    d = self.drift
                    checks[b - 1] = [dict(zip(("feature", "psi", "n_reference", "n_recent", "ready", "drifted"), v)) for v in zip(self.features, d.psi.tolist(), d.reference.count.tolist(), d.recent.count.tolist(), d.ready().tolist(), drifted.tolist())]
                    if self.adapt and drifted.any():
                        self.baselines.forget(drifted)
                        for layer in sorted({LAYER_OF[f] for f, hit in zip(self.features, drifted) if hit} & set(ORDER)):
                            self.nets.restart(ORDER.index(layer))
                            nets[ORDER.index(layer)] = Net(self.nets, ORDER.index(layer))
        for net in (*nets, output):
            net.put_back()
        none = lambda t: pa.nulls(n, t)
        out = [_lists(l1), _lists(high)] if "l1" in self.stages else list(map(none, ARROW[:2]))
        if "l2" in self.stages:
            out += [_lists(rmse), _lists(score), _lists(relative), pa.array(np.minimum(1.0, np.maximum(joint, score.max(1, initial=0.0))))]
        else:
            out += list(map(none, ARROW[2:6]))
        at = [checks.get(i) for i in range(n)]
        number = [None if v is None else c for v, c in zip(at, counted.tolist())]
        return [*out, pa.array(number, ARROW[6]), pa.array(at, ARROW[7])]

    def layout(self) -> str:
        return saved.layout_of("ladder", self.features, self.stages)

    def dump(self) -> bytes:
        return saved.save(self, self.layout())

    @staticmethod
    def load(state: bytes, features: list[str], adapt: bool = True, stages: tuple[str, ...] = ("l1", "l2", "drift")) -> Ladder:
        """The saved ladder; one of other features is refused."""
        found = Ladder(features, adapt, stages)
        saved.restore(found, found.layout(), state)
        return found


def _lists(x: np.ndarray) -> pa.Array:
    """A list a row; NaN is null."""
    flat = pa.array(np.ascontiguousarray(x).ravel(), from_pandas=True)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), flat)


ARROW = [pa.list_(pa.float64())] * 5 + [pa.float64(), pa.int32(), pa.list_(pa.struct([("feature", pa.string()), ("psi", pa.float64()), ("n_reference", pa.int32()), ("n_recent", pa.int32()), ("ready", pa.bool_()), ("drifted", pa.bool_())]))]


def by_host(frames: DataFrame) -> DataFrame:
    """A host's frames in one partition. The number of partitions is given, since a frame costs far more than its bytes tell:
    Spark would put small tables into one task. It is far over the number of tasks at a time, so that few hosts share one."""
    return frames.repartition(max(200, int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "host_id")


def host_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, pa.RecordBatch]]:
    """(host, its next frames) from sorted batches; a host may come in several."""
    for b in batches:
        hosts, start = pc.run_end_encode(b.column("host_id")), 0
        for end, host in zip(hosts.run_ends.to_pylist(), hosts.values.to_pylist()):
            yield host, b.slice(start, end - start)
            start = end


def scan(frames: DataFrame, start: Callable[[], object], step: Callable[[object, pa.RecordBatch], list[pa.Array]], added: list[T.StructField], dealt: bool = False, keep: list[str] | None = None, state: str | None = None, ordered: bool = False) -> DataFrame:
    """`frames` (or their columns `keep`) with columns that depend on a host's earlier frames: `step` gets the host's state
    and its next frames. `dealt`: a host's frames are in one partition already; `ordered`: they also come in order of time, as
    another scan left them, and aren't sorted once more (frames out of order are an error).

    `state` names a binary column for scans that go on from a saved state. A row without ts holds a host's state in it, which
    `load` reads before the host's first frame; frames up to the last one that the state has `seen` are left out. What a host
    leaves comes back as such a row, with the other columns of the row that came in.
    """
    out = T.StructType([*[f for f in frames.schema.fields if keep is None or f.name in keep], *added])
    kept, types = [f.name for f in out.fields][: len(out.fields) - len(added)], [to_arrow_type(f.dataType) for f in out.fields]

    def left(host: int, found: object, row: dict, came: pa.Schema) -> pa.RecordBatch:
        values = row | {"host_id": host, "ts": None, state: found.dump()}
        # in the types that came: what may be null inside of them can be less than the schema tells
        return pa.RecordBatch.from_arrays([pa.array([values.get(n)], came.field(n).type if n in kept else t) for n, t in zip(out.names, types)], out.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, row, newest = object(), None, {}, -math.inf
        for host, rows in host_runs(batches):
            if found is None or host != at:
                if state and found is not None:
                    yield left(at, found, row, rows.schema)
                at, found, row, newest = host, start(), {}, -math.inf
            if ordered and not state:
                ts = rows.column("ts").to_numpy()
                if ts[0] < newest or (np.diff(ts) < 0).any():
                    raise ValueError(f"the frames of host {host} are out of order")
                newest = ts[-1]
            if state:
                while len(rows) and rows.column("ts")[0].as_py() is None:
                    row = {n: rows.column(n)[0].as_py() for n in kept}
                    if row[state] is not None:
                        found.load(row[state])
                    rows = rows.slice(1)
                if len(rows) and hasattr(found, "seen"):
                    rows = rows.filter(pc.greater(rows.column("ts"), found.seen))
            if len(rows):
                yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in kept], *step(found, rows)], out.names)
        if state and found is not None:
            yield left(at, found, row, rows.schema)

    rows = frames if dealt else by_host(frames)
    return (rows if ordered else rows.sortWithinPartitions("host_id", F.asc_nulls_first("ts"))).mapInArrow(run, out)


def climb(frames: DataFrame, features: list[str], adapt: bool = True, stages: tuple[str, ...] = ("l1", "l2", "drift"), learn: str | None = None, dealt: bool = False, limits: list[float] | None = None, keep: list[str] | None = None, wanted: set[str] | None = None, packed: list[str] | None = None) -> DataFrame:
    """`frames` (or their columns `keep`) with the columns of ADDED, from the double columns `features`; `learn` names a column
    that pauses learning where false. With `limits` the stages see each feature's last value while it is no older than its limit.
    Columns of ADDED that aren't `wanted` are null; the double columns `packed` come as one array of that name. The recurrences run in the JVM (see `native`)."""
    kept = [n for n in frames.columns if keep is None or n in keep]
    rows = (frames if dealt else by_host(frames)).sortWithinPartitions("host_id", F.asc_nulls_first("ts"))
    return native.climbed(rows, Ladder(features, adapt, stages), learn, limits, kept, ADDED, {f.name for f in ADDED} if wanted is None else wanted, packed or [])
