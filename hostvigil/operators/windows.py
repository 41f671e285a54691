"""Count-based windows of a feature: at every check the last values, and those before them, and how far the two part.

A host's frames are read once in order of time by a task that holds the two windows of each feature (see `ladder.scan`), so
no value is copied for the checks that see it, and what a check tells leaves the task instead of its windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostvigil.operators import ladder as L
from hostvigil.operators.frames import OFF_TIES, limit_of
from hostvigil.operators.ladder import DRIFT_EVERY, DRIFT_MIN, RECENT_SIZE, REFERENCE_SIZE
from hostvigil.operators.models import LEARNED, _lanes_sql, learned_frames
from hostvigil.operators.trailing import Trailing
from hostvigil.registry import query
from hostvigil.sources.fixtures import fixture

_CHECK = [("feature", T.StringType(), pa.string()), ("nr", T.LongType(), pa.int64()), ("nf", T.LongType(), pa.int64()), *[(n, T.DoubleType(), pa.float64()) for n in ("recent_mean", "reference_mean", "psi")]]
_ADDED = [T.StructField("checks", T.ArrayType(T.StructType([T.StructField(n, t) for n, t, _ in _CHECK])))]
_ARROW = pa.list_(pa.struct([(n, t) for n, _, t in _CHECK]))


class Windows:
    """The two windows of each feature of a host; a column a feature."""

    def __init__(self, features: list[str], every: int, recent: int, reference: int, least: int):
        self.features, self.every, self.least, self.frames = features, every, least, 0
        self.recent, self.reference = L.Rings(recent, len(features)), L.Rings(reference, len(features))

    def step(self, x: np.ndarray) -> dict[int, list[dict]]:
        """By the number of the frame in x what its check tells of the features that have enough values."""
        out, a = {}, 0
        while a < len(x):
            b = min(len(x), a + self.every - self.frames % self.every, a + len(self.recent.values), a + len(self.reference.values))
            self.reference.push(self.recent.push(x[a:b]))
            self.frames += b - a
            a = b
            if self.frames % self.every == 0:
                out[b - 1] = self.check()
        return out

    def check(self) -> list[dict]:
        sizes = np.stack((self.recent.count, self.reference.count), 1)
        told = {}
        for n, m in {tuple(v) for v in sizes.tolist() if min(v) >= self.least}:  # features of windows of the same sizes at once
            at = np.flatnonzero((sizes == (n, m)).all(1))
            recent, reference = self.recent.values[:n, at], self.reference.values[:m, at]
            values = zip(recent.mean(0).tolist(), reference.mean(0).tolist(), L.psi(reference, recent).tolist())
            told |= {k: (self.features[k], n, m, *v) for k, v in zip(at.tolist(), values)}
        return [dict(zip((c for c, _, _ in _CHECK), told[k])) for k in sorted(told)]


def check_windows(frames: DataFrame, features: list[str], limits: list[float] | None = None, every: int = DRIFT_EVERY, recent: int = RECENT_SIZE, reference: int = REFERENCE_SIZE, least: int = DRIFT_MIN) -> DataFrame:
    """host_id, feature, ts, sizes (nr, nf) and means of the two windows and their PSI at every `every`-th frame of a host, where
    both have `least` values or more; from the double columns `features`, whose missing values count as frames only. With
    `limits` each feature's last value counts again while it is no older than its limit."""

    def step(state: tuple[Trailing, Windows], rows: pa.RecordBatch) -> list[pa.Array]:
        trailing, windows = state
        x = np.stack([rows.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features], 1)
        x = x if limits is None else trailing.carry(rows.column("ts").to_numpy(), x)
        checks = windows.step(x)
        return [pa.array([checks.get(i) for i in range(len(x))], _ARROW)]

    scanned = L.scan(frames, lambda: (Trailing(limits or [], 0, ()), Windows(features, every, recent, reference, least)), step, _ADDED, keep=["host_id", "ts"])
    return scanned.filter("checks IS NOT NULL").select("host_id", "ts", F.explode("checks").alias("c")).select("host_id", "c.feature", "ts", "c.nr", "c.nf", "c.recent_mean", "c.reference_mean", "c.psi")


def _psi_sql(recent: str, reference: str) -> str:
    """DuckDB text of the index over two lists, with the edges worked out beside as `edges`."""
    share = lambda values: f"greatest(len(list_filter({values}, lambda y: (j = 0 OR y > edges[j]) AND (j = len(edges) OR y <= edges[j + 1]))) / len({values}), 1e-4)"
    return f"list_sum(list_transform(range(len(edges) + 1), lambda j: ({share(recent)} - {share(reference)}) * ln({share(recent)} / {share(reference)})))"


_WINDOWS = f"""(WITH r AS MATERIALIZED (SELECT * FROM {_lanes_sql()}), xs AS (SELECT host_id, feature, list(x ORDER BY i) FILTER (x IS NOT NULL) AS xs FROM r GROUP BY 1, 2),
  c AS (SELECT * FROM (SELECT host_id, feature, ts, i, count(x) OVER (PARTITION BY host_id, feature ORDER BY i) AS k FROM r) WHERE i % {DRIFT_EVERY} = 0 AND k > {RECENT_SIZE}),
  w AS (SELECT c.host_id, c.feature, c.ts, xs[k - {RECENT_SIZE - 1} : k] AS recent, xs[greatest(1, k - {RECENT_SIZE + REFERENCE_SIZE - 1}) : k - {RECENT_SIZE}] AS reference FROM c JOIN xs ON xs.host_id = c.host_id AND xs.feature = c.feature),
  p AS (SELECT *, list_sort(reference) AS o, list_transform(range(1, 10), lambda q: q * (len(reference) - 1) / 10) AS places FROM w WHERE len(reference) >= {DRIFT_MIN} AND len(recent) >= {DRIFT_MIN}),
  e AS (SELECT *, list_sort(list_distinct(list_transform(places, lambda q: o[CAST(floor(q) AS BIGINT) + 1] * (1 - (q - floor(q))) + o[least(CAST(floor(q) AS BIGINT) + 2, len(o))] * (q - floor(q))))) AS edges FROM p)
  SELECT host_id, feature, ts, len(recent) AS nr, len(reference) AS nf, round(list_avg(recent) + {OFF_TIES}, 6) AS recent_mean, round(list_avg(reference) + {OFF_TIES}, 6) AS reference_mean, round({_psi_sql('recent', 'reference')} + {OFF_TIES}, 6) AS psi FROM e)"""


@query(f"SELECT * FROM {_WINDOWS}", "samples_dense")
def drift_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of every feature at every check, and how far they part, as long as no drift starts them anew."""
    w = check_windows(learned_frames(fixture(spark, sf_dir, "samples_dense")), LEARNED, [limit_of(f) for f in LEARNED])
    return w.select("host_id", "feature", "ts", "nr", "nf", *[F.round(F.col(c) + OFF_TIES, 6).alias(c) for c in ("recent_mean", "reference_mean", "psi")])
