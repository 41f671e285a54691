"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity has three grades: 0 not toxic, 1 toxic, 2 toxic and of low quality. P(grade >= k) = sigmoid(w.x - t_k) with one
weight vector for all ordered thresholds t_1 <= t_2; x marks which hashed words, and
beginnings of words, a text has. The model is fitted by
proximal gradient steps with an L1 penalty, so that few weights remain, and it scores every document: the expected
severity is P(grade >= 1) + P(grade >= 2).

It is fitted on a sample of TRAIN_ROWS labelled documents, those of the smallest hashes of doc_id; beyond that bound
more labels change nothing. The features of the sample pass through the driver (at most TRAIN_ROWS * 2^FEATURE_BITS
numbers), the weights are broadcast (2^FEATURE_BITS at most). Everything else runs where the documents are, without a
shuffle.

Null text counts as empty, long texts are read whole, repeated rows are scored each by themselves, and extra columns may
have any name. Labels with nulls or of unknown documents are left out; a document labelled twice counts twice. Without toxic or without other labels in the sample all severities are 0 (or the one grade there is). An empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvigil.llm.common import only, read_table, row_chunks

TRAIN_ROWS = 6_000
FEATURE_BITS = 18
GRADES = 3
#: The L1 penalty is this over the root of the number of rows: fewer labels keep fewer words.
L1 = 0.024
#: Lengths of the beginnings that longer words are marked with.
PREFIXES = (5, 6, 7)
CACHE_WORDS = 300_000
STEPS = 150
#: A document is called toxic from this expected severity.
TOXIC_FROM = 0.4
_WORD = re.compile(r"[^\W\d_]+")


def marks_of(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word."""
    names = [word, *[f"{word[:k]}*" for k in PREFIXES if len(word) > k]]
    return tuple(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) >> (64 - FEATURE_BITS) for x in names)


def features(text: str | None) -> list[int]:
    """The distinct features of a text, sorted."""
    return sorted({f for w in set(_WORD.findall((text or "").lower())) for f in marks_of(w)})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Model:
    """Weights shared by all thresholds."""

    def __init__(self, weights: dict[int, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def above(self, text: str | None, known: dict[str, tuple[int, ...]]) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ...; `known` is a bounded cache of the features with a weight."""
        if len(known) > CACHE_WORDS:
            known.clear()
        marks: set[int] = set()
        for w in set(_WORD.findall((text or "").lower())):
            f = known.get(w)
            if f is None:
                f = known[w] = tuple(x for x in marks_of(w) if x in self.weights)
            if f:
                marks.update(f)
        return _sigmoid(sum(map(self.weights.__getitem__, sorted(marks))) - self.thresholds)


def fit(rows: list[list[int]], grades: np.ndarray) -> Model:
    """Penalised maximum likelihood of the cumulative-link model."""
    n = len(rows)
    cuts = GRADES - 1
    share = [(np.sum(grades >= k) + 0.5) / (n + 1.0) for k in range(1, GRADES)]
    thresholds = -np.log(np.array(share) / (1 - np.array(share)))
    if n == 0 or len(np.unique(grades)) < 2:
        return Model({}, np.where(np.arange(1, GRADES) <= (grades[0] if n else 0), -35.0, 35.0))
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.fromiter((f for r in rows for f in r), np.int64, len(row))
    used, col = np.unique(col, return_inverse=True)
    often = np.bincount(col) >= 3  # a word of one or two documents says nothing of others
    keep = often[col]
    row, col = row[keep], col[keep]
    w, prev, momentum = np.zeros(len(used)), np.zeros(len(used)), 1.0
    t = thresholds.copy()
    rate = 0.5

    def loss_and_slopes(w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = np.bincount(row, w[col], n) if len(row) else np.zeros(n)
        p = _sigmoid(z[:, None] - t)  # P(grade >= k)
        bounds = np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), 1)
        slope = np.concatenate((np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))), 1)
        at = np.arange(n)
        mass = np.maximum(bounds[at, grades] - bounds[at, grades + 1], 1e-12)
        dz = -(slope[at, grades] - slope[at, grades + 1]) / mass / n
        dt = np.zeros(cuts)
        for k in range(1, GRADES):
            dt[k - 1] = np.sum(np.where(grades == k, slope[:, k], 0) / mass - np.where(grades == k - 1, slope[:, k], 0) / mass) / n
        return float(-np.log(mass).mean()), np.bincount(col, dz[row], len(w)), dt

    penalty = L1 / n**0.5
    v = w.copy()
    for _ in range(STEPS):
        loss, dw, dt = loss_and_slopes(v, t)
        while True:  # backtracking
            new = v - rate * dw
            new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
            gap = new - v
            if loss_and_slopes(new, t)[0] <= loss + dw @ gap + gap @ gap / (2 * rate) + 1e-12 or rate < 1e-6:
                break
            rate /= 2
        rate *= 1.1
        t = np.maximum.accumulate(t - 2.0 * dt)
        nxt = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v = new + (momentum - 1) / nxt * (new - prev)
        prev, momentum = new, nxt
    held = np.flatnonzero(prev)
    return Model(dict(zip(used[held].tolist(), prev[held].tolist(), strict=True)), t)


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[list[int]], np.ndarray]:
    """Features and grades of the sample."""
    known = only(labels, doc_id="long", quality="int", toxic="int").dropna()
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 1, 1).otherwise(2).alias("grade")
    ids = only(docs, doc_id="long").dropna().distinct()  # labels of unknown documents take no place in the sample
    sample = known.join(ids, "doc_id", "left_semi").select("doc_id", grade, F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "grade").limit(TRAIN_ROWS)
    # at most TRAIN_ROWS narrow rows are broadcast, so the texts stay where they are
    texts = only(docs, doc_id="long", text="string").join(F.broadcast(sample.select("doc_id", "grade")), "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_chunks(batches):
            marks = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array(marks, pa.list_(pa.int32()))], ["doc_id", "grade", "marks"])

    got = texts.select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, marks array<int>").toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    return got.column("marks").to_pylist(), np.array(got.column("grade").to_pylist(), np.int64)


def severity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_toxic (P(grade >= 1)), p_severe (P(grade >= 2)), expected_severity and toxic of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(*training_sample(docs, labels)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for b in row_chunks(batches):
            p = np.array([shared.value.above(t, cache) for t in b.column("text").to_pylist()]).reshape(-1, GRADES - 1)
            expected = p.sum(1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(expected), pa.array(expected >= TOXIC_FROM)], ["doc_id", "p_toxic", "p_severe", "expected_severity", "toxic"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, p_toxic double, p_severe double, expected_severity double, toxic boolean")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
