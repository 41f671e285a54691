"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into segments of SEGMENT characters (every STRIDE, and one at the end; shorter items are one
segment). A segment of m characters that occurs in a text with at most e = BUDGET * m edits shares at least
m + 1 - Q - e * Q of its q-grams with it, all on e + 1 neighbouring diagonals (text position less segment position). So
shared q-grams are counted in overlapping bands of diagonals, bands under that count are dropped, and the rest is
verified by banded alignment. Case and runs of white space don't count as edits.

The benchmark is a query set, met in blocks of BLOCK_SEGMENTS segments or so: a block's index is a few MB whatever the
benchmark's size, and each block passes over the texts once, without a shuffle. Equal segments are one entry of the
index. Shared q-grams are met in slices of HITS or so from the text's start to its end, and a band is judged when the
slices have passed it, so a q-gram that a text repeats at every place takes no more memory than another.

Null texts count as empty and match nothing, long ones are searched whole; items of fewer than Q characters (or null)
are not searched; repeated items or documents each give their own rows; extra columns may have any name. Empty tables
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvigil.llm.common import CHUNK_CHARS, materialize, only, read_table, row_chunks, text_batches, tidied, tidy

Q = 10
SEGMENT, STRIDE = 100, 50
BUDGET = 0.08
BAND = 16
BLOCK_SEGMENTS = 50_000
#: Shared q-grams counted at a time.
HITS = 1 << 19
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams, joined from those of 1, 2, 4 and 8 characters."""
    h, size, out, done = c.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _ODD, 1, None, 0
    power = lambda n: _U(pow(int(_ODD), n, 1 << 64))
    while True:
        if Q & size:
            out = h.copy() if out is None else out[: max(0, len(h) - done)] * power(size) + h[done:][: len(out)]
            done += size
        if done == Q:
            out = out[: max(0, len(c) - Q + 1)]
            return out ^ (out >> _U(29))
        h = h[: max(0, len(h) - size)] * power(size) + h[size:]
        size *= 2


def segments(text: str | None) -> list[tuple[int, str]]:
    t = normal(text)
    if len(t) <= SEGMENT:
        return [(0, t)] if len(t) >= Q else []
    starts = [*range(0, len(t) - SEGMENT, STRIDE), len(t) - SEGMENT]
    return [(s, t[s : s + SEGMENT]) for s in starts]


def edits_allowed(m: int) -> int:
    return max(0, min(int(BUDGET * m), (m - Q) // Q))


class Index:
    """Q-grams of a block of segments."""

    def __init__(self, items: list[tuple[int, str]]):
        owners: dict[str, list[int]] = {}
        for i, t in items:
            owners.setdefault(t, []).append(i)
        self.items = list(owners.values())  # of each segment; an item is named as often as it has the segment
        self.text = [codes(t) for t in owners]
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.edits = np.array([edits_allowed(m) for m in self.size.tolist()], np.int64)
        self.least = self.size + 1 - Q - self.edits * Q
        g = [grams(t) for t in self.text]
        owner = np.repeat(np.arange(len(g)), [len(x) for x in g])
        place = np.concatenate([np.arange(len(x)) for x in g]) if g else np.zeros(0, np.int64)
        h = np.concatenate(g) if g else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.hash, self.first = np.unique(h[order], return_index=True)
        self.end = np.append(self.first[1:], len(h))
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.hash >> _U(64 - _FILTER_BITS)] = True

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, segment, start of the region, edits) of every segment that occurs in a text, once for a region."""
        if not len(self.hash):
            return []
        gap = "\0" * Q  # in no segment
        flat = codes(gap.join(texts) + gap)
        size = np.array([len(t) + Q for t in texts], np.int64)
        begin = np.concatenate(([0], np.cumsum(size)))
        g = grams(flat)
        at = np.flatnonzero(self.seen[g >> _U(64 - _FILTER_BITS)])
        k = np.searchsorted(self.hash, g[at])
        k[k == len(self.hash)] = 0
        same = self.hash[k] == g[at]
        at, k = at[same], k[same]
        n = self.end[k] - self.first[k]
        total = np.concatenate(([0], np.cumsum(n)))
        cuts = np.unique(np.minimum(np.searchsorted(total, np.arange(HITS, int(total[-1]) + HITS, HITS)), len(at))).tolist() if len(at) else []
        held = (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))  # bands that later slices may add to, and their counts
        found: list[tuple[int, int, int, int]] = []
        exact = np.zeros(0, np.int64)  # (text, segment) found without edits: other regions of theirs can't be better
        a = 0
        for b in cuts:
            held = self._count(at[a:b], k[a:b], n[a:b], begin, held, exact)
            reach = len(flat) if b == len(at) else int(at[b]) - SEGMENT  # no later hit is on a smaller diagonal
            done = (held[0][:, 2] + 2) * BAND - SEGMENT <= reach if b < len(at) else np.ones(len(held[0]), bool)
            regions = held[0][done & (held[1] >= self.least[held[0][:, 1]])]
            held = held[0][~done], held[1][~done]
            edits = self.align(flat, begin, regions)
            ok = edits <= self.edits[regions[:, 1]]
            found += [(d, s, max(0, x * BAND - SEGMENT - int(begin[d])), e) for (d, s, x), e in zip(regions[ok].tolist(), edits[ok].tolist(), strict=True)]
            none = regions[ok & (edits == 0)]
            exact = np.union1d(exact, none[:, 0] * len(self.text) + none[:, 1])
            a = b
        return found

    def _count(self, at: np.ndarray, k: np.ndarray, n: np.ndarray, begin: np.ndarray, held: tuple[np.ndarray, np.ndarray], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, segment, band) and shared q-grams: those held and those of the places `at`."""
        hit = np.repeat(self.first[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        seg, diag = self.owner[hit], np.repeat(at, n) - self.place[hit]
        doc = np.repeat(np.searchsorted(begin, at, side="right") - 1, n)
        if len(exact):
            rest = ~np.isin(doc * len(self.text) + seg, exact)
            seg, diag, doc = seg[rest], diag[rest], doc[rest]
        band = (diag + SEGMENT) // BAND  # a band is two of these: every run of BAND + 1 diagonals lies inside one
        key = np.stack([np.concatenate((doc, doc)), np.concatenate((seg, seg)), np.concatenate((band, band - 1))], 1)
        key, count = np.concatenate((held[0], key)), np.concatenate((held[1], np.ones(len(key), np.int64)))
        if not len(key):
            return held
        order = np.lexsort((key[:, 2], key[:, 1], key[:, 0]))
        key, count = key[order], count[order]
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
        return key[new], np.add.reduceat(count, new)

    def align(self, flat: np.ndarray, begin: np.ndarray, regions: np.ndarray) -> np.ndarray:
        """Least edits of each segment against its region, within the band and its margin of `edits` diagonals."""
        out = np.zeros(len(regions), np.int64)
        for size in np.unique(self.size[regions[:, 1]]).tolist():
            mine = np.flatnonzero(self.size[regions[:, 1]] == size)
            for part in np.array_split(mine, -(-len(mine) // 4096)):
                doc, seg, band = regions[part].T
                margin = edits_allowed(size) + 1
                width = 2 * BAND + 2 * margin + 1
                low = band * BAND - SEGMENT - margin  # first diagonal
                pattern = np.stack([self.text[s] for s in seg])
                reach = np.arange(width)
                cost = np.zeros((len(part), width), np.int32)  # row 0: a match may start on any diagonal
                for i in range(size):
                    place = low[:, None] + i + reach
                    inside = (place >= begin[doc][:, None]) & (place < begin[doc + 1][:, None] - Q)
                    char = np.where(inside, flat[np.clip(place, 0, len(flat) - 1)], 0)
                    step = cost + (char != pattern[:, i : i + 1])
                    step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # a character of the segment is missing
                    cost = np.minimum.accumulate(step - reach, axis=1) + reach  # characters of the text too many
                out[part] = cost.min(1)
        return out


def _indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[Broadcast]:
    """The benchmark's segments, cut once and broadcast block by block; the driver holds one block."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, s, t) for i, x in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True) for s, t in segments(x)]
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*got) if got else [[]] * 3, (pa.int64(), pa.int64(), pa.string()))], ["item_id", "start", "segment"])

    rows = materialize(only(benchmark, item_id="long", text="string").mapInArrow(cut, "item_id long, start long, segment string"))
    blocks = -(-rows.count() // BLOCK_SEGMENTS)
    for k in range(blocks):
        block = rows.filter(F.pmod(F.xxhash64("segment"), F.lit(blocks)) == k).orderBy("item_id", "start").collect()
        yield docs.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["segment"]) for r in block]))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_segments (of the item that occur in the text) and edits (of the best) for every such pair."""
    rows = only(docs, doc_id="long", text="string")
    schema = "doc_id long, item_id long, n_segments long, edits long"

    def search(index):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in row_chunks(batches):
                ids = b.column("doc_id").to_pylist()
                best: dict[tuple[int, int], int] = {}
                for d, s, _, e in index.value.search([normal(t) for t in b.column("text").to_pylist()]):
                    best[d, s] = min(e, best.get((d, s), e))
                pairs: dict[tuple[int, int], tuple[int, int]] = {}
                for (d, s), e in best.items():
                    for i in index.value.items[s]:
                        n, least = pairs.get((d, i), (0, e))
                        pairs[d, i] = n + 1, min(e, least)
                out = [(ids[d], i, n, e) for (d, i), (n, e) in pairs.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], ["doc_id", "item_id", "n_segments", "edits"])

        return run

    found: list[DataFrame] = []
    last: Broadcast | None = None
    for index in _indexes(docs, benchmark):
        if last is not None:  # of several blocks one is held at a time
            found[-1] = materialize(found[-1])
            last.unpersist()
        found.append(rows.mapInArrow(tidied(search(index)), schema))
        last = index
    if not found:
        return rows.sparkSession.createDataFrame([], schema)
    if len(found) == 1:
        return found[0]
    return reduce(DataFrame.unionAll, found).groupBy("doc_id", "item_id").agg(F.sum("n_segments").alias("n_segments"), F.min("edits").alias("edits"))


def _occurs(index):
    """Column function: whether a segment of the index occurs in a text."""

    def hit(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), bool)
        clean = [normal(t) for t in texts]
        start = held = 0
        for k, t in enumerate([*clean, None]):
            if t is None or held and held + len(t) > CHUNK_CHARS:
                for d, *_ in index.value.search(clean[start:k]):
                    out[start + d] = True
                start, held = k, 0
            held += len(t or "")
        tidy()
        return pd.Series(out)

    return F.pandas_udf(hit, "boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in whose text no benchmark segment occurs, with all their columns."""
    last: Broadcast | None = None
    for index in _indexes(text_batches(docs), benchmark):
        if last is not None:
            docs = materialize(docs)
            last.unpersist()
        docs = docs.filter(~_occurs(index)(F.coalesce(F.col("text").cast("string"), F.lit(""))))
        last = index
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
