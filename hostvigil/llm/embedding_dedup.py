"""Near-duplicate embeddings by lattice hashing: random projections decoded to points of the lattice E8.

Equal vectors are one class. In each of several tables a class's vector is projected at random to one or more blocks of
eight numbers; each block is decoded to the nearest point of E8, and the points are the vector's cell. A vector is also
sent to the neighbouring cells that its projection lies closest to, where it meets the vectors that have their own cell
there. All pairs that meet are verified by cosine in double precision.

How wide the lattice is, how many blocks make a cell, how many neighbours are probed and how many tables there are
follows from the number of vectors and their length (`plan`): seeded trials tell how often a pair right at the threshold
and how often unlike vectors meet, and the cheapest choice is taken that finds such a pair with a chance of RECALL.
Nothing depends on the data, no vector is left out and no cell has a limit: a cell with more than BLOCK rows is dealt to
tasks by pairs of blocks, so that every pair still meets. A pair that meets more than once counts in the first table and
cell only, which each task tells from the two vectors alone; so a task sends one number for each vector and the edges of a
spanning forest, never its pairs.

Vectors that are null, empty, zero or hold a null or non-finite number link with nothing, and neither do vectors of
unlike length. Repeated vec_ids are vectors of their own that share an id; a null vec_id takes part, is never the
smallest, and isn't kept. Labels and other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostvigil.llm.common import bounded, materialize, read_table, tidied
from hostvigil.llm.graph import components, stars

THRESHOLD = 0.95
#: Chance with which a pair right at the threshold is found.
RECALL = 0.995
#: Rows of a cell that one task takes at a time.
BLOCK = 1024
#: What a row costs, in pairs.
ROW_COST = 500
#: Room for rounding when single precision picks the pairs to verify.
SLACK = 1e-4
_TRIALS = 2000
_SPREADS = (0.5, 0.6, 0.7, 0.85, 1.0, 1.2)
_PROBES = (0, 1, 2, 4, 8)


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    near = np.rint(y)
    off = y - near
    odd = np.flatnonzero(near.sum(-1) % 2)
    worst = np.abs(off[odd]).argmax(-1)
    near[odd, worst] += np.where(off[odd, worst] < 0, -1, 1)
    return near


def nearest(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8 to rows of eight numbers: of even whole coordinates, or of these moved by a half."""
    whole, half = _even(y), _even(y - 0.5) + 0.5
    closer = ((y - half) ** 2).sum(-1) < ((y - whole) ** 2).sum(-1)
    return np.where(closer[:, None], half, whole)


@functools.cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, which lead to the neighbours of a point."""
    pairs = [[s if k == i else t if k == j else 0 for k in range(8)] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [v for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(pairs + halves)


@functools.lru_cache(64)
def _projection(length: int, blocks: int, table: int) -> np.ndarray:
    """Columns of eight numbers a block; a unit vector comes out with a length of about 1 a block."""
    return np.random.default_rng([length, blocks, table]).normal(size=(length, 8 * blocks)) / math.sqrt(8)


def _points(unit: np.ndarray, blocks: int, spread: float, table: int, probes: int) -> np.ndarray:
    """(rows, 1 + probes, 8 * blocks): each row's own lattice points, then those of the neighbours, closest first."""
    y = unit @ _projection(unit.shape[1], blocks, table) / spread
    own = np.concatenate([nearest(y[:, b : b + 8]) for b in range(0, 8 * blocks, 8)], axis=1)
    out = np.repeat(own[:, None], 1 + probes, axis=1)
    if probes:
        towards = np.concatenate([(y - own)[:, b : b + 8] @ neighbours().T for b in range(0, 8 * blocks, 8)], axis=1)
        best = np.argpartition(-towards, probes - 1, axis=1)[:, :probes]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(towards, best, 1), axis=1, kind="stable"), 1)
        rows = np.arange(len(y))
        for p in range(probes):
            block, step = best[:, p] // 240, neighbours()[best[:, p] % 240]
            for e in range(8):
                out[rows, 1 + p, 8 * block + e] += step[:, e]
    return out


def cells(unit: np.ndarray, choice: tuple[int, float, int, int]) -> np.ndarray:
    """(rows, tables, 1 + probes): numbers of each row's own cell and of those that it probes."""
    blocks, spread, probes, tables = choice
    odd = np.random.default_rng(8).integers(1 << 62, size=8 * blocks, dtype=np.int64) * 2 + 1
    with np.errstate(over="ignore"):
        return np.stack([((2 * _points(unit, blocks, spread, t, probes)).astype(np.int64) * odd).sum(-1) + t * np.int64(0x5851F42D4C957F2D) for t in range(tables)], axis=1)


@functools.cache
def _trial(length: int, threshold: float, blocks: int, spread: float) -> dict[int, float]:
    """By number of probes: the chance that two vectors right at the threshold meet in a table."""
    rng = np.random.default_rng([length, 1])
    x, z = rng.normal(size=(2, _TRIALS, length))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    a, b = (_points(v, blocks, spread, 0, max(_PROBES)) for v in (x, threshold * x + math.sqrt(1 - threshold**2) * z))
    from_a, from_b = (a == b[:, :1]).all(-1), (b == a[:, :1]).all(-1)
    return {p: float((from_a | from_b)[:, : 1 + p].any(1).mean()) for p in _PROBES}


@functools.cache
def _crowd(length: int, spread: float) -> float:
    """Share of unlike vectors that have the same point in a block."""
    v = np.random.default_rng([length, 2]).normal(size=(8000, length))
    points = _points(v / np.linalg.norm(v, axis=1, keepdims=True), 1, spread, 0, 0)[:, 0]
    n = np.unique(points, axis=0, return_counts=True)[1]
    return max(float((n * (n - 1)).sum()), 1.0) / (8000 * 7999)


@functools.cache
def plan(rows: int, length: int, threshold: float = THRESHOLD) -> tuple[int, float, int, int]:
    """Blocks, spread, probes and tables for so many vectors of this length: the least work for a vector."""
    best = None
    for blocks, spread in itertools.product(range(1, 6), _SPREADS):
        for probes, chance in _trial(length, threshold, blocks, spread).items():
            if chance < 0.05:
                continue
            tables = 1 if chance >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - chance))
            work = tables * ((1 + probes) * ROW_COST + (1 + 2 * probes) * rows * _crowd(length, spread) ** blocks)
            if best is None or work < best[0]:
                best = work, (blocks, spread, probes, tables)
    return best[1]


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    """Rows of a list column that all have this length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), length)


def prepared(table: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id, key (SHA-256 of the vector; null if it links with nothing), length and vec."""
    kind = table.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    of, arrow = ("float", pa.float32()) if single else ("double", pa.float64())
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("key", pa.binary()), ("length", pa.int32()), ("vec", pa.list_(arrow))])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lengths = [], []
            for v in batch.column("vec"):
                x = v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.zeros(0)
                good = len(x) and v.values.null_count == 0 and np.isfinite(x).all() and x.any()
                keys.append(hashlib.sha256((x + 0.0).tobytes()).digest() if good else None)
                lengths.append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(lengths, pa.int32()), batch.column("vec").cast(pa.list_(arrow))], schema=schema)

    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{of}>").alias("vec"))
    return materialize(rows.mapInArrow(tidied(keyed), f"row long, vec_id long, key binary, length int, vec array<{of}>"))


def unit_of(vec: np.ndarray) -> np.ndarray:
    x = vec.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of huge and of tiny numbers
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows of x with rows of y, in double precision."""
    x, y = (v / np.where((m := np.abs(v).max(axis=1, keepdims=True)) > 1e100, m, np.where(m < 1e-100, m, 1.0)) for v in (x.astype(np.float64), y.astype(np.float64)))
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def _meetings(own: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, cell: int) -> np.ndarray:
    """Whether pairs of rows of `cells` meet for the first time in this cell of this table."""
    first = np.ones(len(i), bool)
    for t in range(table + 1):
        a, b = own[i, t], own[j, t]
        at_b, at_a = (a == b[:, :1]).any(1), (b == a[:, :1]).any(1)  # in b's own cell, in a's own cell
        if t < table:
            first &= ~(at_a | at_b)
        else:  # of two cells in which they meet, the smaller
            first &= ~(at_a & (a[:, 0] < cell)) & ~(at_b & (b[:, 0] < cell))
    return first


def _links(choices: dict[int, tuple[int, float, int, int]], threshold: float):
    """From rows sorted by cell, t, length and pair of blocks: (a, b, n): n links that class a has (b null), and edges of classes a and b."""

    def group(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        length, table, cell = (rows.column(c)[0].as_py() for c in ("length", "t", "cell"))
        own, block, cid, weight = (rows.column(c).to_numpy() for c in ("own", "block", "cid", "weight"))
        if not own.any():
            return
        vec = _matrix(rows.column("vec").combine_chunks(), length)
        unit = unit_of(vec)
        near = unit.astype(np.float32)
        at = np.flatnonzero(own)
        pick = near[at] @ near.T >= threshold - SLACK
        a, b = np.nonzero(pick)
        a = at[a]
        # a pair of two own rows comes up twice; a task for two blocks takes pairs across them only
        ok = (cid[a] != cid[b]) & (~own[b] | (a < b))
        if rows.column("low")[0] != rows.column("high")[0]:
            ok &= block[a] != block[b]
        a, b = a[ok], b[ok]
        for s in range(0, len(a), 1 << 18):
            i, j = a[s : s + (1 << 18)], b[s : s + (1 << 18)]
            ok = cosines(vec[i], vec[j]) >= threshold
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            who, where = np.unique(np.concatenate((i, j)), return_inverse=True)
            ok = _meetings(cells(unit[who], choices[length]), where[: len(i)], where[len(i) :], table, cell)
            i, j = i[ok], j[ok]
            if len(i):
                yield cid[i], cid[j], weight[i], weight[j]

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def out(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if found:
            i, j, wi, wj = map(np.concatenate, zip(*found))
            ids, at = np.unique(np.concatenate((i, j)), return_inverse=True)
            n = np.zeros(len(ids), np.int64)
            np.add.at(n, at, np.concatenate((wj, wi)))
            x, y = stars(i, j)
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids), none, pa.array(n)], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(x), pa.int64())], schema=schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, found, held = None, [], 0
        for batch in itertools.chain(batches, [None]):
            rows = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rows is None or not len(rows):
                break
            names = np.stack([rows.column(c).to_numpy() for c in ("cell", "t", "length", "low", "high")])
            cuts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1
            ends = [*cuts, len(rows)] if batch is None else [*cuts]
            start = 0
            for e in ends:
                if e - start > 1:
                    for f in group(rows.slice(start, e - start)):
                        found.append(f)
                        held += len(f[0])
                    if held > 1 << 20:
                        yield from out(found)
                        found, held = [], 0
                start = e
            rest = rows.slice(start)
        yield from out(found)

    return tidied(search)


def near_links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, n over classes (cid, weight, length, vec): with b null, n vectors outside of class a that link with it, to be
    summed; else an edge of the spanning forest of all links."""
    sizes = {r["length"]: r["count"] for r in classes.groupBy("length").count().collect()}  # a row for each length in use
    choices = {length: plan(1 << n.bit_length(), length, threshold) for length, n in sizes.items()}

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            got = [None] * len(batch)
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                found = cells(unit_of(_matrix(batch.column("vec").take(pa.array(at)), length)), choices[length])
                for i, c in zip(at.tolist(), found.reshape(len(at), -1).tolist()):
                    got[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    of = classes.schema["vec"].dataType.simpleString()
    rows = materialize(classes.select("cid", "weight", "length", "vec").mapInArrow(tidied(celled), f"cid long, weight long, length int, vec {of}, cells array<long>"))
    width = F.when(F.lit(False), 0)
    for length, choice in choices.items():
        width = width.when(F.col("length") == length, 1 + choice[2])
    spread = rows.select(F.posexplode("cells").alias("place", "cell"), "length", width.alias("width"), "cid", "weight", "vec")
    spread = spread.withColumn("t", F.floor(F.col("place") / F.col("width")).cast("int")).withColumn("own", F.col("place") % F.col("width") == 0)
    where = ["cell", "t", "length"]
    crowded = bounded(materialize(spread.groupBy(*where).agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select(*where, F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))))
    dealt = spread.join(crowded, where, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    # a row goes to all pairs of blocks that hold its own
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, "block").alias("low"), F.greatest(o, "block").alias("high")))
    dealt = dealt.select(*where, F.explode(pairs).alias("pair"), "own", "block", "cid", "weight", "vec").select("*", "pair.*").drop("pair")
    keys = [*where, "low", "high"]
    return materialize(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_links(choices, threshold), "a long, b long, n long"))


def dedup(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector of (vec_id, embedding)."""
    rows = prepared(table)
    classes = materialize(rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("row").alias("cid"), F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("length").alias("length"), F.first("vec").alias("vec")))
    found = near_links(classes, threshold)
    linked = found.filter("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    labels = components(found.filter("b IS NOT NULL").select("a", "b")).toDF("cid", "label")
    of_class = classes.select("key", "cid", "weight", "least").join(labels, "cid", "left").join(linked, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    of_class = materialize(of_class)
    smallest = of_class.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(smallest, "label").select("key", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(of_class, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and survivor of every embedding."""
    return dedup(read_table(spark, sf_dir, "embeddings"))


#: The same rows by brute force.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, e, len(e) AS d, coalesce(len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0)), false) AS good
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND a.good AND b.good AND a.d = b.d
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM v LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id) JOIN (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY a) USING (vec_id)
"""
