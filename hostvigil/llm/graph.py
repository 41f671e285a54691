"""Connected components of an edge table by contraction."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostvigil.llm.common import materialize

#: Edges that a task gathers before it thins them out.
HELD_EDGES = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node of its component: as connected as the edges given, and fewest."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[x], up[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up, up[up]):
            up = up[up]
    moved = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[moved], nodes[up[moved]]


def thin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) of a task as stars; a task holds HELD_EDGES or so at a time."""
    a, b, held, floor = [], [], 0, 0

    def flush() -> None:
        nonlocal a, b, held, floor
        if held:
            x, y = stars(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], len(x)
            floor = len(x)

    for batch in batches:
        a.append(batch.column("a").to_numpy())
        b.append(batch.column("b").to_numpy())
        held += len(batch)
        if held - floor > HELD_EDGES:
            flush()
            if held > 4 * HELD_EDGES:  # hardly any edge was one too many
                yield pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(b[0])], ["a", "b"])
                a, b, held, floor = [], [], 0, 0
    flush()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(b[0])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, label (one node of its component) for every node of the long columns `a` and `b`.

    A round merges every node into its smallest neighbour's smallest neighbour, rewrites the edges to the merged nodes
    and drops what became loops or repeats, so edges and nodes shrink from round to round and an edge is carried no
    further than its ends are apart. Tasks thin their edges out to stars before each shuffle. Labels are put together
    from the rounds at the end. Everything stays in tables; only "is any edge left" comes to the driver.
    """
    schema = "a long, b long"
    left = materialize(edges.select("a", "b").filter("a <> b").mapInArrow(thin, schema))
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialize(ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("next")))
        jump = near.join(near.toDF("next", "far"), "next").select("node", F.col("far").alias("next"))
        merged = materialize(jump)
        moved = left.join(merged.toDF("a", "x"), "a").join(merged.toDF("b", "y"), "b").filter("x <> y")
        left = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().mapInArrow(thin, schema))
        rounds.append(merged)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    labels = rounds.pop().toDF("node", "label")
    for merged in reversed(rounds):
        labels = merged.join(labels.toDF("next", "label"), "next", "left").select("node", F.coalesce("label", "next").alias("label"))
    return materialize(labels)
