"""Packed exchange between parts of the corpus and buckets of keys.

Operators that must look up something for every few bytes of text would shuffle a row for each. Here the documents are
dealt to parts (ranges of doc_id, or by hash), each part sends one binary record to each bucket of the key space, and each bucket
answers each part with one record in the same order. Parts and buckets are sized in bytes, so their number grows with
the corpus and a task's memory doesn't. What a part sends is distinct within the part, so a key that many documents
share reaches its bucket at most once a part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostvigil.llm.common import materialize, only, partitions_for, parts_for, tidied

#: Text of a part; a task needs about thirty times as much memory.
PART_BYTES = 8 << 20
#: What a row weighs beside its text.
ROW_BYTES = 32
#: Parts of one rank: a part's number is its rank times this, and more.
SAME_RANK = 1 << 20
MESSAGE = "part long, bucket int, kind int, body binary"
_MESSAGE = pa.schema([("part", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])


def _cuts(sizes: DataFrame, n: int) -> list[int]:
    """The last ids of n ranges near equal in size, from a row an id: sorted by ranges, summed in each, and shifted by the sums before it."""
    ranged = materialize(sizes.select("i", "size").repartitionByRange("i").withColumn("r", F.spark_partition_id()))
    sums = sorted((r["r"], r["s"]) for r in ranged.groupBy("r").agg(F.sum("size").alias("s")).collect())  # a row a task
    if n < 2 or not sums:
        return []
    before = np.cumsum([0, *(s for _, s in sums)]).tolist()
    shifts = sizes.sparkSession.createDataFrame([(r, b) for (r, _), b in zip(sums, before)], "r int, before long").hint("broadcast")
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("r").orderBy("i"))
    nth = lambda at: F.floor(at / (before[-1] / n))
    ends = ranged.join(shifts, "r").select("i", "size", upto.alias("upto")).filter(nth(F.col("upto")) > nth(F.col("upto") - F.col("size")))
    return [r["i"] for r in ends.collect()]


def parted(docs: DataFrame, part_bytes: int = PART_BYTES, keep: bool = False) -> tuple[DataFrame, int]:
    """part, doc_id, text, with `keep` also `kept` (a struct of all columns but the text, named c0, c1 and so on), and the number of parts.

    The rank of a part (its number over SAME_RANK) is that of a range of doc_ids; null ids come first. Ranges are cut by
    bytes, where the running sum of the ids' sizes reaches a part's share. An id with more text than a part is a range of
    its own, dealt to several parts of one rank. The ranges' bounds, 8 bytes for each PART_BYTES of text, come to the driver.
    """
    rows = only(docs, doc_id="long", text="string")
    lowest = -(1 << 63)
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sizes = materialize(rows.groupBy(id_.alias("i")).agg(F.sum(size).alias("text"), F.sum(size + ROW_BYTES).alias("size")))
    n = parts_for(docs.sparkSession, sizes.agg(F.sum("text").alias("b")).first()["b"], part_bytes)
    hot = {r["i"]: -(-r["text"] // part_bytes) for r in sizes.filter(F.col("text") > part_bytes).collect()}
    edges = np.unique(np.array([*_cuts(sizes, n), *hot, *(i - 1 for i in hot if i > lowest)], np.int64))
    alone, salts = np.array(sorted(hot), np.int64), np.array([hot[i] for i in sorted(hot)], np.int64)

    def number(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        i = ids.to_numpy()
        salt = np.zeros(len(i), np.int64)
        if len(alone):
            k = np.minimum(np.searchsorted(alone, i), len(alone) - 1)
            salt = np.where(alone[k] == i, (hashes.to_numpy() & ((1 << 62) - 1)) % salts[k] % SAME_RANK, 0)
        return pd.Series(np.searchsorted(edges, i, side="left").astype(np.int64) * SAME_RANK + salt)

    kept = [F.struct(*[(F.lit(None).cast("string") if c == "text" else F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("kept")] if keep else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *kept)
    return rows.select(F.pandas_udf(number, "long")(F.coalesce("doc_id", F.lit(lowest)), F.xxhash64("text")).alias("part"), "*"), n


def scattered(docs: DataFrame, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """part, doc_id, text, and the number of parts, for operators to which order is nothing: a part is what a hash deals
    to it, so that many rows of one id, or without one, go to many parts."""
    rows = only(docs, doc_id="long", text="string")
    n = partitions_for(rows, "text", part_bytes)
    return rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("long").alias("part"), "*"), n


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, _MESSAGE.types)], schema=_MESSAGE)


def send(parts: DataFrame, emit: Callable[[pa.Table], list[tuple[int, int, int, bytes]]]) -> DataFrame:
    """Messages of every part; emit gets its documents."""
    return parts.groupBy("part").applyInArrow(tidied(lambda table: messages(emit(table))), MESSAGE)


def answer(sent: DataFrame, reply: Callable[[list[dict]], list[tuple[int, int, int, bytes]]]) -> DataFrame:
    """Messages of every bucket; reply gets what the parts sent to it, by part."""
    return sent.groupBy("bucket").applyInArrow(tidied(lambda table: messages(reply(sorted(table.to_pylist(), key=lambda r: r["part"])))), MESSAGE)


def meet(parts: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, list[dict]], pa.Table], schema: str) -> DataFrame:
    """The documents of every part together with the answers to it."""
    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(tidied(lambda docs, got: finish(docs, got.to_pylist())), schema)
