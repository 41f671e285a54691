"""Sharding by a hierarchical weighted hash tree (regions, racks, shards).

Every document descends the tree: at each level the children draw ``-ln(u) / weight`` with ``u`` a hash of
(doc_id, child), and the smallest draw wins, so a child gets rows in proportion to its weight. A node's weight is the
sum of its shards' weights, so a change of a shard's weight moves rows only into or out of the subtrees above it.
`grow` adds a shard as a region of its own, which leaves all other weights as they are: one more shard takes rows
only into itself.

Only built-in column functions are used. Null and repeated doc_ids are hashed like any other value (null as the empty
string), so equal ids share a shard; each row still has a slot of its own.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostvigil.llm.common import only, read_table

#: region -> rack -> shard -> weight
Layout = dict[str, dict[str, dict[int, float]]]
BUCKETS = 1024


def layout(n_shards: int, per_rack: int = 4, racks_per_region: int = 2) -> Layout:
    """Equal shards in order, per_rack to a rack and racks_per_region to a region."""
    out: Layout = {}
    for s in range(n_shards):
        rack = s // per_rack
        out.setdefault(f"region{rack // racks_per_region}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return out


def grow(tree: Layout, weight: float = 1.0) -> Layout:
    """One more shard, in a rack and region of its own."""
    s = 1 + max((s for racks in tree.values() for shards in racks.values() for s in shards), default=-1)
    return {**tree, f"region+{s}": {f"rack+{s}": {s: weight}}}


def _draw(key: Column, node: str, weight: float) -> Column:
    """An exponential draw of rate `weight`: 52 bits of MD5 as u in (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{node}")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(weight)


def _winner(key: Column, children: dict[str, float]) -> Column:
    """Index of the child with the smallest draw."""
    if len(children) == 1:
        return F.lit(0)
    draws = F.array(*[F.struct(_draw(key, n, w).alias("d"), F.lit(i).alias("i")) for i, (n, w) in enumerate(children.items())])
    return F.array_min(draws).getField("i")


def _by_index(index: Column, branches: list[Column]) -> Column:
    return functools.reduce(lambda rest, ib: F.when(index == ib[0], ib[1]).otherwise(rest), list(enumerate(branches))[-2::-1], branches[-1])


def shard_of(key: Column, tree: Layout) -> Column:
    """Shard number of a string key."""
    total = lambda racks: sum(sum(s.values()) for s in racks.values())
    return _by_index(
        _winner(key, {f"r:{r}": total(racks) for r, racks in tree.items()}),
        [
            _by_index(
                _winner(key, {f"k:{r}/{k}": sum(s.values()) for k, s in racks.items()}),
                [_by_index(_winner(key, {f"s:{s}": w for s, w in shards.items()}), [F.lit(s) for s in shards]) for shards in racks.values()],
            )
            for r, racks in tree.items()
        ],
    )


def assign(docs: DataFrame, tree: Layout, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs`.

    Slots are counted in hash buckets of a shard, so no task sorts a whole shard: row numbers within a bucket plus the
    number of rows in earlier buckets. Null text has size 1 and CRC 0; an empty table gives no rows.
    """
    rows = only(docs, doc_id="long", text="string")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, tree).cast("int").alias("shard"),
        shard_of(key, grow(tree)).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"),
    )
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(within))
        .join(offsets, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, tree: Layout, path: str) -> None:
    """The documents themselves, one folder for each shard."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs.withColumn("shard", shard_of(key, tree)).write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read_table(spark, sf_dir, "documents"), layout(16))
