"""Tables of hosts as files partitioned by day and bucket of the host: upsert, erase and expiry rewrite what they touch.

A change reads the partitions that it concerns, puts what they shall hold into a table of its own, and only then overwrites
exactly these partitions; all others keep their files. Partitions that end up empty, or that are older than a cut, are
deleted as folders. A run that is repeated after a failure leaves the same rows. Rows without ts lie in day -1.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostvigil.sources.scratch import materialize

DAY_S = 86_400
BUCKETS = 16
PLACE = ["day", "bucket"]
_PLACES = [T.StructField(c, T.IntegerType()) for c in PLACE]
#: Hosts that may be broadcast.
FEW = 1 << 20


def bucket_of(host: Column) -> Column:
    return F.pmod(F.xxhash64(host.cast("long")), F.lit(BUCKETS)).cast("int")


def placed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"day": F.coalesce(F.floor(F.col("ts") / DAY_S), F.lit(-1)).cast("int"), "bucket": bucket_of(F.col("host_id"))})


def _keep_schema(rows: DataFrame, path: str) -> None:
    """Beside the files: a table without rows has no file that tells its columns."""
    text = T.StructType([f for f in rows.schema.fields if f.name not in PLACE] + _PLACES).json()
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_schema")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table with its partition columns."""
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/_schema").first()[0]))
    return spark.read.schema(schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    folder, files = _folder(spark, path)
    return files.exists(folder)


def _write(rows: DataFrame, path: str) -> None:
    rows.repartition(*PLACE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(path)


def _drop(spark: SparkSession, path: str, places: list[tuple[int, int]]) -> None:
    for day, bucket in places:
        folder, files = _folder(spark, f"{path}/day={day}/bucket={bucket}")
        files.delete(folder, True)


def _places(rows: DataFrame) -> set[tuple[int, int]]:
    """The partitions that hold rows: names of folders, not data."""
    return {(r["day"], r["bucket"]) for r in rows.select(*PLACE).distinct().collect()}


def put(rows: DataFrame, path: str, keys: list[str], arrival: str) -> None:
    """Insert rows, or replace those of the same keys that arrived earlier. `ts` and host_id must be of the keys."""
    from hostvigil.sources.samples import upsert

    spark = rows.sparkSession
    new = materialize(placed(rows))
    if exists(spark, path):
        touched = F.broadcast(new.select(*PLACE).distinct())  # a row a partition
        new = new.unionByName(read(spark, path).join(touched, PLACE, "left_semi"), allowMissingColumns=True)
    merged = materialize(upsert(new, [*keys, *PLACE], arrival))
    _keep_schema(merged, path)
    _write(merged, path)


def add(rows: DataFrame, path: str, widened: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """Append rows that are new. `widened` puts long columns beside rows that are dealt and sorted already, by a join with a
    small table, so that they are neither moved nor sorted."""
    if not exists(rows.sparkSession, f"{path}/_schema"):
        _keep_schema(widened(rows), path)
    widened(placed(rows).repartition(*PLACE).sortWithinPartitions(*PLACE)).write.mode("append").partitionBy(*PLACE).parquet(path)


def erase(spark: SparkSession, path: str, gone: DataFrame) -> None:
    """Remove all rows of the hosts in `gone` (host_id); only partitions of their buckets are read and rewritten."""
    gone = materialize(gone.select(F.col("host_id").cast("long").alias("host_id")).distinct())
    buckets = [r["b"] for r in gone.select(bucket_of(F.col("host_id")).alias("b")).distinct().collect()]
    held = read(spark, path).filter(F.col("bucket").isin(buckets))
    before = _places(held.join(F.broadcast(gone) if gone.count() <= FEW else gone, "host_id", "left_semi"))
    left = materialize(held.join(spark.createDataFrame(sorted(before), "day int, bucket int").hint("broadcast"), PLACE, "left_semi").join(F.broadcast(gone) if gone.count() <= FEW else gone, "host_id", "left_anti"))
    _write(left, path)
    _drop(spark, path, sorted(before - _places(left)))


def expire(spark: SparkSession, path: str, before: float, gone: Column | None = None) -> None:
    """Remove rows of a ts before the cut, of them only those where `gone` holds if it is given. Without it, days that are
    over by then are deleted as folders and no row of them is read."""
    day = int(before // DAY_S)
    held = read(spark, path).filter(F.col("day") >= 0)
    if gone is None:
        _drop(spark, path, sorted(_places(held.filter(F.col("day") < day))))
        held, dead = held.filter(F.col("day") == day), F.col("ts") < before
    else:
        held, dead = held.filter(F.col("day") <= day), (F.col("ts") < before) & gone
    places = _places(held.filter(dead))
    if places:
        touched = spark.createDataFrame(sorted(places), "day int, bucket int").hint("broadcast")
        left = materialize(held.join(touched, PLACE, "left_semi").filter(~F.coalesce(dead, F.lit(False))))
        _write(left, path)
        _drop(spark, path, sorted(places - _places(left)))
