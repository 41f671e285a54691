"""Shared plumbing of the training-data operators: text batches, scratch tables and size checks."""

from __future__ import annotations

import ctypes
import gc
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to one numpy or dictionary pass at a time, in characters.
CHUNK_CHARS = 2 << 20
#: Rows of text that go to a Python worker at once.
TEXT_ROWS = 1000
#: Rows of a few numbers that may be broadcast (some 50 MB in each executor).
BROADCAST_ROWS = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode a new one if that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder and read again, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, column: str, target_bytes: int) -> int:
    """Number of parts that keeps each near target_bytes of `column`, and at least the session's shuffle partitions."""
    return parts_for(df.sparkSession, df.agg(F.sum(F.octet_length(column)).alias("b")).first()["b"], target_bytes)


def parts_for(spark: SparkSession, total: int | None, target_bytes: int) -> int:
    """`partitions_for` of a column of `total` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // target_bytes), 1)


def row_chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about `limit` bytes of text, or a single longer row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < len(sizes):
            yield batch.slice(start)


#: By operator, how to drop what a worker process keeps for the next task of the same operator.
KEPT: dict[str, Callable[[], None]] = {}


def forget(but: str = "") -> None:
    """Drop what other operators than `but` keep in this worker process: Spark hands its workers round."""
    for name, drop in KEPT.items():
        if name != but:
            drop()


def tidy() -> None:
    """Give freed memory back to the system: Spark keeps idle Python workers for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(f: Callable, keeps: str = "") -> Callable:
    """`f`, a function of a batch, a group or two groups, or a generator over batches, followed by `tidy`; what other
    operators than `keeps` left in the worker is dropped first."""

    def stream(batches):
        forget(keeps)
        try:
            yield from f(batches)
        finally:
            tidy()

    def one(x):
        forget(keeps)
        try:
            return f(x)
        finally:
            tidy()

    def two(x, y):
        forget(keeps)
        try:
            return f(x, y)
        finally:
            tidy()

    return stream if inspect.isgeneratorfunction(f) else two if len(inspect.signature(f).parameters) == 2 else one


def bounded(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has at most BROADCAST_ROWS rows; else Spark joins it by shuffling."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores in front where a column (of any case) has one already."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def text_batches(df: DataFrame) -> DataFrame:
    """`df`; from now on the session sends TEXT_ROWS rows at most to Python at once, so that neither side holds more text."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns with fixed types, so that extra or clashing columns of the input never matter."""
    text_batches(df)
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])
