"""Joins of points of time with spans of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Points of a host with its spans that hold them (an end of null is open). The sides meet by host and hour; an open
    span, of which a host has one at most, meets its host's points by itself."""
    hour = 3600.0
    closed = spans.filter(F.col(end).isNotNull()).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / hour), F.floor(F.col(end) / hour))))
    open_ = spans.filter(F.col(end).isNull())
    p = points.withColumn("_bin", F.floor(F.col(at) / hour))
    near = p.join(closed, ["host_id", "_bin"]).filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    late = p.join(open_, "host_id").filter(F.col(at) >= F.col(start))
    return near.unionByName(late).drop("_bin")
