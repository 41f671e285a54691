"""Links between all texts whose sets of shingles have a Jaccard similarity of `similarity` or more, by prefix filtering.

Two such sets share at least `similarity` times the greater size. So a text of which fewer shingles than that occur in
another text has no partner and drops out at once (the distinct shingles of parts of the corpus meet in buckets, see
`exchange`). Of the others, shingles are ordered from rare to frequent and only the first m - need + 1 of a text's m
shared ones are kept: two sets that share `need` or more meet in one of them. Texts that meet are linked in order of
their size, as long as neighbours' sizes allow the similarity. No pair that is similar enough is lost; texts that only
meet are told apart by counting again within their component (`rounds`) and by whoever compares them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostvigil.llm.common import materialize, partitions_for
from hostvigil.llm.exchange import PART_BYTES, answer, meet, messages, send
from hostvigil.llm.graph import components

_40 = np.uint64((1 << 40) - 1)
_SHARED = "id long, need int, grams array<long>"


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return wide.reshape(-1).view("<u8").astype(np.uint64)


class Part:
    """The distinct shingles of a part's texts (one of each id), by bucket and key, and where each text has them."""

    def __init__(self, docs: pa.Table, hashes: Callable[[str | None], np.ndarray], n: int):
        texts = dict(zip(docs.column("id").to_pylist(), docs.column("text").to_pylist(), strict=True))
        self.ids = sorted(texts)
        sets = [hashes(texts[i]) for i in self.ids]
        self.at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
        self.grams = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        distinct, place, times = np.unique(self.grams.view(np.uint64), return_inverse=True, return_counts=True)
        bucket, key = ((distinct >> np.uint64(40)) % np.uint64(n)).astype(np.int64), distinct & _40
        order = np.lexsort((key, bucket))
        moved = np.empty_like(order)
        moved[order] = np.arange(len(order))
        self.bucket, self.key, self.several, self.place = bucket[order], key[order], times[order] > 1, moved[place]

    def slices(self) -> list[tuple[int, int, int]]:
        """(bucket, start, end) of the part's shingles."""
        heads = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        return list(zip(self.bucket[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(self.bucket)], strict=True)) if len(heads) else []


def _reply(rows: list[dict]) -> list[tuple[int, int, int, bytes]]:
    """A byte a shingle: whether another text has it. Keys of 40 bits that clash count as shared, which loses nothing."""
    sizes = [len(r["body"]) // 6 for r in rows]
    key = np.concatenate([_from_five(r["body"][: 5 * n]) for r, n in zip(rows, sizes, strict=True)])
    flag = np.concatenate([np.frombuffer(r["body"][5 * n :], np.uint8) for r, n in zip(rows, sizes, strict=True)]).copy()
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    flag[order[same]] = flag[order[same + 1]] = 1
    ends = np.cumsum(sizes).tolist()
    return [(r["part"], r["bucket"], 0, flag[e - n : e].tobytes()) for r, n, e in zip(rows, sizes, ends, strict=True)]


def shared(texts: DataFrame, hashes: Callable[[str | None], np.ndarray], similarity: float, part_bytes: int = PART_BYTES) -> DataFrame:
    """id, need, grams (those that occur in another text too) of the texts (id, text) that may have a partner."""
    n = partitions_for(texts, "text", part_bytes)
    parts = texts.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("long").alias("part"), "id", "text")

    def emit(docs: pa.Table) -> list[tuple[int, int, int, bytes]]:
        p, part = Part(docs, hashes, n), docs.column("part")[0].as_py()
        return [(part, q, 0, _five(p.key[a:b]) + p.several[a:b].astype(np.uint8).tobytes()) for q, a, b in p.slices()]

    def finish(docs: pa.Table, got: list[dict]) -> pa.Table:
        p, by = Part(docs, hashes, n), {r["bucket"]: r["body"] for r in got}
        flag = np.frombuffer(b"".join(by[q] for q, _, _ in p.slices()), np.uint8).astype(bool)
        ids, need, grams = [], [], []
        for i, a, b in zip(p.ids, p.at[:-1].tolist(), p.at[1:].tolist(), strict=True):
            has, least = flag[p.place[a:b]], int(np.ceil(similarity * (b - a) - 1e-9))
            if b > a and has.sum() >= least:
                ids.append(i)
                need.append(least)
                grams.append(p.grams[a:b][has])
        return pa.table([pa.array(ids, pa.int64()), pa.array(need, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], names=["id", "need", "grams"])

    return meet(parts, answer(send(parts, emit), _reply), finish, _SHARED)


def _meeting(rows: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) between texts (label, id, need, grams) of a label that meet in a kept shingle."""
    each = rows.select("label", "id", "need", F.explode("grams").alias("gram"))
    counted = each.withColumn("n", F.count("*").over(Window.partitionBy("label", "gram"))).filter("n > 1")
    mine = Window.partitionBy("id")
    kept = counted.withColumns({"m": F.count("*").over(mine), "k": F.row_number().over(mine.orderBy("n", "gram"))}).filter("k <= m - need + 1")
    # needs stand for sizes: ceil(s x) >= s ceil(s y) wherever x >= s y
    before = Window.partitionBy("label", "gram").orderBy("need", "id")
    linked = kept.withColumns({"a": F.lag("id").over(before), "least": F.lag("need").over(before)})
    return linked.filter(F.col("least") >= F.lit(similarity) * (F.col("need") - 1) - 1e-9).select("a", F.col("id").alias("b"))


def prefix_links(texts: DataFrame, hashes: Callable[[str | None], np.ndarray], similarity: float, rounds: int = 3) -> DataFrame:
    """Edges (a, b) between ids of the distinct texts (id, text) that connect all pairs of `similarity` or more."""
    rows = materialize(shared(texts, hashes, similarity).withColumn("label", F.lit(0).cast("long")))
    n = rows.count()
    for k in range(rounds):
        labels = components(_meeting(rows, similarity)).select(F.col("node").alias("id"), "label")
        if k == rounds - 1:
            return labels.toDF("a", "b")
        rows = materialize(rows.drop("label").join(labels, "id"))
        before, n = n, rows.count()
        if n > 0.95 * before and k:
            break
    return rows.select(F.col("id").alias("a"), F.col("label").alias("b"))
