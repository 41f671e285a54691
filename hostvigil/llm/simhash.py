"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

Distinct fingerprints are dealt to groups by some of their bits. Inside a group they stand in Gray order, where
neighbours differ in few bits. Upper nodes of the index hold the bits that all fingerprints below them share; two nodes
that differ in more than `radius` shared bits are pruned with everything below, and so are nodes that are linked
already. A group gives one edge for each linked fingerprint, never its pairs; connected components then run over the
distinct fingerprints.

For 64-bit fingerprints at few bits (`near_duplicates`) the groups are exact: two at `radius` or fewer differing bits
agree wholly on two of radius + 2 blocks, so each goes to one group for each pair of blocks. Whole near copies at a
similarity of 0.8 (`keep_one`) differ in more bits than blocks can be exact for: there fingerprints have 128 bits and
go to groups by sets of bits (`Bands`) whose width follows the size of the corpus. These propose most pairs, and
`prefix_join` all that they leave out, so no pair is lost.

Null text counts as empty (fingerprint zero), as long texts are taken whole. Rows with a null doc_id take part; their
component is the smallest doc_id reached, or null. Repeated rows share a fingerprint. Extra columns may have any name.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostvigil.llm.common import bounded, materialize, only, read_table, text_batches, tidied, unused
from hostvigil.llm.graph import components, stars
from hostvigil.llm.prefix_join import prefix_links

SEED = 42
#: Bits of the fingerprints of `keep_one`, unlike codes in a group, and the share of pairs at the similarity asked for that meet.
WIDE, GROUP, RECALL = 128, 512, 0.97
#: Rows of a group from which it is dealt to parts.
LARGEST = 20_000
#: Codes of a leaf of the index, nodes of an upper node, pairs of nodes compared at a time, and of leaves.
LEAF, FANOUT, FRONTIER, LEAVES = 32, 8, 4096, 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_PLACE = (np.arange(16, dtype=np.int64) * 256)[None, :]


def _majority(digests: np.ndarray) -> np.ndarray:
    """The bits set in over half the rows of bytes, as bytes."""
    n, width = digests.shape
    seen = np.bincount((digests + _PLACE[:, :width]).ravel(), minlength=256 * width).reshape(width, 256)
    return np.packbits((2 * (seen @ _BITS) > n).ravel(), bitorder="little")


def _shingles(text: str | None, size: int) -> list[bytes]:
    """All word shingles, repeats included; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    return [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)]


def fingerprint(text: str | None, size: int = 3) -> int:
    """64 majority bits of the XXH64 hashes of all word shingles, as a signed integer."""
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(x, SEED) for x in _shingles(text, size)], np.uint64)
    return int(_majority(h.view(np.uint8).reshape(-1, 8)).view(np.int64)[0]) if len(h) else 0


def wide_fingerprint(text: str | None, size: int) -> tuple[int, int]:
    """128 majority bits of the XXH3 hashes of all word shingles, as two signed integers."""
    digest = xxhash.xxh3_128_digest
    h = b"".join([digest(x, SEED) for x in _shingles(text, size)])
    hi, lo = _majority(np.frombuffer(h, np.uint8).reshape(-1, 16)).view(np.int64).tolist() if h else (0, 0)
    return hi, lo


def fingerprint_column(text: Column, size: int) -> Column:
    run = F.pandas_udf(lambda texts: pd.Series([fingerprint(t, size) for t in texts], dtype="int64"), "long")
    return run(F.coalesce(text.cast("string"), F.lit("")))


def wide_fingerprint_column(text: Column, size: int) -> Column:
    run = F.pandas_udf(lambda texts: pd.DataFrame([wide_fingerprint(t, size) for t in texts], columns=["hi", "lo"], dtype="int64"), "hi long, lo long").asNondeterministic()
    return run(F.coalesce(text.cast("string"), F.lit("")))


class Bands:
    """Which bits of a WIDE-bit code make a group key: `count` sets of `width` bits each.

    Two codes of texts of similarity SIMILAR differ in a bit with chance acos(2 s / (1 + s)) / pi; the number of sets is
    such that the two share a key with chance RECALL. The width follows the number of codes, so that a group holds about
    GROUP codes that have nothing else in common, however large the corpus.
    """

    def __init__(self, n_codes: int, similarity: float):
        differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
        self.width = min(48, max(4, math.ceil(math.log2(max(1, n_codes) / GROUP))))
        self.count = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - differ) ** self.width))
        rng = np.random.default_rng(SEED)
        self.sets = [np.sort(rng.permutation(WIDE)[: self.width]) for _ in range(self.count)]

    def keys(self, hi: np.ndarray, lo: np.ndarray) -> Iterator[np.ndarray]:
        """The group keys of all codes, band by band."""
        bits = np.unpackbits(np.stack([hi, lo], 1).view(np.uint8).reshape(len(hi), 16), axis=1, bitorder="little").astype(np.int64)
        for band, at in enumerate(self.sets):
            yield (bits[:, at] << np.arange(self.width)).sum(1) * self.count + band


def block_keys(code: Column, radius: int) -> Column:
    """One key for each pair of radius + 2 blocks of a long code: exact for the radius."""
    edges = [64 * i // (radius + 2) for i in range(radius + 3)]
    block = [F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << b - a) - 1)) for a, b in zip(edges, edges[1:])]
    width = max(b - a for a, b in zip(edges, edges[1:]))
    keys = [F.shiftleft(F.shiftleft(F.lit(t).cast("long"), width).bitwiseOR(block[i]), width).bitwiseOR(block[j]) for t, (i, j) in enumerate(combinations(range(radius + 2), 2))]
    return F.array(*keys)


def gray_rank(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of bit patterns in the Gray sequence: the exclusive or of all their right shifts."""
    hi, lo = hi.copy(), lo.copy()
    for k in (1, 2, 4, 8, 16, 32):
        hi ^= hi >> np.uint64(k)
        lo ^= lo >> np.uint64(k)
    return hi, lo ^ (np.uint64(0) - (hi & np.uint64(1)))  # the parity of the upper half goes on into the lower one


def _differ(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], mask: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    x, y = a[0] ^ b[0], a[1] ^ b[1]
    if mask is not None:
        x, y = x & mask[0], y & mask[1]
    return np.bitwise_count(x).astype(np.int64) + np.bitwise_count(y)


def link_group(hi: np.ndarray, lo: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places, enough to connect every component of distinct codes in Gray order at `radius` or fewer bits."""
    n = len(hi)
    near = np.flatnonzero(_differ((hi[1:], lo[1:]), (hi[:-1], lo[:-1])) <= radius)
    found = [(near, near + 1)]
    label = np.arange(n)
    label[1:][near] = -1
    label = np.maximum.accumulate(label)  # runs of neighbours in Gray order are one component each
    if label[-1] == 0:
        return found[0]
    # levels of the index: (pattern, mask of the bits that all below share), from leaves of LEAF codes up to one root
    starts = np.arange(0, n, LEAF)
    low = [np.bitwise_and.reduceat(x, starts) for x in (hi, lo)]
    high = [np.bitwise_or.reduceat(x, starts) for x in (hi, lo)]
    levels = [(low, [~(x ^ y) for x, y in zip(low, high)])]
    while len(low[0]) > 1:
        at = np.arange(0, len(low[0]), FANOUT)
        low, high = [np.bitwise_and.reduceat(x, at) for x in low], [np.bitwise_or.reduceat(x, at) for x in high]
        levels.append((low, [~(x ^ y) for x, y in zip(low, high)]))

    def one_label(k: int) -> np.ndarray:
        """The label of each node of a level if all below it has one, else -1 less the node's number."""
        at = starts if k == 0 else np.arange(0, n, LEAF * FANOUT**k)
        least, most = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
        return np.where(least == most, least, -1 - np.arange(len(at)))

    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, i, j = stack.pop()
        if k and len(i) > FRONTIER:
            stack += [(k, i[FRONTIER:], j[FRONTIER:]), (k, i[:FRONTIER], j[:FRONTIER])]
            continue
        (p, q), (m, w) = levels[k]
        whole = one_label(k)
        some = (_differ((p[i], q[i]), (p[j], q[j]), (m[i] & m[j], w[i] & w[j])) <= radius) & ~((whole[i] == whole[j]) & (whole[i] >= 0))
        i, j = i[some], j[some]
        if not len(i):
            continue
        if k:
            below = len(levels[k - 1][0][0])
            step = np.arange(FANOUT)
            ci = np.broadcast_to(i[:, None, None] * FANOUT + step[None, :, None], (len(i), FANOUT, FANOUT)).ravel()
            cj = np.broadcast_to(j[:, None, None] * FANOUT + step[None, None, :], (len(i), FANOUT, FANOUT)).ravel()
            inside = (ci <= cj) & (cj < below)
            stack.append((k - 1, ci[inside], cj[inside]))
            continue
        for s in range(0, len(i), LEAVES):
            ci = np.broadcast_to(i[s : s + LEAVES, None, None] * LEAF + np.arange(LEAF)[None, :, None], (len(i[s : s + LEAVES]), LEAF, LEAF))
            cj = np.broadcast_to(j[s : s + LEAVES, None, None] * LEAF + np.arange(LEAF)[None, None, :], ci.shape)
            a, b = np.minimum(ci, n - 1), np.minimum(cj, n - 1)
            at = np.flatnonzero(((_differ((hi[a], lo[a]), (hi[b], lo[b])) <= radius) & (ci < cj) & (cj < n) & (label[a] != label[b])).ravel())
            if len(at):
                x, y = a.ravel()[at], b.ravel()[at]
                child, root = stars(label[x], label[y])
                found.append((x, y))
                to = np.arange(n)
                to[child] = root
                label = to[label]
    a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    return a, b


_ROWS = "key long, hi long, lo long, node long"
_LINKS = "key long, hi long, lo long, node long, a long, b long"


def _link(radius: int):
    """Edges (a, b) between nodes, and the first code of each component (key, hi, lo, node) of salted groups, from rows of
    (key, hi, lo, node, salt) with those of a group together."""

    def flush(rows: pa.Table) -> pa.RecordBatch:
        key, salt, node = (rows.column(c).to_numpy() for c in ("key", "salt", "node"))
        hi, lo = (rows.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
        cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(salt) != 0)) + 1
        start, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        rank = gray_rank(hi, lo)
        a, b, heads = [], [], []
        for s, e in zip(start.tolist(), end.tolist(), strict=True):
            if e - s == 1:
                if salt[s] >= 0:
                    heads.append([s])
                continue
            order = s + np.lexsort((rank[1][s:e], rank[0][s:e]))
            x, y = stars(*(order[z] for z in link_group(hi[order], lo[order], radius)))
            a.append(x)
            b.append(y)
            if salt[s] >= 0:
                heads.append(np.setdiff1d(np.arange(s, e), x))
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        a, b, heads = join(a), join(b), join(heads)
        first = [pa.array(np.concatenate((v[heads].view(np.int64), np.zeros(len(a), np.int64))), mask=np.arange(len(heads) + len(a)) >= len(heads)) for v in (key, hi, lo, node)]
        pair = [pa.array(np.concatenate((np.zeros(len(heads), np.int64), node[v])), mask=np.arange(len(heads) + len(a)) < len(heads)) for v in (a, b)]
        return pa.RecordBatch.from_arrays([*first, *pair], ["key", "hi", "lo", "node", "a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            key, salt = batch.column("key").to_numpy(), batch.column("salt").to_numpy()
            last = np.flatnonzero((key != key[-1]) | (salt != salt[-1]))
            whole = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            if whole or held and (held[-1].column("key")[0].as_py(), held[-1].column("salt")[0].as_py()) != (key[0], salt[0]):
                yield flush(pa.Table.from_batches([*held, batch.slice(0, whole)]).combine_chunks())
                held = []
            held.append(batch.slice(whole))
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return run


def _grouped(rows: DataFrame, radius: int) -> DataFrame:
    dealt = rows.repartition("key", "salt").sortWithinPartitions("key", "salt")
    return dealt.select("key", "hi", "lo", "node", "salt").mapInArrow(tidied(_link(radius)), _LINKS)


def linked(rows: DataFrame, radius: int, limit: int = LARGEST) -> DataFrame:
    """Edges (a, b) that connect the nodes at `radius` or fewer bits within each group of rows (key, hi, lo, node).

    A group of more than `limit` rows (many unlike copies of one text) is dealt to salted parts of about that size; each
    part links its own rows, and then the first of each component stand for it in the group, until that fits as well or
    shrinks no more. Links between other members of two parts are left to the other groups that the rows are in.
    """
    rows = materialize(rows)
    edges: list[DataFrame] = []
    size: int | None = None
    while True:
        large = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > limit))
        now = large.agg(F.sum("n").alias("n")).first()["n"] or 0  # one number
        if not now or (size is not None and now > 0.8 * size):
            edges.append(_grouped(rows.withColumn("salt", F.lit(-1).cast("long")), radius).select("a", "b"))
            break
        size = now
        salt = F.when(F.col("n").isNull(), -1).otherwise(F.pmod(F.xxhash64("key", "node"), F.ceil(F.col("n") / limit))).cast("long")
        found = materialize(_grouped(rows.join(bounded(large), "key", "left").withColumn("salt", salt), radius))
        edges.append(found.filter("a IS NOT NULL").select("a", "b"))
        rows = found.filter("key IS NOT NULL").select("key", "hi", "lo", "node")
    return reduce(DataFrame.unionAll, edges)


def exact_links(codes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between the distinct long fingerprints of column `code`, enough to connect every component."""
    return linked(codes.select(F.explode(block_keys(F.col("code"), radius)).alias("key"), F.col("code").alias("hi"), F.lit(0).cast("long").alias("lo"), F.col("code").alias("node")), radius, 1 << 62)


def likely_links(codes: DataFrame, similarity: float, limit: int = LARGEST) -> DataFrame:
    """Edges (a, b) between the nodes of (node, hi, lo), by Bands: all pairs of texts of `similarity` or more but for one in 20 or so."""
    bands = Bands(codes.count(), similarity)
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = round(WIDE * differ + 1.7 * math.sqrt(WIDE * differ * (1 - differ)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hi, lo = (b.column(c).to_numpy() for c in ("hi", "lo"))
            for key in bands.keys(hi, lo):
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column("hi"), b.column("lo"), b.column("node")], ["key", "hi", "lo", "node"])

    return linked(codes.select("hi", "lo", "node").mapInArrow(tidied(run), _ROWS), radius, limit)


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, code (fingerprint as long), component_id of every row."""
    rows = only(docs, doc_id="long", text="string")
    return classes(materialize(rows.select("doc_id", fingerprint_column(F.col("text"), size).alias("code"))), radius)


def classes(marked: DataFrame, radius: int) -> DataFrame:
    """doc_id, code, component_id from doc_id and code."""
    return marked.join(code_components(marked, radius), "code").select("doc_id", "code", "component_id")


def code_components(marked: DataFrame, radius: int) -> DataFrame:
    """code and component_id (smallest doc_id reachable) of every distinct fingerprint."""
    codes = materialize(marked.groupBy("code").agg(F.min("doc_id").alias("least")))
    found = components(exact_links(codes, radius))
    whole = codes.join(found, F.col("code") == F.col("node"), "left").select("code", "least", F.coalesce("label", "code").alias("label"))
    ids = whole.groupBy("label").agg(F.min("least").alias("component_id"))
    return materialize(whole.join(ids, "label").select("code", "component_id", "label"))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    grams = set(_shingles(text, size))
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams)).view(np.int64))


def alike_later(ids: np.ndarray, at: np.ndarray, similarity: float, heads: int | None = None) -> np.ndarray:
    """Which of some shingle sets an earlier one that stays puts out, in order; set i is ids[at[i]:at[i + 1]].

    With `heads` the first `heads` sets all stay and only they put others out; else every set that is still in does.
    """
    n, size = len(at) - 1, np.diff(at)
    word = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    out, mark = np.zeros(n, bool), np.zeros(int(word.max()) + 1 if len(word) else 0, bool)
    for i in range(n if heads is None else heads):
        if out[i]:
            continue
        k = i + 1 if heads is None else heads
        own = word[at[i] : at[i + 1]]
        mark[own] = True
        seen = np.concatenate(([0], np.cumsum(mark[word[at[k] :]])))
        mark[own] = False
        both = seen[at[k + 1 :] - at[k]] - seen[at[k:-1] - at[k]]
        either = size[i] + size[k:] - both
        out[k:] |= np.where(either > 0, both / np.maximum(either, 1), 1.0) >= similarity
    return out


def _flat(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of the column `grams`."""
    grams = rows.column("grams")
    grams = grams.combine_chunks() if isinstance(grams, pa.ChunkedArray) else grams
    return grams.flatten().to_numpy(), np.concatenate(([0], np.cumsum(grams.value_lengths().to_numpy().astype(np.int64))))


def _heads(similarity: float):
    """The documents that stay of each label's block, from rows sorted by label and order."""

    def judge(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, at = _flat(rows)
        label = rows.column("label").to_numpy()
        cut = np.flatnonzero(np.diff(label)) + 1
        stays = np.ones(len(label), bool)
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(label)], strict=True):
            if e - s > 1:
                stays[s:e] = ~alike_later(ids[at[s] : at[e]], at[s : e + 1] - at[s], similarity)
        yield from rows.filter(pa.array(stays)).to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column("label").to_numpy()
            whole = int(np.searchsorted(label == label[-1], True))  # the last label may go on
            if whole or held and held[-1].column("label")[0].as_py() != label[0]:
                yield from judge(pa.Table.from_batches([*held, batch.slice(0, whole)]))
                held = []
            held.append(batch.slice(whole))
        if held:
            yield from judge(pa.Table.from_batches(held))

    return run


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8, block: int = 1 << 20) -> DataFrame:
    """The rows of `docs`, with all their columns, less near copies: one row of each group of copies stays.

    Fingerprints and shared rare shingles (`prefix_links`, which leaves no pair of `similarity` out) only propose; a document goes if its text equals an earlier one's or if the Jaccard similarity of its
    shingles with an earlier document of its component that stays is `similarity` or more (order: doc_id, hash; null
    doc_ids last). Components run side by side. One of more than `block` shingles is judged block by block: its first
    open documents among themselves in one task, then the others against those that stay, in parts of about `block`
    shingles, until none is open.

    Null text counts as empty; all empty texts are copies of each other. Of wholly repeated rows one stays.
    """
    id_, hash_ = unused(text_batches(docs).columns, "doc", "text_hash")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), text.alias("text"))
    keys = keys.withColumn("hash", F.xxhash64("text"))
    code = keys.select("doc_id", "hash", wide_fingerprint_column(F.col("text"), size).alias("code"))
    marked = materialize(code.select("doc_id", "hash", "code.hi", "code.lo", F.xxhash64("code.hi", "code.lo").alias("node")))
    first = materialize(marked.groupBy("node", "hi", "lo", "hash").agg(F.min("doc_id").alias("doc_id")))  # equal texts are one
    texts = keys.join(bounded(first), ["doc_id", "hash"]).select(F.col("hash").alias("id"), "text")
    met = prefix_links(texts, lambda t: shingle_hashes(t, size), similarity)
    node_of = first.select("hash", "node")
    met = met.join(node_of.toDF("a", "x"), "a").join(node_of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = components(likely_links(materialize(first.select("node", "hi", "lo").distinct()), similarity).unionByName(met))
    twins = first.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node", F.col("node").alias("label"))
    named = found.union(twins.join(found, "node", "left_anti"))  # a code of several texts is a component too
    open_ = materialize(first.join(bounded(materialize(named)), "node").select("doc_id", "hash", "label"))
    hashes = F.pandas_udf(lambda texts: pd.Series([shingle_hashes(t, size) for t in texts]), "array<long>")
    grams = keys.join(bounded(open_), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).select("doc_id", "hash", "label", hashes("text").alias("grams"))
    place, columns, schema = F.struct("doc_id", "hash"), ["doc_id", "hash", "label", "grams"], "doc_id long, hash long, label long, grams array<long>"

    def unlike(heads: pa.Table, rest: pa.Table) -> pa.Table:
        """The documents of a part of a label that none of the label's heads puts out."""
        both = pa.concat_tables([heads.select(columns), rest.select(columns).cast(heads.select(columns).schema)])
        out = alike_later(*_flat(both), similarity, heads.num_rows)
        return rest.select(columns).filter(pa.array(~out[heads.num_rows :]))

    stay: list[DataFrame] = []
    while True:
        grams = materialize(grams)
        sizes = grams.select("label", "doc_id", "hash", F.size("grams").cast("long").alias("n"))
        large = materialize(sizes.groupBy("label").agg(F.sum("n").alias("n")).filter(F.col("n") > block).select("label", F.ceil(F.col("n") / block).alias("parts")))
        if large.isEmpty():
            stay.append(_in_order(grams).mapInArrow(tidied(_heads(similarity)), schema).select("doc_id", "hash"))
            break
        # the first documents of up to `block` shingles and one more, by salted parts first, so that no task sorts a whole label
        ahead = sizes.join(bounded(large), "label").withColumn("salt", F.pmod("hash", F.lit(64)))
        for by in (["label", "salt"], ["label"]):
            before = Window.partitionBy(*by).orderBy("doc_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
            ahead = ahead.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("before") < block)
        cuts = materialize(ahead.groupBy("label", "parts").agg(F.max(place).alias("cut")))
        now = grams.join(bounded(cuts), "label", "left")
        heads = materialize(_in_order(now.filter(F.col("cut").isNull() | (place <= F.col("cut")))).mapInArrow(tidied(_heads(similarity)), schema))
        stay.append(heads.select("doc_id", "hash"))
        rest = now.filter(place > F.col("cut")).select(*columns, F.pmod("hash", "parts").alias("salt"))
        sent = heads.join(bounded(cuts), "label").select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
        grams = sent.groupBy("label", "salt").cogroup(rest.groupBy("label", "salt")).applyInArrow(unlike, schema)
    kept = materialize(reduce(DataFrame.unionAll, stay))
    times = marked.groupBy("doc_id", "hash").agg(F.count("*").alias("n"))
    copies = times.join(first.select("doc_id", "hash"), ["doc_id", "hash"], "left_anti")
    unlike_none = open_.select("doc_id", "hash").join(kept, ["doc_id", "hash"], "left_anti")
    gone = materialize(copies.select("doc_id", "hash").union(unlike_none).toDF(id_, hash_))
    # the texts stay where they are as long as what goes can be broadcast
    narrow = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), hash_: F.xxhash64(text)})
    left = narrow.join(bounded(gone), [id_, hash_], "left_anti")
    again = materialize(times.filter("n > 1").select(F.col("doc_id").alias(id_), F.col("hash").alias(hash_)))
    if again.isEmpty():
        return left.select(*[F.col(f"`{c}`") for c in docs.columns])
    once = left.join(bounded(again), [id_, hash_], "left_anti")
    repeated = left.join(bounded(again), [id_, hash_], "left_semi").dropDuplicates([id_, hash_])
    return once.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])


def _in_order(grams: DataFrame) -> DataFrame:
    return grams.select("doc_id", "hash", "label", "grams").repartition(F.col("label")).sortWithinPartitions("label", "doc_id", "hash")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
