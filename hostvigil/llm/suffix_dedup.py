"""Substring dedup by prefix-free parsing.

A rolling hash runs over every text. In each stretch of LENGTH bytes, the leftmost k-gram of the smallest hash is a
trigger, so equal stretches have the same trigger at the same place. The phrase of a trigger is the text of all
stretches that it rules, overlapping the next phrases as in prefix-free parsing: every LENGTH-byte string of the corpus
is the start of a suffix of exactly one phrase, so equal strings meet in the dictionary of distinct phrases and the
parse (which phrases each document has, in order of doc_id) gives back their documents.

The dictionary is dealt to buckets by trigger and sorted there by (trigger, phrase, part of the corpus); that alone
decides phrases whose trigger has no other phrase. For the rest, the suffixes of the dictionary's phrases are sorted by
their first LENGTH bytes. Both orders are by hash (80 bits and more), not by letter: only runs of equal strings and
the corpus order within them matter here. A text is parsed in parts (see `exchange`), and parts are ranges of doc_id,
so "occurs in a document with a smaller id" means an earlier part or an earlier document of the same part.

Null text counts as empty; rows of the same doc_id don't count against each other; null doc_ids come before all others
and count as one id. Texts under LENGTH bytes lose nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostvigil.llm.common import read_table
from hostvigil.llm.exchange import MESSAGE, SAME_RANK, answer, meet, messages, parted, send

LENGTH = 50
TRIGGER = 24
#: Text of a part, in bytes.
PART_BYTES = 5 << 20
#: Bytes hashed at a time.
BLOCK = 1 << 18
PHRASES, SUFFIXES = 0, 1
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOW = _U(0xFFFFFFFF)
_40 = _U((1 << 40) - 1)


def _power(n: int) -> np.uint64:
    return _U(pow(int(_BASE), n, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _glue(a: np.ndarray, b: np.ndarray, at: int, size: int) -> np.ndarray:
    """Hashes of strings of `at` + `size` bytes from those of `at` bytes and of the `size` bytes after them."""
    n = max(0, len(b) - at)
    return a[:n] * _power(size) + b[at : at + n]


class Parse:
    """Phrases of a part: for each, the first and last start of its stretches, its document, trigger and phrase hash."""

    def __init__(self, docs: pa.Table, strings: bool = True):
        """Without `strings` the hashes of all LENGTH bytes, eight times the text, are not kept."""
        ids = docs.column("doc_id").combine_chunks()
        # null first, then by id; repeated ids in the order of their texts, so that every attempt sees the same order
        rows = [(i is not None, i or 0, (t or "").encode("utf-8", "surrogatepass"), k) for k, (i, t) in enumerate(zip(ids.to_pylist(), docs.column("text").to_pylist(), strict=True))]
        rows.sort()
        self.part = docs.column("part")[0].as_py() if len(docs) else None
        self.ids = [i if some else None for some, i, _, _ in rows]
        self.texts = [t for _, _, t, _ in rows]
        self.row = [k for _, _, _, k in rows]  # in the input
        new = [n == 0 or rows[n][:2] != rows[n - 1][:2] for n in range(len(rows))]
        self.rank = np.cumsum(np.array(new, np.int64))  # equal for equal ids
        size = np.array([len(t) for t in self.texts], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(size)))
        self.hash = np.zeros(int(self.begin[-1]), np.uint64) if strings else None  # of the LENGTH bytes from here
        del rows
        got = [self._block(a, b) for a, b in self._blocks(size)]
        first, last, trigger, self.phrase = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.uint64 if k >= 2 else np.int64) for k in range(4))
        del got
        self.first, self.last, self.trigger = first, last, trigger
        self.doc = np.searchsorted(self.begin, first, side="right") - 1
        # the part's dictionary, in the order in which it is sent
        self.key, self.code = trigger & _40, self.phrase & _40
        self.bucket_hash = trigger >> _U(40)

    def _blocks(self, size: np.ndarray):
        a = held = 0
        for d, n in enumerate(size.tolist()):
            if held and held + n > BLOCK:
                yield a, d
                a, held = d, 0
            held += n
        if held:
            yield a, len(size)

    def _block(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of documents a to b - 1."""
        offset = int(self.begin[a])
        text = np.frombuffer(b"".join(self.texts[a:b]), np.uint8)
        empty = np.zeros(0, np.int64)
        if len(text) < LENGTH:
            return empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        h1 = _TABLE[text]
        h2 = _glue(h1, h1, 1, 1)
        h4 = _glue(h2, h2, 2, 2)
        h8 = _glue(h4, h4, 4, 4)
        h16 = _glue(h8, h8, 8, 8)
        h32 = _glue(h16, h16, 16, 16)
        whole = _glue(_glue(h32, h16, 32, 16), h2, 48, 2)  # LENGTH bytes
        gram = _mix(_glue(h16, h8, 16, 8))  # TRIGGER bytes
        v = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)
        for step in (1, 2, 4, 8):  # smallest of 16 in a row, then of LENGTH - TRIGGER + 1
            v = np.minimum(v[:-step], v[step:])
        step = LENGTH - TRIGGER + 1 - 16
        v = np.minimum(v[:-step], v[step:])
        owner = (v & _LOW).astype(np.int64)
        if self.hash is not None:
            self.hash[offset : offset + len(whole)] = whole
        inside = np.zeros(len(text), bool)  # starts of stretches that don't leave their document
        for s, e in zip((self.begin[a:b] - offset).tolist(), (self.begin[a + 1 : b + 1] - offset).tolist(), strict=True):
            if e - s >= LENGTH:
                inside[s : e - LENGTH + 1] = True
        p = np.flatnonzero(inside)
        if not len(p):
            return empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        o = owner[p]
        cut = np.flatnonzero(np.diff(o)) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(p) - 1]))
        first, last, trigger = p[first], p[last], gram[o[first]]
        phrase = _mix(whole[first] * _U(0xC2B2AE3D27D4EB4F) + whole[last] * _U(0x165667B19E3779F9) + (last - first).astype(np.uint64))
        return first + offset, last + offset, trigger, phrase

    def dictionary(self, n: int) -> None:
        """Sort the phrases: `order` by (bucket, trigger, phrase, document), `entry` of each phrase, `head` of each entry."""
        self.bucket = (self.bucket_hash % _U(n)).astype(np.int64)
        self.order = np.lexsort((self.doc, self.code, self.key, self.bucket))
        k, c, q = self.key[self.order], self.code[self.order], self.bucket[self.order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (q[1:] != q[:-1])
        self.head = self.order[new]
        self.entry = np.empty(len(k), np.int64)
        self.entry[self.order] = np.cumsum(new) - 1
        del self.order

    def suffixes(self, entries: np.ndarray, n: int) -> None:
        """Sort the suffixes of LENGTH bytes and more of these entries' phrases, each phrase taken where it comes first."""
        head = self.head[entries]
        count = self.last[head] - self.first[head] + 1
        at = np.repeat(self.first[head] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
        h, x = _mix(self.hash[at]), (np.repeat(self.trigger[head], count) & _U(0xFFFF)).astype(np.uint16)
        rank = np.repeat(self.rank[self.doc[head]], count)
        q = ((h >> _U(40)) % _U(n)).astype(np.int64)
        order = np.lexsort((rank, x, h, q))
        h, x, q, rank, at = h[order], x[order], q[order], rank[order], at[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1]) | (q[1:] != q[:-1])
        string = np.cumsum(new) - 1
        # of the distinct strings: hash, rest, bucket; of all suffixes: start, string, and whether an earlier document of the part has it
        self.s_hash, self.s_rest, self.s_bucket = h[new], x[new], q[new]
        self.s_at, self.s_string, self.s_again = at, string, rank > rank[new][string]

    def flags(self, got: list[dict], kind: int, buckets: np.ndarray) -> np.ndarray:
        """The answers of one kind, in the order in which the entries were sent."""
        by = {r["bucket"]: r["body"] for r in got if r["kind"] == kind}
        return np.frombuffer(b"".join(by[q] for q in np.unique(buckets).tolist()), np.uint8)


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def _slices(bucket: np.ndarray):
    """(bucket, start, end) of each run in a sorted array."""
    cut = np.flatnonzero(np.diff(bucket)) + 1
    ends = np.concatenate((cut, [len(bucket)])) if len(bucket) else []
    start = 0
    for e in ends:
        yield int(bucket[start]), start, int(e)
        start = int(e)


def _send_phrases(n: int):
    def emit(docs: pa.Table) -> list[tuple[int, int, int, bytes]]:
        p = Parse(docs, strings=False)
        del p.texts
        p.dictionary(n)
        return [(p.part, q, PHRASES, _five(p.key[p.head[a:b]]) + _five(p.code[p.head[a:b]])) for q, a, b in _slices(p.bucket[p.head])]

    return emit


def _answer_phrases(rows: list[dict]) -> list[tuple[int, int, int, bytes]]:
    """For each entry: 1 if a part of smaller rank has the phrase, plus 2 if the trigger has other phrases too."""
    sizes = [len(r["body"]) // 10 for r in rows]
    key = np.concatenate([_from_five(r["body"][: 5 * n]) for r, n in zip(rows, sizes, strict=True)])
    code = np.concatenate([_from_five(r["body"][5 * n :]) for r, n in zip(rows, sizes, strict=True)])
    flag = np.zeros(len(key), np.uint8)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    shared = np.zeros(len(key), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    at = np.flatnonzero(shared)  # in order of the parts
    at = at[np.lexsort((at, code[at], key[at]))]
    k, c = key[at], code[at]
    if len(at):
        again = _after_first(_ranks(rows, sizes)[at], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
        new = np.concatenate(([True], k[1:] != k[:-1]))
        head = np.flatnonzero(new)
        tail = np.concatenate((head[1:], [len(at)])) - 1
        several = (c[head] != c[tail])[np.cumsum(new) - 1]
        flag[at] = again + 2 * several
    return _split(rows, sizes, flag, PHRASES)


def _ranks(rows: list[dict], sizes: list[int]) -> np.ndarray:
    return np.repeat(np.array([r["part"] // SAME_RANK for r in rows], np.int64), sizes)


def _after_first(rank: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which of some sorted entries come from a greater rank than the first of their run; `new`: where the next run begins."""
    head = np.concatenate(([0], np.flatnonzero(new) + 1))
    return rank > np.repeat(rank[head], np.diff(np.append(head, len(rank))))


def _split(rows: list[dict], sizes: list[int], flag: np.ndarray, kind: int) -> list[tuple[int, int, int, bytes]]:
    ends = np.cumsum(sizes).tolist()
    return [(r["part"], r["bucket"], kind, flag[e - n : e].tobytes()) for r, n, e in zip(rows, sizes, ends, strict=True)]


def _open(p: Parse, flag: np.ndarray) -> np.ndarray:
    """Entries whose suffixes must be compared: first of their phrase, and the trigger has others."""
    return np.flatnonzero(flag == 2)


def _send_suffixes(n: int):
    def finish(docs: pa.Table, got: list[dict]) -> pa.Table:
        if not len(docs):
            return messages([])
        p = Parse(docs)
        del p.texts
        p.dictionary(n)
        p.suffixes(_open(p, p.flags(got, PHRASES, p.bucket[p.head])), n)
        return messages([(p.part, q, SUFFIXES, p.s_hash[a:b].astype("<u8").tobytes() + p.s_rest[a:b].astype("<u2").tobytes()) for q, a, b in _slices(p.s_bucket)])

    return finish


def _answer_suffixes(rows: list[dict]) -> list[tuple[int, int, int, bytes]]:
    """For each string: 1 if a part of smaller rank has it."""
    sizes = [len(r["body"]) // 10 for r in rows]
    h = np.concatenate([np.frombuffer(r["body"][: 8 * n], "<u8") for r, n in zip(rows, sizes, strict=True)])
    x = np.concatenate([np.frombuffer(r["body"][8 * n :], "<u2") for r, n in zip(rows, sizes, strict=True)])
    order = np.lexsort((x, h))  # stable: equal strings stay in order of the parts
    flag = np.zeros(len(h), np.uint8)
    h, x = h[order], x[order]
    if len(h):
        flag[order] = _after_first(_ranks(rows, sizes)[order], (h[1:] != h[:-1]) | (x[1:] != x[:-1]))
    return _split(rows, sizes, flag, SUFFIXES)


def _removed(p: Parse, got: list[dict], n: int) -> np.ndarray:
    """For each byte of the part's texts, whether it goes."""
    p.dictionary(n)
    flag = p.flags(got, PHRASES, p.bucket[p.head])
    whole = (flag[p.entry] & 1 == 1) | (p.rank[p.doc] > p.rank[p.doc[p.head]][p.entry])  # all stretches of the phrase occur before
    cover = np.zeros(len(p.hash) + 1, np.int32)
    np.add.at(cover, p.first[whole], 1)
    np.add.at(cover, p.last[whole] + LENGTH, -1)
    open_ = _open(p, flag)
    if len(open_):
        p.suffixes(open_, n)
        before = p.flags(got, SUFFIXES, p.s_bucket).astype(bool)[p.s_string] | p.s_again
        # the strings of an open phrase go wherever the phrase stands in the first document that has it
        starts = np.zeros(len(p.hash) + 1, bool)
        starts[p.s_at[before]] = True
        again = np.flatnonzero(~whole & np.isin(p.entry, open_) & (p.head[p.entry] != np.arange(len(p.entry))))
        for f in again.tolist():  # more than once in the same document (or under the same id)
            g = p.head[p.entry[f]]
            starts[p.first[f] : p.last[f] + 1] |= starts[p.first[g] : p.last[g] + 1]
        s = np.flatnonzero(starts)
        cover[: len(p.hash)] += starts[:-1]
        np.add.at(cover, s + LENGTH, -1)
    return np.cumsum(cover, dtype=np.int32, out=cover)[:-1] > 0


def _digest(n: int, keep: bool):
    def finish(docs: pa.Table, got: list[dict]) -> pa.Table:
        p = Parse(docs) if len(docs) else None
        size, removed, spans, kept = [], [], [], []
        if p:
            gone = _removed(p, got, n)
            del p.hash
            for t, a, b in zip(p.texts, p.begin[:-1].tolist(), p.begin[1:].tolist(), strict=True):
                g = gone[a:b]
                size.append(b - a)
                removed.append(int(g.sum()))
                spans.append(int(np.count_nonzero(g[1:] & ~g[:-1]) + (len(g) > 0 and g[0])))
                kept.append(np.frombuffer(t, np.uint8)[~g].tobytes() if removed[-1] else t)
        columns = [pa.array(p.ids if p else [], pa.int64()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans"]
        if not keep:
            columns.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))
            return pa.table(columns, names=[*names, "kept_sha256"])
        columns.append(pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
        columns.append(docs.column("kept").take(pa.array(p.row if p else [], pa.int64())))
        return pa.table(columns, names=[*names, "text", "kept"])

    return finish


def dedup(docs: DataFrame, keep: bool = False, part_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    With `keep`: the kept text instead of its hash, and `kept`, a struct of the row's other columns (c0, c1 and so on; text is null). The kept text leaves out bytes of characters that were cut in two.
    """
    parts, n = parted(docs, part_bytes or PART_BYTES, keep)
    # all three passes read the same columns, so that the texts are shuffled once
    phrases = answer(send(parts, _send_phrases(n)), _answer_phrases)
    strings = answer(meet(parts, phrases, _send_suffixes(n), MESSAGE), _answer_suffixes)
    fields = [T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")]
    fields += [T.StructField("text", T.StringType()), parts.schema["kept"]] if keep else [T.StructField("kept_sha256", T.StringType())]
    return meet(parts, phrases.unionByName(strings), _digest(n, keep), T.StructType(fields))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with repeated text removed and n_chars, if there is such a column, counted anew; other columns of any name
    stay as they are, every row gives a row, and an empty table stays one."""
    out = dedup(docs, keep=True)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col(f"kept.c{k}")).alias(c) for k, c in enumerate(docs.columns)])


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents"))
