"""Language-model scoring with a probabilistic suffix tree.

The tree spells tokens: a word is its bytes and a blank, the end of a text is a line feed, so that spelled tokens are
free of each other's beginnings. Its states are contexts of up to DEPTH bytes, over the borders of words, counted in all
training texts. A context is retained if the counts of its next bytes diverge from its parent's distribution (the
context without its first byte) by KEEP_NATS or more in log-likelihood; a retained state smooths its counts towards its
parent by as many pseudo-counts as it has different next bytes; any other context passes on to its longest retained
suffix. A token's probability is that of its first two bytes in their longest suffix states, times a mixture of the
training words that begin so and of the spelling: share * c / C + (1 - share) * P(its other bytes | longest suffix
states), with share = C / (C + V). C counts the training tokens that begin with these two bytes, V the distinct ones, so
the probabilities of all tokens sum to one, words that were never seen included.

Words and strings of DEPTH + 1 bytes meet the corpus through `exchange`: what a part sends is distinct within it, and
all contexts that end in the same two bytes meet in one bucket, which grows their subtree and answers with
probabilities. So neither the vocabulary nor the tree is ever broadcast, whatever its size; contexts of no or one byte
are a table of 256 * 256 numbers. Every count is taken over all training documents, and no result depends on how the
corpus is dealt.

Null text counts as empty (one token, the end); a null doc_id hashes as the empty string; texts are scored whole, and
every row by itself, repeated or not. Extra columns may have any name. An empty table gives no rows; without training
documents all bytes are equally likely.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvigil.llm.common import materialize, only, read_table, row_chunks, tidied
from hostvigil.llm.exchange import answer, meet, scattered, send

FOLDS = 10
ADD = 0.1
DEPTH = 5
KEEP_NATS = 4.0
WORDS, STATS, GRAMS = 0, 1, 2
#: Bytes spelled at a time.
BLOCK = 1 << 21
_U = np.uint64
END = b"\n"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def spelled(words: list[bytes]) -> bytes:
    """A text's tokens, after DEPTH ends that stand for its start."""
    return END * DEPTH + b" ".join(words) + b" " * bool(words) + END


def beginning(word: bytes) -> int:
    """A word's first two spelled bytes as a number."""
    return word[0] << 8 | (word[1] if len(word) > 1 else 32)


def grams(text: bytes) -> np.ndarray:
    """Each DEPTH + 1 bytes in a row as one number, the last byte lowest."""
    x = np.frombuffer(text, np.uint8)
    g = np.zeros(max(0, len(x) - DEPTH), _U)
    for k in range(DEPTH + 1):
        g = g << _U(8) | x[k : k + len(g)]
    return g


def _spellings(texts: Iterable[tuple[bool, list[bytes]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of (trains, words) of each text, some texts at a time: every gram, whether it trains, and where each text begins."""
    held: list[np.ndarray] = []
    train: list[bool] = []

    def flush():
        size = np.array([len(g) for g in held], np.int64)
        return np.concatenate(held), np.repeat(np.array(train, bool), size), np.concatenate(([0], np.cumsum(size)[:-1]))

    n = 0
    for trains, words in texts:
        held.append(grams(spelled(words)))
        train.append(trains)
        n += len(held[-1])
        if n >= BLOCK:
            yield flush()
            held, train, n = [], [], 0
    if held:
        yield flush()


def _smoothed(count: np.ndarray, total: np.ndarray, kinds: np.ndarray, parent: np.ndarray) -> np.ndarray:
    return (count + kinds * parent) / np.maximum(total + kinds, 1)


def roots(counts: np.ndarray) -> np.ndarray:
    """P(byte | longest state of at most one byte) from counts of (byte before, byte)."""
    root = (counts.sum(0) + ADD) / (counts.sum() + 256 * ADD)
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    seen = np.where(counts > 0, counts, 1)
    gain = np.where(counts > 0, counts * np.log(seen / np.maximum(total, 1) / root), 0).sum(1, keepdims=True)
    return np.where(gain >= KEEP_NATS, _smoothed(counts, total, kinds, root), root)


def grow(gram: np.ndarray, count: np.ndarray, root: np.ndarray) -> np.ndarray:
    """P(last byte | longest state) of each of the distinct sorted grams, from all training counts of the grams that end in
    its context's last two bytes. Each depth is summed from the one below it, which has fewer and fewer pairs."""
    byte = _U(255)
    levels = [gram]  # of each depth, deepest first, the distinct (context, byte), and which of them each one of the next depth ends in
    counts, into = [count], []
    for depth in range(DEPTH - 1, 1, -1):
        pair, of = np.unique(levels[-1] & _U((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        counts.append(np.bincount(of, counts[-1], len(pair)))
        levels.append(pair)
        into.append(of)
    last = levels[-1]
    p = root[(last >> _U(8) & byte).astype(np.int64), (last & byte).astype(np.int64)]
    while True:
        pair, n = levels.pop(), counts.pop()
        start = _runs_of(pair >> _U(8))
        size = np.diff(np.append(start, len(pair)))
        total, kinds = np.repeat(np.add.reduceat(n, start), size), np.repeat(np.add.reduceat((n > 0).astype(float), start), size)
        diverge = np.where(n > 0, n * np.log(np.where(n > 0, n, 1) / np.maximum(total, 1) / p), 0)
        kept = np.repeat(np.add.reduceat(diverge, start) >= KEEP_NATS, size)
        p = np.where(kept, _smoothed(n, total, kinds, p), p)
        if not levels:
            return p
        p = p[into.pop()]


def _by_bucket(words, n: int) -> dict[int, list[bytes]]:
    """Words sorted within buckets: the order in which they are sent."""
    out: dict[int, list[bytes]] = {}
    for w in words:
        out.setdefault(zlib.crc32(w) % n, []).append(w)
    for ws in out.values():
        ws.sort()
    return out


def _gram_buckets(gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order in which distinct sorted grams are sent, and the bucket of each in that order: by the last two bytes of the context."""
    tail = (gram >> _U(8)) & _U(0xFFFF)
    bucket = ((tail * _U(0x9E3779B97F4A7C15) >> _U(32)) % _U(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for a, b in zip(cut, cut[1:]):
        if b > a:
            yield int(bucket[a]), a, b


def _runs_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in sorted ones."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))


def _distinct_grams(rows: Iterable[tuple[bool, list[bytes]]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, and how often the training texts have each."""
    grams_, counts = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for g, train, _ in _spellings(rows):
        key = np.sort(g << _U(1) | train.astype(_U))  # sorting numbers alone is far faster than sorting places
        at = _runs_of(key >> _U(1))
        grams_.append(key[at] >> _U(1))
        counts.append(np.add.reduceat((key & _U(1)).astype(np.int64), at) if len(at) else np.zeros(0, np.int64))
    gram, of = _merged(np.concatenate(grams_))
    return gram, np.bincount(of, np.concatenate(counts), len(gram))


def _merged(sorted_runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and which of them stands where, of sorted runs one after the other."""
    order = np.argsort(sorted_runs, kind="stable")  # merges runs
    values = sorted_runs[order]
    at = _runs_of(values)
    of = np.empty(len(values), np.int64)
    of[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(values))))
    return values[at], of


def _send(n: int):
    def emit(docs: pa.Table) -> list[tuple[int, int, int, bytes]]:
        part = docs.column("part")[0].as_py()
        rows = [(not held_out(i), tokens(t)) for i, t in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True)]
        train: Counter = Counter()
        every: set[bytes] = set()
        for trains, ws in rows:
            (train if trains else every).update(ws)
        every.update(train)
        out = []
        for q, ws in _by_bucket(every, n).items():
            counts = np.fromiter(map(train.__getitem__, ws), np.int64, len(ws))
            out.append((part, q, WORDS, b" ".join(ws) + END + counts.astype("<i8").tobytes()))
        gram, count = _distinct_grams(rows)
        order, bucket = _gram_buckets(gram, n)
        gram, count = gram[order], count[order]
        out += [(part, q, GRAMS, gram[a:b].astype("<u8").tobytes() + count[a:b].astype("<u4").tobytes()) for q, a, b in _runs(bucket)]
        return out

    return emit


def _answer(root: np.ndarray):
    def reply(rows: list[dict]) -> list[tuple[int, int, int, bytes]]:
        """To each part the training counts of its words and the log10 probabilities of its grams; the bucket's words in all."""
        q = rows[0]["bucket"]
        sent = [(r["part"], *r["body"].split(END, 1)) for r in rows if r["kind"] == WORDS]
        total: Counter = Counter()
        for _, ws, counts in sent:
            for w, c in zip(ws.split(b" "), np.frombuffer(counts, "<i8").tolist(), strict=True):
                total[w] += c
        out = [(part, q, WORDS, np.fromiter((total[w] for w in ws.split(b" ")), np.int64).astype("<i8").tobytes()) for part, ws, _ in sent]
        begun = Counter()
        kinds = Counter()
        for w, c in total.items():
            if c:
                begun[beginning(w)] += c
                kinds[beginning(w)] += 1
        out.append((-1, q, STATS, np.array([*begun, *begun.values(), *(kinds[k] for k in begun)], "<i8").tobytes()))
        got = [(r["part"], r["body"]) for r in rows if r["kind"] == GRAMS]
        if got:
            size = [len(b) // 12 for _, b in got]
            gram = np.concatenate([np.frombuffer(b[: 8 * k], "<u8") for (_, b), k in zip(got, size, strict=True)])
            count = np.concatenate([np.frombuffer(b[8 * k :], "<u4") for (_, b), k in zip(got, size, strict=True)])
            some, of = _merged(gram)
            p = np.log10(grow(some, np.bincount(of, count, len(some)), root)).astype("<f4")[of]
            ends = np.cumsum(size).tolist()
            out += [(part, q, GRAMS, p[e - k : e].tobytes()) for (part, _), k, e in zip(got, size, ends, strict=True)]
        return out

    return reply


def _score(n: int, ends: int, begun: np.ndarray, kinds: np.ndarray):
    """Per document: tokens, known ones, base score and score."""
    big_n, big_v = int(begun.sum()) + ends, int(kinds.sum()) + (ends > 0)

    def finish(docs: pa.Table, got: list[dict]) -> pa.Table:
        rows = [(i, tokens(t)) for i, t in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True)] if len(docs) else []
        body = {(r["kind"], r["bucket"]): r["body"] for r in got}
        count: dict[bytes, int] = {}
        for q, ws in _by_bucket({w for _, ws in rows for w in ws}, n).items():
            count.update(zip(ws, np.frombuffer(body[WORDS, q], "<i8").tolist(), strict=True))
        blocks = []  # of each: its distinct grams, which of them stands where, the last bytes, and where texts begin
        for g, _, begin in _spellings((False, ws) for _, ws in rows):
            some, which = np.unique(g, return_inverse=True)
            blocks.append((some, which.astype(np.int32), (g & _U(255)).astype(np.uint8), begin))
        gram = _merged(np.concatenate([b[0] for b in blocks]))[0] if blocks else np.zeros(0, _U)
        order, bucket = _gram_buckets(gram, n)
        p = np.empty(len(gram), np.float32)
        if len(gram):
            p[order] = np.concatenate([np.frombuffer(body[GRAMS, q], "<f4") for q, *_ in _runs(bucket)])
        out: list[tuple] = []
        todo = iter(rows)
        for some, which, byte, begin in blocks:
            steps = p[np.searchsorted(gram, some)].astype(np.float64)[which]
            stop = (byte == 32) | (byte == 10)  # the last byte of each token
            first = np.flatnonzero(np.concatenate(([True], stop[:-1])))
            end = byte[first] == 10
            second = np.where(end, first, first + 1)
            two = steps[first] + np.where(end, 0.0, steps[second])
            rest = np.add.reduceat(steps, first) - two
            cell = byte[first].astype(np.int64) << 8 | byte[second]
            docs_here = [next(todo) for _ in range(len(begin))]
            counts: list[int] = []
            for _, ws in docs_here:
                counts += map(count.__getitem__, ws)
                counts.append(ends)
            c = np.array(counts, np.float64)
            with np.errstate(divide="ignore"):
                share = begun[cell] / np.maximum(begun[cell] + kinds[cell], 1)
                whole, spelling = np.log10(share * c / np.maximum(begun[cell], 1)), rest + np.log10(1 - share)
            most = np.maximum(whole, spelling)
            token = two + np.where(end, 0.0, most + np.log10(10.0 ** (whole - most) + 10.0 ** (spelling - most)))
            base = np.log10((c + ADD) / (big_n + ADD * (big_v + 1)))
            at = np.searchsorted(first, begin)
            sums = [np.add.reduceat(x, at) for x in (base, token, (c > 0).astype(np.int64))]
            for k, (i, ws) in enumerate(docs_here):
                out.append((i, held_out(i), len(ws) + 1, int(sums[2][k]), big_n, float(sums[0][k]), float(sums[1][k])))
        types_ = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.table([pa.array(x, ty) for x, ty in zip(zip(*out) if out else [[]] * 7, types_)], names=names)

    return finish


def _byte_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n): counts of two spelled bytes in a row in the training documents; cell 65536 counts the documents."""
    counts = np.zeros(65537, np.int64)
    for b in row_chunks(batches):
        texts = [tokens(t) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if not held_out(i)]
        for g, _, _ in _spellings((True, ws) for ws in texts):
            counts[:65536] += np.bincount((g & _U(0xFFFF)).astype(np.int64), minlength=65536)
        counts[65536] += len(texts)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["cell", "n"])


def _numbers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n): tokens by their beginning, and from cell 65536 on distinct words."""
    for b in batches:
        for body in b.column("body").to_pylist():
            cell, n, kinds = np.frombuffer(body, "<i8").reshape(3, -1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((cell, cell + 65536))), pa.array(np.concatenate((n, kinds)))], ["cell", "n"])


def _sums(cells: DataFrame, size: int) -> np.ndarray:
    """At most `size` numbers, added up on the executors."""
    out = np.zeros(size, np.int64)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def score(docs: DataFrame, part_bytes: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    parts, n = scattered(docs, **({"part_bytes": part_bytes} if part_bytes else {}))
    pairs = _sums(only(docs, doc_id="long", text="string").mapInArrow(tidied(_byte_pairs), "cell long, n long"), 65537)
    root = roots(pairs[:65536].reshape(256, 256))
    answers = materialize(answer(send(parts, _send(n)), _answer(root)))
    begun, kinds = _sums(answers.filter(F.col("kind") == STATS).select("body").mapInArrow(_numbers, "cell long, n long"), 131072).reshape(2, -1)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return meet(parts, answers.filter(F.col("kind") != STATS), _score(n, int(pairs[65536]), begun, kinds), schema)


def op8_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
