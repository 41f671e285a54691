"""Edit-aware token counts.

`save_trees` cuts every document into pre-tokens once and keeps, with its text, the characters and tokens of each block
of pre-tokens. `recount` reads these tables back: a segment tree over a document's blocks holds the sums, an edit
(start, end, replacement, in characters of the text as it was) descends to its block, and only the blocks that it
touches are cut and encoded anew, with one or two pre-tokens before the edit as boundary context and up to the first old
boundary behind it that the new cut meets again; then the sums on the way to the root are updated. Documents without
edits cost nothing. Counts equal those of encoding the whole edited text.

Pre-tokens are those of byte-level BPE vocabularies (a pattern that reads at most one character ahead), so a boundary
that has the same text behind it is the start of the same pre-tokens. Blocks that outgrow twice BLOCK pre-tokens are
split; a touched block holds its own text, so an edit never copies the document.

Null text counts as empty; long texts are cut whole; repeated rows count each by themselves; extra columns may have any
name. Edits are applied from the first to the last; of edits that overlap, the one that starts first (then the longest)
is applied and the others are left out. Edits beyond the text's end are cut to it. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvigil.llm.common import materialize, only, read_table, row_chunks, text_batches

BLOCK = 64
CACHE_PIECES = 300_000
#: Personal data and secrets that a cleaning pass replaces: the edits of the registered query.
_MAIL = re.compile(r"[\w.+-]{1,64}@[\w-]+\.[\w.-]*\w")
_NUMBERS = re.compile(r"\+?\d[\d .()-]{6,}\d|[0-9a-f]{32,}")
REDACTED = "[removed]"


class Counter:
    """Tokens of pre-tokens, by a byte-level BPE vocabulary of ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def all(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece."""
        known = self.known
        new = [p for p in set(pieces) if p not in known]
        if len(known) + len(new) > CACHE_PIECES:
            known.clear()
            new = set(pieces)
        for p in new:
            known[p] = len(self.encoding.encode_ordinary(p))
        return list(map(known.__getitem__, pieces))

    def __call__(self, piece: str) -> int:
        return self.all([piece])[0]


_counters: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, pattern)
    return _counters[path, pattern]


class TokenTree:
    """Segment tree over blocks of pre-tokens: `sums` are (characters, tokens) of each block of the text."""

    def __init__(self, text: str, count: Counter, sums: list[tuple[int, int]] | None = None):
        self.base, self.count, self.encoded = text, count, 0
        if sums is None:
            pieces = count.pattern.findall(text)
            self.encoded, sums = len(pieces), self._sums(pieces)
        self.sums = [tuple(x) for x in sums] or [(0, 0)]
        at = 0
        self.spans: list[tuple[int, int] | str] = []  # of each block: where it stands in `base`, or its own text
        for c, _ in self.sums:
            self.spans.append((at, at + c))
            at += c
        self._plant()

    def _sums(self, pieces: list[str]) -> list[tuple[int, int]]:
        chars, tokens = list(map(len, pieces)), self.count.all(pieces)
        return [(sum(chars[k : k + BLOCK]), sum(tokens[k : k + BLOCK])) for k in range(0, len(pieces), BLOCK)]

    def _plant(self) -> None:
        self.size = 1 << (len(self.sums) - 1).bit_length()
        pad = [0] * (self.size - len(self.sums))
        self.chars, self.tokens = ([0] * self.size + [x[i] for x in self.sums] + pad for i in (0, 1))
        for node in range(self.size - 1, 0, -1):
            self._join(node)

    def _join(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(map(self.block, range(len(self.spans))))

    def block(self, k: int) -> str:
        span = self.spans[k]
        return span if isinstance(span, str) else self.base[span[0] : span[1]]

    def cut(self, first: int, last: int, start: int = 0) -> list[tuple[int, int]]:
        """Pre-tokens of blocks first to last from `start` on, as places in their text; the next character is read ahead."""
        text = "".join(map(self.block, range(first, last + 1)))
        size = len(text)
        for k in range(last + 1, len(self.spans)):
            if self.sums[k][0]:
                text += self.block(k)[0]
                break
        return [m.span() for m in self.count.pattern.finditer(text, start) if m.start() < size]

    def find(self, at: int) -> tuple[int, int]:
        """Block that holds character `at` (the last block beyond the end), and where the block starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return min(node - self.size, len(self.sums) - 1), start

    def replace(self, start: int, end: int, new: str) -> None:
        """Put `new` in the place of characters start to end - 1."""
        first, at = self.find(max(0, start - 1))
        before = [e for b, e in self.cut(first, first) if at + b < start]
        while first and len(before) < 3:  # context stands in the block before
            first -= 1
            at -= self.sums[first][0]
            before = [e for b, e in self.cut(first, first) if at + b < start]
        begin = before[-3] if len(before) > 2 else 0  # where the new cut begins, in the region
        last = max(first, self.find(max(0, end - 1))[0])
        shift = len(new) - (end - start)
        meet = None
        while meet is None:
            last = min(last + 1, len(self.sums) - 1)  # one block more than the edit touches, to read ahead in
            whole = last == len(self.sums) - 1
            spans = self.cut(first, last)
            old = "".join(map(self.block, range(first, last + 1)))
            safe = len(old) if whole else len(old) - self.sums[last][0]
            edges = {e for _, e in spans if end - at <= e <= safe} | ({0} if end == at else set())
            region = old[: start - at] + new + old[end - at :]
            made, place = [], begin
            for m in self.count.pattern.finditer(region, begin):
                if place >= start - at + len(new) and place - shift in edges:
                    break
                made.append(m[0])
                place = m.end()
            if place >= start - at + len(new) and place - shift in edges:
                meet = place - shift
            elif whole:
                meet = len(old)
        pieces = [*(old[b:e] for b, e in spans if e <= begin), *made, *(old[b:e] for b, e in spans if b >= meet)]
        self.encoded += len(pieces)
        size = 2 * BLOCK if len(pieces) <= 2 * BLOCK * (last + 1 - first) else BLOCK
        some = max(1, -(-len(pieces) // size), min(last + 1 - first, len(pieces)))
        groups = [pieces[k * len(pieces) // some : (k + 1) * len(pieces) // some] for k in range(some)]
        sums = [(sum(map(len, g)), sum(self.count.all(g))) for g in groups]
        same = len(groups) == last + 1 - first
        self.spans[first : last + 1] = ["".join(g) for g in groups]
        self.sums[first : last + 1] = sums
        if not same:
            self._plant()
            return
        nodes = set()
        for k, (c, t) in enumerate(sums, first):
            self.chars[self.size + k], self.tokens[self.size + k] = c, t
            nodes.add((self.size + k) >> 1)
        while nodes and nodes != {0}:
            for node in nodes:
                self._join(node)
            nodes = {n >> 1 for n in nodes if n > 1}


def apply_edits(tree: TokenTree, edits: list[tuple[int, int, str]]) -> int:
    """Apply edits given in places of the original text; how many were applied."""
    size, done, shift, applied = tree.n_chars, 0, 0, 0
    for start, end, new in sorted(edits, key=lambda e: (e[0], -e[1])):
        start, end = min(max(0, start), size), min(max(start, end, 0), size)
        if start < done:
            continue
        tree.replace(start + shift, end + shift, new)
        shift += len(new) - (end - start)
        done = max(end, start)
        applied += 1
    return applied


def redactions(text: str) -> list[tuple[int, int, str]]:
    found = [m.span() for m in _NUMBERS.finditer(text)]
    if "@" in text:
        found += [m.span() for m in _MAIL.finditer(text)]
    return [(a, b, REDACTED) for a, b in found]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def save_trees(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, text, n_chars, n_tokens, n_pretokens and the block sums of every row: what later edits start from."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for b in row_chunks(batches):
            trees = [TokenTree(t or "", count) for t in b.column("text").to_pylist()]
            numbers = [pa.array([f(t) for t in trees], pa.int64()) for f in (lambda t: t.n_chars, lambda t: t.n_tokens, lambda t: t.encoded)]
            sums = [pa.array([[x[i] for x in t.sums] for t in trees], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), *numbers, *sums], ["doc_id", "text", "n_chars", "n_tokens", "n_pretokens", "block_chars", "block_tokens"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, text string, n_chars long, n_tokens long, n_pretokens long, block_chars array<int>, block_tokens array<int>")


def recount(saved: DataFrame, edits_of: Callable[[str], list[tuple[int, int, str]]] | None = None, edits: str | None = None, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_chars, n_tokens, n_edits, n_chars_edited, n_tokens_edited, n_pretokens and n_reencoded of every saved row.

    `edits` names a column of edits (array of struct<start, end, text>), as an edit log joined by doc_id gives; else
    `edits_of` finds the edits in a text.
    """
    path, pattern = vocabulary or default_vocabulary()
    log = {"log": F.col(f"`{edits}`").cast("array<struct<start:bigint,end:bigint,text:string>>").alias("log")} if edits else {}
    rows = text_batches(saved).select("doc_id", "text", "n_chars", "n_tokens", "n_pretokens", "block_chars", "block_tokens", *log.values())
    names = ["doc_id", "n_chars", "n_tokens", "n_edits", "n_chars_edited", "n_tokens_edited", "n_pretokens", "n_reencoded"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for b in row_chunks(batches):
            out = []
            logs = b.column("log").to_pylist() if edits else [None] * len(b)
            columns = [b.column(c).to_pylist() for c in ("doc_id", "text", "n_chars", "n_tokens", "n_pretokens")]
            for k, (i, text, chars, tokens, pieces) in enumerate(zip(*columns, strict=True)):
                found = [(e["start"], e["end"], e["text"] or "") for e in logs[k] or []] if edits else edits_of(text or "")
                if not found:
                    out.append((i, chars, tokens, 0, chars, tokens, pieces, 0))
                    continue
                tree = TokenTree(text or "", count, list(zip(b.column("block_chars")[k].as_py(), b.column("block_tokens")[k].as_py(), strict=True)))
                n = apply_edits(tree, found)
                out.append((i, chars, tokens, n, tree.n_chars, tree.n_tokens, pieces, tree.encoded))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * len(names))], names)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after personal data and secrets are redacted: trees are saved once, the redactions applied to them."""
    return recount(materialize(save_trees(read_table(spark, sf_dir, "documents"))), redactions)
