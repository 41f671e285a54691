"""BPE encoding and decoding by prefix-sharing trie traversal.

The encodings of a string's prefixes are linked: the last token of a prefix, and the encoding of what stands before that
token, are the encoding of the prefix. So a trie over the distinct words needs one state a node, its last token, and
shared prefixes are encoded once. A token that ends at a node is the last one if the pair of it and the last token
before it stays apart under the merges; exactly one does. The trie is walked depth first over the sorted words, and only
the path from the root is held.

Words are what the pre-tokenizer makes of the white-space separated pieces of a text. Each task holds bounded caches of
finished words and of pieces; the texts are never shuffled. Null text is encoded as empty; an empty text has no tokens;
long texts are encoded whole. Every row gives a row, repeated or not; other columns may have any name. An empty table
gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from hostvigil.llm.common import KEPT, only, read_table, row_chunks, tidied

#: Entries in each of the two generations of a task's caches, beside those of one stretch of text: when the young one is
#: full it becomes the old one.
CACHE_PIECES, CACHE_WORDS = 20_000, 30_000
#: Pairs of tokens of which a worker remembers, from task to task, whether they stay apart.
CACHE_PAIRS = 200_000
#: Text encoded at a time, in characters: the more words stand in one trie, the more prefixes they share, and the more of
#: them are held at once, in each worker.
TRIE_CHARS = 1 << 19
#: Letters of Unicode versions after 16.0, which the library's pattern doesn't know as letters.
NEWER_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Lower-case letters of Unicode 16.0 and 17.0, which the library knows and Python may not know yet.
NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}
_NEWER_UPPER = re.compile("[" + "".join(map(chr, NEWER_LOWER)) + "]")
#: Signs that end many pieces; a run of them is one word.
_SIGNS = ".,;:!?'\"()[]{}<>*#$%&@/\\|+=~^`_-"
_NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = iter(range(256, 512))
    return [chr(b if b in plain else next(odd)) for b in range(256)]


class Merges:
    """Vocabulary and merges, and which pairs of tokens stay apart."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in self.ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): r for r, (a, b) in enumerate(pairs)}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: its rank, left part, right part
        for r, (a, b) in enumerate(pairs):
            self.made.setdefault(self.ids[a + b], (r, self.ids[a], self.ids[b]))
        self.apart: dict[int, bool] = {}
        # a token is of use only if its own text is encoded as itself
        self.usable = {s: t for s, t in self.ids.items() if t not in self.made or self.stay_apart(*self.made[t][1:], self.made[t][0])}
        # every stretch of symbols inside a usable token: the token that it is, or -1
        self.parts: dict[str, int] = {}
        for t in self.usable:
            body, end = (t[: -len(self.end)], self.end) if t.endswith(self.end) else (t, "")
            n = len(body)
            self.parts.update(dict.fromkeys((body[i:j] for i in range(n) for j in range(i + 1, n + 1)), -1))
            self.parts.update(dict.fromkeys((body[i:] + end for i in range(n)), -1))
        self.parts |= self.usable

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(piece, rank at which it is merged into the next) at one edge of a token, from the single symbol to the token."""
        out, until = [], _NEVER
        while True:
            out.append((token, until))
            if token not in self.made:
                return out[::-1]
            until, token = self.made[token][0], self.made[token][side]

    def stay_apart(self, left: int, right: int, below: int = _NEVER) -> bool:
        """No merge of a rank under `below` joins the two tokens across their border."""
        a, b = self._edge(left, 2), self._edge(right, 1)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            r = self.rank.get((x, y), _NEVER)
            if r < below and r < x_until and r <= y_until:  # of equal ranks the leftmost merges first
                return False
            if x_until == _NEVER and y_until == _NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1


def _pattern(text: str) -> regex.Pattern:
    """The file's pattern with the letters that the library knows."""
    newer = "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in NEWER_LETTERS)
    return regex.compile(text.replace(r"[\p{L}]+", rf"[\p{{L}}--[{newer}]]+").replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])+"), regex.V1)


class Kept:
    """A bounded cache of two generations."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Those of the keys that the young generation can't be given from the old one."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out


class TrieEncoder:
    """Encodes texts a batch at a time; `show` makes what is kept of a word from its ids, `glue` that of several words."""

    def __init__(self, path: str, show: Callable[[TrieEncoder, tuple[int, ...]], tuple] = lambda self, ids: ids, glue: Callable[[list], tuple] = lambda parts: sum(parts, ())):
        self.show, self.glue = show, glue
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        # the pattern of the file's pre-tokenizer; there it is also given as text
        self.pattern = _pattern(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.space = regex.compile(r"\s+")
        self.alphabet = "".join(byte_alphabet())
        self.number = [str(i) for i in range(1 + max(self.merges.text))]
        #: the pattern for ASCII text
        self.plain = re.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r" \t\n\r\x0b\x0c"))
        self.release()

    def normal(self, text: str) -> str:
        """The text as the file's normaliser leaves it, but for white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letters are lowered one by one: no final sigma
        return text.lower()

    def words(self, piece: str) -> list[str]:
        """Pre-tokens of a normalised piece, in the byte alphabet."""
        if not piece.isascii() and _NEWER_UPPER.search(piece):  # lowered here, where only new pieces come
            piece = piece.translate(NEWER_LOWER)
        core = piece.rstrip(_SIGNS)
        if core.isalpha():
            found = [core] if core == piece else [core, piece[len(core) :]]
        else:
            found = (self.plain if piece.isascii() else self.pattern).findall(piece)
        if piece.isascii() and piece.isprintable():
            return found
        return [w if w.isascii() and w.isprintable() else codecs.charmap_decode(w.encode("utf-8"), "strict", self.alphabet)[0] for w in found]

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Depth-first over the trie of the distinct words."""
        m, out = self.merges, {}
        part_of, apart, end, shift = m.parts.get, m.apart, m.end, len(m.text).bit_length()
        # for each prefix on the path from the root: its last token, where that begins, and where its longest part of a token begins
        lasts, starts, widest, path = [0], [0], [0], ""
        for word in sorted(words):
            size = len(word)
            depth = 0
            for x, y in zip(path, word):
                if x != y:
                    break
                depth += 1
            depth = min(depth, size - 1)
            del lasts[depth + 1 :], starts[depth + 1 :], widest[depth + 1 :]
            k = widest[depth]
            symbols = word
            for n in range(depth + 1, size + 1):
                if n == size:  # the last symbol of a word is one of its own
                    symbols += end
                    n += len(end)
                token = part_of(symbols[k:n])
                while token is None:  # without its last symbol a part is still a part, so it begins no earlier than that of the prefix before
                    k += 1
                    token = part_of(symbols[k:n])
                at = k
                while True:
                    if token >= 0:
                        if not at:
                            break
                        pair = lasts[at] << shift | token
                        ok = apart.get(pair)
                        if ok is None:
                            ok = apart[pair] = m.stay_apart(lasts[at], token)
                        if ok:
                            break
                    at += 1
                    token = part_of(symbols[at:n])
                lasts.append(token)
                starts.append(at)
                widest.append(k)
            path = word[:-1]
            n = size
            ids = []
            while n:
                ids.append(lasts[n])
                n = starts[n]
            ids.reverse()
            out[word] = tuple(ids)
            lasts.pop()
            starts.pop()
            widest.pop()
        return out

    def _fill(self, texts: list[list[str]]) -> dict[str, object]:
        """What is kept of every piece of the texts."""
        if len(self.merges.apart) > CACHE_PAIRS:
            self.merges.apart.clear()
        split = {p: self.words(p) for p in self.pieces.missing({p for t in texts for p in t}) if p not in self.special}
        new = self.known.missing({w for ws in split.values() for w in ws})
        pieces, known, show, glue = self.pieces.young, self.known.young, self.show, self.glue
        for w, ids in self.encode_words(new).items():
            known[w] = show(self, ids)
        for p, ws in split.items():
            pieces[p] = known[ws[0]] if len(ws) == 1 else glue([known[w] for w in ws])
        for s, i in self.special.items():
            pieces[s] = show(self, (i,))
        return pieces

    def _cut(self, text: str) -> list[str]:
        """Normalised white-space separated pieces and special tokens; str.split() also cuts at four controls that are no white space."""
        out: list[str] = []
        for part in self.split_special.split(text) if "<|" in text else [text]:
            if part in self.special:
                out.append(part)
                continue
            part = self.normal(part)
            if any(c in part for c in "\x1c\x1d\x1e\x1f"):
                out += [p for p in self.space.split(part) if p]
            else:
                out += part.split()
        return out

    def encode_batch(self, texts: list[str]) -> list[list]:
        """What is kept of each piece of each text: with the default `show`, its token ids."""
        cut = [self._cut(t) for t in texts]
        get = self._fill(cut).__getitem__
        return [list(map(get, c)) for c in cut]

    def release(self) -> None:
        """Drop what is kept of pieces: idle worker processes should not hold it."""
        self.pieces, self.known = Kept(CACHE_PIECES), Kept(CACHE_WORDS)

    def decode(self, ids: Iterable[int]) -> str:
        """The file has no decoder: token texts joined by a space."""
        return " ".join(map(self.merges.text.__getitem__, ids))


def counted(encoder: TrieEncoder, ids: tuple[int, ...]) -> tuple[int, str, str]:
    """Number of ids, the ids as text, and the decoded text."""
    return len(ids), " ".join(map(encoder.number.__getitem__, ids)), encoder.decode(ids)


def glued(parts: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    if len(parts) == 2:
        (n, ids, text), (m, more, rest) = parts
        return n + m, f"{ids} {more}", f"{text} {rest}"
    n, ids, decoded = zip(*parts) if parts else ((), (), ())
    return sum(n), " ".join(ids), " ".join(decoded)


_encoders: dict[tuple, TrieEncoder] = {}
KEPT["bpe"] = _encoders.clear


def encoder(path: str, *show: Callable) -> TrieEncoder:
    """One encoder for each worker process."""
    if (path, *show) not in _encoders:
        _encoders[path, *show] = TrieEncoder(path, *show)
    return _encoders[path, *show]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    path = path or default_tokenizer()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in row_chunks(batches, limit=TRIE_CHARS):
            got = enc.encode_batch([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([[i for p in t for i in p] for t in got], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return only(docs, doc_id="long", text="string").mapInArrow(tidied(run, "bpe"), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of doc_id and ids."""
    path = path or default_tokenizer()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([enc.decode(t or []) for t in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidied(run, "bpe"), "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: `encode` and `decode` in one pass over the texts."""
    path = path or default_tokenizer()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, counted, glued)
        for b in row_chunks(batches, limit=TRIE_CHARS):
            n, ids, decoded = [], [], []
            for pieces in enc.encode_batch([t or "" for t in b.column("text").to_pylist()]):
                size, codes, text = glued(pieces)
                n.append(size)
                ids.append(hashlib.sha256(codes.encode()).hexdigest())
                decoded.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        enc.release()

    return only(docs, doc_id="long", text="string").mapInArrow(tidied(run, "bpe"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
