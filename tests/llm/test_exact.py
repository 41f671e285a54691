"""Operators with exact contracts against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pyspark.sql import functions as F

from hostvigil.llm import bpe, common, exchange, graph, prefix_join, quality, sharding, simhash, suffix_dedup, suffix_tree_lm
from tests.llm.conftest import EDGE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.fixture(scope="session")
def table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(table):
    return [(r.doc_id, r.text, r.lang, r.source) for r in table.select("doc_id", "text", "lang", "source").collect()]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def order(i):
    return (i is not None, i or 0)


# --- simhash
def slow_fingerprint(text):
    w = WORD.findall((text or "").translate(LOW))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    n = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for i in range(64):
            n[i] += h >> i & 1
    return sum(1 << i for i in range(64) if s and 2 * n[i] > len(s))


def slow_components(ids, codes, radius=3):
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= radius:
                up[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash(table, rows):
    got = sorted((r.doc_id, r.code % 2**64, r.component_id) for r in simhash.near_duplicates(table).collect())
    ids, codes = [r[0] for r in rows], [slow_fingerprint(r[1]) for r in rows]
    assert got == sorted(zip(ids, codes, slow_components(ids, codes)))


def test_simhash_edges(make):
    got = sorted(((r.doc_id, r.code % 2**64, r.component_id) for r in simhash.near_duplicates(make(EDGE)).collect()), key=str)
    ids, codes = [r[0] for r in EDGE], [slow_fingerprint(r[1]) for r in EDGE]
    assert got == sorted(zip(ids, codes, slow_components(ids, codes)), key=str)
    assert simhash.near_duplicates(make([])).collect() == []


@pytest.mark.parametrize("radius", [1, 3, 6])
def test_index_links_what_brute_force_links(radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(4)]
    codes = set()
    for _ in range(300):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 2 * radius)):
            x ^= 1 << rng.randrange(64)
        codes.add(x)

    hi = np.array(sorted(codes), np.uint64)
    lo = np.zeros(len(hi), np.uint64)
    order = np.lexsort(simhash.gray_rank(hi, lo)[::-1])
    hi = hi[order]
    a, b = simhash.link_group(hi, lo, radius)
    near = np.bitwise_count(hi[a] ^ hi[b]) <= radius
    assert near.all()
    x, y = graph.stars(a, b)
    first = np.arange(len(hi))
    first[x] = y
    assert first.tolist() == slow_components(range(len(hi)), hi.tolist(), radius)


def test_gray_rank_of_wide_codes():
    rng = random.Random(1)
    codes = [rng.getrandbits(128) for _ in range(50)]

    def rank(x):
        for k in (1, 2, 4, 8, 16, 32, 64):
            x ^= x >> k
        return x

    hi, lo = np.array([x >> 64 for x in codes], np.uint64), np.array([x & 2**64 - 1 for x in codes], np.uint64)
    a, b = simhash.gray_rank(hi, lo)
    assert [int(x) << 64 | int(y) for x, y in zip(a, b)] == [rank(x) for x in codes]


@pytest.mark.parametrize("limit", [20_000, 40])
def test_likely_links_find_near_texts(spark, limit):
    """A tight cluster of several hundred codes and many unlike ones: one component, also if its groups are dealt to parts."""
    rng = random.Random(3)
    center = rng.getrandbits(128)
    codes = {center ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 9))) for _ in range(400)}
    far = {rng.getrandbits(128) for _ in range(400)}
    signed = lambda x: x - 2**64 if x >> 63 else x
    rows = [(k, signed(c >> 64), signed(c & 2**64 - 1)) for k, c in enumerate([*codes, *far])]
    found = graph.components(simhash.likely_links(spark.createDataFrame(rows, "node long, hi long, lo long"), 0.8, limit))
    label = {r["node"]: r["label"] for r in found.collect()}
    assert set(label) == set(range(len(codes))) and len(set(label.values())) == 1


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1400)] + [(5000 + k, 5001 + k) for k in range(300)] + [(9000 - k, 9000) for k in range(1, 200)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in edges:
        up[find(x)] = find(y)
    found = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert set(found) == {x for e in edges if e[0] != e[1] for x in e}
    groups = collections.defaultdict(set)
    for x, label in found.items():
        groups[find(x)].add(label)
    assert all(len(g) == 1 for g in groups.values()) and len({*map(min, groups.values())}) == len(groups)


def slow_likeness(a, b, size=5):
    grams = lambda t: {tuple(w[i : i + size]) for w in [WORD.findall((t or "").translate(LOW))] for i in range(max(1, len(w) - size + 1)) if w}
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_keep_one(make):
    rng = random.Random(2)
    base = [rng.choice("abcdefghij") + str(k) for k in range(300)]
    near = list(base)
    near[150] = "other"
    far = [w if k % 6 else w + "x" for k, w in enumerate(base)]
    docs = make([(4, " ".join(base)), (2, " ".join(near)), (2, " ".join(near)), (7, " ".join(far)), (9, "nine ten eleven twelve thirteen"), (None, None), (8, "")])
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 7, 8, 9]
    assert simhash.keep_one(make([])).count() == 0


def test_keep_one_leaves_no_pair_out(make):
    rng = random.Random(9)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(600)]
    short = [t[:49] for t in texts]  # 45 of 56 shingles: 0.8036
    apart = [t[:48] for t in texts[:50]]  # 44 of 56 are too few, 44 of 45 are not
    rows = [(3 * i, " ".join(t)) for i, t in enumerate(texts)] + [(3 * i + 1, " ".join(t)) for i, t in enumerate(short)]
    alone = [(10_000 + i, " ".join(rng.sample(t[:48], 48))) for i, t in enumerate(apart)]
    got = {r.doc_id for r in simhash.keep_one(make(rows + alone)).select("doc_id").collect()}
    assert got == {3 * i for i in range(600)} | {d for d, _ in alone}
    apart_rows = [(3 * i, " ".join(t)) for i, t in enumerate(texts[:50])] + [(3 * i + 1, " ".join(t)) for i, t in enumerate(apart)]
    assert simhash.keep_one(make(apart_rows)).count() == 100


def test_prefix_links_connect_what_is_similar_and_little_else(spark):
    rng = random.Random(4)
    line = [f"c{i}" for i in range(30)]  # a passage that all share
    texts = [(i, " ".join(line + [f"w{rng.randrange(10**6)}" for _ in range(30)])) for i in range(200)]
    texts += [(1000 + i, " ".join(texts[i][1].split()[:-11])) for i in range(100)]
    found = prefix_join.prefix_links(spark.createDataFrame(texts, "id long, text string"), lambda t: simhash.shingle_hashes(t, 5), 0.8)
    label = {}
    for a, b in ((r.a, r.b) for r in found.collect()):
        label.setdefault(b, {b}).add(a)
    assert sorted(sorted(x) for x in label.values()) == [[i, 1000 + i] for i in range(100)]


def test_keep_one_removes_only_near_copies(table, rows):
    left = {r.doc_id for r in simhash.keep_one(table).select("doc_id").collect()}
    texts = {d: t for d, t, *_ in rows}
    for d in texts.keys() - left:
        assert max(slow_likeness(texts[d], texts[k]) for k in left) >= 0.8
    seen = collections.Counter(texts[d] for d in left)
    assert max(seen.values()) == 1


def test_recall_of_near_pairs(spark):
    """Pairs of similarity 0.8 to 0.9 by brute force, each among texts that have nothing in common: at least 0.9 are found."""
    rng = random.Random(11)
    docs, pairs = {}, []
    for k in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 400))]
        copy = list(words)
        while True:
            at = rng.randrange(len(copy))
            before, copy[at] = copy[at], f"x{rng.randrange(10**6)}"
            if slow_likeness(" ".join(words), " ".join(copy)) < 0.8:
                copy[at] = before
                break
            if rng.random() < 0.1 and slow_likeness(" ".join(words), " ".join(copy)) < 0.9:
                break
        if 0.8 <= slow_likeness(" ".join(words), " ".join(copy)) < 0.9:
            pairs.append((2 * k, 2 * k + 1))
        docs[2 * k], docs[2 * k + 1] = " ".join(words), " ".join(copy)
    codes = [(d, *simhash.wide_fingerprint(t, 5)) for d, t in docs.items()]
    found = graph.components(simhash.likely_links(spark.createDataFrame(codes, "node long, hi long, lo long"), 0.8))
    label = {r["node"]: r["label"] for r in found.collect()}
    met = sum(a in label and label[a] == label.get(b) for a, b in pairs)
    assert len(pairs) > 200 and met >= 0.9 * len(pairs)


def slow_keep_one(found, texts, size=5):
    """doc_ids that stay in a plain run: in order of doc_id, less those like an earlier one of their component that stays."""
    grams = {d: {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for d, w in ((d, t.split()) for d, t in texts.items())}
    stays = collections.defaultdict(list)
    for d in sorted(grams):
        near = stays[found[d]]
        if all(len(grams[d] & grams[k]) < 0.8 * len(grams[d] | grams[k]) for k in near):
            near.append(d)
    return sorted(d for near in stays.values() for d in near), max(map(len, stays.values()))


@pytest.mark.parametrize("block", [1 << 20, 4000])
def test_keep_one_in_a_family_of_unlike_variants(make, block):
    """Hundreds of mutually unlike variants of a text, then copies of each variant with the last word changed."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for i in range(300):
        variant = list(base)
        for at in rng.sample(range(10, 110), 2):
            variant[at] = f"x{i}y{at}"
        texts[i] = " ".join(variant)
        texts[1000 + i] = " ".join([*variant[:-1], f"z{i}"])
    texts[5000], texts[5001] = "quite another text of few words", "quite another text of few words"
    docs = make(list(texts.items()))
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, 5, 8).collect()}
    want, most = slow_keep_one(found, texts)
    assert most > 100
    assert sorted(r.doc_id for r in simhash.keep_one(docs, block=block).collect()) == want


def test_alike_later():
    rng = random.Random(6)
    sets = [sorted(rng.sample(range(12), rng.randrange(9))) for _ in range(60)]
    ids, at = np.array([x for s in sets for x in s], np.int64), np.cumsum([0, *map(len, sets)])
    like = lambda a, b: len({*a} & {*b}) >= 0.6 * len({*a} | {*b})
    stays = []
    for i, s in enumerate(sets):
        if not any(like(s, sets[k]) for k in stays):
            stays.append(i)
    assert np.flatnonzero(~simhash.alike_later(ids, at, 0.6)).tolist() == stays
    got = simhash.alike_later(ids, at, 0.6, 5)
    assert got.tolist() == [False] * 5 + [any(like(s, sets[k]) for k in range(5)) for s in sets[5:]]


# --- sharding
def test_sharding(table, rows):
    got = by_id(sharding.assign(table, sharding.layout(16)))
    assert len(got) == len(rows)
    slots = collections.defaultdict(list)
    for d, text, *_ in rows:
        r, b = got[d], (text or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(b) + 1 if text is not None else 1, zlib.crc32(b), "key")
        assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_follows_weights_and_moves_only_what_changes(spark):
    ids = spark.range(20000).selectExpr("id AS doc_id", "'t' AS text")
    tree = sharding.layout(8)
    heavy = sharding.layout(8)
    heavy["region0"]["rack0"][0] = 3.0
    a, b = by_id(sharding.assign(ids, tree)), by_id(sharding.assign(ids, heavy))
    n = collections.Counter(r["shard"] for r in b.values())
    assert abs(n[0] / 20000 - 0.3) < 0.02
    moved = [(a[d]["shard"], b[d]["shard"]) for d in a if a[d]["shard"] != b[d]["shard"]]
    assert all(to < 8 and (to == 0 or to in (1, 2, 3) or frm >= 4) for frm, to in moved)


def test_sharding_edges(make):
    got = sharding.assign(make(EDGE), sharding.layout(16)).collect()
    assert len(got) == len(EDGE) and all(r["size"] == 1 and r["text_crc32"] == 0 for r in got if r["doc_id"] == 1)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(make([]), sharding.layout(16)).count() == 0


# --- BPE
@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def check_digests(got, docs, library):
    for d, text in docs:
        enc = library.encode(text or "", add_special_tokens=False)
        r = got[d]
        assert r["n_tokens"] == len(enc.ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, enc.ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(enc.ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe(table, rows, library):
    check_digests(by_id(bpe.digests(table)), [r[:2] for r in rows], library)


def test_bpe_edges(make, library):
    texts = [t for _, t in EDGE] + ["it's <|endoftext|>don't<|startoftext|>", "ΣΑΣ ΟΔΟΣ İ ſ ŉ", "x²½ a\x1cb\x1d é", "aaaaaaa abababab", "123 !!!###\u0085c", "<|end", "\u0000\u0001"]
    docs = list(enumerate(texts))
    check_digests(by_id(bpe.digests(make(docs))), docs, library)
    codes = bpe.encode(make(docs))
    back = by_id(bpe.decode(codes))
    assert all(back[r["doc_id"]]["text"] == library.decode(r["ids"], skip_special_tokens=False) for r in codes.collect())
    assert bpe.digests(make([])).count() == 0


def test_bpe_on_random_words(library):
    rng = random.Random(0)
    enc = bpe.encoder(bpe.default_tokenizer())
    texts = ["".join(rng.choice("abcdeinorst'.é1 ") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    assert [[i for p in t for i in p] for t in enc.encode_batch(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_holds_few_words():
    """A worker's memory is bounded where every word of a batch is new."""
    r = random.Random(6)
    texts = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(3000)) for _ in range(100)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    enc = bpe.TrieEncoder(bpe.default_tokenizer(), bpe.counted, bpe.glued)
    tracemalloc.start()
    try:
        for b in common.row_chunks([batch], limit=bpe.TRIE_CHARS):
            enc.encode_batch(b.column("text").to_pylist())
        assert tracemalloc.get_traced_memory()[1] < 128 << 20
    finally:
        tracemalloc.stop()


def test_bpe_on_every_code_point(library):
    enc = bpe.encoder(bpe.default_tokenizer())
    texts = [f"a{chr(c)}b1" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 7 == 0 or 0x32300 < c < 0x33500)]
    for s in range(0, len(texts), 20_000):
        part = texts[s : s + 20_000]
        assert [[i for p in t for i in p] for t in enc.encode_batch(part)] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


# --- substring dedup
def slow_dedup(docs, size=50):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w not in first or order(d) < order(first[w]):
                first[w] = d
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if order(first[b[i : i + size]]) < order(d):
                gone[i : i + size] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + (len(b) > 0 and gone[0]))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(table, rows):
    got = sorted((tuple(r) for r in suffix_dedup.dedup(table, part_bytes=64 << 10).collect()), key=str)
    assert got == slow_dedup([r[:2] for r in rows])


@pytest.mark.parametrize("letters", ["ab", "a", "abcdefgh é"])
def test_substring_dedup_on_repetitive_text(make, letters):
    rng = random.Random(len(letters))
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [word(rng.randint(40, 200)) for _ in range(4)]
    docs = [(rng.choice([k, k, 3, None]), rng.choice([None, "".join(rng.choice([rng.choice(passages), rng.choice(passages)[rng.randint(0, 60) :], word(20)]) for _ in range(4))] * 3)) for k in range(15)]
    got = sorted((tuple(r) for r in suffix_dedup.dedup(make(docs), part_bytes=500).collect()), key=str)
    assert got == slow_dedup(docs)


def test_substring_dedup_with_a_hot_id(make):
    """Ids with more text than a part: their rows go to several parts, and don't count against each other."""
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(120)) for _ in range(5)]
    docs = [(rng.choice([None, None, 5, 5, 5, k]), "".join(rng.choice(passages) + rng.choice("xyz") * rng.randint(0, 9) for _ in range(3))) for k in range(40)]
    got = sorted((tuple(r) for r in suffix_dedup.dedup(make(docs), part_bytes=900).collect()), key=str)
    assert got == slow_dedup(docs)


def test_parts_are_even_in_bytes(make):
    """Short rows and rows a thousand times as long in one table: no part has over twice its size."""
    docs = make([(k, "x" * 100) for k in range(20_000)] + [(20_000 + k, f"{k}" * 20 + "y" * 100_000) for k in range(100)])
    parts, n = exchange.parted(docs, part_bytes=1 << 20)
    size = {r["part"]: r["b"] for r in parts.groupBy("part").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    assert n >= 12 and max(size.values()) < 2 << 20
    assert exchange.parted(make([(k, None) for k in range(100)]), part_bytes=1 << 20)[0].select("part").distinct().count() > 1


def test_parts_make_no_rows(make, monkeypatch):
    """Bounds of parts come from a row an id, however many parts there are."""
    monkeypatch.setattr(F, "explode", None)
    docs = make([(k, "x" * (1 + k % 700)) for k in range(3000)] + [(None, "y")] * 5)
    parts, n = exchange.parted(docs, part_bytes=20_000)
    size = {r["part"]: r["b"] for r in parts.groupBy("part").agg(F.sum(F.octet_length("text") + exchange.ROW_BYTES).alias("b")).collect()}
    assert len(size) == n and max(size.values()) - min(size.values()) <= 2 * (700 + exchange.ROW_BYTES)


def test_repeats_shuffle_their_texts_once(spark, table, tmp_path):
    """All passes of the substring dedup read one exchange of the texts, with their other columns in it."""
    table.limit(300).write.parquet(f"{tmp_path}/docs")
    kept = suffix_dedup.remove_repeats(spark.read.parquet(f"{tmp_path}/docs"))
    kept.collect()
    plan = kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1


def test_substring_dedup_edges(make):
    docs = [(d, t) for d, t in EDGE if d != 7]
    assert sorted((tuple(r) for r in suffix_dedup.dedup(make(docs)).collect()), key=str) == slow_dedup(docs)
    assert suffix_dedup.dedup(make([])).count() == 0
    kept = suffix_dedup.remove_repeats(make([(1, "x" * 60 + "y"), (2, "z" + "x" * 60)]))
    assert kept.columns == make([]).columns and {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {1: ("x" * 60 + "y", 61), 2: ("z", 1)}


# --- language model
def test_language_model(table, rows):
    got = by_id(suffix_tree_lm.score(table, part_bytes=64 << 10))
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in rows}
    words = {d: WORD.findall((t or "").translate(LOW)) + ["\n"] for d, t, *_ in rows}
    c = collections.Counter(w for d in words if not held[d] for w in words[d])
    n, v = sum(c.values()), len(c)
    for d, ws in words.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) < 1e-6 * len(ws)


def test_language_model_beats_the_base_model(spark, sf_dir):
    """On unseen texts of a table that is large enough to learn words from (the base takes all unknown words as one)."""
    got = suffix_tree_lm.score(spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet"))
    out = got.filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def slow_scores(docs):
    """log10 probability of each text by a tree in plain dictionaries."""
    lm = suffix_tree_lm
    words = [WORD.findall((t or "").translate(LOW)) for _, t in docs]
    spell = [b"\n" * lm.DEPTH + b"".join(w.encode() + b" " for w in ws) + b"\n" for ws in words]
    train = [k for k, (d, _) in enumerate(docs) if zlib.crc32(b"" if d is None else str(d).encode()) % 10]
    nexts = collections.defaultdict(collections.Counter)
    for k in train:
        for i in range(lm.DEPTH, len(spell[k])):
            for depth in range(lm.DEPTH + 1):
                nexts[spell[k][i - depth : i]][spell[k][i]] += 1
    known = {}

    def p(context, byte):
        if (context, byte) not in known:
            n = nexts[context]
            total = sum(n.values())
            if not context:
                got = (n[byte] + 0.1) / (total + 25.6)
            else:
                got = p(context[1:], byte)
                if sum(c * math.log(c / total / p(context[1:], s)) for s, c in n.items() if c) >= lm.KEEP_NATS:
                    kinds = sum(c > 0 for c in n.values())
                    got = (n[byte] + kinds * got) / (total + kinds)
            known[context, byte] = got
        return known[context, byte]

    counts = collections.Counter(w for k in train for w in [*words[k], "\n"])
    out = []
    for ws, text in zip(words, spell):
        at, score = lm.DEPTH, 0.0
        for w in [*(w.encode() + b" " for w in ws), b"\n"]:
            steps = [p(text[i - lm.DEPTH : i], text[i]) for i in range(at, at + len(w))]
            at += len(w)
            like = [x for x in counts if x != "\n" and (x.encode() + b" ")[:2] == w[:2]]
            total = sum(counts[x] for x in like)
            share = total / (total + len(like)) if total else 0.0
            score += math.log10(math.prod(steps[:2]))
            if w != b"\n":
                score += math.log10((share * counts[w.decode()[:-1]] / total if total else 0.0) + (1 - share) * math.prod(steps[2:]))
        out.append(score)
    return out


@pytest.mark.parametrize("part_bytes", [1 << 20, 3000])
def test_language_model_equals_brute_force(make, part_bytes):
    rng = random.Random(1)
    vocabulary = ["the", "cat", "sat", "Été", "naïve", "on", "a", "mat", "thé", "x" * 30]
    docs = [(rng.choice([k, k, k, None]), rng.choice([None, "", *[" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(8)]])) for k in range(60)]
    docs += [(1, "tie one tie"), (1, "tie one tie"), (2, "one tie one")]
    got = sorted((str(r.doc_id), r.n_tokens, round(r.score, 3)) for r in suffix_tree_lm.score(make(docs), part_bytes=part_bytes).collect())
    want = sorted((str(d), len((t or "").split()) + 1, round(s, 3)) for (d, t), s in zip(docs, slow_scores(docs)))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(x[2] - y[2]) < 2e-3 for x, y in zip(got, want))


def test_language_model_does_not_depend_on_partitions(spark, make):
    docs = [(k, " ".join(f"w{(k * 7 + i) % 13}" for i in range(20))) for k in range(20)]
    scores = []
    for n in (1, 8, 211):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        scores.append({r.doc_id: r.score for r in suffix_tree_lm.score(make(docs)).collect()})
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert scores[0] == scores[1] == scores[2]


def test_language_model_edges(make):
    got = suffix_tree_lm.score(make(EDGE)).collect()
    assert len(got) == len(EDGE) and all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert suffix_tree_lm.score(make([])).count() == 0


# --- quality
def slow_stats(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality(table, rows):
    got = by_id(quality.judge(table))
    for d, t, *_ in rows:
        r, want = got[d], slow_stats(t)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        base = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == base and not (base and r["kept"])


def test_quality_keeps_good_documents(spark, sf_dir, table):
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    got = by_id(quality.judge(table))
    passed = [d for d in good if d in got and not got[d]["base_failed"]]
    assert sum(got[d]["kept"] for d in passed) >= 0.97 * len(passed)
    assert quality.keep_good(table).count() == sum(r["kept"] for r in got.values())


def test_quality_edges(make):
    rows = [(*r, None, "s") if k % 2 else (*r, "en", None) for k, r in enumerate(EDGE)]
    docs = make(rows)
    assert quality.judge(docs).count() == len(EDGE) and quality.keep_good(docs).columns == docs.columns
    assert quality.judge(make([])).count() == 0


def test_sketch_quantiles_are_within_their_error(spark):
    rng = np.random.default_rng(0)
    text = [(k, " ".join("x" * int(n) for n in rng.integers(1, 12, 50)), "en", "s") for k in range(400)]
    docs = spark.createDataFrame(text, "doc_id long, text string, lang string, source string")
    stats = quality.document_stats(docs).toPandas()
    x = np.sort(stats["word_chars"] / stats["n_words"])
    fence = quality.thresholds(quality.sketches(quality.document_stats(docs))).first()["word_len_max"]
    q25, q75 = x[100], x[300]
    assert abs(fence - (q75 + 3 * max(1.0, q75 - q25))) < 0.05 * fence


# --- names that the stages use inside
@pytest.mark.parametrize("stage", [quality.keep_good, simhash.keep_one, suffix_dedup.remove_repeats])
def test_stages_keep_columns_of_any_name(make, stage):
    names = ["hash", "node", "code", "label", "stats", "group_lang", "limit", "doc", "text_hash", "_doc", "n", "part", "grams", "word_len_max", "_keep_text", "lang_", "edits", "a.b", "key", "salt"]
    docs = make([(k, " ".join(f"w{k}x{i % 90}" for i in range(60))) for k in range(12)] + [(12, None), (12, None), (None, "short")]).drop("stats", "part", "key", "label")
    docs = docs.withColumns({c: F.lit(k) for k, c in enumerate(names)})
    got = stage(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert {r["doc_id"] for r in rows} >= set(range(12))
    assert all([r[c] for c in names] == list(range(len(names))) for r in rows)


def test_phrases_need_no_hashes_of_all_strings(table, rows):
    import pyarrow as pa

    docs = pa.table({"part": pa.array([0] * len(rows), pa.int64()), "doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    bare, full = suffix_dedup.Parse(docs, strings=False), suffix_dedup.Parse(docs)
    assert bare.hash is None and len(full.hash) == full.begin[-1]
    assert all(np.array_equal(getattr(bare, c), getattr(full, c)) for c in ("first", "last", "trigger", "phrase", "doc"))


def test_a_task_of_another_operator_drops_the_encoder():
    bpe.encoder(bpe.default_tokenizer())
    list(common.tidied(lambda batches: (yield from batches), "bpe")([1]))
    assert bpe._encoders
    list(common.tidied(lambda batches: (yield from batches))([1]))
    assert not bpe._encoders
