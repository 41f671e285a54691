"""Prefix trie, embedding near-duplicates and importance resampling against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from hostvigil.llm import embedding_dedup, prefix_trie, resampling

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---- prefix trie ------------------------------------------------------------------------------------------------------
def trie_rows(turns):
    """Rows of the trie of (conv_id, turn, role, text), with dictionaries of whole prefixes."""
    own: dict[int, list] = {}
    for c, t, r, x in turns:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).digest(), x or ""))
    own = {c: [(v[2], v[4]) for v in sorted(rows)] for c, rows in own.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + mine[h:])
    members, below = {}, {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for p in members:
        if p:
            below.setdefault(p[:-1], []).append(p)
    sums, out = {}, []
    for p in sorted(members, key=len, reverse=True):
        kids = below.get(p, [])
        saved = (len(members[p]) - 1) * len(WORDS.findall(p[-1][1])) if p else 0
        sums[p] = (sum(sums[k][0] for k in kids) or 1, saved + sum(sums[k][1] for k in kids))
        ends = ",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found_trie(spark, turns, extra=False):
    rows = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, pos int, dig string")
    turns = prefix_trie.materialize(prefix_trie.numbered(rows))
    out = prefix_trie.trie(*prefix_trie.rebuilt(turns)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_trie_of_the_given_table(spark, sf_dir):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = prefix_trie.op11_prefix_trie(spark, sf_dir).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == trie_rows(turns)


@pytest.mark.parametrize("seed", [0, 1])
def test_trie_of_conversations_that_share_prefixes(spark, seed):
    """Two texts, lengths of 0 to 33: forks at every depth, many equal conversations and ties."""
    rng = np.random.default_rng(seed)
    turns = []
    for c in rng.choice(200, 60, replace=False).tolist():
        same = rng.random() < 0.3
        for t in range(int(rng.integers(1, 34))):
            turns.append((c, t if not same else t % 5, "user", "a b" if same or rng.random() < 0.85 else " c\td "))
    assert found_trie(spark, turns) == trie_rows(turns)


def test_trie_edges(spark):
    long = "word " * 50_000
    turns = [(None, 1, "user", "x"), (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 3, "user", long), (2, 1, None, "é \U0001f600"), (40, 1, "a", "bc"), (60, 1, "ab", "c"), (-3, 1, "a", "bc"), (-3, 2, "a", long)]
    turns += [(c, t, "user", "same text") for c in range(100, 130) for t in (1, 1, 2)]
    assert found_trie(spark, turns) == trie_rows(turns)
    assert found_trie(spark, []) == []
    assert found_trie(spark, [(None, 1, "user", "x")]) == []
    # crc32("1") % 4 is 3: a single turn is cut off, nothing but the root stays
    assert found_trie(spark, [(21, 0, "user", "x")]) == trie_rows([(21, 0, "user", "x")])


def test_a_conversation_over_many_ranges(spark):
    """All rows are of one conversation: order and blocks may not depend on one task."""
    turns = [(0, t, "user", f"t{t % 7}") for t in range(3000)] + [(20, t, "user", f"t{t % 7}") for t in range(1500)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = found_trie(spark, turns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 3001
    assert got == trie_rows(turns)


# ---- embeddings -------------------------------------------------------------------------------------------------------
def found_links(spark, rows, kind="float"):
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], f"vec_id long, embedding array<{kind}>, label int, cid int")
    return sorted(map(tuple, embedding_dedup.dedup(table).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def all_links(rows):
    good = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in good:
        for j in good:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if (a / np.abs(a).max() * (b / np.abs(b).max())).sum() / np.sqrt(((a / np.abs(a).max()) ** 2).sum() * ((b / np.abs(b).max()) ** 2).sum()) >= 0.95:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i, (c, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((c, len(links[i]), least, c is not None and c == least))
    return sorted(out, key=str)


def family(rng, n, length, noise, start):
    center = rng.normal(size=length)
    return [(start + k, (center + noise * rng.normal(size=length)).astype(np.float32).tolist()) for k in range(n)]


@pytest.mark.parametrize("block", [1024, 16])
def test_links_of_families(spark, monkeypatch, block):
    """Families of copies and near copies among unlike vectors; small blocks split every cell of a family."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = family(rng, 60, 32, 0.1, 0) + family(rng, 40, 32, 0.15, 1000) + [(2000 + k, rng.normal(size=32).astype(np.float32).tolist()) for k in range(150)]
    rows += [(3000 + k, rows[5][1]) for k in range(50)] + [(4000, [2 * x for x in rows[70][1]])]
    got, want = found_links(spark, rows), all_links(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    near = [r for r in want if r[1] > 20]
    assert len(near) > 90 and [r for r in got if r[1] > 20] == near


@pytest.mark.parametrize("length", [3, 8, 64, 300])
def test_recall_at_the_threshold(spark, length):
    """Pairs right above 0.95, each apart from all others (but in few dimensions): at least nine tenths are found."""
    rng = np.random.default_rng(length)
    rows = []
    for k in range(150):
        a, b = rng.normal(size=(2, length))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.9502
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    got, want = found_links(spark, rows, "double"), all_links(rows)
    n = sum(r[1] for r in want)
    assert n >= 300 and all(g[1] <= w[1] for g, w in zip(sorted(got), sorted(want)))
    assert sum(r[1] for r in got) >= 0.95 * n


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (None, [2.0, 2.0]), (9, [1.0, 1.0, 1.0]), (10, [1e300, 1e300]), (11, [1e-300, 1e-300]), (None, None), (12, [-0.0, 1.0]), (13, [0.0, 1.0])]
    assert found_links(spark, rows, "double") == all_links(rows)
    assert found_links(spark, []) == []


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(200, 8)) * 2
    near = embedding_dedup.nearest(y)
    around = near[:, None] + np.concatenate([embedding_dedup.neighbours(), np.zeros((1, 8))])
    assert np.allclose(((y - near) ** 2).sum(1), ((y[:, None] - around) ** 2).sum(2).min(1))
    assert np.allclose((near.sum(1) % 2), 0) and (((2 * near) % 2).std(1) == 0).all()
    v = embedding_dedup.neighbours()
    assert len(np.unique(v, axis=0)) == 240 and np.allclose((v**2).sum(1), 2)


# ---- importance resampling --------------------------------------------------------------------------------------------
def drawn(docs, target, percent=10, min_words=20, ngrams=1, buckets=10_000):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for table, texts in ((s, [d[1] for d in docs]), (t, target)):
        for x in texts:
            for f in runs(split(x)):
                table[of(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, (c, x) in enumerate(docs):
        f = runs(split(x))
        weight = sum(gain[of(g)] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if c is None else c}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((c, len(f), weight, score, len(split(x)) >= min_words))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    n = len(able) * percent // 100
    ranks = [(*r[:4], k + 1) for k, r in enumerate(able[:n])]
    rest = [(*r[:4], None) for r in able[n:]] + [(*r[:4], None) for r in rows if not r[4]]
    return sorted(ranks + rest, key=str)


def found_draw(spark, docs, target, **more):
    table = spark.createDataFrame([(*d, 1, 2, "k") for d in docs], "doc_id long, text string, score int, rank int, bucket string")
    items = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    out = resampling.resample(table, items, **more)
    return sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("ngrams", [1, 3])
def test_draw(spark, ngrams):
    rng = np.random.default_rng(ngrams)
    words = [f"w{k}" for k in range(300)] + ["É", "漢字", "A1b", "x-y"]
    docs = [(int(c), " ".join(rng.choice(words, int(rng.integers(0, 60))))) for c in rng.permutation(400)]
    target = [" ".join(rng.choice(words[:30], 25)) for _ in range(20)]
    assert found_draw(spark, docs, target, ngrams=ngrams, percent=25) == drawn(docs, target, ngrams=ngrams, percent=25)


def test_draw_edges(spark):
    many = "one two three " * 10
    docs = [(None, many), (None, many), (1, None), (2, ""), (3, "A" * 3 + ". " + many), (4, "long " * 100_000), (5, "x\x00y\x7fz " * 9)]
    docs += [(7, many)] * 30 + [(k, many) for k in (-(1 << 62), 1 << 62)]  # equal rows across the cutoff
    for percent in (0, 10, 50, 100):
        assert found_draw(spark, docs, ["one one", None, ""], percent=percent) == drawn(docs, ["one one", None, ""], percent=percent)
    assert found_draw(spark, docs, []) == drawn(docs, [])
    assert found_draw(spark, [], ["a"]) == []


def test_draw_with_documents(spark):
    docs = [(k, "word " * (15 + k)) for k in range(50)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    out = resampling.resample(table, table.select("text"), percent=40, carry=True).filter("rank IS NOT NULL")
    assert all(r["document"]["doc_id"] == r["doc_id"] and r["document"]["text"] == docs[r["doc_id"]][1] for r in out.collect())


def test_kth_value_of_any_long(spark):
    values = [-(1 << 63), -5, -5, -5, 0, 3, 3, (1 << 63) - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for k in range(1, 9):
        v = sorted(values)[k - 1]
        assert resampling.nth(rows, "v", k) == (v, sum(x < v for x in values), values.count(v))
