"""The corpus pipeline: each stage takes effect, equals a plain run, and clean documents stay."""

from __future__ import annotations

import collections
import hashlib
import math
import random

import numpy as np
import pytest

import corpus_pipeline
from hostvigil.llm import decontaminate, quality
from hostvigil.llm.common import materialize
from tests.llm.test_exact import LOW, WORD, order, slow_stats


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        assert docs.columns == columns, name
        counts.append(docs.count())
        assert docs.select("doc_id").distinct().count() == counts[-1]
    assert counts[0] > counts[1] > counts[2] == counts[3] >= counts[4] > 0.5 * counts[0]
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[-1]


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


# --- a plain run
def plain_quality(rows):
    """Rows that pass, by sketches in dictionaries."""
    values = []
    for r in rows:
        n, chars, symbols, dup, repeat = slow_stats(r["text"])
        lines = sum(bool(WORD.search(x)) for x in (r["text"] or "").split("\n"))
        share = lambda a, b: a / b if b else 0.0
        values.append((n < 10 or 100 * repeat > 20 * n, {"word_len": share(chars, n), "symbol_share": share(symbols, chars), "dup_line_share": share(dup, lines), "repeat_share": share(repeat, n)}))
    groups = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
    for r, (_, m) in zip(rows, values):
        for key in ((r["lang"], r["source"]), (r["lang"],), ()):
            for name, x in m.items():
                groups[key][name][0 if x < quality.LEAST else math.ceil(math.log(x / quality.LEAST) / math.log(quality.GAMMA)) + 1] += 1

    def quantile(sketch, q):
        seen, total = 0, sum(sketch.values())
        for b in sorted(sketch):
            seen += sketch[b]
            if seen >= q * total:
                return 0.0 if b == 0 else quality.LEAST * quality.GAMMA ** (b - 1) * 2 / (1 + quality.GAMMA)

    def fence(r, name):
        for key in ((r["lang"], r["source"]), (r["lang"],), ()):
            sketch = groups[key][name]
            if not key or sum(sketch.values()) >= quality.MIN_ROWS:
                a, b = quantile(sketch, 0.25), quantile(sketch, 0.75)
                return b + quality.FENCE * max(b - a, quality.SPREAD[name])

    return [r for r, (base, m) in zip(rows, values) if not base and all(x <= fence(r, k) for k, x in m.items())]


def plain_near_dedup(rows):
    """In order of doc_id, what is not 0.8 or more alike to an earlier row that stays."""
    def grams(t):
        w = WORD.findall((t or "").translate(LOW))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    stays = []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        g = grams(r["text"])
        if all(len(g & h) < 0.8 * len(g | h) if g | h else False for h, _ in stays):
            stays.append((g, r))
    return [r for _, r in stays]


def plain_repeats(rows, size=50):
    first = {}
    for r in rows:
        b = (r["text"] or "").encode()
        for i in range(len(b) - size + 1):
            if b[i : i + size] not in first or order(r["doc_id"]) < order(first[b[i : i + size]]):
                first[b[i : i + size]] = r["doc_id"]
    out = []
    for r in rows:
        b = (r["text"] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if order(first[b[i : i + size]]) < order(r["doc_id"]):
                gone[i : i + size] = True
        out.append(r | {"text": np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")})
    return out


def plain_decontamination(rows, benchmark):
    """Rows in which no segment occurs, by dynamic programming wherever one of nine pieces of the segment stands."""
    segments = {t for x in benchmark for _, t in decontaminate.segments(x)}

    def edits(pattern, text):
        place = np.arange(len(text) + 1)
        row, letters = np.zeros(len(text) + 1, np.int64), np.frombuffer(text.encode("utf-32-le"), np.uint32)
        for c in pattern:
            new = row + 1
            new[1:] = np.minimum(new[1:], row[:-1] + (letters != ord(c)))
            row = np.minimum.accumulate(new - place) + place
        return row.min()

    def found(text):
        for s in segments:
            most = decontaminate.edits_allowed(len(s))
            pieces = [s[k * len(s) // (most + 1) : (k + 1) * len(s) // (most + 1)] for k in range(most + 1)]
            if any(p in text for p in pieces) and edits(s, text) <= most:
                return True
        return False

    return [r for r in rows if not found(decontaminate.normal(r["text"]))]


@pytest.fixture(scope="module")
def planted(spark, sf_dir):
    """The given documents, families of copies with few and with many changes, shared passages and benchmark passages."""
    rng = random.Random(7)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    words = lambda n: [f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bdfgklmnprst')}{rng.randrange(100)}" for _ in range(n)]
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    passage = " ".join(words(60))
    made = []
    for _ in range(6):
        base = words(150)
        for changes in (0, 1, 1, 2, 60, 75):
            copy = list(base)
            for at in rng.sample(range(150), changes):
                copy[at] = words(1)[0]
            made.append(" ".join(copy))
    made += [" ".join([*words(80), passage, *words(20)]) for _ in range(4)]
    made += [" ".join([*words(60), next(b for b in bench if len(b) > 150)[:150], *words(40)]) for _ in range(3)]
    rows += [rows[0] | {"doc_id": 10**6 + k, "text": t, "lang": "en", "source": "planted", "n_chars": len(t)} for k, t in enumerate(made)]
    return spark.createDataFrame(rows, docs.schema), rows, bench


def test_every_stage_equals_a_plain_run(spark, sf_dir, planted):
    from tokenizers import Tokenizer

    from hostvigil.llm import bpe

    docs, rows, bench = planted
    want = [plain_quality(rows)]
    want.append(plain_near_dedup(want[-1]))
    want.append(plain_repeats(want[-1]))
    want.append(plain_decontamination(want[-1], bench))
    assert len(rows) > len(want[0]) > len(want[1]) > len(want[3]) > 100
    for (name, stage), plain in zip(corpus_pipeline.STAGES, want):
        docs = materialize(stage(spark, docs, sf_dir))
        got = {r.doc_id: r.text for r in docs.collect()}
        assert got == {r["doc_id"]: r["text"] for r in plain}, name
    library = Tokenizer.from_file(bpe.default_tokenizer())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()}
    for r in want[-1]:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


@pytest.mark.parametrize("k", range(5))
def test_stages_on_nulls_empties_ties_repeats_long_texts_and_odd_names(spark, sf_dir, k):
    from tests.llm.conftest import EDGE

    rows = [(*r, "en", None) for r in EDGE] + [(3, EDGE[0][1], "en", "s"), (None, "x y z", None, "s"), (4, "a b c d e f g h i j", "en", "s")]
    docs = spark.createDataFrame([(*r, 0, "h", "n") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, hash string, `no.de` string")
    out = corpus_pipeline.STAGES[k][1](spark, docs, sf_dir)
    got = out.collect()
    if k < 4:
        assert out.columns == docs.columns and len(got) <= len(rows)
    if k == 1:  # of equal texts the first of the smallest id stays
        assert sorted(str(r.doc_id) for r in got if r.text == EDGE[0][1]) == ["3"] and sum(not (r.text or "").strip() for r in got) == 1
    if k in (2, 4):
        assert len(got) == len(rows)
