"""Operators checked by planted cases, held-out accuracy or an exact second way."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest

from hostvigil.llm import decontaminate, html_text, token_counts, toxicity
from tests.llm.conftest import EDGE


def mutate(rng, text, n):
    t = list(text)
    for _ in range(n):
        p = rng.randrange(len(t))
        if rng.random() < 0.5:
            t[p] = rng.choice("qxz")
        elif rng.random() < 0.5:
            t.insert(p, "q")
        else:
            del t[p]
    return "".join(t)


def slow_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for x in pattern:
        new = [row[0] + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(3))
def test_alignment_equals_dynamic_programming(seed):
    rng = random.Random(seed)
    for _ in range(25):
        s = "".join(rng.choice("abcdefghij klmn") for _ in range(100)).strip().ljust(100, "o")
        text = "".join(rng.choice("abc de") for _ in range(rng.randint(0, 150))) + mutate(rng, s, rng.randint(0, 11)) + "".join(rng.choice("abc de") for _ in range(80))
        index = decontaminate.Index([(1, s)])
        found, e = index.search([text]), slow_edits(s, text)
        assert bool(found) == (e <= index.edits[0]) and (not found or min(x[3] for x in found) == e)


def test_repeated_q_grams_take_bounded_memory(monkeypatch):
    import tracemalloc

    index = decontaminate.Index([(1, "-" * 100), (2, "-" * 100), (3, "ab" * 50)])
    tracemalloc.start()
    found = index.search(["-" * 200_000, "ab" * 100_000, "x" * 500 + "-" * 99 + "y"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(d, tuple(index.items[s])) for d, s, _, e in found} == {(0, (1, 2)), (1, (3,)), (2, (1, 2))}
    assert peak < 200 << 20


@pytest.mark.parametrize("seed", range(3))
def test_slices_find_what_one_slice_finds(monkeypatch, seed):
    rng = random.Random(seed)
    items = [(i, "".join(rng.choice("ab ") for _ in range(rng.choice([40, 100])))) for i in range(20)]
    texts = ["".join(rng.choice("ab ") for _ in range(300)) + mutate(rng, t, rng.randint(0, 6)) + "b a" * 50 for _, t in items]
    best = lambda found: {(d, s): min(e for x, y, _, e in found if (x, y) == (d, s)) for d, s, *_ in found}
    whole = best(decontaminate.Index(items).search(texts))
    monkeypatch.setattr(decontaminate, "HITS", 200)
    assert best(decontaminate.Index(items).search(texts)) == whole and len(whole) >= 15


def test_planted_passages_are_found_and_clean_documents_left(spark, sf_dir, make):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = bench.collect()
    rng = random.Random(1)
    filler = ["".join(rng.choice("abcdefghij ") for _ in range(400)) for _ in range(len(items))]
    docs = [(k, f + mutate(rng, i.text, int(0.05 * len(i.text))).upper() + f) for k, (f, i) in enumerate(zip(filler, items))] + [(1000 + k, f) for k, f in enumerate(filler)]
    got = decontaminate.matches(make(docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(k, i.item_id) for k, i in enumerate(items)} and all(r.doc_id < 1000 for r in got)
    left = decontaminate.drop_contaminated(make(docs), bench)
    assert sorted(r.doc_id for r in left.collect()) == [1000 + k for k in range(len(items))] and left.columns == make([]).columns


def test_benchmark_in_blocks_gives_the_same(spark, sf_dir, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = {tuple(r) for r in decontaminate.matches(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_SEGMENTS", 40)
    assert {tuple(r) for r in decontaminate.matches(docs, bench).collect()} == one and one
    exact = {d.doc_id for d in docs.collect() for i in bench.collect() if decontaminate.normal(i.text) in decontaminate.normal(d.text)}
    assert {r[0] for r in one} == exact


def test_decontamination_edges(spark, make):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "a b c d e f g h i j")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.matches(make(EDGE), bench).collect()} == {3}
    assert decontaminate.matches(make(EDGE), bench.limit(0)).count() == 0 and decontaminate.matches(make([]), bench).count() == 0


# --- token counts
def test_edited_counts_equal_counts_of_the_edited_text():
    count = token_counts.counter(*token_counts.default_vocabulary())
    rng = random.Random(0)
    letters = "ab c  'd.1\n\té s"
    for block in (1, 3, 64):
        token_counts.BLOCK = block
        for _ in range(400):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 70)))
            tree, now = token_counts.TokenTree(text, count), text
            edits, at, shift = [], 0, 0
            while at <= len(text) and rng.random() < 0.8:
                a = rng.randint(at, len(text))
                b = min(len(text), a + rng.randint(0, 6))
                new = "".join(rng.choice(letters) for _ in range(rng.randint(0, 5)))
                edits.append((a, b, new))
                now = now[: a + shift] + new + now[b + shift :]
                shift += len(new) - (b - a)
                at = b + 1
            assert token_counts.apply_edits(tree, edits) == len(edits)
            assert tree.text == now and tree.n_tokens == len(count.encoding.encode_ordinary(now))
            pieces = [[tree.block(k)[a:b] for a, b in tree.cut(k, k)] for k in range(len(tree.sums))]
            assert [x for p in pieces for x in p] == count.pattern.findall(now)
            assert tree.sums == [(sum(map(len, p)), sum(count.all(p))) for p in pieces] and max(map(len, pieces)) <= 2 * block
            again = token_counts.TokenTree(text, count, token_counts.TokenTree(text, count).sums)  # from what is saved
            token_counts.apply_edits(again, edits)
            assert (again.text, again.sums) == (tree.text, tree.sums)
    token_counts.BLOCK = 64


def test_token_counts(spark, sf_dir, make):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    enc = token_counts.counter(*token_counts.default_vocabulary()).encoding
    for r in token_counts.recount(token_counts.save_trees(docs), token_counts.redactions).collect():
        t = text[r.doc_id] or ""
        for a, b, new in sorted(token_counts.redactions(t), reverse=True):
            t = t[:a] + new + t[b:]
        assert (r.n_tokens, r.n_tokens_edited, r.n_chars_edited) == (len(enc.encode_ordinary(text[r.doc_id] or "")), len(enc.encode_ordinary(t)), len(t))
    assert token_counts.recount(token_counts.save_trees(make(EDGE)), token_counts.redactions).count() == len(EDGE) and token_counts.save_trees(make([])).count() == 0


def test_an_edit_log_is_applied_to_saved_trees(spark, make):
    saved = token_counts.save_trees(make([(1, "one two three " * 500), (2, "four"), (3, None)]))
    log = spark.createDataFrame([(1, [(4, 7, "twelve"), (6000, 6000, " and more words" * 400)])], "doc_id long, log array<struct<start:long,end:long,text:string>>")
    got = {r.doc_id: r for r in token_counts.recount(saved.join(log, "doc_id", "left"), edits="log").collect()}
    text = "one two three " * 500
    text = text[:4] + "twelve" + text[7:6000] + " and more words" * 400 + text[6000:]
    enc = token_counts.counter(*token_counts.default_vocabulary()).encoding
    assert got[1].n_tokens_edited == len(enc.encode_ordinary(text)) and got[1].n_chars_edited == len(text)
    assert got[1].n_reencoded < got[1].n_pretokens + 1200 + 600 and (got[2].n_edits, got[2].n_reencoded, got[3].n_tokens) == (0, 0, 0)


def test_a_long_insertion_splits_blocks():
    count = token_counts.counter(*token_counts.default_vocabulary())
    tree = token_counts.TokenTree("word " * 1000, count)
    tree.replace(2500, 2500, " more" * 20_000)
    assert max(len(count.pattern.findall(tree.block(k))) for k in range(len(tree.sums))) <= 2 * token_counts.BLOCK
    before = tree.encoded
    tree.replace(2500, 2501, "x")
    assert tree.encoded - before < 10 * token_counts.BLOCK


def test_overlapping_and_overlong_edits():
    tree = token_counts.TokenTree("hello world", token_counts.counter(*token_counts.default_vocabulary()))
    assert token_counts.apply_edits(tree, [(6, 99, "all"), (0, 5, "bye"), (2, 4, "no")]) == 2 and tree.text == "bye all"


# --- toxicity
def test_toxicity_on_held_out_labels(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    fit, held = labels.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 = 0")
    got = toxicity.severity(docs, fit).withColumnRenamed("toxic", "said")
    x = got.join(held, "doc_id").toPandas()
    y, pred = x["toxic"], x["said"]
    assert y.sum() > 50
    hit = (pred & (y == 1)).sum()
    assert hit / y.sum() > 0.8 and hit / pred.sum() > 0.9


def test_ordinal_thresholds_and_shared_weights():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(3000):
        n = int(rng.integers(0, 6))
        rows.append(sorted(rng.choice(20, n, replace=False).tolist()) + sorted(100 + rng.choice(50, int(rng.integers(0, 4)), replace=False)))
        grades.append(0 if n < 2 else 1 if n < 4 else 2)
    m = toxicity.fit(rows, np.array(grades))
    signal, noise = [m.weights.get(f, 0) for f in range(20)], [abs(m.weights.get(f, 0)) for f in range(100, 150)]
    assert m.thresholds[0] < m.thresholds[1] and min(signal) > 0.5 and max(noise) < 0.5 * min(signal)


def test_labels_of_unknown_documents_take_no_place(spark, make, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 20)
    docs = make([(k, "fine words here" if k % 2 else "vile words here") for k in range(20)])
    labels = spark.createDataFrame([(k, 1, int(k % 2 == 0)) for k in range(2000)], "doc_id long, quality int, toxic int")
    rows, grades = toxicity.training_sample(docs, labels)
    assert len(rows) == 20 and sorted(grades.tolist()) == [0] * 10 + [1] * 10


def slow_likelihood(rows, grades, weights, thresholds):
    """Mean negative log-likelihood of the cumulative-link model, text by text."""
    total = 0.0
    for r, g in zip(rows, grades):
        z = sum(weights.get(f, 0.0) for f in r)
        above = [1.0, *(1 / (1 + np.exp(-(z - t))) for t in thresholds), 0.0]
        total -= np.log(above[g] - above[g + 1])
    return total / len(rows)


def test_fit_is_a_minimum_of_the_penalised_likelihood():
    """No small change of a weight or threshold makes the objective, computed in a plain way, better."""
    rng = np.random.default_rng(3)
    rows = [sorted(rng.choice(12, int(rng.integers(0, 6)), replace=False).tolist()) for _ in range(400)]
    grades = np.array([min(2, max(0, int(sum(f < 5 for f in r) + rng.integers(-1, 2)))) for r in rows])
    m = toxicity.fit(rows, grades)
    goal = lambda w, t: slow_likelihood(rows, grades, w, t) + toxicity.L1 / 20 * sum(map(abs, w.values()))
    best = goal(m.weights, m.thresholds)
    for f in range(12):
        for step in (-0.05, 0.05):
            assert goal(m.weights | {f: m.weights.get(f, 0.0) + step}, m.thresholds) > best - 1e-5
    for k in (0, 1):
        for step in (-0.05, 0.05):
            assert goal(m.weights, m.thresholds + step * (np.arange(2) == k)) > best - 1e-5


def test_toxicity_edges(spark, make):
    labels = spark.createDataFrame([(3, 1, 0), (1, 1, None), (99, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.severity(make(EDGE), labels).collect()
    assert len(got) == len(EDGE) and all(r.expected_severity < 1e-9 for r in got)
    assert toxicity.severity(make([]), labels.limit(0)).count() == 0


# --- HTML
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1><nav><a href="/">Home</a></nav></header>
<div id="cookie-notice">We use cookies</div><div class="sidebar"><p>Another long story about nothing at all, told at length.</p></div>
<div class="content"><h2>Title &amp; more</h2><p>First <i>para</i>graph of the article,\n which is   quite long.</p><p>Short.</p><form><label>Name</label><input></form><p>Second &lt;paragraph&gt; with&nbsp;more.</p><ul><li>one</li><li>two</li></ul></div>
<section id="comments"><article class="comment"><p>Nice post! I like it so much that I write this long comment.</p></article></section><footer>&copy; all</footer></body></html>"""
WANT = "Title & more First paragraph of the article, which is quite long. Short. Second <paragraph> with more. one two"


def test_main_text():
    assert html_text.main_text(PAGE) == WANT
    assert html_text.main_text(PAGE.replace('<div class="content">', "<main>").replace("</ul></div>", "</ul></main>")) == WANT
    assert html_text.main_text('<div class="ad">Buy this<article><p>Text stays</p></article>') == "Text stays"
    assert [html_text.main_text(x) for x in (None, "", "plain", "<p>", "<!-- x", "<nav>a</nav>")] == ["", "", "plain", "", "", ""]


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = html_text.extract(pages).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) for r in got)
    odd = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>long text here</p>" * 3, "x"), (1, "u", "", "x")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html_text.extract(odd).collect()) == ["", "", "long text here long text here long text here"]


P = "<p>Some words of the article that go on for a while.</p>"
Q = "Some words of the article that go on for a while."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article class='post no-sidebar'>{P}</article>", Q),
        (f"<article class='post tag-legal category-social'>{P}</article>", Q),
        (f"<article class='sidebar'>{P}</article><div class='sidebar'>Also here</div>", Q),
        (f"<main id='search'>{P}</main>", Q),
        (f"<div class='layout with-sidebar'>{P}</div>", Q),
        (f"<article><section aria-label='Search engines'>{P}</section></article>", Q),
        (f"<article>{P}<p><a href='x'>A reference that is wholly a link</a></p></article>", f"{Q} A reference that is wholly a link"),
        (f"<article>{P}<figure><img src='x'><figcaption>What the figure shows</figcaption></figure></article>", f"{Q} What the figure shows"),
        (f"<div><main><div class='promo'>Buy<article>{P}</article>Buy more</div><p>After it</p></main></div>", f"{Q} After it"),
        (f"<div>{P}</div><div class='site-footer'>Imprint and all</div><div class='cookie-notice'>We use them</div><ul><li><a href='x'>Elsewhere</a></li></ul>", Q),
        (f"<article>{P}<article class='comment' id='comment-5'>Nice post</article></article>", Q),
        (f"<article>{P}</article><div class='comment-list'><article>Nice post</article></div>", Q),
        (f"<article>{P}<div id='search'>{P}</div><div class='discussion'>{P}</div><section class='social'>{P}</section></article>", " ".join([Q] * 4)),
        (f"<article>{P}<div class='share'><a href='x'>Post it</a></div><section class='related'><ul><li><a href='x'>More</a></li></ul></section></article>", Q),
        (f"<article>{P}<div class='site-sidebar-list-widget-area-box-left-inner-wrap-container-top-9'>Elsewhere</div></article>", Q),
        (f"<article>{P}<div class='{'top-' * 40}sidebar'>Elsewhere</div><div class='{'top-' * 40}'>Here</div></article>", f"{Q} Here"),
        (f"<article>{P}<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds</p></article>", f"{Q} So x=1 holds"),
        (f"<div class='content'>{P * 5}<p><a href='x'>A paragraph that is one link</a></p>{P}</div><ul><li><a href='x'>Elsewhere</a></li></ul>", " ".join([Q] * 5 + ["A paragraph that is one link", Q])),
        (f"<div class='content'><p>{Q * 20}</p><div class='ad'><p>Buy</p><p>this</p><p>now</p></div><p>The end.</p></div><p>Imprint</p>", f"{Q * 20} The end."),
        (f"<div class='content'><h1>Title</h1><div class='share'><p>a</p><p>b</p><p>c</p></div>{P * 5}</div>", " ".join(["Title"] + [Q] * 5)),
        (f"<div class='content'>{P}</div><div role='search dialog'>Find</div><div role='form'>Name</div>", Q),
    ],
)
def test_html_containers(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("block", ["<p class='share'>Share of the vote by county</p>", "<h2 id='search'>The search goes on</h2>", "<figcaption class='banner'>A banner</figcaption>", "<p><a href='x'>All of this sentence is one link</a></p>", "<p>By me</p>"])
def test_nothing_inside_of_an_article_is_dropped(block):
    text = re.sub("<[^>]*>", "", block)
    assert html_text.main_text(f"<nav>menu</nav><article>{block}{P * 30}{block}</article><footer>end</footer>") == " ".join([text, *[Q] * 30, text])


@pytest.mark.parametrize("part", ["<a ", "<div>x", "<span>y", "<svg>", "<!", '<a title="', "<p>a<", "</div>", "<article><div class=ad>z", "< ", "<a href='x'", "&amp", "<div class='" + "top-" * 50 + "'>"])
def test_broken_pages_take_linear_time(part):
    def seconds(n):
        start = time.thread_time()
        html_text.main_text(part * (n // len(part)))
        return time.thread_time() - start

    seconds(1000)
    assert seconds(1 << 20) < max(1.0, 40 * seconds(1 << 16))


def test_planted_articles_are_found(spark):
    """Articles of random shape in pages with and without <article>: what of their words comes out, and what else."""
    rng = random.Random(8)
    word = lambda kind: f"{kind}{rng.randrange(10**6)}"
    words = lambda kind, n: " ".join(word(kind) for _ in range(n))
    rows, want = [], {}
    for k in range(300):
        body = [words("w", rng.choice([3, 12, 40, 90])) for _ in range(rng.randint(3, 15))]
        body[0] = words("w", 60)
        inner = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<p><b>{}</b></p>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>"]).format(x) + rng.choice(["", "", f"<div class='ad'>{words('b', 9)}</div>", f"<script>{words('b', 5)}</script>"]) for x in body)
        whole = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<section>{}</section>", "{}"]).format(inner)
        menu = "".join(f"<li><a href='x'>{words('b', 2)}</a></li>" for _ in range(8))
        rows.append((k, "u", f"<html><head><title>{words('b', 4)}</title></head><body><nav><ul>{menu}</ul></nav><div class='menu'><ul>{menu}</ul></div>{whole}<div id='comments'><p>{words('b', 30)}</p></div><aside>{words('b', 20)}</aside><form>{words('b', 5)}</form><footer>{words('b', 12)}</footer></body></html>"))
        want[k] = " ".join(body)
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want  # precision and recall of 1 on these


def test_windows_decide_where_the_text_is():
    """Without <article> and names: short lines far from the text are no text, those beside it are."""
    page = "<div>Home</div>" + "<div><a href='x'>link</a></div>" * 6 + "<div>Title</div>" + "<div>" + "Long text here. " * 40 + "</div><div>Short end</div>" + "<div><a href='x'>link</a></div>" * 6 + "<div>(c)</div>"
    assert html_text.main_text(page) == "Title " + ("Long text here. " * 40).strip() + " Short end"
