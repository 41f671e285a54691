"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each (lang, source) has, for each measure, a sketch of counts in logarithmic buckets (the DDSketch of Masson, Rim and
Lee, VLDB 2019): any quantile has a relative error of at most ALPHA, and sketches merge by adding counts. A measure
is too high if it lies above the upper fence ``q75 + FENCE * max(q75 - q25, SPREAD)``; groups with fewer than MIN_ROWS
rows use the merged sketch of their language, or of all rows.

Null text counts as empty and null lang or source as a group of its own; long texts are measured whole, repeated rows
each by themselves. Extra columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvigil.llm.common import materialize, only, read_table, text_batches, unused

ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Values below this count as zero: they share one bucket.
LEAST = 1e-4
FENCE = 3.0
MIN_ROWS = 200
#: Least interquartile range of each measure, so that groups of equal documents keep some room.
SPREAD = {"word_len": 1.0, "symbol_share": 0.01, "dup_line_share": 0.1, "repeat_share": 0.05}

STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOL = re.compile(r"[#*$%&|<>]")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of `size` words that occur at least twice in the list."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    v = h[:n].copy()
    for k in range(1, size):
        v = v * _ODD + h[k : n + k]
    order = np.argsort(v, kind="stable")
    same = v[order][1:] == v[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    seen: dict[tuple, int] = {}  # equal hashes are compared as words
    starts = np.flatnonzero(twice).tolist()
    for i in starts:
        w = tuple(words[i : i + size])
        seen[w] = seen.get(w, 0) + 1
    marks = np.zeros(len(words) + 1, np.int64)
    for i in starts:
        if seen[tuple(words[i : i + size])] > 1:
            marks[i] += 1
            marks[i + size] -= 1
    return int((np.cumsum(marks) > 0).sum())


def text_stats(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six ASCII white-space characters
    chars = len(text) - sum(map(text.count, _SPACE))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return len(words), chars, len(_SYMBOL.findall(text)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def _measure(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(t or "") for t in texts], columns=STATS, dtype="int64")


def with_stats(docs: DataFrame, name: str = "stats") -> DataFrame:
    """`docs` with a column `name` of statistics; the other columns stay in the JVM."""
    # as if not deterministic: the plan must not measure twice
    measure = F.pandas_udf(_measure, ", ".join(f"{n} long" for n in STATS)).asNondeterministic()
    return text_batches(docs).withColumn(name, measure(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def document_stats(docs: DataFrame) -> DataFrame:
    return with_stats(only(docs, doc_id="long", lang="string", source="string", text="string")).select("doc_id", *_group(), "stats.*")


def _group() -> list[Column]:
    """lang and source, with null as a value of its own."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in ("lang", "source")]


def measures(of: str = "") -> dict[str, Column]:
    """The measures from the statistics in columns (or, with "stats." or the like, fields) of these names."""
    share = lambda a, b: F.when(F.col(of + b) > 0, F.col(of + a) / F.col(of + b)).otherwise(0.0)
    return {"word_len": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words")}


def _bucket(x: Column) -> Column:
    """Logarithmic bucket of a value; 0 holds all values below LEAST."""
    return F.when(x < LEAST, 0).otherwise(F.ceil(F.log(x / LEAST) / math.log(GAMMA)) + 1).cast("int")


def sketches(stats: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: the quantile sketch of every measure; merge by summing n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), _bucket(v).alias("bucket")) for k, v in measures().items()]))
    return stats.select("lang", "source", pairs.alias("m")).groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rows, <measure>_max from sketches merged to `keys`."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    at = F.array_sort(F.collect_list(F.struct("bucket", "n")))  # buckets, not rows: bounded by the range of a measure
    groups = merged.groupBy(*keys, "measure").agg(at.alias("at"), F.sum("n").alias("rows"))

    def quantile(q: float) -> Column:
        step = lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.when((acc["b"] < 0) & (acc["seen"] + x["n"] >= F.col("rows") * q), x["bucket"]).otherwise(acc["b"]).alias("b"))
        b = F.aggregate("at", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("b")), step)["b"]
        return F.when(b <= 0, 0.0).otherwise(LEAST * F.pow(F.lit(GAMMA), b - 1) * 2 / (1 + GAMMA))

    spread = F.element_at(F.create_map(*[F.lit(x) for kv in SPREAD.items() for x in kv]), F.col("measure"))
    top = groups.select(*keys, "measure", "rows", (quantile(0.75) + FENCE * F.greatest(quantile(0.75) - quantile(0.25), spread)).alias("top"))
    return top.groupBy(*keys).pivot("measure", list(SPREAD)).agg(F.first("top")).join(top.groupBy(*keys).agg(F.max("rows").alias("rows")), keys) if keys else top.groupBy().pivot("measure", list(SPREAD)).agg(F.first("top"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and the fence of each measure; small groups take those of the language, then of all rows."""
    every = _fences(sketch, []).first()  # one row
    lang = _fences(sketch, ["lang"]).select("lang", F.col("rows").alias("lang_rows"), *[F.col(m).alias(f"lang_{m}") for m in SPREAD])
    best = {f"{m}_max": F.when(F.col("rows") >= MIN_ROWS, F.col(m)).when(F.col("lang_rows") >= MIN_ROWS, F.col(f"lang_{m}")).otherwise(F.lit(every[m]).cast("double")) for m in SPREAD}
    return _fences(sketch, ["lang", "source"]).join(lang, "lang").select("lang", "source", *[c.alias(k) for k, c in best.items()])


def _verdict(of: str = "", limits: str = "") -> tuple[Column, Column]:
    """base_failed and kept, from the statistics and the limits of the row's group (columns, or fields of these structs)."""
    base = (F.col(of + "n_words") < 10) | (100 * F.col(of + "n_repeat_words") > 20 * F.col(of + "n_words"))
    inside = F.lit(True)
    for m, value in measures(of).items():
        inside = inside & (value <= F.col(f"{limits}{m}_max"))
    return base, ~base & inside


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row."""
    stats = materialize(document_stats(docs))
    base, kept = _verdict()
    return stats.join(materialize(thresholds(sketches(stats))), ["lang", "source"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, with all their columns of whatever names; the texts are measured again rather than shuffled.

    Rows are judged one by one, repeated or not. Without `lang` or `source` column the rows count as one language or source.
    """
    for c in {"lang", "source"} - {x.lower() for x in docs.columns}:
        return keep_good(docs.withColumn(c, F.lit("-"))).drop(c)
    stats, lang_, source_, limit = unused(docs.columns, "stats", "group_lang", "group_source", "limit")
    limits = materialize(thresholds(materialize(sketches(document_stats(docs)))))
    limits = limits.select(F.col("lang").alias(lang_), F.col("source").alias(source_), F.struct(*[f"{m}_max" for m in SPREAD]).alias(limit))
    lang, source = _group()
    joined = with_stats(docs, stats).join(limits, (lang == F.col(lang_)) & (source == F.col(source_)))
    return joined.filter(_verdict(f"{stats}.", f"{limit}.")[1]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """DuckDB SQL for the rows of the query."""
    share = {"word_len": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words")}
    m = {k: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0 END" for k, (a, b) in share.items()}
    long = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, CASE WHEN ({x}) < {LEAST} THEN 0 ELSE CAST(ceil(ln(({x}) / {LEAST}) / {math.log(GAMMA)!r}) AS INT) + 1 END AS bucket FROM s" for k, x in m.items())
    value = lambda q: f"(CASE WHEN min(bucket) FILTER (WHERE up >= total * {q}) <= 0 THEN 0 ELSE {LEAST} * pow({GAMMA!r}, min(bucket) FILTER (WHERE up >= total * {q}) - 1) * 2 / {1 + GAMMA!r} END)"
    spread = "CASE measure " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SPREAD.items()) + " END"

    def fences(keys: str) -> str:
        by = f"{keys}, measure" if keys else "measure"
        return f"SELECT {by}, any_value(total) AS total, {value(0.75)} + {FENCE} * greatest({value(0.75)} - {value(0.25)}, any_value({spread})) AS top FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS up, sum(n) OVER (PARTITION BY {by}) AS total FROM (SELECT {by}, bucket, count(*) AS n FROM l GROUP BY {by}, bucket)) GROUP BY {by}"

    inside = " AND ".join(f"({x}) <= max(CASE WHEN measure = '{k}' THEN top END)" for k, x in m.items())
    word = r"[^\x20\x09-\x0D]"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM documents),
    g AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
    p AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1), (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
    s AS (SELECT d.r, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}'))) AS n_lines, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')))) AS n_dup_lines,
      coalesce(p.n, 0) AS n_repeat_words FROM d LEFT JOIN p ON p.r = d.r),
    l AS ({long}),
    a AS (SELECT o.lang, o.source, o.measure, CASE WHEN o.total >= {MIN_ROWS} THEN o.top WHEN b.total >= {MIN_ROWS} THEN b.top ELSE e.top END AS top FROM ({fences("lang, source")}) o JOIN ({fences("lang")}) b ON b.lang = o.lang AND b.measure = o.measure JOIN ({fences("")}) e ON e.measure = o.measure)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM (
      SELECT any_value(doc_id) AS doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {inside} AS inside
      FROM s JOIN a ON a.lang = s.lang AND a.source = s.source GROUP BY r, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)"""


ORACLE = _oracle()
