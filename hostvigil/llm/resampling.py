"""Importance resampling towards a target: hashed features, array-scored weights, a cutoff found by counting.

A feature is a run of 1 to `ngrams` consecutive words and falls into one of `buckets` buckets by its CRC-32. The counts
of all documents and of all target texts give each bucket a gain (a log ratio, in thousandths); the gains of all buckets
are one array of fixed size, and a document's weight is the floored mean of its features' gains. Gumbel noise made of
its doc_id turns the weights into a draw without replacement: the highest scores win (Xie et al., NeurIPS 2023).

No sort of all documents finds the winners: the scores are written once, and exact counts over that table narrow the
cutoff's score, then the cutoff's doc_id among equal scores, then the row among equal ids, four halvings a job. Only the
winners are dealt by range, and a winner's rank is its place in its range plus the sizes of the ranges before.

Null or empty text has no features: weight 0. A null doc_id draws as the empty string and comes last among ties; rows of
one id share their noise, and each has a rank of its own. An empty table gives no rows, an empty target counts as zeros.
Texts are read whole; extra columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from hostvigil.llm.common import materialize, only, read_table, text_batches, tidied

#: A job of the bisection counts below this many thresholds, less one.
WAYS = 16
LAST_ID = (1 << 63) - 1
#: A-Z become lower case, all other ASCII but digits and letters becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Runs of ASCII digits, ASCII letters (lower-cased) and all characters beyond ASCII, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def features(word_list: list[bytes], ngrams: int) -> list[bytes]:
    """All runs of 1 to `ngrams` words, joined by one space."""
    if ngrams == 1:
        return word_list
    return word_list + [b" ".join(word_list[i : i + n]) for n in range(2, ngrams + 1) for i in range(len(word_list) - n + 1)]


def bucket_of(found: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % buckets


def bucket_counts(texts: DataFrame, ngrams: int, buckets: int) -> DataFrame:
    """bucket, n over all features of all texts; a task sums by bucket and sends at most a row for each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += np.bincount(bucket_of(features(words(t or ""), ngrams), buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    sums = only(texts, text="string").mapInArrow(tidied(count), "bucket int, n long")
    return sums.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, ngrams: int = 1, buckets: int = 10_000) -> np.ndarray:
    """The gain of each bucket. The two sums of each bucket, as many as the parameter says, come to the driver."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, table in ((s, docs), (t, target)):
        for bucket, n in bucket_counts(table, ngrams, buckets).collect():
            counts[bucket] = n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighted(docs: DataFrame, target: DataFrame, ngrams: int = 1, buckets: int = 10_000, seed: int = 2024, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document; with `carry` its columns as the struct `document`."""
    gain = gains(docs, target, ngrams, buckets)

    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                w = words(text)
                f = features(w, ngrams)
                out.append((len(w), len(f), int(gain[bucket_of(f, buckets)].sum()) // len(f) if f else 0))
            yield pd.DataFrame(out, columns=["n_words", "n_features", "weight"], dtype="int64")

    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")] if carry else []
    # as if not deterministic: the plan must not weigh twice
    of_text = F.pandas_udf(weigh, "n_words long, n_features long, weight long", PandasUDFType.SCALAR_ITER).asNondeterministic()
    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), of_text(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w"), *kept)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return rows.select("doc_id", "w.*", *(["document"] if carry else [])).withColumn("score", F.col("weight") + noise)


def nth(rows: DataFrame, column: str, k: int) -> tuple[int, int, int]:
    """The k-th smallest value v of a long column without nulls, how many are less than v, and how many equal it."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    below, upto = 0, None
    while low < high:
        cuts = sorted({low + (high - low) * i // WAYS for i in range(1, WAYS)} - {high} | {low})
        got = rows.agg(*[F.count_if(F.col(column) <= F.lit(c).cast("long")) for c in cuts]).first()
        at = next((i for i, n in enumerate(got) if n >= k), len(cuts))
        if at < len(cuts):
            high, upto = cuts[at], got[at]
        if at > 0:
            low, below = cuts[at - 1] + 1, got[at - 1]
    if upto is None:
        upto = rows.filter(F.col(column) <= F.lit(low).cast("long")).count()
    return low, below, upto - below


def first_k(rows: DataFrame, order: list[str], k: int) -> Column:
    """Condition that holds for exactly the k first rows in ascending order of long columns that tell all rows apart."""
    taken, same = F.lit(False), F.lit(True)
    for c in order:
        if k <= 0:
            break
        v, below, equal = nth(rows.filter(same), c, k)
        taken = taken | (same & (F.col(c) < F.lit(v).cast("long")))
        same = same & (F.col(c) == F.lit(v).cast("long"))
        k -= below
        if k == equal:
            return taken | same
    return taken


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `rank`, 1, 2, 3 and so on in ascending order of the columns: dealt by range, numbered range by range."""
    dealt = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").count().orderBy("_range").collect()  # a number a range
    starts, before = [], 0
    for r in sizes:
        starts.append((r["_range"], before))
        before += r["count"]
    offsets = rows.sparkSession.createDataFrame(starts, "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long")
    return dealt.withColumn("_place", place).join(F.broadcast(offsets), "_range").withColumn("rank", F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, ngrams: int = 1, buckets: int = 10_000, seed: int = 2024, carry: bool = False) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document.

    Of the documents with `min_words` words or more, `percent` hundredths (rounded down) of the highest scores get a
    rank; ties go to the smaller doc_id. With `carry` the rows also hold their documents.
    """
    rows = weighted(docs, target, ngrams, buckets, seed, carry)
    scored = materialize(rows.select("*", (-F.col("score")).alias("_a"), F.coalesce("doc_id", F.lit(LAST_ID)).alias("_b"), F.monotonically_increasing_id().alias("_c")))
    order = ["_a", "_b", "_c"]
    able = F.col("n_words") >= min_words
    n = scored.filter(able).count() * percent // 100
    drawn = able & first_k(scored.filter(able), order, n)
    columns = ["doc_id", "n_features", "weight", "score", *(["document"] if carry else [])]
    rest = scored.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked(scored.filter(drawn), order).select(*columns, "rank").union(rest)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn in the likeness of the benchmark's texts."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: The same rows; CRC-32 is computed byte by byte with a table made of its polynomial.
ORACLE = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), target AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), tokens AS (SELECT doc_id, unnest(ws) AS w FROM lists
), vocabulary AS (SELECT DISTINCT w FROM (SELECT w FROM tokens UNION ALL SELECT w FROM target)
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM vocabulary, crc_table
), s AS (SELECT bucket, count(*) AS n FROM tokens JOIN hashed USING (w) GROUP BY 1
), t AS (SELECT bucket, count(*) AS n FROM target JOIN hashed USING (w) GROUP BY 1
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS g
  FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), weights AS (SELECT doc_id, floor(sum(g) / count(*)) AS weight FROM tokens JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM lists LEFT JOIN weights USING (doc_id)
), ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= n * 10 // 100 THEN r END AS rank FROM scored LEFT JOIN ranks USING (doc_id)
"""
