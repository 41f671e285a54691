"""Prefix trie of conversations, built by van Emde Boas recursion on its height.

Turns stand for themselves by the SHA-256 of role and text. Every conversation is cut into blocks of 1, 2, 4 ... turns,
and a block's digest is made of its halves' digests (`_blocks`). From the top, each recursion cuts all tries of height
2h at half depth at once: the upper trie keeps the root, the lower forest has a trie below each cut prefix, which is
named by root and upper block, and equal pieces below one root become one, so what conversations share is carried on
once (`_cut`). At height 1 a piece is a node. Totals then come up the same levels (`_graft`): tries of height h are
summed by themselves, lower ones are grafted onto the prefix they hang on, and so on up; then the other way round, so
that also prefixes in the middle of a block get what lies below the block. A level handles all tries of all
conversations side by side; there are as many levels as the longest conversation's length has binary digits, and a
level has half the rows of the level below it.

No group is gathered: order comes from a range partition, counts and sums are combined before they are shuffled, and a
conversation's rows, a common first turn or a thousand copies of a conversation may lie in any number of tasks. Only the
longest length, the number of conversations and the sizes of sort ranges come to the driver.

Null role or text counts as empty. Turns are in order of `turn`, null first, ties by role and then by the text's SHA-256.
Rows without conv_id belong to no conversation and are left out. An empty table has no trie, not even a root. Texts are
read whole; extra columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostvigil.llm.common import materialize, read_table

#: Bytes of conv_ids in one piece of a list that is hashed.
PIECE_BYTES = 1 << 18
_SPACES = "[ \t\n\x0b\x0c\r]+"


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (0, 1, 2 ... in order of turn), dig (of role and text), words of the text, for each turn."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    words = F.size(F.array_remove(F.split(text, _SPACES), "")).cast("long")
    # the length of the role keeps ("a", "bc") and ("ab", "c") apart
    dig = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("by_text"), dig.alias("dig"), words.alias("words"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "by_text", "row"]
    dealt = materialize(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    # a conversation in several ranges goes on counting where the range before stopped
    sizes = dealt.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = sizes.select("conv_id", "range", F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("before")).filter("before > 0")
    place = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order[1:]))
    placed = dealt.withColumn("place", place)
    # at most one conversation goes on from range to range: no more rows than ranges
    return placed.join(F.broadcast(before), ["conv_id", "range"], "left").select("conv_id", (F.col("place") - 1 + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "dig", "words")


def rebuilt(turns: DataFrame, stride: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (as `numbered`) of every conversation c after its first h turns are those of conversation c - c % stride, with h = crc32(c) % most; and conv_id of all conversations."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % stride).alias("donor"), F.least("n", F.lit(most)).alias("n")))
    donors = convs.select(F.col("conv_id").alias("donor"), F.col("n").alias("donor_n"))
    heads = turns.filter(F.col("pos") < most - 1).withColumnRenamed("conv_id", "donor")
    first = convs.join(heads, "donor").filter("pos < h").select("conv_id", "pos", "dig", "words")  # at most `stride` conversations a side and donor
    # a donor of fewer than h turns leaves a gap to close
    short = convs.join(donors, "donor", "left").select("conv_id", (F.col("h") - F.coalesce("donor_n", F.lit(0))).alias("gap")).filter("gap > 0")
    own = turns.filter(F.col("pos") >= head).join(short, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("pos"), "dig", "words")
    return first.union(own), convs.select("conv_id")


def _hash(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _blocks(turns: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """By level k from 1: conv_id, i, and the halves l and r (null if empty) of its block i of 2^k turns, each a struct of
    dig, n (turns) and words (of a single turn); and the digest of each whole conversation with turns."""
    level, halves = turns.select("conv_id", F.col("pos").alias("i"), F.struct("dig", F.lit(1).cast("long").alias("n"), "words").alias("b")), []
    for _ in range(levels):
        side = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("b")))  # noqa: E731  one row at most
        pairs = materialize(level.groupBy("conv_id", F.shiftright("i", 1).alias("up")).agg(side(0).alias("l"), side(1).alias("r")).withColumnRenamed("up", "i"))
        halves.append(pairs)
        n = F.col("l.n") + F.coalesce("r.n", F.lit(0))
        whole = F.struct(_hash(F.lit("("), F.col("l.dig"), F.coalesce("r.dig", F.lit(b""))).alias("dig"), n.alias("n"), F.lit(None).cast("long").alias("words"))
        level = pairs.select("conv_id", "i", whole.alias("b"))
    return halves, level.select("conv_id", "b.dig")


def _cut(halves: list[DataFrame], whole: DataFrame) -> list[DataFrame]:
    """The pieces of each recursion, from height 1 up: root (name of the prefix that the piece goes on from), i (number
    of the block), b (its digest), conv_id (the smallest with root and piece), n_convs (with both), ends (digest of the
    conversation that ends inside of the piece or right at its end, else null)."""
    top = whole.groupBy("dig").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    items = top.select(F.lit(b"").alias("root"), F.lit(0).cast("long").alias("i"), "conv_id", "n_convs", F.col("dig").alias("ends"))
    out: list[DataFrame] = []
    for k in range(len(halves) - 1, -1, -1):
        both = items.join(halves[k], ["conv_id", "i"])  # a row for a row: an item's smallest conversation has one such block
        cut = _hash(F.col("root"), F.lit(f"|{k}|"), F.col("l.dig"))
        none = F.lit(None).cast("binary")
        upper = F.struct("root", (2 * F.col("i")).alias("i"), F.col("l").alias("b"), F.when(F.col("r").isNull(), F.col("ends")).otherwise(none).alias("ends"))
        lower = F.struct(cut.alias("root"), (2 * F.col("i") + 1).alias("i"), F.col("r").alias("b"), F.col("ends").alias("ends"))
        pieces = both.select("conv_id", "n_convs", F.explode(F.filter(F.array(upper, lower), lambda p: p["b"].isNotNull())).alias("p")).select("conv_id", "n_convs", "p.*")
        items = materialize(pieces.groupBy("root", "i", "b").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("ends").alias("ends")))
        out.insert(0, items)
    return out


def _nodes(items: list[DataFrame], root: int) -> DataFrame:
    """Nodes below the root: depth, conv_id, up (conv_id of the node 1, 2, 4 ... turns further up, as far as the depth is a
    multiple), n_convs, words, ends."""
    # a piece that fills its block ends at a node 2^k below its root; where the block's number is even, this names the node
    full = None
    for k, level in enumerate(items):
        rows = level.filter(F.col("b.n") == 1 << k).select("root", F.lit(k).alias("k"), ((F.col("i") + 1) * (1 << k)).alias("depth"), "conv_id", F.when(F.col("i") % 2 == 0, _hash(F.col("root"), F.lit(f"|{k}|"), F.col("b.dig"))).alias("name"), "n_convs", "b.words", "ends", "i")
        full = rows if full is None else full.union(rows)
    full = materialize(full)
    names = full.filter("name IS NOT NULL").select(F.col("name").alias("root"), F.col("conv_id").alias("above"))
    paths = full.join(names, "root", "left").withColumn("above", F.when(F.col("i") == 0, F.lit(root)).otherwise(F.col("above")))
    at = lambda c: F.max(F.when(F.col("k") == 0, F.col(c))).alias(c)
    up = F.transform(F.array_sort(F.collect_list(F.struct("k", "above"))), lambda x: x["above"])  # one for each level
    return paths.groupBy("depth", "conv_id").agg(up.alias("up"), at("n_convs"), at("words"), at("ends"))


def _graft(nodes: DataFrame, levels: int) -> DataFrame:
    """depth, conv_id, n_leaves and saved: sums of `leaf` and `own` over the subtrees of (depth, conv_id, up, leaf, own)."""
    none = F.lit(None).cast("array<bigint>")

    def summed(rows: DataFrame) -> DataFrame:
        return materialize(rows.groupBy("depth", "conv_id").agg(F.max("up").alias("up"), F.sum("leaf").alias("leaf"), F.sum("own").alias("own")))

    def lifted(rows: DataFrame, k: int) -> DataFrame:
        return rows.select((F.col("depth") - (1 << k)).alias("depth"), F.col("up")[k].alias("conv_id"), none.alias("up"), "leaf", "own")

    within = [nodes.select("depth", "conv_id", "up", "leaf", "own")]  # by k: sums of the trie of height 2^k below each node at a multiple of 2^k
    for k in range(levels):
        odd = F.col("depth") % (2 << k) != 0
        within.append(summed(within[k].filter(~odd).union(lifted(within[k].filter(odd), k))))
    done = within[levels]  # the root
    for k in range(levels - 1, -1, -1):
        odd = F.col("depth") % (2 << k) != 0
        done = done.union(summed(within[k].filter(odd).union(lifted(done.filter("depth > 0"), k))))
    return done.select("depth", "conv_id", F.col("leaf").alias("n_leaves"), F.col("own").alias("saved"))


def _strung(members: DataFrame) -> DataFrame:
    """ends, sha: of (ends, conv_id), the SHA-256 of each group's conv_ids, ascending and joined by commas. A list lies in
    as many ranges as it needs; its pieces then pass through one hash, which can only be made in order."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, held, size = None, 0, [], 0
        for batch in batches:
            out = []
            for g, c in zip(batch.column("ends").to_pylist(), batch.column("conv_id").to_pylist()):
                if g != group or size > PIECE_BYTES:
                    if held:
                        out.append((group, first, ",".join(held)))
                    group, first, held, size = g, c, [], 0
                held.append(str(c))
                size += len(held[-1])
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o)) for o in out], schema)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (group, first, ",".join(held))))], schema)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sha = None, None
        for batch in batches:
            out = []
            for g, ids in zip(batch.column("ends").to_pylist(), batch.column("ids").to_pylist()):
                if g != group:
                    if sha:
                        out.append({"ends": group, "sha": sha.hexdigest()})
                    group, sha = g, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist(out, result)
        if sha:
            yield pa.RecordBatch.from_pylist([{"ends": group, "sha": sha.hexdigest()}], result)

    schema = pa.schema([("ends", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    result = pa.schema([("ends", pa.binary()), ("sha", pa.string())])
    order = ["ends", "conv_id"]
    strings = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "ends binary, first long, ids string")
    # nearly all lists are in one piece
    return strings.repartition("ends").sortWithinPartitions("ends", "first").mapInArrow(hashes, "ends binary, sha string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each node of the prefix trie of `turns` (conv_id, pos, dig, words) of `conversations` (conv_id): conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = materialize(turns.select("conv_id", "pos", "dig", "words"))
    size = conversations.agg(F.min("conv_id").alias("root"), F.count("*").alias("n")).first()
    longest = turns.agg(F.max("pos")).first()[0]
    levels = 0 if longest is None else (longest + 1).bit_length()
    spark = turns.sparkSession
    if not size["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    top = spark.createDataFrame([(0, size["root"], None, size["n"], 0, b"")], "depth long, conv_id long, up array<bigint>, n_convs long, words long, ends binary")
    silent = F.lit(b"").alias("ends")
    if levels:
        halves, whole = _blocks(turns, levels)
        whole = materialize(whole)
        nodes = top.union(_nodes(_cut(halves, whole), size["root"]).select(*top.columns))
        mute = conversations.join(whole, "conv_id", "left_anti").select(silent, "conv_id")
        members = whole.select(F.col("dig").alias("ends"), "conv_id").union(mute)
    else:
        nodes, members = top, conversations.select(silent, "conv_id")
    nodes = materialize(nodes)
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up")[0].alias("conv_id")).agg(F.count("*").alias("n_children"))
    full = nodes.join(children, ["depth", "conv_id"], "left").fillna(0, ["n_children"])
    full = materialize(full.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("own", (F.col("n_convs") - 1) * F.col("words")))
    sums = _graft(full, levels)
    nothing = hashlib.sha256(b"").hexdigest()
    rows = full.join(sums, ["depth", "conv_id"]).join(_strung(members), "ends", "left")
    return rows.select("conv_id", "depth", F.col("up")[0].alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(nothing)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of the rebuilt conversations."""
    turns = materialize(numbered(read_table(spark, sf_dir, "conversations")))
    return trie(*rebuilt(turns))


#: The same rows; CRC-32 is computed byte by byte with a table made of its polynomial.
ORACLE = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS pos, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS donor, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id), crc_table
), rebuilt AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM convs AS c JOIN turns AS t ON t.conv_id = c.donor AND t.pos < c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(d.n, 0)), t.role, t.text FROM convs AS c JOIN turns AS t ON t.conv_id = c.conv_id AND t.pos >= c.h LEFT JOIN convs AS d ON d.conv_id = c.donor
), seqs AS (
  SELECT conv_id, coalesce(s, []) AS s FROM convs LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS s FROM rebuilt GROUP BY conv_id) USING (conv_id)
), prefixes AS (SELECT conv_id, d, s[1:d] AS p, d = len(s) AS is_end FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM seqs)
), named AS (SELECT conv_id, d, is_end, min(conv_id) OVER w AS name, count(*) OVER w AS n, p[-1].text AS text FROM prefixes WINDOW w AS (PARTITION BY d, p)
), nodes AS (
  SELECT d, name, any_value(n) AS n, any_value(text) AS text, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '') AS ends FROM named GROUP BY d, name
), parents AS (SELECT x.d, x.name, p.name AS parent FROM nodes AS x JOIN named AS p ON p.conv_id = x.name AND p.d = x.d - 1
), children AS (SELECT d - 1 AS d, parent AS name, count(*) AS n_children FROM parents GROUP BY 1, 2
), own AS (
  SELECT d, name, n_children IS NULL AS leaf, (n - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS saved FROM nodes LEFT JOIN children USING (d, name)
), sums AS (
  SELECT a.d, a.name, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved) AS saved FROM own AS o JOIN named AS a ON a.conv_id = o.name AND a.d <= o.d GROUP BY 1, 2
)
SELECT name AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM nodes LEFT JOIN parents USING (d, name) LEFT JOIN children USING (d, name) JOIN sums USING (d, name)
"""
