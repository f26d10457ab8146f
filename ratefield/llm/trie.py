"""The prefix trie of conversations: partial tries of node tables, merged by hash, then rolled up from the leaves."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratefield.llm.common import Scratch, range_bounds, range_bucket, small_batches, task, word_count
from ratefield.operators.skew import HOT_ROWS, join_facts

#: Partial tries that one merge takes together.
FAN = 64
#: A conversation of more turns is numbered and hashed in ranges instead of one window.
LONG_TURNS = 1 << 17
#: Conversations whose ids make one piece of an end list.
PIECE = 4096
_NODE = ["depth", "x", "y"]


def crc32_mod(value: Column, n: int) -> Column:
    return (F.crc32(F.encode(value.cast("string"), "UTF-8")) % n).cast("int")


def running(df: DataFrame, key: str, order: list[str], scratch: Scratch, name: str, giants: DataFrame | None, **values: Column) -> DataFrame:
    """df with a running bit_xor or count of each value over the rows of a key in order.

    values: columns to xor; None counts rows. Keys of giants are cut into ranges of their order: each range is summed up
    alone, and what the ranges before it come to is added; other keys are a window each.
    """

    def over(rows: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("*", *[(F.count("*") if v is None else F.bit_xor(v)).over(w).alias(n) for n, v in values.items()])

    if giants is None:
        return over(df, key)
    parts = max(2, df.sparkSession.sparkContext.defaultParallelism * 4)
    cut = df.join(F.broadcast(giants.select(key)), key, "left_semi").repartitionByRange(parts, key, *order).withColumn("part", F.spark_partition_id())
    cut = scratch.table(cut, f"{name}-ranges")
    # a row a range and giant; giants are few
    sums = cut.groupBy(key, "part").agg(*[(F.count("*") if v is None else F.bit_xor(v)).alias(f"{n} before") for n, v in values.items()])
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "part", *[F.coalesce((F.sum if v is None else F.bit_xor)(f"{n} before").over(before), F.lit(0)).alias(f"{n} before") for n, v in values.items()])
    long = over(cut, key, "part").join(F.broadcast(sums), [key, "part"])
    long = long.withColumns({n: F.col(n) + F.col(f"{n} before") if v is None else F.col(n).bitwiseXOR(F.col(f"{n} before")) for n, v in values.items()})
    rest = over(df.join(F.broadcast(giants.select(key)), key, "left_anti"), key)
    return rest.unionByName(long.select(rest.columns))


def numbered_turns(turns: DataFrame, scratch: Scratch, long_turns: int = LONG_TURNS) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """From (conv_id, turn, role, text): each turn's position in its conversation, with two hashes and its words; conversations with their number of turns; those of over long_turns turns, if any.

    Turns go by turn (null first), then role, then the text's hashes; a null role or text is an empty one. Rows without conv_id are of no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(text, F.lit(7), role).alias("b"), word_count(text).alias("words")
    )
    rows = scratch.table(rows, "turns")
    convs = scratch.table(rows.groupBy("conv").agg(F.count("*").alias("n")), "convs")
    total, most = convs.agg(F.sum("n"), F.max("n")).first()
    # at most total / long_turns of them
    giants = convs.filter(F.col("n") > max(long_turns, (total or 0) // HOT_ROWS)) if (most or 0) > long_turns else None
    return running(rows, "conv", ["turn", "role", "a", "b"], scratch, "order", giants, pos=None).drop("turn", "role"), convs, giants


def rebuilt(turns: DataFrame, scratch: Scratch, every: int = 20, most_heads: int = 4, long_turns: int = LONG_TURNS) -> tuple[DataFrame, DataFrame]:
    """Each conversation c begins with the first h = crc32(c) % most_heads turns of conversation c - c % every, and goes on with its own after its first h.

    Returns turns (conv, depth from 1, a, b, words, len) and conversations (conv, len).
    """
    rows, convs, giants = numbered_turns(turns, scratch, long_turns)
    rows = scratch.table(rows, "numbered")
    h, base = crc32_mod(F.col("conv"), most_heads).cast("long"), F.col("conv") - F.col("conv") % every
    known = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.select("conv", "n", h.alias("h"), base.alias("base")).join(known, "base", "left")
    convs = convs.withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("len", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = scratch.table(convs.select("conv", "base", "n", "h", "m", "len"), "lengths")
    total = convs.agg(F.sum("n")).first()[0] or 0
    own = join_facts(rows, convs.select("conv", "h", "m", "len", "n"), ["conv"], "n", total).filter("pos > h")
    own = own.select("conv", (F.col("m") + F.col("pos") - F.col("h")).alias("depth"), "a", "b", "words", "len")
    # a base has most_heads - 1 heads at most, and `every` conversations
    heads = rows.filter((F.col("pos") < most_heads) & (F.col("conv") % every == 0)).select(F.col("conv").alias("base"), "pos", "a", "b", "words")
    first = convs.filter("m > 0").join(heads, "base").filter("pos <= m").select("conv", F.col("pos").alias("depth"), "a", "b", "words", "len")
    return own.unionByName(first), convs.select("conv", "len")


def merged(rows: DataFrame, keys: list[str], fan: int, scratch: Scratch, name: str, **values: Column) -> DataFrame:
    """Partial tries merged until one is left: each partition's rows are combined by key, then those of `fan` partial tries at a time, dealt by the key's hash.

    values: aggregates over columns of their own names, so that they can be taken again.
    """
    parts = rows.rdd.getNumPartitions()
    rows, step = rows.withColumn("trie", F.spark_partition_id()), 0
    while parts > fan:
        parts = -(-parts // fan)
        rows = rows.withColumn("trie", F.floor(F.col("trie") / fan).cast("int")).groupBy(*keys, "trie").agg(*[v.alias(n) for n, v in values.items()])
        rows, step = scratch.table(rows, f"{name}-{step}"), step + 1
    return rows.groupBy(*keys).agg(*[v.alias(n) for n, v in values.items()])


def trie(turns: DataFrame, convs: DataFrame, scratch: Scratch | None = None, fan: int = FAN, piece: int = PIECE, long_turns: int = LONG_TURNS) -> tuple[DataFrame, DataFrame]:
    """The prefix trie of sequences: nodes and end lists.

    turns: conv, depth (1, 2, ...), a, b (two hashes of the turn), words, len (turns of its sequence); convs: conv, len
    for every sequence, empty ones included. A node stands for a distinct sequence of first turns; the root for none.
    nodes: depth, x, y (a key of the node: 128 bits of hash over places and turns), conv_id (least member), parent_conv_id
    (its parent's; root: null), n_convs, n_children, n_leaves (nodes without children in its subtree, itself included),
    words (of its last turn), saved_tokens ((n_convs - 1) * words, over its subtree). ends: depth, x, y, piece, ids: the
    members that end at a node, in rising order, at most about `piece` a row; pieces are in order as well.
    Without sequences there is no node.

    Each partition's turns are combined to a partial trie; tries are merged by node in steps of `fan`. Sums over subtrees
    double their reach at each step, so that a deep trie takes the logarithm of its depth in steps. Only nodes with two
    members or more take part; a node with one member has one leaf and saves nothing.
    """
    spark = convs.sparkSession
    scratch = scratch or Scratch(spark, "trie")
    n, least, longest, total = convs.agg(F.count("*"), F.min("conv"), F.max("len"), F.sum("len")).first()
    # places enter the hash, so the xor over places tells sequences apart
    hashed = turns.select("conv", "depth", "words", "len", F.xxhash64("depth", "a", "b").alias("hx"), F.xxhash64("b", "depth", "a").alias("hy"))
    giants = convs.filter(F.col("len") > max(long_turns, (total or 0) // HOT_ROWS)) if (longest or 0) > long_turns else None
    paths = running(hashed, "conv", ["depth"], scratch, "paths", giants, x=F.col("hx"), y=F.col("hy"))
    paths = scratch.table(paths.select("conv", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("hx")).alias("px"), F.col("y").bitwiseXOR(F.col("hy")).alias("py"), "words", "len"), "paths")
    first = {c: F.max(c) for c in ("px", "py", "words")}
    nodes = merged(paths.select(*_NODE, "px", "py", "words", F.col("conv").alias("least"), F.lit(1).cast("long").alias("n")), _NODE, fan, scratch, "nodes", n=F.sum("n"), least=F.min("least"), **first)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n"), F.min("conv").alias("least")).filter("n > 0").select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "n", "least", *[F.lit(None).cast("long").alias(c) for c in ("px", "py")], zero.alias("words"))
    nodes = scratch.table(nodes.withColumn("depth", F.col("depth").cast("long")).select(root.columns).unionByName(root), "nodes")
    below = nodes.filter("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n") == 1).alias("single"))
    nodes = nodes.join(below, _NODE, "left").fillna(0, ["n_children", "single"])
    own = F.when(F.col("n") > 1, F.col("single") + (F.col("n_children") == 0).cast("long"))
    nodes = scratch.table(nodes.withColumns({"leaves": own, "saved": (F.col("n") - 1) * F.col("words")}), "counted")
    shared = nodes.filter("n > 1").select(*_NODE, "least", "leaves", "saved")
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    # the ancestor `reach` above a node is on the path of the node's least member
    mine = paths.join(shared.select(F.col("least").alias("conv")).distinct(), "conv", "left_semi").filter(F.col("depth") <= deepest).select(F.col("conv").alias("least"), F.col("depth").cast("long").alias("depth"), "x", "y")
    mine = scratch.table(mine, "ways")
    reach, step = 1, 0
    while reach <= deepest:
        up = mine.select("least", (F.col("depth") + reach).alias("depth"), F.col("x").alias("ax"), F.col("y").alias("ay"))
        under = shared.filter(F.col("depth") >= reach).join(up, ["least", "depth"], "left")
        added = under.groupBy((F.col("depth") - reach).alias("depth"), F.coalesce("ax", F.lit(0)).alias("x"), F.coalesce("ay", F.lit(0)).alias("y")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        shared = shared.join(added, _NODE, "left").select(*_NODE, "least", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        shared, reach, step = scratch.table(shared, f"rolled-{step}"), 2 * reach, step + 1
    done = nodes.drop("leaves", "saved").join(shared.select(*_NODE, "leaves", "saved"), _NODE, "left")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("least").alias("parent_conv_id"), "n")
    inner = join_facts(done.filter("depth > 0"), parents.withColumnRenamed("n", "members"), ["depth", "px", "py"], "members", (total or 0) + (n or 0))
    done = inner.unionByName(done.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(inner.columns))
    done = done.select(*_NODE, F.col("least").alias("conv_id"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), "words", F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"))

    bounds = range_bounds(convs, "conv", (n or 0) // piece + 1)
    last = paths.filter("depth = len").select(F.col("depth").cast("long").alias("depth"), "x", "y", "conv")
    last = last.unionByName(convs.filter("len = 0").select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv"))
    last = last.select(*_NODE, range_bucket(F.col("conv"), bounds).alias("piece"), F.array("conv").alias("ids"))
    ends = merged(last, [*_NODE, "piece"], fan, scratch, "ends", ids=F.flatten(F.collect_list("ids")))
    return done, ends.withColumn("ids", F.array_sort("ids"))


def _digests(batches):
    """Rows come by node and piece: the hash goes on over a node's pieces."""
    node, state, out = None, None, []

    def flush():
        rows = [(*n, s.hexdigest()) for n, s in out]
        return pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], ["depth", "x", "y", "sha"])

    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids")), strict=True):
            if key != node:
                if state is not None:
                    out.append((node, state))
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(map(str, ids)).encode())
        if len(out) >= 1000:
            yield flush()
            out = []
    if state is not None:
        out.append((node, state))
    if out:
        yield flush()


def end_digests(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """SHA-256 of each node's end list as decimals with commas. A list of one piece is hashed in place; one of several pieces streams, sorted, through one task (the hash is sequential), a piece at a time."""
    small_batches(ends.sparkSession, 200)
    ends = scratch.table(ends, "end-lists")
    pieces = ends.groupBy(*_NODE).agg(F.count("*").alias("pieces")).filter("pieces > 1").drop("pieces")
    single = ends.join(pieces, _NODE, "left_anti").select(*_NODE, F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256).alias("sha"))
    several = ends.join(pieces, _NODE, "left_semi").repartition(*_NODE).sortWithinPartitions(*_NODE, "piece").select(*_NODE, "ids")
    return single.unionByName(several.mapInArrow(task(_digests), "depth long, x long, y long, sha string"))


def query(spark, sf_dir: str) -> DataFrame:
    """Nodes of the rebuilt conversations. Null turns come first; turns of one number go by role, then by hash; rows without conv_id are left out; other columns don't matter."""
    scratch = Scratch(spark, "conversations")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows, convs = rebuilt(turns, scratch)
    nodes, ends = trie(rows, convs, scratch)
    none = hashlib.sha256(b"").hexdigest()
    found = nodes.join(end_digests(ends, scratch), _NODE, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(none)).alias("ends_sha256"))


#: crc32 of a number's digits by its definition, a bit at a time. Turns of one number go by their text here; no such turns are in the tables.
ORACLE = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, c - c % 20 AS base, CAST(xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
  lambda crc, b: list_reduce(list_concat([xor(crc, b)], list_transform(range(8), lambda z: CAST(0 AS UBIGINT))), lambda v, z: xor(v >> 1, (v & 1) * CAST(3988292384 AS UBIGINT)))), CAST(4294967295 AS UBIGINT)) % 4 AS BIGINT) AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT c.c, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.c = c.base AND t.pos <= c.h UNION ALL SELECT c.c, 1, t.pos, t.role, t.text FROM c JOIN t ON t.c = c.c AND t.pos > c.h),
s AS (SELECT c, row_number() OVER w AS d, sha256(string_agg(sha256(role) || sha256(text), '' ) OVER w) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, count(*) OVER (PARTITION BY c) AS n FROM r WINDOW w AS (PARTITION BY c ORDER BY part, pos)),
p AS (SELECT c, d, k, words, n FROM s UNION ALL SELECT c.c, 0, '', 0, (SELECT count(*) FROM r WHERE r.c = c.c) FROM c),
g AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, string_agg(CASE WHEN d = n THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends FROM p GROUP BY d, k),
e AS (SELECT g.d, g.k, q.d AS pd, q.k AS pk FROM g JOIN p q ON q.c = g.conv_id AND q.d <= g.d),
f AS (SELECT pd, pk, count(*) AS n FROM e WHERE pd = d - 1 GROUP BY pd, pk),
v AS (SELECT g.*, coalesce(f.n, 0) AS n_children FROM g LEFT JOIN f ON f.pd = g.d AND f.pk = g.k),
u AS (SELECT e.pd, e.pk, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved FROM e JOIN v ON v.d = e.d AND v.k = e.k GROUP BY e.pd, e.pk)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs, CAST(v.n_children AS BIGINT) AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN u ON u.pd = v.d AND u.pk = v.k LEFT JOIN e ON e.d = v.d AND e.k = v.k AND e.pd = v.d - 1 LEFT JOIN g q ON q.d = e.pd AND q.k = e.pk
"""
