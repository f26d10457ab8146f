"""Mixing sources to target weights by blocks of a fixed number of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratefield.llm.common import WORD, Scratch, documents, range_bounds, range_bucket, row_hash, shuffle_partitions, word_count

BLOCK = 128
SHARD = 1024
CAP = 3.0
WEIGHTS = (1, 2, 3)
#: A draw is a number under 2**DRAW_BITS; its first CELL_BITS name the cell by which draws and sources meet.
DRAW_BITS, CELL_BITS = 48, 12
#: Shards whose counts are summed up in one group.
GROUP = 4096


def source_targets(sizes: DataFrame, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From (source, source_size): target and whole words to take. One row per source, in one task.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Resharing what is cut off by weight ends where the
    uncut ones get level * weight: sources enter by cap * size / weight, and the level is where the rest fits.
    """
    by_name, by_room = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("_room", "_i")
    out = sizes.withColumn("_i", F.row_number().over(by_name) - 1)
    out = out.withColumn("_w", F.get(F.lit(list(map(float, weights))), F.col("_i") % len(weights)))
    out = out.withColumn("_cap", cap * F.col("source_size")).withColumn("_room", F.col("_cap") / F.col("_w"))
    whole = Window.partitionBy()
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    used, over = F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    left = (F.sum("source_size").over(whole) - used) / (F.sum("_w").over(whole) - over)
    out = out.withColumn("_level", left).withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_room"), F.col("_level"))).over(whole))
    out = out.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("_w")))
    return out.select("source", "source_size", "target", F.least(F.round("target"), F.floor("_cap")).cast("long").alias("take"))


def permuted(index: Column, size: Column, key: list[Column], rounds: int = 3, walk: int = 24) -> Column:
    """A keyed permutation of 0 .. size-1 at index.

    A Feistel network on Z_a x Z_b with a = ceil(sqrt(size)), b = ceil(size / a); what falls at or over size goes
    through it again. At most a - 1 places lie over, so 24 walks are enough up to 500, and beyond that the chance that
    one doesn't end is under (1 / 22) ** 24; it would be an error, not a lost block.
    """
    start = F.struct(size.alias("n"), F.ceil(F.sqrt(size.cast("double"))).cast("long").alias("a"), F.struct(*key).alias("k"))
    start = F.struct(start["n"].alias("n"), start["a"].alias("a"), F.ceil(start["n"] / start["a"]).cast("long").alias("b"), start["k"].alias("k"))

    def once(x: Column, p: Column) -> Column:
        def turn(s, r):
            left = F.pmod(s["l"] + F.pmod(F.xxhash64(p["k"], s["r"], r, F.lit("l")), p["a"]), p["a"])
            t = F.get(F.transform(F.array(left), lambda v: F.struct(v.alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(p["k"], v, r, F.lit("r")), p["b"]), p["b"]).alias("r"))), 0)
            return t

        parts = F.struct(F.floor(x / p["b"]).cast("long").alias("l"), F.pmod(x, p["b"]).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), parts, turn, lambda s: s["l"] * p["b"] + s["r"])

    def of(p: Column) -> Column:
        first, inside = F.lit(-1).cast("long"), lambda x: (x >= 0) & (x < p["n"])
        found = lambda x: F.when(inside(x), x).otherwise(F.raise_error(F.lit("a permutation's walk did not end")).cast("long"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(walk)), first, lambda x, i: F.when(inside(x), x).otherwise(once(F.when(x < 0, index).otherwise(x), p)), found)

    return F.get(F.transform(F.array(start), of), 0)


def source_pieces(docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Sources with targets, and the pieces of documents in blocks: source, block, doc_id, begin and n (words within the document), at (in the block).

    docs: doc_id, source, text and row (a hash that tells rows of one doc_id apart). A source's documents lie end to end
    by doc_id, size and row; sums by range of doc_id come first, so that no source's rows meet in one task. p and k
    (the range, and the place there) name a row of docs, also among equal ones.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", "row", word_count(F.col("text")).alias("size"))
    bounds = range_bounds(docs, "doc_id", shuffle_partitions(spark))
    # texts are read once: sizes alone go on
    sized = scratch.table(sized.withColumn("p", range_bucket(F.col("doc_id"), bounds)), "sized")
    sums = sized.groupBy("source", "p").agg(F.sum("size").alias("n"))
    base = sums.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("p")) - F.col("n"))
    sources = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")))
    inner = Window.partitionBy("source", "p").orderBy("doc_id", "size", "row")
    placed = sized.withColumn("k", F.row_number().over(inner)).withColumn("end", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    base = base.select(F.col("source").alias("s"), F.col("p").alias("q"), "base")
    placed = placed.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("p") == F.col("q")), "left")
    placed = placed.withColumn("from", F.col("base") + F.col("end") - F.col("size"))
    first, last = F.floor(F.col("from") / block), F.floor((F.col("from") + F.col("size") - 1) / block)
    own = ["doc_id", "source", "size", "row", "p", "k"]
    cut = placed.select(*own, "from", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))).alias("block"))
    lo, hi = F.greatest(F.col("from"), F.col("block") * block), F.least(F.col("from") + F.col("size"), (F.col("block") + 1) * block)
    pieces = cut.select(*own, "block", (lo - F.col("from")).alias("begin"), (hi - lo).alias("n"), (lo - F.col("block") * block).alias("at"))
    return sources, pieces


def slot_needs(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sources that the mix takes words of, with what their slots need: name, blocks, whole (epochs taken entirely), rest (words of the last one) and slots."""
    s = sources.filter("source_size > 0 AND take > 0").withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    s = s.withColumn("whole", F.floor(F.col("take") / F.col("source_size")).cast("long")).withColumn("rest", F.col("take") - F.col("whole") * F.col("source_size"))
    # the last, shorter block may come early in the last epoch, so that one slot more is needed
    last = F.when(F.col("rest") > 0, F.least(F.ceil(F.col("rest") / block).cast("long") + 1, F.col("blocks"))).otherwise(0)
    s = s.withColumn("slots", F.col("whole") * F.col("blocks") + last).withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    return s.select("name", "source", "source_size", "blocks", "whole", "rest", "slots")


def drawn_slots(needs: DataFrame, scratch: Scratch, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """The mix's slots with their sources: shard, place, name and i (the slot's number within its source, each of 0 .. slots-1 once).

    Each slot draws its source by a keyed hash, with the sources' slots as weights, so a shard's counts are multinomial.
    The draws' sums miss the targets by their square roots; where a source was drawn too often, the slots that its
    permutation puts last go to the sources drawn too rarely.
    """
    spark = needs.sparkSession
    parts = shuffle_partitions(spark)
    order = Window.orderBy("name")
    total = needs.agg(F.sum("slots")).first()[0] or 0
    top = F.lit(float(1 << DRAW_BITS) / max(1, total))
    upto = F.sum("slots").over(order)
    bound = lambda c: F.floor(c.cast("double") * top).cast("long")
    spans = needs.select("name", bound(upto - F.col("slots")).alias("lo"), F.when(upto == total, F.lit(1 << DRAW_BITS)).otherwise(bound(upto)).alias("hi"))
    cell = lambda c: F.shiftright(c, DRAW_BITS - CELL_BITS)
    spans = spans.filter("hi > lo").withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    slots = spark.range(0, total, 1, parts).withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), 64 - DRAW_BITS))
    drawn = slots.withColumn("cell", cell(F.col("u"))).join(spans, "cell").filter("u >= lo AND u < hi")
    drawn = drawn.select(F.floor(F.col("id") / shard).cast("long").alias("shard"), F.pmod("id", F.lit(shard)).alias("place"), "name")
    drawn = scratch.table(drawn, "drawn")
    # the slot's number among its source's draws: by shard, by group of shards, and over all
    counts = drawn.groupBy("name", "shard").agg(F.count("*").alias("c")).withColumn("group", F.floor(F.col("shard") / GROUP))
    groups = counts.groupBy("name", "group").agg(F.sum("c").alias("g"))
    groups = groups.withColumn("before", F.sum("g").over(Window.partitionBy("name").orderBy("group")) - F.col("g")).drop("g")
    inner = F.sum("c").over(Window.partitionBy("name", "group").orderBy("shard")) - F.col("c")
    counts = counts.withColumn("inner", inner).join(groups, ["name", "group"]).select("name", "shard", (F.col("before") + F.col("inner")).alias("base"))
    j = F.row_number().over(Window.partitionBy("name", "shard").orderBy("place")) - 1
    # what a source has over (extra) and lacks, and where these lie end to end
    sums = drawn.groupBy("name").agg(F.count("*").alias("d"))
    sums = needs.select("name", "slots").join(sums, "name", "left").fillna(0, ["d"])
    sums = sums.withColumn("extra", F.greatest(F.lit(0), F.col("d") - F.col("slots"))).withColumn("lack", F.greatest(F.lit(0), F.col("slots") - F.col("d")))
    sums = sums.withColumn("extra_at", F.sum("extra").over(order) - F.col("extra")).withColumn("lack_at", F.sum("lack").over(order) - F.col("lack"))
    sums = scratch.table(sums, "sums", narrow=True)
    at = drawn.withColumn("j", j.cast("long")).join(counts, ["name", "shard"]).withColumn("j", F.col("j") + F.col("base")).join(sums, "name")
    at = at.withColumn("i", F.when(F.col("extra") > 0, permuted(F.col("j"), F.col("d"), [F.lit(seed), F.lit("keep"), F.col("name")])).otherwise(F.col("j")))
    at = scratch.table(at.select("shard", "place", "name", "i", "slots", "extra_at"), "numbered")
    kept = at.filter("i < slots").select("shard", "place", "name", "i")
    freed = at.filter("i >= slots").select("shard", "place", (F.col("extra_at") + F.col("i") - F.col("slots")).alias("f"))
    lacking = sums.filter("lack > 0").select(F.col("name"), F.col("lack_at").alias("lo"), (F.col("lack_at") + F.col("lack")).alias("hi"), "d")
    # cells of a thousand slots, by which freed slots and lacking sources meet
    lacking = lacking.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", 10), F.shiftright(F.col("hi") - 1, 10))))
    freed = freed.withColumn("cell", F.shiftright("f", 10)).join(lacking, "cell").filter("f >= lo AND f < hi")
    return kept.unionByName(freed.select("shard", "place", "name", (F.col("d") + F.col("f") - F.col("lo")).alias("i")))


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Mix docs (doc_id, source, text): the sources with targets, and the mix's pieces.

    Slot i of a source, in epoch i div blocks, holds the block that the source's and epoch's permutation has at i mod
    blocks; slots find their blocks by index. In the last epoch the last slot takes as many words as the target lacks.
    A piece: doc_id, source, size, row, p, k (which name the row, also among equal ones), the source's block, shard,
    place, copy, begin (word of the document), taken (words). A document without words has one piece with taken 0 and no
    block, as has one in a block that the mix leaves out. The same rows and seed give the same mix. Null and empty texts
    have size 0; a null source is a source of its own; rows with equal or null doc_ids, and equal rows, are mixed each.
    No rows give no pieces. docs may have row, a hash that tells rows apart; else that of all columns is taken.
    """
    if "row" not in docs.columns:
        docs = docs.select(F.col("doc_id"), "source", "text", row_hash(docs).alias("row"))
    scratch = Scratch(docs.sparkSession, "mix")
    sources, pieces = source_pieces(docs, scratch, block)
    sources = scratch.table(sources, "sources", narrow=True)
    needs = scratch.table(slot_needs(sources, block), "needs", narrow=True)
    slots = drawn_slots(needs, scratch, shard, seed).join(needs, "name")
    slots = slots.withColumn("copy", F.floor(F.col("i") / F.col("blocks")).cast("long")).withColumn("pos", F.pmod("i", "blocks"))
    slots = slots.withColumn("block", permuted(F.col("pos"), F.col("blocks"), [F.lit(seed), F.col("name"), F.col("copy")]))
    slots = slots.withColumn("length", F.least(F.lit(block), F.col("source_size") - F.col("block") * block).cast("long"))
    slots = scratch.table(slots.select("name", "source", "block", "shard", "place", "copy", "pos", "whole", "rest", "length"), "slots")
    # words before the slot in its epoch: the short block counts for less in the slots behind it
    short = slots.filter(F.col("length") < block).select("name", "copy", F.col("pos").alias("short_pos"), F.col("length").alias("short_length"))
    slots = slots.join(short, ["name", "copy"], "left")
    done = F.col("pos") * block - F.when(F.col("short_pos") < F.col("pos"), block - F.col("short_length")).otherwise(0)
    allowed = F.when(F.col("copy") < F.col("whole"), F.col("length")).otherwise(F.least(F.col("length"), F.greatest(F.lit(0), F.col("rest") - done)))
    slots = slots.select(F.col("source").alias("s"), F.col("block").alias("b"), "shard", "place", "copy", allowed.alias("allowed")).filter("allowed > 0")
    both = pieces.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    part = F.greatest(F.lit(0), F.least(F.col("n"), F.col("allowed") - F.col("at")))
    taken = F.when(F.col("allowed").isNull(), 0).otherwise(part).cast("long")
    return sources, both.select("doc_id", "source", "size", "row", "p", "k", "block", "shard", "place", "copy", "begin", taken.alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The mix as documents: docs' rows (doc_id, source, text, others) with the words that the mix takes, a row per copy.

    Copy k of a document has the words of its blocks that are taken for the k-th time, with the blanks behind them. A
    document of which nothing is taken goes, as does one without words (null or empty). n_chars, if there, is that of
    the new text. Rows with equal or null doc_ids, and equal rows, each give what is taken of them. Names of other
    columns don't matter; no rows give no rows.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "source", "text", row_hash(docs).alias("row"))
    _, pieces = mix(whole.select("doc_id", "source", "text", "row"), block, seed=seed)
    # a run list has at most a document's blocks
    runs = pieces.filter("taken > 0").groupBy("row", "source", "p", "k", "copy").agg(F.array_sort(F.collect_list(F.struct("begin", "taken"))).alias("runs"))
    # equal rows are one text, which as many runs find as there are rows
    both = whole.select("row", "doc").dropDuplicates(["row"]).join(runs.select("row", "runs"), "row")
    words = F.regexp_extract_all(F.col("doc.text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    # an array of one lets the words be found once
    part = lambda w: F.array_join(F.flatten(F.transform("runs", lambda x: F.slice(w, (x["begin"] + 1).cast("int"), x["taken"].cast("int")))), "")
    out = both.select("doc", F.get(F.transform(F.array(words), part), 0).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    sources, pieces = mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    took = pieces.groupBy("doc_id", "source", "size", "row", "p", "k").agg(F.sum("taken").alias("taken"))
    sources = sources.select(F.col("source").alias("s"), "source_size", "target")
    return took.join(sources, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", "taken")
