"""Packing token sequences by the histogram of lengths, shortest pack first."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratefield.llm.common import Scratch, documents, range_bounds, range_bucket, shuffle_partitions, small_batches, task
from ratefield.llm.tokens import encoder

LENGTH = 1024
END = b"\0\0\0\0"


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _measure(tokenizer: str, length: int):
    """Each document's number of tokens and the crc32 of its pieces: full ones, then the rest."""

    def run(batches):
        ids = encoder(tokenizer).ids
        for batch in batches:
            n, crcs = [], []
            for text in batch.column("text").to_pylist():
                data = ids(text) + END
                n.append(len(data) // 4)
                crcs.append([zlib.crc32(data[i : i + 4 * length]) for i in range(0, len(data), 4 * length)])
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "n", "crcs"])

    return run


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a pack's pieces) with their counts, for so many pieces of each length.

    Lengths are placed longest first; a run of equal pieces goes to the packs that are shortest among those with room,
    and to new packs where none has. Packs of one pattern are one entry with a count, so the work depends on the
    number of lengths, not of pieces: a step either uses up a length or an entry, and makes at most one entry.
    """
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = {length: []}
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = max((r for r, packs in open_packs.items() if packs), default=0)
            if room < size:
                open_packs.setdefault(length - size, []).append(((size,), left))
                break
            pattern, count = open_packs[room].pop()
            used = min(count, left)
            if used < count:
                open_packs[room].append((pattern, count - used))
            open_packs.setdefault(room - size, []).append(((*pattern, size), used))
            left -= used
    return [p for room in sorted(open_packs) for p in open_packs[room]]


def piece_slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """For each place of a pattern: length, first rank, rank after the last, sequence of the first rank, offset in the sequence."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, count in patterns:
        at = 0
        for size in pattern:
            first = ranks.get(size, 0)
            out.append((size, first, first + count, sequence, at))
            ranks[size] = first + count
            at += size
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pack docs (doc_id, text) into sequences of at most `length` tokens; a row per piece.

    A document's tokens, with an end id 0, are cut into full pieces, each a sequence of its own, and a rest. The rests'
    lengths make a histogram (at most `length` numbers, which the driver packs); each rest finds its place by its rank
    among the rests of its length. Ranks and sequence numbers come from sums by range of doc_id, so that no length's
    rests meet in one task. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset. Null and
    empty texts are the end id alone; rows with equal or null doc_ids, and equal rows, are packed each. Long texts are
    encoded whole; no rows give no pieces; other columns of docs don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "packing")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = range_bounds(docs, "doc_id", shuffle_partitions(spark))
    sized = docs.mapInArrow(task(_measure(tokenizer or _default_tokenizer(), length), "encoder"), "doc_id long, n long, crcs array<long>")
    sized = sized.withColumn("full", F.floor(F.col("n") / length)).withColumn("rest", (F.col("n") % length).cast("int")).withColumn("p", range_bucket(F.col("doc_id"), bounds))
    sized = scratch.table(sized, "sized")

    by = sized.groupBy("rest", "p").agg(F.count("*").alias("c"))
    first = by.select("rest", "p", (F.sum("c").over(Window.partitionBy("rest").orderBy("p")) - F.col("c")).alias("first"))
    fulls = sized.groupBy("p").agg(F.sum("full").alias("c"))
    begun = fulls.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("begun"))
    whole = fulls.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    histogram = {r[0]: r[1] for r in by.filter("rest > 0").groupBy("rest").agg(F.sum("c")).collect()}
    slots = spark.createDataFrame(piece_slots(shortest_pack_first(histogram, length)), "slot_rest int, lo long, hi long, sequence long, at int")

    order = [F.col("doc_id").asc_nulls_first(), "n", F.xxhash64("crcs")]
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("rest", "p").orderBy(*order)) - 1)
    ranked = ranked.withColumn("before", F.sum("full").over(Window.partitionBy("p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("full"))
    ranked = ranked.join(first, ["rest", "p"]).join(begun, "p").withColumn("rank", F.col("rank") + F.col("first")).withColumn("before", F.col("before") + F.col("begun"))
    # at most two entries for each length and step of the packing, however many documents there are
    placed = ranked.join(F.broadcast(slots), (F.col("rest") == F.col("slot_rest")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    pieces = placed.select("*", F.posexplode("crcs").alias("k", "ids_crc32"))
    rest = F.col("k") == F.col("full")
    return pieces.select(
        "doc_id",
        (F.col("k") * F.lit(length)).cast("long").alias("start"),
        F.when(rest, F.col("rest")).otherwise(length).cast("long").alias("length"),
        "ids_crc32",
        F.col("n").alias("doc_tokens"),
        F.when(rest, whole + F.col("sequence") + F.col("rank") - F.col("lo")).otherwise(F.col("before") + F.col("k")).cast("long").alias("sequence_id"),
        F.when(rest, F.col("at")).otherwise(0).cast("long").alias("offset"),
    )


def _cut(tokenizer: str):
    def run(batches):
        ids = encoder(tokenizer).ids
        for batch in batches:
            sequence, offset, out = [], [], []
            for text, pieces in zip(batch.column("text").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                data = ids(text) + END
                for x in pieces:
                    sequence.append(x["sequence_id"])
                    offset.append(x["offset"])
                    out.append(data[4 * x["start"] : 4 * (x["start"] + x["length"])])
            yield pa.record_batch([pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(out, pa.binary())], ["sequence_id", "offset", "ids"])

    return run


def sequences(docs: DataFrame, pieces: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The packed sequences: sequence_id and ids (little-endian uint32), from docs with unique doc_ids and their pieces.

    A text is encoded once, whatever its pieces. Documents without pieces, and pieces without a document, are left out.
    """
    of_doc = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    cut = docs.select("doc_id", "text").join(of_doc, "doc_id").select("text", "pieces").mapInArrow(task(_cut(tokenizer or _default_tokenizer()), "encoder"), "sequence_id long, offset long, ids binary")
    parts = cut.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
