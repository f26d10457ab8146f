"""Document fingerprints: every shingle hash below a fixed share of the hash range."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratefield.llm.common import Words, distinct_by_doc, documents, range_bounds, range_bucket, shuffle_partitions, slices, small_batches, task, text_bytes

WORDS = 5
#: One in so many hashes is kept; README has the size and the error of likeness by the length of texts.
SCALE = 8
#: Characters that stand for a hash: its upper 48 bits, six to each of an alphabet in the order of its codes.
CHARS = 8
ALPHABET = "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
_CODES = np.frombuffer(ALPHABET.encode(), np.uint8)
_SHIFTS = np.arange(58, 10, -6, dtype=np.uint64)


def sketch_arrays(data: np.ndarray, offsets: np.ndarray, words: int = WORDS, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """The kept hashes of each text in rising order, and the offset of each text's first.

    Kept are the distinct shingle hashes below 2**64 / scale, and a text's least one if none is: so a text with a word
    has a fingerprint. merge joins fingerprints; the exception goes where another hash is kept.
    """
    h, doc = Words(data, offsets).shingles(words)
    texts = len(offsets) - 1
    low = h <= np.uint64((1 << 64) // scale - 1)
    few = np.flatnonzero((np.bincount(doc[low], minlength=texts) == 0) & (np.bincount(doc, minlength=texts) > 0))
    if len(few):
        least = np.full(texts, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, doc, h)
        low |= np.isin(doc, few) & (h == least[doc])
    return distinct_by_doc(h[low], doc[low], texts)


def as_text(h: np.ndarray) -> np.ndarray:
    """The characters of each hash, a row each; their order is that of the hashes."""
    return _CODES[((h[:, None] >> _SHIFTS) & np.uint64(63)).astype(np.int64)]


def to_text(h: np.ndarray, at: np.ndarray) -> pa.Array:
    """Each text's hashes as eight characters each, one after the other."""
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer((at * CHARS).astype(np.int64).tobytes()), pa.py_buffer(as_text(h).tobytes())]).cast(pa.string())


def _common(h1: np.ndarray, at1: np.ndarray, h2: np.ndarray, at2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of sketches: hashes in both, in the first, in the second."""
    n = len(at1) - 1
    doc = np.concatenate([np.repeat(np.arange(n), np.diff(at1)), np.repeat(np.arange(n), np.diff(at2))])
    h = np.concatenate([h1, h2])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    return np.bincount(doc[1:][same], minlength=n), np.diff(at1), np.diff(at2)


def likeness(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity; two empty sketches are alike (1), an empty one is like no other (0)."""
    union = a + b - both
    return np.where(union == 0, 1.0, both / np.maximum(union, 1))


def hashes(fingerprint: Column) -> Column:
    """The hashes of a fingerprint, as an array of strings."""
    parts = F.transform(F.sequence(F.lit(1), F.floor(F.char_length(fingerprint) / CHARS).cast("int")), lambda i: F.substr(fingerprint, (i - 1) * CHARS + 1, F.lit(CHARS)))
    return F.when(F.char_length(fingerprint) > 0, parts).otherwise(F.array().cast("array<string>"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, of two fingerprints as strings; null if a is empty. It doesn't depend on b's size."""
    return F.when(F.char_length(a) > 0, F.size(F.array_intersect(hashes(a), hashes(b))) / F.size(hashes(a)))


def merge(found: Column, scale: int = SCALE) -> Column:
    """The fingerprint of texts taken together, of an array of their fingerprints: the union.

    Of hashes at or over the threshold (least ones of texts that keep none) the least stays, if there is no other; so
    merging in any order gives what the set of all the texts' shingles has.
    """
    limit = as_text(np.array([(1 << 64) // scale], np.uint64))[0].tobytes().decode() if scale > 1 else "~"
    whole = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(found, F.isnotnull), hashes))))
    low = F.filter(whole, lambda h: h < limit)
    return F.array_join(F.when(F.size(low) > 0, low).otherwise(F.slice(whole, 1, 1)), "")


def held_in(both: np.ndarray, a: np.ndarray) -> pa.Array:
    """Estimated share of a's shingles that the other has; null for an empty sketch."""
    return pa.array(both / np.maximum(a, 1), mask=a == 0)


def _sketches(words: int, scale: int, column: str):
    def run(batches):
        for batch in slices(batches, column):
            h, at = sketch_arrays(*text_bytes(batch.column(column)), words, scale)
            yield pa.record_batch([*batch.columns, to_text(h, at)], [*batch.schema.names, "fingerprint"])

    return run


def fingerprint(docs: DataFrame, text_col: str = "text", words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Adds a fingerprint (a string of eight characters per kept hash) to docs. A null text is an empty one, whose fingerprint is "".

    Equal word sequences have equal fingerprints, whatever parts the words and the case of A-Z. Each row has its own, also
    among equal rows and ids; long texts are read whole; no rows give no rows. A column named fingerprint is replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("fingerprint")
    schema = T.StructType([*docs.schema, T.StructField("fingerprint", T.StringType())])
    return docs.mapInArrow(task(_sketches(words, scale, text_col)), schema)


def _strings(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array(texts, pa.large_string()))


def _edits(words: int, scale: int):
    """Rows (p, guest, doc_id, text) in order; guest rows stand for the first of the next range. A row for each that is no guest."""

    def rows(held: list):
        texts, edited = [x[1] for x in held], []
        following = texts[1:]
        own = held[:-1]
        for (_, text, _), after in zip(own, following, strict=True):
            cut = len(text) // 2
            edited.append(text[: len(text) - cut] + after[:cut])
        h, at = sketch_arrays(*_strings(texts), words, scale)
        eh, eat = sketch_arrays(*_strings(edited), words, scale)
        a, aat = h[: at[-2]], at[:-1]
        b, bat = h[at[1] :], at[1:] - at[1]
        edit, after = _common(a, aat, eh, eat), _common(a, aat, b, bat)
        keep = [not x[2] for x in own]
        out = pa.record_batch(
            [
                pa.array([x[0] for x in own], pa.int64()), pa.array([len(x[1]) for x in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), to_text(a, aat), to_text(eh, eat), pa.array(likeness(*edit)), pa.array(likeness(*after)),
                held_in(edit[0], edit[1]), held_in(after[0], after[1]), held_in(after[0], after[2]),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "own_in_edited", "own_in_next", "next_in_own"],
        )
        return out.filter(pa.array(keep))

    def run(batches):
        held: list[tuple] = []
        for batch in slices(batches, most=1 << 20):
            held += zip(batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()], batch.column("guest").to_pylist(), strict=True)
            if len(held) > 1:
                yield rows(held)
                held = held[-1:]

    return run


_EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, own_in_edited double, own_in_next double, next_in_own double"


def edit_likeness(docs: DataFrame, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Fingerprints of each document and of its edited text: the last half of its code points replaced by as many first ones of the next.

    The next document is that with the next doc_id (after the last: the first; null ids come first, and rows with
    equal ids follow each other by text). Documents are dealt out by ranges of doc_id; each range also gets the first
    document of the range after it as a guest. An empty document is edited to "". Besides likeness, the share of a
    document's shingles that the edited text and the next document hold, and of the next one's that it holds: these don't
    suffer where one text is much longer. A very long text is a batch of its own. No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = shuffle_partitions(spark)
    placed = docs.withColumn("p", range_bucket(F.col("doc_id"), range_bounds(docs, "doc_id", parts)))
    # the first id of each range: at most as many as there are ranges
    ids = placed.groupBy("p").agg(F.min("doc_id").alias("id"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).orderBy("p").collect()
    if not ids:
        return spark.createDataFrame([], _EDITS)
    first = {r["p"]: None if r["nulls"] else r["id"] for r in ids}
    order = sorted(first)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    ranges = [p for p in order if first[p] is not None]
    is_first = F.col("doc_id").isNull()
    if ranges:
        starts = F.map_from_arrays(F.lit(ranges), F.lit([first[p] for p in ranges]))
        is_first |= F.col("doc_id") == F.element_at(starts, F.col("p"))
    host = F.when(is_first, F.element_at(F.map_from_arrays(F.lit(order), F.lit([before[p] for p in order])), F.col("p")))
    own = F.struct(F.col("p"), F.lit(False).alias("guest"))
    copies = F.when(host.isNotNull(), F.array(own, F.struct(host.alias("p"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    rows = placed.select("doc_id", "text", F.explode(copies).alias("c")).select("c.p", "c.guest", "doc_id", "text")
    rows = rows.repartition(parts, "p").sortWithinPartitions("p", "guest", F.col("doc_id").asc_nulls_first(), "text")
    return rows.mapInArrow(task(_edits(words, scale)), _EDITS)


def query(spark, sf_dir: str) -> DataFrame:
    return edit_likeness(documents(spark, sf_dir))
