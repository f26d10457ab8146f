"""Quality: base rules, and the log-likelihood ratio of hashed n-grams between trusted documents and the whole corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratefield.llm.common import BLANKS, Scratch, Words, documents, slices, small_batches, task, text_bytes
from ratefield.operators.order import exact_quantiles, value_ranks

BUCKETS = 1 << 16
#: Trusted doc_ids up to this number are broadcast (9 bytes each); more are joined by a shuffle of the texts.
BROADCAST_ROWS = 1 << 21
#: The share of trusted documents, of those not learned from, that the threshold gives up; and the threshold without any.
GIVE_UP, DEFAULT = 0.005, -0.15
SMOOTH = 0.5
LEAST_WORDS, MOST_REPEATS = 50, 50  # words; per cent
SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def ngrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each word and each pair of words."""
    pairs, doc = words.windows(2)
    return (np.concatenate([words.hash, pairs]) >> np.uint64(64 - 16)).astype(np.int64), np.concatenate([words.doc, doc])


def _count(batches):
    """One row per task: its counts of all buckets in the corpus and in the trusted documents to learn from."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in slices(batches):
        bucket, doc = ngrams(Words(*text_bytes(batch.column("text")), fold=False))
        counts[0] += np.bincount(bucket, minlength=BUCKETS)
        mine = batch.column("learn").fill_null(False).to_numpy(zero_copy_only=False)
        counts[1] += np.bincount(bucket[mine[doc]], minlength=BUCKETS)
    if counts.any():
        yield pa.record_batch([pa.array([counts.tobytes()], pa.binary())], ["counts"])


def _sum(batches):
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for data in batch.column("counts").to_pylist():
            counts += np.frombuffer(data, np.int64).reshape(2, BUCKETS)
    yield pa.record_batch([pa.array([counts.tobytes()], pa.binary())], ["counts"])


def added_up(rows: DataFrame, fan: int = 32) -> np.ndarray:
    """The sum of all tasks' counts: in steps of `fan` tasks each, so that a task and the driver get `fan` rows (a megabyte each) at most."""
    parts = rows.rdd.getNumPartitions()
    while parts > fan:
        parts = -(-parts // fan)
        rows = rows.repartition(parts).mapInArrow(task(_sum), "counts binary")
    found = rows.toArrow()["counts"].to_pylist()
    return sum((np.frombuffer(x, np.int64).reshape(2, BUCKETS) for x in found), np.zeros((2, BUCKETS), np.int64))


def repeated_words(words: Words, n: int = 3) -> np.ndarray:
    """For each document the words that lie in an n-word window found twice or more in it."""
    h, doc = words.windows(n)
    first = np.flatnonzero(words.doc[: max(0, len(words.doc) - n + 1)] == words.doc[n - 1 :])
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words.doc), bool)
    for i in range(n):
        covered[first[twice] + i] = True
    return np.bincount(words.doc[covered], minlength=words.docs)


def repeated_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    lines = [x for x in (text or "").split("\n") if x.strip(BLANKS)]
    seen.update(lines)
    return len(lines) - len(seen)


def _measure(ratios):
    def run(batches):
        llr = ratios.value
        for batch in slices(batches):
            data, at = text_bytes(batch.column("text"))
            words = Words(data, at, fold=False)
            n = batch.num_rows
            inside = np.zeros(len(data) + 1, np.int64)
            within = np.zeros(len(data) + 1, np.int64)
            np.add.at(within, words.start, 1)
            np.add.at(within, words.end, -1)
            np.cumsum((np.cumsum(within)[:-1] > 0) & ((data & 0xC0) != 0x80), out=inside[1:])
            symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[data])])
            bucket, doc = ngrams(words)
            size = np.bincount(doc, minlength=n)
            total = np.bincount(doc, weights=llr[bucket], minlength=n) / np.maximum(size, 1)
            cols = [words.counts, inside[at[1:]] - inside[at[:-1]], symbols[at[1:]] - symbols[at[:-1]], np.array([repeated_lines(t) for t in batch.column("text").to_pylist()]), repeated_words(words)]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in cols), pa.array(total, mask=size == 0)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"])

    return run


def rate_quality(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): the base measures, base_failed, llr and kept.

    llr is the mean over a text's words and word pairs, hashed to 65,536 buckets, of the log ratio of the bucket's share
    among trusted documents to its share in the corpus (both with 0.5 added). Corpus counts are of all rows. A text that
    the base rules pass is kept if its llr is at least the threshold: the 0.5 % quantile over trusted documents that
    were not learned from, or -0.15 where there are none. trusted: doc_ids, all of which are used; every second one in
    rising order, from the first on, is learned from. A null or empty text has no words, all measures 0 and no llr, and fails the base rules; an llr equal to
    the threshold is kept. Rows with equal or null doc_ids, and equal rows, are measured each; long texts are read
    whole; no rows give no rows; other columns of docs don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "quality")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("n", F.lit(1))
    placed = value_ranks(scratch.table(ids, "trusted"), "doc_id").select("doc_id", (F.col("before") % 2 == 0).alias("learn"))
    placed = scratch.table(placed, "placed", narrow=True)
    few = placed.count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    marked = docs.join(small(placed), "doc_id", "left").select("text", "learn")
    raw, target = added_up(marked.mapInArrow(task(_count), "counts binary")) + SMOOTH
    # without trusted text there is nothing to tell documents apart by
    ratios = np.log(target / target.sum()) - np.log(raw / raw.sum()) if target.sum() > SMOOTH * BUCKETS else np.zeros(BUCKETS)
    ratio_of = spark.sparkContext.broadcast(ratios)
    measured = docs.mapInArrow(task(_measure(ratio_of)), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))
    measured = scratch.table(measured.withColumn("base_failed", failed), "measured")
    ratio_of.destroy()
    calibrate = measured.filter("not base_failed").join(small(placed.filter("not learn").select("doc_id")), "doc_id")
    found = exact_quantiles(calibrate, "llr", [GIVE_UP]).first()
    least = found and found["value"]
    return measured.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= F.lit(DEFAULT if least is None else least), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rate_quality(documents(spark, sf_dir), labels.filter("quality = 1").select("doc_id"))
