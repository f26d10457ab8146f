"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratefield.llm.common import Scratch, documents, give_back, small_batches, task

#: Labelled rows to learn from at most: those with the least hash of doc_id.
EXAMPLES = 6_000
NEIGHBOURS = 15
#: Votes that the share of label 1 among all examples weighs, in units of a neighbour at cosine 1.
PRIOR = 0.3
THRESHOLD = 0.3
#: Examples in a block of the index, and blocks that are looked into before others are ruled out.
BLOCK, FIRST = 64, 8
#: A term is common if one example in so many has it; texts are compared with the examples so many at a time.
COMMON, TOGETHER = 24, 64
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> Counter:
    """The terms of a text, all its words in lower case, with their numbers."""
    return Counter(_WORD.findall((text or "").lower()))


def _spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions at[i] .. at[i] + size[i] - 1, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - at, size)


class BlockMaxIndex:
    """Labelled examples as unit TF-IDF vectors, by term, in blocks of BLOCK examples with each term's largest weight there.

    A term weighs (1 + log tf) * log(1 + n / df) * log2(2 + a / max(1, df - a)): n examples, df of them with the term, a of
    these with label 1. The last factor (relevance frequency; Lan et al., 2009) is 1 for words that label 0 has alone.
    Terms that one example in COMMON or more has are multiplied out as a matrix; the others have postings. A query looks
    into the FIRST blocks by upper bound (the block's best by common terms, plus the sum of its weights times the
    largest ones there), and then into each other block whose bound reaches the k-th best cosine found: the k nearest
    are exact. Equally near examples come by number.
    """

    def __init__(self, example: np.ndarray, term: np.ndarray, tf: np.ndarray, labels: np.ndarray, ids: np.ndarray, terms: int):
        n = self.n = len(ids)
        df = np.bincount(term, minlength=terms)
        ones = np.bincount(term, weights=labels[example], minlength=terms)
        self.idf = np.log1p(n / np.maximum(df, 1)) * np.log2(2 + ones / np.maximum(1, df - ones))
        weight = (1 + np.log(tf)) * self.idf[term]
        weight /= np.sqrt(np.bincount(example, weights=weight**2, minlength=n))[example]
        # alike examples share blocks: those with one label and one strongest term, common terms counting for more
        lead = np.full(n, -1)
        by = np.lexsort((-term, weight * np.sqrt(df[term]), example))
        if len(by):
            last = np.append(example[by][1:] != example[by][:-1], True)
            lead[example[by][last]] = term[by][last]
        order = np.lexsort((ids, lead, labels))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.labels, self.ids = labels[order], ids[order]
        self.blocks = -(-n // BLOCK)
        common = df * COMMON >= max(1, n)
        self.column = np.where(common, np.cumsum(common) - 1, -1).astype(np.int32)
        self.matrix = np.zeros((int(common.sum()), self.blocks * BLOCK), np.float32)
        dense = common[term]
        self.matrix[self.column[term[dense]], place[example[dense]]] = weight[dense]
        example, term, weight = example[~dense], term[~dense], weight[~dense]
        by = np.lexsort((place[example], term))
        self.example, self.weight = place[example][by].astype(np.int32), weight[by].astype(np.float32)
        block, of = self.example // BLOCK, term[by]
        head = np.ones(len(of), bool)
        head[1:] = (of[1:] != of[:-1]) | (block[1:] != block[:-1])
        self.start = np.append(np.flatnonzero(head), len(of)).astype(np.int32)
        self.block = block[head].astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, self.start[:-1]) if len(of) else self.weight
        self.blocks_of = np.searchsorted(of[head], np.arange(terms + 1)).astype(np.int32)

    def _add(self, got: np.ndarray, entries: np.ndarray, q: np.ndarray) -> None:
        size = self.start[entries + 1] - self.start[entries]
        at = _spread(self.start[entries], size)
        got += np.bincount(self.example[at], weights=self.weight[at] * np.repeat(q, size), minlength=len(got))

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, but: list[int | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For texts with such terms and numbers of them: numbers and cosines of the k nearest examples with a cosine above 0, nearest first; without the example `but`."""
        weights, rows = [], np.zeros((len(vectors), len(self.matrix)), np.float32)
        for i, (terms, tf) in enumerate(vectors):
            q = (1 + np.log(tf)) * self.idf[terms]
            q /= max(1e-12, np.sqrt((q**2).sum()))
            column = self.column[terms]
            rows[i, column[column >= 0]] = q[column >= 0]
            weights.append((terms[column < 0], q[column < 0]))
        dense = rows @ self.matrix
        return [self._nearest(terms, q, light.astype(np.float64), k, but[i] if but else None) for i, ((terms, q), light) in enumerate(zip(weights, dense, strict=True))]

    def _nearest(self, terms: np.ndarray, q: np.ndarray, got: np.ndarray, k: int, but: int | None) -> tuple[np.ndarray, np.ndarray]:
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        size = self.blocks_of[terms + 1] - self.blocks_of[terms]
        entries, q = _spread(self.blocks_of[terms], size), np.repeat(q, size)
        block = self.block[entries]
        bound = got.reshape(-1, BLOCK).max(1)
        # weights are of single precision: a bound that is a little larger loses nothing
        bound = (bound + np.bincount(block, weights=q * self.most[entries], minlength=self.blocks)) * (1 + 1e-6)
        first = np.zeros(self.blocks, bool)
        first[np.argpartition(-bound, min(FIRST, self.blocks) - 1)[:FIRST]] = True
        use = first[block]
        self._add(got, entries[use], q[use])
        if but is not None:
            got[but] = 0.0
        seen = got.reshape(-1, BLOCK)[first].ravel()
        least = np.partition(seen, -k)[-k] if len(seen) > k else 0.0
        more = ~first & (bound >= least)
        if more.any():
            use = more[block]
            self._add(got, entries[use], q[use])
            if but is not None:
                got[but] = 0.0
            # what was ruled out isn't complete
            got.reshape(-1, BLOCK)[~first & ~more] = 0.0
        else:
            got.reshape(-1, BLOCK)[~first] = 0.0
        found = np.flatnonzero(got >= max(least - 1e-9, 1e-9))
        near = np.round(got[found], 6)
        if len(found) > k:
            kept = near >= np.partition(near, len(near) - k)[len(near) - k]
            found, near = found[kept], near[kept]
        top = np.lexsort((found, -near))[:k]
        return found[top], near[top]


def rising(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the isotonic regression of y on x (pool adjacent violators): means of x and of y, both rising."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][0] / pools[-2][2] >= pools[-1][0] / pools[-1][2]):
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Model:
    """What scoring needs; it is broadcast and as large as EXAMPLES texts' words let it be."""

    def __init__(self, terms: list[str], index: BlockMaxIndex, prior: float):
        self.number = {t: i for i, t in enumerate(terms)}
        self.index, self.prior = index, prior
        self.knots: tuple[np.ndarray, np.ndarray] | None = None

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a text's known terms in rising order, and how often it has each."""
        number = self.number
        found = sorted((i, n) for t, n in words_of(text).items() if (i := number.get(t)) is not None)
        both = np.array(found, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def votes(self, texts: list[str | None], but: list[int | None] | None = None) -> list[tuple[float, list[int], list[float]]]:
        """For each text the nearest examples' vote, weighted by cosine, against the share of label 1; and as evidence their doc_ids and cosines."""
        out = []
        for i in range(0, len(texts), TOGETHER):
            found = self.index.nearest([self.vector(t) for t in texts[i : i + TOGETHER]], but=but[i : i + TOGETHER] if but else None)
            for near, cosine in found:
                share = float((cosine * self.index.labels[near]).sum() + PRIOR * self.prior) / float(cosine.sum() + PRIOR)
                out.append((share, self.index.ids[near].tolist(), cosine.tolist()))
        return out

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int], list[float]]]:
        """The votes, calibrated to the share of label 1 that such votes have, and the evidence."""
        found = self.votes(texts)
        if self.knots is None:
            return found
        shares = np.interp([f[0] for f in found], *self.knots).tolist()
        # a text without neighbours has the prior alone, which is a share already
        return [(s if ids else self.prior, ids, cosines) for s, (_, ids, cosines) in zip(shares, found, strict=True)]


def _counted(batches):
    for batch in batches:
        found = [words_of(t) for t in batch.column("text").to_pylist()]
        terms, counts = pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))
        yield pa.record_batch([batch.column("doc_id"), batch.column("label"), terms, counts], ["doc_id", "label", "terms", "counts"])


def _votes(model):
    def run(batches):
        m = model.value
        place = {int(d): i for i, d in enumerate(m.index.ids)}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            votes = [v[0] for v in m.votes(batch.column("text").to_pylist(), [place.get(d) for d in ids])]
            yield pa.record_batch([batch.column("label"), pa.array(votes)], ["label", "vote"])

    return run


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """Learn from labels (doc_id, label 0 or 1) of docs (doc_id, text); at most `examples` of them, those with the least hash of doc_id.

    Terms are all words of all examples, of either label. The calibration is an isotonic regression of the examples'
    labels on their votes, each without itself. Of rows with one doc_id the text with the least hash is the example
    (and the largest label, if they differ); null ids and labels are left out; a null or empty text is an example
    without terms, and long texts are read whole. Without labelled documents every text scores 0.0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "toxicity")
    chosen = labels.filter("doc_id is not null and label is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("label").cast("int")).alias("label"))
    chosen = scratch.table(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples), "chosen")
    # at most `examples` rows of 12 bytes
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    sample = scratch.table(sample.select("doc_id", "label", "t.text"), "sample")
    rows = sample.mapInArrow(task(_counted), "doc_id long, label int, terms array<string>, counts array<long>").orderBy("doc_id").toArrow().combine_chunks()
    label, ids = rows["label"].to_numpy().astype(float), rows["doc_id"].to_numpy()
    size = pc.list_value_length(rows["terms"]).to_numpy().astype(np.int64)
    coded = pc.list_flatten(rows["terms"]).combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    term, tf = coded.indices.to_numpy().astype(np.int64), pc.list_flatten(rows["counts"]).to_numpy()
    index = BlockMaxIndex(np.repeat(np.arange(len(ids)), size), term, tf, label, ids, len(coded.dictionary))
    model = Model(coded.dictionary.to_pylist(), index, float(label.mean()) if len(ids) else 0.0)
    del rows, coded, term, tf, size
    give_back()
    if len(ids):
        shared = spark.sparkContext.broadcast(model)
        parts = spark.sparkContext.defaultParallelism
        votes = sample.repartition(parts, "doc_id").mapInArrow(task(_votes(shared)), "label int, vote double").toArrow()
        model.knots = rising(votes["vote"].to_numpy(), votes["label"].to_numpy().astype(float))
        shared.destroy()
    scratch.drop()
    give_back()
    return model


def _scores(model):
    def run(batches):
        m = model.value
        for batch in batches:
            found = m.scores(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array([f[0] for f in found]), pa.array([int(f[0] >= THRESHOLD) for f in found], pa.int32()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.float64()))],
                [*batch.schema.names[:-1], "score", "predicted", "nearest", "cosines"],
            )

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1), predicted (1 at 0.3 or more), and nearest and cosines (the examples that voted) to docs.

    Each row is scored by itself, so repeated rows, equal and null ids don't matter. A null or empty text, and one
    without a known word, has no neighbours and scores the share of label 1 among the examples. Long texts are read whole.
    Columns of these names are replaced; others may have any name. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("predicted", "score", "nearest", "cosines")
    schema = T.StructType([*docs.schema, *T.StructType.fromDDL("score double, predicted int, nearest array<long>, cosines array<double>")])
    text = F.col(f"`{text_col}`")
    return docs.select("*", text.alias("text of the row")).mapInArrow(task(_scores(docs.sparkSession.sparkContext.broadcast(model))), schema)


def fit_tables(spark, sf_dir: str) -> Model:
    """The model of a folder's documents and labels, without the rows that are held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    return fit(documents(spark, sf_dir), labels.select("doc_id", F.col("toxic").alias("label")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = score(docs, fit_tables(spark, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
