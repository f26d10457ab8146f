"""Passages of benchmark items in documents: a prefix-filtered containment join of item windows with document windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratefield.llm.common import IS_SIGN, KEPT, Scratch, Words, added_arrays, documents, mix64, slices, small_batches, task, text_bytes

#: Words of a window; an item of fewer, but not none, is one window.
WINDOW = 10
#: Words of a shingle.
SHINGLE = 3
#: Bytes of the benchmark's texts in one broadcast index, some 100 times as many when unpacked; more items are joined block by block.
BLOCK_BYTES = 1 << 20
_NAMES = ("n_words", "hits", "items")
_ODD = np.uint64(0x2545F4914F6CDD1D | 1)


def _words(batch: pa.RecordBatch) -> Words:
    return Words(*text_bytes(batch.column("text")), parting=IS_SIGN)


def _spell(words: Words, begin: int, end: int) -> bytes:
    """The words' bytes, lower-cased and parted by one blank."""
    data = words.data
    return b" ".join(bytes(data[a:b]) for a, b in zip(words.start[begin:end], words.end[begin:end], strict=True)).lower()


def _chained(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive word hashes."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out = out * _ODD + h[i : i + m]
    return mix64(out)


class Windows:
    """The windows of a block of items, their shingles, and the index of their necessary prefixes.

    A window of m words has m - k + 1 shingles of k = min(3, m) words. Of a window with n distinct shingles a document
    window of its size must hold at least t = ceil(share * n); so it holds one of the n - t + 1 rarest, the prefix.
    """

    def __init__(self, texts: list[str | None], window: int, shingle: int, share: float):
        words = _words(pa.record_batch([pa.array(texts, pa.string())], ["text"]))
        begin = np.concatenate([[0], np.cumsum(words.counts)])
        self.share, self.shingle = share, shingle
        self.item, self.words, self.spelt = [], [], []  # per window: its items, its words' hashes, its words
        place: dict[bytes, int] = {}
        for i, n in enumerate(words.counts.tolist()):
            size = min(window, n)
            for a in range(begin[i], begin[i] + (n - size + 1 if n else 0)):
                text = _spell(words, a, a + size)
                if text not in place:
                    place[text] = len(self.words)
                    self.words.append(words.hash[a : a + size])
                    self.spelt.append(text)
                    self.item.append([])
                if not self.item[place[text]] or self.item[place[text]][-1] != i:
                    self.item[place[text]].append(i)
        self.size = np.array([len(w) for w in self.words], np.int64)
        hashes = [_chained(w, min(shingle, len(w))) for w in self.words]
        self.tokens = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        #: Numbers of the shingles of each window, by place; -1 beyond its end.
        self.grams = np.full((len(hashes), max((len(x) for x in hashes), default=1)), -1, np.int64)
        for i, x in enumerate(hashes):
            self.grams[i, : len(x)] = np.searchsorted(self.tokens, x)
        self.lengths = np.unique(np.minimum(self.size, shingle))

    def order(self, counts: np.ndarray) -> None:
        """Order shingles by rarity (documents that hold them, then number) and index each window's prefix."""
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
        token, which, at = [], [], []
        self.least = np.ones(len(self.words), np.int64)
        for i, row in enumerate(self.grams):
            own, first = np.unique(row[row >= 0], return_index=True)
            self.least[i] = max(1, int(np.ceil(round(self.share * len(own), 9))))
            rare = np.argsort(rank[own], kind="stable")[: len(own) - self.least[i] + 1]
            token.append(own[rare])
            which.append(np.full(len(rare), i))
            at.append(first[rare])
        token, which, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (token, which, at))
        by = np.argsort(token, kind="stable")
        self.entry, self.entry_at = which[by], at[by]
        self.first = np.searchsorted(token[by], np.arange(len(self.tokens) + 1))

    def places(self, words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a shingle of n words that some window has begins in the texts, and its number."""
        h = _chained(words.hash, n)
        number = np.searchsorted(self.tokens, h)
        number[number == len(self.tokens)] = 0
        found = np.flatnonzero((self.tokens[number] == h) & (words.doc[: len(h)] == words.doc[n - 1 :])) if len(h) else np.zeros(0, np.int64)
        return found, number[found]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Windows found and the word where each begins."""
        if not len(self.tokens) or not len(words.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = [self._candidates(*self.places(words, int(n)), words) for n in self.lengths]
        which, at = (np.concatenate([x[k] for x in out]) for k in (0, 1))
        return self._exact(which, at, words) if self.share >= 1 else self._enough(which, at, words)

    def _candidates(self, found: np.ndarray, number: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
        count = self.first[number + 1] - self.first[number]
        ends = np.cumsum(count)
        entry = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(self.first[number], count)
        which, place = self.entry[entry], np.repeat(found, count)
        if self.share >= 1:
            # position: all shingles are there, so each stands where it first stands in the window
            at = place - self.entry_at[entry]
        else:
            room = self.size[which] - np.minimum(self.size[which], self.shingle) + 1
            ends = np.cumsum(room)
            back = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - room, room)
            which, at = np.repeat(which, room), np.repeat(place, room) - back
            place = np.repeat(place, room)
        # length: the window lies in the document of the shingle
        last = at + self.size[which] - 1
        inside = (at >= 0) & (last < len(words.doc))
        which, at, place, last = which[inside], at[inside], place[inside], last[inside]
        inside = (words.doc[at] == words.doc[place]) & (words.doc[last] == words.doc[place])
        both = np.unique(which[inside] * np.int64(len(words.doc)) + at[inside])
        return both // len(words.doc), both % len(words.doc)

    def _exact(self, which: np.ndarray, at: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Candidates whose words are the window's, one by one."""
        keep = np.ones(len(which), bool)
        longest = int(self.size.max())
        own = np.zeros((len(self.words), longest), np.uint64)
        for i, x in enumerate(self.words):
            own[i, : len(x)] = x
        for j in range(longest):
            still = np.flatnonzero(keep & (self.size[which] > j))
            keep[still] = words.hash[at[still] + j] == own[which[still], j]
        which, at = which[keep], at[keep]
        same = [_spell(words, a, a + n) == self.spelt[w] for w, a, n in zip(which.tolist(), at.tolist(), self.size[which].tolist(), strict=True)]
        return which[same], at[same]

    def _enough(self, which: np.ndarray, at: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Candidates whose document window holds `least` of the window's distinct shingles."""
        keep = np.zeros(len(which), bool)
        for n in self.lengths.tolist():
            number = np.full(len(words.hash), -1, np.int64)
            found, own = self.places(words, n)
            number[found] = own
            mine = np.flatnonzero(np.minimum(self.size[which], self.shingle) == n)
            for some in np.array_split(mine, max(1, len(mine) >> 14)):
                width = self.grams.shape[1]
                there = np.minimum(at[some, None] + np.arange(width), len(number) - 1)
                inside = np.arange(width) <= (self.size[which[some]] - n)[:, None]
                doc = np.where(inside, number[there], -2)
                own = np.sort(self.grams[which[some]], axis=1)
                own[:, 1:][own[:, 1:] == own[:, :-1]] = -1
                held = ((own[:, :, None] == doc[:, None, :]) & (own >= 0)[:, :, None]).any(2).sum(1)
                keep[some] = held >= self.least[which[some]]
        return which[keep], at[keep]


def _index(shared, counts=None) -> Windows:
    """The worker's index of a block, built once and kept for its next tasks."""
    key, texts, window, shingle, share, *held = shared.value
    name = f"{key}{'' if counts is None and not held else '+'}"
    known, ready = KEPT.get("windows", ("", None))
    if known != name:
        ready = Windows(texts, window, shingle, share)
        if held:
            ready.order(np.frombuffer(held[0], np.int64))
        KEPT["windows"] = (name, ready)
    return ready


def _count(shared):
    """One row a task: how many of its documents hold each shingle."""

    def run(batches):
        index = _index(shared)
        counts = np.zeros(len(index.tokens), np.int64)
        for batch in slices(batches):
            words = _words(batch)
            for n in index.lengths.tolist():
                if len(words.hash):
                    found, number = index.places(words, n)
                    held = np.unique(words.doc[found] * np.int64(len(counts)) + number)
                    counts += np.bincount(held % len(counts), minlength=len(counts))
        if counts.any():
            yield pa.record_batch([pa.array([counts.tobytes()], pa.binary())], ["counts"])

    return run


def _merged(begin: np.ndarray, end: np.ndarray) -> list[dict]:
    """Ranges that overlap or touch, as one."""
    if not len(begin):
        return []
    by = np.lexsort((end, begin))
    begin, reach = begin[by], np.maximum.accumulate(end[by])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)
    return [{"begin": a, "end": b} for a, b in zip(begin[new].tolist(), reach[last].tolist(), strict=True)]


def _search(shared, labels, columns: list[str], first: bool):
    names = [*columns, *_NAMES]
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        index, name_of = _index(shared), labels.value
        for batch in slices(batches):
            words = _words(batch)
            which, at = index.find(words)
            doc, base = words.doc[at], np.concatenate([[0], np.cumsum(words.counts)])
            by = np.argsort(doc, kind="stable")
            which, at, cut = which[by], at[by], np.searchsorted(doc[by], np.arange(batch.num_rows + 1))
            hits: list[list] = [[] for _ in range(batch.num_rows)] if first else batch.column("hits").to_pylist()
            items: list[list] = [[] for _ in range(batch.num_rows)] if first else batch.column("items").to_pylist()
            for d in np.unique(doc).tolist():
                w, a = which[cut[d] : cut[d + 1]], at[cut[d] : cut[d + 1]] - base[d]
                old = np.array([(x["begin"], x["end"]) for x in hits[d]], np.int64).reshape(-1, 2)
                hits[d] = _merged(np.concatenate([old[:, 0], a]), np.concatenate([old[:, 1], a + index.size[w]]))
                items[d] = sorted({*items[d], *(name_of[i] for x in np.unique(w).tolist() for i in index.item[x])})
            out = [pa.array(words.counts.astype(np.int64)), pa.array(hits, span), pa.array(items, pa.list_(pa.string()))]
            yield pa.record_batch([*(batch.column(c) for c in columns), *out], names)

    return run


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: float = 1.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where documents (text) hold windows of benchmark items (item_id, text).

    Returns the columns of docs and n_words, hits (array of word ranges begin, end (exclusive) that windows cover; merged,
    rising) and items (the item_ids of the windows found, as strings, sorted, each once). Words: runs of ASCII letters and
    digits and of characters beyond ASCII, A-Z lower-cased. A window is `window` consecutive words of an item; an item of
    fewer words is one window. With share 1 a window is found where all its words stand in order, compared one by one;
    below 1, where a document window of its size holds that share of its distinct shingles of `shingle` words.

    Shingles are counted over all documents and ordered by rarity. A window's prefix, its n - ceil(share * n) + 1 rarest
    shingles, is joined with the documents' shingles; the place of a shingle in the window and the document's ends leave
    few places, which are verified. The prefix index goes to all tasks, in blocks of items of `block_bytes` of text at
    most (an item is not cut): nothing is shuffled, and a document is one row whatever it holds.

    A null or empty text has no words and no hits; an item without words has no window; a null item_id counts as an empty
    string, rows with one item_id as one item. Equal rows are searched each, other columns of docs don't matter, but
    columns named n_words, hits or items are replaced. Long texts are read whole; no rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(*_NAMES)
    columns, scratch = docs.columns, Scratch(spark, "decontaminate")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "n_words long, hits array<struct<begin:bigint,end:bigint>>, items array<string>"])
    context, out = spark.sparkContext, docs
    for number, block in enumerate(_blocks(benchmark, block_bytes, scratch)):
        texts, names = block["text"].to_pylist(), [x or "" for x in block["item"].to_pylist()]
        key = (f"{scratch.path}/{number}", texts, window, shingle, share)
        shared = context.broadcast(key)
        counts = added_arrays(docs.select("text").mapInArrow(task(_count(shared), "windows"), "counts binary"))
        shared.destroy()
        if counts is None:
            counts = np.zeros(len(Windows(*key[1:]).tokens), np.int64)
        if number:
            out = scratch.table(out, f"before-{number}")
        shared, labels = context.broadcast((*key, counts.tobytes())), context.broadcast(names)
        out = out.mapInArrow(task(_search(shared, labels, columns, number == 0), "windows"), schema)
    return out


def _blocks(benchmark: DataFrame, block_bytes: int, scratch: Scratch):
    """Items in blocks of about so many bytes, each an Arrow table (item, text); at least one block."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter(F.length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    if blocks <= 1:
        yield items.toArrow()
        return
    dealt = scratch.table(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(2 * blocks))), "items")
    for b in range(2 * blocks):
        yield dealt.filter(F.col("block") == b).select("item", "text").toArrow()


def without_hits(df: DataFrame) -> DataFrame:
    """From find_items' rows those without any hit."""
    return df.filter(F.size("hits") == 0)


def query(spark, sf_dir: str) -> DataFrame:
    found = find_items(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (SELECT item_id, least(10, len(ws)) AS n, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS s FROM v),
p AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w))),
h AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM p JOIN w ON p.n = w.n AND p.s = w.s),
j AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN j ON j.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
