"""Benchmark passages against brute force: exact windows, shares of shingles, blocks of items and edge cases."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratefield.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def windows(items, window):
    for i, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            yield "" if i is None else str(i), w[a : a + n]


def brute(docs, items, window=10, shingle=3, share=1.0):
    out = []
    for d, text in docs:
        w, hit, held = words_of(text), set(), set()
        for i, own in set((i, tuple(x)) for i, x in windows(items, window)):
            k, n = min(shingle, len(own)), len(own)
            grams = {own[j : j + k] for j in range(n - k + 1)}
            for a in range(len(w) - n + 1):
                there = tuple(w[a : a + n])
                if there == own if share >= 1 else len(grams & {there[j : j + k] for j in range(n - k + 1)}) >= np.ceil(round(share * len(grams), 9)):
                    hit.update(range(a, a + n))
                    held.add(i)
        out.append((d, len(w), len(hit), sorted(held)))
    return out


def result(df):
    rows = df.select("doc_id", "n_words", "hits", "items").collect()
    assert all(a["end"] < b["begin"] for r in rows for a, b in zip(r["hits"], r["hits"][1:], strict=False))
    return [(r["doc_id"], r["n_words"], sum(x["end"] - x["begin"] for x in r["hits"]), r["items"]) for r in rows]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(30)] + ["ä", "Öl", "日本", "x1"]
    items = [(i, " ".join(rng.choice(vocabulary, int(n)))) for i, n in enumerate([3, 10, 11, 25, 40, 9, 1, 12])]
    items += [(20, "same same same same same same same same same same same same"), (21, items[3][1]), (22, items[3][1]), (None, "no id but words " * 3), (23, ""), (24, None), (25, "?! ...")]
    docs = [(None, None), (1, ""), (2, " \n\t"), (3, "short")]
    for d in range(4, 60):
        text = list(rng.choice(vocabulary, int(rng.integers(0, 60))))
        if d % 2:
            own = words_of(items[int(rng.integers(len(items)))][1])
            a = int(rng.integers(0, max(1, len(own) - 4)))
            at = int(rng.integers(0, len(text) + 1))
            text[at:at] = [x.upper() for x in own[a : a + int(rng.integers(4, 30))]]
        docs.append((d, ", ".join(text)))
    docs += [(70, "SAME, " * 200), (70, "SAME, " * 200), (None, items[4][1]), (71, " ".join(f"v{i}" for i in range(30_000)) + " " + items[3][1])]
    return docs, items


@pytest.mark.parametrize("share,window", [(1.0, 10), (1.0, 4), (0.7, 10), (0.5, 6)])
def test_equals_brute_force(spark, corpus, share, window):
    docs, items = corpus
    docs = docs if share == 1 else docs[:-1]
    got = decontaminate.find_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), window=window, share=share)
    assert sorted(result(got), key=repr) == sorted(brute(docs, items, window, share=share), key=repr)


def test_blocks_and_clashing_columns(spark, corpus):
    docs, items = corpus
    df = spark.createDataFrame(docs, DOCS).withColumns({"hits": F.lit("x"), "items": F.lit(1), "item_id": F.lit(2), "block": F.lit("y"), "data set": F.lit(0)})
    bench = spark.createDataFrame(items, ITEMS).withColumn("block", F.lit(0))
    one, many = (decontaminate.find_items(df, bench, block_bytes=b) for b in (1 << 20, 150))
    assert one.columns == ["doc_id", "text", "item_id", "block", "data set", "n_words", "hits", "items"]
    assert sorted(result(one), key=repr) == sorted(result(many), key=repr) == sorted(brute(docs, items), key=repr)
    clean = decontaminate.without_hits(one).count()
    assert 0 < clean < len(docs)


def test_empty_tables(spark, corpus):
    docs, items = (spark.createDataFrame(x, s) for x, s in zip(corpus, (DOCS, ITEMS), strict=True))
    assert decontaminate.find_items(docs.limit(0), items).count() == 0
    got = result(decontaminate.find_items(docs, items.limit(0)))
    assert len(got) == len(corpus[0]) and all(x[2] == 0 and x[3] == [] for x in got)


def test_query(spark, tmp_path, corpus):
    docs, items = corpus
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in brute(docs, items)]
    got = decontaminate.query(spark, str(tmp_path)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
