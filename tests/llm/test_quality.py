"""Quality: all trusted documents count."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from ratefield.llm import quality
from ratefield.llm.common import Words, text_bytes


@pytest.mark.parametrize("broadcast", [1 << 21, 100])
def test_more_trusted_documents_than_were_once_used(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality, "BROADCAST_ROWS", broadcast, raising=False)
    n = 45_000
    docs = spark.range(n).selectExpr("3 * id AS doc_id", "concat('w', id) AS text")
    got = quality.rate_quality(docs, docs.select("doc_id").union(docs.select("doc_id").limit(5))).select("doc_id", "llr").toPandas().set_index("doc_id")["llr"]
    bucket, _ = quality.ngrams(Words(*text_bytes(pa.array([f"w{i}" for i in range(n)], pa.large_string())), fold=False))
    raw, target = (np.bincount(b, minlength=quality.BUCKETS) + 0.5 for b in (bucket, bucket[::2]))
    want = (np.log(target / target.sum()) - np.log(raw / raw.sum()))[bucket]
    assert len(got) == n and np.allclose(got.loc[3 * np.arange(n)], want)


def test_a_null_id_is_not_trusted(spark):
    docs = spark.createDataFrame([(None, "one two"), (-1, "three four"), (5, "five six")], "doc_id long, text string")
    rows = {r["doc_id"]: r["llr"] for r in quality.rate_quality(docs, docs.filter("doc_id = -1").select("doc_id")).collect()}
    assert rows[None] == pytest.approx(rows[5]) and rows[-1] > rows[None]
