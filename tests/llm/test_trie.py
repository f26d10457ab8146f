"""The conversation trie against brute force: ties, nulls, giants in ranges, merges in steps, end lists in pieces."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratefield.llm import trie
from ratefield.llm.common import Scratch
from ratefield.operators import skew

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    # SQL's remainder has the sign of the number
    whole = {c: own.get(c - int(np.fmod(c, 20)), [])[: (h := zlib.crc32(str(c).encode()) % 4)] + v[h:] for c, v in own.items()}
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    totals = {}
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        under = [totals[x] for x in children[k]]
        totals[k] = (sum(x[0] for x in under) or 1, sum(x[1] for x in under) + (len(members[k]) - 1) * words)
    ends = {k: ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(k)) for k, m in members.items()}
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), *totals[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items())


def conversations():
    rng = np.random.default_rng(12)
    rows = []
    for c in [*range(-25, 150), 400, 405, 10**12 + 7]:
        last = 0 if c % 20 else 2
        for t in range(int(rng.integers(1, 6)) - last if last == 0 or rng.random() < 0.5 else 1):
            rows.append((c, t, ["user", "assistant", None][t % 3], [f"hello {rng.integers(3)} there", "ok", None, "", " \n"][int(rng.integers(5))]))
    rows += [(c, t, "user", f"deep turn {t}") for c in (500, 501, 502) for t in range(40)] + [(502, 40, "user", "more"), (503, None, "user", "null comes first"), (503, 0, "user", "then zero")]
    return rows + [(None, 0, "user", "of no conversation"), (504, 1, "b", "tie"), (504, 1, "a", "tie"), (504, 1, "a", "tie"), (505, 0, "user", "word " * 50_000)]


def found(spark, rows, **settings):
    scratch = Scratch(spark, "trie-test")
    small = {k: v for k, v in settings.items() if k == "long_turns"}
    turns, convs = trie.rebuilt(spark.createDataFrame(rows, SCHEMA).repartition(7), scratch, **small)
    nodes, ends = trie.trie(turns, convs, scratch, **settings)
    out = nodes.join(trie.end_digests(ends, scratch), ["depth", "x", "y"], "left")
    out = out.select(*COLUMNS[:-1], F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias(COLUMNS[-1]))
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("settings", [{}, {"long_turns": 3, "fan": 2, "piece": 10}])
def test_equals_brute_force(spark, settings):
    rows = conversations()
    assert found(spark, rows, **settings) == brute(rows)


def test_many_copies(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 3000, 2) for t in range(3)] + [(c, 0, "user", f"own {c}") for c in range(2, 600, 2)]
    assert found(spark, rows, piece=100) == brute(rows)


def test_frequent_nodes_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    rows = [(c, t, "user", f"turn {t} {c % 2 * t}") for c in range(1500) for t in range(3)]
    assert found(spark, rows) == brute(rows)


def test_query_on_odd_tables(spark, tmp_path):
    rows = conversations()
    odd = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("conv", "depth", "a", "b", "words", "len", "part", "trie", "piece")})
    odd.write.parquet(f"{tmp_path}/odd/conversations.parquet")
    odd.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert sorted(map(tuple, trie.query(spark, f"{tmp_path}/odd").select(COLUMNS).collect())) == brute(rows)
    assert trie.query(spark, f"{tmp_path}/none").count() == 0
