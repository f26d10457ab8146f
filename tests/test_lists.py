"""Identities over three lists and the three-list report, against union-find and other fits."""

from __future__ import annotations

import numpy as np
import pytest

from ratefield.operators import lists

NAMES = ["a", "b", "c"]


def brute(sizes, pairs):
    top = {(n, i): (n, i) for n in NAMES for i in range(sizes[n])}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for (n, m), found in pairs.items():
        for i, j in found:
            if i < sizes[n] and j < sizes[m]:
                top[root((n, i))] = root((m, j))
    groups = {}
    for x in top:
        groups.setdefault(root(x), []).append(x)
    out = []
    for members in groups.values():
        by = {n: sorted(i for m, i in members if m == n) for n in NAMES}
        out.append(tuple(v for n in NAMES for v in (int(bool(by[n])), by[n][0] if by[n] else -1, len(by[n]))) + (any(len(v) > 1 for v in by.values()),))
    return sorted(out)


def test_identities(spark):
    rng = np.random.default_rng(6)
    sizes = {"a": 40, "b": 30, "c": 35}
    pairs = {(n, m): [(int(i), int(j)) for i, j in zip(rng.permutation(sizes[n])[:18], rng.permutation(sizes[m])[:18], strict=True)] for n, m in (("a", "b"), ("a", "c"), ("b", "c"))}
    pairs["a", "b"] += [(1, 999), (999, 2)]
    tables = {n: spark.createDataFrame([(i,) for i in [*range(k), 3, None]], "id long") for n, k in sizes.items()}
    matches = {k: spark.createDataFrame(v + [(None, 1), (1, None)], "a_id long, b_id long") for k, v in pairs.items()}
    found = lists.identities(tables, matches)
    columns = [c for n in NAMES for c in (n, f"{n}_id", f"n_{n}")]
    got = sorted(tuple(-1 if v is None else v for v in r) for r in found.select(*columns, "ambiguous").collect())
    assert got == brute(sizes, pairs) and any(r[-1] for r in got)
    assert lists.identities({n: t.limit(0) for n, t in tables.items()}, matches).count() == 0


def test_pairs_by_block(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "id long, k string")
    b = spark.createDataFrame([(9, "x"), (7, "y"), (8, "y"), (5, None)], "id long, k string")
    assert sorted(map(tuple, lists.paired(a, b, ["k"]).collect())) == [(1, 9), (3, 7)]


CELLS = {"111": 20.0, "110": 30.0, "101": 25.0, "011": 15.0, "100": 90.0, "010": 60.0, "001": 50.0}


def test_independence_by_capture_chances():
    """Under independence the counts are N p q r; the fit solves the likelihood equations."""
    n, chances = 5000.0, (0.3, 0.2, 0.45)
    exact = {c: n * np.prod([p if k == "1" else 1 - p for k, p in zip(c, chances, strict=True)]) for c in lists.CELLS}
    got = lists.independence(exact)
    assert got["unseen"] == pytest.approx(n * 0.7 * 0.8 * 0.55, rel=1e-6) and got["lr"] == pytest.approx(0, abs=1e-6) and got["lr_p"] == pytest.approx(1, abs=1e-3)
    assert got["unseen_low"] < got["unseen"] < got["unseen_high"]
    # the profile over the unseen number: sufficient totals fix the chances, so the likelihood in N has one top
    got = lists.independence(CELLS)
    seen, totals = sum(CELLS.values()), [sum(v for k, v in CELLS.items() if k[i] == "1") for i in range(3)]
    size = np.arange(seen, 3000, 0.01)
    # Darroch's equation for the size under independence
    gap = np.abs(1 - seen / size - np.prod([1 - t / size for t in totals], axis=0))
    assert seen + got["unseen"] == pytest.approx(size[gap.argmin()], abs=0.02)


def test_report(spark):
    rows = [(*map(int, k), *map(int, k), i % 2 == 0 and k == "111") for k, v in CELLS.items() for i in range(int(v))]
    df = spark.createDataFrame(rows, "a int, b int, c int, n_a int, n_b int, n_c int, ambiguous boolean")
    r = lists.report(df, NAMES, truth=600.0).first()
    assert (r["identities"], r["ambiguous"], r["records_a"], r["both_a_b"]) == (290, 10, 165, 50)
    assert r["chapman_a_b"] == pytest.approx(166 * 126 / 51 - 1)
    unseen = 20 * 90 * 60 * 50 / (30 * 25 * 15)
    assert r["saturated"] == pytest.approx(290 + unseen) and r["term_a_b"] == pytest.approx(np.log(30 * unseen / (90 * 60)))
    assert r["independent"] == pytest.approx(290 + lists.independence(CELLS)["unseen"]) and 0.05 < r["lr_p"] < 0.07 and r["lr_df"] == 3
    assert r["error_saturated"] == pytest.approx(r["saturated"] - 600) and r["better_than_two_lists"] == (abs(r["error_saturated"]) < abs(r["error_chapman"]))
    none = lists.report(df.filter("a = 1 and b = 1"), NAMES).first()
    assert none["saturated"] is None and none["truth"] is None
    assert lists.report(df.limit(0), NAMES).first()["identities"] == 0


def test_independence_with_a_variance_rounded_below_zero(monkeypatch):
    from ratefield.operators import lists

    monkeypatch.setattr(lists.np.linalg, "pinv", lambda *a, **k: lists.np.full((4, 4), -1e-9))
    fit = lists.independence({"111": 0, "110": 0, "101": 0, "011": 0, "100": 0, "010": 0, "001": 5})
    assert fit["unseen_low"] == 0 and fit["unseen_high"] == float("inf")
