"""Joins that stay even when one key holds much of the rows."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of facts that may be broadcast because their keys are frequent.
HOT_ROWS = 100_000


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, total: int, hot_rows: int | None = None) -> DataFrame:
    """rows with the columns of facts (one row a key; null where there is none), a null key matching a null.

    `weight` is at least the number of rows of that key and `total` at least the sum of all weights. Facts of a weight
    above total / hot_rows, so hot_rows at most, are broadcast; the rest are joined by a shuffle, in which no key then
    has more rows than that. facts are looked at beforehand: they should be a table or cheap to make.
    """
    most = max(1000, total // (hot_rows or HOT_ROWS))
    names = [c for c in facts.columns if c not in (*keys, weight)]
    renamed = facts.select(*[F.col(f"`{k}`").alias(f"key {i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in (weight, *names)])
    equal = functools.reduce(operator.and_, [rows[f"`{k}`"].eqNullSafe(renamed[f"`key {i}`"]) for i, k in enumerate(keys)])
    drop = [f"key {i}" for i in range(len(keys))]
    hot = renamed.filter(F.col(f"`{weight}`") > most).drop(weight).withColumn("is hot", F.lit(True))
    if total <= most or hot.isEmpty():
        return rows.join(renamed.drop(weight), equal, "left").drop(*drop)
    marked = rows.join(F.broadcast(hot), equal, "left").drop(*drop)
    found = marked.filter("`is hot`").drop("is hot")
    left = marked.filter("`is hot` is null").drop("is hot", *names)
    rest = renamed.filter(F.col(f"`{weight}`") <= most).drop(weight)
    equal = functools.reduce(operator.and_, [left[f"`{k}`"].eqNullSafe(rest[f"`key {i}`"]) for i, k in enumerate(keys)])
    return found.unionByName(left.join(rest, equal, "left").drop(*drop).select(found.columns))
