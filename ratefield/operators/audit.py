"""Filters, dedups and contracts that are counted while the rows pass: one scan gives the rows, the audit and the verdicts."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: One schema for all events of a run.
EVENTS = "at timestamp, source string, event string, position int, step string, before long, after long, dropped long, path string, notes string"


class ContractError(ValueError):
    """A table breaks what its source promises."""


class Passage:
    """A table on its way through steps. `rows` is the plan; counts exist once its first action has run.

    Each step is observed in the plan (Observation), so rows and counts come from the same scan. A condition that is
    null drops the row, as a filter does. Steps may have any name, also equal ones. If an executor is lost, tasks before
    a dedup that run again are counted again; the last count is always that of the rows that came out.
    """

    def __init__(self, df: DataFrame, source: str, path: str = "", notes: str = ""):
        self.source, self.path, self.notes, self.rows = source, path, notes, df
        self._seen: list[tuple[str, str, Observation]] = []
        self._contracts: list[tuple[str, Observation, Callable[[dict], str | None]]] = []
        self._observe("fetch", notes or "rows read")

    def _observe(self, event: str, step: str) -> None:
        seen = Observation()
        self.rows = self.rows.observe(seen, F.count(F.lit(1)).alias("n"))
        self._seen.append((event, step, seen))

    def keep(self, step: str, condition: Column) -> Passage:
        """Rows where the condition holds stay."""
        self.rows = self.rows.filter(condition)
        self._observe("filter", step)
        return self

    def change(self, f: Callable[[DataFrame], DataFrame], step: str = "", event: str = "dedup") -> Passage:
        """Any further step, as a dedup or a derived column; counted if it has a name."""
        self.rows = f(self.rows)
        if step:
            self._observe(event, step)
        return self

    def promise(self, what: str, verdict: Callable[[dict], str | None], **measures: Column) -> Passage:
        """A contract over all rows at this point: measures are aggregates, the verdict is the fault in words or None."""
        seen = Observation()
        self.rows = self.rows.observe(seen, *[m.alias(k) for k, m in measures.items()])
        self._contracts.append((what, seen, verdict))
        return self

    def events(self) -> DataFrame:
        """Fetch, filter and dedup events with counts before and after; waits for an action on rows."""
        counts = [s.get["n"] for _, _, s in self._seen]
        at = datetime.datetime.now(datetime.UTC)
        out = [(at, self.source, event, i, step, counts[max(i - 1, 0)], n, counts[max(i - 1, 0)] - n, self.path, self.notes) for i, ((event, step, _), n) in enumerate(zip(self._seen, counts, strict=True))]
        return self.rows.sparkSession.createDataFrame(out, EVENTS)

    def count(self) -> DataFrame:
        """The events alone: one scan of the columns that the steps need."""
        self.rows.select(F.lit(1)).write.format("noop").mode("overwrite").save()
        return self.events()

    def faults(self) -> list[str]:
        """What the rows broke; waits for an action on rows."""
        found = [(what, verdict(dict(seen.get))) for what, seen, verdict in self._contracts]
        return [f"{self.source}: {what}: {fault}" for what, fault in found if fault]

    def save(self, path: str, **options: str) -> tuple[DataFrame, DataFrame]:
        """Write the rows as Parquet: (the written table, its events). If a contract is broken the table is deleted and ContractError raised."""
        spark = self.rows.sparkSession
        schema = self.rows.schema
        self.rows.write.mode("overwrite").options(**options).parquet(path)
        if broken := self.faults():
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            raise ContractError("; ".join(broken))
        return spark.read.schema(schema).parquet(path), self.events()


def audited_filters(df: DataFrame, steps: list[tuple[str, Column]], source: str = "", path: str = "") -> Passage:
    """df through filters in order, counted as rows pass."""
    passage = Passage(df, source, path)
    for step, condition in steps:
        passage.keep(step, condition)
    return passage


# Contracts.


def complete(passage: Passage, column: str) -> Passage:
    """No value of a column is missing."""
    return passage.promise(f"{column} is complete", lambda m: f"{m['n']} rows without it" if m["n"] else None, n=F.count_if(F.col(column).isNull()))


def at_least(passage: Passage, rows: int) -> Passage:
    """A floor of rows: fewer mean a truncated read."""
    return passage.promise("rows", lambda m: f"{m['n']} rows, {rows} at least are expected" if m["n"] < rows else None, n=F.count(F.lit(1)))


def exactly(passage: Passage, rows: int) -> Passage:
    """The number of rows that the source itself states."""
    return passage.promise("rows", lambda m: f"{m['n']} rows, the source states {rows}" if m["n"] != rows else None, n=F.count(F.lit(1)))


def known(passage: Passage, column: str, words: list[str], where: Column | None = None) -> Passage:
    """A closed vocabulary: values outside it are to be classified by hand first. Nulls aren't values."""
    odd = F.col(column).isNotNull() & ~F.col(column).isin(words) & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
    example = F.min(F.when(odd, F.col(column).cast("string")))
    return passage.promise(f"{column} is a known word", lambda m: f"{m['n']} rows with others, as {m['example']!r}" if m["n"] else None, n=F.count_if(odd), example=example)


def sound(passage: Passage, corrupt: str = "_corrupt_record") -> Passage:
    """No record failed to parse; the column is dropped after the count."""
    passage.promise("records parse", lambda m: f"{m['n']} don't, as {m['example']!r}" if m["n"] else None, n=F.count(corrupt), example=F.min(F.substring(corrupt, 1, 80)))
    return passage.change(lambda df: df.drop(corrupt))


def matched(passage: Passage, crosswalk: DataFrame, key: str, out: str, normal: Callable[[Column], Column] = lambda c: F.lower(F.btrim(c))) -> Passage:
    """Adds `out` from crosswalk (key, out) by the normalised key; a key that the crosswalk lacks is a fault. A crosswalk's keys are told apart by their normal form; of equal ones the least `out` counts."""
    look = crosswalk.select(normal(F.col(key)).alias("_key"), F.col(out)).groupBy("_key").agg(F.min(out).alias(out))
    passage.change(lambda df: df.withColumn("_own", normal(F.col(key))).join(F.broadcast(look) if look.count() <= 100_000 else look, F.col("_own") == F.col("_key"), "left").drop("_own", "_key"))
    lost = F.col(out).isNull()
    return passage.promise(f"{key} is in the crosswalk", lambda m: f"{m['n']} rows aren't, as {m['example']!r}" if m["n"] else None, n=F.count_if(lost), example=F.min(F.when(lost, F.col(key).cast("string"))))
