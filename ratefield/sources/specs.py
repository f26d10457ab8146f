"""Declared sources: a registry is a format, a schema and ordered steps; reading it is compiled to one plan with an audit and contracts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratefield.operators import audit
from ratefield.operators.audit import ContractError, Passage
from ratefield.operators.tables import keep_first

CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class Source:
    """A registry as a declaration.

    schema: what the files have; records that don't fit are faults unless `lenient`. steps, in order, each a tuple:
    ("keep", name, condition), ("replace", column, {old: new}), ("derive", {column: expression}), ("first", name, keys,
    order), ("explode", name, array column), ("known", column, words) or ("known", column, words, where), ("complete",
    column), ("agree", name, condition), ("rows", least), ("total", rows), ("match", crosswalk, key, out), ("select",
    columns), ("change", name, function). Conditions and orders are SQL expressions. A crosswalk is named here and given
    to load().
    """

    name: str
    format: str
    schema: str
    steps: list[tuple] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)
    rename: dict[str, str] = field(default_factory=dict)
    lenient: bool = False

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """The files' rows with the source's names; text formats keep what doesn't parse in `_corrupt_record`."""
        text = self.format in ("csv", "json") and not self.lenient
        options = ({"header": "true", "multiLine": "true", "enforceSchema": "false", "columnPruning": "false"} if self.format == "csv" else {}) | ({"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"} if text else {}) | self.options
        schema = f"{self.schema}, {CORRUPT} string" if text else self.schema
        return spark.read.format(self.format).options(**options).schema(schema).load(path).withColumnsRenamed(self.rename)

    def load(self, spark: SparkSession, path: str, crosswalks: dict[str, DataFrame] | None = None) -> Passage:
        """The compiled plan; its counts and verdicts are there once it has run (Passage.save does so)."""
        passage = Passage(self.read(spark, path), self.name, path)
        if CORRUPT in passage.rows.columns:
            audit.sound(passage, CORRUPT)
        for kind, *what in self.steps:
            _STEPS[kind](passage, crosswalks or {}, *what)
        return passage


def _replace(passage: Passage, _, column: str, words: dict[str, str]) -> None:
    passage.change(lambda df: df.replace(words, subset=[column]))


def _first(passage: Passage, _, step: str, keys: list[str], order: list[str]) -> None:
    passage.change(lambda df: keep_first(df, keys, *[F.expr(o).desc() if d else F.expr(o) for o, d in ((o.removesuffix(" desc"), o.endswith(" desc")) for o in order)]), step)


def _agree(passage: Passage, _, what: str, condition: str) -> None:
    passage.promise(what, lambda m: f"{m['n']} rows don't" if m["n"] else None, n=F.count_if(~F.coalesce(F.expr(condition), F.lit(False))))


_STEPS: dict[str, Callable] = {
    "keep": lambda p, _, step, condition: p.keep(step, F.expr(condition)),
    "replace": _replace,
    "derive": lambda p, _, columns: p.change(lambda df: df.withColumns({c: F.expr(e) for c, e in columns.items()})),
    "first": _first,
    "explode": lambda p, _, step, column: p.change(lambda df: df.select(*[c for c in df.columns if c != column], F.inline(column)), step, "explode"),
    "known": lambda p, _, column, words, where=None: audit.known(p, column, words, None if where is None else F.expr(where)),
    "complete": lambda p, _, column: audit.complete(p, column),
    "agree": _agree,
    "rows": lambda p, _, least: audit.at_least(p, least),
    "total": lambda p, _, rows: audit.exactly(p, rows),
    "match": lambda p, crosswalks, name, key, out: audit.matched(p, crosswalks[name], key, out),
    "select": lambda p, _, columns: p.change(lambda df: df.select(*columns)),
    "change": lambda p, _, step, f: p.change(f, step, "change"),
}


def best_attempt(spark: SparkSession, source: Source, paths: list[str], least: int = 0) -> tuple[str, DataFrame]:
    """Of repeated downloads of one source the one with most rows, of those that parse: (its path, attempts (path, rows, broken, digest)).

    A shorter download is a truncated part of a longer one. ContractError if none parses or none has `least` rows.
    """
    counted = None
    for path in paths:
        df = source.read(spark, path)
        # a digest of all columns, so that all of them are parsed
        whole = F.bit_xor(F.xxhash64(*[F.col(c) for c in df.columns if c != CORRUPT])).alias("digest")
        one = df.agg(F.count("*").alias("rows"), F.count(CORRUPT).alias("broken"), whole).select(F.lit(path).alias("path"), "rows", "broken", "digest")
        counted = one if counted is None else counted.unionByName(one)
    attempts = counted.collect()
    whole = [a for a in attempts if not a["broken"]]
    if not whole:
        raise ContractError(f"{source.name}: no attempt parses: {[tuple(a) for a in attempts]}")
    best = max(whole, key=lambda a: a["rows"])
    if best["rows"] < least:
        raise ContractError(f"{source.name}: {best['rows']} rows at most, {least} at least are expected: {[tuple(a) for a in attempts]}")
    return best["path"], spark.createDataFrame([tuple(a) for a in attempts], "path string, rows long, broken long, digest long")
