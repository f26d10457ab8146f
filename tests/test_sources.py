"""One-pass audits, contracts that fail, declared sources and the area builder."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from ratefield.operators import audit
from ratefield.operators.areas import AreaDataset, Leg, national
from ratefield.operators.audit import ContractError, Passage
from ratefield.sources import sinks
from ratefield.sources.specs import Source, best_attempt


def test_rows_and_audit_take_one_scan(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(1000).mapInPandas(count, "id long")
    passage = audit.audited_filters(df, [("even", F.col("id") % 2 == 0), ("null drops", F.when(F.col("id") < 900, F.col("id") >= 100))], "numbers", "somewhere")
    table, events = passage.change(lambda d: d.dropDuplicates(["id"]), "repeats").save(str(tmp_path / "rows"))
    assert seen.value == 1000 and table.count() == 400 and seen.value == 1000
    got = [(r["event"], r["step"], r["before"], r["after"], r["dropped"]) for r in events.orderBy("position").collect()]
    assert got == [("fetch", "rows read", 1000, 1000, 0), ("filter", "even", 1000, 500, 500), ("filter", "null drops", 500, 400, 100), ("dedup", "repeats", 400, 400, 0)]
    for _ in range(2):
        sinks.append_audit(events, str(tmp_path / "audit"))
    back = sinks.read_audit(spark, str(tmp_path / "audit"))
    assert back.count() == 8 and {r["source"] for r in back.collect()} == {"numbers"} and back.filter("event = 'fetch'").first()["path"] == "somewhere"


def test_count_reads_no_more_than_the_steps_need(spark, tmp_path):
    spark.range(10).withColumn("wide", F.lit("x" * 50)).write.parquet(str(tmp_path / "t"))
    passage = audit.audited_filters(spark.read.parquet(str(tmp_path / "t")), [("few", F.col("id") < 3)])
    plan = passage.rows.select(F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert "wide" not in plan.split("ReadSchema")[1] and [r["after"] for r in passage.count().orderBy("position").collect()] == [10, 3]


@pytest.mark.parametrize(
    "promise,text",
    [
        (lambda p, _: audit.complete(p, "name"), "name is complete: 1 rows"),
        (lambda p, _: audit.at_least(p, 5), "3 rows, 5 at least"),
        (lambda p, _: audit.exactly(p, 4), "the source states 4"),
        (lambda p, _: audit.known(p, "kind", ["pub", "bar"]), "1 rows with others, as 'inn'"),
        (lambda p, s: audit.matched(p, s.createDataFrame([(" PUB ", 1), ("bar", 2)], "kind string, key int"), "kind", "key"), "kind is in the crosswalk: 1 rows aren't, as 'inn'"),
    ],
)
def test_contracts_fail(spark, tmp_path, promise, text):
    df = spark.createDataFrame([("a", "pub"), ("b", "bar"), (None, "inn")], "name string, kind string")
    passage = promise(Passage(df, "places"), spark)
    with pytest.raises(ContractError, match=text):
        passage.save(str(tmp_path / "rows"))
    assert not os.path.exists(tmp_path / "rows")


def test_contracts_hold(spark, tmp_path):
    df = spark.createDataFrame([("a", "pub"), ("b", "bar"), ("c", None)], "name string, kind string")
    passage = audit.known(audit.exactly(audit.at_least(audit.complete(Passage(df, "places"), "name"), 3), 3), "kind", ["pub", "bar"])
    passage = audit.known(passage, "name", ["a"], F.col("kind") == "pub")
    assert passage.save(str(tmp_path / "rows"))[0].count() == 3


def test_declared_source(spark, tmp_path):
    os.makedirs(tmp_path / "raw")
    (tmp_path / "raw/1.csv").write_text('id,st,n\n1,"Ohioo",5\n2,Ohio,6\n1,Ohio,7\n3,Iowa,8\n')
    steps = [("replace", "state", {"Ohioo": "Ohio"}), ("known", "state", ["Ohio", "Iowa"]), ("keep", "Ohio", "state = 'Ohio'"), ("first", "repeats", ["id"], ["n desc"]), ("derive", {"twice": "n * 2"}), ("total", 2)]
    source = Source("registry", "csv", "id long, st string, n int", steps, rename={"st": "state"})
    table, events = source.load(spark, str(tmp_path / "raw")).save(str(tmp_path / "rows"))
    assert sorted(map(tuple, table.select("id", "n", "twice").collect())) == [(1, 7, 14), (2, 6, 12)]
    assert [r["dropped"] for r in events.orderBy("position").collect()] == [0, 1, 1]


def test_truncated_downloads(spark, tmp_path):
    for name, text in {"a": "id,n\n1,2\n", "b": "id,n\n1,2\n2,3\n", "c": "id,n\n1,2\n2,3\n3,4\n4\n"}.items():
        os.makedirs(tmp_path / name)
        (tmp_path / name / "x.csv").write_text(text)
    source = Source("list", "csv", "id long, n int")
    paths = [str(tmp_path / n) for n in "abc"]
    assert best_attempt(spark, source, paths, 2)[0] == paths[1]
    with pytest.raises(ContractError, match="2 rows at most, 3 at least"):
        best_attempt(spark, source, paths, 3)
    with pytest.raises(ContractError, match="no attempt parses"):
        best_attempt(spark, source, paths[2:])
    with pytest.raises(ContractError, match="records parse: 1 don't"):
        source.load(spark, paths[2]).save(str(tmp_path / "rows"))


def test_stated_totals(spark, tmp_path):
    os.makedirs(tmp_path / "raw")
    (tmp_path / "raw/1.json").write_text('{"Total": 2, "Data": [{"k": 1}]}\n{"Total": 1, "Data": [{"k": 2}]}\n')
    source = Source("grid", "json", "Total int, Data array<struct<k:int>>", [("agree", "pages are whole", "size(Data) = Total"), ("explode", "rows", "Data")])
    with pytest.raises(ContractError, match="pages are whole: 1 rows don't"):
        source.load(spark, str(tmp_path / "raw")).save(str(tmp_path / "rows"))


@pytest.fixture(scope="module")
def areas(spark):
    return {
        "spine": spark.createDataFrame([(1, 100, "x"), (2, 0, "y"), (3, 50, None)], "key int, people long, note string"),
        "one": spark.createDataFrame([(9, 10, "z")], "key int, people long, note string"),
        "rows": spark.createDataFrame([(1, " Ash  Town"), (1, "ASH TOWN"), (3, "oak"), (None, "oak")], "key int, name string"),
        "odd": spark.createDataFrame([("elm",), (None,)], "name string"),
        "spots": spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (9.0, 9.0), (None, 1.0)], "x double, y double"),
    }


def test_area_dataset(spark, areas):
    cross = spark.createDataFrame([("Ash Town", 1), ("Oak", 3), ("ash town ", 1)], "name string, key int")
    squares = spark.createDataFrame([(k, [k - 1.0, float(k), float(k), k - 1.0], [0.0, 0.0, 1.0, 1.0]) for k in (1, 2, 3)], "area_id int, xs array<double>, ys array<double>")
    spec = AreaDataset("d", "spine", "key", "people", [Leg("by_key", "rows", "key"), Leg("by_name", "rows", "name", via="crosswalk"), Leg("unknown", "rows", "key", zero=False), Leg("placed", "spots", via="points")], "by_name", ["note"], benchmark=8.0, floor=60)
    built = spec.build(areas, cross, squares, cell=1.0)
    got = {r["key"]: (r["by_key"], r["by_name"], r["unknown"], r["placed"], r["by_name_rate"]) for r in built.collect()}
    assert got == {1: (2, 2, 2, 1, 2000.0), 2: (0, 0, None, 1, None), 3: (1, 2, 1, 0, 4000.0)}
    assert {r["leg"]: (r["total"], r["benchmark_pct"]) for r in spec.checkpoints(built).collect()} == {"by_key": (3, 37.5), "by_name": (4, 50.0), "unknown": (3, 37.5), "placed": (2, 25.0)}
    assert [r["key"] for r in spec.leaders(built).collect()] == [1]


def test_area_dataset_contracts(spark, areas):
    cross = spark.createDataFrame([("oak", 3)], "name string, key int")
    named = AreaDataset("d", "spine", "key", "people", [Leg("n", "odd", "name", via="crosswalk")], "n")
    with pytest.raises(ContractError, match="lacks: \\['None', 'elm'\\]"):
        named.build(areas, cross)
    single = [AreaDataset("d", s, "key", "people", [Leg("n", "rows", via="single")], "n") for s in ("one", "spine")]
    assert single[0].build(areas).first()["n"] == 4
    with pytest.raises(ContractError, match="single area"):
        single[1].build(areas)
    with pytest.raises(ContractError, match="repeats \\['1'\\]"):
        AreaDataset("d", "spine", "key", "people", [], "n").build({"spine": areas["spine"].union(areas["spine"].filter("key = 1"))})
    built = single[0].build(areas)
    both = national([(single[0], built), (named, built.withColumn("key", F.col("key") + 1))], areas["spine"].select("key", "note"), "key")
    assert both.count() == 2
    with pytest.raises(ContractError, match="more than one dataset"):
        national([(single[0], built), (named, built)], areas["spine"].select("key", "note"), "key")
