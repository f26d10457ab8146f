"""Readers with explicit schemas: files of registries, nested JSON and text extracts become tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratefield.functions.text import strip_tags


def latest_snapshot(spark: SparkSession, pattern: str) -> str:
    """The last path, by name, that matches; snapshots are stamped in their names."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(s.getPath().toString() for s in found or [])
    if not names:
        raise FileNotFoundError(pattern)
    return names[-1]


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """Named, located elements of a map extract: nodes have their own place, ways that of their centre."""
    element = "array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
    rows = spark.read.option("multiLine", "true").schema(f"elements {element}").json(path).select(F.inline("elements"))
    out = rows.select(F.concat_ws("/", "type", F.col("id").cast("string")).alias("id"), F.element_at("tags", F.lit("name")).alias("name"), F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"), "tags")
    return out.filter("name is not null and lat is not null and lon is not null")


def array_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of arrays whose first row names the columns, as strings; an empty file gives no rows of the schema."""
    names = [c.split()[0] for c in schema.split(",")]
    text = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", "array<array<string>>").alias("t"))
    head = F.get(F.col("t"), 0)
    rows = text.filter(F.size("t") > 0).select(head.alias("h"), F.explode(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))).alias("r"))
    picked = rows.select(*[F.get(F.col("r"), (F.array_position("h", n) - 1).cast("int")).alias(n) for n in names])
    typed = spark.createDataFrame([], schema).schema
    return picked.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in typed])


def table_cells(pages: DataFrame, html: str, key: str, width: int, header: int = 0) -> DataFrame:
    """Rows of an HTML table's cells: (key, row, cells), after the header's cells. Cells that don't fill their last row fail the job."""
    cells = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    body = pages.select(key, F.slice(cells, header + 1, F.greatest(F.size(cells) - header, F.lit(0))).alias("c")).filter(F.size("c") > 0)
    ok = F.when(F.size("c") % width == 0, F.col("c")).otherwise(F.raise_error(F.lit("a table's cells don't fill its rows")).cast("array<string>"))
    each = body.select(key, F.posexplode(ok).alias("p", "cell")).select(key, F.floor(F.col("p") / width).alias("row"), F.col("p"), strip_tags(F.col("cell")).alias("cell"))
    return each.groupBy(key, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "cell"))), lambda x: x["cell"]).alias("cells"))


def anchored_lines(texts: DataFrame, key: str, text: str, is_anchor: Callable[[Column], Column], offsets: dict[str, int]) -> DataFrame:
    """Records of a text extract: for each anchor line, fields at fixed offsets before it (negative) or after it."""
    lines = texts.select(key, F.posexplode(F.split(F.col(text), "\r?\n")).alias("n", "line"))
    w = Window.partitionBy(key).orderBy("n")
    wide = lines.select(key, "n", "line", *[(F.lag("line", -o).over(w) if o < 0 else F.lead("line", o).over(w)).alias(name) for name, o in offsets.items()])
    return wide.filter(is_anchor(F.col("line"))).withColumnRenamed("line", "anchor")


def header_row(df: DataFrame, marker: str, columns: list[str]) -> DataFrame:
    """Rows of a sheet (n, c0, c1, ...) below the first one where c0 is the marker, under the names given."""
    at = df.filter(F.col("c0") == marker).agg(F.min("n").alias("_at"))
    return df.crossJoin(F.broadcast(at)).filter(F.col("n") > F.col("_at")).select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(columns)])
