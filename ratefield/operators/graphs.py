"""Connected components, contiguity and values of neighbours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratefield.session import scratch_dir


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge (src, dst) both ways, once, without loops."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct()


def thinned(edges: DataFrame) -> DataFrame:
    """A spanning forest of each partition's edges (src, dst): the same components from as many edges as nodes at most."""
    kind = edges.schema["src"].dataType.simpleString()

    def forest(batches):
        top: dict = {}

        def root(x):
            while top.setdefault(x, x) != x:
                top[x] = x = top[top[x]]
            return x

        for batch in batches:
            kept = []
            for x, y in zip(batch["src"].tolist(), batch["dst"].tolist(), strict=True):
                a, b = root(x), root(y)
                if a != b:
                    top[a] = b
                    kept.append((x, y))
            yield pd.DataFrame(kept, columns=["src", "dst"])

    return edges.select("src", "dst").mapInPandas(forest, f"src {kind}, dst {kind}")


def components(nodes: DataFrame, edges: DataFrame, turns: int = 64) -> DataFrame:
    """(node, component): component is the least node that edges between nodes reach; a node without edges is its own.

    Large-star and small-star steps (Kiveris et al., 2014) in turn until nothing changes, so turns grow with the
    logarithm of a component. A turn is written as Parquet in the session's shared folder and read back: a checkpoint
    would keep the size that the plan was estimated at, which each turn's joins raise to a power, until the estimate
    alone fills the driver.
    """
    spark = nodes.sparkSession
    place = scratch_dir(spark, "components")
    written: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        written.append(f"{place}/{len(written)}")
        df.write.parquet(written[-1])
        return spark.read.schema(df.schema).parquet(written[-1])

    def drop(path: str) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def least(e: DataFrame) -> DataFrame:
        return e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")

    known = lambda c: nodes.select(F.col("node").alias(c))
    pairs = kept(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    e, before = kept(pairs.join(known("u"), "u", "left_semi").join(known("v"), "v", "left_semi").select("u", "v")), None
    for _ in range(turns):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        parts = least(large)
        small = parts.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(parts.select("u", F.col("m").alias("v"))).distinct()
        e = kept(small)
        drop(written[-2])
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            drop(written[0])
            return nodes.join(e.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
        before = now
    raise RuntimeError("components didn't settle")


def islands(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a neighbour."""
    return nodes.join(undirected(edges).select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def shared_vertex_edges(rings: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """Queen contiguity of polygons given as (key, x, y) vertices: units that share a vertex, the lesser key first."""
    spots = rings.select(key, F.round("x", digits).alias("_x"), F.round("y", digits).alias("_y")).distinct()
    other = spots.withColumnRenamed(key, "dst")
    return spots.join(other, ["_x", "_y"]).filter(F.col(key) < F.col("dst")).select(F.col(key).alias("src"), "dst").distinct()


def neighbour_mean(values: DataFrame, edges: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the mean of the neighbours' known values; null without any. values: (node, column)."""
    near = undirected(edges).join(values.select(F.col("node").alias("dst"), F.col(column).alias("_v")), "dst")
    return values.join(near.groupBy(F.col("src").alias("node")).agg(F.avg("_v").alias(out)), "node", "left")
