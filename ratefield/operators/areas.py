"""One builder for area datasets: a spine of areas with exposures, and legs that count what each source has in them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratefield.operators.audit import ContractError
from ratefield.operators.spatial import points_in_polygons

#: Areas that lists of faults name.
_NAMED = 20


@dataclass(frozen=True)
class Leg:
    """What one source adds to the areas, as the column `name`.

    via: "key" (rows carry the area's key), "crosswalk" (rows carry a name; it is matched by its trimmed lower-case form
    and a name that the crosswalk lacks is an error), "points" (rows have x and y and fall in polygons; outside of all
    they count nowhere) or "single" (all rows are of the one area). value: a column of numbers to add up instead of
    counting rows. zero: an area without rows has 0; else it stays unknown, as with suppressed cells.
    """

    name: str
    table: str
    key: str = ""
    via: str = "key"
    value: str = ""
    where: str = ""
    zero: bool = True


@dataclass(frozen=True)
class AreaDataset:
    """A declared dataset: spine table, its key, exposure and covariates, legs, the leg whose rate counts, a benchmark total and a floor of exposure for rankings."""

    name: str
    spine: str
    key: str
    exposure: str
    legs: list[Leg]
    headline: str
    covariates: list[str] = field(default_factory=list)
    benchmark: float | None = None
    floor: float = 0.0
    per: float = 100_000.0

    def build(self, tables: dict[str, DataFrame], crosswalk: DataFrame | None = None, polygons: DataFrame | None = None, cell: float = 0.1) -> DataFrame:
        """A row for each area of the spine: key, exposure, covariates, each leg's count and the headline's rate.

        crosswalk: (name, key); polygons: (area_id, xs, ys), area_id being the key. A spine that repeats a key is an error.
        """
        spine = tables[self.spine].select(self.key, self.exposure, *self.covariates)
        twice = spine.groupBy(self.key).count().filter("count > 1").limit(_NAMED).collect()
        if twice:
            raise ContractError(f"{self.name}: the spine repeats {sorted(str(r[0]) for r in twice)}")
        out = spine
        for leg in self.legs:
            counts = self._counts(leg, tables[leg.table], spine, crosswalk, polygons, cell)
            out = out.join(counts, self.key, "left")
            if leg.zero:
                out = out.withColumn(leg.name, F.coalesce(leg.name, F.lit(0).cast(counts.schema[leg.name].dataType)))
        return out.withColumn(f"{self.headline}_rate", F.try_divide(F.col(self.headline) * self.per, F.col(self.exposure)))

    def _counts(self, leg: Leg, rows: DataFrame, spine: DataFrame, crosswalk, polygons, cell) -> DataFrame:
        if leg.where:
            rows = rows.filter(leg.where)
        if leg.via == "points":
            held = rows.withColumn("point_id", F.monotonically_increasing_id()) if "point_id" not in rows.columns else rows
            rows = points_in_polygons(held.select("point_id", "x", "y"), polygons, cell).filter("area_id is not null").withColumnRenamed("area_id", "_area")
        elif leg.via == "crosswalk":
            normal = lambda c: F.lower(F.btrim(F.regexp_replace(c, r"\s+", " ")))
            look = crosswalk.select(normal(F.col("name")).alias("_name"), F.col(self.key).alias("_area")).distinct()
            # names are grouped before they are joined, so a frequent one is a row
            by = rows.groupBy(normal(F.col(leg.key)).alias("_name")).agg((F.sum(leg.value) if leg.value else F.count("*")).alias(leg.name)).join(look, "_name", "left")
            lost = by.filter("_area is null").select("_name").limit(_NAMED).collect()
            if lost:
                raise ContractError(f"{self.name}: {leg.table} names areas that the crosswalk lacks: {sorted(str(r[0]) for r in lost)}")
            return by.groupBy(F.col("_area").alias(self.key)).agg(F.sum(leg.name).alias(leg.name))
        elif leg.via == "single":
            total = rows.agg((F.sum(leg.value) if leg.value else F.count("*")).alias(leg.name))
            one = spine.select(self.key).limit(2).collect()
            if len(one) != 1:
                raise ContractError(f"{self.name}: {leg.table} is of a single area, the spine has {'none' if not one else 'more'}")
            return total.withColumn(self.key, F.lit(one[0][0]))
        else:
            rows = rows.withColumn("_area", F.col(leg.key))
        return rows.filter("_area is not null").groupBy(F.col("_area").alias(self.key)).agg((F.sum(leg.value) if leg.value else F.count("*")).alias(leg.name))

    def checkpoints(self, built: DataFrame) -> DataFrame:
        """Each leg's total over all areas, and its share of the benchmark in per cent (null without one)."""
        sums = built.agg(*[F.sum(leg.name).cast("double").alias(leg.name) for leg in self.legs])
        rows = F.array(*[F.struct(F.lit(leg.name).alias("leg"), F.col(leg.name).alias("total")) for leg in self.legs])
        share = F.try_divide(F.col("total") * 100.0, F.lit(self.benchmark).cast("double"))
        return sums.select(F.inline(rows)).select(F.lit(self.name).alias("dataset"), "leg", "total", share.alias("benchmark_pct"))

    def leaders(self, built: DataFrame, k: int = 10) -> DataFrame:
        """The k areas of highest rate among those at or over the floor."""
        return built.filter(F.col(self.exposure) >= self.floor).orderBy(F.desc_nulls_last(f"{self.headline}_rate"), self.key).limit(k)


def national(datasets: list[tuple[AreaDataset, DataFrame]], covariates: DataFrame, key: str) -> DataFrame:
    """Datasets one below the other with their name (columns that one lacks are null), and covariates by key.

    An area in two datasets is an error; an area without covariates keeps nulls.
    """
    out = None
    for spec, built in datasets:
        one = built.withColumn("dataset", F.lit(spec.name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    twice = out.groupBy(key).count().filter("count > 1").limit(_NAMED).collect()
    if twice:
        raise ContractError(f"areas in more than one dataset: {sorted(str(r[0]) for r in twice)}")
    return out.join(covariates, key, "left")
