"""Geological intervals against ages, and recorded ages on labels."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, start double, end double, rank string, parent string, color string"


def read_timescale(spark: SparkSession, path: str) -> DataFrame:
    """A timescale CSV; bounds come in either order and are put right."""
    t = spark.read.schema(SCHEMA).option("header", True).csv(path)
    return t.select("name", F.least("start", "end").alias("young"), F.greatest("start", "end").alias("old"), "rank", "parent", "color")


def bands_in(scale: DataFrame, young: float, old: float, ranks: list[str] | None = None) -> DataFrame:
    s = scale.where((F.col("young") <= old) & (F.col("old") >= young))
    return s.where(F.col("rank").isin(*ranks)) if ranks else s


def intervals_of(ages: DataFrame, scale: DataFrame, rank: str | None = None) -> DataFrame:
    """Each age with the intervals it lies in; the scale is a fixed table of a few hundred rows, so it is broadcast."""
    s = scale.where(F.col("rank") == rank) if rank else scale
    return ages.join(F.broadcast(s), (F.col("young") <= F.col("age")) & (F.col("age") <= F.col("old")), "left")


def node_age(recorded: Column, root_age: Column, root_dist: Column) -> Column:
    """struct(age, source): the recorded age where it isn't negative, else the root's age less the distance, 0 at least."""
    by_tree = F.greatest(root_age - root_dist, F.lit(0.0))
    ok = recorded.isNotNull() & (recorded >= 0)
    return F.struct(F.when(ok, recorded).otherwise(by_tree).alias("age"), F.when(ok, "recorded").otherwise("computed").alias("source"))


def read_plot_metadata(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV of values for leaves with its own columns, ``key`` renamed to ``label``."""
    return spark.read.option("header", True).option("multiLine", True).csv(path).withColumnRenamed(key, "label")


def packed(bands: DataFrame, by: list[str]) -> DataFrame:
    """``bands`` (by, name, young, old) with ``row``, from 0: the least number of rows in which no bands of a row overlap.

    Bands are taken by their young bound and go to the row that is free longest; those that only touch share a row.  The
    bands of a scale's rank, some hundreds, are one group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["young", "old", "name"]).reset_index(drop=True)
        free: list[tuple[float, int]] = []
        out = []
        for young, old in zip(pdf["young"], pdf["old"], strict=True):
            row = heapq.heappop(free)[1] if free and free[0][0] <= young else len(free)
            heapq.heappush(free, (old, row))
            out.append(row)
        return pdf.assign(row=out)

    return bands.groupBy(*by).applyInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bands.schema) + ", row int")
