"""Checks of what was asked against what was written and what came back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def written_back(requested: DataFrame, files: DataFrame) -> DataFrame:
    """(run_id, text, wanted, found) of texts that a written file has fewer times than asked; requested: run_id, text;
    files: run_id, content."""
    want = requested.groupBy("run_id", "text").agg(F.count("*").alias("wanted"))
    j = want.join(files, "run_id", "left")
    found = F.coalesce((F.length("content") - F.length(F.replace("content", "text", F.lit("")))) / F.length("text"), F.lit(0)).cast("int")
    return j.select("run_id", "text", "wanted", found.alias("found")).where("found < wanted")


def effective_bounds(bounds: DataFrame) -> DataFrame:
    """(run_id, name, lo, hi): the largest minimum and least maximum of a node; a fixed age is both.

    bounds: run_id, name, kind (fix, min, max), age."""
    fix = F.max(F.when(F.col("kind") == "fix", F.col("age")))
    g = bounds.groupBy("run_id", "name").agg(fix.alias("f"), F.max(F.when(F.col("kind") == "min", F.col("age"))).alias("lo"), F.min(F.when(F.col("kind") == "max", F.col("age"))).alias("hi"))
    return g.select("run_id", "name", F.coalesce("f", "lo").alias("lo"), F.coalesce("f", "hi").alias("hi"))


def reconcile_bounds(expected: DataFrame, reported: DataFrame) -> DataFrame:
    """Findings where a reported bound is looser than the expected one by more than max(0.06, 0.1 %), or is missing.

    expected: run_id, name, lo, hi; reported: run_id, name, min, max."""
    tol = lambda c: F.greatest(F.lit(0.06), F.abs(c) * 0.001)
    j = expected.join(reported, ["run_id", "name"], "left")
    lost = (F.col("lo").isNotNull() & F.col("min").isNull()) | (F.col("hi").isNotNull() & F.col("max").isNull())
    loose = (F.col("min") < F.col("lo") - tol(F.col("lo"))) | (F.col("max") > F.col("hi") + tol(F.col("hi")))
    k = F.when(lost, "bound_missing").when(F.coalesce(loose, F.lit(False)), "bound_loosened")
    return j.withColumn("check", k).where("check IS NOT NULL").select("run_id", "name", "check", "lo", "hi", "min", "max")


def violations(ages: DataFrame, bounds: DataFrame, slack: float = 1.0) -> DataFrame:
    """Ages outside their bounds by more than ``slack``, and ages at a bound (within max(0.05, 0.5 %))."""
    j = ages.join(bounds, ["run_id", "name"])
    near = lambda b: F.abs(F.col("age") - b) <= F.greatest(F.lit(0.05), F.abs(b) * 0.005)
    out = (F.col("age") < F.col("lo") - slack) | (F.col("age") > F.col("hi") + slack)
    hit = (F.col("lo") != F.col("hi")) & (near(F.col("lo")) | near(F.col("hi")))
    k = F.when(F.coalesce(out, F.lit(False)), "bound_violated").when(F.coalesce(hit, F.lit(False)), "at_boundary")
    return j.withColumn("check", k).where("check IS NOT NULL").select("run_id", "name", "check", "age", "lo", "hi")


def calibrated_ages(placed: DataFrame, dated: DataFrame) -> DataFrame:
    """Ages of calibrations in a dated tree: by the calibration's own label, else by its clade's token, else null.

    placed: tree_id, name, topology_id; dated: tree_id, label, topology_id, age."""
    by_name = dated.where("label IS NOT NULL").groupBy("tree_id", F.col("label").alias("name")).agg(F.min("age").alias("_a"))
    by_clade = dated.groupBy("tree_id", "topology_id").agg(F.min("age").alias("_b"))
    j = placed.join(by_name, ["tree_id", "name"], "left").join(by_clade, ["tree_id", "topology_id"], "left")
    return j.select("tree_id", "name", F.coalesce("_a", "_b").alias("age"), F.when(F.col("_a").isNotNull(), "label").when(F.col("_b").isNotNull(), "clade").otherwise("none").alias("found_by"))


def degradations(rendered: DataFrame, placed: DataFrame) -> DataFrame:
    """Records of meaning lost on the way to a program, with the node they concern; rendered: see render_all."""
    return rendered.where("degraded_to IS NOT NULL").join(placed.select("tree_id", "name", "topology_id"), "name").select("tree_id", "name", "target", "topology_id", "degraded_to", "notes").dropDuplicates()
