"""Tables out of dating programs' text: columns of whole outputs in, rows out, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The names that programs give a node's interval in its comment.
HPD_KEYS = ("95%HPD", "95%", "height_95%_HPD", "height_95_HPD", "CI_height", "age_95%_HPD")

NUM = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def lines(texts: DataFrame) -> DataFrame:
    """(run_id, i, line)"""
    return texts.select("run_id", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("i", "line"))


def smoothing_table(texts: DataFrame) -> DataFrame:
    """(run_id, ordinal, smoothing, chisq): rows of two numbers after a header naming smoothing and chi-square."""
    x = lines(texts).withColumn("head", F.lower("line").contains("smoothing") & F.lower("line").contains("chi"))
    start = x.where("head").groupBy("run_id").agg(F.min("i").alias("s"))
    p = F.split(F.trim("line"), r"\s+")
    rows = x.join(start, "run_id").where("i > s").select("run_id", F.col("i").alias("ordinal"), F.expr("try_cast(get(split(trim(line), '\\\\s+'), 0) AS double)").alias("smoothing"), F.expr("try_cast(get(split(trim(line), '\\\\s+'), 1) AS double)").alias("chisq"), F.size(p).alias("n"))
    return rows.where("n >= 2 AND smoothing IS NOT NULL AND chisq IS NOT NULL").drop("n")


def prime_options(text: Column) -> Column:
    """struct(opt, optad, found): both default to 1 where the text has none."""
    opt, ad = (F.regexp_extract(text, rf"(?i)\b{k}\s*=\s*(\d+)", 1) for k in ("opt", "optad"))
    ok = (opt != "") & (ad != "")
    return F.struct(F.when(ok, F.expr("1") * opt.try_cast("int")).otherwise(1).alias("opt"), F.when(ok, ad.try_cast("int")).otherwise(1).alias("optad"), ok.alias("found"))


def bound_table(texts: DataFrame) -> DataFrame:
    """(run_id, ordinal, name, age, min, max) of a Name / Age / min / max node table; ``-`` is no bound."""
    x = lines(texts).withColumn("p", F.split(F.trim("line"), r"\s+"))
    head = x.where(F.lower(F.get("p", F.lit(0))).eqNullSafe("name") & F.lower("line").contains("age")).groupBy("run_id").agg(F.min("i").alias("s"))
    num = lambda k: F.get("p", F.lit(k)).try_cast("double")
    rows = x.join(head, "run_id").where("i > s").select("run_id", F.col("i").alias("ordinal"), F.get("p", F.lit(0)).alias("name"), num(1).alias("age"), num(2).alias("min"), num(3).alias("max"))
    return rows.where("age IS NOT NULL")


def informative_counts(text: Column) -> Column:
    """Map fix, min, max -> number of informative nodes."""
    pat = r"(?i)Number of informative (fix|min|max)\w*\s*nodes?\D*(\d+)"
    z = F.arrays_zip(F.regexp_extract_all(text, F.lit(pat), 1).alias("k"), F.regexp_extract_all(text, F.lit(pat), 2).alias("v"))
    return F.map_from_entries(F.transform(z, lambda e: F.struct(F.lower(e["k"]), e["v"].cast("int"))))


def named_ages(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(run_id, name, age, conflicting): rows whose first field is a calibration's name; conflicting values are flagged and
    give a null age."""
    x = lines(texts).select("run_id", F.split(F.trim("line"), r"\s+").alias("p")).withColumn("name", F.get("p", F.lit(0)))
    v = x.join(names.select("name").distinct(), "name").select("run_id", "name", F.explode(F.filter(F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda t: t.rlike(r"^\d+\.\d+$"))).alias("v"))
    g = v.groupBy("run_id", "name").agg(F.collect_set(F.round(F.col("v").cast("double"), 9)).alias("s"))
    return g.select("run_id", "name", F.when(F.size("s") == 1, F.get("s", F.lit(0))).alias("age"), (F.size("s") > 1).alias("conflicting"))


def substitution_rate(text: Column) -> Column:
    return F.regexp_extract(text, rf"(?s)Substitution rate is per time unit\s*({NUM})", 1).try_cast("double")


def chronogram(text: Column) -> Column:
    """The last bracketed tree with a closing ``;`` in a program's log."""
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(text, F.lit(r"(\([^;]*\)[^;()]*;)"), 1)), -1)


def read_samples(spark: SparkSession, path: str, chain: Column | int = 0) -> DataFrame:
    """(chain, iter, param, value) of a tab-separated sample file with a header; the index column is dropped by name."""
    wide = spark.read.option("sep", "\t").option("header", True).csv(path)
    return melt_samples(wide, chain)


def melt_samples(wide: DataFrame, chain: Column | int = 0) -> DataFrame:
    index = [c for c in wide.columns if c.strip().lower() in ("gen", "iter", "iteration", "state", "sample")]
    values = [c for c in wide.columns if c not in index]
    it = F.col(f"`{index[0]}`").try_cast("long") if index else F.monotonically_increasing_id()
    return wide.select((F.lit(chain) if isinstance(chain, int) else chain).alias("chain"), it.alias("iter"), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in values)).unpivot(["chain", "iter"], values, "param", "value")


def date_token(label: Column) -> Column:
    """struct(kind, age): ``|48.3`` or ``[&date=...]`` on a label; calendar dates are told apart and never converted."""
    t = F.coalesce(F.nullif(F.regexp_extract(label, r"\[&date=\"?([^\]\"]+)\"?\]", 1), F.lit("")), F.nullif(F.regexp_extract(label, r"\|([^|\[\]]+)$", 1), F.lit("")))
    kind = F.when(t.isNull(), "none").when(t.rlike(r"^\d{4}-\d{1,2}(-\d{1,2})?$"), "calendar").when(t.rlike(rf"^{NUM}$"), "ma").otherwise("none")
    return F.struct(kind.alias("kind"), F.when(kind == "ma", t.try_cast("double")).alias("age"))


def interval_columns(nodes: DataFrame) -> DataFrame:
    """``nodes`` with hpd_lo and hpd_hi out of their comments: ``95%HPD={a,b}`` or ``height_95%_HPD={a,b}``, whichever a
    node has, in either order of bounds; null where there is none, or not two numbers."""
    pair = F.coalesce(*[F.element_at("comments", F.lit(k)) for k in HPD_KEYS])
    both = F.transform(F.regexp_extract_all(pair, F.lit(f"({NUM})"), 1), lambda x: x.try_cast("double"))
    both = F.when(F.size(both) == 2, F.array_sort(both))
    return nodes.withColumn("hpd_lo", F.get(both, F.lit(0))).withColumn("hpd_hi", F.get(both, F.lit(1)))
