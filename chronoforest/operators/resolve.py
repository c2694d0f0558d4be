"""Resolution of calibration targets to tree nodes: a prioritised union of matches, the first non-empty kind wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import tokens
from . import nodes as N

# The special targets and the domains whose leaves they stand for.
SPECIAL = {"ROOT": None, "LUCA": ("bacteria", "archaea"), "LBCA": ("bacteria",), "LACA": ("archaea",)}


def domain_of(label: Column, taxonomy: Column) -> Column:
    d = F.lower(F.coalesce(F.element_at(taxonomy, "d"), F.lit("")))
    low = F.lower(label)
    return F.when(d.isin("bacteria", "archaea"), d).when(d != "", F.lit(None)).when(low.contains("_d_bacteria"), "bacteria").when(low.contains("_d_archaea"), "archaea").when(low.contains("bacteria"), "bacteria").when(low.contains("archaea"), "archaea")


def words(label: Column, sizes: Column) -> Column:
    """The runs of ``sizes`` parts of a label between underscores: what whole words of so many parts it has."""
    parts = F.split(label, "_", -1)
    last = lambda n: F.size(parts) - n + 1
    runs = F.transform(sizes, lambda n: F.when(last(n) >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last(n), F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n), "_"))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(runs))


def resolve(targets: DataFrame, tips: DataFrame) -> DataFrame:
    """(tree_id, target, label, how): leaves that each target names.

    targets: tree_id, target.  tips: tree_id, label, taxonomy map (null entries and null maps allowed).  Kinds in order:
    special (upper case only), exact, taxonomy value, whole word between underscores, token.

    A leaf has a row for each name that it goes by, and targets meet these by equality; so a tree's leaves don't meet all
    of its targets.  Of words it has those of as many parts as some target has.
    """
    asked = targets.select("tree_id", "target").distinct()
    plain = asked.where(~F.col("target").isin(*SPECIAL)).withColumn("_low", F.lower("target"))
    sizes = F.broadcast(plain.agg(F.collect_set(F.size(F.split("_low", "_", -1))).alias("_sizes")))  # one row
    names = {
        1: F.array("label"),
        2: F.array_distinct(F.transform(F.map_values("taxonomy"), lambda v: F.lower(v))),
        3: words(F.lower("label"), F.col("_sizes")),
        4: F.array_except(tokens(F.col("label")), F.split(F.lower("label"), "_", -1)),  # whole parts are words
    }
    kind = lambda k: lambda v: F.struct(F.lit(k).alias("_k"), v.alias("name"))
    kinds = F.array(*[F.transform(x, kind(k)) for k, x in names.items()])
    known = tips.crossJoin(sizes).select("tree_id", "label", F.explode(F.flatten(F.filter(kinds, lambda x: x.isNotNull()))).alias("n")).select("tree_id", "label", "n._k", "n.name")
    either = F.array(F.struct(F.lit(True).alias("exact"), F.col("target").alias("name")), F.struct(F.lit(False).alias("exact"), F.col("_low").alias("name")))
    wanted = plain.select("tree_id", "target", F.explode(either).alias("n")).select("tree_id", "target", "n.exact", "n.name")
    least = known.groupBy("tree_id", (F.col("_k") == 1).alias("exact"), "name").agg(F.min("_k").alias("_k"))  # without labels
    best = wanted.join(least, ["tree_id", "exact", "name"]).groupBy("tree_id", "target").agg(F.min("_k").alias("_k"))
    best = best.withColumn("name", F.when(F.col("_k") == 1, F.col("target")).otherwise(F.lower("target")))
    named = known.join(best, ["tree_id", "_k", "name"])
    domains = F.array(F.lit("ROOT"), F.when(F.col("_domain").isNotNull(), "LUCA"), F.when(F.col("_domain") == "bacteria", "LBCA"), F.when(F.col("_domain") == "archaea", "LACA"))
    stood = tips.withColumn("_domain", domain_of(F.col("label"), F.col("taxonomy"))).select("tree_id", "label", F.explode(domains).alias("target"))
    special = stood.join(asked.where(F.col("target").isin(*SPECIAL)), ["tree_id", "target"]).withColumn("_k", F.lit(0))
    hits = named.select("tree_id", "target", "label", "_k").unionByName(special.select("tree_id", "target", "label", "_k"))
    how = F.element_at(F.array(*[F.lit(x) for x in ("special", "exact", "taxonomy", "word", "token")]), F.col("_k") + 1)
    return hits.select("tree_id", "target", "label", how.alias("how"))


def missing_domains(resolved: DataFrame, tips: DataFrame) -> DataFrame:
    """LUCA needs both domains, LBCA and LACA two leaves: findings of those that lack them."""
    t = tips.withColumn("_domain", domain_of(F.col("label"), F.col("taxonomy"))).select("tree_id", "label", "_domain")
    g = resolved.where(F.col("target").isin("LUCA", "LBCA", "LACA")).join(t, ["tree_id", "label"]).groupBy("tree_id", "target").agg(F.countDistinct("_domain").alias("d"), F.count("*").alias("n"))
    return g.where("(target = 'LUCA' AND d < 2) OR (target != 'LUCA' AND n < 2)").select("tree_id", F.lit("unresolved_special").alias("check"), F.lit("error").alias("severity"), F.col("target").alias("detail"))


def representatives(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree_id, target, a, b, n): the two members that span a target's MRCA: its first and last leaf."""
    at = resolved.join(N.leaves(nodes).select("tree_id", "label", "ord"), ["tree_id", "label"])
    return at.groupBy("tree_id", "target").agg(F.min_by("label", "ord").alias("a"), F.max_by("label", "ord").alias("b"), F.count("*").alias("n"))


def place(calibrations: DataFrame, resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """calibrations (tree_id, target, name, min_age, max_age ...) with the MRCA's node_id, depth, leaf_lo, leaf_hi."""
    m = N.mrca(resolved.select("tree_id", "target", "label"), nodes, ["target"])
    return calibrations.join(m.drop("root_dist"), ["tree_id", "target"])


def is_pure_clade(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    return N.monophyly(resolved.select("tree_id", "target", "label"), nodes, ["target"])
