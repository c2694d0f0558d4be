"""Alignment of node ages across methods and the comparison report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import accession, sanitize
from . import nodes as N
from .intervals import clade_keys, set_keys
from .timescale import node_age


def aliases(tips: DataFrame) -> DataFrame:
    """(alias, label): spellings a leaf may have in a result; an alias that several leaves have means the first by ``ord``.

    tips: label, ord."""
    base = F.col("label")
    forms = F.array(base, F.lower(base), sanitize(base), accession(base), F.regexp_replace(base, r"_\d+$", ""))
    rows = tips.select("label", "ord", F.posexplode(F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != "")))).alias("k", "alias"))
    return rows.groupBy("alias").agg(F.min_by("label", F.struct("k", "ord")).alias("label"))


def canonical(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """``nodes`` with leaf labels as the input tree spells them; names: see aliases().  Unknown ones stay."""
    own = names.select(F.col("alias").alias("label"), F.col("label").alias("_own"))
    out = nodes.join(own, "label", "left").withColumn("label", F.when(F.col("is_leaf"), F.coalesce("_own", "label")).otherwise(F.col("label")))
    return out.select(nodes.columns)


def labelled_clades(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(tree_id, label, topology_id, n_leaves, depth) of the first node of each label; keys: see intervals.clade_keys()."""
    rows = nodes.where("label IS NOT NULL AND label != ''").select("tree_id", "node_id", "label", "depth").join(keys, ["tree_id", "node_id"])
    first = rows.groupBy("tree_id", "label").agg(F.min_by(F.struct("n_leaves", "clade", "depth"), "node_id").alias("c"))
    return first.select("tree_id", "label", clade_token(F.col("c.n_leaves"), F.col("c.clade")).alias("topology_id"), F.col("c.n_leaves").alias("n_leaves"), F.col("c.depth").alias("depth"))


def clade_token(n_leaves: Column, clade: Column) -> Column:
    return F.concat(n_leaves.cast("string"), F.lit("L:"), clade)


def align_trees(ages: DataFrame, dated: DataFrame, tree: DataFrame, members: DataFrame) -> DataFrame:
    """align() from the trees themselves.

    dated: nodes of each method's tree, its tree_id the method; tree: nodes of the input tree; members: (name, label) of
    calibrations.  Leaves of other spellings are read as the input tree's (aliases()), so a clade meets the same clade of
    any method by an equi-join on its key.  A clade that the input tree has too counts with its depth there."""
    names = aliases(N.tip_names(tree).select("label", "ord")).cache()
    keys = clade_keys(canonical(dated, names))
    own = labelled_clades(tree, clade_keys(tree)).drop("tree_id")
    at = tree.select("node_id", F.col("depth").alias("_depth")).join(clade_keys(tree), "node_id")
    at = at.groupBy(clade_token(F.col("n_leaves"), F.col("clade")).alias("topology_id")).agg(F.max("_depth").alias("_depth"))
    clades = labelled_clades(dated, keys).join(at, "topology_id", "left").withColumn("depth", F.coalesce("_depth", "depth"))
    spelt = members.join(names.select(F.col("alias").alias("label"), F.col("label").alias("_own")), "label", "left")
    sets = set_keys(spelt.select("name", F.coalesce("_own", "label").alias("label")), ["name"])
    cal = sets.withColumn("topology_id", clade_token(F.col("n_leaves"), F.col("clade"))).join(at, "topology_id", "left")
    cal = cal.select("name", "topology_id", "n_leaves", F.col("_depth").alias("depth"))
    return align(ages, clades.select(F.col("tree_id").alias("method"), "label", "topology_id", "n_leaves", "depth"), cal, own, names)


def align(ages: DataFrame, clades: DataFrame, calibrations: DataFrame, inputs: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """``ages`` (method, node_key, ordinal, age, lo, hi, ci_type) with row_key, alignment, n_leaves and depth.

    A node key is looked up as a label of the method's dated tree (clades: method, label, topology_id, n_leaves, depth),
    then as a calibration's name (calibrations: name, topology_id, n_leaves, depth), then as a label of the input tree
    (inputs: label, topology_id, n_leaves, depth).  Keys found that way align by topology, others by name only, and
    positional keys (``n12``, ``internal_node_3``) are unresolved.  Leaves have distances, not ages, and no row: clades of
    one leaf, and keys that are a leaf's name or alias (tips: see aliases()).  If a method has a row twice the later counts.
    """
    c = clades.select("method", F.col("label").alias("node_key"), *(F.col(x).alias(f"c_{x}") for x in ("topology_id", "n_leaves", "depth")))
    k = calibrations.select(F.col("name").alias("node_key"), *(F.col(x).alias(f"k_{x}") for x in ("topology_id", "n_leaves", "depth")))
    i = inputs.select(F.col("label").alias("node_key"), *(F.col(x).alias(f"i_{x}") for x in ("topology_id", "n_leaves", "depth")))
    j = ages.join(c, ["method", "node_key"], "left").join(k, "node_key", "left").join(i, "node_key", "left")
    got = {x: F.coalesce(f"c_{x}", f"k_{x}", f"i_{x}") for x in ("topology_id", "n_leaves", "depth")}
    j = j.where(F.coalesce(got["n_leaves"] != 1, F.lit(True)))
    if tips is not None:
        leaf = tips.select(F.col("alias").alias("node_key"), F.lit(True).alias("_tip")).distinct()
        j = j.join(leaf, "node_key", "left").where(F.col("_tip").isNull() | got["topology_id"].isNotNull())
    positional = F.col("node_key").rlike(r"^(n\d+|internal_node_\d+|node_?\d+)$")
    kind = F.when(got["topology_id"].isNotNull(), "topology").when(positional, "unresolved").otherwise("name-only")
    rows = j.select(*ages.columns, kind.alias("alignment"), F.coalesce(got["topology_id"], F.concat(F.lit("?"), "node_key")).alias("row_key"), got["n_leaves"].alias("n_leaves"), got["depth"].alias("depth"))
    last = rows.groupBy("row_key", "method").agg(F.max_by(F.struct(*[x for x in rows.columns if x not in ("row_key", "method")]), "ordinal").alias("r"), F.count("*").alias("n_rows"))
    return last.select("row_key", "method", "r.*", "n_rows")


def ordered(rows: DataFrame) -> DataFrame:
    """Report order: alignment, depth (unknown last), larger clades first, name."""
    rank = F.when(F.col("alignment") == "topology", 0).when(F.col("alignment") == "name-only", 1).otherwise(2)
    return rows.orderBy(rank, F.coalesce("depth", F.lit(9999)), F.desc(F.coalesce("n_leaves", F.lit(0))), F.lower("row_key"))


def format_age(age: Column, lo: Column, hi: Column, ci_type: Column) -> Column:
    """``48.3 [41.2,55.6]_HPD95``, the mean alone without an interval, NA without an age."""
    plain = F.format_string("%.1f", age)
    return F.when(age.isNull(), "NA").when(lo.isNotNull() & hi.isNotNull(), F.concat(plain, F.lit(" ["), F.format_string("%.1f", lo), F.lit(","), F.format_string("%.1f", hi), F.lit("]_"), F.coalesce(ci_type, F.lit("unspecified")))).otherwise(plain)


def report(aligned: DataFrame, methods: list[str]) -> DataFrame:
    """One row a node, one text column a method."""
    rows = aligned.withColumn("_t", format_age(F.col("age"), F.col("lo"), F.col("hi"), F.col("ci_type")))
    keys = rows.groupBy("row_key").agg(F.min("alignment").alias("alignment"), F.max("n_leaves").alias("n_leaves"), F.min("depth").alias("depth"))
    wide = rows.groupBy("row_key").pivot("method", methods).agg(F.max("_t")).fillna("NA")
    return keys.join(wide, "row_key")


def capabilities(ages: DataFrame) -> DataFrame:
    """Interval kinds a method really gave."""
    return ages.groupBy("method").agg(F.array_sort(F.collect_set("ci_type")).alias("ci_types"), F.count_if(F.col("lo").isNotNull()).alias("with_interval"), F.count("*").alias("nodes"))


def alignment_summary(aligned: DataFrame) -> DataFrame:
    """(item, name, n): rows of each alignment kind, comparable rows (not unresolved) with one and with several methods, and
    each method's missing estimates among the comparable rows."""
    row = aligned.groupBy("row_key").agg(F.min("alignment").alias("name"), F.count_distinct("method").alias("methods"))  # a row has one kind
    kinds = row.groupBy("name").agg(F.count("*").alias("n")).select(F.lit("alignment").alias("item"), "name", "n")
    good = row.where("name != 'unresolved'")
    several = good.select(F.when(F.col("methods") > 1, "several").otherwise("one").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    have = aligned.groupBy("method").agg(F.count_distinct(F.when(F.col("alignment") != "unresolved", F.col("row_key"))).alias("_have"))
    total = good.agg(F.count("*").alias("_all")).select(F.lit(None).cast("string").alias("method"), F.lit(0).cast("long").alias("_have"), "_all")
    few = have.select("method", "_have", F.lit(None).cast("long").alias("_all")).unionByName(total)  # a row a method
    missing = few.withColumn("_all", F.max("_all").over(W.partitionBy(F.lit(0)))).where("method IS NOT NULL")
    missing = missing.select(F.lit("missing").alias("item"), F.col("method").alias("name"), (F.col("_all") - F.col("_have")).alias("n"))
    several = several.select(F.lit("methods").alias("item"), "name", "n")
    return kinds.unionByName(several).unionByName(missing)


def reconciliation(requested: DataFrame, written: DataFrame, ages: DataFrame) -> DataFrame:
    """(method, requested, effective, not_written, parsed, short): calibrations asked of a method, those that its input files
    hold, the names that they lack, the ages that came back, and whether these are fewer than asked.

    requested, written: method, name; ages: method, node_key."""
    ask, got = requested.select("method", "name").distinct(), written.select("method", "name").distinct().withColumn("_w", F.lit(True))
    both = ask.join(got, ["method", "name"], "left").groupBy("method").agg(
        F.count("*").alias("requested"), F.count("_w").alias("effective"), F.array_sort(F.collect_list(F.when(F.col("_w").isNull(), F.col("name")))).alias("not_written"),
    )
    parsed = ages.groupBy("method").agg(F.count("*").alias("parsed"))
    j = both.join(parsed, "method", "left").withColumn("parsed", F.coalesce("parsed", F.lit(0)))
    return j.withColumn("short", F.col("parsed") < F.col("requested"))


def interval_kinds(ages: DataFrame) -> DataFrame:
    """(method, ci_type, n)"""
    return ages.groupBy("method", F.coalesce("ci_type", F.lit("unspecified")).alias("ci_type")).agg(F.count("*").alias("n"))


def plot_values(nodes: DataFrame, ages: DataFrame) -> DataFrame:
    """(tree_id, node_id, label, age, source, lo, hi): a result's ages on the nodes of a tree, by label; nodes without one
    have the tree's height less their root distance (source computed).  Of a name that a result has twice the first counts.

    ages: tree_id, node_key, ordinal, age, lo, hi."""
    top = nodes.where("is_leaf").groupBy("tree_id").agg(F.max("root_dist").alias("_top"))
    named = ages.groupBy("tree_id", F.col("node_key").alias("label")).agg(F.min_by(F.struct("age", "lo", "hi"), "ordinal").alias("_r"))
    j = nodes.select("tree_id", "node_id", "label", "root_dist").join(top, "tree_id").join(named, ["tree_id", "label"], "left")
    at = node_age(F.col("_r.age"), F.col("_top"), F.col("root_dist"))
    return j.select("tree_id", "node_id", "label", at["age"].alias("age"), at["source"].alias("source"), F.col("_r.lo").alias("lo"), F.col("_r.hi").alias("hi"))
