"""The nested-interval node relation and queries on it.

``nodes``: tree_id, node_id (preorder), parent_id, child_index, label, branch_length, is_leaf, is_root, depth, root_dist,
leaf_lo, leaf_hi (first and last leaf ordinal beneath the node), n_leaves.  A missing length is null and counts as 0 in
sums.  A duplicated leaf label means its first occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import intervals as I


def leaves(nodes: DataFrame) -> DataFrame:
    """(tree_id, label, ord, root_dist): the first leaf of each label."""
    tips = nodes.where("is_leaf").groupBy("tree_id", "label").agg(F.min(F.struct("leaf_lo", "node_id", "root_dist", "depth")).alias("m"))
    return tips.select("tree_id", "label", F.col("m.leaf_lo").alias("ord"), F.col("m.node_id").alias("node_id"), F.col("m.root_dist").alias("root_dist"), F.col("m.depth").alias("depth"))


def tip_names(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_leaf").select("tree_id", F.col("leaf_lo").alias("ord"), "label")


def span(members: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, lo, hi, n_named, n_found): leaf ordinals that the named labels cover; members: tree_id, by, label."""
    keys = list(dict.fromkeys(["tree_id", *by]))
    found = members.select(*keys, "label").distinct().join(leaves(nodes).select("tree_id", "label", "ord"), ["tree_id", "label"], "left")
    return found.groupBy(*keys).agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count("*").alias("n_named"), F.count("ord").alias("n_found"))


def smallest_container(spans: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The deepest node whose leaf interval contains [lo, hi], for each span: the MRCA.  (keys, node_id, depth, n_leaves,
    root_dist, leaf_lo, leaf_hi)"""
    n = nodes.select("tree_id", "node_id", "depth", "n_leaves", "root_dist", "leaf_lo", "leaf_hi")
    met = I.meeting_nodes(spans, nodes, keys).join(n, ["tree_id", "node_id"]).where("leaf_lo <= lo AND leaf_hi >= hi")
    return met.select(*keys, "node_id", "depth", "n_leaves", "root_dist", "leaf_lo", "leaf_hi")


def mrca(members: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """MRCA of each set of labels; a set with a label that the tree lacks has no row."""
    keys = list(dict.fromkeys(["tree_id", *by]))
    return smallest_container(span(members, nodes, by).where("n_named = n_found"), nodes, keys)


def monophyly(members: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """(keys, n_members, n_leaves, is_monophyletic): whether a set is all leaves of its MRCA."""
    keys = list(dict.fromkeys(["tree_id", *by]))
    s = span(members, nodes, by).where("n_named = n_found")
    m = smallest_container(s, nodes, keys)
    return s.join(m, keys).select(*keys, F.col("n_named").alias("n_members"), "n_leaves", (F.col("n_named") == F.col("n_leaves")).alias("is_monophyletic"))


def descendants(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Leaves beneath each (tree_id, node_id) of ``targets``."""
    t = targets.join(nodes.select("tree_id", "node_id", "leaf_lo", "leaf_hi"), ["tree_id", "node_id"])
    return I.ordinals(t, "leaf_lo", "leaf_hi", "ord").drop("leaf_lo", "leaf_hi").join(tip_names(nodes), ["tree_id", "ord"])


def is_ancestor(a: str = "a", d: str = "d") -> Column:
    """Strict ancestor test on two aliases of ``nodes``."""
    c = F.col
    inside = (c(f"{d}.leaf_lo") >= c(f"{a}.leaf_lo")) & (c(f"{d}.leaf_hi") <= c(f"{a}.leaf_hi"))
    return inside & (c(f"{d}.depth") > c(f"{a}.depth")) & (c(f"{d}.tree_id") == c(f"{a}.tree_id"))


def leaf_pairs(nodes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(tree_id, a, b, distance) of leaf pairs with a's ordinal below b's: root_dist(a) + root_dist(b) - 2 root_dist(MRCA).

    A leaf is paired with the leaves beneath the other children of each of its ancestors, which is where they meet: a row a
    leaf and ancestor, then a row a pair, quadratic in a tree's leaves by nature; ``names`` (tree_id, label) restricts it.
    """
    tips = leaves(nodes)
    if names is not None:
        tips = tips.join(names.select("tree_id", "label").distinct(), ["tree_id", "label"], "left_semi")
    tops = nodes.where("NOT is_leaf").select("tree_id", F.col("node_id").alias("top"), F.col("root_dist").alias("top_dist"))
    kids = nodes.where("parent_id IS NOT NULL").select("tree_id", F.col("parent_id").alias("top"), "child_index", "leaf_lo", "leaf_hi")
    below = I.ordinals(kids, "leaf_lo", "leaf_hi", "ord").join(tips, ["tree_id", "ord"]).join(tops, ["tree_id", "top"])
    side = lambda x: below.select("tree_id", "top", "top_dist", F.col("label").alias(x), F.col("ord").alias(f"{x}_ord"), F.col("root_dist").alias(f"{x}_dist"), F.col("child_index").alias(f"{x}_child"))
    pairs = side("a").join(side("b").drop("top_dist"), ["tree_id", "top"]).where("a_child < b_child")
    return pairs.select("tree_id", "a", "b", "a_ord", "b_ord", (F.col("a_dist") + F.col("b_dist") - 2 * F.col("top_dist")).alias("distance"))


def farthest_pair(pairs: DataFrame) -> DataFrame:
    """The pair of largest distance of each tree; the first in leaf order on ties."""
    best = pairs.groupBy("tree_id").agg(F.max_by(F.struct("a", "b", "distance"), F.struct(F.col("distance"), -F.col("a_ord"), -F.col("b_ord"))).alias("m"))
    return best.select("tree_id", "m.*")


def ages(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``age``: the largest root-to-tip distance of the tree minus the node's own."""
    top = nodes.where("is_leaf").groupBy("tree_id").agg(F.max("root_dist").alias("_top"))
    return nodes.join(top, "tree_id").withColumn("age", F.col("_top") - F.col("root_dist")).drop("_top")


def topology_ids(nodes: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(tree_id, node_id, topology_id) of all nodes, or of ``only`` (tree_id, node_id): leaf count and the start of the SHA-1
    of the sorted leaf set.

    It is made of whole leaf sets: for the clades that are shown.  Clades are compared by their keys (intervals.clade_keys).
    """
    asked = nodes.select("tree_id", "node_id") if only is None else only.select("tree_id", "node_id").distinct()
    sets = descendants(asked, nodes).groupBy("tree_id", "node_id").agg(F.collect_list("label").alias("s"))
    return sets.select("tree_id", "node_id", clade_hash(F.col("s")).alias("topology_id"))


def clade_hash(members: Column) -> Column:
    inner = F.concat(F.lit("{"), F.array_join(F.array_sort(F.array_distinct(members)), ","), F.lit("}"))
    return F.concat(F.size(F.array_distinct(members)).cast("string"), F.lit("L:"), F.substring(F.sha1(inner.cast("binary")), 1, 8))


def is_binary(nodes: DataFrame) -> DataFrame:
    kids = nodes.where("parent_id IS NOT NULL").groupBy("tree_id", "parent_id").agg(F.count("*").alias("c"))
    by_tree = kids.groupBy("tree_id").agg(F.bool_and(F.col("c") == 2).alias("is_binary"))
    return nodes.select("tree_id").distinct().join(by_tree, "tree_id", "left").select("tree_id", F.coalesce("is_binary", F.lit(True)).alias("is_binary"))


def rooting_info(nodes: DataFrame) -> DataFrame:
    """(tree_id, root_children, is_rooted, has_singleton_outgroup, shortest_internal, longest_internal): rooted means that
    the root has exactly two children."""
    child = (F.col("depth") == 1)
    inner = ~F.col("is_leaf") & F.col("parent_id").isNotNull()
    return nodes.groupBy("tree_id").agg(
        F.count_if(child).alias("root_children"), (F.count_if(child) == 2).alias("is_rooted"), ((F.count_if(child) == 2) & (F.count_if(child & F.col("is_leaf")) == 1)).alias("has_singleton_outgroup"),
        F.min(F.when(inner, F.col("branch_length"))).alias("shortest_internal"), F.max(F.when(inner, F.col("branch_length"))).alias("longest_internal"),
    )


def branch_findings(nodes: DataFrame, huge: float = 1e6) -> DataFrame:
    """(tree_id, check, severity, detail, n) of negative, zero and huge branch lengths."""
    b = F.col("branch_length")
    kind = F.when(b < 0, "negative_branch").when(b == 0, "zero_branch").when(b > huge, "huge_branch")
    rows = nodes.select("tree_id", kind.alias("check"), F.col("label")).where("check IS NOT NULL")
    g = rows.groupBy("tree_id", "check").agg(F.count("*").alias("n"), F.min("label").alias("detail"))
    return g.withColumn("severity", F.when(F.col("check") == "negative_branch", "error").otherwise("warning"))


def ultrametricity(nodes: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(tree_id, min_height, max_height, relative_spread, is_ultrametric); null with fewer than two leaves."""
    h = nodes.where("is_leaf").groupBy("tree_id").agg(F.min("root_dist").alias("min_height"), F.max("root_dist").alias("max_height"), F.count("*").alias("n"))
    rel = F.when(F.col("max_height") == 0, F.lit(0.0)).otherwise((F.col("max_height") - F.col("min_height")) / F.col("max_height"))
    rel = F.when(F.col("n") >= 2, rel)
    return h.select("tree_id", "min_height", "max_height", rel.alias("relative_spread"), (rel <= tolerance).alias("is_ultrametric"))


# Methods that take trees whose tips differ in height; others take branch lengths as time.
UNEQUAL_HEIGHTS = ("treepl", "pathd8", "r8s", "mdcat", "wlogdate")


def tree_findings(nodes: DataFrame, method: str | None = None, require_rooted: bool = False, require_time_tree: bool = False) -> DataFrame:
    """(tree_id, check, severity, detail) of whole trees: roots, polytomies, branch lengths, heights and names.

    A tree without a root is an error where ``require_rooted``, else a warning.  Tips of unequal heights are an error where
    ``require_time_tree``, else information for a ``method`` that takes them, else a warning.
    """
    heights = "error" if require_time_tree else "info" if method in UNEQUAL_HEIGHTS else "warning"

    def found(rows: DataFrame, check: str, severity: str, detail) -> DataFrame:
        return rows.select("tree_id", F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))

    parts = [
        found(rooting_info(nodes).where("NOT is_rooted"), "not_rooted", "error" if require_rooted else "warning", F.col("root_children")),
        found(is_binary(nodes).where("NOT is_binary"), "not_binary", "warning", F.lit("")),
        found(ultrametricity(nodes).where("NOT is_ultrametric"), "not_ultrametric", heights, F.round("relative_spread", 6)),
        branch_findings(nodes).select("tree_id", "check", "severity", "detail"),
        duplicate_names(nodes).select("tree_id", "check", "severity", "detail"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def internal_ratio(nodes: DataFrame) -> DataFrame:
    """(tree_id, shortest_ratio): the shortest branch of an inner node, the root's included where it has one, over the
    longest; near 0 where rerooting has left a stub, 0 where there is none or all are 0."""
    inner = nodes.where("NOT is_leaf").groupBy("tree_id").agg(F.min("branch_length").alias("a"), F.max("branch_length").alias("b"))
    return inner.select("tree_id", F.coalesce(F.when(F.col("b") > 0, F.col("a") / F.col("b")), F.lit(0.0)).alias("shortest_ratio"))


def top_offenders(nodes: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` leaves of each tree farthest below its largest height."""
    w = W.partitionBy("tree_id")
    short = nodes.where("is_leaf").withColumn("gap", F.max("root_dist").over(w) - F.col("root_dist"))
    r = short.withColumn("rank", F.row_number().over(w.orderBy(F.desc("gap"), "leaf_lo")))
    return r.where(F.col("rank") <= k).select("tree_id", "label", "gap", "rank")


def duplicate_names(nodes: DataFrame) -> DataFrame:
    """Duplicate tip names are errors, duplicate internal names warnings."""
    d = nodes.where("label IS NOT NULL AND label != ''").groupBy("tree_id", "is_leaf", "label").agg(F.count("*").alias("n")).where("n > 1")
    return d.select("tree_id", F.when(F.col("is_leaf"), "duplicate_tip").otherwise("duplicate_internal").alias("check"), F.when(F.col("is_leaf"), "error").otherwise("warning").alias("severity"), F.col("label").alias("detail"), "n")


def rename_leaves(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels of leaves through ``mapping`` (old, new); others stay."""
    out = nodes.join(mapping.select(F.col("old").alias("label"), "new"), "label", "left")
    return out.withColumn("label", F.when(F.col("is_leaf"), F.coalesce("new", "label")).otherwise(F.col("label"))).select(nodes.columns)


def without_lengths(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("branch_length", F.lit(None).cast("double"))


def without_internal_labels(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("label", F.when(F.col("is_leaf"), F.col("label")))


def tree_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tree_id").agg(F.count_if("is_leaf").alias("tips"), F.count_if(~F.col("is_leaf")).alias("internals"), F.sum(F.coalesce("branch_length", F.lit(0.0))).alias("total_length"))


def root_representatives(nodes: DataFrame) -> DataFrame:
    """One leaf, the first, from beneath each child of the root."""
    kids = nodes.where("depth = 1").select("tree_id", F.col("node_id").alias("child"), F.col("leaf_lo").alias("ord"))
    return kids.join(tip_names(nodes), ["tree_id", "ord"]).select("tree_id", "child", "label")


def same_topology(a: DataFrame, b: DataFrame) -> DataFrame:
    """(tree_id, same): whether both tables have the same internal clades."""

    def inner(n: DataFrame, mark: str) -> DataFrame:
        own = n.where("NOT is_leaf").select("tree_id", "node_id")
        return I.clade_keys(n).join(own, ["tree_id", "node_id"]).select("tree_id", "n_leaves", "clade", F.lit(1).alias(mark)).distinct()

    both = inner(a, "x").join(inner(b, "y"), ["tree_id", "n_leaves", "clade"], "full_outer")
    return both.groupBy("tree_id").agg(F.bool_and(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("same"))


def chronology_breaks(nodes: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Nodes older than their parent by more than ``tolerance``; ``nodes`` has ``age``."""
    p = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("age").alias("parent_age"))
    return nodes.join(p, ["tree_id", "parent_id"]).where(F.col("age") > F.col("parent_age") + tolerance).select("tree_id", "node_id", "label", "age", "parent_age")
