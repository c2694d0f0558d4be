"""Interval keys over the node relation: containment, nearest common ancestors and clade identity as equi-joins.

Leaf ordinals of a tree run from 1.  An interval of them is the union of at most two cells of each power of two (``cells``),
a point lies in one cell of each (``cells_of``), so *contains* is equality of (tree, level, cell).  Between leaves i and i + 1
lies the gap i, which belongs to the node where the two meet; the ancestor of a span is the shallowest node of its gaps, the
least over a few cells.  None of it depends on a tree's shape: a ladder costs as much as a balanced tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Leaves whose hashes are summed in one window; a tree's blocks meet as one row each.
BLOCK = 4096

#: Ordinals that one row is unfolded to at once.
RUN = 4096

CELLS = "array<struct<level:int,cell:bigint>>"


def _bits(x: Column) -> Column:
    """The highest set bit of a positive number."""
    return F.length(F.bin(x)) - 1


def cells(lo: Column, hi: Column) -> Column:
    """The fewest cells (level, cell) that together are the ordinals lo to hi, both from 1 and inclusive."""

    def step(s: Column, k: Column) -> Column:
        a, b = s["a"], s["b"]
        up = a + a % 2
        left = F.when((a < b) & (a % 2 == 1), F.array(F.struct(k.alias("level"), a.alias("cell")))).otherwise(F.array().cast(CELLS))
        right = F.when((up < b) & (b % 2 == 1), F.array(F.struct(k.alias("level"), (b - 1).alias("cell")))).otherwise(F.array().cast(CELLS))
        half = F.shiftright(up, 1).alias("a"), F.shiftright(b, 1).alias("b")
        return F.struct(*half, F.concat(s["out"], left, right).alias("out"))

    begin = F.struct(lo.cast("long").alias("a"), (hi + 1).cast("long").alias("b"), F.array().cast(CELLS).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), _bits(hi + 1)), begin, step, lambda s: s["out"])


def cells_of(at: Column) -> Column:
    """The cells that hold an ordinal; cells 0 are left out, as no interval needs them."""
    return F.transform(F.sequence(F.lit(0), _bits(at)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", at.cast("long"), k).alias("cell")))


def gaps(nodes: DataFrame) -> DataFrame:
    """(tree_id, at, depth, node_id): the node where leaves ``at`` and ``at`` + 1 meet."""
    kids = nodes.where("parent_id IS NOT NULL").select("tree_id", "parent_id", F.col("leaf_hi").alias("at"))
    tops = nodes.where("NOT is_leaf").select("tree_id", F.col("node_id").alias("parent_id"), "depth", F.col("leaf_hi").alias("_end"))
    return kids.join(tops, ["tree_id", "parent_id"]).where("at < _end").select("tree_id", "at", "depth", F.col("parent_id").alias("node_id"))


def meeting_nodes(spans: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi, node_id) of the deepest node over the leaves lo to hi of each span; keys hold tree_id.  A span that
    isn't within its tree has no row."""
    out = list(dict.fromkeys([*keys, "lo", "hi"]))
    asked = spans.where("lo >= 1 AND lo <= hi").select(*out).distinct()
    tips = nodes.where("is_leaf").select("tree_id", F.col("leaf_lo").alias("lo"), "node_id")
    single = asked.where("lo = hi").join(tips, ["tree_id", "lo"]).select(*out, "node_id")
    wide = asked.where("lo < hi").select(*out, F.explode(cells(F.col("lo"), F.col("hi") - 1)).alias("c"))
    wide = wide.select(*out, "c.level", "c.cell")
    least = gaps(nodes).select("tree_id", F.struct("depth", "node_id").alias("m"), F.explode(cells_of(F.col("at"))).alias("c"))
    least = least.groupBy("tree_id", "c.level", "c.cell").agg(F.min("m").alias("m"))
    met = wide.join(least, ["tree_id", "level", "cell"]).groupBy(*out).agg(F.min("m").alias("m"))
    return single.unionByName(met.select(*out, F.col("m.node_id").alias("node_id")))


def containing_pairs(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Rows of ``outer`` (tree_id, o_lo, o_hi, ...) with the rows of ``inner`` (tree_id, i_lo, i_hi, ...) that lie within them.

    A row of ``outer`` holds the first leaf of such a row in exactly one of its cells, so no pair comes twice.  Intervals
    may begin at 0."""
    o = outer.withColumn("_c", F.explode(cells(F.col("o_lo") + 1, F.col("o_hi") + 1))).select("*", "_c.level", "_c.cell").drop("_c")
    i = inner.withColumn("_c", F.explode(cells_of(F.col("i_lo") + 1))).select("*", "_c.level", "_c.cell").drop("_c")
    return o.join(i, ["tree_id", "level", "cell"]).where("i_hi <= o_hi").drop("level", "cell")


def ordinals(rows: DataFrame, lo: str, hi: str, name: str) -> DataFrame:
    """A row for each number from ``lo`` to ``hi`` of a row; long runs are unfolded piece by piece."""
    runs = rows.withColumn("_run", F.explode(F.expr(f"sequence(cast({lo} AS long) div {RUN}, cast({hi} AS long) div {RUN})")))
    first, last = F.greatest(F.col(lo).cast("long"), F.col("_run") * RUN), F.least(F.col(hi).cast("long"), F.col("_run") * RUN + RUN - 1)
    return runs.withColumn(name, F.explode(F.sequence(first, last))).drop("_run")


def clade_keys(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, n_leaves, clade) of all nodes: ``clade`` is equal for equal sets of leaf labels.

    It is the exclusive or of two 64-bit hashes of each label, so that a clade's is that of the leaves up to its last one
    against that of the leaves before its first.  Labels are to be unique in their tree; labels twice in a clade cancel out.
    """
    tips = nodes.where("is_leaf").select("tree_id", F.col("leaf_lo").alias("at"), F.xxhash64("label").alias("x"), F.xxhash64("label", F.lit(1)).alias("y"))
    tips = tips.withColumn("_block", F.expr(f"at div {BLOCK}"))
    before = W.partitionBy("tree_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = tips.groupBy("tree_id", "_block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    blocks = blocks.select("tree_id", "_block", *(F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"_{c}") for c in "xy"))
    here = W.partitionBy("tree_id", "_block").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    upto = tips.select("tree_id", "_block", "at", *(F.bit_xor(c).over(here).alias(c) for c in "xy")).join(blocks, ["tree_id", "_block"])
    upto = upto.select("tree_id", "at", *(F.col(c).bitwiseXOR(F.col(f"_{c}")).alias(c) for c in "xy"))
    last = upto.select("tree_id", F.col("at").alias("leaf_hi"), F.col("x").alias("_x1"), F.col("y").alias("_y1"))
    first = upto.select("tree_id", (F.col("at") + 1).alias("leaf_lo"), F.col("x").alias("_x0"), F.col("y").alias("_y0"))
    rows = nodes.select("tree_id", "node_id", "n_leaves", "leaf_lo", "leaf_hi").join(last, ["tree_id", "leaf_hi"]).join(first, ["tree_id", "leaf_lo"], "left")
    half = lambda c: F.hex(F.col(f"_{c}1").bitwiseXOR(F.coalesce(f"_{c}0", F.lit(0))))
    return rows.select("tree_id", "node_id", "n_leaves", F.concat(half("x"), F.lit("-"), half("y")).alias("clade"))


def set_keys(members: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_leaves, clade) of sets of labels (by, label), as clade_keys() has them."""
    one = members.select(*by, "label").distinct()
    half = lambda *x: F.hex(F.bit_xor(F.xxhash64("label", *x)))
    return one.groupBy(*by).agg(F.count("*").alias("n_leaves"), F.concat(half(), F.lit("-"), half(F.lit(1))).alias("clade"))
