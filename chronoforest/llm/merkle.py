"""Merkle manifest of a table, with proofs by descent of a content-addressed store.

A row is a leaf: the SHA-256 (lower-case hex) of its fields, each ``-`` if null, else byte count, ``:`` and value.  Leaves of
a source ascend by key; every 16 consecutive nodes become the hash of their digests until one is left, the source's subroot.
Subroots, ordered by source (null first, then bytewise), are joined in the same way to the root.

The store has a record for each inner node: its digest, its children's digests.  Requests (rows) go down from the root:
the base-16 digits of a row's rank say which child is theirs, the children not selected are collected as a segment, and
the path's segments in reverse are the proof.  Requests that share a prefix of digits are one row of the descent, so the
root's record is read once, not once a row; only the last step has a row for each request.

Ranks come from key ranges: the rows are written once in order of source and key, and a rank is the row's place in its
file, less that of the source's first row there, plus what earlier files hold of the source.  No window spans a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textcore import stored, tasks_for

FAN_OUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of a source that look its number up together.
PIECE = 512

#: Tree number of the tree over the subroots; sources are numbered from 0.
TOP = -1


def digest_of(*columns):
    """SHA-256 of the columns' values as framed fields."""
    framed = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*framed).cast("binary"), 256)


def joined_digest(digests):
    return F.sha2(F.concat_ws("", digests).cast("binary"), 256)


@dataclass
class Manifest:
    """``leaves``: (key, tree, rank, leaf, changed), ``sources``: (tree, source, n, height, subroot), ``records``: (height,
    digest, children) of all inner nodes, those over subroots being higher than any of a source; the ``root``; and how many
    levels the tallest source (``height``) and the tree over the subroots (``top``) have."""

    leaves: DataFrame
    sources: DataFrame
    records: DataFrame
    root: str | None
    height: int
    top: int


def levels(n: int) -> int:
    """How often ``n`` nodes are joined until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN_OUT), out + 1
    return out


def in_order(rows: DataFrame, by: list[str], what: str) -> DataFrame:
    """``rows`` as a table in order of ``by``, with ``_file`` and ``_place``; places ascend within and between files."""
    # rows equal in all of ``by`` are spread by their place in the input; it doesn't matter which of them comes first
    spread = rows.withColumn("_salt", F.monotonically_increasing_id())
    dealt = spread.repartitionByRange(tasks_for(rows), *by, "_salt").sortWithinPartitions(*by).drop("_salt")
    return stored(dealt.withColumn("_file", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), what)


def ranked(rows: DataFrame, group: str | None, by: list[str], what: str) -> DataFrame:
    """``rows`` with ``rank`` and ``n``: the place from 0 among all rows, or those of ``group``, in order of ``by``; and how
    many those are.  What is joined has one row for each file, or each group and file."""
    table = in_order(rows, ([group] if group else []) + by, what)
    on = ([group] if group else []) + ["_file"]
    parts = table.groupBy(*on).agg(F.count("*").alias("_c"), F.min("_place").alias("_first"))
    whole = W.partitionBy(*([group] if group else [F.lit(0)]))
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_base", before - F.col("_first")).withColumn("n", F.sum("_c").over(whole))
    return table.join(parts.drop("_c", "_first"), on).withColumn("rank", F.col("_place") + F.col("_base")).drop("_file", "_place", "_base")


def _grow(nodes: DataFrame, most: int, height: int) -> list[DataFrame]:
    """Tables (tree, rank, n, height, digest, children) of the levels above ``nodes`` (tree, rank, n, digest)."""
    out = []
    while most > 1:
        height += 1
        group = nodes.where("n > 1").groupBy("tree", F.expr(f"rank div {FAN_OUT}").alias("rank"), F.expr(f"(n + {FAN_OUT - 1}) div {FAN_OUT}").alias("n"))
        children = F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("at"), "digest"))), lambda x: x["digest"])
        level = group.agg(children.alias("children")).withColumn("digest", joined_digest("children"))
        nodes = stored(level.withColumn("height", F.lit(height)), "merkle-level")
        out.append(nodes)
        most = -(-most // FAN_OUT)
    return out


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", source: str = "source", changed=None) -> Manifest:
    """The manifest of ``docs``.  ``changed`` maps a field's name and column to the column that a check has in its place, or
    None where all are as they were; the leaf of a row so changed is kept beside its own."""
    spark = docs.sparkSession
    own = {f: F.col(f).cast("string") for f in fields}
    leaf = digest_of(*own.values())
    other = digest_of(*(changed(f, c) if changed else c for f, c in own.items()))
    # sources as text that sorts null first
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), name.alias("_source"), leaf.alias("leaf"), other.alias("changed"))
    rows = ranked(rows, "_source", ["_key", "leaf"], "merkle-leaves")
    names = ranked(rows.where("rank = 0").select("_source", F.col("n").alias("_n")), None, ["_source"], "merkle-sources")
    names = names.select("_source", F.col("rank").alias("tree"), "_n", F.col("n").alias("_k"))
    # a source's number is joined by (source, piece), so that a source with most rows isn't one key
    piece = F.expr(f"rank div {PIECE}").alias("_piece")
    pieces = rows.select("_source", piece).distinct().join(names, "_source")
    leaves = rows.select("*", piece).join(pieces.drop("_n", "_k"), ["_source", "_piece"])
    leaves = stored(leaves.select("_key", "tree", "rank", "n", "leaf", "changed"), "merkle-leaves")
    sizes = names.agg(F.max("_n").alias("most"), F.max("_k").alias("k")).first()
    height, top = levels(sizes["most"] or 0), levels(sizes["k"] or 0)
    inner = _grow(leaves.select("tree", "rank", "n", F.col("leaf").alias("digest")), sizes["most"] or 0, 0)
    bases = [leaves.where("n = 1").select("tree", F.col("leaf").alias("subroot"), F.lit(0).alias("height"))]
    bases += [x.where("n = 1").select("tree", F.col("digest").alias("subroot"), "height") for x in inner]
    subroots = bases[0]
    for x in bases[1:]:
        subroots = subroots.unionByName(x)
    plain = F.when(F.col("_source") != "", F.expr("substring(_source, 2)")).alias("source")
    sources = stored(names.join(subroots, "tree").select("tree", plain, F.col("_n").alias("n"), "height", "subroot", "_k"), "merkle-sources")
    nodes = sources.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("rank"), F.col("_k").alias("n"), F.col("subroot").alias("digest"))
    over = _grow(nodes, sizes["k"] or 0, height)
    records = spark.createDataFrame([], "height int, digest string, children array<string>")
    for x in inner + over:
        records = records.unionByName(x.select("height", "digest", "children"))
    last = over[-1] if over else sources.select(F.col("subroot").alias("digest"))
    at_top = last.select("digest").head(1)
    return Manifest(leaves, sources.drop("_k"), records, at_top[0][0] if at_top else None, height, top)


def _opened(state: DataFrame, records: DataFrame, height: int) -> DataFrame:
    """``state`` (tree, rank, digest, subroot, path) with the children of each node.  Equal nodes have one record."""
    here = records.where(F.col("height") == height).select("digest", "children").dropDuplicates(["digest"])
    return state.join(here, "digest")


def _segment(digit):
    """What a step collects: the children before and after the selected one."""
    left = F.concat_ws("", F.slice("children", F.lit(1), digit))
    return F.struct(left.alias("left"), F.concat_ws("", F.slice("children", digit + 2, F.lit(FAN_OUT))).alias("right"))


def _down(state: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """One step of the descent: a row for each child, or each that a request goes through."""
    rows = state.select("tree", "rank", "subroot", "path", "children", F.posexplode("children").alias("_digit", "digest"))
    path = F.concat("path", F.array(_segment(F.col("_digit"))))
    rows = rows.select("tree", (F.col("rank") * FAN_OUT + F.col("_digit")).alias("rank"), "digest", "subroot", path.alias("path"))
    return rows if wanted is None else rows.join(wanted, ["tree", "rank"], "left_semi")


def proofs(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """(columns of the request, subroot, path) of each row of ``requests`` (rows of ``m.leaves``; all where None).

    ``path`` is the proof: for each level, from the leaf's up to the root's, the digests ``left`` and ``right`` of it.
    """
    asked, spark = m.leaves if requests is None else requests, m.leaves.sparkSession

    def prefixes(tree: str, rank: str, steps: int, rows: DataFrame | None) -> DataFrame | None:
        """Nodes that requests go through ``steps`` levels above their own; None: through all."""
        return None if rows is None else rows.select(F.col(tree).alias("tree"), F.expr(f"{rank} div {FAN_OUT**steps}").alias("rank")).distinct()

    start = "tree long, rank long, digest string, subroot string, path array<struct<left:string,right:string>>"
    state = spark.createDataFrame([(TOP, 0, m.root, None, [])], start)
    over = requests.withColumn("_top", F.lit(TOP).cast("long")) if requests is not None else None
    for step in range(m.top, 0, -1):
        state = _down(_opened(state, m.records, m.height + step), prefixes("_top", "tree", step - 1, over))
    subroots = state.select(F.col("rank").alias("tree"), F.lit(0).cast("long").alias("rank"), "digest", F.col("digest").alias("subroot"), "path")
    subroots = stored(subroots.join(m.sources.select("tree", "height"), "tree"), "merkle-subroots")

    def entering(height: int) -> DataFrame:
        return subroots.where(F.col("height") == height).drop("height")

    # a source of one row: its leaf is its subroot
    found = asked.where("n = 1").join(entering(0).drop("rank"), "tree").withColumn("path", F.reverse("path")).drop("digest")
    state = entering(m.height) if m.height else None
    for height in range(m.height, 0, -1):
        opened = _opened(state, m.records, height)
        if height > 1:
            state = _down(opened, prefixes("tree", "rank", height - 1, requests)).unionByName(entering(height - 1))
            continue
        nodes = opened.select("tree", F.col("rank").alias("_node"), "children", "subroot", "path")
        last = asked.where("n > 1").withColumn("_node", F.expr(f"rank div {FAN_OUT}")).join(nodes, ["tree", "_node"])
        digit = F.expr(f"cast(rank % {FAN_OUT} AS int)")
        last = last.withColumn("path", F.reverse(F.concat("path", F.array(_segment(digit))))).drop("_node", "children")
        found = found.unionByName(last)
    return found


def folded(path, leaf):
    """The root that ``leaf`` and the proof ``path`` give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def tampered(docs: DataFrame, every: int = 5):
    """For manifest(): rows whose crc32 of doc_id divides by ``every`` have A-Z lower-cased in their text; nulls stay."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return lambda name, col: F.when(hit, F.translate(col, _UPPER, _LOWER)).otherwise(col) if name == "text" else col


def verify(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", source: str = "source", changed=None) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified), one row per input row.

    Rows that repeat a key are ordered by their leaf; rows equal in all fields are equal leaves side by side.  A null key
    comes first in its source, a null source is a source of its own, null fields are ``-``.  A null key counts as not
    changed.  Texts are hashed whole in the JVM.  Columns that are not among ``fields`` are not read, and an empty table
    gives no rows.
    """
    m = manifest(docs, fields, key, source, changed)
    proof = joined_digest(F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    again = folded(F.col("path"), F.col("changed"))
    out = proofs(m).select(F.col("_key").alias(key), "leaf", "subroot", F.lit(m.root).alias("root"), proof.alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
