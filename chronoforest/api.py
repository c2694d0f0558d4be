"""The short way in: load, check, ask, compare; method and step registries; SQL functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InputError, UsageError
from .functions.taxonomy import parse_taxonomy
from .operators import nodes as N
from .operators import relations as R
from .operators import resolve as RS
from .sources import alignments as AL
from .sources import newick as NW

Step = Callable[[DataFrame], DataFrame]


class Registry:
    """Named callables; keys are lower case."""

    def __init__(self, kind: str):
        self.kind, self.items = kind, {}

    def register(self, name: str, f: Callable | None = None):
        """As a call or as a decorator."""
        if f is None:
            return lambda g: self.register(name, g)
        self.items[name.lower()] = f
        return f

    def get(self, name: str) -> Callable:
        if name.lower() not in self.items:
            raise UsageError(f"unknown {self.kind} {name}; known: {', '.join(sorted(self.items))}")
        return self.items[name.lower()]

    def names(self) -> list[str]:
        return sorted(self.items)


METHODS, STEPS, FORMATTERS = Registry("method"), Registry("step"), Registry("formatter")


def chain(names: list[str], rows: DataFrame) -> DataFrame:
    """Quality steps in order, each DataFrame to DataFrame."""
    return reduce(lambda df, n: df.transform(STEPS.get(n)), names, rows)


class Session:
    """A Spark session with the library's readers and questions."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def load_trees(self, path: str, mode: str = "split", validate: bool = True, **rules) -> tuple[DataFrame, DataFrame]:
        """(nodes, findings); with ``validate`` no tree at all is an error.  ``rules``: see nodes.tree_findings()."""
        trees = NW.read_trees(self.spark, path, mode)
        nodes, bad = NW.parse_trees(trees)
        if validate and not nodes.where("is_leaf").head(1):
            raise InputError(f"no tree in {path}")
        return nodes, bad.unionByName(NW.text_findings(trees)).unionByName(N.tree_findings(nodes, **rules))

    def taxonomy(self, nodes: DataFrame) -> DataFrame:
        """(tree_id, label, taxonomy) of leaves, by the ranks in their labels."""
        return nodes.where("is_leaf").select("tree_id", "label", parse_taxonomy(F.col("label")).alias("taxonomy"))

    def is_monophyletic(self, nodes: DataFrame, targets: list[str], tips: DataFrame | None = None) -> DataFrame:
        """(tree_id, target, is_monophyletic, reason); a target may be a leaf, a taxon or a special name.  Null for unrooted
        trees and for targets that name no leaf."""
        tips = tips if tips is not None else self.taxonomy(nodes)
        asked = nodes.select("tree_id").distinct().select("tree_id", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
        pure = RS.is_pure_clade(RS.resolve(asked, tips), nodes).select("tree_id", "target", "is_monophyletic")
        out = asked.join(N.rooting_info(nodes).select("tree_id", "is_rooted"), "tree_id").join(pure, ["tree_id", "target"], "left")
        reason = F.when(~F.col("is_rooted"), "unrooted").when(F.col("is_monophyletic").isNull(), "unresolved")
        return out.select("tree_id", "target", F.when(F.col("is_rooted"), F.col("is_monophyletic")).alias("is_monophyletic"), reason.alias("reason"))

    def cross_validate(self, nodes: DataFrame, seqs: DataFrame, strict: bool = False) -> DataFrame:
        """(name, status, suggestion) of leaves against sequence names; ``strict`` raises on any difference.  Leaves that the
        alignment lacks get the nearest name in it."""
        tips, ids = nodes.where("is_leaf").select(F.col("label").alias("name")), seqs.select(F.col("seq_id").alias("name"))
        out = R.reconcile(tips, ids, "name", "only_tree", "only_alignment")
        near = R.fuzzy_suggestions(out.where("status = 'only_tree'").select("name"), ids)
        out = out.join(near.select("name", "suggestion"), "name", "left")
        if strict and out.where("status != 'match'").head(1):
            raise InputError("tree and alignment differ")
        return out

    def alignment_report(self, path: str) -> tuple[DataFrame, DataFrame]:
        seqs = AL.read_fasta(self.spark, path)
        return AL.metadata(seqs), AL.findings(seqs)

    def register_sql(self) -> None:
        """``newick_nodes(text)`` as a table function for SQL."""
        self.spark.udtf.register("newick_nodes", _udtf())


def _udtf():
    from pyspark.sql.functions import udtf

    @udtf(returnType="node_id int, parent_id int, label string, branch_length double, is_leaf boolean, depth int, root_dist double, leaf_lo int, leaf_hi int")
    class NewickNodes:
        def eval(self, text: str) -> Iterator[tuple]:
            try:
                rows = NW.node_rows("", 0, NW.parse(text or ""))
            except NW.NewickError:
                return
            for r in rows:
                yield r[2], r[3], r[5], r[6], r[7], r[9], r[10], r[11], r[12]

    return NewickNodes


@STEPS.register("drop_negative_lengths")
def drop_negative_lengths(nodes: DataFrame) -> DataFrame:
    """Negative lengths as missing ones."""
    return nodes.withColumn("branch_length", F.when(F.col("branch_length") >= 0, F.col("branch_length")))


@STEPS.register("drop_internal_labels")
def drop_internal_labels(nodes: DataFrame) -> DataFrame:
    return N.without_internal_labels(nodes)
