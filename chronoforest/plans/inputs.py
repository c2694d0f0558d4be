"""Input files of the dating programs, rendered from node and calibration tables, one row a (tree, program).

calibrations here: tree_id, name, a, b (the two leaves that span the node), taxa, text (the program's rendering), is_root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import nodes as N


def filled(text: Column) -> Column:
    """A rendering with its place holders put in."""
    out = F.replace(text, F.lit("{label}"), F.col("name"))
    out = F.replace(F.replace(out, F.lit("{t1}"), F.col("a")), F.lit("{t2}"), F.col("b"))
    return F.replace(F.replace(out, F.lit("{Name}"), F.col("name")), F.lit("{taxa_str}"), F.array_join(F.coalesce("taxa", F.array("a", "b")), "+"))


def _joined(calibrations: DataFrame, line: Column) -> DataFrame:
    rows = calibrations.select("tree_id", F.struct("name", line.alias("line")).alias("s"))
    return rows.groupBy("tree_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["line"]), "\n").alias("body"), F.count("*").alias("n"))


def lsd2_dates(calibrations: DataFrame) -> DataFrame:
    """(tree_id, content): a count line, then ``a,b<TAB>date`` a calibration."""
    g = _joined(calibrations, F.concat(F.col("a"), F.lit(","), F.col("b"), F.lit("\t"), filled(F.col("text"))))
    return g.select("tree_id", F.concat(F.col("n").cast("string"), F.lit("\n"), "body", F.lit("\n")).alias("content"))


def wlogdate_constraints(calibrations: DataFrame) -> DataFrame:
    g = _joined(calibrations, filled(F.col("text")))
    return g.select("tree_id", F.concat("body", F.lit("\n")).alias("content"))


def pathd8_infile(trees: DataFrame, calibrations: DataFrame, sites: int) -> DataFrame:
    """Sequence length, tree, bounds, then names of the calibrated nodes."""
    bounds = _joined(calibrations, filled(F.col("text")))
    names = _joined(calibrations, F.concat(F.lit("name of mrca: "), F.col("a"), F.lit(", "), F.col("b"), F.lit(", name="), F.col("name"), F.lit(";"))).select("tree_id", F.col("body").alias("names"))
    j = trees.join(bounds, "tree_id").join(names, "tree_id")
    return j.select("tree_id", F.concat(F.lit(f"Sequence length={sites};\n\n"), "newick", F.lit("\n\n"), "body", F.lit("\n\n"), "names", F.lit("\n")).alias("content"))


def treepl_config(trees: DataFrame, calibrations: DataFrame, sites: int, threads: int = 1, seed: int = 42, smoothing: float | None = None) -> DataFrame:
    nodes = _joined(calibrations, F.concat(F.lit("mrca = "), F.col("name"), F.lit(" "), F.col("a"), F.lit(" "), F.col("b"), F.lit("\n"), filled(F.col("text"))))
    tail = f"nthreads = {threads}\nseed = {seed}\n" + (f"smooth = {smoothing}\nthorough\n" if smoothing is not None else "cv\n")
    return trees.join(nodes, "tree_id").select("tree_id", F.concat(F.lit(f"treefile = tree.nwk\nnumsites = {sites}\n"), "body", F.lit("\n" + tail)).alias("content"))


def r8s_block(trees: DataFrame, calibrations: DataFrame, sites: int, method: str = "nprs") -> DataFrame:
    lines = _joined(calibrations, F.concat(F.lit("mrca "), F.col("name"), F.lit(" "), F.col("a"), F.lit(" "), F.col("b"), F.lit(";\n"), filled(F.col("text"))))
    head = f"begin r8s;\nblformat nsites={sites} lengths=persite ultrametric=no;\n"
    body = F.concat(F.lit("#NEXUS\nbegin trees;\ntree t = "), F.col("newick"), F.lit("\nend;\n" + head), F.col("body"), F.lit(f"\ndivtime method={method} algorithm=powell;\nshowage shownamed=yes;\ndescribe plot=chronogram plot=tree_description;\nend;\n"))
    return trees.join(lines, "tree_id").select("tree_id", body.alias("content"))


def control_file(settings: dict[str, object]) -> str:
    """``key = value`` lines of a control file."""
    return "".join(f"{k:>14} = {v}\n" for k, v in settings.items())


def input_findings(calibrations: DataFrame, methods: list[str]) -> DataFrame:
    """(tree_id, method, check, detail): what a program can't do with a tree's calibrations.

    PATHd8 needs a fixed age; LSD2 one calibration that isn't the root's; MCMCTree no fixed root, and no node twice.
    calibrations: tree_id, name, type, is_root, node_id."""
    out = []
    g = calibrations.groupBy("tree_id")
    if "pathd8" in methods:
        out.append(g.agg(F.bool_or(F.col("type") == "fixed").alias("ok")).where("NOT ok").select("tree_id", F.lit("pathd8").alias("method"), F.lit("no_fixed_age").alias("check"), F.lit("").alias("detail")))
    if "lsd2" in methods:
        out.append(g.agg(F.count_if(~F.col("is_root")).alias("n")).where("n = 0").select("tree_id", F.lit("lsd2").alias("method"), F.lit("no_internal_calibration").alias("check"), F.lit("").alias("detail")))
    if "mcmctree" in methods:
        out.append(calibrations.where("is_root AND type = 'fixed'").select("tree_id", F.lit("mcmctree").alias("method"), F.lit("fixed_root").alias("check"), F.col("name").alias("detail")))
        out.append(calibrations.groupBy("tree_id", "node_id").agg(F.count("*").alias("n"), F.min("name").alias("detail")).where("n > 1").select("tree_id", F.lit("mcmctree").alias("method"), F.lit("node_calibrated_twice").alias("check"), "detail"))
    if not out:
        return calibrations.limit(0).select("tree_id", F.lit("").alias("method"), F.lit("").alias("check"), F.lit("").alias("detail"))
    both = out[0]
    for x in out[1:]:
        both = both.unionByName(x)
    return both


def annotate(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` whose inner labels become calibration texts, quoted in the written tree: labels (tree_id, node_id, text)."""
    j = nodes.join(labels.select("tree_id", "node_id", F.col("text").alias("_t")), ["tree_id", "node_id"], "left")
    return j.withColumn("label", F.when(F.col("is_leaf"), F.col("label")).otherwise(F.col("_t"))).select(nodes.columns)


def rescale(nodes: DataFrame, threshold: float = 1e-4, factor: float = 1.0) -> DataFrame:
    """Branches times max(factor, 10 * threshold / shortest positive one) where the shortest is under ``threshold``; the
    column ``rescaled_by`` undoes it."""
    low = nodes.where("branch_length > 0").groupBy("tree_id").agg(F.min("branch_length").alias("_m"))
    by = F.when(F.col("_m") < threshold, F.greatest(F.lit(factor), 10 * threshold / F.col("_m"))).otherwise(F.lit(1.0))
    return nodes.join(low, "tree_id", "left").withColumn("rescaled_by", F.coalesce(by, F.lit(1.0))).withColumn("branch_length", F.col("branch_length") * F.col("rescaled_by")).select(*nodes.columns, "rescaled_by")


def spans_root(calibrations: DataFrame, nodes: DataFrame) -> DataFrame:
    """calibrations (tree_id, name, a, b) with ``is_root``: whether a and b meet at the root."""
    members = calibrations.select("tree_id", "name", F.explode(F.array("a", "b")).alias("label"))
    m = N.mrca(members, nodes, ["name"]).select("tree_id", "name", (F.col("depth") == 0).alias("is_root"))
    return calibrations.drop("is_root").join(m, ["tree_id", "name"])
