from pyspark.sql import functions as F

from chronoforest.operators import audit as A
from chronoforest.operators import nodes as N
from chronoforest.operators import reroot as RR
from chronoforest.plans import inputs as IN
from chronoforest.sources import newick as NW
from chronoforest.sources import tables as TB

import pytest


@pytest.fixture(scope="module")
def nodes(spark):
    t = spark.createDataFrame([("t", 0, "((A:1,B:1)ab:1,(C:1,D:0.00001):1);")], "tree_id string, tree_ordinal int, newick string")
    return NW.parse_trees(t)[0].cache()


def test_taxonomy_tables(spark, tmp_path):
    (tmp_path / "wide.tsv").write_text("name\tdomain\tphylum\nx\tBacteria\t\ny\tArchaea\nz\tA\tB\tC\n")
    e, f = TB.read_taxonomy(spark, str(tmp_path / "wide.tsv"))
    assert {r["name"]: r["taxonomy"] for r in e.collect()} == {"x": {"d": "Bacteria", "p": None}, "y": {"d": "Archaea", "p": None}, "z": {"d": "A", "p": "B"}}
    assert {(r["check"], r["detail"]) for r in f.collect()} == {("short_row", "y"), ("long_row", "z")}
    (tmp_path / "two.tsv").write_text("x\td__A;p__B\n")
    e, f = TB.read_taxonomy(spark, str(tmp_path / "two.tsv"))
    assert [tuple(r) for r in e.collect()] == [("x", {"d": "A", "p": "B"})] and f.count() == 0
    (tmp_path / "none.tsv").write_text("name\tdomain\n")
    assert [r["check"] for r in TB.read_taxonomy(spark, str(tmp_path / "none.tsv"))[1].collect()] == ["no_entries"]
    TB.write_taxonomy(e, str(tmp_path / "out"))
    assert TB.read_taxonomy(spark, str(tmp_path / "out"))[0].collect() == e.collect()
    with pytest.raises(ValueError):
        TB.safe_path("a/../b")


def test_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"\xef\xbb\xbf(A,B);\r\n")
    (tmp_path / "b").write_bytes(b"")
    (tmp_path / "c").write_bytes(b"\xff\xfe")
    got = {(r["path"][-1], r["check"]) for r in TB.file_findings(spark, str(tmp_path)).collect()}
    assert got == {("a", "byte_order_mark"), ("a", "windows_line_ends"), ("b", "empty_file"), ("c", "not_utf8")}
    heads = spark.createDataFrame([("#NEXUS",), ("[&R] (A,B);",), ("# STOCKHOLM 1.0",), ("x",)], "h string")
    assert [r["k"] for r in heads.select(TB.tree_format(F.lit("f.nwk"), F.col("h")).alias("k")).collect()] == ["nexus", "newick", "stockholm", "newick"]


def test_inputs(spark, nodes):
    cal = spark.createDataFrame([("t", "ab", "A", "B", None, "-9.0", "fixed", 1), ("t", "root", "A", "D", ["A", "C", "D"], "-110.0:-100.0", "uniform", 0)], "tree_id string, name string, a string, b string, taxa array<string>, text string, type string, node_id int")
    assert IN.lsd2_dates(cal).first()["content"] == "2\nA,B\t-9.0\nA,D\t-110.0:-100.0\n"
    rooted = IN.spans_root(cal, nodes)
    assert {r["name"]: r["is_root"] for r in rooted.collect()} == {"ab": False, "root": True}
    assert IN.input_findings(rooted, ["pathd8", "lsd2", "mcmctree"]).count() == 0
    only = rooted.where("is_root").withColumn("type", F.lit("fixed"))
    assert {(r["method"], r["check"]) for r in IN.input_findings(only.unionByName(only), ["lsd2", "mcmctree"]).collect()} == {("lsd2", "no_internal_calibration"), ("mcmctree", "fixed_root"), ("mcmctree", "node_calibrated_twice")}
    w = cal.where("name = 'root'").withColumn("text", F.lit("{Name}={taxa_str}\t105.0"))
    assert IN.wlogdate_constraints(w).first()["content"] == "root=A+C+D\t105.0\n"
    trees = NW.write_trees(nodes)
    p = cal.withColumn("text", F.lit("mrca: {t1}, {t2}, fixage=9.0;"))
    text = IN.pathd8_infile(trees, p, 3000).first()["content"]
    assert text.startswith("Sequence length=3000;") and "mrca: A, B, fixage=9.0;" in text and "name of mrca: A, D, name=root;" in text
    assert "min = ab 9.0" in IN.treepl_config(trees, cal.withColumn("text", F.lit("min = {Name} 9.0")), 100).first()["content"]
    assert "fixage taxon=ab age=9;" in IN.r8s_block(trees, cal.withColumn("text", F.lit("fixage taxon={label} age=9;")), 100).first()["content"]


def test_audit(spark):
    req = spark.createDataFrame([("r", "B(1)"), ("r", "B(1)"), ("r", "U(2)")], "run_id string, text string")
    files = spark.createDataFrame([("r", "(A,B)'B(1)';")], "run_id string, content string")
    assert {(r["text"], r["wanted"], r["found"]) for r in A.written_back(req, files).collect()} == {("B(1)", 2, 1), ("U(2)", 1, 0)}
    b = spark.createDataFrame([("r", "x", "min", 5.0), ("r", "x", "min", 7.0), ("r", "x", "max", 9.0), ("r", "y", "fix", 3.0)], "run_id string, name string, kind string, age double")
    eff = A.effective_bounds(b)
    assert {r["name"]: (r["lo"], r["hi"]) for r in eff.collect()} == {"x": (7.0, 9.0), "y": (3.0, 3.0)}
    rep = spark.createDataFrame([("r", "x", 6.0, 9.0)], "run_id string, name string, min double, max double")
    assert {(r["name"], r["check"]) for r in A.reconcile_bounds(eff, rep).collect()} == {("x", "bound_loosened"), ("y", "bound_missing")}
    ages = spark.createDataFrame([("r", "x", 9.01), ("r", "y", 5.0)], "run_id string, name string, age double")
    assert {(r["name"], r["check"]) for r in A.violations(ages, eff).collect()} == {("x", "at_boundary"), ("y", "bound_violated")}


def test_tree_extras(spark, nodes):
    assert {r["name"] for r in RR.name_internal(nodes).collect()} == {"internal_node_1", "internal_node_2"}
    assert RR.digest(NW.parse("((A:1,B:2):1,C:1);")) == RR.digest(NW.parse("(C:1,(B:2,A:1):1);")) != RR.digest(NW.parse("((A:1,C:2):1,B:1);"))
    inner = nodes.where("label = 'ab'").select("tree_id", "node_id")
    assert N.tip_names(RR.collapse(nodes, inner)).count() == 3
    r = IN.rescale(nodes)
    assert r.where("branch_length > 0 AND branch_length < 1e-4").count() == 0 and r.select("rescaled_by").distinct().count() == 1
    dated = N.ages(nodes).join(N.topology_ids(nodes), ["tree_id", "node_id"])
    placed = dated.where("label = 'ab'").select("tree_id", F.lit("cal").alias("name"), "topology_id")
    assert [(r["age"], r["found_by"]) for r in A.calibrated_ages(placed, dated).collect()] == [(1.0, "clade")]
