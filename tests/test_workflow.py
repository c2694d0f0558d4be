import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoforest.functions import constraints as C
from chronoforest.functions import names as NM
from chronoforest.functions import taxonomy as TX
from chronoforest.operators import compare as CP
from chronoforest.operators import diagnostics as DG
from chronoforest.operators import nodes as N
from chronoforest.operators import relations as R
from chronoforest.operators import resolve as RS
from chronoforest.operators import timescale as TS
from chronoforest.plans import batch as B
from chronoforest.sources import alignments as AL
from chronoforest.sources import calibrations as CA
from chronoforest.sources import newick as NW
from chronoforest.sources import outputs as OUT


def test_quantiles_of_known_distributions():
    # chi-square of 10 degrees is gamma(5, 1/2): published 2.5 % and 97.5 % points
    lo, hi = C.interval({"type": "gamma", "alpha": 5.0, "beta": 0.5})
    assert math.isclose(lo, 3.24697, abs_tol=1e-4) and math.isclose(hi, 20.48318, abs_tol=1e-4)
    lo, hi = C.interval({"type": "skew_normal", "location": 0.0, "scale": 1.0, "shape": 0.0})
    assert math.isclose(hi, 1.959964, abs_tol=1e-5) and math.isclose(lo, -1.959964, abs_tol=1e-5)
    mean, sd = C.skew_t_moments(0.0, 1.0, 0.0, 1e6)
    assert abs(mean) < 1e-9 and math.isclose(sd, 1.0, abs_tol=1e-5)


@pytest.mark.parametrize(
    ("c", "target", "text", "down"),
    [
        ({"type": "fixed", "age": 9.0}, "mcmctree", "B(0.00891, 0.00909, 0.005, 0.005)", None),
        ({"type": "fixed", "age": 9.0}, "lsd2", "-9.0", None),
        ({"type": "uniform", "min": 60.0, "max": 80.0}, "mcmctree", "B(0.0600, 0.0800, 0.0001, 0.0001)", None),
        ({"type": "uniform", "min": 60.0, "max": 80.0}, "lsd2", "-80.0:-60.0", None),
        ({"type": "uniform", "min": 60.0, "max": 80.0}, "wlogdate", "{Name}={taxa_str}\t70.0", "point estimate 70.0"),
        ({"type": "soft_lower", "min": 50.0}, "lsd2", "NA:-50.0", None),
        ({"type": "soft_lower", "min": 50.0}, "treepl", "min = {Name} 50.0", "hard minimum age 50.0"),
        ({"type": "soft_lower", "min": 50.0}, "mcmctree", "L(0.0500, 0.1, 1.0, 0.025)", None),
        ({"type": "maximum", "max": 110.0}, "r8s", "constrain taxon={label} max_age=110.0;", None),
        ({"type": "maximum", "max": 110.0}, "mdcat", "{Name}={taxa_str}\t55.0", "point estimate 55.0"),
        ({"type": "soft_bounds", "min": 1.0, "max": 2.0}, "pathd8", "mrca: {t1}, {t2}, minage=1.0;\nmrca: {t1}, {t2}, maxage=2.0;", "uniform [1.0, 2.0]"),
    ],
)
def test_renderers(c, target, text, down):
    got = C.render(c, target)
    assert got[0] == text and got[1] == down


def test_constraint_problems():
    codes = lambda c: {k for k, _ in C.problems(c)}
    assert codes({"type": "nope"}) == {"unknown_type"}
    assert codes({"type": "uniform", "min": 5, "max": 5}) == {"min_not_below_max"}
    assert codes({"type": "fixed", "age": float("nan")}) == {"not_finite"}
    assert codes({"type": "fixed", "age": 0}) == {"not_positive"}
    assert codes({"type": "fixed", "age": 5000}) == {"too_old"}
    assert codes({"type": "fixed", "age": 1, "q": 2}) == {"unknown_key"}
    assert codes({"type": "skew_t", "location": 1, "scale": 1, "shape": 1, "df": 2}) == {"df_too_small"}


YAML = """
calibrations:
  - {name: root, is_root: true, taxa: [A, D], constraint: {type: uniform, min: 100, max: 110}}
  - {name: ab, mrca_pair: [A, B], constraint: {type: fixed, age: 120}}
  - {name: bad, mrca_pair: [A, A], constraint: {type: fixed, age: 9}}
  - {name: cd, taxa: [C, D], constraint: {type: range, min: 1, max: 2}, fossil: {min_stratigraphic_age: 5, max_stratigraphic_age: 6}}
"""


def test_calibrations_to_conflicts(spark):
    cal, found = CA.read_calibrations(spark, YAML)
    assert {(r["name"], r["check"]) for r in found.collect()} == {("bad", "bad_pair"), ("cd", "fossil_conflict")}
    text = spark.createDataFrame([("t", 0, "((A:1,B:1)ab:1,(C:1,D:1)cd:1);")], "tree_id string, tree_ordinal int, newick string")
    nodes, _ = NW.parse_trees(text)
    members = cal.select(F.lit("t").alias("tree_id"), "name", F.explode(F.coalesce("mrca_pair", "taxa")).alias("label"))
    placed = N.mrca(members, nodes, ["name"]).join(cal, "name")
    bad = R.temporal_conflicts(placed)
    assert [(r["older"], r["younger"]) for r in bad.collect()] == [("root", "ab")]
    out = C.render_all(cal, ["lsd2", "mcmctree"])
    assert out.count() == 6 and out.where("error IS NOT NULL").count() == 0
    assert CA.parse_short("Mammalia:160-180")["constraint"] == {"type": "uniform", "min": 160.0, "max": 180.0}
    assert CA.parse_short("X:5-5")["constraint"]["type"] == "fixed"
    assert CA.load("a: [")[1][0][1] == "yaml" and CA.load("[]")[1][0][1] == "empty"


def test_resolver(spark):
    tips = spark.createDataFrame(
        [("t", "x_d_Bacteria_1", None), ("t", "y", {"d": "Archaea", "g": "Sulfo"}), ("t", "z_sulfo", None), ("t", "w.alpha", {"d": "Bacteria", "p": None})],
        "tree_id string, label string, taxonomy map<string,string>",
    )
    targets = spark.createDataFrame([("t", x) for x in ("LUCA", "LBCA", "LACA", "ROOT", "y", "sulfo", "alpha", "none", "luca")], "tree_id string, target string")
    got = {}
    for r in RS.resolve(targets, tips).collect():
        got.setdefault(r["target"], [r["how"], set()])[1].add(r["label"])
    assert got["LUCA"] == ["special", {"x_d_Bacteria_1", "y", "w.alpha"}] and got["LBCA"][1] == {"x_d_Bacteria_1", "w.alpha"}
    assert got["ROOT"][1] == {"x_d_Bacteria_1", "y", "z_sulfo", "w.alpha"}
    assert got["y"] == ["exact", {"y"}] and got["sulfo"] == ["taxonomy", {"y"}] and got["alpha"] == ["token", {"w.alpha"}]
    assert "none" not in got and "luca" not in got
    assert {r["detail"] for r in RS.missing_domains(RS.resolve(targets, tips), tips).collect()} == {"LACA"}


def test_taxonomy(spark):
    df = spark.createDataFrame([("a", "d__Bacteria;p__Firm;c__;p__Last"), ("b", "GB_GCA_1_d_Bacteria_p_Proteo_g_Esch"), ("c", "Bacteria; Firm"), ("d", "plain")], "name string, label string")
    got = {r["name"]: r["t"] for r in df.select("name", TX.parse_taxonomy(F.col("label")).alias("t")).collect()}
    assert got["a"] == {"d": "Bacteria", "c": None, "p": "Last"}
    assert got["b"] == {"d": "Bacteria", "p": "Proteo", "g": "Esch"}
    assert got["c"] == {"d": "Bacteria", "p": "Firm"} and got["d"] == {}
    cyc = spark.createDataFrame([({"d": "A", "p": "B"},), ({"d": "B", "p": "A"},), ({"d": "A", "p": "C"},)], "taxonomy map<string,string>")
    assert [(r["up"], r["down"]) for r in TX.two_cycles(cyc).collect()] == [("A", "B")]
    m = spark.createDataFrame([({"d": "A", "p": None}, {"d": "B", "c": "X"})], "a map<string,string>, b map<string,string>")
    r = m.select(TX.merge_taxonomy(F.col("a"), F.col("b")).alias("m"), TX.conflicts(F.col("a"), F.col("b")).alias("c"), TX.format_taxonomy(F.col("a")).alias("f")).first()
    assert r["m"] == {"d": "B", "p": None, "c": "X"} and r["c"] == ["d"] and r["f"] == "d__A;p__"


def test_names(spark):
    assert NM.claim(["a", "a", "a_2", "a"], 30) == ["a", "a_2", "a_2_2", "a_3"]
    assert NM.claim(["abcdef", "abcdef"], 6) == ["abcdef", "abcd_2"]
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate(["A b!", "A_b", "x", "A(b)"])], "scope string, ordinal int, original string")
    assert [r["short"] for r in NM.short_names(df, "scope").orderBy("ordinal").collect()] == ["A_b", "A_b_2", "x", "A_b_3"]
    m = spark.createDataFrame([("Homo_sapien",), ("zzz",)], "name string")
    a = spark.createDataFrame([("Homo_sapiens",), ("Homo_sapienss",), ("qqq",)], "name string")
    assert [tuple(r) for r in R.fuzzy_suggestions(m, a).collect()] == [("Homo_sapien", "Homo_sapiens", 1)]


def test_alignments(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">s1 note\nACGT\nAC\n>s2\nACGTA!\n>s2\nAC\n")
    seqs = AL.read_fasta(spark, str(tmp_path / "a.fasta"))
    assert sorted((r["seq_id"], r["seq"]) for r in seqs.collect()) == [("s1", "ACGTAC"), ("s2", "AC"), ("s2", "ACGTA!")]
    assert {(r["check"], r["position"]) for r in AL.findings(seqs).collect()} == {("duplicate_sequence", None), ("invalid_residue", 6), ("unequal_length", None)}
    t = spark.createDataFrame([("f", "@r1\nACGT\n+\n!!!!\n@r2\nAC\n+\n!\n"), ("p", "2 4\nA  ACGT\nB  AC-T\n"), ("s", "# STOCKHOLM 1.0\nA ACG\nB ACT\nA TT\nB GG\n//\n")], "aln_id string, text string")
    assert [(r["seq_id"], r["ok"]) for r in AL.parse_fastq(t.where("aln_id = 'f'")).collect()] == [("r1", True), ("r2", False)]
    assert [(r["seq_id"], r["seq"]) for r in AL.parse_phylip(t.where("aln_id = 'p'")).collect()] == [("A", "ACGT"), ("B", "AC-T")]
    assert {(r["seq_id"], r["length"]) for r in AL.parse_blocks(t.where("aln_id = 's'")).collect()} == {("A", 5), ("B", 5)}
    kinds = t.select("aln_id", AL.detect_format(F.lit("x.txt"), F.col("text")).alias("k")).collect()
    assert {r["aln_id"]: r["k"] for r in kinds} == {"f": "fastq", "p": "phylip", "s": "stockholm"}


def test_ess_and_psrf(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=2000)
    ar = np.zeros(2000)
    for i in range(1, 2000):
        ar[i] = 0.9 * ar[i - 1] + x[i]
    assert 1200 < DG.geyer_ess(x) < 2900 and 50 < DG.geyer_ess(ar) < 220 and DG.geyer_ess(np.ones(10)) == 0
    rows = [("p", c, i, float(v)) for c in (0, 1) for i, v in enumerate(rng.normal(size=500))] + [("q", c, i, float(v + 10 * c)) for c in (0, 1) for i, v in enumerate(rng.normal(size=500))] + [("one", 0, 0, 1.0)]
    s = spark.createDataFrame(rows, "param string, chain int, iter int, value double")
    psrf = {r["param"]: r["psrf"] for r in R.psrf(s, ["param"]).collect()}
    assert psrf["p"] < 1.02 and psrf["q"] > 3 and psrf["one"] is None
    both = R.psrf(s, ["param"]).join(DG.ess(s, ["param"]), "param")
    verdict = {r["param"]: r["v"] for r in both.select("param", R.convergence(both).alias("v")).collect()}
    assert verdict == {"p": True, "q": False, "one": None}
    h = {r["param"]: (r["lo"], r["hi"]) for r in DG.hpd(s.where("param = 'p'"), ["param"]).collect()}
    assert -2.3 < h["p"][0] < -1.6 and 1.6 < h["p"][1] < 2.3
    assert {r["param"]: r["disjoint_pairs"] for r in R.chain_summary(s, ["param"]).collect()}["q"] == 1


def test_comparison(spark):
    ages = spark.createDataFrame([("m1", "x", 0, 48.31, 41.2, 55.6, "HPD95"), ("m1", "x", 1, 48.3, 41.2, 55.6, "HPD95"), ("m2", "cal", 0, 50.0, None, None, None), ("m2", "n12", 1, 5.0, None, None, None), ("m2", "who", 2, 6.0, None, None, None)], "method string, node_key string, ordinal int, age double, lo double, hi double, ci_type string")
    clades = spark.createDataFrame([("m1", "x", "2L:aa", 2, 1)], "method string, label string, topology_id string, n_leaves int, depth int")
    cal = spark.createDataFrame([("cal", "2L:aa", 2, 1)], "name string, topology_id string, n_leaves int, depth int")
    inp = spark.createDataFrame([], "label string, topology_id string, n_leaves int, depth int")
    al = CP.align(ages, clades, cal, inp).cache()
    assert {(r["row_key"], r["method"]): r["alignment"] for r in al.collect()} == {("2L:aa", "m1"): "topology", ("2L:aa", "m2"): "topology", ("?n12", "m2"): "unresolved", ("?who", "m2"): "name-only"}
    rep = {r["row_key"]: (r["m1"], r["m2"]) for r in CP.report(al, ["m1", "m2"]).collect()}
    assert rep["2L:aa"] == ("48.3 [41.2,55.6]_HPD95", "50.0") and rep["?who"] == ("NA", "6.0")
    assert [r["row_key"] for r in CP.ordered(al.select("row_key", "alignment", "depth", "n_leaves").distinct()).collect()] == ["2L:aa", "?who", "?n12"]


def test_program_outputs(spark):
    t = spark.createDataFrame([("a", "log\nsmoothing   chi-square\n1 9.5\n10 3.5\n100 3.5\n"), ("b", "Name Age min max\nroot 100.0 - 110\nx 9.0 9.0 9.0\n"), ("c", "cal1 node 48.3\ncal2 n 1.5\ncal2 n 2.5\n"), ("d", "opt = 3\noptad = 5\nSubstitution rate is per time unit\n\n  0.0123\nNumber of informative fix nodes: 2\n tree x = (A:1,B:2);")], "run_id string, text string")
    best = R.best_smoothing(OUT.smoothing_table(t.where("run_id = 'a'")), ["run_id"]).first()
    assert (best["smoothing"], best["chisq"]) == (10.0, 3.5)
    assert [(r["name"], r["age"], r["min"], r["max"]) for r in OUT.bound_table(t.where("run_id = 'b'")).orderBy("ordinal").collect()] == [("root", 100.0, None, 110.0), ("x", 9.0, 9.0, 9.0)]
    names = spark.createDataFrame([("cal1",), ("cal2",)], "name string")
    assert {r["name"]: (r["age"], r["conflicting"]) for r in OUT.named_ages(t.where("run_id = 'c'"), names).collect()} == {"cal1": (48.3, False), "cal2": (None, True)}
    d = t.where("run_id = 'd'").select(OUT.prime_options(F.col("text")).alias("o"), OUT.substitution_rate(F.col("text")).alias("r"), OUT.informative_counts(F.col("text")).alias("n"), OUT.chronogram(F.col("text")).alias("t")).first()
    assert (d["o"]["opt"], d["o"]["optad"], d["r"], d["n"], d["t"]) == (3, 5, 0.0123, {"fix": 2}, "(A:1,B:2);")
    lab = spark.createDataFrame([("a|48.3",), ("a|2020-01-02",), ("a",), ('a[&date="7.5"]',)], "l string")
    assert [tuple(r["d"]) for r in lab.select(OUT.date_token(F.col("l")).alias("d")).collect()] == [("ma", 48.3), ("calendar", None), ("none", None), ("ma", 7.5)]


def test_samples_and_timescale(spark, tmp_path):
    (tmp_path / "mcmc.txt").write_text("Gen\tt_n5\tmu\n0\t1.0\t2.0\n10\t1.5\t2.5\n")
    s = OUT.read_samples(spark, str(tmp_path / "mcmc.txt"), 1)
    assert sorted((r["iter"], r["param"], r["value"]) for r in s.collect()) == [(0, "mu", 2.0), (0, "t_n5", 1.0), (10, "mu", 2.5), (10, "t_n5", 1.5)]
    (tmp_path / "scale.csv").write_text("name,start,end,rank,parent,color\nA,0,10,period,,x\nB,20,10,period,,y\n")
    scale = TS.read_timescale(spark, str(tmp_path / "scale.csv"))
    ages = spark.createDataFrame([(5.0,), (15.0,), (99.0,)], "age double")
    assert [(r["age"], r["name"]) for r in TS.intervals_of(ages, scale).orderBy("age").collect()] == [(5.0, "A"), (15.0, "B"), (99.0, None)]
    assert [r["name"] for r in TS.bands_in(scale, 12, 13).collect()] == ["B"]


def test_batch(spark):
    jobs = spark.createDataFrame([("s1", "lsd2", "f1", "x"), ("s2", "lsd2", "f2", "x"), ("s3", "r8s", "f3", "x")], "sample_id string, method string, fingerprint string, input string")
    done = spark.createDataFrame([("s1", "lsd2", "f1", "ok"), ("s2", "lsd2", "old", "ok"), *[("s3", "r8s", "f3", "failed")] * 3], "sample_id string, method string, fingerprint string, status string")
    assert [r["sample_id"] for r in B.resumable(jobs, done).collect()] == ["s2"]
    runs = B.run_jobs(jobs.select("sample_id", "method", "input"), lambda m, i: (["no-such-program-here"], {"in.txt": i})).collect()
    assert {r["status"] for r in runs} == {"unavailable"}
    echo = B.run_jobs(jobs.limit(1).select("sample_id", "method", "input"), lambda m, i: (["cat", "in.txt"], {"in.txt": i})).first()
    assert (echo["status"], echo["log"]) == ("ok", "x")
    err = spark.createDataFrame([("Out of memory",), ("weird",)], "l string").select(B.error_class(F.col("l")).alias("k")).collect()
    assert [r["k"] for r in err] == ["memory", "unknown"]
