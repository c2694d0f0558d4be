"""Interval keys, clade keys, rootings and farthest pairs against plain searches on random trees; ladders and stars stay linear."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoforest.operators import compare as C
from chronoforest.operators import diagnostics as D
from chronoforest.operators import intervals as I
from chronoforest.operators import nodes as N
from chronoforest.operators import relations as R
from chronoforest.operators import reroot as T
from chronoforest.operators import timescale as S
from chronoforest.sources import newick as NW


def random_text(rng, tips, name="q"):
    """A tree of ``tips`` leaves with nodes of one to four children and labels on some inner nodes."""
    made = [f"{name}{i}:{rng.randint(0, 8) / 8}" for i in range(tips)]
    k = 0
    while len(made) > 1:
        take = [made.pop(rng.randrange(len(made))) for _ in range(min(len(made), rng.choice([1, 2, 2, 3, 4])))]
        label, k = (f"{name}x{k}" if rng.random() < 0.6 else ""), k + 1
        made.append(f"({','.join(take)}){label}:{rng.randint(0, 8) / 8}")
    return made[0].rpartition(":")[0] + ";"


TEXTS = {str(s): random_text(random.Random(s), 2 + s * 3 % 29) for s in range(14)}


@pytest.fixture(scope="module")
def nodes(spark):
    trees = spark.createDataFrame([(k, 0, v) for k, v in TEXTS.items()], "tree_id string, tree_ordinal int, newick string")
    return NW.parse_trees(trees)[0].cache()


@pytest.fixture(scope="module")
def roots():
    return {k: NW.parse(v) for k, v in TEXTS.items()}


def ladder(n):
    """A tree in which each inner node has a leaf and the next inner node."""
    return "(" * (n - 1) + "a1:1," + ",".join(f"a{i}:1):1" for i in range(2, n)) + f",a{n}:1);"


def test_cells(spark):
    pairs = [(a, b) for a in range(1, 40) for b in range(a, 40)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", I.cells(F.col("a"), F.col("b")).alias("c")).collect()
    for a, b, c in got:
        assert sorted(x for k, v in c for x in range(v << k, (v + 1) << k)) == list(range(a, b + 1)) and len(c) <= 2 * math.ceil(math.log2(b + 2))
    at = spark.range(1, 40).select("id", I.cells_of(F.col("id")).alias("c")).collect()
    assert all([tuple(x) for x in c] == [(k, i >> k) for k in range(i.bit_length())] for i, c in at)


def test_spans_meet_where_a_walk_says(spark, nodes):
    rows = [r.asDict() for r in nodes.collect()]
    spans = [(t, lo, hi) for t in TEXTS for n in [max(r["leaf_hi"] for r in rows if r["tree_id"] == t)] for lo in range(1, n + 1) for hi in range(lo, min(n, lo + 9) + 1)]
    df = spark.createDataFrame([*spans, ("0", 1, 99), ("0", 0, 1)], "tree_id string, lo int, hi int").withColumn("k", F.struct("lo", "hi"))
    got = {(r["tree_id"], *r["k"]): r["node_id"] for r in N.smallest_container(df, nodes, ["tree_id", "k"]).collect()}
    want = {(t, lo, hi): max((r["depth"], r["node_id"]) for r in rows if r["tree_id"] == t and r["leaf_lo"] <= lo and r["leaf_hi"] >= hi)[1] for t, lo, hi in spans}
    assert got == want


def test_conflicts_and_uncomparable(spark, nodes):
    rng = random.Random(5)
    inner = nodes.where("NOT is_leaf").collect()
    cal = [(r["tree_id"], f"k{i}", r["leaf_lo"], r["leaf_hi"], r["depth"], rng.choice([None, rng.randint(0, 9)]), rng.choice([None, rng.randint(0, 9)])) for i, r in enumerate(inner)]
    df = spark.createDataFrame(cal, "tree_id string, name string, leaf_lo int, leaf_hi int, depth int, min_age int, max_age int")
    inside = [(a, d) for a in cal for d in cal if a[0] == d[0] and a[1] != d[1] and d[2] >= a[2] and d[3] <= a[3]]
    want = {(a[0], a[1], d[1], a[6], d[5]) for a, d in inside if d[4] >= a[4] and a[6] is not None and d[5] is not None and a[6] < d[5]}
    assert {tuple(r) for r in R.temporal_conflicts(df).collect()} == want and want
    nested = {(a[0], *sorted((a[1], d[1]))) for a, d in inside}
    for r in R.uncomparable(df).collect():
        n = sum(c[0] == r["tree_id"] for c in cal)
        assert (r["n_pairs"], r["n_nested"]) == (n * (n - 1) // 2, sum(x[0] == r["tree_id"] for x in nested)) and r["n_uncomparable"] == r["n_pairs"] - r["n_nested"]


def test_descendants_collapse_pairs(spark, nodes, roots):
    tips = {(t, i): [x.label for x in NW_tips(n)] for t, root in roots.items() for i, n in enumerate(root.preorder())}
    got = {}
    for r in N.descendants(nodes.select("tree_id", "node_id"), nodes).orderBy("ord").collect():
        got.setdefault((r["tree_id"], r["node_id"]), []).append(r["label"])
    assert got == tips
    targets = nodes.where("depth = 1").select("tree_id", "node_id")
    left = T.collapse(nodes, targets).groupBy("tree_id").count().collect()
    assert {r["tree_id"]: r["count"] for r in left} == {t: 1 + len(root.children) for t, root in roots.items()}
    pairs = {(r["tree_id"], *sorted((r["a"], r["b"]))): r["distance"] for r in N.leaf_pairs(nodes).collect()}
    for t, root in roots.items():
        for a, b in itertools.combinations(root.tips(), 2):
            assert pairs.pop((t, *sorted((a.label, b.label)))) == pytest.approx(T.distances(root, a)[id(b)])
    assert not pairs


def NW_tips(n):
    out, stack = [], [n]
    while stack:
        x = stack.pop()
        stack += reversed(x.children)
        out += [] if x.children else [x]
    return out


def test_clade_keys_are_leaf_sets(spark, nodes, roots):
    sets = {(t, i): frozenset(x.label for x in NW_tips(n)) for t, root in roots.items() for i, n in enumerate(root.preorder())}
    key = {(r["tree_id"], r["node_id"]): (r["n_leaves"], r["clade"]) for r in I.clade_keys(nodes).collect()}
    by_key = {}
    for at, s in sets.items():
        by_key.setdefault(key[at], set()).add(s)
    assert all(len(s) == 1 for s in by_key.values()) and len(by_key) == len(set(sets.values()))
    members = spark.createDataFrame([(str(k), x) for k, s in enumerate(set(sets.values())) for x in s], "k string, label string")
    assert {(r["n_leaves"], r["clade"]) for r in I.set_keys(members, ["k"]).collect()} == set(by_key)
    shown = N.topology_ids(nodes, nodes.where("depth < 2")).collect()
    assert len(shown) == nodes.where("depth < 2").count() and all(r["topology_id"].startswith(f"{len(sets[r['tree_id'], r['node_id']])}L:") for r in shown)


def test_ladder_is_linear(spark):
    n = 50_000
    trees = spark.createDataFrame([("l", 0, ladder(n))], "tree_id string, tree_ordinal int, newick string")
    nodes = NW.parse_trees(trees)[0].cache()
    nodes.count()
    began = time.time()
    assert [r["same"] for r in N.same_topology(nodes, nodes).collect()] == [True]
    other = nodes.withColumn("label", F.when(F.col("label") == "a7", "zz").otherwise(F.col("label")))
    assert [r["same"] for r in N.same_topology(nodes, other).collect()] == [False]
    members = spark.createDataFrame([("l", k, f"a{x}") for k in range(1, 2001) for x in (k * 11, k * 23)], "tree_id string, k int, label string")
    got = N.mrca(members, nodes, ["k"]).collect()
    # leaves a1 and a2 are deepest; from a_i on the clade holds the first i leaves
    assert len(got) == 2000 and all(r["n_leaves"] == r["k"] * 23 for r in got)
    assert time.time() - began < 120


def test_star_rows(spark):
    text = "(" + ",".join(f"s{i}:1" for i in range(30_000)) + ");"
    began = time.time()
    rows = NW.node_rows("s", 0, NW.parse(text))
    assert [r[4] for r in rows[1:]] == list(range(30_000)) and time.time() - began < 10


def test_least_variance_equals_search(nodes, roots):
    got = {(r["tree_id"], r["node_id"]): r["variance"] for r in T.node_variances(nodes).collect()}
    for t, root in roots.items():
        for i, n in enumerate(root.preorder()):
            d = T.distances(root, n)
            assert got.pop((t, i)) == pytest.approx(np.var([d[id(x)] for x in root.tips()]), abs=1e-9)
    assert not got


def deviation_at(root):
    """Root mean square of 2 d / D - 1 over the pairs of a rooted tree's leaves, by walking."""
    tips, top = root.tips(), T.distances(root, root)
    up = {}
    for t in tips:
        line, n = [], t
        while n is not None:
            line.append(id(n))
            n = n.parent
        up[id(t)] = line
    out = []
    for a, b in itertools.combinations(tips, 2):
        meet = next(x for x in up[id(a)] if x in set(up[id(b)]))
        whole = top[id(a)] + top[id(b)] - 2 * top[meet]
        if whole > 1e-12:
            out.append((2 * (top[id(a)] - top[meet]) / whole - 1) ** 2)
    return math.sqrt(sum(out) / len(out)) if out else 0.0


def test_least_deviation_equals_search():
    for s in range(12):
        text = random_text(random.Random(100 + s), 4 + s % 9)
        rows = T.ancestor_deviations(NW.parse(text))
        for i, (_, at, value) in enumerate(rows):
            def rooted(x, i=i, text=text):
                root = NW.parse(text)
                n = list(root.preorder())[1:][i]
                return deviation_at(T.on_edge(root, n, x))

            assert rooted(at) == pytest.approx(value, abs=1e-9)
            length = list(NW.parse(text).preorder())[1:][i].length or 0.0
            assert min(rooted(length * k / 16) for k in range(17)) >= value - 1e-9
    root, done, _ = T.least_deviation(NW.parse("((a:3,b:3):1,(c:2,d:2):1,e:6);"))
    assert done and deviation_at(root) == pytest.approx(min(d for _, _, d in T.ancestor_deviations(NW.parse("((a:3,b:3):1,(c:2,d:2):1,e:6);"))))


def test_mad_reroot_keeps_distances(nodes):
    before = {(r["tree_id"], *sorted((r["a"], r["b"]))): r["distance"] for r in N.leaf_pairs(nodes).collect()}
    out = T.reroot(nodes, "mad")
    after = {(r["tree_id"], *sorted((r["a"], r["b"]))): r["distance"] for r in N.leaf_pairs(out).collect()}
    assert before.keys() == after.keys() and all(after[k] == pytest.approx(v) for k, v in before.items())


def test_farthest_members_equal_all_pairs(spark, nodes, roots):
    rng = random.Random(9)
    sets = [(t, k, x.label) for t, root in roots.items() for k in range(5) for x in rng.sample(root.tips(), rng.randint(1, len(root.tips())))]
    got = {(r["tree_id"], r["k"]): (r["a"], r["b"], r["distance"], r["n"]) for r in T.farthest_members(spark.createDataFrame(sets, "tree_id string, k int, label string"), nodes, ["k"]).collect()}
    for t, root in roots.items():
        for k in range(5):
            names = [x for x in root.tips() if (t, k, x.label) in set(sets)]
            pairs = [(-round(T.distances(root, a)[id(b)], 9), i, j, a.label, b.label) for (i, a), (j, b) in itertools.combinations(enumerate(names), 2)]
            if pairs:
                d, _, _, a, b = min(pairs)
                assert got.pop((t, k)) == (a, b, -d, len(names))
    assert not got


def test_ess_of_segments(spark):
    rng = np.random.default_rng(4)
    chains = {}
    for k, (n, phi) in enumerate([(5000, 0.0), (5000, 0.9), (3001, 0.995), (7, 0.5), (2, 0.1), (300, -0.5)]):
        x, noise = np.zeros(n), rng.normal(size=n)
        for i in range(n):
            x[i] = phi * x[i - 1] * (i > 0) + noise[i]
        chains[k] = x
    chains[9] = np.ones(50)
    rows = spark.createDataFrame([(int(k), 0, i, float(v)) for k, x in chains.items() for i, v in enumerate(x)], "k int, chain int, iter int, value double")
    got = {r["k"]: r["ess"] for r in D.ess(rows.repartition(5), ["k"], segment=256, lags=16).collect()}
    assert got.keys() == chains.keys()
    for k, x in chains.items():
        assert got[k] == pytest.approx(D.geyer_ess(x), rel=1e-9)


def test_packed_rows_are_fewest(spark):
    rng = random.Random(1)
    bands = [(g, f"b{i}", a, a + rng.randint(0, 12)) for g in ("p", "q") for i in range(60) for a in [rng.randint(0, 99)]]
    got = S.packed(spark.createDataFrame(bands, "rank string, name string, young int, old int"), ["rank"]).collect()
    for g in ("p", "q"):
        own = [r for r in got if r["rank"] == g]
        for row in {r["row"] for r in own}:
            line = sorted((r["young"], r["old"]) for r in own if r["row"] == row)
            assert all(a[1] <= b[0] for a, b in itertools.pairwise(line))
        deepest = max(sum(r["young"] < x + 0.5 < r["old"] for r in own) for x in range(120))
        assert len(own) == 60 and deepest <= max(r["row"] for r in own) + 1 <= deepest + sum(r["young"] == r["old"] for r in own)


def test_fuzzy_names_are_normalised(spark):
    missing = spark.createDataFrame([("Homo-sapiens_HG_38",), ("E_COLI_K12",), ("abc",), ("far away",), ("Same_One",)], "name string")
    there = spark.createDataFrame([("homosapiensHG38",), ("ecolik12",), ("abcde",), ("x",), ("Same_One",), ("sameone",)], "name string")
    got = {r["name"]: (r["suggestion"], r["distance"]) for r in R.fuzzy_suggestions(missing, there).collect()}
    assert got == {"Homo-sapiens_HG_38": ("homosapiensHG38", 0), "E_COLI_K12": ("ecolik12", 0), "abc": ("abcde", 2), "Same_One": ("sameone", 0)}


def test_align_trees_of_other_spellings(spark):
    texts = [("input", "(((GCA_1.1_x:1,beta:1)in1:1,gamma:2)in2:1,'Delta sp':3)top;"), ("m1", "((gamma:2,(GCA_1.1:1,beta:1)u:1)v:1,'delta sp':3)w;"), ("m2", "((beta:1,delta_sp:1)odd:1,GCA_1.1_x:1);")]
    nodes = NW.parse_trees(spark.createDataFrame([(k, 0, v) for k, v in texts], "tree_id string, tree_ordinal int, newick string"))[0]
    ages = [("m1", "u", 0, 1.0), ("m1", "v", 1, 2.0), ("m1", "beta", 2, 9.0), ("m1", "n7", 3, 4.0), ("m2", "calib", 0, 1.5), ("m2", "odd", 1, 7.0), ("m2", "in2", 2, 2.5), ("m2", "delta_sp", 3, 8.0), ("m2", "who", 4, 6.0)]
    ages = spark.createDataFrame([(*a, None, None, None) for a in ages], "method string, node_key string, ordinal int, age double, lo double, hi double, ci_type string")
    members = spark.createDataFrame([("calib", "beta"), ("calib", "gca_1.1_x")], "name string, label string")
    got = C.align_trees(ages, nodes.where("tree_id != 'input'"), nodes.where("tree_id = 'input'"), members).collect()
    by = {(r["method"], r["node_key"]): r for r in got}
    assert set(by) == {("m1", "u"), ("m1", "v"), ("m1", "n7"), ("m2", "calib"), ("m2", "odd"), ("m2", "in2"), ("m2", "who")}
    assert by["m1", "u"]["row_key"] == by["m2", "calib"]["row_key"] and by["m1", "v"]["row_key"] == by["m2", "in2"]["row_key"]
    assert (by["m1", "u"]["depth"], by["m1", "u"]["n_leaves"]) == (2, 2) and by["m2", "odd"]["depth"] == 1
    assert by["m1", "n7"]["alignment"] == "unresolved" and by["m2", "who"]["alignment"] == "name-only"


def test_rerooting_drops_an_old_root_of_one_child(spark):
    texts = ["(((L1:5.2)a:1)b:1)c;", "(((L1:5.2,L2:3)a:1)b:1)c;", "(((L1:5.2,L2:3)a:1,(L3:2)d:2)b:1)c;"]
    nodes = NW.parse_trees(spark.createDataFrame([(str(i), 0, t) for i, t in enumerate(texts)], "tree_id string, tree_ordinal int, newick string"))[0]
    before = {(r["tree_id"], r["a"], r["b"]): r["distance"] for r in N.leaf_pairs(nodes).collect()}
    for way in ("midpoint", "minvar", "mad"):
        out = T.reroot(nodes, way)
        assert {(r["tree_id"], *sorted((r["a"], r["b"]))): pytest.approx(r["distance"]) for r in N.leaf_pairs(out).collect()} == before
