import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoforest.operators import nodes as N
from chronoforest.operators import reroot as RR
from chronoforest.sources import newick as NW

SMALL = "(((owl:1.5,hare:2.25):0.5,fern:3.0):1.25,moss:6.0);"
TEXTS = [
    ("small", SMALL),
    ("star", "(p:7,q:5,r:3,s:2,t:1);"),
    ("named", "(((owl,hare)beasts,fern)land,moss)all;"),
    ("negative", "(elm:0.0,(ash:2.5,yew:-1.5):4.0);"),
    ("quoted", "('a b':1,'it''s':2[&rate=0.5,date=\"3\"]);"),
    ("twice", "((A:1,B:1)x:1,(A:2,C:1)x:1);"),
    ("broken", "((A:0.1,B:0.2):0.3;"),
    ("empty", ""),
]


@pytest.fixture(scope="module")
def trees(spark):
    return spark.createDataFrame([(k, 0, v) for k, v in TEXTS], "tree_id string, tree_ordinal int, newick string")


@pytest.fixture(scope="module")
def nodes(trees):
    return NW.parse_trees(trees)[0].cache()


def rows(df):
    return [tuple(r) for r in df.collect()]


def random_tree(rng, tips):
    items = [f"t{i}:{rng.randint(0, 9) / 4}" for i in range(tips)]
    while len(items) > 1:
        k = min(len(items), rng.choice([2, 2, 2, 3]))
        rng.shuffle(items)
        inner = "(" + ",".join(items[:k]) + ")"
        items = [*items[k:], inner + (f":{rng.randint(0, 9) / 4}" if len(items) > k else "")]
    return items[0] + ";"


def tip_distances(root):
    tips = root.tips()
    out = {}
    for t in tips:
        d = RR.distances(root, t)
        out |= {(t.label, u.label): round(d[id(u)], 9) for u in tips}
    return out


def test_parse_findings(trees):
    bad = {r["tree_id"] for r in NW.parse_trees(trees)[1].collect()}
    assert bad == {"broken", "empty"}
    text = {(r["tree_id"], r["check"]) for r in NW.text_findings(trees).collect()}
    assert ("broken", "unbalanced_bracket") in text and ("empty", "empty") in text and not any(k == "small" for k, _ in text)


def test_mrca_monophyly_ages(spark, nodes):
    m = spark.createDataFrame([("small", "x", "owl"), ("small", "x", "hare"), ("small", "y", "hare"), ("small", "y", "moss"), ("small", "z", "owl"), ("small", "z", "yak")], "tree_id string, k string, label string")
    got = {r["k"]: (r["n_leaves"], r["depth"]) for r in N.mrca(m, nodes, ["k"]).collect()}
    assert got == {"x": (2, 2), "y": (4, 0)}
    assert {r["k"]: r["is_monophyletic"] for r in N.monophyly(m, nodes, ["k"]).collect()} == {"x": True, "y": False}
    ages = {r["label"]: round(r["age"], 9) for r in N.ages(nodes).where("tree_id = 'small' AND is_leaf").collect()}
    assert ages == {"owl": 2.75, "hare": 2.0, "fern": 1.75, "moss": 0.0}


def test_pairs_and_shape(nodes):
    small = nodes.where("tree_id = 'small'")
    d = {(r["a"], r["b"]): round(r["distance"], 9) for r in N.leaf_pairs(small).collect()}
    root = NW.parse(SMALL)
    want = tip_distances(root)
    assert d == {k: want[k] for k in d} and len(d) == 6
    info = {r["tree_id"]: (r["root_children"], r["is_rooted"]) for r in N.rooting_info(nodes).collect()}
    assert info["small"] == (2, True) and info["star"] == (5, False)
    assert {r["tree_id"] for r in N.is_binary(nodes).where("NOT is_binary").collect()} == {"star"}
    assert {(r["tree_id"], r["check"]) for r in N.branch_findings(nodes).collect()} == {("negative", "negative_branch"), ("negative", "zero_branch")}
    assert {(r["tree_id"], r["check"], r["severity"]) for r in N.duplicate_names(nodes).collect()} == {("twice", "duplicate_tip", "error"), ("twice", "duplicate_internal", "warning")}


def test_round_trip(nodes, trees):
    back = {r["tree_id"]: r["newick"] for r in NW.write_trees(nodes).collect()}
    again = {k: NW.write(NW.parse(v)) for k, v in back.items()}
    assert back == again and back["small"] == SMALL and "'it''s':2.0" in back["quoted"]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 14))
def test_rerooting_keeps_distances(seed, tips):
    rng = random.Random(seed)
    text = random_tree(rng, tips)
    want = tip_distances(NW.parse(text))
    for f in (RR.midpoint, RR.least_variance, lambda r: RR.outgroup(r, {"t0"})):
        root, done, _ = f(NW.parse(text))
        assert tip_distances(root) == want
        if f is RR.midpoint and done:
            d = RR.distances(root, root)
            top = sorted((d[id(t)] for t in root.tips()), reverse=True)
            assert math.isclose(top[0], max(want.values()) / 2, abs_tol=1e-6)


def test_reroot_prune_layout(spark, nodes):
    small = nodes.where("tree_id = 'small'")
    r = RR.reroot(small, "midpoint").cache()
    assert r.where("is_leaf").count() == 4 and r.where("is_root").count() == 1
    keep = spark.createDataFrame([("small", "owl"), ("small", "fern"), ("small", "moss")], "tree_id string, label string")
    p = RR.prune(small, keep)
    assert {x["newick"] for x in NW.write_trees(p).collect()} == {"((owl:2.0,fern:3.0):1.25,moss:6.0);"}
    xy = RR.layout(small)
    assert xy.count() == 7 and RR.segments(xy, small).count() == 9


def test_files_and_modes(spark, tmp_path):
    (tmp_path / "a.nex").write_bytes(b"\xef\xbb\xbf#NEXUS\nBegin trees;\n translate 1 A, 2 B;\n tree x = [&R] (1:1,2:2);\n tree y = (2:1,1:1);\nEnd;\n")
    (tmp_path / "b.nwk").write_text("(A,B);(C,D);\n")
    t = NW.read_trees(spark, str(tmp_path))
    assert t.count() == 4
    assert {r["newick"] for r in NW.read_trees(spark, str(tmp_path), "last").collect()} == {"(B:1.0,A:1.0);", "(C,D);"}
    with pytest.raises(Exception, match="several trees"):
        NW.read_trees(spark, str(tmp_path), "error").collect()


def test_deep_caterpillar(spark):
    n = 3000
    text = "(" * (n - 1) + "t0" + "".join(f",t{i}:1):1" for i in range(1, n)) + ";"
    nodes, bad = NW.parse_trees(spark.createDataFrame([("deep", 0, text)], "tree_id string, tree_ordinal int, newick string"))
    assert bad.count() == 0 and nodes.where("is_leaf").count() == n


def test_stream(spark, tmp_path):
    from chronoforest.streaming.ingest import ingest

    src = tmp_path / "in"
    src.mkdir()
    (src / "one.nwk").write_text(SMALL + "\n((A,B);\n")
    for _ in range(2):
        q = ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out/nodes")).count() == 7
    assert spark.read.parquet(str(tmp_path / "out/findings")).count() == 2
