"""Queries over many small trees read each tree once."""

import random

import pytest

from chronoforest.operators import reroot as T
from chronoforest.queries import QUERIES
from chronoforest.sources import newick


def python_steps(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("MapInArrow") + plan.count("MapInPandas")


def random_tree(rng: random.Random, n: int) -> str:
    parts = [f"t{i}:{rng.choice([0, 1, 2, rng.random() * 100])}" for i in range(n)]
    while len(parts) > 1:
        take = [parts.pop(rng.randrange(len(parts))) for _ in range(min(len(parts), rng.randint(2, 4)))]
        parts.append(f"({','.join(take)}):{rng.choice([0, 1, rng.random() * 50])}")
    return parts[0] + ";"


@pytest.mark.parametrize("query", ["order_least_deviation", "order_outgroup"])
def test_trees_are_read_once(spark, sf, query):
    assert python_steps(QUERIES[query](spark, sf)) == 2  # the reader, and what is done with the trees


def test_deviations_of_many_trees(monkeypatch):
    rng = random.Random(4)
    texts = [random_tree(rng, rng.randint(1, 12)) for _ in range(150)] + ["((a:1):2);", "a;", "(a:0,b:0);", "(a:1,b:1,c:1);"]
    roots = [newick.parse(t) for t in texts]
    for cells in (T.CELLS, 300):  # at once; and in many parts, the larger trees alone
        monkeypatch.setattr(T, "CELLS", cells)
        found = list(T.many_deviations(roots))
        assert len(found) == len(roots)
        for root, (edges, at, deviation) in zip(roots, found, strict=True):
            want = T.ancestor_deviations(root)
            assert [id(v) for v, _, _ in want] == [id(v) for v in edges]
            assert at.tolist() == pytest.approx([a for _, a, _ in want], abs=1e-7)
            assert deviation.tolist() == pytest.approx([d for _, _, d in want], abs=1e-7)


def test_rooted_deviations_against_pairs(spark):
    from pyspark.sql import functions as F

    from chronoforest.operators import nodes as N

    rng = random.Random(8)
    rows = [(str(k), 0, random_tree(rng, rng.randint(2, 14))) for k in range(40)] + [("one", 0, "(a:1);")]
    nodes = newick.parse_trees(spark.createDataFrame(rows, "tree_id string, tree_ordinal int, newick string"))[0].cache()
    pairs = {r["tree_id"]: (r["n"], r["total"]) for r in N.leaf_pairs(nodes).groupBy("tree_id").agg(F.count("*").alias("n"), F.sum("distance").alias("total")).collect()}
    least = {r["tree_id"]: r["d"] for r in T.edge_deviations(nodes).groupBy("tree_id").agg(F.min("deviation").alias("d")).collect()}
    edges = T.rooted_deviations(nodes).withColumn("part", F.expr("branch_length * n_leaves * (n_tips - n_leaves)"))
    got = edges.groupBy("tree_id").agg(F.max("n_tips").alias("n"), F.sum("part").alias("total"), F.max("before").alias("before"), F.min("deviation").alias("after")).collect()
    assert {r["tree_id"] for r in got} == set(pairs)
    for r in got:
        assert r["n"] * (r["n"] - 1) // 2 == pairs[r["tree_id"]][0]
        assert r["total"] == pytest.approx(pairs[r["tree_id"]][1], abs=1e-6)
        assert r["before"] == pytest.approx(least[r["tree_id"]], abs=1e-7) and r["after"] == pytest.approx(r["before"], abs=1e-6)


def test_outgroups_against_joins(spark):
    from chronoforest.operators import nodes as N

    rng = random.Random(6)
    rows = [(str(k), 0, random_tree(rng, rng.randint(2, 12))) for k in range(30)]
    sets = [(t, str(g), f"t{i}") for t, _, text in rows for g in range(3) for i in range(text.count("t")) if rng.random() < 0.3] + [("0", "odd", "t0"), ("0", "odd", "missing"), ("none", "0", "t0")]
    nodes = newick.parse_trees(spark.createDataFrame(rows, "tree_id string, tree_ordinal int, newick string"))[0].cache()
    got = {(r["tree_id"], r["outgroup"]): tuple(r)[2:] for r in T.outgroup_clades(nodes, spark.createDataFrame(sets, "tree_id string, outgroup string, label string")).collect()}
    assert len(got) > 50 and ("0", "odd") not in got and ("none", "0") not in got
    for g in range(3):
        some = spark.createDataFrame([(t, x) for t, name, x in sets if name == str(g) and t != "none"], "tree_id string, label string")
        out = T.reroot(nodes, "outgroup", some.groupBy("tree_id").agg({"label": "collect_list"}).toDF("tree_id", "names"))
        done = {r["tree_id"]: r["was_rerooted"] for r in out.where("is_root").collect()}
        clades = {r["tree_id"]: (r["n_members"], r["n_leaves"], done[r["tree_id"]]) for r in N.monophyly(some, out.select(*nodes.columns), []).collect()}
        assert {t: x for (t, name), x in got.items() if name == str(g)} == clades


def test_names_are_no_column_of_nodes(spark):
    """A list of names on each row of a tree would take the square of its leaves in the shuffle."""
    n = 400
    nodes = newick.parse_trees(spark.createDataFrame([("a", 0, "(" + ",".join(f"t{i}:1" for i in range(n)) + ");")], "tree_id string, tree_ordinal int, newick string"))[0]
    names = spark.createDataFrame([("a", [f"t{i}" for i in range(n // 2)])], "tree_id string, names array<string>")
    for out, left in ((T.reroot(nodes, "outgroup", names), n), (T.prune(nodes, names.selectExpr("tree_id", "explode(names) AS label")), n // 2)):
        assert "array<string>" not in out._jdf.queryExecution().optimizedPlan().treeString() and "_names" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert out.where("is_leaf").count() == left
