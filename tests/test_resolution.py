"""Targets meet the names that leaves go by, not all leaves."""

import random

from pyspark.sql import functions as F

from chronoforest.functions.taxonomy import tokens
from chronoforest.operators import resolve as S
from chronoforest.queries import QUERIES

PARTS = ["GCF", "a", "B", "Bacteria", "archaea", "x.1", "é", "", "1", "Homo sapiens", "a-b", "(x)"]


def test_no_join_on_the_tree_alone(spark, sf):
    plan = QUERIES["resolved_targets"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("target" in line or "name" in line or "nation" in line for line in joins) and "RLIKE" not in plan


def test_resolution_against_all_pairs(spark):
    rng = random.Random(2)
    label = lambda: "_".join(rng.choice(PARTS) for _ in range(rng.randint(1, 4)))
    ranks = lambda: rng.choice([None, {}, {"d": rng.choice(["Bacteria", "Archaea", "", None]), "p": rng.choice(PARTS)}, {"g": rng.choice(PARTS).upper()}])
    tips = [(t, label(), ranks()) for t in ("1", "2") for _ in range(40)]
    asked = [(t, x) for t in ("1", "2") for x in [*(l for u, l, _ in tips[::3] if u == t), *(label() for _ in range(40)), *PARTS, *(p.upper() for p in PARTS), "sapiens", "ROOT", "LUCA", "LBCA", "LACA", "root", None]]
    tips_df = spark.createDataFrame(tips, "tree_id string, label string, taxonomy map<string,string>")
    low = lambda x: x.lower()
    flat = lambda tax: str(sorted((tax or {}).items()))
    domains = {(r["tree_id"], r["label"], flat(r["taxonomy"])): (r["d"], r["t"]) for r in tips_df.withColumn("d", S.domain_of(F.col("label"), F.col("taxonomy"))).withColumn("t", tokens(F.col("label"))).collect()}

    def kind(tip, target):
        _, name, tax = tip
        domain, parts = domains[tip[0], name, flat(tax)]
        if target in S.SPECIAL:
            want = S.SPECIAL[target]
            return "0special" if want is None or domain in want else None
        if name == target:
            return "1exact"
        if any(v is not None and low(v) == low(target) for v in (tax or {}).values()):
            return "2taxonomy"
        if f"_{low(target)}_" in f"_{low(name)}_":
            return "3word"
        return "4token" if low(target) in parts else None

    want = []
    for tree, target in set(asked):
        found = [(kind(tip, target), tip[1]) for tip in tips if tip[0] == tree and target is not None]
        found = [x for x in found if x[0]]
        want += [(tree, target, name, k[1:]) for k, name in found if k == min(found)[0]]
    got = S.resolve(spark.createDataFrame(asked, "tree_id string, target string"), tips_df).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({r["how"] for r in got}) == 5
