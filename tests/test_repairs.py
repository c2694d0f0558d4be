"""Inputs that readers and runners once took wrongly."""

import os
import stat

import pytest
from pyspark.sql import functions as F

from chronoforest.functions import constraints as C
from chronoforest.functions.names import serial_names
from chronoforest.operators import relations as R
from chronoforest.plans import batch
from chronoforest.sources import alignments as A
from chronoforest.sources import newick
from chronoforest.sources import tables as T


def test_fasta_marks_inside_headers(spark, tmp_path):
    (tmp_path / "a.fasta").write_bytes(b">s1 A->B swap\r\nACGT\r\nAC\r\n>s2 >x\nGG\n")
    got = [(r["seq_id"], r["seq"]) for r in A.read_fasta(spark, str(tmp_path)).orderBy("seq_id").collect()]
    assert got == [("s1", "ACGTAC"), ("s2", "GG")]


def test_encoding_is_judged_on_whole_files(spark, tmp_path):
    (tmp_path / "border.txt").write_bytes(b"a" * ((1 << 20) - 1) + "é".encode() * 4)
    (tmp_path / "late.txt").write_bytes(b"a" * (3 << 20) + b"\xff\r\n")
    got = {(os.path.basename(r["path"]), r["check"]) for r in T.file_findings(spark, str(tmp_path)).collect()}
    assert got == {("late.txt", "not_utf8"), ("late.txt", "windows_line_ends")}


def test_quoted_taxonomy_cells(spark, tmp_path):
    (tmp_path / "t.csv").write_text('name,domain,phylum\nt1,"Bact, sp",P\n"t ""2""",B,"Q"\n')
    rows, _ = T.read_taxonomy(spark, str(tmp_path / "t.csv"))
    got = {r["name"]: (r["taxonomy"]["d"], r["taxonomy"]["p"]) for r in rows.collect()}
    assert got == {"t1": ("Bact, sp", "P"), 't "2"': ("B", "Q")}


def test_sequence_vote(spark):
    rows = [("ACGTRYKM" * 40 + "EFIL",), ("MKVLAWFEEQ",), ("",), ("NNNNBDH",)]
    assert [r[0] for r in spark.createDataFrame(rows, "s string").select(A.sequence_type(F.col("s"))).collect()] == ["dna", "protein", "dna", "dna"]


def test_serial_names_above_five_digits(spark):
    names = serial_names(spark.createDataFrame([(1,), (10_000,), (100_000,)], "ordinal long"))
    assert [r["short"] for r in names.orderBy("ordinal").collect()] == ["S00001", "S10000", "S100000"]


def test_jobs_return_files_and_whole_logs(spark, tmp_path):
    tool = tmp_path / "stub"
    tool.write_text("#!/bin/sh\necho 'out of memory' >&2\nhead -c 9000 /dev/zero | tr '\\0' x >&2\nsed 's/A/B/' input.txt > tree.nwk\n")
    tool.chmod(tool.stat().st_mode | stat.S_IEXEC)
    jobs = spark.createDataFrame([("s1", "stub", "(A:1,C:2);\n")], "sample_id string, method string, input string")
    path = str(tool)
    run = batch.run_jobs(jobs, lambda method, text: ([path], {"input.txt": text}))
    r = run.withColumn("class", batch.error_class(F.col("log"))).first()
    assert r["status"] == "ok" and r["files"] == {"tree.nwk": "(B:1,C:2);\n"} and r["class"] == "memory"
    nodes, _ = newick.parse_trees(run.select(F.col("sample_id").alias("tree_id"), F.lit(0).alias("tree_ordinal"), F.col("files")["tree.nwk"].alias("newick")))
    assert {x["label"]: x["root_dist"] for x in nodes.where("is_leaf").collect()} == {"B": 1.0, "C": 2.0}
    with pytest.raises(Exception, match="2 jobs"):
        batch.run_jobs(jobs.unionAll(jobs), lambda method, text: ([path], {"input.txt": text})).collect()


def test_single_chain_has_a_dense_interval(spark):
    rows = [("p", 1, float(v)) for v in range(100)] + [("p", 1, 1e6)] + [("q", c, float(c * 10 + i)) for c in (1, 2) for i in range(3)]
    got = {r["param"]: r for r in R.chain_summary(spark.createDataFrame(rows, "param string, chain int, value double"), ["param"]).collect()}
    assert (got["p"]["ci_type"], got["p"]["lo"], got["p"]["hi"]) == ("HPD95", 0.0, 95.0)
    assert (got["q"]["ci_type"], got["q"]["lo"], got["q"]["hi"]) == ("RANGE", 10.0, 22.0)


def test_degenerate_bounds_are_refused():
    with pytest.raises(ValueError, match="after rounding"):
        C.mcmctree({"type": "uniform", "min": 50.0, "max": 50.0 + 1e-12})


def test_statements_with_marks_inside_names():
    text = "#NEXUS\nBEGIN TREES;\nTRANSLATE 1 'a, b', 2 \"c;d\";\nTREE t [note; more] = [&R] (1:1,2[x;y]:2);\nEND;"
    out = newick.statements(text)
    assert len(out) == 1 and [t.label for t in newick.parse(out[0]).tips()] == ["a, b", "c;d"]
    assert newick.statements("('x;y',b)[c;d];(c,d);") == ["('x;y',b)[c;d];", "(c,d);"]


def test_ranks_on_skewed_keys(spark):
    from chronoforest.operators import relations as R

    values = [None, float("nan"), 0.0, 0.0, -1e300, 1e300, *(2.0**-i for i in range(200)), *([7.0] * 50)]
    rows = spark.createDataFrame([(i % 3, i, v) for i, v in enumerate(values)], "g int, i int, v double")
    got = {r["i"]: r["rank"] for r in R.ranked(rows, ["g"], "v", ["i"], ranges=16).collect()}
    place = lambda i: (0, 0, i) if values[i] is None else (2, 0, i) if values[i] != values[i] else (1, values[i], i)
    for g in range(3):
        order = sorted((i for i in range(len(values)) if i % 3 == g), key=place)
        assert [got[i] for i in order] == list(range(1, len(order) + 1))
    assert R.ranked(rows.limit(0), ["g"], "v").count() == 0


def test_farthest_pair_against_all_pairs(spark):
    import random

    from chronoforest.operators import nodes as N
    from chronoforest.operators import reroot as T
    from chronoforest.sources import newick

    rng, texts = random.Random(5), []
    for k in range(12):
        parts = [f"t{i}:{rng.randint(0, 6)}" for i in range(rng.randint(2, 14))]
        while len(parts) > 1:
            take = [parts.pop(rng.randrange(len(parts))) for _ in range(min(len(parts), rng.randint(2, 3)))]
            parts.append(f"({','.join(take)}):{rng.randint(0, 5)}")
        texts.append((str(k), 0, parts[0] + ";"))
    texts.append(("one", 0, "(a:1);"))
    nodes = newick.parse_trees(spark.createDataFrame(texts, "tree_id string, tree_ordinal int, newick string"))[0].cache()
    want = {r["tree_id"]: (r["a"], r["b"], r["distance"]) for r in N.farthest_pair(N.leaf_pairs(nodes)).collect()}
    got = {r["tree_id"]: (r["a"], r["b"], r["distance"]) for r in T.diameter(nodes).collect()}
    assert got == want and len(got) == 12


def test_texts_of_trees(spark, tmp_path):
    from chronoforest.sources import newick

    rows = [("a", 0, "((x:-1,y:0)[&h={1,2}]:1e-3,'q:9':.5);"), ("b", 1, "(u:0)u:7;"), ("c", 0, "no tree"), ("d", 2, None)]
    trees = spark.createDataFrame(rows, "tree_id string, tree_ordinal int, newick string")
    got = {r["tree_id"]: tuple(r)[1:] for r in newick.length_scan(trees).collect()}
    assert got == {"a": (4, 1, 1, 0.5), "b": (2, 0, 1, 7.0), "c": (0, 0, 0, None), "d": (0, 0, 0, None)}
    loops = newick.text_findings(trees).where("check = 'self_loop'").collect()
    assert [r["tree_id"] for r in loops] == ["b"]
    text = newick.nexus_texts(trees.where("tree_id < 'c'").withColumn("source", F.lit("s"))).first()["text"]
    (tmp_path / "t.nex").write_text(text)
    back = newick.read_trees(spark, str(tmp_path / "t.nex")).orderBy("tree_ordinal").collect()
    assert [r["newick"] for r in back] == [rows[0][2], rows[1][2]]
    root = newick.parse("(x[&&NHX:S=human:B=100]:1,y:2);")
    assert newick.write(root, comments=True, style="nhx") == "(x:1.0[&&NHX:B=100:S=human],y:2.0);"
    assert newick.parse(newick.write(root, comments=True, style="nhx")).children[0].comments == {"S": "human", "B": "100"}


def test_taxonomy_files_have_headers_of_their_own(spark, tmp_path):
    from chronoforest.sources import tables as T

    (tmp_path / "a.tsv").write_text("name\tphylum\tdomain\nx\tP\tD\n")
    (tmp_path / "b.tsv").write_text("domain\tphylum\tname\nE\tQ\ty\nname\tphylum\tdomain\n")
    rows, found = T.read_taxonomy(spark, str(tmp_path))
    got = {r["name"]: dict(r["taxonomy"]) for r in rows.collect()}
    assert got == {"x": {"p": "P", "d": "D"}, "y": {"p": "Q", "d": "E"}, "domain": {"p": "phylum", "d": "name"}}
    assert found.count() == 0
