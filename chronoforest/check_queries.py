"""Queries over readers of alignments and trees, checks of inputs, and tables of the workflow, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.constraints import render_all
from .functions.taxonomy import conflicts
from .operators import audit as A
from .operators import nodes as N
from .operators import relations as R
from .operators import timescale as TS
from .order_queries import ORD, trees
from .plans import batch as B
from .plans import inputs as P
from .queries import query, table
from .sources import alignments as AL
from .sources import newick
from .sources import tables as ST

SEQ = """WITH s AS (SELECT p_brand AS aln_id, 'p' || p_partkey AS seq_id, p_partkey AS k, translate(upper(p_type), 'BDHJKMNORXZSUVWYPFLIQE', 'ACGTACGTACGTACGTACGTAC') AS seq FROM part) """


def part_sequences(spark, d):
    seq = F.translate(F.upper("p_type"), "BDHJKMNORXZSUVWYPFLIQE", "ACGTACGTACGTACGTACGTAC")
    return table(spark, d, "part").select(F.col("p_brand").alias("aln_id"), F.concat(F.lit("p"), "p_partkey").alias("seq_id"), F.col("p_partkey").alias("k"), seq.alias("seq"))


def texts(rows, line, head=None, end: str = ""):
    """(aln_id, text): the lines of each alignment in order of keys."""
    body = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("x")))), lambda r: r["x"]))
    g = rows.groupBy("aln_id").agg(body.alias("body"), F.count("*").alias("n"), F.max(F.length("seq")).alias("l"))
    return g.select("aln_id", F.concat(head if head is not None else F.lit(""), "body", F.lit(end)).alias("text"))


@query(SEQ + "SELECT aln_id, seq_id, seq, k % 7 <> 0 AS ok FROM s")
def fastq_records(spark, d):
    """FASTQ texts, one a brand; every seventh record's quality is too short."""
    quality = F.expr("repeat('I', length(seq) - if(k % 7 = 0, 1, 0))")
    t = texts(part_sequences(spark, d), F.concat(F.lit("@"), "seq_id", F.lit(" note\r\n"), "seq", F.lit("\n+\n"), quality))
    return AL.parse_fastq(t).drop("quality")


@query(SEQ + "SELECT aln_id, seq_id, seq, count(*) OVER (PARTITION BY aln_id)::INT AS n_declared, max(length(seq)) OVER (PARTITION BY aln_id)::INT AS length_declared FROM s")
def phylip_records(spark, d):
    """PHYLIP texts with their declared counts."""
    t = texts(part_sequences(spark, d), F.concat("seq_id", F.lit("  "), F.substring("seq", 1, 4), F.lit(" "), F.expr("substring(seq, 5)")), F.concat_ws(" ", F.col("n").cast("string"), F.concat(F.col("l").cast("string"), F.lit("\n"))))
    return AL.parse_phylip(t)


@query(SEQ + "SELECT aln_id, seq_id, 2 * length(seq) AS length FROM s")
def stockholm_records(spark, d):
    """Stockholm texts in two blocks, whose fragments add up."""
    s = part_sequences(spark, d)
    block = F.concat("seq_id", F.lit("   "), "seq")
    t = texts(s.unionByName(s.withColumn("k", F.col("k") + 1_000_000_000)), block, F.lit("# STOCKHOLM 1.0\n\n"), "\n//\n")
    return AL.parse_blocks(t)


@query(SEQ + """, x AS (SELECT aln_id, CASE WHEN k % 11 = 0 THEN 'same' ELSE seq_id END AS seq_id, CASE WHEN k % 13 = 0 THEN '' WHEN k % 5 = 0 THEN seq || '4' ELSE seq END AS seq FROM s)
SELECT aln_id, 'duplicate_sequence' AS "check", seq_id AS detail, NULL::INT AS position FROM x GROUP BY aln_id, seq_id HAVING count(*) > 1 UNION ALL SELECT aln_id, 'empty_sequence', seq_id, NULL FROM x WHERE seq = ''
UNION ALL SELECT aln_id, 'invalid_residue', seq_id || ':4', length(seq)::INT FROM x WHERE seq LIKE '%4' UNION ALL SELECT aln_id, 'unequal_length', '', NULL FROM x GROUP BY aln_id HAVING min(length(seq)) <> max(length(seq))""")
def alignment_findings(spark, d):
    """Duplicate names, empty sequences, residues outside the alphabet, unequal lengths."""
    k = F.col("k")
    x = part_sequences(spark, d).select("aln_id", F.when(k % 11 == 0, "same").otherwise(F.col("seq_id")).alias("seq_id"), F.when(k % 13 == 0, "").when(k % 5 == 0, F.concat("seq", F.lit("4"))).otherwise(F.col("seq")).alias("seq"))
    return AL.findings(x).drop("severity")


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'fasta' WHEN 1 THEN 'fastq' WHEN 2 THEN 'stockholm' WHEN 3 THEN 'clustal' WHEN 4 THEN 'nexus' WHEN 5 THEN 'phylip' ELSE 'unknown' END AS kind FROM orders""")
def alignment_formats(spark, d):
    """Formats by signature, else by the file's name."""
    k = F.col("o_orderkey") % 7
    head = F.when(k == 0, ">a\nAC").when(k == 1, "@a\nAC").when(k == 2, "# STOCKHOLM 1.0").when(k == 3, "CLUSTAL W").when(k == 4, "#NEXUS").otherwise("...")
    name = F.concat(F.lit("dir/x"), F.col("o_orderkey"), F.when(k == 5, ".phy").otherwise(".bin"))
    return table(spark, d, "orders").select("o_orderkey", AL.detect_format(name, head).alias("kind"))


@query("""SELECT o_orderkey::VARCHAR AS tree_id, unnest(CASE o_orderkey % 9 WHEN 0 THEN ['unbalanced_bracket'] WHEN 1 THEN ['control_character'] WHEN 2 THEN ['bidi_character'] WHEN 3 THEN ['zero_width_character'] WHEN 4 THEN ['empty_name']
    WHEN 5 THEN ['self_loop'] WHEN 6 THEN ['several_trees'] WHEN 7 THEN ['empty'] ELSE [] END) AS "check" FROM orders""")
def text_checks(spark, d):
    """A fault of each kind in trees' texts; every ninth is sound."""
    k, name = F.col("o_orderkey") % 9, F.concat(F.lit("t"), F.col("o_orderkey"))
    bad = [
        F.concat(F.lit("(("), name, F.lit(":1,x:2);")), F.concat(F.lit("("), name, F.lit("\x07:1,x:2);")), F.concat(F.lit("("), name, F.lit("‮:1,x:2);")), F.concat(F.lit("("), name, F.lit("​:1,x:2);")),
        F.concat(F.lit("("), name, F.lit(":1,:2);")), F.concat(F.lit("(("), name, F.lit(":0)"), name, F.lit(":1,x:2);")), F.concat(F.lit("("), name, F.lit(":1,x:2);(a,b);")), F.lit("  "),
    ]
    text = F.concat(F.lit("("), name, F.lit(":1,x:2);"))
    for i, t in enumerate(bad):
        text = F.when(k == i, t).otherwise(text)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("tree_id"), text.alias("newick"))
    return newick.text_findings(rows).select("tree_id", "check")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'nexus' WHEN 1 THEN 'phyloxml' WHEN 2 THEN 'newick' ELSE 'auto' END AS kind FROM orders""")
def tree_formats(spark, d):
    k = F.col("o_orderkey") % 4
    head = F.when(k == 0, "#NEXUS\nbegin").when(k == 1, "<?xml version='1.0'?><phyloxml>").when(k == 2, "(a,b);").otherwise("text")
    return table(spark, d, "orders").select("o_orderkey", ST.tree_format(F.concat(F.lit("x"), F.col("o_orderkey"), F.lit(".dat")), head).alias("kind"))


CALS = """WITH c AS (SELECT o_custkey::VARCHAR AS tree_id, 'n' || o_orderkey AS name, CASE o_orderstatus WHEN 'F' THEN 'fixed' ELSE 'uniform' END AS type, o_orderkey % 5 = 0 AS is_root, o_orderkey % 7 AS node_id FROM orders) """


def order_points(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("tree_id"), F.concat(F.lit("n"), k).alias("name"), F.when(F.col("o_orderstatus") == "F", "fixed").otherwise("uniform").alias("type"), (k % 5 == 0).alias("is_root"), (k % 7).alias("node_id"))


@query(CALS + """SELECT tree_id, 'pathd8' AS method, 'no_fixed_age' AS "check", '' AS detail FROM c GROUP BY tree_id HAVING NOT bool_or(type = 'fixed') UNION ALL SELECT tree_id, 'lsd2', 'no_internal_calibration', '' FROM c GROUP BY tree_id HAVING bool_and(is_root)
UNION ALL SELECT tree_id, 'mcmctree', 'fixed_root', name FROM c WHERE is_root AND type = 'fixed' UNION ALL SELECT tree_id, 'mcmctree', 'node_calibrated_twice', min(name) FROM c GROUP BY tree_id, node_id HAVING count(*) > 1""")
def method_inputs(spark, d):
    """What three programs can't do with a tree's calibrations."""
    return P.input_findings(order_points(spark, d), ["pathd8", "lsd2", "mcmctree"])


@query("""WITH c AS (SELECT o_custkey::VARCHAR AS tree_id, 'n' || o_orderkey AS name, 'a' || o_orderkey || ',b' || o_orderkey || chr(9) || '-' || (o_orderkey % 90 + 1) AS line FROM orders)
SELECT tree_id, count(*) || chr(10) || string_agg(line, chr(10) ORDER BY name) || chr(10) AS content FROM c GROUP BY tree_id""")
def date_files(spark, d):
    """LSD2's date files: a count and a line a calibration."""
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("tree_id"), F.concat(F.lit("n"), k).alias("name"), F.concat(F.lit("a"), k).alias("a"), F.concat(F.lit("b"), k).alias("b"), F.concat(F.lit("-"), k % 90 + 1).alias("text"), F.lit(None).cast("array<string>").alias("taxa"))
    return P.lsd2_dates(c)


@query(ORD + """, t AS (SELECT tree_id, max(rd) AS top FROM n GROUP BY 1) SELECT tree_id, label, round(top - rd, 6) AS age FROM n JOIN t USING (tree_id)""")
def order_ages(spark, d):
    """Ages of all nodes of all trees."""
    return N.ages(trees(spark, d)).select("tree_id", "label", F.round("age", 6).alias("age"))


@query(ORD + "SELECT tree_id, label, len AS age, 250.0::DOUBLE AS parent_age FROM o WHERE len > 250.000001")
def order_chronology(spark, d):
    """Nodes older than their parents."""
    nodes = trees(spark, d)
    aged = nodes.withColumn("age", F.when(F.col("is_leaf"), F.col("branch_length")).otherwise(F.lit(250.0)))
    return N.chronology_breaks(aged).select("tree_id", "label", "age", "parent_age")


@query("""WITH r AS (SELECT l_orderkey::VARCHAR AS tree_id, 'n' || l_linenumber AS label, l_returnflag AS token, l_extendedprice AS age FROM lineitem),
p AS (SELECT DISTINCT tree_id, 'n' || (substr(label, 2)::INT + 1) AS name, token FROM r), a AS (SELECT tree_id, label, min(age) AS age FROM r GROUP BY ALL), b AS (SELECT tree_id, token, min(age) AS age FROM r GROUP BY ALL)
SELECT p.tree_id, p.name, p.token AS topology_id, coalesce(a.age, b.age) AS age, CASE WHEN a.age IS NOT NULL THEN 'label' ELSE 'clade' END AS found_by FROM p LEFT JOIN a ON a.tree_id = p.tree_id AND a.label = p.name JOIN b ON b.tree_id = p.tree_id AND b.token = p.token""")
def calibrations_found(spark, d):
    """Calibrations in dated trees: by label, else by clade."""
    li = table(spark, d, "lineitem")
    dated = li.select(F.col("l_orderkey").cast("string").alias("tree_id"), F.concat(F.lit("n"), "l_linenumber").alias("label"), F.col("l_returnflag").alias("topology_id"), F.col("l_extendedprice").alias("age"))
    placed = li.select(F.col("l_orderkey").cast("string").alias("tree_id"), F.concat(F.lit("n"), F.col("l_linenumber") + 1).alias("name"), F.col("l_returnflag").alias("topology_id")).distinct()
    # a name may stand for two clades here: both are part of it
    named = placed.select("tree_id", F.concat_ws("/", "name", "topology_id").alias("name"), "topology_id")
    spelt = dated.withColumn("label", F.explode(F.array(*[F.concat_ws("/", "label", F.lit(x)) for x in ("A", "N", "R")])))
    at = F.split("name", "/")
    return A.calibrated_ages(named, spelt).select("tree_id", at[0].alias("name"), at[1].alias("topology_id"), "age", "found_by")


@query("""SELECT p_brand AS tree_id, p_partkey::VARCHAR AS name, p_type AS topology_id, target, CASE WHEN target = 'wlogdate' THEN 'point estimate ' || CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE ELSE p_size::DOUBLE + 5 END::VARCHAR
    WHEN p_partkey % 2 = 0 THEN 'hard minimum age ' || p_size::DOUBLE::VARCHAR ELSE 'uniform [' || p_size::DOUBLE::VARCHAR || ', ' || (p_size + 10)::DOUBLE::VARCHAR || ']' END AS degraded_to FROM part, (SELECT unnest(['treepl', 'wlogdate']) AS target)""")
def degradations(spark, d):
    """What soft bounds lose in two programs, with the nodes that it concerns."""
    size, even = F.col("p_size").cast("double"), F.col("p_partkey") % 2 == 0
    c = F.struct(F.when(even, "soft_lower").otherwise("soft_bounds").alias("type"), size.alias("min"), F.when(~even, size + 10).alias("max"))
    p = table(spark, d, "part").withColumn("name", F.col("p_partkey").cast("string"))
    placed = p.select(F.col("p_brand").alias("tree_id"), "name", F.col("p_type").alias("topology_id"))
    return A.degradations(render_all(p.select("name", c.alias("constraint")), ["treepl", "wlogdate"]), placed).drop("notes")


@query("""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 10 = 1 THEN false ELSE 1 + p_size / 600.0 <= 1.05 AND p_retailprice - 800 >= 100 END AS converged FROM part""")
def convergence_verdicts(spark, d):
    """Null where a diagnostic is unknown, false where it is no number."""
    s = F.col("p_size")
    psrf = F.when(s % 10 == 0, F.lit(None)).when(s % 10 == 1, F.lit(float("nan"))).otherwise(1 + s / 600.0)
    rows = table(spark, d, "part").select("p_partkey", psrf.cast("double").alias("psrf"), (F.col("p_retailprice") - 800).alias("ess"))
    return rows.select("p_partkey", R.convergence(rows).alias("converged"))


@query("""SELECT c_custkey, n_name AS band FROM customer LEFT JOIN nation ON n_nationkey * 400 - 900 <= c_acctbal AND c_acctbal <= n_nationkey * 400 - 400""")
def ages_in_bands(spark, d):
    """Balances in the bands of a scale whose bounds come in either order; some lie between bands."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey") * 400.0
    a, b = k - 900, k - 400
    scale = n.select(F.col("n_name").alias("name"), F.least(a, b).alias("young"), F.greatest(a, b).alias("old"), F.lit("nation").alias("rank"))
    return TS.intervals_of(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("age")), scale).select("c_custkey", F.col("name").alias("band"))


@query("""SELECT 'duplicate_sample' AS "check", o_custkey::VARCHAR AS detail, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1
UNION ALL SELECT 'duplicate_output', (o_orderkey // 2)::VARCHAR, count(*) FROM orders GROUP BY o_orderkey // 2 HAVING count(*) > 1""")
def batch_identities(spark, d):
    """Samples and folders that a batch names twice."""
    o = table(spark, d, "orders")
    return B.identity_findings(o.select(F.col("o_custkey").cast("string").alias("sample_id"), F.expr("o_orderkey div 2").cast("string").alias("output_dir")))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'memory' WHEN 1 THEN 'missing_file' WHEN 2 THEN 'permission' WHEN 3 THEN 'timeout' ELSE 'unknown' END AS kind FROM orders""")
def error_kinds(spark, d):
    """The first rule that a program's output meets."""
    k = F.col("o_orderkey") % 5
    log = F.concat(F.lit("step "), F.col("o_orderkey"), F.lit("\n"), F.when(k == 0, "terminate: std::bad_alloc").when(k == 1, "Cannot open x; Permission denied").when(k == 2, "Permission denied").when(k == 3, "it timed out").otherwise("odd"))
    return table(spark, d, "orders").select("o_orderkey", B.error_class(log).alias("kind"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'p' ELSE '' END AS ranks FROM customer""")
def taxonomy_conflicts(spark, d):
    """Ranks on which a label and a table differ; missing ones don't."""
    k = F.col("c_custkey")
    a = F.create_map(F.lit("d"), F.lit("X"), F.lit("p"), F.col("c_mktsegment"))
    b = F.when(k % 3 == 0, F.create_map(F.lit("d"), F.lit("X"), F.lit("p"), F.lit("other"))).when(k % 3 == 1, F.create_map(F.lit("d"), F.lit("X"))).otherwise(a)
    return table(spark, d, "customer").select("c_custkey", F.array_join(conflicts(a, b), ",").alias("ranks"))
