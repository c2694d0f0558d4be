"""Queries over trees in Newick texts that are built from the supplied tables, through the library's own readers and operators.

A nation is a tree, its market segments are the inner nodes, its customers the leaves; balances (absolute) are the leaves'
branch lengths, and a segment's branch is as long as the nation's key plus 1.  Texts are made by one aggregation a nation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.constraints import whole_age
from .functions.names import accession, serial_names, short_names
from .functions.taxonomy import parse_taxonomy
from .operators import compare as C
from .operators import diagnostics as D
from .operators import nodes as N
from .operators import reroot as T
from .plans.batch import program_version, same_series
from .queries import query, table
from .sources import alignments as A
from .sources import newick
from .sources.tables import calibrated_texts


def tree_texts(spark, d):
    """(tree_id, tree_ordinal, newick)"""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nk"), F.col("c_mktsegment").alias("seg"), "c_custkey", F.concat(F.lit("c"), "c_custkey", F.lit(":"), F.abs("c_acctbal").cast("decimal(18,2)").cast("string")).alias("tip"))
    seg = c.groupBy("nk", "seg").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "tip"))), lambda x: x.tip)).alias("tips"))
    seg = seg.select("nk", "seg", F.concat(F.lit("("), "tips", F.lit(")"), "seg", F.lit(":"), (F.col("nk") + 1).cast("string")).alias("clade"))
    out = seg.groupBy("nk").agg(F.concat_ws(",", F.array_sort(F.collect_list("clade"))).alias("clades"))
    return out.select(F.col("nk").cast("string").alias("tree_id"), F.lit(0).alias("tree_ordinal"), F.concat(F.lit("("), "clades", F.lit(")n"), F.col("nk").cast("string"), F.lit(";")).alias("newick"))


def trees(spark, d):
    return newick.parse_trees(tree_texts(spark, d))[0]


TIPS = """WITH tip AS (SELECT c_nationkey::VARCHAR AS tree_id, c_mktsegment AS seg, c_custkey AS k, 'c' || c_custkey AS label, abs(c_acctbal)::DECIMAL(18,2) AS len, (c_nationkey + 1)::DECIMAL(18,2) AS up FROM customer) """


@query(TIPS + """SELECT tree_id, label, round((len + up)::DOUBLE, 4) AS root_dist, 2 AS depth, true AS is_leaf FROM tip
UNION ALL SELECT DISTINCT tree_id, seg, round(up::DOUBLE, 4), 1, false FROM tip UNION ALL SELECT DISTINCT tree_id, 'n' || tree_id, 0.0::DOUBLE, 0, false FROM tip""")
def newick_nodes(spark, d):
    """The Newick reader's nodes with their root distances."""
    return trees(spark, d).select("tree_id", "label", F.round("root_dist", 4).alias("root_dist"), "depth", "is_leaf")


@query(TIPS + """SELECT DISTINCT tree_id, true AS same FROM tip""")
def newick_round_trip(spark, d):
    """Written and read again, a tree has the same digest."""
    nodes = trees(spark, d)
    again = newick.parse_trees(newick.write_trees(nodes).withColumn("tree_ordinal", F.lit(0)))[0]
    both = T.tree_digests(nodes).join(T.tree_digests(again).withColumnRenamed("digest", "again"), "tree_id")
    return both.select("tree_id", (F.col("digest") == F.col("again")).alias("same"))


@query(TIPS + """, m AS (SELECT tree_id, k % 3 AS set_id, count(*) AS n, count(DISTINCT seg) AS segs, min(seg) AS seg, min(label) AS label FROM tip WHERE k % 5 = 0 GROUP BY ALL)
SELECT tree_id, set_id, CASE WHEN n = 1 THEN m.label WHEN segs = 1 THEN seg ELSE 'n' || tree_id END AS label, n AS n_members,
    CASE WHEN n = 1 THEN 1 WHEN segs = 1 THEN (SELECT count(*) FROM tip t WHERE t.tree_id = m.tree_id AND t.seg = m.seg) ELSE (SELECT count(*) FROM tip t WHERE t.tree_id = m.tree_id) END AS n_leaves,
    n = CASE WHEN n = 1 THEN 1 WHEN segs = 1 THEN (SELECT count(*) FROM tip t WHERE t.tree_id = m.tree_id AND t.seg = m.seg) ELSE (SELECT count(*) FROM tip t WHERE t.tree_id = m.tree_id) END AS is_monophyletic FROM m""")
def tree_mrca(spark, d):
    """MRCA and monophyly of sets of leaves."""
    nodes = trees(spark, d)
    c = table(spark, d, "customer").where("c_custkey % 5 = 0")
    sets = c.select(F.col("c_nationkey").cast("string").alias("tree_id"), (F.col("c_custkey") % 3).alias("set_id"), F.concat(F.lit("c"), "c_custkey").alias("label"))
    top = N.mrca(sets, nodes, ["set_id"]).select("tree_id", "set_id", "node_id").join(nodes.select("tree_id", "node_id", "label"), ["tree_id", "node_id"])
    return N.monophyly(sets, nodes, ["set_id"]).join(top.drop("node_id"), ["tree_id", "set_id"])


@query(TIPS + """, clade AS (SELECT tree_id, seg AS label, label AS tip FROM tip UNION ALL SELECT tree_id, 'n' || tree_id, label FROM tip)
SELECT tree_id, label, count(*) || 'L:' || substr(sha1('{' || string_agg(tip, ',' ORDER BY tip) || '}'), 1, 8) AS topology_id FROM clade GROUP BY ALL""")
def tree_topology_ids(spark, d):
    nodes = trees(spark, d)
    return N.topology_ids(nodes).join(nodes.where("NOT is_leaf").select("tree_id", "node_id", "label"), ["tree_id", "node_id"]).drop("node_id")


@query(TIPS + """SELECT tree_id, count(*) AS tips, count(DISTINCT seg) + 1 AS internals, round((sum(len) + count(DISTINCT seg) * any_value(up))::DOUBLE, 2) AS total_length FROM tip GROUP BY ALL""")
def tree_summary(spark, d):
    return N.tree_summary(trees(spark, d)).withColumn("total_length", F.round("total_length", 2))


@query(TIPS + """, h AS (SELECT tree_id, min(len + up)::DOUBLE AS lo, max(len + up)::DOUBLE AS hi, count(*) AS n FROM tip GROUP BY ALL)
SELECT tree_id, round(lo, 4) AS min_height, round(hi, 4) AS max_height, CASE WHEN n >= 2 THEN round((hi - lo) / hi, 6) END AS relative_spread, CASE WHEN n >= 2 THEN (hi - lo) / hi <= 0.000001 END AS is_ultrametric FROM h""")
def tree_ultrametricity(spark, d):
    u = N.ultrametricity(trees(spark, d))
    return u.select("tree_id", *(F.round(c, r).alias(c) for c, r in (("min_height", 4), ("max_height", 4), ("relative_spread", 6))), "is_ultrametric")


@query(TIPS + """SELECT tree_id, label, round(gap::DOUBLE, 4) AS gap, rank FROM (SELECT *, max(len + up) OVER (PARTITION BY tree_id) - len - up AS gap,
    row_number() OVER (PARTITION BY tree_id ORDER BY len + up, seg, k) AS rank FROM tip) WHERE rank <= 5""")
def tree_top_offenders(spark, d):
    return N.top_offenders(trees(spark, d)).withColumn("gap", F.round("gap", 4))


@query(TIPS + """, s AS (SELECT DISTINCT tree_id, seg, up FROM tip) SELECT tree_id, count(*) AS root_children, count(*) = 2 AS is_rooted, false AS has_singleton_outgroup,
    min(up)::DOUBLE AS shortest_internal, max(up)::DOUBLE AS longest_internal FROM s GROUP BY tree_id""")
def tree_rooting(spark, d):
    return N.rooting_info(trees(spark, d))


@query(TIPS + """SELECT tree_id, seg AS label, label AS tip FROM tip WHERE true QUALIFY row_number() OVER (PARTITION BY tree_id, seg ORDER BY k) = 1""")
def tree_root_representatives(spark, d):
    """The first leaf beneath each child of the root."""
    nodes = trees(spark, d)
    kids = nodes.where("depth = 1").select("tree_id", F.col("node_id").alias("child"), F.col("label").alias("seg"))
    return N.root_representatives(nodes).withColumnRenamed("label", "tip").join(kids, ["tree_id", "child"]).select("tree_id", F.col("seg").alias("label"), "tip")


@query(TIPS + """, r AS (SELECT *, row_number() OVER (PARTITION BY tree_id, seg ORDER BY len DESC, k) AS i FROM tip),
g AS (SELECT tree_id, seg, any_value(up) AS up, max(len) AS one, sum(len) AS two FROM r WHERE i <= 2 GROUP BY tree_id, seg),
best AS (SELECT tree_id, max(two) AS d FROM g GROUP BY 1 UNION ALL SELECT a.tree_id, max(a.one + a.up + b.one + b.up) FROM g a JOIN g b ON a.tree_id = b.tree_id AND a.seg < b.seg GROUP BY 1)
SELECT tree_id, round((max(d) / 2)::DOUBLE, 3) AS height, (SELECT count(*) FROM tip t WHERE t.tree_id = best.tree_id) AS tips FROM best GROUP BY tree_id""")
def tree_midpoint(spark, d):
    """Rooted at the midpoint, a tree is half its diameter high and keeps its leaves."""
    out = T.reroot(trees(spark, d), "midpoint")
    return out.where("is_leaf").groupBy("tree_id").agg(F.round(F.max("root_dist"), 3).alias("height"), F.count("*").alias("tips"))


@query(TIPS + """, kept AS (SELECT * FROM tip WHERE k % 4 = 0), per AS (SELECT tree_id, count(DISTINCT seg) AS segs FROM kept GROUP BY 1)
SELECT tree_id, label, round((len + CASE WHEN segs > 1 OR (SELECT count(*) FROM kept o WHERE o.tree_id = kept.tree_id) = 1 THEN up ELSE 0 END)::DOUBLE, 4) AS root_dist FROM kept JOIN per USING (tree_id) WHERE segs > 1""")
def tree_prune(spark, d):
    """Leaves and root distances of trees pruned to a quarter of their leaves, where these lie in two segments or more."""
    keep = table(spark, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_nationkey").cast("string").alias("tree_id"), "c_mktsegment", F.concat(F.lit("c"), "c_custkey").alias("label"))
    wide = keep.groupBy("tree_id").agg(F.count_distinct("c_mktsegment").alias("n")).where("n > 1").select("tree_id")
    out = T.prune(trees(spark, d), keep.select("tree_id", "label").join(wide, "tree_id", "left_semi"))
    return out.where("is_leaf").select("tree_id", "label", F.round("root_dist", 4).alias("root_dist"))


@query(TIPS + """SELECT tree_id, label, true AS is_error FROM tip WHERE k % 10 = 0""")
def newick_findings(spark, d):
    """Texts that are no trees become findings: one broken text for every tenth customer."""
    c = table(spark, d, "customer").where("c_custkey % 10 = 0")
    bad = c.select(F.concat("c_nationkey", F.lit("/c"), "c_custkey").alias("tree_id"), F.lit(0).alias("tree_ordinal"), F.concat(F.lit("(("), F.lit("c"), "c_custkey", F.lit(":1,x:2);")).alias("newick"))
    f = newick.parse_trees(bad)[1]
    at = F.split("tree_id", "/")
    return f.select(at[0].alias("tree_id"), at[1].alias("label"), (F.col("severity") == "error").alias("is_error"))


@query("""SELECT event_type, lo, hi FROM (SELECT event_type, value AS lo, lead(value, greatest(1, ceil(n * 0.95))::INT - 1) OVER (PARTITION BY event_type ORDER BY value) AS hi
FROM (SELECT event_type, value, count(value) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)) WHERE hi IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY hi - lo, lo) = 1""")
def hpd_interval(spark, d):
    """The shortest interval with 95 % of the values."""
    return D.hpd(table(spark, d, "events").select("event_type", "value"), ["event_type"])


FASTA = """WITH a AS (SELECT p_brand AS aln_id, 'p' || p_partkey AS seq_id, translate(upper(p_name || p_type), 'BDHJKMNORXZ ', 'ACGTACGTACG') AS seq FROM part) """


@query(FASTA + """SELECT aln_id, seq_id, regexp_replace(seq, '\\s', '', 'g') AS seq FROM a""")
def fasta_records(spark, d):
    """FASTA texts, one a brand, with marks inside headers and sequences over two lines."""
    return A.parse_fasta(fasta_texts(spark, d)).select("aln_id", "seq_id", "seq")


def fasta_texts(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("aln_id"), "p_partkey", F.translate(F.upper(F.concat("p_name", "p_type")), "BDHJKMNORXZ ", "ACGTACGTACG").alias("seq"))
    rec = F.concat(F.lit(">p"), "p_partkey", F.lit(" A->B note\n"), F.substring("seq", 1, 9), F.lit("\r\n"), F.expr("substring(seq, 10)"))
    return p.groupBy("aln_id").agg(F.concat_ws("\n", F.collect_list(rec)).alias("text"))


@query(FASTA + """SELECT aln_id, count(*) AS num_sequences, CASE WHEN min(length(seq)) = max(length(seq)) THEN max(length(seq)) END::INTEGER AS sequence_length, min(length(seq)) = max(length(seq)) AS is_aligned FROM a GROUP BY ALL""")
def alignment_metadata(spark, d):
    return A.metadata(A.parse_fasta(fasta_texts(spark, d)))


@query("""SELECT doc_id, CASE WHEN n > 0 AND p > 0.05 * n AND p > n - p THEN 'protein' ELSE 'dna' END AS kind FROM (SELECT doc_id, length(s) AS n, length(regexp_replace(s, '[ATCGU]', '', 'g')) AS p
FROM (SELECT doc_id, left(regexp_replace(upper(coalesce(text, '')), '[^ATCGUEFILPQSVWY]', '', 'g'), 1000) AS s FROM documents))""")
def sequence_vote(spark, d):
    return table(spark, d, "documents").select("doc_id", A.sequence_type(F.coalesce("text", F.lit(""))).alias("kind"))


@query("""SELECT o_orderkey, 'S' || CASE WHEN i < 100000 THEN lpad(i::VARCHAR, 5, '0') ELSE i::VARCHAR END AS short FROM (SELECT o_orderkey, o_orderkey + 99000 AS i FROM orders)""")
def serial_short_names(spark, d):
    """Names by number, on both sides of 99,999."""
    return serial_names(table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") + 99000).alias("ordinal"))).select("o_orderkey", "short")


@query("""SELECT c_custkey, 'GCF_' || lpad(c_custkey::VARCHAR, 9, '0') || '.1' AS accession, r_name AS domain, n_name AS phylum FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def taxonomy_strings(spark, d):
    """Accessions and ranks out of labels."""
    place = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    label = F.concat(F.lit("RS_GCF_"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(".1"))
    ranks = parse_taxonomy(F.concat(F.lit("d__"), "r_name", F.lit(";p__"), "n_name"))
    return c.select("c_custkey", accession(label).alias("accession"), ranks["d"].alias("domain"), ranks["p"].alias("phylum"))


@query(r"""WITH s AS (SELECT p_brand, p_partkey, left(trim(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_'), 30) AS base FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, base ORDER BY p_partkey) AS i FROM s)
SELECT p_brand, p_partkey, CASE WHEN i = 1 THEN base ELSE left(base, 30 - length('_' || i)) || '_' || i END AS short FROM r""")
def short_names_in_scope(spark, d):
    """Unique short names within a brand, claimed in key order."""
    names = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("original"))
    return short_names(names, "p_brand").select("p_brand", F.col("ordinal").alias("p_partkey"), "short")


@query(TIPS + """, r AS (SELECT *, row_number() OVER (PARTITION BY tree_id, seg ORDER BY len DESC, k) AS i FROM tip),
g AS (SELECT tree_id, seg, any_value(up) AS up, max(len) AS one, sum(len) AS two, count(*) AS n FROM r WHERE i <= 2 GROUP BY tree_id, seg),
best AS (SELECT tree_id, max(two) AS d FROM g WHERE n = 2 GROUP BY 1 UNION ALL SELECT a.tree_id, max(a.one + a.up + b.one + b.up) FROM g a JOIN g b ON a.tree_id = b.tree_id AND a.seg < b.seg GROUP BY 1)
SELECT tree_id, round(max(d)::DOUBLE, 3) AS distance FROM best GROUP BY tree_id""")
def tree_diameter(spark, d):
    """The farthest pair's distance, in one pass over each tree."""
    return T.diameter(trees(spark, d)).select("tree_id", F.round("distance", 3).alias("distance"))


@query(TIPS + """, s AS (SELECT tree_id, len FROM tip UNION ALL SELECT tree_id, up FROM (SELECT DISTINCT tree_id, seg, up FROM tip))
SELECT tree_id, count(*)::INTEGER AS n_lengths, (count(*) FILTER (len < 0))::INTEGER AS n_negative, (count(*) FILTER (len = 0))::INTEGER AS n_zero, max(len)::DOUBLE AS longest FROM s GROUP BY tree_id""")
def tree_length_scan(spark, d):
    """Branch lengths counted in the texts themselves."""
    return newick.length_scan(tree_texts(spark, d))


CLADES = TIPS + """, s AS (SELECT tree_id, seg, '(' || string_agg(label || ':' || len, ',' ORDER BY k) || ')' || seg || ':' || any_value(up)::INTEGER AS clade FROM tip GROUP BY tree_id, seg),
w AS (SELECT tree_id, '(' || string_agg(clade, ',' ORDER BY clade) || ')n' || tree_id || ';' AS newick FROM s GROUP BY tree_id) """


@query(CLADES + """SELECT (tree_id::INTEGER % 5)::INTEGER AS source, '#NEXUS\nBEGIN TREES;\n' || string_agg('\tTREE ' || chr(39) || tree_id || chr(39) || ' = [&R] ' || newick || '\n', '' ORDER BY tree_id::INTEGER) || 'END;\n' AS text FROM w GROUP BY 1""")
def nexus_files(spark, d):
    """NEXUS texts of five trees each."""
    nk = F.col("tree_id").cast("int")
    return newick.nexus_texts(tree_texts(spark, d).withColumn("source", nk % 5).withColumn("tree_ordinal", nk))


@query(CLADES + """, c AS (SELECT tree_id, count(*) AS n, string_agg('# ' || label || ': MRCA ' || CASE WHEN k % 2 = 0 THEN 'root' ELSE label || ',x' END || ' = ' || CASE WHEN k % 3 = 0 THEN 'unknown' ELSE seg END, '\n'
    ORDER BY '# ' || label || ': MRCA ' || CASE WHEN k % 2 = 0 THEN 'root' ELSE label || ',x' END || ' = ' || CASE WHEN k % 3 = 0 THEN 'unknown' ELSE seg END) AS lines FROM tip WHERE k % 7 = 0 GROUP BY tree_id)
SELECT tree_id, '# Total calibrations: ' || coalesce(n, 0) || coalesce('\n' || lines, '') || '\n\n' || newick || '\n' AS text FROM w LEFT JOIN c USING (tree_id)""")
def calibrated_tree_texts(spark, d):
    """Trees beneath their calibrations as comments."""
    k = F.col("c_custkey")
    label = F.concat(F.lit("c"), k)
    c = table(spark, d, "customer").where(k % 7 == 0).select(
        F.col("c_nationkey").cast("string").alias("tree_id"), label.alias("name"), label.alias("a"), F.lit("x").alias("b"), (k % 2 == 0).alias("is_root"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("bounds"),
    )
    return calibrated_texts(tree_texts(spark, d), c)


@query(TIPS + """, n AS (SELECT tree_id, label, len + up AS root_dist, k % 4 = 0 AS has, k FROM tip UNION ALL SELECT DISTINCT tree_id, seg, up, false, 0 FROM tip UNION ALL SELECT DISTINCT tree_id, 'n' || tree_id, 0, false, 0 FROM tip),
t AS (SELECT tree_id, max(len + up) AS top FROM tip GROUP BY 1)
SELECT tree_id, label, round(CASE WHEN has THEN k ELSE top - root_dist END::DOUBLE, 3) AS age, CASE WHEN has THEN 'recorded' ELSE 'computed' END AS source FROM n JOIN t USING (tree_id)""")
def result_on_nodes(spark, d):
    """Ages of a result on a tree's nodes, others from the tree's height."""
    k = F.col("c_custkey")
    ages = table(spark, d, "customer").where(k % 4 == 0).select(F.col("c_nationkey").cast("string").alias("tree_id"), F.concat(F.lit("c"), k).alias("node_key"), F.lit(0).alias("ordinal"), k.cast("double").alias("age"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    return C.plot_values(trees(spark, d), ages).select("tree_id", "label", F.round("age", 3).alias("age"), "source")


ALIGNED = """WITH a AS (SELECT DISTINCT l_partkey::VARCHAR AS row_key, l_returnflag AS method, CASE l_partkey % 4 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'name-only' ELSE 'topology' END AS alignment FROM lineitem),
r AS (SELECT row_key, alignment AS name, count(*) AS m FROM a GROUP BY ALL), g AS (SELECT * FROM r WHERE name <> 'unresolved') """


@query(ALIGNED + """SELECT 'alignment' AS item, name, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'methods', CASE WHEN m > 1 THEN 'several' ELSE 'one' END, count(*) FROM g GROUP BY ALL
UNION ALL SELECT 'missing', method, (SELECT count(*) FROM g) - count(*) FILTER (alignment <> 'unresolved') FROM a GROUP BY method""")
def alignment_summary(spark, d):
    """Counts by alignment kind, compared rows, missing estimates."""
    p = F.col("l_partkey") % 4
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("row_key"), F.col("l_returnflag").alias("method"), F.when(p == 0, "unresolved").when(p == 1, "name-only").otherwise("topology").alias("alignment")).distinct()
    return C.alignment_summary(rows)


@query("""WITH q AS (SELECT DISTINCT o_orderpriority AS method, o_custkey AS name FROM orders), w AS (SELECT DISTINCT o_orderpriority AS method, o_custkey AS name FROM orders WHERE o_orderstatus = 'O'),
p AS (SELECT o_orderpriority AS method, count(*) AS parsed FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT method, count(*) AS requested, count(w.name) AS effective, min(q.name) FILTER (w.name IS NULL) AS first_lost FROM q LEFT JOIN w USING (method, name) GROUP BY method)
SELECT method, requested, effective, requested - effective AS lost, first_lost, coalesce(parsed, 0) AS parsed, coalesce(parsed, 0) < requested AS short FROM b LEFT JOIN p USING (method)""")
def reconciliation(spark, d):
    """Calibrations asked, written and come back, by method."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("method"), F.col("o_custkey").alias("name"), "o_orderstatus")
    r = C.reconciliation(o, o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"))
    return r.select("method", "requested", "effective", F.size("not_written").cast("long").alias("lost"), F.get("not_written", F.lit(0)).alias("first_lost"), "parsed", "short")


@query("""SELECT c_custkey, floor(c_acctbal::DOUBLE + 0.5)::BIGINT AS age, abs(c_acctbal::DOUBLE - floor(c_acctbal::DOUBLE + 0.5)) > 1e-12 AS rounded FROM customer""")
def whole_ages(spark, d):
    """Ages for a program that takes whole numbers only."""
    at = whole_age(F.col("c_acctbal").cast("double"))
    return table(spark, d, "customer").select("c_custkey", at["age"].alias("age"), at["rounded"].alias("rounded"))


@query("""SELECT p_partkey, (p_size % 6) || '.' || (p_partkey % 11) || '.8' AS version, p_size % 6 = 4 AND p_partkey % 11 = 10 AS same FROM part""")
def version_series(spark, d):
    """Versions out of banners, held against a series."""
    v = F.concat((F.col("p_size") % 6).cast("string"), F.lit("."), (F.col("p_partkey") % 11).cast("string"), F.lit(".8"))
    found = program_version(F.concat(F.lit("PROGRAM in package version "), v, F.lit(", 15 May")))
    return table(spark, d, "part").select("p_partkey", found.alias("version"), same_series(F.lit("4.10.2"), found).alias("same"))


@query(TIPS + """, p AS (SELECT a.tree_id, least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, (a.len + b.len + CASE WHEN a.seg = b.seg THEN 0 ELSE 2 * a.up END)::DOUBLE AS distance
FROM tip a JOIN tip b ON a.tree_id = b.tree_id AND a.k < b.k WHERE a.k % 3 = 0 AND b.k % 3 = 0) SELECT tree_id, a, b, round(distance, 3) AS distance FROM p""")
def tree_leaf_pairs(spark, d):
    """Distances of all pairs among named leaves, those of a third of the customers."""
    names = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_nationkey").cast("string").alias("tree_id"), F.concat(F.lit("c"), "c_custkey").alias("label"))
    return N.leaf_pairs(trees(spark, d), names).select("tree_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("distance", 3).alias("distance"))
