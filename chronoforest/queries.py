"""Each operator's relational kernel as a query over the supplied tables, with its SQL for DuckDB.

The star schema plays the trees: a region is a tree, nations and customers are its inner nodes, orders its leaves; keys
and prices play branch lengths and ages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.names import sanitize
from .operators import nodes as N
from .operators import relations as R
from .plans.batch import remaining, seed_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c):
    return c.cast("decimal(18,2)")


def customer_nodes(spark: SparkSession, d: str) -> DataFrame:
    """nodes of one tree a region: root, nations, customers as leaves.  A customer's ordinal is its nation's offset plus its
    rank in the nation, and that rank is found in key ranges, so no task orders a whole tree or nation."""
    nat = table(spark, d, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").cast("long").alias("tree_id"), "n_name")
    reg = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("tree_id"), "r_name")
    cust = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nk"), "c_name", money(F.col("c_acctbal")).alias("bal"))
    per = cust.groupBy("nk").agg(F.count("*").alias("n"))
    sized = nat.join(F.broadcast(per), "nk")  # nations: a fixed table
    before = F.coalesce(F.sum("n").over(W.partitionBy("tree_id").orderBy("nk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sized = sized.withColumn("off", before)
    tips = cust.join(F.broadcast(sized.select("nk", "tree_id", "off")), "nk")
    tips = R.ranked(tips, ["nk"], "c_custkey").withColumn("ord", F.col("rank") + F.col("off"))
    length = F.col("nk").cast("double") + 1
    leaf = tips.select("tree_id", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), F.col("c_name").alias("label"), F.abs("bal").cast("double").alias("branch_length"), F.lit(True).alias("is_leaf"), F.lit(2).alias("depth"), (length + F.abs("bal").cast("double")).alias("root_dist"), F.col("ord").alias("leaf_lo"), F.col("ord").alias("leaf_hi"), F.lit(1).cast("long").alias("n_leaves"))
    inner = sized.select("tree_id", F.concat(F.lit("n"), F.col("nk").cast("string")).alias("node_id"), F.col("n_name").alias("label"), length.alias("branch_length"), F.lit(False).alias("is_leaf"), F.lit(1).alias("depth"), length.alias("root_dist"), (F.col("off") + 1).alias("leaf_lo"), (F.col("off") + F.col("n")).alias("leaf_hi"), F.col("n").alias("n_leaves"))
    total = sized.groupBy("tree_id").agg(F.sum("n").alias("n"))
    root = total.join(F.broadcast(reg), "tree_id").select("tree_id", F.concat(F.lit("r"), F.col("tree_id").cast("string")).alias("node_id"), F.col("r_name").alias("label"), F.lit(None).cast("double").alias("branch_length"), F.lit(False).alias("is_leaf"), F.lit(0).alias("depth"), F.lit(0.0).alias("root_dist"), F.lit(1).cast("long").alias("leaf_lo"), F.col("n").alias("leaf_hi"), F.col("n").alias("n_leaves"))
    return leaf.unionByName(inner).unionByName(root)


SQL_NODES = """
WITH per AS (SELECT c_nationkey AS nk, count(*) AS n FROM customer GROUP BY 1),
sized AS (SELECT n_nationkey AS nk, n_regionkey::BIGINT AS tree_id, n_name, n,
    coalesce(sum(n) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
    FROM nation JOIN per ON nk = n_nationkey),
tips AS (SELECT c_custkey, c_name, abs(c_acctbal::DECIMAL(18,2))::DOUBLE AS bal, s.nk, tree_id,
    row_number() OVER (PARTITION BY s.nk ORDER BY c_custkey) + off AS ord FROM customer JOIN sized s ON c_nationkey = s.nk),
nodes AS (
  SELECT tree_id, 'c' || c_custkey AS node_id, c_name AS label, bal AS branch_length, true AS is_leaf, 2 AS depth, nk + 1 + bal AS root_dist, ord AS leaf_lo, ord AS leaf_hi, 1 AS n_leaves FROM tips
  UNION ALL SELECT tree_id, 'n' || nk, n_name, nk + 1.0::DOUBLE, false, 1, nk + 1.0::DOUBLE, off + 1, off + n, n FROM sized
  UNION ALL SELECT tree_id, 'r' || tree_id, r_name, NULL, false, 0, 0.0::DOUBLE, 1, m, m FROM (SELECT tree_id, sum(n) AS m FROM sized GROUP BY 1) JOIN region ON r_regionkey = tree_id)
"""

Query = tuple[Callable[[SparkSession, str], DataFrame], str]
REGISTRY: dict[str, Query] = {}


def query(sql: str):
    def keep(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return keep


@query("""WITH leaf AS (SELECT r_name, n_name, n_nationkey + 1 AS a, abs(c_acctbal)::DECIMAL(18,2) AS b, coalesce(o_totalprice, 0)::DECIMAL(18,2) AS c
  FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey)
SELECT r_name, n_name, count(*) AS n_leaves, min(a + b + c)::DOUBLE AS min_dist, max(a + b + c)::DOUBLE AS max_dist FROM leaf GROUP BY ALL""")
def hier_root_dist(spark, d):
    """Root-to-tip distances of region > nation > customer > order."""
    paths = (
        table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
        .groupBy("c_nationkey").agg(F.count("*").alias("n_leaves"), F.min(_tip()).alias("lo"), F.max(_tip()).alias("hi"))
    )
    nat = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    out = paths.join(F.broadcast(nat), F.col("c_nationkey") == F.col("n_nationkey"))
    a = F.col("n_nationkey") + 1
    return out.select("r_name", "n_name", "n_leaves", (F.col("lo") + a).cast("double").alias("min_dist"), (F.col("hi") + a).cast("double").alias("max_dist"))


def _tip():
    return money(F.abs("c_acctbal")) + F.coalesce(money(F.col("o_totalprice")), F.lit(0).cast("decimal(18,2)"))


@query(SQL_NODES + """SELECT tree_id, node_id, label, round(max(root_dist) FILTER (is_leaf) OVER (PARTITION BY tree_id) - root_dist, 4) AS age FROM nodes QUALIFY NOT is_leaf""")
def hier_ages(spark, d):
    """Ages of inner nodes: the largest tip height of the tree minus the node's."""
    return N.ages(customer_nodes(spark, d)).where("NOT is_leaf").select("tree_id", "node_id", "label", F.round("age", 4).alias("age"))


@query(SQL_NODES + """, named AS (SELECT c_mktsegment AS seg, tree_id, ord FROM customer JOIN tips USING (c_custkey) WHERE c_acctbal > 9900),
sp AS (SELECT tree_id, seg, min(ord) AS lo, max(ord) AS hi FROM named GROUP BY ALL)
SELECT sp.tree_id, seg, node_id, n_leaves::BIGINT AS n_leaves FROM sp JOIN nodes n ON n.tree_id = sp.tree_id AND leaf_lo <= lo AND leaf_hi >= hi
QUALIFY row_number() OVER (PARTITION BY sp.tree_id, seg ORDER BY depth DESC) = 1""")
def interval_mrca(spark, d):
    """MRCA of the rich customers of each market segment: the deepest interval around their ordinals."""
    rich = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_name").alias("label"), F.col("c_mktsegment").alias("seg"))
    nodes = customer_nodes(spark, d)
    at = rich.join(nodes.where("is_leaf").select("tree_id", "label", F.col("leaf_lo").alias("ord")), "label")
    spans = at.groupBy("tree_id", "seg").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    hit = spans.join(nodes.where("NOT is_leaf"), "tree_id").where("leaf_lo <= lo AND leaf_hi >= hi")
    own = spans.where("lo = hi").join(nodes.where("is_leaf").select("tree_id", "node_id", "depth", "n_leaves", F.col("leaf_lo").alias("lo")), ["tree_id", "lo"])
    both = hit.select("tree_id", "seg", "node_id", "depth", "n_leaves").unionByName(own.select("tree_id", "seg", "node_id", "depth", "n_leaves"))
    best = both.groupBy("tree_id", "seg").agg(F.max_by(F.struct("node_id", "n_leaves"), "depth").alias("m"))
    return best.select("tree_id", "seg", "m.node_id", "m.n_leaves")


@query(SQL_NODES + """, s AS (SELECT n_nationkey, c_mktsegment AS seg, min(ord) AS lo, max(ord) AS hi, count(*) AS n FROM customer JOIN tips USING (c_custkey) JOIN nation ON n_nationkey = nk GROUP BY ALL)
SELECT n_nationkey, seg, n AS n_members, hi - lo + 1 = n AS is_contiguous FROM s""")
def monophyly(spark, d):
    """Whether a segment's customers of a nation are an unbroken run of leaves: count against span."""
    nodes = customer_nodes(spark, d).where("is_leaf").select(F.col("label").alias("c_name"), "leaf_lo")
    c = table(spark, d, "customer").select("c_name", F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("seg")).join(nodes, "c_name")
    s = c.groupBy("n_nationkey", "seg").agg(F.count("*").alias("n_members"), F.min("leaf_lo").alias("lo"), F.max("leaf_lo").alias("hi"))
    return s.select("n_nationkey", "seg", "n_members", (F.col("hi") - F.col("lo") + 1 == F.col("n_members")).alias("is_contiguous"))


@query("""WITH cal AS (
  SELECT r_regionkey::BIGINT AS tree_id, 'r' || r_regionkey AS name, 0 AS lo, 1000 AS hi, 0 AS depth, min(s_acctbal) AS mn, avg(s_acctbal)::DECIMAL(18,2)::DOUBLE AS mx FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL
  UNION ALL SELECT n_regionkey::BIGINT, 'n' || n_nationkey, n_nationkey, n_nationkey, 1, median(s_acctbal), max(s_acctbal) FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT a.tree_id, a.name AS older, d.name AS younger FROM cal a JOIN cal d ON a.tree_id = d.tree_id AND d.lo >= a.lo AND d.hi <= a.hi AND d.depth >= a.depth AND a.mx < d.mn AND a.name <> d.name""")
def conflict_self_join(spark, d):
    """Temporal conflicts: a container whose upper bound is below a contained node's lower bound."""
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    reg = s.groupBy(F.col("n_regionkey").cast("long").alias("tree_id")).agg(F.min("s_acctbal").alias("min_age"), F.avg("s_acctbal").cast("decimal(18,2)").cast("double").alias("max_age"))
    reg = reg.select("tree_id", F.concat(F.lit("r"), F.col("tree_id").cast("string")).alias("name"), F.lit(0).alias("leaf_lo"), F.lit(1000).alias("leaf_hi"), F.lit(0).alias("depth"), "min_age", "max_age")
    nat = s.groupBy(F.col("n_regionkey").cast("long").alias("tree_id"), F.col("n_nationkey").alias("leaf_lo")).agg(F.median("s_acctbal").alias("min_age"), F.max("s_acctbal").alias("max_age"))
    nat = nat.select("tree_id", F.concat(F.lit("n"), F.col("leaf_lo").cast("string")).alias("name"), "leaf_lo", F.col("leaf_lo").alias("leaf_hi"), F.lit(1).alias("depth"), "min_age", "max_age")
    return R.temporal_conflicts(reg.unionByName(nat)).select("tree_id", "older", "younger")


@query("""SELECT l_partkey, l_suppkey, max(l_quantity) AS lo, min(l_extendedprice / 1000) AS hi, count(*) AS n, max(l_quantity) > min(l_extendedprice / 1000) AS is_empty
FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def same_node_merge(spark, d):
    """Intersection of all intervals of one node."""
    l = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").alias("lo"), (F.col("l_extendedprice") / 1000).alias("hi"))
    return R.merge_bounds(l, ["l_partkey", "l_suppkey"]).where("n > 1")


BANDS = [("low", 0.0, 10.0), ("mid", 40.0, 8.0), ("high", 35.0, 120.0), ("top", 1000.0, 100.0)]


@query("""WITH bands(name, a, b) AS (VALUES ('low', 0.0, 10.0), ('mid', 40.0, 8.0), ('high', 35.0, 120.0), ('top', 1000.0, 100.0))
SELECT name, event_type, count(*) AS n, max(value) AS top_value FROM events JOIN bands ON least(a, b) <= value * 1.1 AND greatest(a, b) >= value GROUP BY ALL""")
def range_overlap(spark, d):
    """Intervals joined with the bands they touch, bounds of a band in either order."""
    bands = spark.createDataFrame(BANDS, "name string, start double, end double")
    e = table(spark, d, "events").select("event_type", "value", F.col("value").alias("lo"), (F.col("value") * F.lit(1.1)).alias("hi"))
    return R.overlaps(e, bands, "lo", "hi").groupBy("name", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top_value"))


@query("""WITH s AS (SELECT event_type, user_id % 4 AS chain, value, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) AS r FROM events),
k AS (SELECT event_type, min(c) AS m FROM (SELECT event_type, chain, count(*) AS c FROM s GROUP BY ALL) GROUP BY ALL),
per AS (SELECT event_type, chain, count(*) AS n, avg(value) AS mean, var_samp(value) AS v FROM s JOIN k USING (event_type) WHERE r <= m GROUP BY ALL),
g AS (SELECT event_type, max(n) AS n, count(*) AS chains, avg(v) AS w, var_samp(mean) AS b FROM per GROUP BY ALL)
SELECT event_type, n, chains, round(sqrt(((n - 1.0) / n * w + b) / w), 6) AS psrf FROM g""")
def psrf(spark, d):
    """Gelman-Rubin statistic; chains are cut to equal length."""
    s = table(spark, d, "events").select("event_type", (F.col("user_id") % 4).alias("chain"), "value", "ts", "event_id")
    return R.psrf(R.equal_lengths(s, ["event_type"], ["ts", "event_id"]), ["event_type"]).withColumn("psrf", F.round("psrf", 6))


@query("""SELECT o_custkey, count(*) AS n, bool_and(up) AS is_increasing FROM (SELECT o_custkey, coalesce(o_orderkey > lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), true) AS up FROM orders) GROUP BY ALL""")
def iteration_guard(spark, d):
    return R.iteration_guard(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", ["o_orderdate", "o_orderkey"])


@query("""SELECT r_name, count(DISTINCT n_name) || 'L:' || substr(sha1('{' || string_agg(DISTINCT n_name, ',' ORDER BY n_name) || '}'), 1, 8) AS topology_id FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def clade_hash(spark, d):
    """The clade token of a region's nations."""
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(F.collect_list("n_name").alias("s")).select("r_name", N.clade_hash(F.col("s")).alias("topology_id"))


@query("""SELECT status, count(*) AS n, min(k) AS first_key FROM (SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'only_orders' WHEN b.k IS NULL THEN 'only_customer' ELSE 'match' END AS status
FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k) GROUP BY ALL""")
def set_reconcile(spark, d):
    """Symmetric difference of two name sets."""
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return R.reconcile(c, o, "k", "only_customer", "only_orders").groupBy("status").agg(F.count("*").alias("n"), F.min("k").alias("first_key"))


@query("""WITH m AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN upper(replace(p_name, ' ', '_')) ELSE p_name END AS name FROM part), d AS (SELECT a.name, b.name AS suggestion, levenshtein(translate(lower(a.name), '_-', ''), translate(lower(b.name), '_-', '')) AS distance FROM m a JOIN m b ON a.name <> b.name)
SELECT name, suggestion, distance::INTEGER AS distance FROM d WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY name ORDER BY distance, suggestion) = 1""")
def fuzzy_names(spark, d):
    """The nearest other part name within two edits, case and underscores aside."""
    p = table(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))).otherwise(F.col("p_name")).alias("name"))
    return R.fuzzy_suggestions(p, p)


@query("""SELECT * FROM (SELECT 'lang' AS rank, count(*) AS total, count(*) FILTER (lang <> '') AS filled, count(*) - count(*) FILTER (lang <> '') AS missing FROM x
UNION ALL SELECT 'source', count(*), count(*) FILTER (source <> ''), count(*) - count(*) FILTER (source <> '') FROM x
UNION ALL SELECT 'quality', count(*), count(quality), count(*) - count(quality) FROM x
UNION ALL SELECT 'toxic', count(*), count(toxic), count(*) - count(toxic) FROM x)""".replace("FROM x", "FROM (SELECT * FROM documents LEFT JOIN labels USING (doc_id))"))
def rank_stats(spark, d):
    """Filled and missing values a rank."""
    rows = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return R.rank_statistics(rows, ["lang", "source", "quality", "toxic"])


@query(r"""WITH s AS (SELECT p_partkey, left(trim(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_'), 30) AS base FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS i FROM s)
SELECT p_partkey, CASE WHEN i = 1 THEN base ELSE base || '_' || i END AS short FROM r""")
def sanitize_dedupe(spark, d):
    """Short names: cleaned, and suffixed in key order where they clash."""
    s = table(spark, d, "part").select("p_partkey", sanitize(F.col("p_name")).alias("base"))
    i = F.row_number().over(W.partitionBy("base").orderBy("p_partkey"))
    return s.withColumn("i", i).select("p_partkey", F.when(F.col("i") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("i").cast("string"))).alias("short"))


@query(r"""SELECT lang, CASE WHEN regexp_matches(upper(text), '^[ACGTN\-?.*\s]+$') THEN 'dna' WHEN regexp_matches(upper(text), '^[A-Z\-?.*\s]+$') THEN 'protein' ELSE 'unknown' END AS alphabet, count(*) AS n FROM documents GROUP BY ALL""")
def alphabet_class(spark, d):
    from .sources.alignments import alphabet

    return table(spark, d, "documents").select("lang", alphabet(F.col("text"), spaces=True).alias("alphabet")).groupBy("lang", "alphabet").agg(F.count("*").alias("n"))


@query(r"""SELECT source, count(*) FILTER (regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) AS control, count(*) FILTER (regexp_matches(text, '[0-9]')) AS digits, count(*) FILTER (length(text) > 4096) AS long FROM documents GROUP BY ALL""")
def bad_chars(spark, d):
    """Texts with control characters, with digits, and over the length limit."""
    t = F.col("text")
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(t.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")).alias("control"), F.count_if(t.rlike("[0-9]")).alias("digits"), F.count_if(F.length(t) > 4096).alias("long"))


@query("""SELECT l_suppkey, max(l_quantity) FILTER (l_returnflag = 'A') AS A, max(l_quantity) FILTER (l_returnflag = 'N') AS N, max(l_quantity) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY ALL""")
def method_pivot(spark, d):
    l = table(spark, d, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("method"), F.col("l_quantity").alias("age"))
    return R.pivot_methods(l, ["l_suppkey"], ["A", "N", "R"])


@query("""WITH e AS (SELECT l_suppkey, l_returnflag AS method, max(l_extendedprice) AS age, min(l_quantity) AS lo, max(l_quantity) AS hi, CASE WHEN count(*) > 20 THEN 'HPD95' ELSE 'RANGE' END AS t FROM lineitem GROUP BY ALL)
SELECT a.l_suppkey, count(*) AS n_pairs, round(max(abs(a.age - b.age)), 4) AS max_delta, count(*) FILTER (a.hi < b.lo OR b.hi < a.lo) AS n_disjoint, count(*) FILTER (a.t <> b.t) AS n_mixed
FROM e a JOIN e b ON a.l_suppkey = b.l_suppkey AND a.method < b.method GROUP BY ALL""")
def disagreement(spark, d):
    """Pairwise disagreement of methods a node."""
    e = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("method")).agg(F.max("l_extendedprice").alias("age"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.when(F.count("*") > 20, "HPD95").otherwise("RANGE").alias("ci_type"))
    return R.disagreement(e, ["l_suppkey"]).withColumn("max_delta", F.round("max_delta", 4))


@query("""WITH e AS (SELECT p_brand, abs(l_extendedprice / l_quantity - p_retailprice) AS e, abs(l_extendedprice / l_quantity - p_retailprice) / abs(p_retailprice) AS r FROM lineitem JOIN part ON l_partkey = p_partkey),
q AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY r) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM e)
SELECT p_brand, count(*) AS n, round(avg(e), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(max(e), 4) AS max_abs, round(max(r), 6) AS max_rel, round(max(r) FILTER (i = n // 2), 6) AS median_rel FROM q GROUP BY p_brand""")
def accuracy(spark, d):
    """MAE, RMSE, maxima and the upper median of the relative error."""
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = R.accuracy(l.select("p_brand", (F.col("l_extendedprice") / F.col("l_quantity")).alias("estimate"), F.col("p_retailprice").alias("truth")), ["p_brand"])
    return out.select("p_brand", "n", *(F.round(c, 4).alias(c) for c in ("mae", "rmse", "max_abs")), F.round("max_rel", 6).alias("max_rel"), F.round("median_rel", 6).alias("median_rel"))


@query("""SELECT l_linestatus, l_returnflag, count(*) AS n, count(*) FILTER (l_quantity >= lo - greatest(1.0, 0.05 * (hi - lo)) AND l_quantity <= hi + greatest(1.0, 0.05 * (hi - lo))) AS honoured
FROM (SELECT *, l_linenumber * 5.0 AS lo, l_linenumber * 12.0 AS hi FROM lineitem) GROUP BY ALL""")
def honour_check(spark, d):
    l = table(spark, d, "lineitem").withColumn("lo", F.col("l_linenumber") * F.lit(5.0)).withColumn("hi", F.col("l_linenumber") * F.lit(12.0))
    return l.groupBy("l_linestatus", "l_returnflag").agg(F.count("*").alias("n"), F.count_if(R.honours(F.col("l_quantity"), F.col("lo"), F.col("hi"))).alias("honoured"))


@query("""WITH t AS (SELECT n_nationkey, s_name, s_acctbal, s_suppkey AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT n_nationkey::BIGINT AS tree_id, a.s_name AS a, b.s_name AS b, round(abs(a.s_acctbal - b.s_acctbal), 2) AS distance FROM t a JOIN t b USING (n_nationkey) WHERE a.o < b.o
QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY abs(a.s_acctbal - b.s_acctbal) DESC, a.o, b.o) = 1""")
def farthest_pair(spark, d):
    """The two suppliers of a nation whose balances lie farthest apart: on a line the ends, so no pairs are formed."""
    s = table(spark, d, "supplier").withColumn("o", F.col("s_suppkey"))
    one = F.struct("s_acctbal", "o", "s_name")
    ends = s.groupBy(F.col("s_nationkey").cast("long").alias("tree_id")).agg(F.min(one).alias("x"), F.max(F.struct(F.col("s_acctbal"), -F.col("o"), F.col("s_name"))).alias("y"), F.count("*").alias("n")).where("n > 1")
    y_o = -F.col("y.col2")
    a = F.when(F.col("x.o") < y_o, F.col("x.s_name")).otherwise(F.col("y.s_name"))
    b = F.when(F.col("x.o") < y_o, F.col("y.s_name")).otherwise(F.col("x.s_name"))
    return ends.select("tree_id", a.alias("a"), b.alias("b"), F.round(F.abs(F.col("x.s_acctbal") - F.col("y.s_acctbal")), 2).alias("distance"))


@query("""SELECT o_orderpriority AS method, count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS succeeded, max(n) FILTER (o_orderstatus = 'F') AS max_nodes, min(n) FILTER (o_orderstatus = 'F') AS min_nodes, round(avg(n) FILTER (o_orderstatus = 'F'), 6) AS avg_nodes
FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY ALL""")
def batch_stats(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("nodes"))
    runs = table(spark, d, "orders").join(n, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("method"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status"), "nodes", F.lit(0.0).alias("seconds"))
    return R.batch_statistics(runs).drop("cpu_seconds").withColumn("avg_nodes", F.round("avg_nodes", 6))


@query("""SELECT DISTINCT l_suppkey, CASE WHEN l_discount > 0.07 THEN 'high_discount' ELSE 'returned' END AS finding FROM lineitem WHERE l_discount > 0.07 OR l_returnflag = 'R'""")
def dedupe_findings(spark, d):
    l = table(spark, d, "lineitem").where("l_discount > 0.07 OR l_returnflag = 'R'")
    return l.select("l_suppkey", F.when(F.col("l_discount") > 0.07, "high_discount").otherwise("returned").alias("finding")).distinct()


@query("""SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5""")
def topk_offenders(spark, d):
    """The five largest orders a customer."""
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("rank")).where("rank <= 5")


@query("""SELECT c_custkey, ('0x' || substr(sha256('seed|42|' || c_name), 1, 8))::BIGINT AS seed FROM customer""")
def seed_hash(spark, d):
    """Seeds a method: the first 32 bits of a SHA-256."""
    return table(spark, d, "customer").select("c_custkey", seed_of(F.lit("seed"), F.lit(42), F.col("c_name")).alias("seed"))


@query("""SELECT o_custkey, count(*) AS remaining FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY ALL""")
def resume_anti_join(spark, d):
    """Jobs that no manifest row covers."""
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), "o_custkey")
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job"))
    return remaining(jobs, done, ["job"]).groupBy("o_custkey").agg(F.count("*").alias("remaining"))


@query("""SELECT l_partkey, round(min(l_discount), 4) AS chisq, arg_min(l_linenumber, (l_discount, l_orderkey, l_linenumber)) AS smoothing FROM lineitem GROUP BY ALL""")
def best_smoothing(spark, d):
    l = table(spark, d, "lineitem").select("l_partkey", F.col("l_discount").alias("chisq"), F.struct("l_orderkey", "l_linenumber").alias("ordinal"), F.col("l_linenumber").alias("smoothing"))
    return R.best_smoothing(l, ["l_partkey"]).select("l_partkey", F.round("chisq", 4).alias("chisq"), "smoothing")


@query("""SELECT l_returnflag, l_linestatus, l_linenumber, round((q - min(q) OVER w) / (max(q) OVER w - min(q) OVER w), 6) AS scaled FROM (SELECT l_returnflag, l_linestatus, l_linenumber, max(l_extendedprice) AS q FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY l_returnflag, l_linestatus)""")
def min_max_scale(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.max("l_extendedprice").alias("q"))
    return R.min_max_scale(l, "q", ["l_returnflag", "l_linestatus"]).select("l_returnflag", "l_linestatus", "l_linenumber", F.round("scaled", 6).alias("scaled"))


@query("""SELECT event_type, CASE WHEN d = abs(ln(v)) THEN 1.0 WHEN d = abs(ln(v * 1000.0)) THEN 1000.0 WHEN d = abs(ln(v * 0.001)) THEN 0.001 ELSE 1000000.0 END AS factor, count(*) AS n
FROM (SELECT event_type, v, least(abs(ln(v)), abs(ln(v * 1000.0)), abs(ln(v * 0.001)), abs(ln(v * 1000000.0))) AS d FROM (SELECT event_type, value::DOUBLE AS v FROM events WHERE value > 0)) GROUP BY ALL""")
def unit_inference(spark, d):
    e = table(spark, d, "events").where("value > 0")
    return e.select("event_type", R.unit_factor(F.col("value")).alias("factor")).groupBy("event_type", "factor").agg(F.count("*").alias("n"))


@query(r"""SELECT conv_id, turn, len(list_filter(regexp_split_to_array(lower(text), '[;_.\-\s]+'), lambda x: x <> ''))::INTEGER AS tokens, regexp_matches(lower(text), '(_|^)the(_|$)') AS word FROM conversations""")
def token_match(spark, d):
    """Name tokens and the word-boundary test."""
    from .functions.taxonomy import has_word, tokens

    return table(spark, d, "conversations").select("conv_id", "turn", F.size(tokens(F.col("text"))).alias("tokens"), has_word(F.col("text"), "the").alias("word"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Ages of a tree's inner nodes with the clade token of the tree."""
    tokens = clade_hash(spark, d)
    reg = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("tree_id"), "r_name")
    return hier_ages(spark, d).join(F.broadcast(reg), "tree_id").join(F.broadcast(tokens), "r_name")


def registered() -> dict[str, Query]:
    from . import check_queries, order_queries, tree_queries  # noqa: F401  these register their own

    return REGISTRY


QUERIES = {k: f for k, (f, _) in registered().items()}
ORACLE_SQL = {k: s for k, (_, s) in registered().items()}
