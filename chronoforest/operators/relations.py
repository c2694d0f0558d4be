"""Relational kernels shared by the dating workflow: conflicts, merges, overlaps, comparisons, diagnostics, scores."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import normalized
from .intervals import containing_pairs


def temporal_conflicts(cal: DataFrame) -> DataFrame:
    """(tree_id, older, younger, older_max, younger_min): an ancestor (or the same node) whose upper bound is below a
    descendant's lower bound.

    cal: tree_id, name, leaf_lo, leaf_hi, depth, min_age, max_age; a null bound is open.  Nodes meet their descendants by
    the cells of their leaf intervals.
    """
    old = cal.where("max_age IS NOT NULL").select("tree_id", F.col("name").alias("older"), F.col("leaf_lo").alias("o_lo"), F.col("leaf_hi").alias("o_hi"), F.col("depth").alias("_od"), F.col("max_age").alias("older_max"))
    young = cal.where("min_age IS NOT NULL").select("tree_id", F.col("name").alias("younger"), F.col("leaf_lo").alias("i_lo"), F.col("leaf_hi").alias("i_hi"), F.col("depth").alias("_yd"), F.col("min_age").alias("younger_min"))
    hit = containing_pairs(old, young).where("_yd >= _od AND older_max < younger_min AND older != younger")
    return hit.select("tree_id", "older", "younger", "older_max", "younger_min")


def uncomparable(cal: DataFrame) -> DataFrame:
    """(tree_id, n_pairs, n_nested, n_uncomparable): pairs of calibrations of a tree, those of which one lies within the
    other, and those whose ages no containment orders."""
    rows = cal.select("tree_id", "name", "leaf_lo", "leaf_hi")
    outer = rows.select("tree_id", F.col("name").alias("_o"), F.col("leaf_lo").alias("o_lo"), F.col("leaf_hi").alias("o_hi"))
    inner = rows.select("tree_id", F.col("name").alias("_i"), F.col("leaf_lo").alias("i_lo"), F.col("leaf_hi").alias("i_hi"))
    # of two on the same interval only one order counts
    nested = containing_pairs(outer, inner).where("_o != _i AND (o_lo < i_lo OR o_hi > i_hi OR _o < _i)").groupBy("tree_id").agg(F.count("*").alias("n_nested"))
    n = rows.groupBy("tree_id").agg(F.count("*").alias("_n")).join(nested, "tree_id", "left")
    pairs, some = F.expr("_n * (_n - 1) div 2"), F.coalesce("n_nested", F.lit(0))
    return n.select("tree_id", pairs.alias("n_pairs"), some.alias("n_nested"), (pairs - some).alias("n_uncomparable"))


def merge_bounds(cal: DataFrame, by: list[str]) -> DataFrame:
    """(by, lo, hi, n, is_empty): the intersection of all intervals of a node."""
    m = cal.groupBy(*by).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.count("*").alias("n"))
    return m.withColumn("is_empty", F.coalesce(F.col("lo") > F.col("hi"), F.lit(False)))


def overlaps(rows: DataFrame, bands: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows of intervals [lo, hi] joined with the bands they touch; band bounds may come in either order.

    ``bands`` (name, start, end) is a fixed table of a few hundred rows, so it is broadcast.
    """
    b = bands.select("name", F.least("start", "end").alias("young"), F.greatest("start", "end").alias("old"))
    return rows.join(F.broadcast(b), (F.col("young") <= F.col(hi)) & (F.col("old") >= F.col(lo)))


def reconcile(left: DataFrame, right: DataFrame, on: str, only_left: str, only_right: str) -> DataFrame:
    """(on, status) of the full outer join of two name sets."""
    a = left.select(on).distinct().withColumn("_l", F.lit(1))
    b = right.select(on).distinct().withColumn("_r", F.lit(1))
    s = F.when(F.col("_l").isNull(), only_right).when(F.col("_r").isNull(), only_left).otherwise("match")
    return a.join(b, on, "full_outer").select(on, s.alias("status"))


def fuzzy_suggestions(missing: DataFrame, available: DataFrame, limit: int = 2) -> DataFrame:
    """(name, suggestion, distance): for each missing name the nearest available one within ``limit`` edits.

    Names are compared without regard to case, ``_`` and ``-``; a name that differs in these alone has distance 0.
    Candidates share one of ``limit + 1`` pieces of the name at a near position (a name within ``limit`` edits keeps one
    of its pieces whole), so no name meets all others; ties go to the smaller name.
    """
    m = missing.select(F.col("name")).distinct().withColumn("plain", normalized(F.col("name")))
    a = available.select(F.col("name").alias("suggestion")).distinct().withColumn("like", normalized(F.col("suggestion")))
    k = limit + 1
    # each plain form once, with its smallest name
    forms = a.where("like IS NOT NULL").groupBy("like").agg(F.min("suggestion").alias("suggestion"), F.sort_array(F.collect_set("suggestion")).alias("all"))
    probes = m.where("plain IS NOT NULL").select("plain", F.length("plain").alias("len")).distinct()
    cut = F.expr(f"transform(sequence(0, {limit}), i -> struct(i AS i, (i * len div {k}) AS s, (((i + 1) * len) div {k}) - ((i * len) div {k}) AS n))")
    probe = probes.select("plain", "len", F.explode(cut).alias("p")).select("plain", "len", F.col("p.n").alias("n"), F.expr("substring(plain, p.s + 1, p.n)").alias("piece"), F.col("p.s").alias("s"))
    sizes = F.expr(f"array_distinct(flatten(transform(sequence(greatest(0, length(like) - {limit}), length(like) + {limit}), L -> transform(sequence(0, {limit}), i -> ((i + 1) * L div {k}) - (i * L div {k})))))")
    grams = forms.select("like", F.explode(sizes).alias("n"))
    grams = grams.select("like", "n", F.explode(F.expr("if(n > length(like), array(-1), sequence(0, length(like) - n))")).alias("at")).where("at >= 0")
    grams = grams.select("like", "n", "at", F.expr("substring(like, at + 1, n)").alias("piece"))
    near = probe.join(grams, ["n", "piece"]).where(f"abs(at - s) <= {limit} AND abs(length(like) - len) <= {limit}").select("plain", "like").distinct()
    d = near.withColumn("distance", F.expr(f"levenshtein(plain, like, {limit})")).where("distance >= 0").join(forms, "like")
    # a name is no suggestion for itself
    found = m.join(d, "plain").withColumn("suggestion", F.when(F.col("suggestion") != F.col("name"), F.col("suggestion")).otherwise(F.get("all", F.lit(1))))
    best = found.where("suggestion IS NOT NULL").groupBy("name").agg(F.min(F.struct("distance", "suggestion")).alias("m"))
    return best.select("name", "m.suggestion", "m.distance")


def ranked(rows: DataFrame, by: list[str], key: str, ties: list[str] | None = None, ranges: int = 512) -> DataFrame:
    """``rows`` with ``rank`` (from 1) within ``by`` in the order of a numeric ``key``, then ``ties``.

    The keys are cut at their quantiles into ranges of like size, however they are spread; a range's offset comes from
    counts, the place inside it from a window.  A group that holds most rows is so ranked by as many tasks as it has
    ranges; rows of one key share a range.  Null keys come first, NaN last.
    """
    cells = rows.withColumn("_at", F.coalesce(F.col(key).cast("double"), F.lit(float("nan"))))
    cuts = cells.approxQuantile("_at", [i / ranges for i in range(1, ranges)], 1 / (2 * ranges))
    ends = [float("-inf"), *sorted({c for c in cuts if math.isfinite(c)}), float("inf")]
    if len(ends) > 2:
        cells = Bucketizer(splits=ends, inputCol="_at", outputCol="_cut", handleInvalid="keep").transform(cells)
    else:
        cells = cells.withColumn("_cut", F.lit(0.0))
    cells = cells.drop("_at").withColumn("_cut", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.col("_cut").cast("int")))
    before = W.partitionBy(*by).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)
    counts = cells.groupBy(*by, "_cut").agg(F.count("*").alias("_c")).withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    here = W.partitionBy(*by, "_cut").orderBy(key, *(ties or []))
    placed = cells.withColumn("_in", F.row_number().over(here))
    same = counts.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_cut"])), "_off")
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "_cut"])]
    return placed.join(same, on).withColumn("rank", F.col("_in") + F.col("_off")).select(*rows.columns, "rank")


def psrf(samples: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, chains, psrf): Gelman-Rubin over chains of equal length; samples: by, chain, value.  Null when fewer than two
    chains or unequal lengths; 1 - exactly - never comes from zero variance: then it is null too."""
    per = samples.groupBy(*by, "chain").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    agg = per.groupBy(*by).agg(F.count("*").alias("chains"), F.min("n").alias("n"), F.max("n").alias("n_max"), F.avg("var").alias("w"), F.var_samp("mean").alias("b"))
    ok = (F.col("chains") >= 2) & (F.col("n") == F.col("n_max")) & (F.col("w") >= 1e-15)
    value = F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")) / F.col("w"))
    return agg.select(*by, "n", "chains", F.when(ok, value).alias("psrf"))


def equal_lengths(samples: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Chains cut to the shortest one's length."""
    w = W.partitionBy(*by, "chain").orderBy(*order)
    n = samples.groupBy(*by, "chain").agg(F.count("*").alias("_n")).groupBy(*by).agg(F.min("_n").alias("_n"))
    return samples.withColumn("_r", F.row_number().over(w)).join(n, by).where("_r <= _n").drop("_r", "_n")


def iteration_guard(rows: DataFrame, by: list[str], index: str, order: list[str]) -> DataFrame:
    """(by, n, is_increasing): whether ``index`` rises strictly in the given order."""
    w = W.partitionBy(*by).orderBy(*order)
    step = rows.withColumn("_up", F.coalesce(F.col(index) > F.lag(index).over(w), F.lit(True)))
    return step.groupBy(*by).agg(F.count("*").alias("n"), F.bool_and("_up").alias("is_increasing"))


def convergence(rows: DataFrame, max_psrf: float = 1.05, min_ess: float = 100) -> Column:
    """Tri-state verdict over columns psrf and ess: null where either is unknown, false for NaN."""
    bad = F.isnan("psrf") | F.isnan("ess")
    return F.when(F.col("psrf").isNull() | F.col("ess").isNull(), F.lit(None)).when(bad, F.lit(False)).otherwise((F.col("psrf") <= max_psrf) & (F.col("ess") >= min_ess))


def chain_summary(samples: DataFrame, by: list[str]) -> DataFrame:
    """Mean of means, median of medians, an interval, and how many pairs of chains are disjoint.

    Several chains have the envelope of their values (RANGE), a single one its shortest interval of 95 % (HPD95).
    """
    from .diagnostics import hpd

    per = samples.groupBy(*by, "chain").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    out = per.groupBy(*by).agg(F.avg("mean").alias("mean"), F.median("median").alias("median"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("chains"))
    a, b = (per.select(*by, *(F.col(c).alias(f"{x}_{c}") for c in ("chain", "lo", "hi"))) for x in "ab")
    apart = a.join(b, by).where("a_chain < b_chain AND (a_hi < b_lo OR b_hi < a_lo)").groupBy(*by).agg(F.count("*").alias("disjoint_pairs"))
    single = per.groupBy(*by).agg(F.count("*").alias("_c")).where("_c = 1").select(*by)
    dense = hpd(samples.join(single, by, "left_semi"), by).select(*by, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    out = out.join(apart, by, "left").fillna(0, ["disjoint_pairs"]).join(dense, by, "left")
    out = out.withColumn("lo", F.coalesce("_lo", "lo")).withColumn("hi", F.coalesce("_hi", "hi")).drop("_lo", "_hi")
    return out.withColumn("ci_type", F.when(F.col("chains") > 1, "RANGE").otherwise("HPD95"))


def pivot_methods(rows: DataFrame, by: list[str], methods: list[str], value: str = "age") -> DataFrame:
    """One column per known method, in one aggregation: the methods are given, so no value is looked for first."""
    return rows.groupBy(*by).agg(*[F.max(F.when(F.col("method") == m, F.col(value))).alias(m) for m in methods])


def disagreement(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_pairs, max_delta, n_disjoint, n_mixed): over all pairs of methods; rows: by, method, age, lo, hi, ci_type."""
    cols = ("method", "age", "lo", "hi", "ci_type")
    a, b = (rows.select(*by, *(F.col(c).alias(f"{x}_{c}") for c in cols)) for x in "ab")
    p = a.join(b, by).where("a_method < b_method")
    return p.groupBy(*by).agg(
        F.count("*").alias("n_pairs"), F.max(F.abs(F.col("a_age") - F.col("b_age"))).alias("max_delta"),
        F.count_if((F.col("a_hi") < F.col("b_lo")) | (F.col("b_hi") < F.col("a_lo"))).alias("n_disjoint"), F.count_if(F.col("a_ci_type") != F.col("b_ci_type")).alias("n_mixed"),
    )


def accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mae, rmse, max_abs, max_rel, median_rel): estimate against truth; the median is the upper one."""
    e = rows.withColumn("_e", F.abs(F.col("estimate") - F.col("truth"))).withColumn("_r", F.col("_e") / F.abs("truth"))
    sq = F.col("_e") * F.col("_e")
    out = e.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_e").alias("mae"), F.sqrt(F.avg(sq)).alias("rmse"), F.max("_e").alias("max_abs"), F.max("_r").alias("max_rel"))
    mid = ranked(e.select(*by, "_r"), by, "_r").join(out.select(*by, "n"), by).where("rank = n div 2 + 1").select(*by, F.col("_r").alias("median_rel"))
    return out.join(mid, by, "left")


def honours(age: Column, lo: Column, hi: Column) -> Column:
    """Fixed ages hold within 1, ranges within the larger of 1 and 5 % of their width; a null bound is open."""
    slack = F.when(lo == hi, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), 0.05 * (hi - lo)))
    slack = F.coalesce(slack, F.lit(1.0))
    return F.coalesce(age >= lo - slack, F.lit(True)) & F.coalesce(age <= hi + slack, F.lit(True))


def unit_factor(ratio: Column) -> Column:
    """The factor among 1, 1e3, 1e-3, 1e6 that brings ``ratio`` (estimate over calibration) nearest to one; first on ties."""
    opts = [1.0, 1e3, 1e-3, 1e6]
    scored = F.array(*[F.struct(F.abs(F.log(ratio * f)).alias("d"), F.lit(i).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(opts)])
    return F.array_min(scored)["f"]


def rank_statistics(rows: DataFrame, ranks: list[str]) -> DataFrame:
    """(rank, total, filled, missing) of columns as ranks, in one pass."""
    stats = rows.agg(*[F.struct(F.lit(r).alias("rank"), F.count("*").alias("total"), F.count_if(F.col(r).isNotNull() & (F.col(r).cast("string") != "")).alias("filled")).alias(f"_{i}") for i, r in enumerate(ranks)])
    flat = stats.select(F.explode(F.array(*stats.columns)).alias("s")).select("s.*")
    return flat.withColumn("missing", F.col("total") - F.col("filled"))


def batch_statistics(runs: DataFrame) -> DataFrame:
    """(method, runs, succeeded, avg_nodes, min_nodes, max_nodes, cpu_seconds): success means ran and gave results."""
    ok = (F.col("status") == "ok") & (F.col("nodes") > 0)
    return runs.groupBy("method").agg(F.count("*").alias("runs"), F.count_if(ok).alias("succeeded"), F.avg(F.when(ok, F.col("nodes"))).alias("avg_nodes"), F.min(F.when(ok, F.col("nodes"))).alias("min_nodes"), F.max(F.when(ok, F.col("nodes"))).alias("max_nodes"), F.sum("seconds").alias("cpu_seconds"))


def best_smoothing(rows: DataFrame, by: list[str]) -> DataFrame:
    """The smoothing value of least chi-square; the first on ties.  rows: by, ordinal, smoothing, chisq."""
    return rows.groupBy(*by).agg(F.min(F.struct("chisq", "ordinal", "smoothing")).alias("m")).select(*by, "m.smoothing", "m.chisq")


def degradation_deviation(rows: DataFrame) -> DataFrame:
    """Per cent deviation of the degraded estimate; rows: reference, degraded."""
    d = (F.col("degraded") - F.col("reference")) / F.col("reference") * 100
    return rows.agg(F.avg(F.abs(d)).alias("mean_abs_pct"), F.max(F.abs(d)).alias("max_abs_pct"), F.count("*").alias("n"))


def min_max_scale(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """``scaled``: 0..1 within each group, 0.5 where constant."""
    w = W.partitionBy(*by)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return rows.withColumn("scaled", F.when(hi == lo, F.lit(0.5)).otherwise((F.col(column) - lo) / (hi - lo)))
