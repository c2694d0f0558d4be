"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source with weight ``w`` - whole ticks of SCALE - owns subtasks ``j = 0, 1, ...``, one a block of its rows, with release
``floor(j * SCALE / w)`` and deadline ``ceil((j + 1) * SCALE / w)``.  Each slot goes to the released subtask with the
earliest deadline.  As the weights sum to SCALE this meets every deadline, so after any number of slots each source has had
its exact share to less than one block, however long the mixture: weights are parts of 2 ** 40 and no period rounds them.
The schedule depends on the weights and the numbers of blocks alone.  It is a fold of one row over the mixture's slots, and
data rows only look their slot up; where there are many rows blocks are larger, so that there are about ``most_slots`` slots.

Within a source, rows are ordered by the MD5 of their key; ranks come from
counts of hash ranges plus a row number inside a (source, range), so a source
that holds most rows is still ranked by many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What weights are parts of.
SCALE = 1 << 40

#: Rows of a source and range that are ranked together, about.
RANGE_ROWS = 20_000

#: The longest schedule that is sent to all tasks (some 60 bytes a slot); a longer one is joined.
SENT_SLOTS = 1 << 20


def pfair_schedule(weights: DataFrame, slots: int) -> DataFrame:
    """(source, subtask, slot, release, deadline, ticks) of the first slots; ``weights``: (source, ticks) with ticks summing
    to SCALE."""
    state = F.struct("source", F.col("ticks").cast("long").alias("ticks"), F.lit(0).cast("long").alias("done"))
    one = weights.where("ticks > 0").agg(F.array_sort(F.collect_list(state)).alias("s")).where(F.size("s") > 0)
    # the released subtask with the earliest deadline; ties go to the earlier release, then to the source's name
    pick = f"""array_min(transform(a.s, (x, i) -> if(x.done * {SCALE} div x.ticks <= t,
        struct((((x.done + 1) * {SCALE} + x.ticks - 1) div x.ticks) AS deadline, (x.done * {SCALE} div x.ticks) AS release, i AS i), null)))"""
    # a fold copies its state at each step: the plan is a text, the sources' numbers in order of slots
    step = f"""transform(array({pick}), p -> struct(
        transform(a.s, (x, i) -> named_struct('source', x.source, 'ticks', x.ticks, 'done', x.done + if(i = p.i, 1L, 0L))) AS s,
        concat(a.plan, if(t = 0, '', ','), cast(p.i AS string)) AS plan))[0]"""
    numbers = f"sequence(0L, {slots - 1}L)" if slots else "cast(array() AS array<bigint>)"
    folded = one.select(F.expr(f"aggregate({numbers}, struct(s AS s, '' AS plan), (a, t) -> {step}, a -> a.plan)").alias("plan"), F.expr("transform(s, x -> named_struct('source', x.source, 'ticks', x.ticks))").alias("s"))
    rows = folded.where("plan != ''").select("s", F.posexplode(F.split("plan", ",")).alias("slot", "i"))
    rows = rows.select(F.col("slot").cast("long").alias("slot"), F.get("s", F.col("i").cast("int")).alias("x")).select("slot", "x.source", "x.ticks")
    rows = rows.withColumn("subtask", F.row_number().over(W.partitionBy("source").orderBy("slot")).cast("long") - 1)
    return rows.select("source", "subtask", "slot", F.expr(f"subtask * {SCALE} div ticks").alias("release"), F.expr(f"((subtask + 1) * {SCALE} + ticks - 1) div ticks").alias("deadline"), "ticks")


def target_ticks(sizes: DataFrame, weights: dict[str, float] | None, max_share: float | None) -> DataFrame:
    """(source, blocks, ticks, capped): weights as whole ticks that sum to SCALE by largest remainders, each source one at
    least.  sizes: source, blocks.

    Given ``weights`` (source -> weight) hold for the named sources and the rest weigh nothing; else each source weighs its
    share of the blocks.  With ``max_share`` the largest sources weigh that much instead, as many of them as it takes until
    none of the others, in the rest of the mixture, is above it.  Of k sources one must weigh 1 / k at least, so where
    ``max_share`` is less they are held to that.
    """
    alone = W.partitionBy(F.lit(0))  # one row per source: the number of sources is a setting of the corpus, not its size
    k = F.count("*").over(alone)
    if weights:
        named = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
        shares = sizes.withColumn("_w", named).where("_w > 0").withColumn("w", F.col("_w") / F.sum("_w").over(alone)).withColumn("capped", F.lit(True))
    else:
        falling = W.partitionBy(F.lit(0)).orderBy(F.desc("blocks"), "source")
        shares = sizes.withColumn("_place", F.row_number().over(falling) - 1)  # how many sources are larger
        shares = shares.withColumn("_rest", F.sum("blocks").over(falling.rowsBetween(0, W.unboundedFollowing)))
        shares = shares.withColumn("_cap", F.greatest(F.lit(max_share or 1.0), F.lit(1.0) / k))
        fits = F.col("blocks") * (1 - F.col("_place") * F.col("_cap")) <= F.col("_cap") * F.col("_rest")
        n_capped = F.coalesce(F.min(F.when(fits, F.col("_place"))).over(alone), k - 1)
        shares = shares.withColumn("_capped", n_capped).withColumn("capped", F.col("_place") < F.col("_capped"))
        rest = F.max(F.when(~F.col("capped"), F.col("_rest"))).over(alone)
        shares = shares.withColumn("w", F.when(F.col("capped"), F.col("_cap")).otherwise(F.col("blocks") / rest * (1 - F.col("_capped") * F.col("_cap"))))
    t = shares.withColumn("_x", F.col("w") * (F.lit(SCALE) - k)).withColumn("_f", F.floor("_x"))
    t = t.withColumn("_left", F.lit(SCALE) - k - F.sum("_f").over(alone))
    by = W.partitionBy(F.lit(0)).orderBy((F.col("_x") - F.col("_f")).desc(), "source")
    t = t.withColumn("ticks", F.lit(1) + F.col("_f") + (F.row_number().over(by) <= F.col("_left")).cast("int"))
    return t.select("source", "blocks", F.col("ticks").cast("long").alias("ticks"), "capped")


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, max_share: float | None = None, block: int = 16, most_slots: int = 1 << 14) -> DataFrame:
    """(key, source, rank, block, slot, release, deadline, selected), one row per input row.

    ``slot`` is the block's place in the interleaving; ``release <= slot < deadline``.  ``selected`` marks the rows of the
    mixture; the others have no slot.  With neither ``weights`` nor ``max_share`` that is every row.  With ``max_share`` the
    mixture ends when the sources that weigh as sized have run out, so only of those held to it rows are left over.  With
    ``weights`` it ends when the source that runs out first has; rows of sources that are not named are never selected.

    Blocks hold ``block`` rows, or the rows over ``most_slots`` where that is more.  A null source is a source of its own
    (read as the empty name), a null key ranks as the empty text does, rows that repeat a key are placed separately, texts
    are not read, and an empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"))
    n = rows.groupBy("source").agg(F.count("*").alias("n"))
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    block = max(block, -(-total["n"] // most_slots))
    digits = max(2, math.ceil(math.log(max(total["most"] / RANGE_ROWS, 1), 16)))
    hashed = rows.withColumn("_h", F.md5(F.coalesce(F.col("_key").cast("string"), F.lit("")).cast("binary"))).withColumn("_range", F.substring("_h", 1, digits))
    before = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = hashed.groupBy("source", "_range").agg(F.count("*").alias("c"))
    starts = counts.withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    here = W.partitionBy("source", "_range").orderBy("_h", "_key")
    ranked = hashed.withColumn("_r", F.row_number().over(here)).join(starts, ["source", "_range"])
    ranked = ranked.select("_key", "source", (F.col("_r") - 1 + F.col("start")).alias("rank")).withColumn("block", F.expr(f"rank div {block}"))

    ticks = target_ticks(n.select("source", F.expr(f"(n + {block - 1}) div {block}").alias("blocks")), weights, max_share)
    if weights:
        slots = ticks.agg(F.min(F.expr(f"blocks * {SCALE} div ticks")).alias("t")).first()["t"] or 0
    else:
        slots = ticks.agg(F.max(F.when(~F.col("capped"), F.expr(f"(blocks * {SCALE} + ticks - 1) div ticks"))).alias("t")).first()["t"] or 0
    plan = pfair_schedule(ticks.select("source", "ticks"), slots).drop("ticks").withColumnRenamed("subtask", "block")
    if not weights:  # up to the last block of the sources that weigh as sized; a row a slot
        last = F.max(F.when(~F.col("capped") & (F.col("block") == F.col("blocks") - 1), F.col("slot"))).over(W.partitionBy(F.lit(0)))
        plan = plan.join(ticks.drop("ticks"), "source").withColumn("_last", last).where("slot <= _last").drop("_last", "blocks", "capped")
    out = ranked.join(F.broadcast(plan) if slots <= SENT_SLOTS else plan, ["source", "block"], "left")
    return out.select(F.col("_key").alias(key), "source", "rank", "block", "slot", "release", "deadline", F.col("slot").isNotNull().alias("selected"))
