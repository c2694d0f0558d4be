"""Exact dedup through an extendible-hash index on shared files, in DataFrame operations only.

1. *Hashes.*  Rows are counted by the 64-bit hash of their text; no text moves.
2. *Directory.*  It starts with one slot, and while a bucket holds more than
   ``capacity`` distinct hashes the directory doubles and that bucket splits on
   the next bit of the hash: a bucket is the shallowest prefix of the hash that
   fits.  The directory (slot, depth) is a table in the shared folder.
3. *Buckets.*  Hashes that one row has are entries as they are.  Texts whose
   hash several rows may share are first pre-aggregated with a salt, so that a
   text which a third of all rows hold leaves a few rows, and then go to their
   bucket's owner: the one exchange is by bucket.  In the bucket, texts of one
   hash form a chain and are told apart by their bytes.  The owners' entries,
   sorted by bucket and hash, are the index in the shared folder.
4. *Lookup.*  Each row finds its entry by bucket and hash, and by the bytes too
   where the chain of that hash has several entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textcore import flagged, stored

#: Slots of a directory that is broadcast (some 30 MB); a larger one is joined by shuffle.
BROADCAST_SLOTS = 1 << 20
SALT = 8


def prefix(depth, of: int = 64, col: str = "h"):
    """The first ``depth`` of the ``of`` bits of ``col``; a shift by 64 would be one by 0."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    shift = F.lit(of) - depth
    return F.when(shift >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col(col), shift))


def directory(hashes: DataFrame, capacity: int, bits: int = 64) -> tuple[DataFrame, int]:
    """((slot, depth), global depth): ``slot`` is a hash's first bits, as many as the global depth; its bucket the first ``depth``.

    ``hashes`` has distinct ``h`` (long).  It doubles until no bucket holds more than ``capacity`` hashes, or until all
    ``bits`` bits of the hash are used.
    """
    n, top = hashes.count(), 0
    while n > capacity << top:
        top += 1
    while True:
        top = min(top + 4, bits)  # buckets fill unevenly: some splits more than the mean needs
        slots = hashes.groupBy(prefix(top).alias("slot")).agg(F.count("*").alias("n"))
        if top == bits or not slots.where(F.col("n") > capacity).head(1):
            break
    levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("depth"))
    levels = levels.withColumn("at", prefix(F.col("depth"), top, "slot"))
    fits = levels.groupBy("depth", "at").agg(F.sum("n").alias("n")).where((F.col("n") <= capacity) | (F.col("depth") == top)).drop("n")
    return levels.drop("n").join(fits, ["depth", "at"]).groupBy("slot").agg(F.min("depth").alias("depth")), top


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 20_000, hot_share: int = 500, bits: int = 64) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256), one row per input row.

    Texts are equal when their bytes are; a null text equals an empty one.  Of equal texts the largest key stays; rows
    that repeat a key are kept apart, and all of them carry the group's ``keep_id`` (``kept`` marks each row whose key is
    that one).  A null key never wins against another, and a group with null keys only has a null ``keep_id`` and keeps
    its rows.  An empty table gives no rows; other columns are ignored.

    ``capacity``: distinct hashes a bucket may hold before it splits.  ``bits``: bits of the hash that are used; fewer make
    longer chains.  ``hot_share``: entries of more than 1/hot_share of the rows, of which there are fewer than
    ``hot_share``, are looked up by broadcast instead of a shuffle of their rows.
    """
    hash_ = F.xxhash64("_text") if bits == 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64("_text"), 64 - bits), 64 - bits)
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("h", hash_)
    hashes = stored(rows.groupBy("h").agg(F.max("_key").alias("keep"), F.count("*").alias("n")), "exact-hashes")
    slots, top = directory(hashes.select("h"), capacity, bits)
    slots = stored(slots, "exact-directory")
    small = slots.count() <= BROADCAST_SLOTS

    def housed(df: DataFrame) -> DataFrame:
        """``df`` with the bucket of its ``h``: how many bits count, and these."""
        found = df.withColumn("slot", prefix(top)).join(F.broadcast(slots) if small else slots, "slot")
        return found.withColumn("_bucket", F.concat_ws("-", "depth", prefix(F.col("depth"), top, "slot"))).drop("slot", "depth")

    # rows whose hash is not alone, and few others, are told apart by their texts
    shared = hashes.where("n > 1").select("h")
    alone = flagged(hashes.where("n = 1"), shared, ["h"]).where("NOT _hit").select("h", F.lit("").alias("_text"), "keep", F.lit(1).cast("long").alias("size"))
    salted = flagged(rows, shared, ["h"]).where("_hit").groupBy("h", "_text", F.pmod(F.xxhash64("_key"), F.lit(SALT)).alias("_salt"))
    texts = salted.agg(F.max("_key").alias("keep"), F.count("*").alias("size")).drop("_salt")
    owned = housed(alone.unionByName(texts)).repartition("_bucket")
    chain = owned.groupBy("_bucket", "h", "_text").agg(F.max("keep").alias("keep"), F.sum("size").alias("size"))
    chain = chain.withColumn("_long", F.count("*").over(W.partitionBy("_bucket", "h")) > 1)
    entries = chain.select("_bucket", "h", F.when(F.col("_long"), F.col("_text")).alias("_text"), "keep", "size").sortWithinPartitions("_bucket", "h")
    index = stored(entries, "exact-index")

    total = index.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    one = index.where("_text IS NULL").select("_bucket", "h", "keep", "size")
    is_hot = F.col("size") * hot_share > F.lit(total)
    hot = one.where(is_hot).select(F.col("h").alias("_hot"), F.col("keep").alias("_k"), F.col("size").alias("_n"))
    ids = rows.select("_key", "h", F.sha2("_text", 256).alias("text_sha256"))
    found = housed(ids).join(F.broadcast(hot), F.col("h") == F.col("_hot"), "left")
    # rows already answered get join keys of their own, so that they spread over all tasks
    found = found.withColumn("_probe", F.when(F.col("_hot").isNull(), F.col("h")).otherwise(F.xxhash64("_key", F.lit("answered"))))
    entry = one.where(~is_hot).select(F.col("_bucket").alias("_b"), F.col("h").alias("_h"), "keep", "size")
    met = found.join(entry, (F.col("_bucket") == F.col("_b")) & (F.col("_probe") == F.col("_h")) & F.col("_hot").isNull(), "left")
    out = met.select("_key", "text_sha256", F.coalesce("_k", "keep").alias("keep"), F.coalesce("_n", "size").alias("size"))
    chains = index.where("_text IS NOT NULL").select("h", "_text", "keep", "size")
    if chains.head(1):  # different texts of one hash: their rows compare bytes
        by_bytes = flagged(rows, chains.select("h"), ["h"]).where("_hit").drop("_hit").join(chains, ["h", "_text"])
        out = out.where("size IS NOT NULL").unionByName(by_bytes.select("_key", F.sha2("_text", 256).alias("text_sha256"), "keep", "size"))
    return out.select(F.col("_key").alias(key), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("_key").eqNullSafe(F.col("keep")).alias("kept"), "text_sha256")
