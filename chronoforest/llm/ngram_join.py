"""N-gram Jaccard join with a count-vector index.

A document is its set of word shingles.  Shingles are hashed into groups and
the numbers of shingles a group holds are the document's point.  For two sets
the overlap is at most the sum of the smaller counts, group by group.

The index is distributed by the same groups.  Sets are classed by size so that
linked sets are in one class or in neighbouring ones.  For a pair of classes
whose larger set has M shingles, linked sets differ in at most r shingles; with
more than r groups at least one group is the same in both, so the shard key
(classes, group, count and fingerprint of the group) brings every linked pair
together.  A few more groups than that make sure that one of these isn't empty.
No shard pairs up all its members, and only what is still apart is compared:

1. The key space is taken in two parts, a small one first.  Of a part's shards
   those whose members lie in one component already are passed over.  In the
   others a member of another component than the smallest member's is a
   candidate for a link with that one: first with the one that it meets in most
   shards, then, where that didn't join them, with the others.  Candidates that
   the bound leaves are verified on their sets, and links connect components.
2. Shards that then still hold several components are found by part again.
   Near misses meet in most of their shards, so documents that such shards tie
   together, a family, go to one task, each once and with its set.  A packed
   R-tree of the members' points joins them: node pairs whose summed minima of
   upper corners can't reach the needed overlap are cut off, as are pairs of one
   component, and the others are verified on the spot; only links that join
   components leave the task, fewer than it has members.  A family over SHARD is
   dealt to tasks as pairs of chunks: chunks of its largest component with
   chunks of the rest, and those among themselves, in rounds in which sets come
   to about the text's size.
3. A family of more than FAMILY * SHARD would be copied too often by that.  Its
   shards are joined one by one, by points alone, in rounds of the text's size,
   and the surviving pairs are verified afterwards.

After that, every linked pair lies in one component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .textcore import drop_rows, flagged, mix, pack, remove, shingles, slices, stored, tasks_for, trim, unpack, words_of

POINT = 128
LEAF, FAN = 32, 16
#: The key space is taken by the keys' remainders by 8: 0 first, then the others in two parts, so that no shuffle has all keys.
PARTS = (("0",), ("1", "2", "3"), ("4", "5", "6", "7"))
#: Text that feature and key rows are made of at once.
PIECE_BYTES = 1 << 19
#: About what a member's row takes in a shuffle with its point, and a shingle in a text.
MEMBER_BYTES, SHINGLE_BYTES = 160, 6
#: Members of a family or shard, and of each side of a pair of chunks, that one task joins; one of more than SET shingles
#: counts as its number of SETs.  A family of up to FAMILY such chunks is joined as a whole.
SHARD, SET, FAMILY = 4096, 512, 16
#: What a shingle takes in a set.
SET_BYTES = 8


@lru_cache(8)
def class_bounds(percent: int, up_to: int) -> np.ndarray:
    """Lower bounds of the size classes: a set and any that is linked with it are in one class or in neighbours."""
    out = [1, 2]
    while out[-1] <= up_to:
        out.append(max(out[-1] + 1, (out[-1] - 1) * 100 // percent + 1))
    return np.array([*out, max(out[-1] + 1, (out[-1] - 1) * 100 // percent + 1), 2**62])


@lru_cache(4096)
def group_count(most: int, percent: int) -> int:
    """Groups for sets of up to ``most`` shingles: one more than linked sets can differ in, and some for empty groups."""
    r = 2 * most * (100 - percent) // (100 + percent)
    if not r:
        return 1
    empty = (r + 1) * math.exp(-most / (r + 1))
    return r + 1 + math.ceil(empty + 3 * math.sqrt(empty))


def group_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Shard keys of a set of shingle hashes; none where only an equal set can be linked.

    A linked set differs in at most d shingles, so if more than d groups hold something, one of these is the same in both.
    Only a set with fewer such groups needs its empty groups as keys; in a pair of two such sets both have them.
    """
    n = len(s)
    if not n:
        return s
    bounds = class_bounds(percent, 1 << max(12, n.bit_length()))
    c = int(np.searchsorted(bounds, n, side="right")) - 1
    out = []
    for p in (c - 1, c):
        if p < 0:
            continue
        most = int(bounds[p + 2]) - 1
        m = group_count(most, percent)
        if m == 1:
            continue
        d = (n + min(most, n * 100 // percent)) * (100 - percent) // (100 + percent)
        with np.errstate(over="ignore"):
            h = mix(s + np.uint64(p) * np.uint64(0xD1B54A32D192ED03))
            g = (h % np.uint64(m)).astype(np.int64)
            total = np.zeros(m, np.uint64)
            np.add.at(total, g, mix(h))
            count = np.bincount(g, minlength=m)
            keys = mix(mix(total + count.astype(np.uint64)) + np.arange(m, dtype=np.uint64) + (np.uint64(p) << np.uint64(40)))
        held = count > 0
        out.append(keys if held.sum() <= d else keys[held])
    return np.concatenate(out) if out else s[:0]


def point(s: np.ndarray) -> np.ndarray:
    return np.bincount((mix(s ^ np.uint64(0xA5A5)) % np.uint64(POINT)).astype(np.int64), minlength=POINT).astype(np.uint8 if len(s) < 256 else np.uint32)


def needed(a, b, percent: int):
    """Least overlap of linked sets of ``a`` and ``b`` elements: percent * union <= 100 * overlap."""
    return -(-(a + b) * percent // (100 + percent))


def tree_pairs(points: np.ndarray, size: np.ndarray, group: np.ndarray, percent: int, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of different ``group``, and different ``side`` if given, whose summed coordinate minima reach the needed
    overlap, by a packed R-tree."""
    if side is None:
        side = np.arange(len(size))
    order = np.lexsort((points[:, 0], size))
    # slabs by size, then by the first coordinate inside a slab
    slab = np.arange(len(order)) // (LEAF * FAN)
    order = order[np.lexsort((points[order, 0], slab))]
    p, n, g, own = points[order].astype(np.int32), size[order].astype(np.int64), group[order], side[order]
    levels = []
    lo = np.arange(0, len(order), LEAF)
    hi = np.minimum(lo + LEAF, len(order))
    while True:
        top = np.array([p[i:j].max(0) for i, j in zip(lo, hi, strict=True)])
        least = np.array([n[i:j].min() for i, j in zip(lo, hi, strict=True)])
        one = np.array([g[i] if (g[i:j] == g[i]).all() else -1 for i, j in zip(lo, hi, strict=True)])
        levels.append((lo, hi, top, least, one))
        if len(lo) == 1:
            break
        lo, hi = lo[::FAN], np.append(hi[FAN - 1 :: FAN], hi[-1])[: len(lo[::FAN])]
    stack = [(len(levels) - 1, 0, 0)]
    while stack:
        level, a, b = stack.pop()
        lo, hi, top, least, one = levels[level]
        if (one[a] == one[b] and one[a] >= 0) or np.minimum(top[a], top[b]).sum() < needed(least[a], least[b], percent):
            continue
        if level:
            kids = lambda x: range(x * FAN, min((x + 1) * FAN, len(levels[level - 1][0])))
            stack += [(level - 1, i, j) for i in kids(a) for j in kids(b) if a != b or i <= j]
            continue
        i, j = np.arange(lo[a], hi[a]), np.arange(lo[b], hi[b])
        bound = np.minimum(p[i][:, None, :], p[j][None, :, :]).sum(2)
        ok = (bound >= needed(n[i][:, None], n[j][None, :], percent)) & (g[i][:, None] != g[j][None, :]) & (own[i][:, None] != own[j][None, :])
        if a == b:
            ok &= i[:, None] < j[None, :]
        x, y = np.nonzero(ok)
        if len(x):
            yield order[i[x]], order[j[y]]


def feature_rows(docs: DataFrame, k: int) -> DataFrame:
    """(doc, n, set_key, point): docs has (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", PIECE_BYTES):
                w = words_of(part)
                n, sets, points = [], [], []
                for i in range(part.num_rows):
                    s = np.unique(shingles(w.hash[w.first[i] : w.first[i + 1]], k))
                    n.append(len(s))
                    with np.errstate(over="ignore"):
                        sets.append(np.array([len(s), mix(s).sum(dtype=np.uint64), mix(s + np.uint64(1)).sum(dtype=np.uint64)], np.uint64).tobytes() if len(s) else None)
                    points.append(pack(point(s)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(points, pa.binary())], names=["doc", "n", "set_key", "point"])
            trim()

    return docs.mapInArrow(run, "doc long, n long, set_key binary, point binary")


def key_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc, keys array<long>): shard keys of each (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", PIECE_BYTES):
                w = words_of(part)
                keys = [group_keys(np.unique(shingles(w.hash[w.first[i] : w.first[i + 1]], k)), percent).view(np.int64) for i in range(part.num_rows)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))], names=["doc", "keys"])
            trim()

    return docs.mapInArrow(run, "doc long, keys array<long>")


def shards(keyed: DataFrame) -> DataFrame:
    """(key, doc, pivot): keyed has (key, doc, comp).  Rows of other components than that of the key's first row, whose
    document is the pivot: the smallest component's smallest one.  One pass over sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # the first row of the last key
        for b in batches:
            if not b.num_rows:
                continue
            key, comp, doc = (np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held))
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            first = np.repeat(at, np.diff(np.append(at, len(key))))
            out = comp != comp[first]
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, doc, doc[first])], names=["key", "doc", "pivot"])
            held = [x[at[-1] : at[-1] + 1] for x in (key, comp, doc)]

    ordered = keyed.select("key", "comp", "doc").repartition(tasks_for(keyed), "key").sortWithinPartitions("key", "comp", "doc")
    return ordered.mapInArrow(run, "key long, doc long, pivot long")


def open_stars(keyed: DataFrame) -> DataFrame:
    """(doc, v) of all rows of keys with several components; keyed has (key, doc, comp).  v is the document of the key's
    first row by (comp, doc), which has a row itself.  One pass over sorted rows; of a key it holds one component's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # rows of the last key: of its first component only, or its first and last
        for b in batches:
            if not b.num_rows:
                continue
            key, comp, doc = (np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held))
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(at, len(key)))
            several = np.repeat(comp[at] != comp[at + size - 1], size)
            if several.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[several]), pa.array(np.repeat(doc[at], size)[several])], names=["doc", "v"])
            rest = np.array([at[-1], len(key) - 1]) if several[-1] else np.arange(at[-1], len(key))
            held = [x[rest] for x in (key, comp, doc)]

    ordered = keyed.select("key", "comp", "doc").repartition(tasks_for(keyed), "key").sortWithinPartitions("key", "comp", "doc")
    return ordered.mapInArrow(run, "doc long, v long").distinct()


def set_rows(docs: DataFrame, k: int) -> DataFrame:
    """(doc, s array<long>) of sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", PIECE_BYTES):
                w = words_of(part)
                sets = [np.unique(shingles(w.hash[w.first[i] : w.first[i + 1]], k)).view(np.int64) for i in range(part.num_rows)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["doc", "s"])
            trim()

    return docs.mapInArrow(run, "doc long, s array<long>")


def within_bound(pairs: DataFrame, feats: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose summed coordinate minima reach the needed overlap; no linked pair is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.stack([unpack(p)[0] for p in b.column(i).to_pylist()]).astype(np.int32) for i in (4, 5))
            ok = np.minimum(x, y).sum(1) >= needed(b.column(2).to_numpy(), b.column(3).to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(ok))

    side = lambda c: feats.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}"), F.col("point").alias(f"p_{c}"))
    j = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "n_v", "p_u", "p_v")
    return j.mapInArrow(run, "u long, v long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v) of the pairs (u, v) that are linked, on their whole sets."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc"))
    sets = set_rows(flagged(docs, ids, ["doc"]).where("_hit").select("doc", "text"), k)
    left = pairs.join(sets.select(F.col("doc").alias("u"), F.col("s").alias("a")), "u")
    both = left.join(sets.select(F.col("doc").alias("v"), F.col("s").alias("b")), "v")
    inter = F.size(F.array_intersect("a", "b"))
    return both.withColumn("_i", inter).where(F.expr(f"100 * _i >= {percent} * (size(a) + size(b) - _i)")).select("u", "v")


def weight(members: DataFrame):
    """What a member counts as, by ``n`` if it is there."""
    return F.greatest(F.lit(1.0), F.col("n") / SET) if "n" in members.columns else F.lit(1.0)


def dealt(members: DataFrame, shard: int) -> DataFrame:
    """members, (key, doc, comp) and n if there, with the task and side of each copy: ``tile`` (a, b) and ``side``.

    A shard of at most ``shard`` members is one tile in which all sides differ (``side`` is null).  A larger one is cut into
    chunks of its largest component (numbered from 0) and chunks of all others (numbered -1, -2 ..), by the document's hash;
    a tile is a pair of chunks, not both of the largest component.
    """
    per = members.groupBy("key", "comp").agg(F.sum(weight(members)).alias("c"))
    big = per.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("most"), F.max("c").alias("in_most"), F.sum("c").alias("all")).where(F.col("all") > shard)
    big = big.select("key", "most", F.ceil(F.col("in_most") / shard).alias("n_a"), F.ceil((F.col("all") - F.col("in_most")) / shard).alias("n_o"))
    m = members.join(big, "key", "left")
    chunk = lambda n: F.pmod(F.xxhash64("doc"), F.col(n))
    inner = F.transform(F.sequence(F.lit(1).cast("long"), F.col("n_o")), lambda o: F.struct(chunk("n_a").alias("a"), (-o).alias("b"), F.lit(0).alias("side")))
    mine = -(chunk("n_o") + 1)
    across = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_a") - 1), lambda a: F.struct(a.alias("a"), mine.alias("b"), F.lit(1).alias("side")))
    others = F.transform(F.sequence(-F.col("n_o"), F.lit(-1).cast("long")), lambda o: F.struct(F.greatest(mine, o).alias("a"), F.least(mine, o).alias("b"), F.when(o != mine, (mine > o).cast("int")).alias("side")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(None).cast("int").alias("side")))
    tiles = F.when(F.col("most").isNull(), whole).when(F.col("comp") == F.col("most"), inner).otherwise(F.concat(across, others))
    return m.withColumn("_t", F.explode(tiles)).select("key", F.col("_t.a").alias("a"), F.col("_t.b").alias("b"), "_t.side", "doc", "comp", *(c for c in ("n",) if c in members.columns))


def tables_by(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[pa.Table]:
    """The rows of each value of the columns ``by``, which lie one after the other."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b])
        rows = rows if held is None else pa.concat_tables([held, rows])
        k = [rows.column(c).to_numpy() for c in by]
        cut = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in k])) + 1
        for i, j in zip([0, *cut[:-1]], cut, strict=False):
            yield rows.slice(i, j - i)
        held = rows.slice(cut[-1]) if len(cut) else rows
    if held is not None:
        yield held


def unresolved_pairs(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) that join components within tiles, fewer than a tile has members; members: see dealt(), docs has (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tables_by(batches, "key", "a", "b"):
            comp = rows.column("comp").to_numpy()
            if (comp == comp[0]).all():
                continue
            lists = rows.column("s").combine_chunks()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            sets = [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
            n, d = np.diff(at).astype(np.int64), rows.column("doc").to_numpy()
            side = None if rows.column("side")[0].as_py() is None else rows.column("side").to_numpy()
            own = np.unique(comp, return_inverse=True)[1].tolist()
            parent, links = list(range(len(own))), []

            def top(x: int, parent: list[int] = parent) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for i, j in tree_pairs(np.stack([point(s) for s in sets]), n, comp, percent, side):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    a, b = top(own[x]), top(own[y])
                    if a == b:
                        continue
                    s, t = sets[x], sets[y]
                    both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        parent[a] = b
                        links.append((max(d[x], d[y]), min(d[x], d[y])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["u", "v"])
        trim()

    sets = set_rows(flagged(docs, members.select("doc"), ["doc"]).where("_hit").select("doc", "text"), k).where("size(s) > 0")
    tiles = members.join(sets, "doc").select("key", "a", "b", "side", "doc", "comp", "s")
    ordered = tiles.repartition(tasks_for(members), "key", "a", "b").sortWithinPartitions("key", "a", "b")
    return ordered.mapInArrow(run, "u long, v long").distinct()


def point_pairs(members: DataFrame, feats: DataFrame, percent: int, shard: int) -> DataFrame:
    """Pairs (u, v) of one shard and different components that the R-tree doesn't rule out; members: see dealt(), feats has
    (doc, n, point)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tables_by(batches, "key", "a", "b"):
            comp = rows.column("comp").to_numpy()
            if (comp == comp[0]).all():
                continue
            points = np.stack([unpack(p)[0] for p in rows.column("point").to_pylist()])
            side = None if rows.column("side")[0].as_py() is None else rows.column("side").to_numpy()
            d = rows.column("doc").to_numpy()
            for i, j in tree_pairs(points, rows.column("n").to_numpy(), comp, percent, side):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(d[i], d[j])), pa.array(np.minimum(d[i], d[j]))], names=["u", "v"])

    tiles = dealt(members.select("key", "doc", "comp"), shard).join(feats.select("doc", "n", "point"), "doc").select("key", "a", "b", "side", "doc", "comp", "n", "point")
    ordered = tiles.repartition(tasks_for(members), "key", "a", "b").sortWithinPartitions("key", "a", "b")
    return ordered.mapInArrow(run, "u long, v long").distinct()


def placed(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``rows``, which have ``doc``, with its component so far as ``comp``."""
    if comp is None:
        return rows.withColumn("comp", F.col("doc"))
    return rows.join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """(key, n_shingles, component_id), one row per input row.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of ``k``-word shingles (fewer words:
    the whole sequence is one shingle); a component is named by its smallest key.  Documents without words, null texts
    included, have no shingles, link with nothing and are their own component.  Keys are whole numbers; a null key takes
    part in no link and has a null component; rows that repeat a key count as one document with several texts (they
    share its component).  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    feats = stored(feature_rows(texts, k), "ngram-features")
    live = feats.where("set_key IS NOT NULL AND doc IS NOT NULL")
    # equal sets first: one representative each
    sets = stored(live.groupBy("set_key").agg(F.min("doc").alias("rep")), "ngram-sets")
    twins = live.join(sets, "set_key").where("doc != rep").select("doc", "rep")
    # a key with several sets keeps its texts: only one of them may be the twin's
    several = live.groupBy("doc").agg(F.min(F.xxhash64("set_key")).alias("a"), F.max(F.xxhash64("set_key")).alias("b")).where("a != b").select("doc")
    spare = twins.select("doc").join(several, "doc", "left_anti")
    keyed = stored(key_rows(drop_rows(texts.where("doc IS NOT NULL"), spare, ["doc"]), k, percent), "ngram-keys")
    comp = None

    def connect(pairs: DataFrame) -> None:
        """Verify what the bound leaves of ``pairs`` and let links join components."""
        near = stored(within_bound(pairs, live, percent), "ngram-pairs")
        joined(stored(verified(near, texts, k, percent), "ngram-links"))
        remove(near)

    def joined(links: DataFrame) -> None:
        """Let links, a stored table, join components."""
        nonlocal comp
        if links.head(1):
            before = comp
            so_far = links if comp is None else links.unionByName(comp.select(F.col("node").alias("u"), F.col("component").alias("v")))
            comp = components(so_far)
            if before is not None:
                remove(before)
        remove(links)

    def rows_of(part: tuple[str, ...]) -> DataFrame:
        """(key, doc, comp) of the keys of a part of the key space."""
        mine = placed(keyed.withColumn("keys", F.expr(f"filter(keys, x -> pmod(x, 8) IN ({', '.join(part)}))")), comp)
        return mine.select(F.explode("keys").alias("key"), "doc", "comp")

    for part in PARTS:
        candidates = stored(shards(rows_of(part)).groupBy("doc", "pivot").agg(F.count("*").alias("c")), "ngram-pairs")
        connect(candidates.groupBy(F.col("doc").alias("u")).agg(F.max_by("pivot", F.struct("c", -F.col("pivot"))).alias("v")))
        ends = placed(placed(candidates, comp).withColumnRenamed("comp", "_c").select(F.col("doc").alias("u"), F.col("pivot").alias("doc"), "_c"), comp)
        connect(ends.where("_c != comp").select("u", F.col("doc").alias("v")))
        remove(candidates)

    # shards that still hold several components, by families of documents that they tie together
    room = SHINGLE_BYTES * (feats.agg(F.sum("n")).first()[0] or 0)
    sizes = live.groupBy("doc").agg(F.sum("n").alias("n"))
    for part in PARTS:
        stars = stored(open_stars(rows_of(part)), "ngram-stars")
        if not stars.head(1):
            remove(stars)
            continue
        tied = components(stars.select(F.col("doc").alias("u"), "v"))
        family = placed(placed(stars.select("doc").distinct(), tied).withColumnRenamed("comp", "key"), comp)
        family = stored(family.join(sizes, "doc").select("key", "doc", "comp", "n"), "ngram-families")
        remove(tied)
        remove(stars)
        giant = family.groupBy("key").agg(F.sum(weight(family)).alias("w")).where(F.col("w") > FAMILY * SHARD).select("key")
        tiles = stored(dealt(family.join(giant, "key", "left_anti"), SHARD), "ngram-tiles")
        rounds = max(1, -(-SET_BYTES * (tiles.agg(F.sum("n")).first()[0] or 0) // max(room, 1)))
        links = [stored(unresolved_pairs(tiles.where(f"pmod(xxhash64(key, a, b), {rounds}) = {i}"), texts, k, percent), "ngram-links") for i in range(rounds)]
        if giant.head(1):
            mine = family.join(giant, "key", "left_semi").select("doc")
            rows = rows_of(part).join(mine, "doc", "left_semi")
            open_keys = stored(shards(rows).select("key").distinct(), "ngram-shards")
            members = stored(rows.join(open_keys, "key", "left_semi"), "ngram-members")
            remove(open_keys)
            turns = -(-MEMBER_BYTES * members.count() // max(room, 1))
            trees = [stored(point_pairs(members.where(f"pmod(shiftright(key, 3), {turns}) = {i}"), feats, percent, SHARD), "ngram-tree") for i in range(turns)]
            remove(members)
            if trees:
                connect(reduce(DataFrame.union, trees).distinct())
            for x in trees:
                remove(x)
        joined(reduce(DataFrame.union, links))
        remove(tiles)
        remove(family)
    final = comp if comp is not None else spark.createDataFrame([], "node long, component long")
    if live.groupBy("doc").count().where("count > 1").head(1):  # keys that stand for several texts tie their sets together
        same = twins.select(F.col("doc").alias("u"), F.col("rep").alias("v"))
        final = components(final.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(same))
    rep_of = feats.join(sets, "set_key", "left").select("doc", "n", F.coalesce("rep", "doc").alias("rep"))
    out = rep_of.join(final, F.col("rep") == F.col("node"), "left")
    return out.select(F.col("doc").cast(docs.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").cast(docs.schema[key].dataType).alias("component_id"))
