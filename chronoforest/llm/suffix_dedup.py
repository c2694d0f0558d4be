"""Repeated passages by sparse suffix arrays.

Of all word suffixes only those at minimisers are kept: a position whose hashed
``gram``-word gram is least in some window of ``min_words - gram - 2`` grams, so
every passage of ``min_words`` words has one, at the same place in each copy.

1. Grams at minimisers that occur once are dropped.
2. The others get their context in hashed words, ``min_words`` to the right and
   as far as a minimiser can lie from a passage's start to the left.  Equal
   contexts collapse to one row with its range of documents.
3. Suffixes of a gram are sorted by their right context and come to one task.
   A window of ``min_words`` words around the anchor is the hash of its right
   and of its left words, for each number of left words; windows that different
   documents hold are found by sorting those hashes, so no count of neighbours
   decides.  The windows of one suffix all hold its anchor: their union is one
   span.  A gram with more than ``group_rows`` suffixes writes its windows to a
   table instead, and an aggregation over all tasks finds the shared ones; a
   window more to the right than the sorted neighbours agree is left out there.
4. Overlapping spans of a document merge.

Tasks stream over sorted rows and hold at most ``group_rows`` and a batch of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textcore import mix, slices, stored, tasks_for, words_of


def sliding(h: np.ndarray, w: int, fold) -> np.ndarray:
    """fold over ``h[i:i+w]`` for each i that has a whole window, by doubling."""
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = fold(out[: len(out) - step], out[step:])
        have += step
    return out


def minimisers(h: np.ndarray, first: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(word positions, gram hashes) of the minimisers of all rows; ``first``: first word of each row and the end."""
    n = len(h) - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        g = np.zeros(n, np.uint64)
        for i in range(gram):
            g = mix(g + h[i : i + n] * np.uint64(2 * i + 1))
    least = sliding(g, window, np.minimum)
    end = np.repeat(first[1:], np.diff(first))[: len(least)]
    least = np.where(np.arange(len(least)) + window + gram - 1 <= end, least, np.uint64(0))
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    at = np.flatnonzero(sliding(padded, window, np.maximum)[:n] == g)
    # where one word repeats, every position ties: of a run of equal grams the first and the last stay.  A passage that begins
    # or ends the run inside itself has that one; one that is that word only lies in two runs of min_words or more, whose
    # first positions both have it to their right, and then the whole run is shared (see repeated_passages).
    step = np.ones(len(at) + 1, bool)
    step[1:-1] = (at[1:] != at[:-1] + 1) | (g[at[1:]] != g[at[:-1]])
    at = at[step[:-1] | step[1:]]
    return at, g[at]


def anchor_rows(texts: DataFrame, gram: int, window: int) -> DataFrame:
    """(gram, rid, pos) of every minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                w = words_of(part)
                at, g = minimisers(w.hash, w.first, gram, window)
                row = np.searchsorted(w.first, at, side="right") - 1
                rid = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(rid[row]), pa.array((at - w.first[row]).astype(np.int32))], names=["gram", "rid", "pos"])

    return texts.mapInArrow(run, "gram long, rid long, pos int")


def context_rows(marked: DataFrame, gram: int, left: int, right: int) -> DataFrame:
    """(rid, pos, ctx, before, after, run): marked has (rid, text, at array<int>).  ``ctx`` is the right context in 32-bit
    word hashes, big-endian so that bytes sort as numbers, then the left one, nearest word first; zeros past the ends.
    ``run``: how often the word at ``pos`` follows in a row, itself included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                w = words_of(part)
                lists = part.column(2)
                lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
                size = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(part.num_rows), size)
                pos = lists.flatten().to_numpy().astype(np.int64)
                short = ((w.hash >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)
                changes = np.unique(np.concatenate([np.flatnonzero(w.hash[1:] != w.hash[:-1]) + 1, w.first]))
                for i in range(0, len(pos), 20_000):
                    r, p = row[i : i + 20_000], pos[i : i + 20_000]
                    lo, hi, at = w.first[r], w.first[r + 1], w.first[r] + p
                    steps = at[:, None] + np.concatenate([np.arange(right), -1 - np.arange(left)])
                    ok = (steps >= lo[:, None]) & (steps < hi[:, None])
                    ctx = np.where(ok, short[np.clip(steps, 0, len(short) - 1)], 0).astype(">u4")
                    # the gram's own hash from its first words keeps equal grams together without a second column
                    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * (left + right)), len(p), [None, pa.py_buffer(ctx.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[r]), pa.array(p.astype(np.int32)), flat, pa.array(np.minimum(p, left).astype(np.int32)), pa.array(np.minimum(hi - at, right).astype(np.int32)), pa.array((changes[np.searchsorted(changes, at, side="right")] - at).astype(np.int32))], names=["rid", "pos", "ctx", "before", "after", "run"])

    return marked.mapInArrow(run, "rid long, pos int, ctx binary, before int, after int, run int")


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix, row by row."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


SPANS = "ctx_id long, l int, r int, a long, b long, lo long, hi long"
_SPANS = pa.schema([("ctx_id", pa.int64()), ("l", pa.int32()), ("r", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def prefixes(x: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first 0, 1, 2 .. words of each row."""
    out = [np.zeros(len(x), np.uint64)]
    with np.errstate(over="ignore"):
        for i in range(x.shape[1]):
            out.append(mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) + x[:, i].astype(np.uint64) + np.uint64(i + 1)))
    return out


def shared_here(cols: list[np.ndarray], left: int, right: int, min_words: int) -> pa.RecordBatch:
    """Spans of contexts whose grams are whole in ``cols``: each window is compared with all of them."""
    x, ids, before, after, lo, hi = cols
    a, b = prefixes(x[:, :right]), prefixes(x[:, right:])
    least, most = np.full(len(ids), left + 1), np.full(len(ids), -1)
    for o in range(left + 1):
        i = np.flatnonzero((before >= o) & (after >= min_words - o))
        if not len(i):
            continue
        with np.errstate(over="ignore"):
            k = mix(a[min_words - o][i] + mix(b[o][i]))
        order = np.argsort(k)
        k, i = k[order], i[order]
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        several = np.minimum.reduceat(lo[i], start) != np.maximum.reduceat(hi[i], start)
        i = i[np.repeat(several, np.diff(np.append(start, len(i))))]
        least[i] = np.minimum(least[i], o)
        most[i] = o
    i = np.flatnonzero(most >= 0)
    none = pa.nulls(len(i), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(most[i].astype(np.int32)), pa.array((min_words - least[i]).astype(np.int32)), none, none, none, none], schema=_SPANS)


def windows_of(cols: list[np.ndarray], reach: np.ndarray, left: int, right: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """Windows of contexts of a large gram, for the aggregation over all tasks; ``reach``: right words that a sorted neighbour
    shares.  A context that several documents have is a span by itself, and still a partner of others."""
    x, ids, before, after, lo, hi = cols
    i = np.flatnonzero((lo != hi) & (before + after >= min_words))
    none = pa.nulls(len(i), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(before[i]), pa.array(after[i]), none, none, none, none], schema=_SPANS)
    a, b = prefixes(x[:, :right]), prefixes(x[:, right:])
    for o in range(left + 1):
        i = np.flatnonzero((before >= o) & (np.minimum(after, reach) >= min_words - o))
        size = np.full(len(i), o, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[i], size, np.int32(min_words) - size, a[min_words - o][i].view(np.int64), b[o][i].view(np.int64), lo[i], hi[i])], schema=_SPANS)


def matched(contexts: DataFrame, gram: int, left: int, right: int, min_words: int, group_rows: int) -> DataFrame:
    """(ctx_id, l, r): words before and from the anchor that a context shares with other documents.

    contexts: (ctx, ctx_id, before, after, lo, hi), ``lo`` and ``hi`` the least and largest document of the context.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = left + right
        cols, last = None, None  # rows not yet dealt with; where their first gram began earlier, its row before them

        def large(part, after_it):
            x = part[0]
            ends = np.concatenate([x[:1] if last is None else last, x, x[-1:] if after_it is None else after_it])
            reach = common(ends[1:, :right], ends[:-1, :right])
            if last is None:
                reach[0] = 0
            if after_it is None:
                reach[-1] = 0
            return windows_of(part, np.maximum(reach[1:], reach[:-1]), left, right, min_words)

        def whole(part):
            """Rows whose last gram has no further row."""
            nonlocal last
            if last is not None:
                border = np.flatnonzero((part[0][1:, :gram] != part[0][:-1, :gram]).any(1))
                n = border[0] + 1 if len(border) else len(part[1])
                yield from large([c[:n] for c in part], None)
                part, last = [c[n:] for c in part], None
            if len(part[1]):
                yield shared_here(part, left, right, min_words)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = [np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32).reshape(n, width), *(batch.column(i).to_numpy() for i in range(1, 6))]
            cols = new if cols is None else [np.concatenate(c) for c in zip(cols, new, strict=True)]
            border = np.flatnonzero((cols[0][1:, :gram] != cols[0][:-1, :gram]).any(1))
            if len(border):
                yield from whole([c[: border[-1] + 1] for c in cols])
                cols = [c[border[-1] + 1 :] for c in cols]
            if len(cols[1]) > group_rows:
                yield from large([c[:-1] for c in cols], cols[0][-1:])
                last, cols = cols[0][-2:-1], [c[-1:] for c in cols]
        if cols is not None:
            yield from whole(cols)

    rows = contexts.select("ctx", "ctx_id", "before", "after", "lo", "hi")
    ordered = rows.repartition(tasks_for(contexts), F.substring("ctx", 1, 4 * gram)).sortWithinPartitions("ctx")
    found = stored(ordered.mapInArrow(run, SPANS), "suffix-spans")
    windows = found.where("a is not null")
    shared = windows.groupBy("a", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi").select("a", "b")
    spans = found.where("a is null").select("ctx_id", "l", "r").unionByName(windows.join(shared, ["a", "b"], "left_semi").select("ctx_id", "l", "r"))
    return spans.groupBy("ctx_id").agg(F.max("l").alias("l"), F.max("r").alias("r"))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50, gram: int = 8, group_rows: int = 20_000) -> DataFrame:
    """(key, start_word, end_word): word spans (end exclusive) of passages of at least ``min_words`` words that another row
    also has.

    Words compare after A-Z are lower-cased, as 32-bit hashes over at least ``min_words`` words.  Spans of a row don't
    overlap.  A passage that repeats inside one row only is no span; rows that repeat (same key and text) count as one.
    Null and empty texts have no spans; a null key is kept as null; an empty table gives no rows; other columns are
    ignored.  A gram with more than ``group_rows`` different contexts is compared through a table (see above).
    """
    if min_words < gram + 3:
        raise ValueError("min_words must be at least gram + 3")
    window = min_words - gram - 2
    left, right = window + 1, min_words
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("rid", F.xxhash64("_key", "text"))
    texts = rows.select("rid", "text")
    anchors = stored(anchor_rows(texts, gram, window), "suffix-anchors")
    counted = anchors.groupBy("gram").agg(F.min("rid").alias("a"), F.max("rid").alias("b")).where("a != b").select("gram")
    places = stored(anchors.join(counted, "gram", "left_semi").groupBy("rid").agg(F.array_sort(F.collect_set("pos")).alias("at")), "suffix-places")
    marked = texts.join(places, "rid").select("rid", "text", "at")
    found = context_rows(marked, gram, left, right).withColumn("ctx_id", F.xxhash64("ctx", "before", "after"))
    found = stored(found, "suffix-contexts")
    contexts = found.groupBy("ctx", "ctx_id", "before", "after").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"))
    spans = matched(contexts, gram, left, right, min_words, max(group_rows, 1))
    hits = found.select("rid", "pos", "run", "ctx_id").join(spans, "ctx_id")
    # a span of min_words to the right of the anchor that is one word, again and again, is the whole run's every window
    r = F.when(F.col("r") >= min_words, F.greatest("r", "run")).otherwise(F.col("r"))
    flat = hits.select("rid", (F.col("pos") - F.col("l")).alias("s"), (F.col("pos") + r).alias("e")).distinct()
    w = W.partitionBy("rid").orderBy("s", "e")
    ends = flat.withColumn("_far", F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1)))
    runs = ends.withColumn("_run", F.sum((F.col("_far").isNull() | (F.col("s") > F.col("_far"))).cast("int")).over(w))
    merged = runs.groupBy("rid", "_run").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"))
    keys = rows.select("_key", "rid").distinct()
    return keys.join(merged, "rid").select(F.col("_key").alias(key), "start_word", "end_word")
