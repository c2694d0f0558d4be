"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (what line feeds separate; empty ones count).  A paragraph is hashed to a wide
vector of 32-bit lanes, and a fingerprint is the sum of its paragraphs' vectors modulo 2**32, lane by lane.  So it doesn't
depend on their order, and inserting or deleting a paragraph adds or subtracts that paragraph's vector.

The first EXACT lanes are SHAKE-128 of the paragraph's bytes: texts with other paragraphs differ in them.  The NEAR lanes
behind them are a signed count sketch of the paragraph's shingles of three words (A-Z lower-cased; a paragraph of one or
two words is one shingle).  These add up too, so that two fingerprints tell how much their texts share:
2 x.y / (x.x + y.y) of the sketches, which is 1 for equal texts and about the shared part otherwise, give or take
1 / sqrt(NEAR).
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import SLICE_BYTES, Words, column_bytes, mix, row_slices, tasks_for

EXACT = 32
NEAR = 512
LANES = EXACT + NEAR
SHINGLE = 3

#: Keys looked at for each range of documents when ranges are cut.
SAMPLE = 64

ROWS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def vectors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    """(n_groups x LANES) sums, modulo 2**32, of the vectors of the paragraphs ``raw[starts[i]:ends[i]]`` by ``group``,
    which doesn't fall.  Paragraphs follow each other and hold no line feed."""
    out = np.zeros((n_groups, LANES), np.uint32)
    if not len(starts):
        return out
    view = memoryview(np.ascontiguousarray(raw))
    lanes = b"".join([hashlib.shake_128(view[a:b]).digest(4 * EXACT) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    first = np.flatnonzero(np.concatenate([[True], np.diff(group) > 0]))
    out[group[first], :EXACT] = np.add.reduceat(np.frombuffer(lanes, "<u4").reshape(-1, EXACT), first, axis=0, dtype=np.uint32)
    # what lies between two paragraphs (a line feed, or what isn't asked for) counts to the one before and is cut off below
    words = Words(raw[starts[0] : ends[-1]], np.concatenate([starts, ends[-1:]]) - starts[0])
    if not len(words.hash):
        return out
    owner = words.doc
    left = np.repeat(words.first[1:], words.count) - np.arange(len(words.hash))  # words to the paragraph's end, this one included
    whole = np.zeros(len(words.hash), bool)
    whole[words.first[:-1][(words.count > 0) & (words.count < SHINGLE)]] = True
    h = words.hash.copy()
    with np.errstate(over="ignore"):
        for i in range(1, SHINGLE):
            more = left > i
            more[-i:] = False
            at = np.flatnonzero(more)
            h[at] = mix(h[at] + words.hash[at + i] * np.uint64(2 * i + 0x2545F491))
    chosen = (left >= SHINGLE) | whole
    h = mix(h[chosen])
    cell = group[owner[chosen]] * NEAR + (h >> np.uint64(33)).astype(np.int64) % NEAR
    sketch = np.bincount(cell, np.where(h & np.uint64(1), 1.0, -1.0), n_groups * NEAR)
    out[:, EXACT:] = sketch.astype(np.int64).astype(np.uint32).reshape(n_groups, NEAR)
    return out


def paragraphs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text) of the paragraphs of texts that lie one behind the other."""
    feeds = np.flatnonzero(raw == 10)
    owner = np.searchsorted(offsets, feeds, side="right") - 1
    starts = np.concatenate([offsets[:-1], feeds + 1])
    ends = np.concatenate([feeds, offsets[1:]])
    text = np.arange(len(offsets) - 1)
    of = np.concatenate([text, owner])
    order = np.lexsort((starts, of))
    until = np.lexsort((ends, np.concatenate([owner, text])))
    return starts[order], ends[until], of[order]


def text_vector(text: str) -> np.ndarray:
    """The fingerprint of one text as lanes; of a paragraph, where it holds no line feed."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, of = paragraphs(raw, np.array([0, len(raw)]))
    return vectors(raw, starts, ends, of, 1)[0]


def encoded(v: np.ndarray) -> str:
    return base64.b64encode(v.astype("<u4").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1, row by row; 1 where fingerprints are equal, texts without words among them."""
    same = (a == b).all(axis=1)
    x, y = a[:, EXACT:].astype(np.int32).astype(np.float64), b[:, EXACT:].astype(np.int32).astype(np.float64)
    size = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    part = 2 * (x * y).sum(axis=1) / np.where(size > 0, size, 1)
    # 1 only where they are equal
    return np.where(same, 1.0, np.clip(part, 0.0, np.nextafter(1.0, 0.0)))


def _edited(raw: np.ndarray, offsets: np.ndarray) -> tuple[list, ...]:
    """Of each text but the last, with the text behind it: code points, the edited text's digest and both fingerprints."""
    n = len(offsets) - 1
    points = np.flatnonzero((raw & 0xC0) != 0x80)
    first = np.searchsorted(points, offsets)
    chars = np.diff(first)
    at = np.concatenate([points, [len(raw)]])
    cut = np.where(chars > 0, at[np.minimum(first[:-1] + chars - chars // 2, first[1:])], offsets[:-1])
    cut = np.minimum(cut, offsets[1:])
    taken = np.minimum(chars[:-1] // 2, chars[1:])
    until = np.minimum(at[np.minimum(first[1:-1] + taken, len(points))], offsets[2:])
    until = np.where(taken > 0, until, offsets[1:-1])
    starts, ends, of = paragraphs(raw, offsets)
    # paragraphs that end before the cut stay; the others make way for those of the seam and of the next text's start
    gone = ends >= cut[of]
    v = vectors(raw, starts, ends, of * 2 + gone, 2 * n)
    own = v[0::2] + v[1::2]
    seam = np.full(n, len(raw), np.int64)
    np.minimum.at(seam, of[gone], starts[gone])
    view, pieces, digests = memoryview(np.ascontiguousarray(raw)), [], []
    for i in range(n - 1):
        new = view[offsets[i + 1] : until[i]]
        h = hashlib.sha256(view[offsets[i] : cut[i]])
        h.update(new)
        digests.append(h.hexdigest())
        pieces.append(bytes(view[seam[i] : cut[i]]) + bytes(new))
    tails = np.frombuffer(b"".join(pieces), np.uint8)
    ends_at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    t_starts, t_ends, t_of = paragraphs(tails, ends_at)
    edited = own[:-1] - v[1:-1:2] + vectors(tails, t_starts, t_ends, t_of, n - 1)
    return chars, digests, own, edited


def _pairs(names: pa.Schema, key: str, limit: int):
    """For mapInArrow over rows in order: each row that isn't a guest with the one behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            for part in row_slices(batch, "_text", limit=limit):
                table = pa.Table.from_batches([part] if waiting is None else [waiting, part]).combine_chunks()
                rows = table.to_batches()[0]
                waiting = rows.slice(rows.num_rows - 1)
                # a copy of its own, so that the slice before it can go
                waiting = pa.RecordBatch.from_arrays([pa.concat_arrays([c, c.slice(0, 0)]) for c in waiting.columns], schema=rows.schema)
                if rows.num_rows < 2:
                    continue
                chars, digests, own, edited = _edited(*column_bytes(rows.column("_text")))
                keep = ~np.array(rows.column("_guest").to_pylist()[:-1], bool)
                pick = np.flatnonzero(keep)
                if not len(pick):
                    continue
                near, far = likeness(own[:-1], edited), likeness(own[:-1], own[1:])
                columns = [
                    rows.column(key).take(pa.array(pick)),
                    pa.array(chars[:-1][pick], pa.int64()),
                    pa.array([digests[i] for i in pick]),
                    pa.array([encoded(own[i]) for i in pick]),
                    pa.array([encoded(edited[i]) for i in pick]),
                    pa.array(near[pick]),
                    pa.array(far[pick]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _cuts(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Keys (_k, _h) of rows that begin ranges of about equal bytes, the first row's among them; at most ``parts``.

    Of keys chosen by hash about SAMPLE for each range are looked at.
    """
    size = rows.agg(F.count("*").alias("n"), F.min("_k").alias("least")).first()
    every = max(1, size["n"] // (parts * SAMPLE))
    chosen = (F.pmod(F.xxhash64("_k", "_h"), F.lit(every)) == 0) | (F.col("_k") == F.lit(size["least"]))
    sample = rows.where(chosen).groupBy("_k", "_h").agg(F.sum(F.octet_length("_text") + 64).alias("b"))
    seen = sorted((r["_k"], r["_h"], r["b"]) for r in sample.collect())
    total, so_far, out = sum(b for _, _, b in seen), 0, []
    for k, h, b in seen:
        if len(out) <= so_far * parts // max(total, 1) and (not out or out[-1] != (k, h)):
            out.append((k, h))
        so_far += b
    return out[:parts]


def _range_of(cuts: list[tuple[int, int]], k, h):
    """The number of the last cut that isn't behind (k, h), by binary search."""
    ks, hs = F.lit([c[0] for c in cuts]).cast("array<long>"), F.lit([c[1] for c in cuts]).cast("array<long>")

    def step(a, _):
        m = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        below = (F.get(ks, m) < k) | ((F.get(ks, m) == k) & (F.get(hs, m) <= h))
        on = a["lo"] < a["hi"]
        return F.struct(F.when(on & below, m + 1).otherwise(a["lo"]).alias("lo"), F.when(on & ~below, m).otherwise(a["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(len(cuts) + 1)) + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), step, lambda a: a["lo"] - 1), ks, hs


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per input row.

    The edited text is the row's own with its last half (rounded down, in code points) replaced by as many of the first of
    the next row's text, or all of them; the next row is that of the next lower key, after the last the first.  Its
    fingerprint is made from the row's own, less the paragraphs from the seam on, plus those that come there.

    The key is an integer.  Null keys come last; rows that repeat a key follow each other by a hash of their texts.  A null
    text counts as empty: no code points, one empty paragraph.  A row alone is its own next.  An empty table gives no
    rows; further columns are not read.

    Rows go to ranges of the order, cut at rows of a bounded sample; a row that begins a range is sent to the range before
    it as well, as a guest.  So each pair of neighbours meets in one task, which streams its rows in slices.
    """
    parts = tasks_for(docs)
    k = F.coalesce(F.bitwise_not(F.col(key).cast("long")), F.lit((1 << 63) - 1))
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_k", k).withColumn("_h", F.xxhash64("_text"))
    cuts = _cuts(rows, parts)
    names = [key, *(c.split()[0] for c in ROWS.split(", "))]
    kind = docs.schema[key].dataType.simpleString()
    if not cuts:
        return docs.sparkSession.createDataFrame([], f"`{key}` {kind}, {ROWS}")
    at, ks, hs = _range_of(cuts, F.col("_k"), F.col("_h"))
    dealt = rows.withColumn("_at", at.cast("int"))
    begins = (F.get(ks, F.col("_at")) == F.col("_k")) & (F.get(hs, F.col("_at")) == F.col("_h"))
    own = F.struct(F.col("_at").alias("_range"), F.lit(False).alias("_guest"))
    guest = F.struct(F.pmod(F.col("_at") - 1, F.lit(len(cuts))).cast("int").alias("_range"), F.lit(True).alias("_guest"))
    dealt = dealt.select(key, "_text", "_k", "_h", F.explode(F.when(begins, F.array(own, guest)).otherwise(F.array(own))).alias("_to"))
    dealt = dealt.select(key, "_text", "_k", "_h", "_to._range", "_to._guest").repartitionById(len(cuts), F.col("_range"))
    ordered = dealt.sortWithinPartitions("_range", "_guest", "_k", "_h").select(key, "_text", "_guest")
    return ordered.mapInArrow(_pairs(names, key, limit), f"`{key}` {kind}, {ROWS}")


def _added(key: str):
    """For mapInArrow: rows (key, fingerprint) of equal keys that follow each other become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            out = []
            for name, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if total is not None and name == now:
                    total = total + decoded(f)
                else:
                    if total is not None:
                        out.append((now, encoded(total)))
                    now, total = name, decoded(f)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], batch.column(0).type), pa.array([f for _, f in out])], names=[key, "fingerprint"])
            kind = batch.column(0).type
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([encoded(total)])], names=[key, "fingerprint"])

    return run


def updated(prints: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint) after ``changes`` (key, paragraph, inserted: boolean); ``prints``: (key, fingerprint).

    A null paragraph is an empty one; a key that has no fingerprint yet begins with none.  A key's changes are summed
    where they lie before they are sent, and then streamed in order, whatever their number.
    """
    kind = prints.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, fingerprint string"

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict = {}
            for name, paragraph, inserted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = text_vector(paragraph or "")
                sums[name] = sums.get(name, np.zeros(LANES, np.uint32)) + (v if inserted else -v)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), batch.column(0).type), pa.array([encoded(v) for v in sums.values()], pa.string())], names=[key, "fingerprint"])

    deltas = changes.select(F.col(key).cast(kind).alias(key), "paragraph", "inserted").mapInArrow(vectors_of, schema)
    both = prints.select(key, "fingerprint").unionByName(deltas).repartition(key).sortWithinPartitions(key)
    return both.mapInArrow(_added(key), schema)
