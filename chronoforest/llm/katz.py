"""Katz backoff language model over words, trained and applied by exchange of compact request tables.

Documents are dealt into blocks of about ``block_bytes`` of text, and n-grams
by their hash into buckets, of about ``bucket_bytes`` of text each.  A block
asks for what it needs and nothing else is moved:

1. Every block sends its distinct words (64-bit hashes, training counts).  A
   bucket sums counts over all blocks and answers each block with counts and
   dense word ids (frequent words first).
2. For each order from 2 on every block sends its distinct n-grams, with their
   training counts and the probability of the last word at the order below, and
   its distinct histories.  A bucket of n-grams sums counts, answers, and sends
   to the buckets of histories what its n-grams add to these: their count, the
   number of followers seen 1 .. 5 times and the followers' mass at the order
   below.  So a frequent history's followers are spread over all buckets.  A
   bucket of histories sums that and answers.
3. Every block scores its documents.

The answers are tables in the shared folder, a row for each block and bucket.

P(w | h) = d(c(hw)) c(hw) / c(h) for a seen bigram, else alpha(h) P(w); the
recursion ends at P(w) = d(c(w)) c(w) / N, and one unknown-word type has the
mass freed there.  d is Good-Turing for counts up to 5 by Katz's formula.  From
the first count on whose d would lie outside (0, 1), it is the same formula on
smoothed counts of counts (Simple Good-Turing: a line through log n_r over
log r).  Only where that line doesn't fall faster than 1 / r, as where no count
repeats, is it (r - D) / r with D = n1 / (n1 + 2 n2).  The forms used are
logged.  alpha(h) = (1 - seen mass) / (1 - unigram mass of the
seen followers), so that each history's distribution sums to 1; a history
without freed mass gives up 1 / (c(h) + 1) of its mass.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import Words, column_bytes, mix, pack, remainder, segment_sums, slices, stored, trim, unpack

log = logging.getLogger(__name__)
K = 5
END = np.uint64(0x5DEECE66D1234567)
BOS, UNKNOWN = np.uint32(0), np.uint32(0xFFFFFFFF)
ROWS = "kind string, bucket int, block int, data binary, sums array<long>"
_ROWS = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("block", pa.int32()), ("data", pa.binary()), ("sums", pa.list_(pa.int64()))])


def slope(n: list[int]) -> float:
    """Slope of log n_r over log r, each n_r averaged over the gaps around it; 0 without two points."""
    seen = [r for r in range(1, K + 2) if n[r] > 0]
    if len(seen) < 2:
        return 0.0
    before, after = [0, *seen[:-1]], [*seen[1:], 2 * seen[-1] - seen[-2]]
    z = [2 * n[r] / (t - q) for q, r, t in zip(before, seen, after, strict=True)]
    return float(np.polyfit(np.log(seen), np.log(z), 1)[0])


def good_turing(n: list[int]) -> tuple[np.ndarray, str]:
    """(d[0..K] for counts 0 .. K, d[0] unused; the form used) from counts of counts n[1..K+1]."""
    d = np.ones(K + 1)
    top = (K + 1) * n[K + 1] / n[1] if n[1] else 0.0
    first = K + 1  # the least count that Katz's formula on n itself can't discount
    for r in range(1, K + 1):
        d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and n[r + 1] and 0 < top < 1 else -1
        if not 0 < d[r] < 1:
            first = r
            break
    if first > K:
        return d, "Good-Turing"
    b = slope(n)
    if b < -1:
        top = (K + 1) ** (b + 1)
        d[first:] = [((1 + 1 / r) ** (b + 1) - top) / (1 - top) for r in range(first, K + 1)]
        if ((d[1:] > 0) & (d[1:] < 1)).all():
            return d, f"Good-Turing, smoothed from {first} on (slope {b:.3f})"
    cut = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    d[1:] = [(r - cut) / r for r in range(1, K + 1)]
    return d, "absolute"


def discounts(n: list[int]) -> np.ndarray:
    """d of good_turing()."""
    return good_turing(n)[0]


class Unigrams:
    """N, V, counts of counts, and P(word of count c); c = 0 is the unknown-word type."""

    def __init__(self, total: int, types: int, n: list[int]):
        self.total, self.types, self.n, self.d = total, types, n, discounts(n)
        freed = sum(n[r] * r * (1 - self.d[r]) for r in range(1, K + 1)) / total if total else 1.0
        self.shrink = 1.0 if freed > 0 else total / (total + 1)
        self.unknown = freed if freed > 0 else 1 / (total + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(c))
        c = c.astype(np.int64)
        return np.where(c > 0, c * self.d[np.where(c <= K, c, 0)] * np.where(c <= K, 1, 1 / self.d[0]) / self.total * self.shrink, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.types + 1)))


def block_words(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes with an end after each document, tokens a document, training flag a token) of a block."""
    parts, sizes = [], []
    for batch in texts.combine_chunks().to_batches():
        for part in slices(batch):
            w = Words(*column_bytes(part.column(part.schema.get_field_index("text"))))
            parts.append(np.insert(w.hash, w.first[1:], END))
            sizes.append(w.count + 1)
    n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return h, n, np.repeat(~np.array(texts.column("held_out").to_pylist(), bool), n)


def rows(out: list[tuple]) -> pa.Table:
    """Rows of (kind, bucket, block, data) or (kind, bucket, block, None, sums).  A worker gives back what it has freed."""
    out = [(*r, None)[:5] for r in out]
    trim()
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ROWS, strict=True)], schema=_ROWS) if out else _ROWS.empty_table()


def by_bucket(key: np.ndarray, buckets: int):
    """(bucket, positions) of the buckets that ``key`` (uint64) falls into; positions keep their order."""
    b = (mix(key) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    ends = np.cumsum(np.bincount(b, minlength=buckets))
    for k in np.unique(b):
        yield int(k), order[ends[k - 1] if k else 0 : ends[k]]


def u32(a: np.ndarray) -> np.ndarray:
    return np.minimum(a, 0xFFFFFFFF).astype(np.uint32)


def ask_words(buckets: int):
    def run(texts: pa.Table) -> pa.Table:
        block = texts.column("block")[0].as_py()
        h, _, train = block_words(texts)
        words, inverse = np.unique(h, return_inverse=True)
        counts = np.bincount(inverse, weights=train, minlength=len(words))
        return rows([("words", b, block, pack(words[at], u32(counts[at]))) for b, at in by_bucket(words, buckets)])

    return run


def merged(tables: list[list[np.ndarray]], key: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, place of each key of each table, borders of the tables)"""
    keys, inverse = np.unique(np.concatenate([t[key] for t in tables]), return_inverse=True)
    return keys, inverse, np.cumsum([0, *(len(t[key]) for t in tables)])


def answer_words(buckets: int):
    def run(asked: pa.Table) -> pa.Table:
        bucket = asked.column("bucket")[0].as_py()
        tables = [unpack(x) for x in asked.column("data").to_pylist()]
        words, inverse, border = merged(tables)
        counts = np.bincount(inverse, weights=np.concatenate([t[1] for t in tables]), minlength=len(words)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, -counts))] = np.arange(len(words))
        ids = 1 + rank * buckets + bucket
        if len(ids) and ids.max() >= int(UNKNOWN):
            raise ValueError("more words than 32-bit ids; raise the word type")
        ids = np.where(counts > 0, ids, int(UNKNOWN)).astype(np.uint32)
        out = [("words", bucket, b, pack(ids[at], counts[at].astype(np.uint64))) for b, at in zip(asked.column("block").to_pylist(), (inverse[i:j] for i, j in zip(border, border[1:], strict=False)), strict=True)]
        return rows([*out, ("stats", bucket, -1, None, sums_of(counts))])

    return run


def sums_of(counts: np.ndarray) -> list[int]:
    """[tokens, types, types seen 1 .. K + 1 times] of a bucket's counts."""
    n = np.bincount(np.minimum(counts, K + 2), minlength=K + 3)
    return [int(x) for x in (counts.sum(), (counts > 0).sum(), *n[1 : K + 2])]


def high(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(32)


def coded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys as the steps of their upper halves and their lower halves."""
    h = high(keys).astype(np.uint32)
    return np.diff(h, prepend=np.uint32(0)), keys.astype(np.uint32)


def decoded(step: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (np.cumsum(step, dtype=np.uint32).astype(np.uint64) << np.uint64(32)) | low


def extended(history: np.ndarray, word: np.ndarray, order: int) -> np.ndarray:
    """Keys of n-grams of ``order`` from their history's keys and last words; of bigrams these two themselves."""
    if order == 2:
        return (history << np.uint64(32)) | word.astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix(history * np.uint64(0xD1B54A32D192ED03) + word.astype(np.uint64) + np.uint64(order))


def histories(keys: np.ndarray, n: np.ndarray, order: int) -> np.ndarray:
    """Keys of the order - 1 words before each token; ``keys``: of the n-grams of order - 1 that end at each token.  Before a
    document there are BOS words only."""
    start = np.array([BOS], np.uint64)
    for m in range(2, order):
        start = extended(start, np.array([BOS], np.uint64), m)
    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    before[np.cumsum(n) - n] = start[0]
    return before


class Block:
    """A block's tokens, and by token: id, training flag, count, probability at the highest known order, and the n-gram's key
    if that order is below ``highest``."""

    def __init__(self, texts: pa.Table, answers: pa.Table, word_buckets: int, buckets: int, uni: Unigrams, ds: list[np.ndarray], highest: int):
        h, self.n, self.train = block_words(texts)
        words, inverse = np.unique(h, return_inverse=True)
        del h
        ids, counts = np.empty(len(words), np.uint32), np.empty(len(words), np.int64)
        got = {}
        for kind, bucket, data in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "data")), strict=True):
            got[kind, bucket] = data
        for b, at in by_bucket(words, word_buckets):
            ids[at], counts[at] = unpack(got["words", b])
        p = uni.p(counts)
        inverse = inverse.astype(np.int32)
        self.ids, self.counts, self.p = ids[inverse], counts[inverse].astype(np.uint32 if counts.max(initial=0) < 2**32 else np.int64), p[inverse]
        self.key = self.ids.astype(np.uint64)
        del words, inverse, ids, counts, p
        for order, d in enumerate(ds, 2):
            history = histories(self.key, self.n, order)
            keys, first, inverse = np.unique(extended(history, self.ids, order), return_index=True, return_inverse=True)
            inverse, own = inverse.astype(np.int32), history[first]
            self.key = below = history = None
            below = self.p[first]
            del first
            c = np.empty(len(keys), np.uint32)
            for b, at in by_bucket(keys, buckets):
                c[at] = unpack(got[f"count{order}", b])[0]
            own, of = np.unique(own, return_inverse=True)
            info = np.empty((2 + K, len(own)))
            for b, at in by_bucket(own, buckets):
                info[:, at] = unpack(got[f"history{order}", b])
            for i in range(0, len(keys), 1 << 16):
                part = slice(i, i + (1 << 16))
                c1, mass, *few = info[:, of[part]]
                below[part] = conditional(c[part].astype(np.int64), c1, below[part], mass, few, d)
            del of, c
            self.p = below[inverse]
            if order < highest:
                self.key = keys[inverse]


def ask_grams(order: int, word_buckets: int, buckets: int, uni: Unigrams, ds: list[np.ndarray]):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _ROWS.empty_table()
        block = texts.column("block")[0].as_py()
        t = Block(texts, answers, word_buckets, buckets, uni, ds, order)
        history = histories(t.key, t.n, order)
        keys, first, inverse = np.unique(extended(history, t.ids, order), return_index=True, return_inverse=True)
        trained = u32(np.bincount(inverse, weights=t.train, minlength=len(keys)))
        del inverse
        # of a bigram the bucket finds the lower probability from the word's count, and the history in the key
        below = [t.counts[first].astype(np.uint64)] if order == 2 else [t.p[first], history[first]]
        out = [("grams", b, block, pack(*coded(keys[at]), trained[at], *(x[at] for x in below))) for b, at in by_bucket(keys, buckets)]
        own = np.unique(history)
        return rows(out + [("asks", b, block, pack(*coded(own[at]))) for b, at in by_bucket(own, buckets)])

    return run


def answer_grams(order: int, buckets: int, uni: Unigrams):
    """Answers on n-grams, what they add to their histories, and the rows that ask for histories as they are."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        every = list(zip(*(group.column(c).to_pylist() for c in ("kind", "block", "data")), strict=True))
        out = [(kind, bucket, block, data) for kind, block, data in every if kind == "asks"]
        asked = [(block, unpack(data)) for kind, block, data in every if kind == "grams"]
        tables = [[decoded(*t[:2]), *t[2:]] for _, t in asked]
        if not tables:
            return rows(out)
        keys, inverse, border = merged(tables)
        column = lambda i: np.concatenate([t[i] for t in tables])
        c = np.bincount(inverse, weights=column(1), minlength=len(keys)).astype(np.int64)
        below = np.empty(len(keys))
        below[inverse] = uni.p(column(2)) if order == 2 else column(2)
        history = high(keys)
        if order > 2:
            history[inverse] = column(3)
        out += [(f"count{order}", bucket, block, pack(u32(c[inverse[i:j]]))) for (block, _), i, j in zip(asked, border, border[1:], strict=False)]
        seen = np.flatnonzero(c > 0)
        own, of = np.unique(history[seen], return_inverse=True)
        add = lambda x: np.bincount(of, weights=x, minlength=len(own))
        info = [add(c[seen]).astype(np.uint64), add(below[seen]), *(u32(add(c[seen] == r)) for r in range(1, K + 1))]
        out += [("adds", b, -1, pack(*coded(own[at]), *(x[at] for x in info))) for b, at in by_bucket(own, buckets)]
        return rows([*out, ("stats", bucket, -1, None, sums_of(c))])

    return run


def answer_histories(order: int):
    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        every = list(zip(*(group.column(c).to_pylist() for c in ("kind", "block", "data")), strict=True))
        tables = [[decoded(*t[:2]), *t[2:]] for t in (unpack(data) for kind, _, data in every if kind == "adds")]
        if tables:
            own, inverse, _ = merged(tables)
            # one more place, of zeros, for histories that training texts don't have
            info = [np.bincount(inverse, weights=np.concatenate([t[i] for t in tables]), minlength=len(own) + 1) for i in range(1, 3 + K)]
        else:
            own, info = np.zeros(0, np.uint64), [np.zeros(1)] * (2 + K)
        out = []
        for kind, block, data in every:
            if kind == "asks":
                want = decoded(*unpack(data))
                at = np.searchsorted(own, want)
                if len(own):
                    at = np.where(own[np.minimum(at, len(own) - 1)] == want, at, len(own))
                c1, mass, *few = (x[at] for x in info)
                out.append((f"history{order}", bucket, block, pack(c1.astype(np.uint64), mass, *(f.astype(np.uint32) for f in few))))
        return rows(out)

    return run


def conditional(c, c1, below, mass, few, d: np.ndarray) -> np.ndarray:
    """P(w | h), element by element; ``below``: P(w) at the order below, ``few``: numbers of followers seen 1 .. K times."""
    freed = sum(f * r * (1 - d[r]) for r, f in enumerate(few, 1))
    bare = freed <= 0
    shrink = np.where(bare, c1 / (c1 + 1.0), 1.0)
    left = np.where(bare, 1 / (c1 + 1.0), freed / np.maximum(c1, 1))
    alpha = np.where(c1 > 0, left / np.maximum(1 - mass, 1e-300), 1.0)
    given = c * d[np.where(c <= K, c, 0)] * np.where(c <= K, 1, 1 / d[0]) / np.maximum(c1, 1) * shrink
    return np.where(c > 0, given, alpha * below)


def score_blocks(word_buckets: int, buckets: int, uni: Unigrams, ds: list[np.ndarray], schema: pa.Schema):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        t = Block(texts, answers, word_buckets, buckets, uni, ds, len(ds) + 1)
        off = np.concatenate([[0], np.cumsum(t.n)])
        cols = [texts.column(0), texts.column("held_out"), pa.array(t.n, pa.int64()), pa.array(segment_sums((t.counts > 0).astype(np.int64), off)), pa.array(np.full(len(t.n), uni.total, np.int64)), pa.array(segment_sums(uni.base(t.counts.astype(np.float64)), off)), pa.array(segment_sums(np.log10(t.p), off))]
        del t
        trim()
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], schema=schema)

    return run


def totals(answers: DataFrame) -> list[int]:
    """Sums over all buckets of sums_of()."""
    sums = [F.sum(F.element_at("sums", i)).alias(f"s{i}") for i in range(1, K + 4)]
    return [int(x or 0) for x in answers.where("kind = 'stats'").agg(*sums).first()]


def katz_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = 2, fold: int = 5, held: int = 1, block_bytes: int = 6 << 20, bucket_bytes: int = 6 << 20) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    Learns from all rows whose crc32(key as text) mod ``fold`` is not ``held``.  ``order``: words of the longest n-grams.  A
    null text is empty and has its end token only.  A null key counts as training text.  Rows that repeat a key, or are the
    same, count and are scored each.  With no training text, every token is unknown with probability 1.  An empty table
    gives no rows; other columns are ignored.
    """
    if order < 1:
        raise ValueError("order is at least 1")
    held_out = F.coalesce(remainder(key, fold) == held, F.lit(False))
    bare = docs.select(F.col(key), held_out.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = bare.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0)).alias("n")).first()["n"]
    blocks, n = max(1, -(-size // block_bytes)), max(1, -(-size // bucket_bytes))
    texts = bare.withColumn("block", F.expr(f"cast(pmod(xxhash64(`{key}`, text), {blocks}) as int)"))

    asked = texts.groupBy("block").applyInArrow(ask_words(n), ROWS)
    words = stored(asked.groupBy("bucket").applyInArrow(answer_words(n), ROWS), "katz-words")
    t = totals(words)
    uni = Unigrams(t[0], t[1], [0, *t[2:]])
    log.info("discounts of words: %s", good_turing(uni.n)[1])
    answers, ds = words.where("kind = 'words'"), []
    for m in range(2, order + 1):
        asked = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask_grams(m, n, n, uni, ds), ROWS)
        grams = stored(asked.groupBy("bucket").applyInArrow(answer_grams(m, n, uni), ROWS), f"katz-grams{m}")
        about = grams.where("kind IN ('adds', 'asks')")
        told = stored(about.groupBy("bucket").applyInArrow(answer_histories(m), ROWS), f"katz-histories{m}")
        d, form = good_turing([0, *totals(grams)[2:]])
        log.info("discounts of %s words: %s", m, form)
        answers, ds = answers.unionByName(grams.where(f"kind = 'count{m}'")).unionByName(told), [*ds, d]

    schema = docs.select(key).schema.add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    from pyspark.sql.pandas.types import to_arrow_schema

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score_blocks(n, n, uni, ds, to_arrow_schema(schema)), schema)
