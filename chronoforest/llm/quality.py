"""Quality classifier by Bradley-Terry pairwise ranking.

P(i is better than j) = sigmoid(w . (x_i - x_j)).  ``w`` minimises the logistic
loss over all pairs of a labelled training row of 1 and one of 0, and the margin
``w . x`` is a document's score.  A pair's loss depends on two margins only, so
the sum over all pairs comes from counts of rows by class and bin of margins.
The cut is a quantile of the training margins; a logistic slope turns margins
into (0, 1) such that this quantile maps to ``cut``.  Features are taken from
the whole text only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textcore import Words, byte_ngram_counts, column_bytes, flagged, remainder, remove, row_slices, segment_sums, stored, trim

N_STYLE = 20
HASHED = 512
WIDTH = N_STYLE + HASHED
#: Bytes at which a text's features count half; shorter texts lean to the mean of the good class.
HALF_BYTES = 64
#: Parts of one in which standardised features are whole.
STEPS = 4096


def _classes() -> np.ndarray:
    c = np.zeros((6, 256), np.float32)
    b = np.arange(256)
    c[0] = (b >= 65) & (b <= 90)
    c[1] = (b >= 48) & (b <= 57)
    c[2] = ((b >= 33) & (b <= 47)) | ((b >= 58) & (b <= 64)) | ((b >= 91) & (b <= 96)) | ((b >= 123) & (b <= 126))
    c[3] = b >= 128
    c[4] = b == 10
    c[5] = (b >= 97) & (b <= 122)
    return c


_CLASS = _classes()


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows x (WIDTH + 1)) float32 of whole texts, the last column a confidence by length; all zero for an empty text."""
    size = np.diff(offsets)
    n = len(size)
    per = np.maximum(size, 1)
    out = np.zeros((n, WIDTH + 1), np.float32)
    out[:, WIDTH] = size / (size + HALF_BYTES)
    sums = [segment_sums(_CLASS[k][raw].astype(np.float64), offsets) for k in range(6)]
    letters = np.maximum(sums[0] + sums[5] + sums[3], 1)
    out[:, 0] = sums[0] / letters
    for k in range(1, 5):
        out[:, k] = sums[k] / per
    w = Words(raw, offsets)
    count = np.maximum(w.count, 1)
    length = w.length.astype(np.float64)
    mean = segment_sums(length, w.first) / count
    out[:, 5] = mean / 10
    out[:, 6] = np.sqrt(np.maximum(segment_sums(length**2, w.first) / count - mean**2, 0)) / 10
    out[:, 7] = np.log1p(w.count) / 10
    if len(w.start):
        doc = w.doc
        order = np.lexsort((w.hash, doc))
        d, h = doc[order], w.hash[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        at = np.flatnonzero(new)
        run = np.diff(np.append(at, len(d)))
        distinct = np.bincount(d[at], minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, d[at], run)
        out[:, 8] = distinct / count
        out[:, 9] = top / count
        same = np.zeros(len(w.hash))
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
        out[:, 10] = segment_sums(same, w.first) / count
        punct = np.concatenate([[0], np.cumsum(_CLASS[2][raw])])
        marks = punct[w.start + w.length] - punct[w.start]
        out[:, 11] = segment_sums((marks > 0).astype(float), w.first) / count
        out[:, 12] = segment_sums((marks > 2).astype(float), w.first) / count
        out[:, 13] = segment_sums((marks == w.length).astype(float), w.first) / count
        out[:, 14] = segment_sums((w.length == 1).astype(float), w.first) / count
        out[:, 15] = segment_sums((w.length > 20).astype(float), w.first) / count
        out[:, 16] = np.log(distinct + 1) / np.log(count + 1.5)
        upper = np.concatenate([[0], np.cumsum(_CLASS[0][raw])])
        caps = upper[w.start + w.length] - upper[w.start]
        out[:, 17] = segment_sums((caps > 1).astype(float), w.first) / count
        digit = np.concatenate([[0], np.cumsum(_CLASS[1][raw])])
        out[:, 18] = segment_sums((digit[w.start + w.length] > digit[w.start]).astype(float), w.first) / count
        out[:, 19] = segment_sums((raw[w.start] >= 128).astype(float), w.first) / count
    out[:, N_STYLE:WIDTH] = np.sqrt(byte_ngram_counts(raw, offsets, (1, 2), HASHED) / per[:, None])
    return out


class PairwiseRanker:
    """Bradley-Terry weights with the standardisation and the calibration of the margin."""

    def __init__(self, prior, scale, weight, cut_margin, slope, cut):
        self.prior, self.scale, self.weight, self.cut_margin, self.slope, self.cut = prior, scale, weight, cut_margin, slope, cut

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Whole multiples of 1 / STEPS, at most 8: their sums and products are exact in any order."""
        return np.rint(np.clip((x[:, :WIDTH] - self.prior) / self.scale, -8, 8) * x[:, WIDTH:] * STEPS) / STEPS

    def margin(self, x: np.ndarray) -> np.ndarray:
        # row by row in float64: a text's score doesn't depend on the rows it is batched with
        return (self.standard(x).astype(np.float64) * self.weight).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.margin(x).astype(np.float64) - self.cut_margin) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def totals(rows: DataFrame, measure: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and sums of values over all ``rows`` (y, x); ``measure`` gives both, as int64, for some rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                x = column_bytes(part.column(1))[0].view(np.float32).reshape(-1, WIDTH + 1)
                k, v = measure(x, part.column(0).to_numpy())
                if len(k) == len(keys) and (k == keys).all():
                    sums = sums + v
                else:
                    keys, place = np.unique(np.concatenate([keys, k]), return_inverse=True)
                    more, sums = np.concatenate([sums, v]), np.zeros(len(keys), np.int64)
                    np.add.at(sums, place, more)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["k", "v"])
        trim()

    got = rows.mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    k, v = got["k"].to_numpy(), got["v"].to_numpy()
    order = np.argsort(k)
    return k[order], v[order]


def spread_of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For totals(): numbers of rows, sums and squares of features by class, in 2^-26; a value above 64 counts as 64."""
    f = np.minimum(x[:, :WIDTH].astype(np.float64), 64)
    parts = []
    for c in (0, 1):
        own = f[y == c]
        parts += [[len(own)], np.rint(own * 2.0**26).sum(0), np.rint(own**2 * 2.0**26).sum(0)]
    v = np.concatenate(parts).astype(np.int64)
    return np.arange(len(v)), v


class PairLoss:
    """The mean logistic loss of all pairs of a row labelled 1 and one labelled 0, by bins of margins, with what a row of
    each bin adds to the gradient.  Bins are 1/64 wide at most, and every row is in one."""

    def __init__(self, rows: DataFrame, model: PairwiseRanker, weight: np.ndarray):
        self.model = PairwiseRanker(model.prior, model.scale, weight, 0.0, 1.0, model.cut)
        ranker, self.width = self.model, min(2.0**-6, max(float(np.abs(weight).sum()), 1e-9) * 2.0**-10)
        width = self.width

        def bins(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return np.unique(np.rint(ranker.margin(x) / width).astype(np.int64) * 2 + y, return_counts=True)

        k, n = totals(rows, bins)
        self.bin, self.count = [k[k % 2 == c] // 2 for c in (0, 1)], [n[k % 2 == c] for c in (0, 1)]
        self.at = [b * self.width for b in self.bin]
        share = [c / c.sum() for c in self.count]
        self.loss, self.wrong = 0.0, [np.zeros(len(self.at[0])), np.zeros(len(self.at[1]))]
        for i in range(0, len(self.at[1]), 256):
            lead = self.at[0][None, :] - self.at[1][i : i + 256, None]
            low = np.exp(-np.abs(lead))
            p = np.where(lead > 0, 1, low) / (1 + low)  # probability given to the wrong order
            self.wrong[1][i : i + 256] = p @ share[0]
            self.wrong[0] += share[1][i : i + 256] @ p
            self.loss += float(share[1][i : i + 256] @ (np.maximum(lead, 0) + np.log1p(low)) @ share[0])

    def gradient(self, rows: DataFrame) -> np.ndarray:
        ranker, width, bin_, wrong = self.model, self.width, self.bin, [np.rint(w * 2.0**20) for w in self.wrong]

        def pull(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            z, k, parts = ranker.standard(x).astype(np.float64) * STEPS, np.rint(ranker.margin(x) / width).astype(np.int64), []
            for c in (0, 1):
                parts.append(wrong[c][np.searchsorted(bin_[c], k[y == c])] @ z[y == c])
            return np.arange(2 * WIDTH), np.concatenate(parts).astype(np.int64)

        v = totals(rows, pull)[1].reshape(2, WIDTH) / (STEPS * 2.0**20)
        return v[0] / self.count[0].sum() - v[1] / self.count[1].sum()

    def quantile(self, q: np.ndarray, c: int | None = None) -> np.ndarray:
        """Quantiles of the margins of class ``c``, or of all."""
        at, n = (self.at[c], self.count[c]) if c is not None else (np.concatenate(self.at), np.concatenate(self.count))
        order = np.argsort(at, kind="stable")
        at, upto = at[order], np.cumsum(n[order])
        place = np.asarray(q) * (upto[-1] - 1)
        low, high = (at[np.searchsorted(upto, f(place), side="right")] for f in (np.floor, np.ceil))
        return low + (high - low) * (place - np.floor(place))

    def below(self, c: int, at: np.ndarray) -> np.ndarray:
        """The share of class ``c`` with margins under ``at``."""
        upto = np.concatenate([[0], np.cumsum(self.count[c])])
        return upto[np.searchsorted(self.at[c], at)] / upto[-1]


def fit_ranker(rows: DataFrame, cut: float = 0.3, decay: float = 1e-3, rounds: int = 30, close: float = 1e-3) -> PairwiseRanker:
    """Fit on all ``rows`` (y: 0 or 1, x: features as bytes) and all pairs of a 1 and a 0: quasi-Newton steps, each one
    pass for the margins and one for the gradient, from the curvature at weights of 0, which bounds all others.  They end
    when a step gains less than ``close`` in the mean loss of a pair.  Sums are of whole numbers, so the fit doesn't depend on partitions.
    With one class only there are no pairs, and every row scores above the cut."""
    weight = np.zeros(WIDTH)
    none = PairwiseRanker(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), weight, -1.0, 1.0, cut)
    v = totals(rows, spread_of)[1]
    if not len(v) or not v[0] or not v[1 + 2 * WIDTH]:
        return none
    v = v.reshape(2, 1 + 2 * WIDTH)
    n, first, second = v[:, 0], v[:, 1 : 1 + WIDTH] / 2.0**26, v[:, 1 + WIDTH :] / 2.0**26
    deviation = np.sqrt(np.maximum(second.sum(0) / n.sum() - (first.sum(0) / n.sum()) ** 2, 0))
    model = PairwiseRanker((first[1] / n[1]).astype(np.float32), (deviation + 1e-4).astype(np.float32), weight, 0.0, 1.0, cut)
    upper = np.triu_indices(WIDTH)

    def moments(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z, parts = model.standard(x).astype(np.float64) * STEPS, []
        for c in (0, 1):
            own = z[y == c]
            parts += [own.sum(0), (own.T @ own)[upper]]
        out = np.concatenate(parts).astype(np.int64)
        return np.arange(len(out)), out

    v = totals(rows, moments)[1].reshape(2, -1) / n[:, None]
    mean, bound = v[:, :WIDTH] / STEPS, np.zeros((WIDTH, WIDTH))
    bound[upper] = v[:, WIDTH:].sum(0) / STEPS**2
    bound += np.triu(bound, 1).T
    bound -= np.outer(mean[0], mean[1]) + np.outer(mean[1], mean[0])
    # more on the diagonal is a bound as well; with fewer rows than features plain steps would fit the rows' noise
    bound = bound / 4 + (np.trace(bound) / 4 / WIDTH + decay) * np.eye(WIDTH)
    loss, grad, now, past = np.log(2), (mean[0] - mean[1]) / 2, None, []
    for _ in range(rounds):
        # two loops over the last steps, around the bound
        d, kept = -grad, []
        for s, g in reversed(past):
            kept.append(s @ d / (s @ g))
            d = d - kept[-1] * g
        d = np.linalg.solve(bound, d)
        for (s, g), a in zip(past, reversed(kept), strict=True):
            d = d + (a - g @ d / (s @ g)) * s
        step = 1.0
        while True:
            tried = PairLoss(rows, model, weight + step * d)
            gained = loss - tried.loss - decay / 2 * float((tried.model.weight**2).sum())
            if gained >= -1e-4 * step * float(grad @ d) or step < 1e-2:
                break
            step /= 2
        if now is not None and gained <= 0:
            break
        now, before, old = tried, grad, weight
        weight, loss = tried.model.weight, loss - gained
        if gained < close:
            break
        grad = now.gradient(rows) + decay * weight
        if (weight - old) @ (grad - before) > 0:
            past = [*past[-7:], (weight - old, grad - before)]
    # the quantile of training margins that best parts the classes, as the middle of the best gap
    levels = np.linspace(0.01, 0.99, 197)
    cuts = now.quantile(levels)
    gain = 1 - now.below(1, cuts) + now.below(0, cuts)
    best = cuts[gain >= gain.max() - 1e-9]
    every = np.unique(np.concatenate(now.at))
    under, over = np.searchsorted(every, best[0]) - 1, np.searchsorted(every, best[-1])
    at = float((every[max(under, 0)] + every[min(over, len(every) - 1)]) / 2)
    spread = max(float(now.quantile(0.5, 1) - now.quantile(0.5, 0)), 1e-3)
    model.weight, model.cut_margin, model.slope = weight, at, 8.0 / spread
    return model


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return features(*column_bytes(batch.column(batch.schema.get_field_index("text"))))


def labelled_features(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(y, x) of every row of ``docs`` whose key has a label; only rows that may have one are shuffled."""
    named = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_y"))
    near = flagged(docs.select(F.col(key), F.col(text).alias("text")), named, [key]).where("_hit").drop("_hit")
    rows = near.join(named, key).select(F.col("_y").cast("int").alias("y"), "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in row_slices(b):
                x = _matrix(part)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])
            trim()

    return rows.mapInArrow(extract, "y int, x binary")


def fit_quality(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, cut: float) -> PairwiseRanker:
    """Learn from all labelled rows, whose features are a table in the shared folder for as long as that takes."""
    rows = stored(labelled_features(docs, labels, key, text, label), "quality-features")
    try:
        return fit_ranker(rows, cut)
    finally:
        remove(rows)


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fold: int = 5, held: int = 0, cut: float = 0.3) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 where score >= cut).

    Labels of rows whose crc32(key as text) mod ``fold`` is ``held`` are never read.  A null text scores as an empty
    one does.  Labels that are null or neither 0 nor 1 are left out, of labels that repeat a key the largest counts.
    Rows that repeat a key are scored each; columns named held_out, score or predicted are replaced.  Without pairs to
    learn from every row scores above the cut.  An empty table gives no rows.
    """
    known = labels.select(key, label).where(remainder(key, fold) != held)
    model = fit_quality(docs.where(remainder(key, fold) != held), known, key, text, label, cut)
    kept = docs.drop("held_out", "score", "predicted")
    bare = kept.withColumn("held_out", F.coalesce(remainder(key, fold) == held, F.lit(False)))
    at = bare.columns.index(text)
    schema = T.StructType([*bare.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(features(*column_bytes(part.column(at)))) for part in row_slices(b, text)]
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])
            trim()

    return bare.mapInArrow(apply, schema)
