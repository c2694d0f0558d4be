"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text is the average of the embeddings of its hashed byte n-grams (orders 1 to
3, lower-cased ASCII); a linear layer and softmax give the language.  A part of
the bounded training sample is set aside to fit a temperature and, from the
confidences of its rightly classified rows, the level under which a prediction
is flagged ``rejected``.  As averaging and the linear layer commute, scoring
needs one table of n-gram bucket by language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textcore import byte_ngram_counts, column_bytes, remainder, row_slices

ORDERS = (1, 2, 3)
BUCKETS = 8192

_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True


class LanguageModel:
    """langs, a (BUCKETS x langs) table, a temperature and a rejection level."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, reject: float):
        self.langs, self.table, self.bias, self.temperature, self.reject = langs, table, bias, temperature, reject

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        """Of rows of n-gram counts."""
        z = (counts @ self.table / np.maximum(counts.sum(1, keepdims=True), 1) + self.bias) / self.temperature
        return softmax(z)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a Unicode letter; only texts without an ASCII one are decoded."""
    ascii_letters = np.concatenate([[0], np.cumsum(_ALPHA[raw])])
    out = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], dim: int = 16, epochs: int = 12, batch: int = 32, rate: float = 2.0, reject_quantile: float = 0.01, seed: int = 11) -> LanguageModel:
    """Train on frequency rows ``x`` (float32) and class numbers ``y``; every tenth row calibrates."""
    k = len(langs)
    if not k:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    emb, out, bias = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32), rng.normal(0, 0.1, (dim, k)).astype(np.float32), np.zeros(k, np.float32)
    test = np.arange(len(x)) % 10 == 9
    train = np.flatnonzero(~test)
    gain = np.float32(8.0)  # frequencies are small; a fixed gain keeps steps even
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(train)
        for at in range(0, len(train), batch):
            rows = order[at : at + batch]
            f = x[rows] * gain
            h = f @ emb
            p = softmax(h @ out + bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            dh = p @ out.T
            out -= step * (h.T @ p)
            bias -= step * p.sum(0)
            emb -= step * (f.T @ dh)
    # multiples of 2**-20: products with counts and their sums are exact, so a text's score doesn't depend on its batch
    table = np.round((gain * emb @ out).astype(np.float64) * 2**20) / 2**20
    model = LanguageModel(langs, table, bias.astype(np.float64), 1.0, 0.0)
    hold, truth = (x[test], y[test]) if test.any() else (x, y)
    z = hold @ table + bias
    grid = np.geomspace(0.05, 20, 60)
    eps = 1 / (len(truth) + 2)  # smoothed targets: a separable sample must not drive the temperature to nothing
    logs = [np.log(softmax(z / t) + 1e-300) for t in grid]
    loss = [-((1 - eps) * g[np.arange(len(truth)), truth] + eps * g.mean(1)).mean() for g in logs]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = p[np.arange(len(truth)), truth][p.argmax(1) == truth]
    model.reject = float(np.quantile(right, reject_quantile)) if len(right) else 0.0
    return model


def learn(docs: DataFrame, key: str, text: str, lang: str, per_language: int) -> LanguageModel:
    """Fit on at most ``per_language`` rows of each language, the first by MD5 of the key."""
    named = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    by = W.partitionBy(lang).orderBy("_h", key)
    ids = named.select(key, F.col(lang).cast("string").alias(lang)).withColumn("_h", F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")))
    chosen = ids.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= per_language).select(F.col(key).alias("_id"), F.col(lang).alias("_lang")).distinct()
    bare = named.select(F.col(key).alias("_id"), F.col(lang).cast("string").alias("_lang"), F.col(text).alias("text"))
    rows = bare.join(F.broadcast(chosen), ["_id", "_lang"])
    # one text of a key that repeats, so that the sample stays as large as it says
    rows = rows.groupBy("_id", "_lang").agg(F.min("text").alias("text")).select("_lang", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in row_slices(b):
                counts = byte_ngram_counts(*column_bytes(part.column(1)), ORDERS, BUCKETS)
                packed = []
                for r in counts:
                    i = np.flatnonzero(r)
                    packed.append(np.concatenate([i.astype(np.uint32), (r[i] / max(r.sum(), 1)).astype(np.float32).view(np.uint32)]).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["lang", "x"])

    got = rows.mapInArrow(extract, "lang string, x binary").orderBy(F.md5("x"), "lang").toPandas()
    langs = sorted(set(got["lang"]))
    x = np.zeros((len(got), BUCKETS), np.float32)
    for r, b in enumerate(got["x"]):
        i, v = np.frombuffer(b, np.uint32).reshape(2, -1)
        x[r, i] = v.view(np.float32)
    return fit(x, np.array([langs.index(v) for v in got["lang"]], np.int64), langs)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fold: int = 4, held: int = 2, per_language: int = 500) -> DataFrame:
    """(key, held_out, lang_pred, score, rejected), one row per input row.

    Learns from rows whose crc32(key as text) mod ``fold`` is not ``held`` and whose text and language are not null.  A
    null text or one without a letter is ``und`` with score 0; else ``lang_pred`` is a learned value and ``score`` its
    calibrated probability, and ``rejected`` flags a score under the calibrated level.  With nothing to learn from, all
    rows are ``und``.  Rows that repeat a key are predicted each; an empty table gives no rows; other columns are ignored.
    """
    model = learn(docs.where(F.coalesce(remainder(key, fold) != held, F.lit(False))), key, text, lang, per_language)
    rows = docs.select(F.col(key), F.coalesce(remainder(key, fold) == held, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    schema = T.StructType([docs.schema[key], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            preds, scores, low = [], [], []
            for part in row_slices(b):
                raw, offsets = column_bytes(part.column(2))
                ok = has_letter(raw, offsets) & bool(model.langs)
                p = model.probabilities(byte_ngram_counts(raw, offsets, ORDERS, BUCKETS)) if model.langs else np.zeros((len(ok), 1))
                best = p.argmax(1)
                s = np.where(ok, p.max(1), 0.0)
                preds += [model.langs[i] if good else "und" for i, good in zip(best, ok, strict=True)]
                scores.append(s)
                low.append(~ok | (s < model.reject))
            if preds:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(preds, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(low))], names=schema.names)

    return rows.mapInArrow(apply, schema)
