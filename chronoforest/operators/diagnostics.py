"""MCMC diagnostics that need a whole chain: effective sample size and highest-density intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relations import ranked


def geyer_ess(x: np.ndarray) -> float:
    """n / tau by the initial positive monotone sequence of paired autocorrelations (FFT); 0 without variance."""
    n = len(x)
    c = x - x.mean() if n else x
    if n < 2 or float(np.var(c, ddof=1)) < 1e-15:
        return 0.0
    f = np.fft.rfft(c, 1 << (2 * n - 1).bit_length())
    acf = np.fft.irfft(f * np.conj(f))[:n]
    total, _ = _positive_pairs(acf / acf[0])
    return float(n / max(2 * total - 1, 1e-12))


def _positive_pairs(acf: np.ndarray) -> tuple[float, bool]:
    """(sum, ended) of the initial positive monotone sequence of pairs of autocorrelations."""
    pairs = acf[: len(acf) // 2 * 2].reshape(-1, 2).sum(1)
    stop = np.flatnonzero((pairs <= 0) | np.append(False, np.diff(pairs) > 0))
    return float(pairs[: stop[0] if len(stop) else len(pairs)].sum()), bool(len(stop))


def _products(keys: list[str], size: int, lags: int):
    """For applyInPandas: what a segment's values make with those at each lag behind them, guests of the next included."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        x, n = pdf["_x"].to_numpy(float), int((pdf["_at"] // size == pdf["_segment"]).sum())
        width = 1 << (len(x) + n).bit_length()
        sums = np.fft.irfft(np.conj(np.fft.rfft(x[:n], width)) * np.fft.rfft(x, width), width)[:lags]
        sums[len(x) :] = 0
        return pdf[[*keys, "_n"]].iloc[:1].reset_index(drop=True).assign(sums=[sums.tolist()])

    return run


def _sizes(keys: list[str], lags: int):
    """For mapInPandas: effective sizes from autocovariances, and whether these were enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(*_positive_pairs(np.array(a[: min(n, lags)]) / a[0]), n) for a, n in zip(pdf["acf"], pdf["_n"], strict=True)]
            value = [n / max(2 * total - 1, 1e-12) for total, _, n in out]
            yield pdf[keys].assign(ess=value, ended=[ended or n <= lags for _, ended, n in out])

    return run


def ess(samples: DataFrame, by: list[str], order: str = "iter", segment: int = 1 << 16, lags: int = 256) -> DataFrame:
    """(by, ess): the least over chains; samples: by, chain, iter, value.

    A chain is cut into segments, each with the first ``lags`` values of the next, and a segment's products at each lag are
    added to the others': no chain is one task's.  Chains whose positive pairs don't end within so many lags are looked at
    again with four times as many; segments grow with the lags.  A chain of at most ``lags`` values is seen whole.
    """
    keys = [*by, "chain"]
    good = samples.where("value IS NOT NULL").select(*keys, order, "value")
    stats = good.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg("value").alias("_mean"), F.var_samp("value").alias("_var"))
    found = stats.where("_n < 2 OR _var IS NULL OR _var < 1e-15").select(*keys, F.lit(0.0).alias("ess"))
    rows = ranked(good, keys, order).join(stats.where("_n >= 2 AND _var >= 1e-15").drop("_var"), keys)
    rows = rows.select(*keys, (F.col("rank") - 1).alias("_at"), "_n", (F.col("value") - F.col("_mean")).alias("_x"))
    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)
    left = None
    while True:
        size = max(segment, 4 * lags)
        own = (rows if left is None else rows.join(left, keys, "left_semi")).withColumn("_segment", F.expr(f"_at div {size}"))
        guests = own.where(f"_segment > 0 AND _at % {size} < {lags}").withColumn("_segment", F.col("_segment") - 1)
        parts = own.unionByName(guests).groupBy(*keys, "_segment").applyInPandas(_products(keys, size, lags), f"{kinds}, _n long, sums array<double>")
        lagged = parts.select(*keys, "_n", F.posexplode("sums").alias("lag", "v")).groupBy(*keys, "_n", "lag").agg(F.sum("v").alias("v"))
        acf = lagged.groupBy(*keys, "_n").agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "v"))), lambda s: s["v"]).alias("acf"))
        done = acf.mapInPandas(_sizes(keys, lags), f"{kinds}, ess double, ended boolean").cache()
        found, left = found.unionByName(done.where("ended").select(*keys, "ess")), done.where("NOT ended").select(*keys)
        if not left.head(1):
            return found.groupBy(*by).agg(F.min("ess").alias("ess"))
        lags *= 4


def hpd(samples: DataFrame, by: list[str], mass: float = 0.95) -> DataFrame:
    """(by, lo, hi): the shortest interval with ``mass`` of the samples, by the ranks of its ends among the sorted values."""
    n = samples.groupBy(*by).agg(F.count("value").alias("_n")).withColumn("_k", F.greatest(F.lit(1), F.ceil(F.col("_n") * mass)).cast("long"))
    r = ranked(samples.where("value IS NOT NULL").select(*by, "value"), by, "value").withColumnRenamed("rank", "_r").join(n, by)
    ends = r.select(*by, (F.col("_r") - F.col("_k") + 1).alias("_r"), F.col("value").alias("hi"))
    spans = r.select(*by, "_r", F.col("value").alias("lo")).join(ends, [*by, "_r"])
    return spans.groupBy(*by).agg(F.min_by(F.struct("lo", "hi"), F.struct(F.col("hi") - F.col("lo"), F.col("lo"))).alias("m")).select(*by, "m.lo", "m.hi")
