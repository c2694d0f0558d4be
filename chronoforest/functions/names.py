"""Names: cleaning, accessions, short names that stay unique."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sanitize(name: Column, limit: int = 30) -> Column:
    """Other characters than letters, digits and ``_`` become one ``_``; ends are stripped; cut to ``limit``."""
    s = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"), "_+", "_")
    return F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, limit)


def accession(name: Column) -> Column:
    """A genome accession inside a name, else null."""
    a = F.regexp_extract(name, r"(GC[AF]_\d+(?:\.\d+)?)", 1)
    return F.when(a != "", a)


def normalized(name: Column) -> Column:
    """A name as suggestions compare it: lower case, without ``_`` and ``-``."""
    return F.translate(F.lower(name), "_-", "")


def serial_names(names: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """``short``: S00001 ... in the order of a dense ordinal column that starts at 1."""
    return names.withColumn("short", F.concat(F.lit("S"), F.format_string("%05d", F.col(ordinal).cast("long"))))


def fit_suffix(base: str, n: int, limit: int) -> str:
    tail = f"_{n}"
    return base[: limit - len(tail)] + tail


def claim(bases: list[str], limit: int, taken: set[str] | None = None) -> list[str]:
    """Each base in turn keeps its name, or takes the first free ``_2``, ``_3`` ... that fits ``limit``."""
    taken, out = set(taken or ()), []
    for b in bases:
        name, n = b[:limit], 2
        while name in taken:
            name, n = fit_suffix(b, n, limit), n + 1
        taken.add(name)
        out.append(name)
    return out


def short_names(names: DataFrame, scope: str, limit: int = 30) -> DataFrame:
    """(scope, ordinal, original, short): unique short names in each naming scope.

    Claiming is sequential by nature, so a scope - the names of one tree - is one group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        return pdf.assign(short=claim(pdf["base"].tolist(), limit))[[scope, "ordinal", "original", "short"]]

    rows = names.select(scope, "ordinal", "original", sanitize(F.col("original"), limit).alias("base"))
    kind = names.schema[scope].dataType.simpleString()
    order = names.schema["ordinal"].dataType.simpleString()
    return rows.groupBy(scope).applyInPandas(run, f"{scope} {kind}, ordinal {order}, original string, short string")


def mapping_findings(mapping: DataFrame) -> DataFrame:
    """Short names used twice and originals with several short names."""
    s = mapping.groupBy("short").agg(F.countDistinct("original").alias("n")).where("n > 1").select(F.lit("duplicate_short").alias("check"), F.col("short").alias("detail"), "n")
    o = mapping.groupBy("original").agg(F.countDistinct("short").alias("n")).where("n > 1").select(F.lit("conflicting_original").alias("check"), F.col("original").alias("detail"), "n")
    return s.unionByName(o)
