"""Taxonomy labels: embedded ranks, rank maps, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rank prefixes and their names.
RANKS = {"d": "domain", "p": "phylum", "c": "class", "o": "order", "f": "family", "g": "genus", "s": "species", "k": "kingdom", "ss": "subspecies", "t": "strain"}


def rank_map(pairs: Column) -> Column:
    """Map of an array of (rank, value) structs; of a repeated rank the last counts, an empty value is a null one."""
    kept = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["rank"] == x["rank"]))
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["rank"].alias("k"), F.when(x["value"] != "", x["value"]).alias("v"))))


def _pairs(label: Column, pattern: str) -> Column:
    ranks, values = F.regexp_extract_all(label, F.lit(pattern), 1), F.regexp_extract_all(label, F.lit(pattern), 2)
    return F.transform(F.arrays_zip(ranks.alias("rank"), values.alias("value")), lambda x: F.struct(F.lower(x["rank"]).alias("rank"), F.trim(x["value"]).alias("value")))


def parse_double(label: Column) -> Column:
    """``d__A;p__B``: ranks split by ``;``, empty values kept as null."""
    return rank_map(_pairs(label, r"(?:^|[;\s])(ss|[dpcofgskt])__([^;]*)"))


def parse_single(label: Column) -> Column:
    """``x_d_A_p_B``: a value runs to the next ``_rank_`` mark."""
    return rank_map(_pairs(label, r"(?:^|_)(ss|[dpcofgskt])_((?!_).+?)(?=_(?:ss|[dpcofgskt])_|$)"))


def parse_ncbi(label: Column) -> Column:
    """``A; B; C``: values by position from the domain down."""
    values = F.transform(F.split(label, ";"), lambda x: F.trim(x))
    order = F.array(*[F.lit(r) for r in "dpcofgs"])
    return F.map_from_entries(F.transform(F.slice(values, 1, 7), lambda x, i: F.struct(F.get(order, i).alias("k"), F.when(x != "", x).alias("v"))))


def parse_taxonomy(label: Column) -> Column:
    """Rank map of a label in whichever format it has; an empty map where none fits."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.when(label.rlike(r"(^|[;\s])(ss|[dpcofgskt])__"), parse_double(label)).when(label.rlike(r"(^|_)[dpcofgskt]_[^_]"), parse_single(label)).when(label.contains(";"), parse_ncbi(label)).otherwise(empty)


def format_taxonomy(tax: Column) -> Column:
    """``d__A;p__B`` of a map, ranks in hierarchical order, null values as empty ones."""
    order = F.array(*[F.lit(r) for r in RANKS])
    have = F.filter(order, lambda r: F.array_contains(F.map_keys(tax), r))
    return F.array_join(F.transform(have, lambda r: F.concat(r, F.lit("__"), F.coalesce(F.element_at(tax, r), F.lit("")))), ";")


def merge_taxonomy(a: Column, b: Column) -> Column:
    """Later non-empty values win; a key that is null in both stays, as null."""
    keys = F.array_distinct(F.concat(F.map_keys(a), F.map_keys(b)))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("k"), F.coalesce(F.element_at(b, k), F.element_at(a, k)).alias("v"))))


def conflicts(a: Column, b: Column) -> Column:
    """Ranks on which two maps have different values."""
    return F.filter(F.array_intersect(F.map_keys(a), F.map_keys(b)), lambda k: F.element_at(a, k) != F.element_at(b, k))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[;_.\-\s]+"), lambda x: x != "")


def has_word(text: Column, word: str) -> Column:
    """Whether ``word`` stands between underscores or ends, in any case."""
    quoted = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in word.lower())
    return F.lower(text).rlike(f"(_|^){quoted}(_|$)")


def members(entries: DataFrame, rank: str, value: str) -> DataFrame:
    return entries.where(F.lower(F.element_at("taxonomy", rank)) == value.lower())


def missing_rank(entries: DataFrame, rank: str) -> DataFrame:
    return entries.where(F.element_at("taxonomy", rank).isNull())


def rank_statistics(entries: DataFrame) -> DataFrame:
    """(rank, total, filled, missing) over a column of maps."""
    x = entries.select(F.explode("taxonomy").alias("rank", "value"))
    return x.groupBy("rank").agg(F.count("*").alias("total"), F.count("value").alias("filled")).withColumn("missing", F.col("total") - F.col("filled"))


def two_cycles(entries: DataFrame, order: str = "dkpcofgst") -> DataFrame:
    """Pairs of values that are each other's parent at adjacent ranks; ``order``: ranks from the top, hierarchical by
    default, or sorted by letter for compatibility."""
    by = F.array(*[F.lit(r) for r in order])
    values = F.filter(F.transform(by, lambda r: F.element_at("taxonomy", r)), lambda v: v.isNotNull())
    steps = entries.select(F.explode(_steps(values)).alias("s")).select("s.*").distinct()
    back = steps.select(F.col("up").alias("down"), F.col("down").alias("up"))
    return steps.join(back, ["up", "down"]).where("up < down")


def _steps(values: Column) -> Column:
    return F.filter(F.transform(values, lambda v, i: F.struct(v.alias("up"), F.get(values, i + 1).alias("down"))), lambda s: s["down"].isNotNull())
