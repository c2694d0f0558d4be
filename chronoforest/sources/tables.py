"""Tabular files: taxonomies, name mappings, reports, manifests; and checks of files before they are read."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.taxonomy import RANKS, format_taxonomy, parse_taxonomy

# Spellings of the name column's header, and of ranks.
NAME_HEADERS = ("name", "label", "taxon", "tip", "id", "genome", "accession")
RANK_HEADERS = {v: k for k, v in RANKS.items()} | {k: k for k in RANKS}


def safe_path(path: str) -> str:
    """``path``, unless one of its segments climbs up."""
    if ".." in path.replace("\\", "/").split("/"):
        raise ValueError(f"unsafe path {path}")
    return path


def sniff(head: str) -> str:
    first = head.splitlines()[0] if head else ""
    return max("\t,;|", key=lambda c: (first.count(c), c == "\t")) if first else "\t"


def read_taxonomy(spark: SparkSession, path: str, sep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries (name, taxonomy map), findings) of tables with one rank a column, or with a name and a rank string.

    Each file is read by its own first line, which is a header if its names tell; only the different first lines are looked
    at on the driver.  Short rows are padded and long rows cut, both as findings.  Without any entry there is an error
    finding.
    """
    meta = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")
    lines = spark.read.text(path).select("value", *meta).withColumn("_id", F.monotonically_increasing_id())
    firsts = lines.where("_start = 0").groupBy("_file").agg(F.min_by("value", "_id").alias("_head"), F.min("_id").alias("_first"))
    body = lines.join(firsts, "_file")
    parts = [_taxonomy_rows(body.where(F.col("_head") == F.lit(r["_head"])), r["_head"], sep) for r in firsts.select("_head").distinct().collect()]
    if not parts:
        parts = [_taxonomy_rows(body, "", sep)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    entries = rows.where("name != ''").select("name", "taxonomy")
    odd = rows.select(F.when(F.coalesce(F.col("name"), F.lit("")) == "", "no_name").when(F.col("n") < F.col("wanted"), "short_row").when(F.col("n") > F.col("wanted"), "long_row").alias("check"), F.coalesce("name", F.lit("")).alias("detail")).where("check IS NOT NULL")
    empty = entries.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no_entries").alias("check"), F.lit("").alias("detail"))
    return entries, odd.unionByName(empty).withColumn("severity", F.when(F.col("check") == "no_entries", "error").otherwise("warning"))


def _taxonomy_rows(lines: DataFrame, head: str, sep: str | None) -> DataFrame:
    """(name, taxonomy, n, wanted) of the lines of files that begin with ``head``."""
    sep = sep or sniff(head)
    names = [h.strip().lower() for h in next(csv.reader(io.StringIO(head), delimiter=sep), [])]
    ranks = [RANK_HEADERS.get(h) for h in names]
    has_header = any(h in NAME_HEADERS for h in names) or sum(r is not None for r in ranks) > 1
    at = next((i for i, h in enumerate(names) if h in NAME_HEADERS), 0)
    # a separator inside quotes has an odd number of quotes after it
    between = "\\Q" + sep + "\\E(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), '^"(.*)"$', "$1"), '""', '"')
    if has_header:
        lines = lines.where("_id != _first")
    cells = lines.where(F.trim("value") != "").select(F.transform(F.split(F.regexp_replace("value", "\r$", ""), between), bare).alias("c"))
    wide = has_header and sum(r is not None for i, r in enumerate(ranks) if i != at) > 0
    if wide:
        pairs = [F.struct(F.lit(r).alias("k"), F.nullif(F.get("c", F.lit(i)), F.lit("")).alias("v")) for i, r in enumerate(ranks) if r and i != at]
        tax = F.map_from_entries(F.array(*pairs))
    else:
        tax = parse_taxonomy(F.coalesce(F.get("c", F.lit(1 if at == 0 else 0)), F.lit("")))
    return cells.select(F.get("c", F.lit(at)).alias("name"), tax.alias("taxonomy"), F.size("c").alias("n"), F.lit(len(names) if has_header else 2).alias("wanted"))


def write_taxonomy(entries: DataFrame, path: str) -> None:
    entries.select("name", format_taxonomy(F.col("taxonomy")).alias("taxonomy")).write.option("sep", "\t").option("header", True).csv(safe_path(path))


MAPPING = "original string, short string, method string, accession string, taxonomy string"


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MAPPING).option("sep", "\t").option("header", True).csv(path)


def write_mapping(mapping: DataFrame, path: str) -> None:
    mapping.select("original", "short", "method", "accession", "taxonomy").write.option("sep", "\t").option("header", True).csv(safe_path(path))


def write_phylip(seqs: DataFrame, path: str) -> None:
    """One PHYLIP text an alignment: lines (aln_id, short, seq) under a count line, partitioned by alignment."""
    head = seqs.groupBy("aln_id").agg(F.concat_ws(" ", F.count("*"), F.max(F.length("seq"))).alias("line")).select("aln_id", F.lit(0).alias("k"), "line")
    body = seqs.select("aln_id", F.lit(1).alias("k"), F.concat("short", F.lit("  "), "seq").alias("line"))
    rows = head.unionByName(body).repartition("aln_id").sortWithinPartitions("aln_id", "k", "line")
    rows.select(F.col("line").alias("value"), "aln_id").write.partitionBy("aln_id").text(safe_path(path))


def write_report(rows: DataFrame, path: str) -> None:
    """The comparison table as one TSV; it has a row a node, so one file is right."""
    rows.coalesce(1).write.option("sep", "\t").option("header", True).csv(safe_path(path))


def write_manifest(runs: DataFrame, path: str) -> None:
    """Job status and counts, no ages, as JSON lines."""
    runs.select("sample_id", "method", "fingerprint", "status", "nodes", "seconds").write.mode("append").json(safe_path(path))


def metadata_text(spark: SparkSession, **facts) -> str:
    """Provenance of a run as JSON: versions, settings and what the caller adds."""
    return json.dumps({"spark": spark.version, "app": spark.sparkContext.applicationId, "partitions": spark.conf.get("spark.sql.shuffle.partitions"), **facts}, sort_keys=True)


def file_findings(spark: SparkSession, path: str, max_bytes: int = 500 << 20) -> DataFrame:
    """(path, check, severity) of files: empty, too large, byte order mark, no UTF-8, Windows line ends."""
    files = spark.read.format("binaryFile").load(path)
    # the scan leaves empty files out; the listing has them
    listed = spark.createDataFrame([(n.replace("file:///", "file:/"),) for n in files.inputFiles()], "path string")
    empty = listed.join(files.select("path"), "path", "left_anti").select("path", F.lit("empty_file").alias("check"), F.lit("error").alias("severity"))
    f = files.select("path", "length", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))
    text = F.expr("try_validate_utf8(cast(content AS string)) IS NOT NULL")
    hexed = F.hex(F.substring("content", 1, 3))
    checks = [("too_large", "error", F.col("length") > max_bytes), ("byte_order_mark", "warning", hexed.startswith("EFBBBF")), ("not_utf8", "warning", F.col("content").isNotNull() & ~text), ("windows_line_ends", "info", F.expr("instr(cast(content AS string), '\r') > 0"))]
    found = F.array(*[F.when(c, F.struct(F.lit(k).alias("check"), F.lit(s).alias("severity"))) for k, s, c in checks])
    return f.select("path", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("path", "f.*").unionByName(empty)


def tree_format(path: Column, head: Column) -> Column:
    """newick, nexus, phyloxml, stockholm (to be refused) or auto, by signature, then extension."""
    h, ext = F.ltrim(head), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(F.upper(h).startswith("#NEXUS"), "nexus").when(h.rlike(r"^<\?xml|^<phyloxml"), "phyloxml").when(h.startswith("# STOCKHOLM"), "stockholm").when(h.rlike(r"^(\[[^\]]*\]\s*)?\("), "newick").when(ext.isin("nex", "nexus"), "nexus").when(ext.isin("nwk", "tre", "tree", "newick"), "newick").when(ext == "xml", "phyloxml").otherwise("auto")


def calibrated_texts(trees: DataFrame, calibrations: DataFrame) -> DataFrame:
    """(tree_id, text): a tree's Newick beneath its calibrations as comment lines; for people, not for programs.

    trees: tree_id, newick; calibrations: tree_id, name, a, b, is_root, bounds (text, null: unknown)."""
    place = F.when(F.col("is_root"), F.lit("root")).otherwise(F.concat_ws(",", "a", "b"))
    line = F.concat(F.lit("# "), "name", F.lit(": MRCA "), place, F.lit(" = "), F.coalesce("bounds", F.lit("unknown")))
    notes = calibrations.groupBy("tree_id").agg(F.array_sort(F.collect_list(line)).alias("_n"))
    lines = F.coalesce("_n", F.array().cast("array<string>"))
    head = F.concat(F.lit("# Total calibrations: "), F.size(lines).cast("string"))
    text = F.concat(F.concat_ws("\n", head, lines), F.lit("\n\n"), "newick", F.lit("\n"))
    return trees.join(notes, "tree_id", "left").select("tree_id", text.alias("text"))
