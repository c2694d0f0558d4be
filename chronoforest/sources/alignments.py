"""Alignments: format detection, FASTA, FASTQ, PHYLIP, Stockholm, Clustal, metadata, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upper(seq: Column) -> Column:
    """Upper case letter by letter, as far as the outcome is A-Z: ``F.upper`` would make SS, two residues, of a sharp s."""
    return F.translate(seq, "abcdefghijklmnopqrstuvwxyz\u0131\u017f", "ABCDEFGHIJKLMNOPQRSTUVWXYZIS")


def alphabet(seq: Column, spaces: bool = False) -> Column:
    """dna, rna, protein or unknown by the characters of a sequence; an unclear dna/rna one is dna.

    ``spaces`` are blank, tab, line feed, form feed and carriage return; other line ends are no part of a sequence."""
    s, gap = upper(seq), r"\-?.*" + (r" \t\n\f\r" if spaces else "")
    out = F.when(s.rlike(f"^[ACGTN{gap}]+\\z"), "dna")
    if not spaces:
        out = out.when(s.rlike(f"^[ACGUN{gap}]+\\z"), "rna")
    return out.when(s.rlike(f"^[A-Z{gap}]+\\z"), "protein").otherwise("unknown")


def detect_format(path: Column, head: Column) -> Column:
    """By signature first, then by extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    h = F.ltrim(head)
    by_sign = F.when(h.startswith(">"), "fasta").when(h.startswith("@"), "fastq").when(h.startswith("# STOCKHOLM"), "stockholm").when(F.upper(h).startswith("CLUSTAL"), "clustal").when(F.upper(h).startswith("#NEXUS"), "nexus").when(h.rlike(r"^\d+\s+\d+"), "phylip")
    by_ext = F.when(ext.isin("fa", "fas", "fasta", "fna", "faa"), "fasta").when(ext.isin("fq", "fastq"), "fastq").when(ext.isin("phy", "phylip"), "phylip").when(ext.isin("sto", "stk", "stockholm"), "stockholm").when(ext.isin("aln", "clustal"), "clustal").when(ext.isin("nex", "nexus"), "nexus")
    return F.coalesce(by_sign, by_ext, F.lit("unknown"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(aln_id, seq_id, seq): split by the reader itself at each ``>`` that begins a line, so a large file is read in records,
    not whole.  The first record of a file still has its mark."""
    rec = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value"), F.col("_metadata.file_path").alias("aln_id"))
    return fasta_records(rec.where("trim(value) != ''"))


def fasta_records(rec: DataFrame) -> DataFrame:
    clean = F.regexp_replace("value", "\r", "")
    head, body = F.regexp_extract(clean, r"^([^\n]*)", 1), F.regexp_replace(clean, r"^[^\n]*\n?", "")
    return rec.select("aln_id", F.regexp_extract(head, r"^(\S+)", 1).alias("seq_id"), F.regexp_replace(body, r"\s", "").alias("seq"))


def parse_fasta(texts: DataFrame) -> DataFrame:
    """(aln_id, seq_id, seq) of a column of whole FASTA texts: texts has (aln_id, text)."""
    return fasta_records(texts.select("aln_id", F.explode(F.split("text", "(?m)^>")).alias("value")).where("trim(value) != ''"))


def parse_fastq(texts: DataFrame) -> DataFrame:
    """(aln_id, seq_id, seq, quality, ok): four lines a record."""
    lines = F.filter(F.split(F.regexp_replace("text", "\r", ""), "\n"), lambda x: x != "")
    n = texts.select("aln_id", lines.alias("l")).where("size(l) > 0")
    rec = n.select("aln_id", "l", F.explode(F.sequence(F.lit(0), F.ceil(F.size("l") / 4).cast("int") - 1)).alias("i"))
    g = lambda k: F.get("l", F.col("i") * 4 + k)
    ok = F.coalesce(g(0).startswith("@") & g(2).startswith("+") & (F.length(g(1)) == F.length(g(3))), F.lit(False))
    return rec.select("aln_id", F.regexp_extract(g(0), r"^@(\S*)", 1).alias("seq_id"), g(1).alias("seq"), g(3).alias("quality"), ok.alias("ok"))


def parse_phylip(texts: DataFrame) -> DataFrame:
    """(aln_id, seq_id, seq, n_declared, length_declared) of sequential PHYLIP texts, one line a sequence."""
    lines = F.filter(F.split(F.regexp_replace("text", "\r", ""), "\n"), lambda x: F.trim(x) != "")
    h = texts.select("aln_id", lines.alias("l")).withColumn("head", F.get("l", F.lit(0)))
    body = h.select("aln_id", "head", F.posexplode(F.slice("l", 2, F.greatest(F.size("l"), F.lit(1)))).alias("i", "line"))
    out = body.where(~F.trim("line").rlike(r"^[Gg]\s"))
    return out.select("aln_id", F.regexp_extract("line", r"^\s*(\S+)", 1).alias("seq_id"), F.regexp_replace(F.regexp_replace("line", r"^\s*\S+", ""), r"\s", "").alias("seq"), F.regexp_extract("head", r"^\s*(\d+)", 1).cast("int").alias("n_declared"), F.regexp_extract("head", r"^\s*\d+\s+(\d+)", 1).cast("int").alias("length_declared"))


def parse_blocks(texts: DataFrame) -> DataFrame:
    """(aln_id, seq_id, length) of Stockholm and Clustal texts: fragments of a name add up."""
    lines = texts.select("aln_id", F.explode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("line"))
    kept = lines.where(~F.col("line").rlike(r"^(#|//|CLUSTAL|\s|$)"))
    parts = kept.select("aln_id", F.split(F.trim("line"), r"\s+").alias("p")).where("size(p) >= 2")
    return parts.groupBy("aln_id", F.get("p", F.lit(0)).alias("seq_id")).agg(F.sum(F.length(F.get("p", F.lit(1)))).alias("length"))


def metadata(seqs: DataFrame) -> DataFrame:
    """(aln_id, num_sequences, sequence_length, is_aligned)"""
    n = F.length("seq")
    g = seqs.groupBy("aln_id").agg(F.count("*").alias("num_sequences"), F.min(n).alias("lo"), F.max(n).alias("hi"))
    return g.select("aln_id", "num_sequences", F.when(F.col("lo") == F.col("hi"), F.col("hi")).alias("sequence_length"), (F.col("lo") == F.col("hi")).alias("is_aligned"))


def findings(seqs: DataFrame) -> DataFrame:
    """(aln_id, check, severity, detail, position): duplicate ids, empty sequences, residues outside the alphabet."""
    dup = seqs.groupBy("aln_id", "seq_id").agg(F.count("*").alias("n")).where("n > 1").select("aln_id", F.lit("duplicate_sequence").alias("check"), F.lit("error").alias("severity"), F.col("seq_id").alias("detail"), F.lit(None).cast("int").alias("position"))
    empty = seqs.where("seq = ''").select("aln_id", F.lit("empty_sequence").alias("check"), F.lit("error").alias("severity"), F.col("seq_id").alias("detail"), F.lit(None).cast("int").alias("position"))
    odd = seqs.where(F.upper("seq").rlike(r"[^A-Z\-?.*]")).select("aln_id", "seq_id", F.posexplode(F.split("seq", "")).alias("i", "c")).where(~F.upper("c").rlike(r"^[A-Z\-?.*]?$"))
    odd = odd.select("aln_id", F.lit("invalid_residue").alias("check"), F.lit("error").alias("severity"), F.concat("seq_id", F.lit(":"), "c").alias("detail"), (F.col("i") + 1).cast("int").alias("position"))
    uneven = metadata(seqs).where("NOT is_aligned").select("aln_id", F.lit("unequal_length").alias("check"), F.lit("warning").alias("severity"), F.lit("").alias("detail"), F.lit(None).cast("int").alias("position"))
    return dup.unionByName(empty).unionByName(odd).unionByName(uneven)


# Letters that decide for nucleotides and for proteins; all others may be either.
NUCLEOTIDES, RESIDUES = "ATCGU", "EFILPQSVWY"


def sequence_type(seq: Column, first: int = 1000) -> Column:
    """Protein where residues are more than 5 % of the first decisive letters and more than the nucleotides; else dna."""
    s = F.substring(F.regexp_replace(upper(seq), f"[^{NUCLEOTIDES}{RESIDUES}]", ""), 1, first)
    residues = F.length(F.regexp_replace(s, f"[{NUCLEOTIDES}]", ""))
    return F.when((residues > 0.05 * F.length(s)) & (residues > F.length(s) - residues), "protein").otherwise("dna")
