"""The corpus pipeline: five stages, each one operator of the llm subpackage, over the table of documents.

1. quality: documents whose quality score is under 0.3 go.
2. exact_dedup: of equal texts one row of the largest doc_id stays.
3. near_dedup: of documents linked by word-shingle Jaccard the one with the smallest doc_id stays (shingles of five
   words, similarity of 0.8 or more).
4. mixing: sources get Pfair slots with a target weight of at most TARGET_SHARE each.  The mixture ends when the sources
   under that weight have run out; what larger ones have left goes.
5. sentencepiece: two sampled segmentations a document, with their ids and inclusion scores.

Stages decide on rows: where a doc_id repeats, its texts are judged one by one, and a null doc_id is one like others (it
loses a tie against any other).  Null texts count as empty.  An empty table stays empty, and further columns are kept as
they are.  Each stage's result is written to the shared folder and reread, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoforest.llm.exact_dedup import exact_dedup
from chronoforest.llm.mixing import mix_sources
from chronoforest.llm.ngram_join import jaccard_components
from chronoforest.llm.quality import quality_scores
from chronoforest.llm.sentencepiece_lattice import sample_segmentations
from chronoforest.llm.textcore import drop_rows, flagged, remove, stored

#: The largest target weight of a source in the mixture.
TARGET_SHARE = 0.25


def row_key(*parts):
    """Columns as one text, nulls told apart from values."""
    return F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.col(p).cast("string")), F.lit("-")) for p in parts))


def small_batches(spark: SparkSession) -> None:
    """From here on workers get 4 MB of rows at once, not 64: stages with Python in them then need less memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs`` that score 0.3 or more, by labels of the training folds."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    named = {c: c if c in ("doc_id", "text") else f"_extra{i}" for i, c in enumerate(docs.columns)}
    good = quality_scores(docs.withColumnsRenamed(named), labels).where("predicted = 1")
    return good.select(*(F.col(now).alias(c) for c, now in named.items()))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, of the largest doc_id."""
    judged = stored(exact_dedup(docs).select(row_key("doc_id", "text_sha256").alias("_row"), "kept"), "pipeline-copies")
    named = docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("_row", row_key("doc_id", "_sha"))
    kept = drop_rows(named, judged.where("NOT kept").select("_row").distinct(), ["_row"])
    # rows that share both doc_id and text: one of them stays
    twice = judged.where("kept").groupBy("_row").count().where("count > 1").select("_row")
    f = flagged(kept, twice, ["_row"])
    return f.where("NOT _hit").unionByName(f.where("_hit").dropDuplicates(["_row"])).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies."""
    # texts are judged by number: their doc_id, but where that is null or repeats, one below all others, of id and text
    several = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    own = F.lit(-(1 << 62)) - F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    rows = flagged(docs, several, ["doc_id"]).withColumn("_number", F.when(F.col("_hit") | F.col("doc_id").isNull(), own).otherwise(F.col("doc_id").cast("long"))).drop("_hit")
    small_batches(spark)
    groups = stored(jaccard_components(rows.select("_number", "text"), "_number", k=5, percent=80).select("_number", "component_id"), "pipeline-groups")
    names = rows.select("_number", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_number").alias("_name")).distinct()
    met = groups.where("component_id != _number").select("component_id").distinct()
    members = groups.distinct().join(met, "component_id").join(names, "_number")
    least = members.groupBy("component_id").agg(F.min("_name").alias("_least"))
    gone = members.join(least, "component_id").where("_name != _least").select("_number")
    return drop_rows(rows, gone, ["_number"]).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that have a slot in the mixture.  Rows that repeat doc_id and source stay together if one of them has.

    Rows stay where they lie: laying them in the order of slots would send every text twice, which took an executor from
    2.8 to 3.1 GB."""
    mixed = mix_sources(docs, max_share=TARGET_SHARE).select(row_key("doc_id", "source").alias("_row"), "selected")
    gone = mixed.groupBy("_row").agg(F.max("selected").alias("any")).where("NOT any").select("_row")
    named = docs.withColumn("_source", F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn("_row", row_key("doc_id", "_source"))
    return drop_rows(named, gone, ["_row"]).select(docs.columns)


def segments(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two segmentations of each document."""
    small_batches(spark)
    return sample_segmentations(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("sentencepiece", segments)]

#: Learned scores and hashed draws have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            remove(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
