"""Trees as they arrive: a directory stream parsed to the node table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.newick import parse_trees, text_findings


def stream_trees(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Streaming trees (tree_id, tree_ordinal, source, newick), one a line of the files that appear in ``folder``."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).format("text").load(folder)
    t = raw.where("trim(value) != ''").select(F.col("_metadata.file_path").alias("source"), F.trim("value").alias("newick"))
    return t.select(F.sha2(F.concat_ws("|", "source", "newick"), 256).alias("tree_id"), F.lit(0).alias("tree_ordinal"), "source", "newick")


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append nodes and findings of new files to Parquet tables under ``target``; restarts go on from ``checkpoint``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        nodes, bad = parse_trees(batch)
        nodes.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(f"{target}/nodes")
        found = bad.unionByName(text_findings(batch).select("tree_id", "check", "severity", "detail"))
        found.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(f"{target}/findings")

    return stream_trees(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
