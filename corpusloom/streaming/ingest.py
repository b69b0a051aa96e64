"""File-source stream of Markdown and text files into a section table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.structure import headings, section_tree
from corpusloom.sources.providers import TEXT, suffix



def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Read every new file of *folder* once and append its sections to the Parquet table *target*.

    The document id is a hash of path and content, so a retried batch gives
    the same ids; each batch writes its own subfolder, which a retry overwrites.
    """

    def store(batch: DataFrame, number: int) -> None:
        docs = batch.select(F.sha2(F.concat_ws("\x1f", "path", "text"), 256).alias("doc"), "text")
        section_tree(headings(docs)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    rows = files.where(suffix("path").isin(*TEXT)).select("path", F.decode("content", "UTF-8").alias("text"))
    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
