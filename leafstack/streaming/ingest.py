"""Files that arrive in a folder are parsed and merged into the store, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from leafstack.operators import store
from leafstack.sources.files import Reader, parse_files

FILE = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, readers: dict[str, Reader] | None = None, once: bool = False) -> StreamingQuery:
    """A stream from ``folder`` into the store at ``target``.

    Each micro-batch replaces the rows of its content hashes, so a batch that is run again changes nothing.
    """
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").load(folder)

    def merge(batch: DataFrame, number: int) -> None:
        chunks = parse_files(batch, readers).where("error IS NULL")
        docs = chunks.groupBy("file_hash").agg(F.max("file_name").alias("file_name"), F.max("file_type").alias("file_type"), F.array_sort(F.collect_list(F.struct("chunk_index", "page_no", "sheet_name", "text"))).alias("chunks"))
        store.save(docs.withColumn("created_at", F.current_timestamp()).withColumn("id", F.xxhash64("file_hash")), target)

    writer = files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def usage_windows(calls: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Calls and their value per kind and time window; rows later than ``late`` are left to the batch path. Works on streams and tables."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "calls", "value")
