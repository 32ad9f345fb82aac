"""Incremental index maintenance by Structured Streaming.

Each micro-batch is tokenised by the batch operators and written under its batch
id, so a batch that is run again after a failure replaces what it wrote before. The
statistics are signed deltas for each source; their sum over the batches is what one
pass over everything gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.index import SCOPE, lengths, postings


#: Bytes of records whose digests are taken together.
BLOCK = 1 << 20


class IndexStream:
    """Appends chunks from a stream to an index folder (postings, lengths by batch)."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            posted = postings(batch)
            posted.write.mode("overwrite").parquet(f"{self.folder}/postings/batch={batch_id}")
            lengths(batch, posted).write.mode("overwrite").parquet(f"{self.folder}/lengths/batch={batch_id}")
        finally:
            batch.unpersist()

    def run(self, source: str, schema: StructType | str, prepare) -> None:
        """Reads what ``source`` (Parquet) holds now that earlier runs have not read; ``prepare`` makes chunks of it."""
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = prepare(stream).writeStream.foreachBatch(self.write_batch).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/postings").drop("batch")

    def lengths(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/lengths").drop("batch")


def appended(records: DataFrame, checkpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new records of sources whose checkpoint still fits, sources to rebuild).

    records: source_key, start_byte, end_byte, digest, complete, line. checkpoints: source_key, offset,
    prefix_digest (digest of the digests of all records below offset). A tail without a newline waits.
    """
    complete = records.where("complete")
    below = complete.join(checkpoints, "source_key").where(F.col("end_byte") <= F.col("offset"))
    prefix = prefix_digests(below).select("source_key", F.col("prefix_digest").alias("now"), F.col("offset").alias("reached"))
    fits = checkpoints.join(prefix, "source_key", "left").where((F.col("now") == F.col("prefix_digest")) & (F.col("reached") == F.col("offset"))).select("source_key", "offset")
    rebuild = complete.select("source_key").distinct().join(fits, "source_key", "left_anti")
    fresh = complete.join(fits, "source_key").where(F.col("start_byte") >= F.col("offset")).drop("offset")
    return fresh, rebuild


def prefix_digests(records: DataFrame) -> DataFrame:
    """source_key, offset, prefix_digest: the digest of the digests of blocks of BLOCK bytes, each the digest of its records' ones in order.

    So no task holds more than a block's records, or a number for each block of a source.
    """
    joined = lambda column, order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda r: r[column]), ""), 256)
    blocks = records.groupBy("source_key", F.floor(F.col("start_byte") / BLOCK).alias("block")).agg(joined("digest", "start_byte").alias("of_block"), F.max("end_byte").alias("offset"))
    return blocks.groupBy("source_key").agg(F.max("offset").alias("offset"), joined("of_block", "block").alias("prefix_digest"))


def checkpoints(records: DataFrame) -> DataFrame:
    """source_key, offset, prefix_digest of the complete records."""
    return prefix_digests(records.where("complete"))


__all__ = ["IndexStream", "SCOPE", "appended", "checkpoints"]
