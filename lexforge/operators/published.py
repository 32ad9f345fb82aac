"""An index that is built once and read by any number of searches.

Its tables lie in one generation of a ``Versions`` folder. Postings, term statistics
and declarations are clustered by a bucket of the term (CRC-32), so a look-up of a few
terms reads a few buckets whatever the size of the index; within a bucket rows are
dealt by match and sorted by term, so a term that every chunk holds is no single task.
Each task is given its bucket and its part of the matches by number, not by a hash of
them, so no task sorts the parts of several by chance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import index as I
from . import sessions as N
from .manifest import Versions

BUCKETS = 64
#: Bytes of text whose postings one task sorts.
TASK_BYTES = 16 << 20
#: The same for an index; and chunks whose postings of one term, held by all of them, one task sorts.
SORT_BYTES, SORT_CHUNKS = 4 << 20, 500_000
#: Tasks up to which a shuffle keeps no rows in memory as it writes (spark.shuffle.sort.bypassMergeThreshold).
MERGED = 200
CLUSTERED = {
    "postings": "match_id string, collection string, kind string, term string, tf long, bucket int", "df": "collection string, kind string, term string, doc_freq long, bucket int", "declared": "match_id string, symbol string, bucket int",
}
#: Look-ups of more terms than this read all buckets.
MOST_TERMS = 4_096


def bucket(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def buckets_of(terms: Iterable[str]) -> list[int]:
    return sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})


def with_columns(chunks: DataFrame) -> DataFrame:
    """Columns that a collection has not are null, bounds those of the text as a whole."""
    text = F.coalesce("text", F.lit(""))
    more = {c: F.lit(None).cast("string") for c in ("agent", "session_id", "event_id", "timestamp", "role", "tool", "field_kind", "path")}
    path = F.col("path") if "path" in chunks.columns else F.lit(None).cast("string")
    more |= {"source_key": F.coalesce(path, F.col("match_id")), "source_version": F.sha2(text, 256), "eligible": F.lit(True), "ordinal": F.lit(0).cast("long")}
    more |= {c: v.cast("long") for c, v in (("start_byte", F.lit(0)), ("end_byte", F.octet_length(text)), ("start_line", F.lit(1)), ("end_line", F.size(F.split(text, "\n"))))}
    return chunks.withColumns({c: v for c, v in more.items() if c not in chunks.columns})


def tasks_for(chunks: DataFrame) -> int:
    """As many tasks as the texts ask for, whatever the session's setting, so that a task's share of their postings fits its memory."""
    size = chunks.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(chunks.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def sorts_for(chunks: DataFrame) -> int:
    """As many tasks as the postings of an index ask for: beyond BUCKETS, as many for each bucket."""
    size, n = chunks.agg(F.sum(F.octet_length("text").cast("long")), F.count("*")).first()
    tasks = max(chunks.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // SORT_BYTES), -(-n * BUCKETS // SORT_CHUNKS))
    return tasks if tasks <= BUCKETS else -(-tasks // BUCKETS) * BUCKETS


@dataclass(frozen=True)
class Index:
    """chunks: match_id, collection, kind, eligible, path, text and what else they have. Statistics are those of eligible sources."""

    chunks: DataFrame
    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    df: DataFrame
    declared: DataFrame
    occurrences: DataFrame  # match_id, occurrence, fingerprint of session chunks: which are copies
    generation: int = 0

    @staticmethod
    def publish(chunks: DataFrame, folder: str, partitions: int | None = None, texts: bool = True) -> Index:
        """Builds and publishes the next generation. ``partitions``: where the input comes in fewer splits than there are cores, deal it out first."""
        spark = chunks.sparkSession
        versions = Versions(spark, folder)
        kept = with_columns(chunks)
        eligible = kept.where("eligible")
        dealt = eligible.repartition(partitions) if partitions else eligible
        new = versions.next()
        tasks = sorts_for(eligible)
        # beyond MERGED a task keeps the postings that it makes until they are shuffled: those of TASK_BYTES, whatever the input's splits
        texts_ = eligible.repartition(max(partitions or 0, tasks * SORT_BYTES // TASK_BYTES), "match_id") if tasks > MERGED else dealt
        parts = -(-tasks // BUCKETS)

        def write(name: str, rows: DataFrame, clustered: str | None = None) -> DataFrame:
            path = versions.path(new, name)
            if clustered:
                rows = rows.withColumn("bucket", bucket(F.col(clustered)))
                # a bucket is dealt out by match (or term) over as many tasks as there are for it, and each of them has no other
                spread = F.pmod(F.xxhash64("match_id" if "match_id" in rows.columns else clustered), F.lit(parts))
                rows.repartitionById(tasks, (F.col("bucket") * parts + spread).cast("int")).sortWithinPartitions("bucket", clustered).write.mode("overwrite").partitionBy("bucket").parquet(path)
            else:
                rows.write.mode("overwrite").parquet(path)
            return spark.read.schema(rows.schema).parquet(path)

        postings = write("postings", I.postings(texts_), "term")
        lengths = write("lengths", I.lengths(eligible, postings))
        stats = write("stats", I.corpus_stats(lengths))
        df = write("df", I.term_stats(postings), "term")
        declared = write("declared", I.declarations(dealt), "symbol")
        occurrences = write("occurrences", N.occurrences(eligible.where("kind = 'session'")).select("match_id", "occurrence", "fingerprint"))
        chunks = write("chunks", kept) if texts else kept
        versions.commit(new)
        return Index(chunks, postings, lengths, stats, df, declared, occurrences, new.generation)

    @staticmethod
    def open(spark: SparkSession, folder: str) -> Index | None:
        """The newest whole generation that this code can read."""
        versions = Versions(spark, folder)
        now = versions.latest()
        if now is None or now.needed() != "nothing":
            return None
        names = ("chunks", "postings", "lengths", "stats", "df", "declared", "occurrences")
        return Index(*(versions.read(now, name, CLUSTERED.get(name)) for name in names), now.generation)

    def of_terms(self, rows: DataFrame, terms: Iterable[str]) -> DataFrame:
        """``rows`` (postings, df or declared) of the buckets of ``terms``."""
        terms = set(terms)
        return rows.where(F.col("bucket").isin(buckets_of(terms))) if len(terms) <= MOST_TERMS else rows
