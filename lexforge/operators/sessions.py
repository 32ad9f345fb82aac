"""Session operators: occurrences of events, collapsed copies, context around a match, paging of copies.

chunks: match_id, source_key, path, ordinal, agent, session_id, event_id, role, tool,
field_kind, text, start_line, end_line, start_byte, end_byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ["agent", "session_id", "event_id"]
BOUNDS = ["start_line", "end_line", "start_byte", "end_byte"]
CONTENT = ["text", "role", "tool", "field_kind"]


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def groupable() -> Column:
    """Only messages with agent, session and event can be copies of one another."""
    return ~blank(F.col("agent")) & ~blank(F.col("session_id")) & ~blank(F.col("event_id")) & F.coalesce(F.col("field_kind") == "message", F.lit(False))


def occurrences(chunks: DataFrame) -> DataFrame:
    """Adds occurrence (chunks of one event at one place of one source), position in it, and fingerprint.

    The fingerprint is equal for occurrences with equal ordered chunks and ids, whatever
    their source, place and time; null for chunks that cannot be grouped, each an occurrence of its own.
    """
    place = F.sha2(F.to_json(F.struct("source_key", *BOUNDS, *IDENTITY, F.when(~groupable(), F.col("match_id")).alias("own")), {"ignoreNullFields": "false"}), 256)
    rows = chunks.withColumn("occurrence", place)
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("occurrence").orderBy("ordinal", "match_id")) - 1)
    parts = rows.where(groupable()).groupBy("occurrence").agg(F.array_sort(F.collect_list(F.struct("position", *CONTENT, *IDENTITY))).alias("parts"))
    prints = parts.select("occurrence", F.sha2(F.to_json("parts", {"ignoreNullFields": "false"}), 256).alias("fingerprint"))
    return rows.join(prints, "occurrence", "left")


def grouped_hits(hits: DataFrame) -> DataFrame:
    """Session hits with copies collapsed: hits (query_id, match_id, score) with the columns of ``occurrences``.

    An occurrence's score is its best chunk's; of equal occurrences the best, then the one with the
    smallest match_id, stands for all, with all its matching chunks and copy_count, the number of
    occurrences among the hits.
    """
    at = Window.partitionBy("query_id", "occurrence").orderBy(F.desc("score"), "match_id")
    rows = hits.withColumn("best_score", F.first("score").over(at)).withColumn("best_id", F.first("match_id").over(at))
    group = F.coalesce("fingerprint", "occurrence")
    rows = rows.withColumn("event", group)
    of_event = Window.partitionBy("query_id", "event").orderBy(F.desc("best_score"), "best_id")
    rows = rows.withColumn("stands", F.dense_rank().over(of_event) == 1)
    copies = rows.groupBy("query_id", "event").agg(F.countDistinct("occurrence").alias("copy_count"))
    return rows.where("stands").join(copies, ["query_id", "event"]).drop("stands")


def copies_of(chunks: DataFrame, match_id: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """All chunks equivalent to ``match_id``: same fingerprint, same position; by path, source, ordinal, id. One that cannot be grouped gives itself.

    Only chunks with the match's own agent, session and event are looked at.
    """
    own = chunks.where(F.col("match_id") == match_id).select(*(F.col(c).alias(f"own_{c}") for c in IDENTITY))
    near = chunks.join(F.broadcast(own), [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in IDENTITY]).select(chunks.columns)
    rows = occurrences(near.where(groupable() | (F.col("match_id") == match_id)))
    anchor = rows.where(F.col("match_id") == match_id).select(F.coalesce("fingerprint", "occurrence").alias("event"), F.col("position").alias("at"))
    found = rows.withColumn("event", F.coalesce("fingerprint", "occurrence")).join(F.broadcast(anchor), "event").where("position = at").drop("at")
    return found.orderBy("path", "source_key", "ordinal", "match_id").offset(offset).limit(limit)


def events(chunks: DataFrame) -> DataFrame:
    """Adds event_no, counted in each source: a new event begins where ids or (with field kinds) bounds change, or without an event id."""
    w = Window.partitionBy("source_key").orderBy("ordinal")
    changed = lambda c: ~F.lag(c).over(w).eqNullSafe(F.col(c))
    moved = changed("start_line") | changed("end_line") | changed("start_byte") | changed("end_byte")
    legacy = F.col("field_kind").isNull() & F.lag("field_kind").over(w).isNull()
    starts = blank(F.col("event_id")) | changed("agent") | changed("session_id") | changed("event_id") | (~legacy & moved) | (F.row_number().over(w) == 1)
    return chunks.withColumn("event_no", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def context(chunks: DataFrame, anchors: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """For each of ``anchors`` (match_id): the chunks of its event and of ``before`` and ``after`` events around, in order."""
    rows = events(chunks.join(chunks.join(anchors.select("match_id"), "match_id", "left_semi").select("source_key").distinct(), "source_key", "left_semi"))
    at = rows.join(anchors.select("match_id"), "match_id").select(F.col("match_id").alias("anchor"), "source_key", F.col("event_no").alias("at"))
    found = rows.join(at, "source_key").where(F.col("event_no").between(F.col("at") - before, F.col("at") + after))
    return found.withColumn("distance", F.col("event_no") - F.col("at")).drop("at")
