"""Session histories from folders to chunks, incrementally.

``discovered`` lists the files of three agents, ``session_records.read_records`` reads
them, ``fields`` makes visible fields of the records, and ``session_chunks`` cuts those
into chunks whose ordinals count through a source. ``SessionIndex`` keeps chunks and
checkpoints by generation: of a source that has only grown the new records' chunks are
appended, with ordinals that go on; a source that was rewritten is replaced; one that is
gone goes. What it holds is what one pass over all records gives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.manifest import Manifest, Versions
from ..streaming.incremental import appended, checkpoints
from . import session_records as J
from .project import BYTES, chunk_texts
from .shared import stored

AGENTS = tuple(J.PROVIDERS)


@dataclass(frozen=True)
class Homes:
    """Where each agent keeps its histories."""

    codex: str
    claude: str
    copilot: str

    def roots(self) -> list[tuple[str, str]]:
        return [(agent, f"{getattr(self, agent).rstrip('/')}/{folder}") for agent, folders in J.PROVIDERS.items() for folder in folders]


def discovered(spark: SparkSession, homes: Homes) -> DataFrame:
    """path, agent, length, modified of every history; contents are not read. Folders that are not there have none."""
    from pyspark.errors import AnalysisException

    out = spark.createDataFrame([], "path string, agent string, length long, modified timestamp")
    for agent, root in homes.roots():
        glob = "events.jsonl" if agent == "copilot" else "*.jsonl"
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
        except AnalysisException:
            continue
        out = out.unionByName(files.select("path", F.lit(agent).alias("agent"), "length", F.col("modificationTime").alias("modified")))
    return out


def read(spark: SparkSession, homes: Homes) -> DataFrame:
    """The records of all histories: source_key (of the path), path, agent, and their places."""
    out = None
    for agent, root in homes.roots():
        found = discovered(spark, homes).where((F.col("agent") == agent) & F.col("path").contains(f"{root}/".removeprefix("file:")))
        if found.isEmpty():
            continue
        glob = "events.jsonl" if agent == "copilot" else "*.jsonl"
        rows = J.read_records(spark, [root], recursiveFileLookup=True, pathGlobFilter=glob).withColumn("agent", F.lit(agent))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise FileNotFoundError("no history")
    return out.withColumn("source_key", F.sha2("path", 256))


def fields(records: DataFrame) -> DataFrame:
    """The visible fields of complete records (source_key, agent, line_no, ..., line): deduplicated, results named by their calls."""
    complete = records.where("complete")
    out = None
    for agent in AGENTS:
        rows = J.normalised(complete.where(F.col("agent") == agent), agent)
        rows = J.correlated(J.deduped_fields(J.deduped_records(rows)))
        out = rows if out is None else out.unionByName(rows)
    return out


def working_folders(records: DataFrame) -> DataFrame:
    """source_key, cwd: the folders that a source's records name, for ownership."""
    v = J.parsed(records.where("complete"))
    kind = J.get("$.type")
    cwd = (
        F.when((F.col("agent") == "codex") & kind.isin("session_meta", "turn_context"), J.get("$.payload.cwd")).when(F.col("agent") == "claude", J.get("$.cwd"))
        .when((F.col("agent") == "copilot") & kind.isin("session.start", "session.resume"), J.get("$.data.context.cwd"))
    )
    return v.select("source_key", cwd.alias("cwd")).where("cwd is not null").distinct()


CHUNK_COLUMNS = ["source_key", "ordinal", "agent", "session_id", "event_id", "timestamp", "role", "tool", "field_kind", "text", "start_line", "end_line", "start_byte", "end_byte"]


def session_chunks(found: DataFrame, records: DataFrame, most: int = BYTES) -> DataFrame:
    """Chunks of at most ``most`` bytes of every field, numbered through their source by line, field and place; bounds are the record's."""
    keys = ["source_key", "line_no", "item", "agent", "session_id", "event_id", "timestamp", "role", "tool", "field_kind"]
    parts = chunk_texts(found, keys, lines=None, most=most).withColumnRenamed("ordinal", "part").drop("start_line", "end_line", "start_byte", "end_byte")
    placed = parts.join(records.select("source_key", "line_no", "start_byte", "end_byte"), ["source_key", "line_no"])
    ordinal = F.row_number().over(Window.partitionBy("source_key").orderBy("line_no", "item", "part")) - 1
    return placed.withColumns({"ordinal": ordinal.cast("long"), "start_line": F.col("line_no"), "end_line": F.col("line_no")}).select(CHUNK_COLUMNS)


class Conflict(RuntimeError):
    """Another writer has published meanwhile."""


class SessionIndex:
    """Chunks and checkpoints of session sources, published by generation."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.versions = spark, Versions(spark, folder)

    def chunks(self) -> DataFrame:
        now = self.versions.latest()
        return self.versions.read(now, "chunks") if now else self.spark.createDataFrame([], "source_key string")

    def ingest(self, records: DataFrame, expected: int | None = None) -> Manifest:
        """Brings the index up to ``records``: all that the sources hold now. ``expected``: the generation the caller has seen; a newer one is a Conflict."""
        now = self.versions.latest()
        if expected is not None and expected != (now.generation if now else 0):
            raise Conflict(f"generation {now.generation if now else 0}, not {expected}")
        complete = records.where("complete")
        new = checkpoints(records)
        if now is None:
            chunks = session_chunks(fields(records), complete)
        else:
            old, held = self.versions.read(now, "checkpoints"), self.versions.read(now, "chunks")
            fresh, rebuild = appended(records, old.select("source_key", "offset", "prefix_digest"))
            rebuild, grown = stored(rebuild), stored(fresh.select("source_key").distinct())
            # a source's context (session, calls, repeats) comes from its whole history, so a changed one is normalised whole and only new chunks are kept
            changed = records.join(grown.union(rebuild).distinct(), "source_key", "left_semi")
            every = stored(session_chunks(fields(changed), changed.where("complete")))
            tail = every.join(old.select("source_key", "offset").join(rebuild, "source_key", "left_anti"), "source_key").where(F.col("start_byte") >= F.col("offset")).drop("offset")
            there = complete.select("source_key").distinct()
            kept = held.join(rebuild, "source_key", "left_anti").join(there, "source_key", "left_semi")
            chunks = kept.unionByName(every.join(rebuild, "source_key", "left_semi")).unionByName(tail)
        latest = self.versions.latest()
        if (latest.generation if latest else 0) != (now.generation if now else 0):
            raise Conflict("published meanwhile")
        return self.versions.publish({"chunks": chunks, "checkpoints": new})
