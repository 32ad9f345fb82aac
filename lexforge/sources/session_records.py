"""Session histories: JSONL records of three coding agents as visible fields.

Records are read as lines with their place (file, line number, byte range, digest);
a last line without a newline is pending. Each provider is one expression tree over
the record as a VARIANT; the three are united. A record that does not parse is a
diagnostic and takes nothing else with it.

records: source_key, line_no, line (and further columns).
fields: source_key, line_no, item, agent, session_id, event_id, timestamp, role,
tool, field_kind, call_id, text. Null and blank texts give no field.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROVIDERS = {"codex": ("sessions", "archived_sessions"), "claude": ("projects",), "copilot": ("session-state",)}

FIELD = "struct<role: string, tool: string, field_kind: string, call_id: string, text: string>"


def read_records(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """path, line_no, start_byte, end_byte, digest, complete, line of every JSONL record."""
    files = spark.read.format("binaryFile").options(**options).load(paths).select("path", "content")

    def run(batches):
        import hashlib

        for batch in batches:
            out = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = 0
                for n, raw in enumerate(content.splitlines(keepends=True) if b"\r" not in content else [x + b"\n" for x in content.split(b"\n")[:-1]] + ([content.rsplit(b"\n", 1)[-1]] if not content.endswith(b"\n") else []), 1):
                    body = raw.rstrip(b"\n")
                    out.append((path, n, at, at + len(raw), hashlib.sha256(body).hexdigest(), raw.endswith(b"\n"), body.decode("utf-8", "replace")))
                    at += len(raw)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
            names = ["path", "line_no", "start_byte", "end_byte", "digest", "complete", "line"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return files.mapInArrow(run, "path string, line_no long, start_byte long, end_byte long, digest string, complete boolean, line string")


def provider_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, folders in PROVIDERS.items():
        out = F.when(path.rlike(rf"/(?:{'|'.join(folders)})/.*\.jsonl$"), name).otherwise(out)
    return out


def parsed(records: DataFrame) -> DataFrame:
    """Adds v (VARIANT, null if malformed) and malformed."""
    return records.withColumn("v", F.try_parse_json("line")).withColumn("malformed", F.col("v").isNull() & (F.trim("line") != ""))


def get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("v"), path, kind)


def scalar(value: Column) -> Column:
    """A VARIANT's text, null for arrays and objects."""
    return F.when(~F.schema_of_variant(value).rlike("^(?:ARRAY|OBJECT)"), F.try_variant_get(value, "$", "string"))


def first_of(*paths: str) -> Column:
    return F.coalesce(*(get(p) for p in paths))


def normal_timestamp(raw: Column) -> Column:
    """RFC 3339 text to UTC with milliseconds; null if it is not one."""
    ok = raw.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)$")
    return F.when(ok, F.date_format(F.to_utc_timestamp(F.try_to_timestamp(raw), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def leaves(value: Column) -> Column:
    """A VARIANT as one text: a scalar itself, an object or array as JSON, which keeps its keys and scalars searchable."""
    return F.try_variant_get(value, "$", "string")


def one(role: Column | str | None, tool: Column | str | None, field_kind: str, call_id: Column | None, text: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(lit(role).alias("role"), lit(tool).alias("tool"), F.lit(field_kind).alias("field_kind"), lit(call_id).alias("call_id"), text.alias("text"))


def blocks(path: str) -> Column:
    return F.coalesce(F.try_variant_get(F.col("v"), path, "array<variant>"), F.array().cast("array<variant>"))


def of(block: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(block, path, kind)


def codex() -> Column:
    """Fields of a record: messages of user and assistant (not on the analysis channel), calls, and outputs."""
    kind, role = get("$.payload.type"), get("$.payload.role")
    plain = F.array(one(role, None, "message", None, scalar(get("$.payload.content", "variant"))))
    texts = F.transform(F.filter(blocks("$.payload.content"), lambda b: of(b, "$.type").isin("text", "input_text", "output_text")), lambda b: one(role, None, "message", None, of(b, "$.text")))
    message = F.when(role.isin("user", "assistant") & ~F.coalesce(get("$.payload.channel") == "analysis", F.lit(False)), F.concat(plain, texts))
    name, call = F.coalesce(get("$.payload.name"), F.lit("")), get("$.payload.call_id")
    inputs = [one("tool", name, "tool_call", call, leaves(get(p, "variant"))) for p in ("$.payload.arguments", "$.payload.input")]
    output = F.array(one("tool", None, "tool_result", call, leaves(get("$.payload.output", "variant"))))
    found = F.when(kind == "message", message).when(kind.isin("function_call", "custom_tool_call"), F.array(one("tool", name, "tool_call", call, name), *inputs)).when(kind.isin("function_call_output", "custom_tool_call_output"), output)
    return F.when(get("$.type") == "response_item", found)


def claude() -> Column:
    """Messages and their text blocks; calls give their input and then their name; results their content.

    Of several calls (or results) in a record, the first one's name and id hold for all.
    """
    role = F.coalesce(get("$.message.role"), get("$.type"))
    content = blocks("$.message.content")
    first = lambda kind, path: F.try_element_at(F.transform(F.filter(content, lambda b: of(b, "$.type") == kind), lambda b: of(b, path)), F.lit(1))
    name, call, answers = F.coalesce(first("tool_use", "$.name"), F.lit("")), first("tool_use", "$.id"), F.coalesce(first("tool_result", "$.tool_use_id"), get("$.toolUseResult.tool_use_id"))
    plain = F.array(one(role, None, "message", None, scalar(get("$.message.content", "variant"))))

    def block(b: Column) -> Column:
        kind = of(b, "$.type")
        result = F.concat(
            F.array(one("tool", None, "tool_result", answers, scalar(of(b, "$.content", "variant")))),
            F.transform(F.coalesce(of(b, "$.content", "array<variant>"), F.array().cast("array<variant>")), lambda x: one("tool", None, "tool_result", answers, of(x, "$.text"))),
        )
        return (
            F.when(kind == "text", F.array(one(role, None, "message", None, of(b, "$.text"))))
            .when(kind == "tool_use", F.array(one("tool", name, "tool_call", call, leaves(of(b, "$.input", "variant")))))
            .when(kind == "tool_result", result).otherwise(F.array().cast(f"array<{FIELD}>"))
        )

    called = F.when(F.exists(content, lambda b: of(b, "$.type") == "tool_use"), F.array(one("tool", name, "tool_call", call, name))).otherwise(F.array().cast(f"array<{FIELD}>"))
    return F.when(get("$.type").isin("user", "assistant"), F.concat(plain, F.flatten(F.transform(content, block)), called))


def copilot() -> Column:
    kind = get("$.type")
    role = F.when(kind.startswith("user"), "user").otherwise("assistant")
    said = F.array(*(one(role, None, "message", None, leaves(get(p, "variant"))) for p in ("$.data.content", "$.content")))
    name = F.coalesce(first_of("$.data.name", "$.name", "$.data.mcpToolName", "$.data.toolName"), F.lit(""))
    call = first_of("$.call_id", "$.data.toolCallId", "$.data.callId")
    calls = F.array(one("tool", name, "tool_call", call, name), *(one("tool", name, "tool_call", call, leaves(get(p, "variant"))) for p in ("$.data.arguments", "$.data.input")))
    results = F.array(*(one("tool", None, "tool_result", call, leaves(get(p, "variant"))) for p in ("$.data.result.content", "$.data.result.detailedContent", "$.result.content")))
    return (
        F.when(kind.isin("user.message", "assistant.message"), said)
        .when(kind.isin("tool.execution_start", "tool.start", "tool_use", "tool.call"), calls)
        .when(kind.isin("tool.execution_complete", "tool.complete", "tool_result", "tool.result"), results)
    )


#: Record types that say nothing visible and are no diagnostic.
SILENT = {"codex": ("session_meta", "turn_context", "response_item"), "claude": ("user", "assistant", "system", "summary", "progress", "file-history-snapshot"), "copilot": ("session.start", "session.resume", "session.info", "user.message", "assistant.message", "tool.execution_start", "tool.start", "tool_use", "tool.call", "tool.execution_complete", "tool.complete", "tool_result", "tool.result")}


def normalised(records: DataFrame, agent: str) -> DataFrame:
    """The visible fields of one provider's records, before correlation and deduplication."""
    tree = {"codex": codex, "claude": claude, "copilot": copilot}[agent]()
    event = first_of("$.uuid", "$.id", "$.payload.id", "$.data.eventId", "$.payload.call_id", "$.data.toolCallId")
    named = {"codex": F.when(get("$.type") == "session_meta", first_of("$.payload.session_id", "$.payload.id")), "copilot": get("$.data.sessionId")}
    session = F.coalesce(first_of("$.session_id", "$.sessionId"), named.get(agent, F.lit(None).cast("string")))
    rows = parsed(records)
    w = Window.partitionBy("source_key").orderBy("line_no")
    rows = rows.withColumn("session_id", F.coalesce(F.last(session, ignorenulls=True).over(w), F.lit("unknown")))
    rows = rows.withColumns({"event_id": event, "timestamp": normal_timestamp(F.coalesce(get("$.timestamp"), get("$.data.timestamp"))), "items": tree})
    rows = rows.select("source_key", "line_no", F.sha2("line", 256).alias("digest"), "session_id", "event_id", "timestamp", F.posexplode("items").alias("item", "f"))
    rows = rows.select("source_key", "line_no", "digest", "item", F.lit(agent).alias("agent"), "session_id", "event_id", "timestamp", "f.*")
    return rows.where(F.coalesce(F.trim("text") != "", F.lit(False)))


def diagnostics(records: DataFrame, agent: str) -> DataFrame:
    """category, n: malformed records, unsupported types, bad timestamps."""
    rows = parsed(records)
    kind, raw = get("$.type"), F.coalesce(get("$.timestamp"), get("$.data.timestamp"))
    category = F.array_compact(F.array(F.when(F.col("malformed"), "malformed_record"), F.when(kind.isNotNull() & (kind != "") & ~kind.isin(*SILENT[agent]), "unsupported_record"), F.when(raw.isNotNull() & normal_timestamp(raw).isNull(), "timestamp")))
    return rows.select(F.explode(category).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def deduped_records(fields: DataFrame) -> DataFrame:
    """A record (event id, digest) counts once in a source: the first line's."""
    w = Window.partitionBy("source_key", "event_id", "digest")
    return fields.withColumn("_first", F.min("line_no").over(w)).where(F.col("event_id").isNull() | (F.col("line_no") == F.col("_first"))).drop("_first")


def deduped_fields(fields: DataFrame) -> DataFrame:
    """Equal messages, or equal results, in one record and context are emitted once; calls always."""
    context = ["source_key", "line_no", "agent", "field_kind", "session_id", "event_id", "timestamp", "role", "tool", "text"]
    first = F.row_number().over(Window.partitionBy(*context).orderBy("item"))
    return fields.withColumn("_n", first).where((F.col("_n") == 1) | (F.col("field_kind") == "tool_call")).drop("_n")


def correlated(fields: DataFrame, own_tools: tuple[str, ...] = ()) -> DataFrame:
    """Results get the name of their call: the first earlier one with the id. Results of ``own_tools`` go; calls stay."""
    calls = fields.where("field_kind = 'tool_call' and call_id is not null and call_id <> ''").groupBy("source_key", "call_id").agg(F.min_by("tool", F.struct("line_no", "item")).alias("called"), F.min(F.struct("line_no", "item")).alias("at"))
    rows = fields.join(calls, ["source_key", "call_id"], "left")
    before = F.col("at") < F.struct("line_no", "item")
    rows = rows.withColumn("_tool", F.when(F.col("field_kind") == "tool_result", F.when(before, F.col("called"))).otherwise(F.col("tool")))
    rows = rows.where(~F.coalesce((F.col("field_kind") == "tool_result") & F.col("_tool").isin(*own_tools), F.lit(False))) if own_tools else rows
    return rows.withColumn("tool", F.col("_tool")).select(fields.columns)


def longest_root(cwds: DataFrame, registry: DataFrame, owner: str | None = None) -> DataFrame:
    """source_key, cwd, root, owner_key: the deepest registered root that holds the cwd.

    A cwd is joined by its own ancestors, so this is an equi-join. ``owner`` is asked only of the
    root chosen: a deeper root of another owner hides a parent's.
    """
    parts = F.split("cwd", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))
    rows = cwds.select("source_key", "cwd", F.explode(F.array_distinct(ancestors)).alias("root"))
    found = rows.join(registry.select("root", "owner_key"), "root").groupBy("source_key", "cwd").agg(F.max_by(F.struct("root", "owner_key"), F.length("root")).alias("best"))
    out = cwds.select("source_key", "cwd").distinct().join(found, ["source_key", "cwd"], "left").select("source_key", "cwd", "best.root", "best.owner_key")
    keep = F.col("owner_key") == owner if owner else F.col("owner_key").isNotNull()
    return out.withColumns({"root": F.when(keep, F.col("root")), "owner_key": F.when(keep, F.col("owner_key"))})


def owned_sources(roots: DataFrame, owner: str) -> DataFrame:
    """source_key, owned: all of a source's cwds belong to the owner. A source without a cwd is not in it."""
    return roots.groupBy("source_key").agg(F.bool_and(F.coalesce(F.col("owner_key") == owner, F.lit(False))).alias("owned"))
