"""Queries: session grouping, context, copies, provider records, ownership, coverage, streaming."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.shared import stored, stream_folder
from ..operators import coverage as V
from ..operators import sessions as N
from ..sources import session_ingest as G
from ..sources import session_records as J
from ..streaming.incremental import IndexStream, appended, checkpoints
from . import oracle as O
from .queries_search import TALK_SCOPE, Built, S, asked, table, talk_chunks

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def copied_talks(spark, sf_dir):
    """Every conversation in one file, and those with an even id in a second file too; ordinals are turns."""
    c = talk_chunks(spark, sf_dir).withColumns({"tool": F.lit(None).cast("string"), "ordinal": F.col("turn"), "start_line": F.col("turn") + 1, "end_line": F.col("turn") + 1, "start_byte": F.col("turn") * 100, "end_byte": F.col("turn") * 100 + 90})
    place = lambda rows, folder: rows.withColumns({"path": F.concat(F.lit(f"{folder}/"), "conv_id", F.lit(".jsonl")), "source_key": F.concat(F.lit(f"{folder}/"), "conv_id"), "match_id": F.concat(F.lit(f"{folder}/"), "conv_id", F.lit(":"), "turn")})
    return place(c, "a").unionByName(place(c.where("conv_id % 2 = 0"), "b"))


COPIED = """(SELECT f || '/' || conv_id || ':' || turn AS match_id, f || '/' || conv_id AS source_key, f || '/' || conv_id || '.jsonl' AS path, conv_id, turn, role, text FROM conversations, (VALUES ('a'), ('b')) AS v(f) WHERE f = 'a' OR conv_id % 2 = 0)"""


@query("SELECT conv_id, turn, 'a/' || conv_id || ':' || turn AS match_id, CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 1 END AS copy_count FROM conversations")
def session_replica_groups(spark, sf_dir):
    """All chunks as hits of one query: copies collapse to one of each pair of files."""
    rows = N.occurrences(copied_talks(spark, sf_dir)).withColumns({"query_id": F.lit(1), "score": F.lit(1.0)})
    return N.grouped_hits(rows).select("conv_id", "turn", "match_id", "copy_count")


TALKED = [(1, "stupid trash"), (2, "with the")]


@query(f"WITH {O.scored(COPIED, O.values(TALKED, 'query_id, query'))}, g AS (SELECT query_id, conv_id, turn, min(match_id) AS match_id, any_value(score) AS score, count(*) AS copy_count FROM hits JOIN src USING (match_id) GROUP BY 1, 2, 3) {O.top(10, 'g', 'query_id, match_id, copy_count, CAST(round(score::DOUBLE, 5) AS DOUBLE) AS score')}")
def session_topk(spark, sf_dir):
    """Copies are grouped before the ten best are taken."""
    chunks = copied_talks(spark, sf_dir)
    hits = Built(chunks, TALK_SCOPE).hits(asked(spark, TALKED)).withColumn("score", F.round(F.col("score").cast("double"), 5))
    grouped = N.grouped_hits(N.occurrences(chunks).join(hits, "match_id"))
    return S.top(grouped, 10).select("query_id", "match_id", "copy_count", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH c AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY turn) AS e FROM {COPIED}) SELECT x.match_id AS anchor, y.match_id, y.e - x.e AS distance FROM c x JOIN c y ON x.source_key = y.source_key AND abs(y.e - x.e) <= 2 WHERE x.turn = 3")
def session_context(spark, sf_dir):
    chunks = copied_talks(spark, sf_dir)
    return N.context(chunks, chunks.where("turn = 3")).select("anchor", "match_id", "distance")


@query(f"SELECT match_id, path FROM {COPIED} WHERE conv_id = 4 AND turn = 1")
def session_copies(spark, sf_dir):
    return N.copies_of(copied_talks(spark, sf_dir), "b/4:1").select("match_id", "path")


@query(f"SELECT source_key, count(*) AS n_events FROM {COPIED} GROUP BY 1")
def session_events(spark, sf_dir):
    return N.events(copied_talks(spark, sf_dir)).groupBy("source_key").agg(F.countDistinct("event_no").alias("n_events"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, event_type FROM events")
def json_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    return rows.select("event_id", J.get("$.page").alias("page"), "event_type")


def line(**record) -> str:
    return json.dumps(record)


RECORDS = {
    "codex": [
        ("x", 1, line(type="session_meta", payload={"id": "s1", "cwd": "/w/app"})),
        ("x", 2, line(type="response_item", timestamp="2026-01-02T03:04:05Z", payload={"type": "message", "id": "m1", "role": "user", "content": [{"type": "input_text", "text": "hello"}, {"type": "image", "text": "no"}]})),
        ("x", 3, line(type="response_item", payload={"type": "message", "role": "assistant", "channel": "analysis", "content": [{"type": "text", "text": "hidden"}]})),
        ("x", 4, line(type="response_item", payload={"type": "function_call", "id": "f1", "name": "shell", "call_id": "c1", "arguments": "ls -l"})),
        ("x", 5, line(type="response_item", payload={"type": "function_call_output", "id": "o1", "call_id": "c1", "output": "files"})),
        ("x", 6, "{not json"), ("x", 7, line(type="event_msg", payload={})),
        ("x", 8, line(type="response_item", timestamp="2026-01-02T03:04:05+02:00", payload={"type": "message", "id": "m2", "role": "assistant", "content": [{"type": "output_text", "text": "bye"}, {"type": "output_text", "text": "bye"}, {"type": "output_text", "text": "  "}]})),
        ("x", 9, line(type="response_item", timestamp="2026-01-02T03:04:05Z", payload={"type": "message", "id": "m1", "role": "user", "content": [{"type": "input_text", "text": "hello"}, {"type": "image", "text": "no"}]})),
    ],
    "claude": [
        ("y", 1, line(type="user", sessionId="s2", uuid="u1", timestamp="2026-02-01T00:00:00.5Z", message={"role": "user", "content": "plain"})),
        ("y", 2, line(type="assistant", sessionId="s2", uuid="u2", message={"role": "assistant", "content": [{"type": "text", "text": "block"}, {"type": "tool_use", "id": "t1", "name": "Search", "input": {"q": "x"}}]})),
        ("y", 3, line(type="user", sessionId="s2", uuid="u3", message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "found"}]})),
        ("y", 4, line(type="system", sessionId="s2")), ("y", 5, line(type="strange", sessionId="s2")),
    ],
    "copilot": [
        ("z", 1, line(type="session.start", data={"sessionId": "s3", "context": {"cwd": "/w"}})), ("z", 2, line(type="user.message", id="e1", timestamp="bad", data={"content": "question"})), ("z", 3, line(type="tool.execution_start", id="e2", data={"toolName": "grep", "toolCallId": "k1", "arguments": "pattern"})),
        ("z", 4, line(type="tool.execution_complete", id="e3", data={"toolCallId": "k1", "result": {"content": "match", "detailedContent": "match"}})), ("z", 5, line(type="assistant.message", id="e4", data={"content": "answer"})),
    ],
}
FIELDS = [
    ("x", 2, "codex", "s1", "m1", "2026-01-02T03:04:05.000Z", "user", None, "message", "hello"), ("x", 4, "codex", "s1", "f1", None, "tool", "shell", "tool_call", "shell"), ("x", 4, "codex", "s1", "f1", None, "tool", "shell", "tool_call", "ls -l"),
    ("x", 5, "codex", "s1", "o1", None, "tool", None, "tool_result", "files"), ("x", 8, "codex", "s1", "m2", "2026-01-02T01:04:05.000Z", "assistant", None, "message", "bye"), ("x", 8, "codex", "s1", "m2", "2026-01-02T01:04:05.000Z", "assistant", None, "message", "bye"),
    ("x", 9, "codex", "s1", "m1", "2026-01-02T03:04:05.000Z", "user", None, "message", "hello"),
    ("y", 1, "claude", "s2", "u1", "2026-02-01T00:00:00.500Z", "user", None, "message", "plain"), ("y", 2, "claude", "s2", "u2", None, "assistant", None, "message", "block"), ("y", 2, "claude", "s2", "u2", None, "tool", "Search", "tool_call", '{"q":"x"}'),
    ("y", 2, "claude", "s2", "u2", None, "tool", "Search", "tool_call", "Search"), ("y", 3, "claude", "s2", "u3", None, "tool", None, "tool_result", "found"),
    ("z", 2, "copilot", "s3", "e1", None, "user", None, "message", "question"), ("z", 3, "copilot", "s3", "e2", None, "tool", "grep", "tool_call", "grep"), ("z", 3, "copilot", "s3", "e2", None, "tool", "grep", "tool_call", "pattern"),
    ("z", 4, "copilot", "s3", "e3", None, "tool", None, "tool_result", "match"), ("z", 4, "copilot", "s3", "e3", None, "tool", None, "tool_result", "match"), ("z", 5, "copilot", "s3", "e4", None, "assistant", None, "message", "answer"),
]
NAMES = "source_key, line_no, agent, session_id, event_id, timestamp, role, tool, field_kind, text"


def records(spark, agent):
    return spark.createDataFrame(RECORDS[agent], "source_key string, line_no int, line string")


def fields(spark):
    out = None
    for agent in RECORDS:
        one = J.normalised(records(spark, agent), agent)
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT * FROM {O.values(FIELDS, NAMES)}")
def provider_normalise(spark, sf_dir):
    return fields(spark).select(*NAMES.split(", "))


@query(f"SELECT * FROM {O.values([('codex', 'malformed_record', 1), ('codex', 'unsupported_record', 1), ('claude', 'unsupported_record', 1), ('copilot', 'timestamp', 1)], 'agent, category, n')}")
def provider_diagnostics(spark, sf_dir):
    out = None
    for agent in RECORDS:
        one = J.diagnostics(records(spark, agent), agent).select(F.lit(agent).alias("agent"), "category", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT * FROM {O.values(FIELDS, NAMES)} WHERE NOT (source_key = 'x' AND line_no = 9)")
def record_dedupe(spark, sf_dir):
    return J.deduped_records(fields(spark)).select(*NAMES.split(", "))


@query(f"SELECT DISTINCT * FROM {O.values(FIELDS, NAMES)}")
def field_dedupe(spark, sf_dir):
    return J.deduped_fields(fields(spark)).select(*NAMES.split(", "))


@query(f"SELECT source_key, line_no, field_kind, text, CASE WHEN field_kind = 'tool_result' THEN CASE source_key WHEN 'x' THEN 'shell' WHEN 'y' THEN 'Search' ELSE 'grep' END ELSE tool END AS tool FROM {O.values(FIELDS, NAMES)}")
def tool_call_correlation(spark, sf_dir):
    return J.correlated(fields(spark)).select("source_key", "line_no", "field_kind", "text", "tool")


@query(f"SELECT source_key, line_no, field_kind, text FROM {O.values(FIELDS, NAMES)} WHERE NOT (source_key = 'y' AND field_kind = 'tool_result')")
def own_result_exclusion(spark, sf_dir):
    return J.correlated(fields(spark), own_tools=("Search",)).select("source_key", "line_no", "field_kind", "text")


CWDS = [("a", "/w/app/src"), ("b", "/w/app"), ("c", "/w/application"), ("d", "/w/app/nested/deep"), ("d", "/w/app"), ("e", "/elsewhere")]
ROOTS = [("/w/app", "one"), ("/w/app/nested", "two"), ("/w", "zero")]


@query(f"WITH c AS (SELECT DISTINCT source_key, cwd FROM {O.values(CWDS, 'source_key, cwd')}), m AS (SELECT *, row_number() OVER (PARTITION BY source_key, cwd ORDER BY length(root) DESC) AS r FROM c LEFT JOIN {O.values(ROOTS, 'root, owner_key')} ON cwd = root OR starts_with(cwd, root || '/')) SELECT source_key, cwd, root, owner_key FROM m WHERE r = 1")
def ownership_longest_prefix(spark, sf_dir):
    return J.longest_root(spark.createDataFrame(CWDS, "source_key string, cwd string"), spark.createDataFrame(ROOTS, "root string, owner_key string"))


@query(f"SELECT * FROM {O.values([('a', True), ('b', True), ('c', False), ('d', False), ('e', False)], 'source_key, owned')}")
def ownership_sources(spark, sf_dir):
    roots = J.longest_root(spark.createDataFrame(CWDS, "source_key string, cwd string"), spark.createDataFrame(ROOTS, "root string, owner_key string"))
    return J.owned_sources(roots, "one")


LEDGER = [("p", "a", 1, 0, 2, {"binary": 2}), ("p", "b", 0, 1, 0, {"io": 1, "binary": 1}), ("q", "c", 0, 0, 0, {}), ("r", "d", 0, 3, 0, {"io": 3})]
LEDGER_SCHEMA = "collection string, source_key string, pending long, errors long, excluded long, diagnostics map<string,long>"


LEDGER_SQL = "(SELECT source AS collection, CAST(doc_id AS VARCHAR) AS source_key, CAST(doc_id % 4 = 0 AS BIGINT) AS pending, CAST(doc_id % 5 = 0 AS BIGINT) AS errors, CAST(doc_id % 7 = 0 AS BIGINT) AS excluded, lang, doc_id % 3 + 1 AS n, doc_id FROM documents)"


def ledger_of(spark, sf_dir):
    """The documents as scanned sources, with outcomes by their ids."""
    d = table(spark, sf_dir, "documents")
    flag = lambda k: (F.col("doc_id") % k == 0).cast("long")
    return d.select(F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("source_key"), flag(4).alias("pending"), flag(5).alias("errors"), flag(7).alias("excluded"), F.create_map("lang", (F.col("doc_id") % 3 + 1).cast("long")).alias("diagnostics"))


@query(f"""WITH l AS {LEDGER_SQL}, d AS (SELECT collection, string_agg(lang || ':' || n, ',' ORDER BY lang || ':' || n) AS diagnostics FROM (SELECT collection, lang, sum(n) AS n FROM l GROUP BY 1, 2) GROUP BY 1)
  SELECT collection, CAST(sum(pending) AS BIGINT) AS pending, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(excluded) AS BIGINT) AS excluded, any_value(diagnostics) AS diagnostics FROM l JOIN d USING (collection) GROUP BY 1""")
def coverage_totals(spark, sf_dir):
    return V.totals(ledger_of(spark, sf_dir))


@query(f"SELECT collection, source_key, CASE WHEN doc_id % 10 = 3 THEN 9 ELSE pending END AS pending FROM {LEDGER_SQL} WHERE doc_id % 10 <> 6")
def coverage_precise_scan(spark, sf_dir):
    """A precise scan: some sources have other outcomes, some are gone, the others stay."""
    ledger = ledger_of(spark, sf_dir)
    n = F.col("source_key").cast("long") % 10
    updates = ledger.where(n.isin(3, 6)).withColumns({"gone": n == 6, "pending": F.lit(9).cast("long")})
    return V.applied(ledger, updates, full=False, completed=True).select("collection", "source_key", "pending")


@query(f"SELECT * FROM {O.values([('p', 'b', 0), ('p', 'n', 5), ('q', 'c', 0), ('r', 'd', 0)], 'collection, source_key, pending')}")
def coverage_applied(spark, sf_dir):
    """A precise scan: one source is new, one is gone, the others stay."""
    ledger = spark.createDataFrame(LEDGER, LEDGER_SCHEMA)
    updates = spark.createDataFrame([("p", "n", 5, 0, 0, {}, False), ("p", "a", 0, 0, 0, {}, True)], LEDGER_SCHEMA + ", gone boolean")
    return V.applied(ledger, updates, full=False, completed=True).select("collection", "source_key", "pending")


STATES = [(1, None, 0, False), (2, None, 0, True), (3, 4, 1, True), (4, 0, 1, True), (5, 0, 0, True)]


@query(f"SELECT id, CASE WHEN pending IS NULL THEN CASE WHEN reconciled THEN 'refreshing' ELSE 'building' END WHEN pending > 0 THEN 'refreshing' WHEN errors > 0 THEN 'degraded' ELSE 'ready' END AS status FROM {O.values(STATES, 'id, pending, errors, reconciled')}")
def coverage_status(spark, sf_dir):
    rows = spark.createDataFrame(STATES, "id int, pending int, errors int, reconciled boolean")
    return rows.select("id", V.status(F.col("pending"), F.col("errors"), F.col("reconciled")).alias("status"))


@query(f"SELECT match_id, term, tf FROM {O.tf(O.TALKS, 'match_id')}")
def stream_append_equals_batch(spark, sf_dir):
    """The conversations as a stream of files, indexed by micro-batches; the oracle tokenises them at once."""
    folder = stream_folder(spark)
    talk_chunks(spark, sf_dir).select("match_id", "collection", "kind", "text").repartition(3, "match_id").write.parquet(f"{folder}/source")
    index = IndexStream(spark, f"{folder}/index")
    index.run(f"{folder}/source", "match_id string, collection string, kind string, text string", lambda rows: rows)
    return index.postings().select("match_id", "term", "tf")


@query("SELECT conv_id, turn FROM conversations WHERE turn >= 2 AND conv_id % 5 <> 0")
def stream_suffix(spark, sf_dir):
    """Sources whose first turns are checkpointed give the turns after them; those whose beginning changed are not appended to."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("source_key"), (F.col("turn") * 10).alias("start_byte"), (F.col("turn") * 10 + 10).alias("end_byte"), F.sha2("text", 256).alias("digest"), F.lit(True).alias("complete"), F.col("text").alias("line"), "conv_id", "turn")
    seen = checkpoints(rows.where("turn < 2"))
    now = rows.withColumn("digest", F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0), F.lit("changed")).otherwise(F.col("digest")))
    return appended(now, seen)[0].select("conv_id", "turn")


def histories(spark, sf_dir):
    """The conversations as records of the three agents' formats, with byte places: an opening record, then a message a turn."""
    talks = talk_chunks(spark, sf_dir).where("role IN ('user', 'assistant')")
    text, none = F.col("text"), F.lit(None).cast("string")
    codex = F.struct(F.lit("response_item").alias("type"), "timestamp", F.struct(F.lit("message").alias("type"), F.col("event_id").alias("id"), "role", F.array(F.struct(F.when(F.col("role") == "user", "input_text").otherwise("output_text").alias("type"), text.alias("text"))).alias("content")).alias("payload"))
    claude = F.struct(F.col("role").alias("type"), "timestamp", F.col("session_id").alias("sessionId"), F.col("event_id").alias("uuid"), F.concat(F.lit("/work/"), "session_id").alias("cwd"), F.struct("role", text.alias("content")).alias("message"))
    copilot = F.struct(F.concat("role", F.lit(".message")).alias("type"), "timestamp", F.col("event_id").alias("id"), F.struct(text.alias("content")).alias("data"))
    turn = F.when(F.col("agent") == "codex", F.to_json(codex)).when(F.col("agent") == "claude", F.to_json(claude)).otherwise(F.to_json(copilot))
    meta = F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("session_id").alias("id"), F.concat(F.lit("/work/"), "session_id").alias("cwd")).alias("payload"))
    start = F.struct(F.lit("session.start").alias("type"), F.struct(F.col("session_id").alias("sessionId"), F.struct(F.concat(F.lit("/work/"), "session_id").alias("cwd")).alias("context")).alias("data"))
    opening = F.when(F.col("agent") == "codex", F.to_json(meta)).when(F.col("agent") == "copilot", F.to_json(start)).otherwise(none)
    first = talks.select("agent", "session_id", opening.alias("line")).distinct().where("line IS NOT NULL").withColumn("turn", F.lit(-1).cast("long"))
    lines = talks.select("agent", "session_id", turn.alias("line"), F.col("turn").cast("long").alias("turn")).unionByName(first)
    w = Window.partitionBy("session_id").orderBy("turn")
    size = F.octet_length("line") + 1
    return lines.select(
        F.col("session_id").alias("source_key"), "agent", F.row_number().over(w).cast("long").alias("line_no"), (F.sum(size).over(w) - size).alias("start_byte"), F.sum(size).over(w).alias("end_byte"),
        F.sha2("line", 256).alias("digest"), F.lit(True).alias("complete"), "line", "turn",
    )


INGESTED = f"""SELECT session_id, agent, match_id AS event_id, timestamp, role, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS BIGINT) AS ordinal, text
  FROM (SELECT s.*, c.turn FROM {O.TALKS} s JOIN conversations c ON s.match_id = c.conv_id || ':' || c.turn) WHERE role IN ('user', 'assistant') AND trim(text) <> ''"""


@query(INGESTED)
def session_ingest(spark, sf_dir):
    """Histories of three agents, ingested in steps: a part, a rewritten source, the rest; against the conversations themselves."""
    records = stored(histories(spark, sf_dir))
    index = G.SessionIndex(spark, stream_folder(spark))
    odd = F.col("source_key").cast("long") % 4 == 1
    index.ingest(records.where("turn < 2").withColumn("line", F.when(odd, F.regexp_replace("line", '"role":"user"', '"role":"assistant"')).otherwise(F.col("line"))).withColumn("digest", F.sha2("line", 256)), expected=0)
    index.ingest(records.where(odd | (F.col("turn") < 3)), expected=1)
    index.ingest(records, expected=2)
    return index.chunks().select(F.col("session_id"), "agent", "event_id", "timestamp", "role", "ordinal", "text")


@query("SELECT CAST(conv_id AS VARCHAR) AS source_key, '/work/' || conv_id AS cwd FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def session_folders(spark, sf_dir):
    """The working folders that histories name."""
    return G.working_folders(histories(spark, sf_dir))
