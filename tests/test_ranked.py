"""The whole ranked search: published quality and ablations, lanes, filters, hydration, decay."""

import pytest
from pyspark.sql import functions as F
from quality_set import CASES, DOCUMENTS, PUBLISHED

from lexforge.operators import metrics as M
from lexforge.operators import ranking as R
from lexforge.operators.published import Index
from lexforge.plans.ranked import Query, search

NOW = "2026-09-21T00:00:00+00:00"
CHUNKS = "match_id string, collection string, kind string, path string, source_key string, text string, timestamp string, role string, agent string, session_id string, event_id string, field_kind string"


def chunk(key, kind, path, text, time=None, role=None, collection="fixture"):
    own = (time, role, "codex", key, key, "tool_result" if role == "tool" else "message") if kind == "session" else (None,) * 6
    return (f"m-{key}", collection, kind, path, key, text, *own)


@pytest.fixture(scope="module")
def fixture_index(spark, tmp_path_factory):
    rows = spark.createDataFrame([chunk(*d) for d in DOCUMENTS], CHUNKS)
    return Index.publish(rows, str(tmp_path_factory.mktemp("quality")))


@pytest.mark.parametrize("off", PUBLISHED)
def test_published_quality(spark, fixture_index, off):
    queries = [Query(i, q, "fixture", kind) for i, (q, kind, _, _) in enumerate(CASES)]
    options = R.Options(**({off: False} if off else {}))
    hits = search(fixture_index, queries, options, NOW, 20).hits
    ranked = hits.join(fixture_index.chunks.select("match_id", F.col("source_key").alias("source"), F.col("text").alias("text_key")), "match_id").select("query_id", F.col("position").alias("rank"), "source", "text_key")
    judged = spark.createDataFrame([(i, s, g) for i, c in enumerate(CASES) for g, names in ((3, c[2]), (1, c[3])) for s in names], "query_id long, source string, grade int")
    got = M.retrieval_metrics(ranked, judged, relevant=3).agg(*(F.avg(c).alias(c) for c in ("recall", "mrr", "ndcg", "duplicate_rate"))).first()
    assert [round(x, 4) for x in got] == pytest.approx(PUBLISHED[off], abs=1e-4)


def talk(key, session, event, text, time, agent="codex"):
    return (f"m-{key}", "talks", "session", f"{key}.jsonl", key, text, time, "assistant", agent, session, event, "message")


@pytest.fixture(scope="module")
def talks_index(spark, tmp_path_factory):
    rows = [talk(f"a{k}", "s1", "e1", "the pump failed at noon", "2026-09-20T00:00:00Z") for k in range(4)]  # one event in four files
    rows += [talk("b", "s2", "e2", "the pump failed at noon", "2025-09-20T00:00:00Z"), talk("c", "s3", "e3", "pump pressure was low", "2026-09-01T00:00:00Z", "claude"), talk("d", "s4", "e4", "nothing of note", None)]
    rows += [chunk("p", "project", "src/pump.rs", "fn pump_pressure() {}", collection="talks")]
    return Index.publish(spark.createDataFrame(rows, CHUNKS), str(tmp_path_factory.mktemp("talks")))


def test_filters_copies_decay_and_hydration(spark, talks_index):
    queries = [
        Query(1, "pump failed", "talks", "session"), Query(2, "pump", "talks", "session", agent="claude"), Query(3, "pump", "talks", "session", before="2026-01-01T00:00:00Z"), Query(4, "pump", "talks", "session", session_id="s3"),
        Query(5, "pump_pressure", "talks", "project"), Query(6, "src/pump.rs", "talks", "project", path_glob="lib/*"), Query(7, "pump.rs", "talks", "project", path_glob="src/*"), Query(8, "zzz", "talks", "session"), Query(9, "...", "talks", "session"),
    ]
    found = search(talks_index, queries, now=NOW)
    rows = {}
    for r in sorted(found.hits.collect(), key=lambda r: (r.query_id, r.position)):
        rows.setdefault(r.query_id, []).append(r)
    assert [(r.match_id, r.copy_count) for r in rows[1]] == [("m-a0", 4), ("m-c", 1)]  # b has the same text and is older: it falls to the copies' first
    assert rows[1][0].collapsed == ["m-b"]
    assert [r.match_id for r in rows[2]] == ["m-c"] == [r.match_id for r in rows[4]] and [r.match_id for r in rows[3]] == ["m-b"]
    assert (rows[5][0].match_id, rows[5][0].tier, rows[5][0].exact) == ("m-p", 2, "symbol") and (rows[7][0].exact, rows[7][0].decay) == ("basename", 1.0)
    assert 6 not in rows and 8 not in rows and 9 not in rows and 9 not in found.plans
    assert rows[3][0].decay < rows[1][0].decay <= 1.0


def test_publish_and_open(spark, talks_index, tmp_path):
    assert Index.open(spark, str(tmp_path / "none")) is None
    rows = spark.createDataFrame([chunk("x", "project", "a.rs", "alpha beta"), chunk("y", "project", "b.rs", "alpha")], CHUNKS)
    for generation in (1, 2):
        assert Index.publish(rows, str(tmp_path / "index")).generation == generation
    index = Index.open(spark, str(tmp_path / "index"))
    assert index.generation == 2 and [r.match_id for r in search(index, [Query(1, "beta", "fixture", "project")], now=NOW).hits.collect()] == ["m-x"]
    assert {r.term for r in index.of_terms(index.postings, ["beta"]).collect()} >= {"beta"} and index.of_terms(index.postings, []).count() == 0


def test_weak_query_runs_its_probes(spark, fixture_index):
    found = search(fixture_index, [Query(1, "panic", "fixture", "project"), Query(2, "HybridPersistenceCoordinator", "fixture", "project")], now=NOW)
    first = found.hits.where("query_id = 1").first()
    assert first.match_id == "m-alias" and first.original == 0 and 0 < first.expansion <= R.EXPANSION_ONLY and first.baseline == 0
    counts = {r.query_id: r for r in found.lanes.collect()}
    assert counts[1].n_expansion > 0 and counts[2].n_definition == 1
    off = search(fixture_index, [Query(1, "panic", "fixture", "project")], R.Options(expansion=False), NOW)
    assert off.hits.count() == 0
