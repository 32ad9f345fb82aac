"""The two tools from arguments to responses: search, context, copies, budgets, cursors."""

import json

import pytest
from test_ranked import CHUNKS, NOW, chunk

from lexforge.operators.published import Index
from lexforge.plans.api import InvalidArguments
from lexforge.plans.tools import Tools, public_coverage

COLUMNS = CHUNKS + ", ordinal long, start_line long, end_line long, start_byte long, end_byte long"


def said(source, n, text, event=None, agent="codex"):
    return (f"m-{source}-{n}", "all", "session", f"{source}.jsonl", source, text, "2026-09-20T00:00:00.000Z", "user", agent, "s", event or f"e{n}", "message", n, n + 1, n + 1, 100 * n, 100 * n + 90)


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    rows = [said(source, n, f"turn {n} about pumps " + "é" * (3_000 if n == 2 else 0)) for source in "ab" for n in range(6)]
    rows += [(*chunk("p", "project", "src/pump.rs", "fn pump_pressure() {}", collection="all"), 0, 1, 1, 0, 21)]
    index = Index.publish(spark.createDataFrame(rows, COLUMNS), str(tmp_path_factory.mktemp("tools")))
    return Tools(index, "all", coverage={"pending": 0, "errors": 1, "excluded": 2, "diagnostics": {"binary_excluded": 2, "/home/secret": 1}})


def test_search(tools):
    out = tools.call("search_project", {"query": "pump_pressure"}, NOW)
    assert [r["path"] for r in out["results"]] == ["src/pump.rs"] and out["coverage"]["diagnostics"] == {"binary_excluded": 2, "other": 1} and out["generation"] == 1
    out = tools.call("search_sessions", {"query": "turn 3", "limit": 2, "after": "2026-09-19T02:00:00+02:00"}, NOW)
    assert out["results"][0]["match_id"] == "m-a-3" and out["results"][0]["copy_count"] == 2 and len(out["results"]) == 2
    assert tools.call("search_sessions", {"query": "turn", "before": "2026-01-01T00:00:00Z"}, NOW)["results"] == []
    with pytest.raises(InvalidArguments):
        tools.call("search_project", {"query": "x", "agent": "codex"})
    with pytest.raises(InvalidArguments):
        tools.call("other", {"query": "x"})


def test_context_pages(tools):
    out = tools.call("search_sessions", {"mode": "context", "match_id": "m-a-2", "window_before": 1, "window_after": 1})
    assert [c["event_id"] for c in out["context"]] == ["e1", "e2", "e3"] and not out["truncated"]
    texts, cursor, pages = [], None, 0
    while True:
        page = tools.call("search_sessions", {"mode": "context", "match_id": "m-a-2", "window_before": 1, "window_after": 1, "budget": 2048} | ({"cursor": cursor} if cursor else {}))
        assert len(json.dumps(page, ensure_ascii=False, separators=(",", ":")).encode()) <= 2048
        texts += [(c["event_id"], c["excerpt_byte_offset"], c["excerpt"]) for c in page["context"]]
        cursor, pages = page.get("cursor"), pages + 1
        if not cursor:
            break
    whole = {c["event_id"]: c["excerpt"] for c in out["context"]}
    assert pages > 2 and {e: "".join(t for x, _, t in texts if x == e) for e in whole} == whole
    with pytest.raises(InvalidArguments):
        tools.call("search_sessions", {"mode": "context", "match_id": "m-a-3", "cursor": json.dumps(["context", "m-a-2", 1, 0, 0])})


def test_copies_pages(tools):
    first = tools.call("search_sessions", {"mode": "copies", "match_id": "m-a-1", "limit": 1})
    assert [c["match_id"] for c in first["copies"]] == ["m-a-1"] and first["truncated"]
    second = tools.call("search_sessions", {"mode": "copies", "match_id": "m-a-1", "limit": 1, "cursor": first["cursor"]})
    assert [c["match_id"] for c in second["copies"]] == ["m-b-1"] and "cursor" not in second
    with pytest.raises(InvalidArguments, match="expired"):
        tools.call("search_sessions", {"mode": "copies", "match_id": "m-a-1", "cursor": json.dumps(["copies", "m-a-1", 0, 1])})


def test_coverage():
    assert public_coverage({})["diagnostics"] == {}
