"""Histories from folders, tails, appends, rewrites and conflicts."""

import json

import pytest

from lexforge.sources import session_ingest as G


def line(**more):
    return json.dumps(more) + "\n"


def turn(n, text, role="user"):
    return line(type=role, sessionId="s", uuid=f"u{n}", cwd="/work/a", timestamp="2026-01-01T00:00:00Z", message={"role": role, "content": text})


@pytest.fixture
def homes(tmp_path):
    places = {"codex/sessions/2026/a.jsonl": line(type="session_meta", payload={"id": "c1", "cwd": "/work/b"}) + line(type="response_item", payload={"type": "message", "role": "user", "id": "e1", "content": [{"type": "input_text", "text": "hello codex"}]}),
              "claude/projects/p/b.jsonl": turn(1, "hello claude") + turn(2, "pending").rstrip("\n"),
              "copilot/session-state/x/events.jsonl": line(type="session.start", data={"sessionId": "g1", "context": {"cwd": "/work/c"}}) + line(type="user.message", id="m1", data={"content": "hello copilot"}),
              "copilot/session-state/x/other.jsonl": "{}\n", "claude/projects/p/notes.txt": "no"}
    for name, text in places.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return G.Homes(*(str(tmp_path / a) for a in ("codex", "claude", "copilot")))


def rows(index):
    return sorted((r.agent, r.session_id, r.ordinal, r.text) for r in index.chunks().collect())


def test_folders_tails_appends_and_rewrites(spark, homes, tmp_path):
    found = G.discovered(spark, homes).collect()
    assert sorted((r.agent, r.path.rsplit("/", 1)[1]) for r in found) == [("claude", "b.jsonl"), ("codex", "a.jsonl"), ("copilot", "events.jsonl")]
    index = G.SessionIndex(spark, str(tmp_path / "index"))
    index.ingest(G.read(spark, homes), expected=0)
    start = [("claude", "s", 0, "hello claude"), ("codex", "c1", 0, "hello codex"), ("copilot", "g1", 0, "hello copilot")]
    assert rows(index) == start  # a last line without its newline waits
    assert {r.cwd for r in G.working_folders(G.read(spark, homes)).collect()} == {"/work/a", "/work/b", "/work/c"}

    own = tmp_path / "claude/projects/p/b.jsonl"
    own.write_text(turn(1, "hello claude") + turn(2, "now complete") + turn(3, "x" * 40_000, "assistant"))
    index.ingest(G.read(spark, homes), expected=1)
    grown = rows(index)
    assert [(o, len(t)) for a, _, o, t in grown if a == "claude"] == [(0, 12), (1, 12), (2, 16384), (3, 16384), (4, 7232)]
    assert [r for r in grown if r[0] != "claude"] == start[1:]

    own.write_text(turn(1, "rewritten"))
    with pytest.raises(G.Conflict):
        index.ingest(G.read(spark, homes), expected=1)
    index.ingest(G.read(spark, homes), expected=2)
    assert rows(index) == [("claude", "s", 0, "rewritten"), *start[1:]]

    own.unlink()
    index.ingest(G.read(spark, homes))
    assert rows(index) == start[1:]


def test_no_history(spark, tmp_path):
    empty = G.Homes(*(str(tmp_path / a) for a in "abc"))
    assert G.discovered(spark, empty).count() == 0
    with pytest.raises(FileNotFoundError):
        G.read(spark, empty)
