import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.operators.coverage import Controller, Scope
from lexforge.plans import api as A


def test_validation():
    assert A.validated("project", {"query": "x"})["limit"] == 10
    for bad in ({"query": ""}, {"query": "x", "limit": 0}, {"query": "x", "limit": 51}, {"query": "x", "budget": 100}, {"query": "x", "what": 1}, {"query": "x", "agent": "codex"}, {"query": "x" * 9000}):
        with pytest.raises(A.InvalidArguments):
            A.validated("project", bad)
    ok = {"query": "x", "after": "2026-01-01T00:00:00Z", "before": "2026-01-02T00:00:00Z", "agent": "codex"}
    A.validated("session", ok)
    with pytest.raises(A.InvalidArguments):
        A.validated("session", ok | {"before": "2025-01-01T00:00:00Z"})
    assert A.validated("session", {"mode": "context", "match_id": "m"})["window_before"] == 2
    with pytest.raises(A.InvalidArguments):
        A.validated("session", {"mode": "copies", "match_id": "m", "query": "x"})


def test_cursor():
    text = A.Cursor("copies", "m", 3, (10,)).text()
    assert A.Cursor.parse(text, "copies", "m", 3).at == (10,)
    with pytest.raises(A.InvalidArguments, match="expired"):
        A.Cursor.parse(text, "copies", "m", 4)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é😀ß ", min_size=1, max_size=200), st.text(alphabet="abéß ", max_size=8), st.integers(8, 64))
def test_excerpt_is_a_slice(text, query, most):
    offset, excerpt = A.excerpt_window(text, query, most)
    raw = text.encode()
    assert raw[offset : offset + len(excerpt.encode())].decode() == excerpt and len(excerpt.encode()) <= most


def test_excerpt_centre():
    text = "x" * 1000 + " set " + "y" * 1000 + " setTimeout() " + "z" * 1000
    assert "setTimeout" in A.excerpt_window(text, "setTimeout", 64)[1]
    assert "error: code" in A.excerpt_window("a" * 500 + " error: code " + "b" * 500, "error code", 64)[1]


def test_budget():
    response = {"results": [{"excerpt": "a" * 2000}, {"excerpt": "b" * 2000}]}
    out = A.fitted(response, 1024, "a")
    assert len(out["results"]) == 1 and out["truncated"] and out["results"][0]["excerpt_truncated"]


def test_controller():
    c = Controller()
    c.observe(Scope(frozenset({"a"})))
    ticket, scope = c.start()
    token = c.token()
    c.observe(Scope(frozenset({"b"})))
    assert c.start() is None and not c.still_valid(token)
    assert not c.finish(ticket + 1, True) and c.finish(ticket, False)
    assert c.start()[1].paths is None
    assert Scope(frozenset(map(str, range(1000)))).merged(Scope(frozenset(map(str, range(900, 1100))))).paths is None
