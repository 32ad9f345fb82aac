from types import SimpleNamespace

import pytest

from lexforge.operators import ranking as R


def row(match_id, relevance, tier=0, text="", kind="project", **more):
    base = dict(match_id=match_id, relevance=relevance, tier=tier, text=text or match_id, kind=kind, source_key=match_id, source_version="v", start_byte=0, end_byte=10, start_line=1, end_line=1, symbols=[])
    return SimpleNamespace(**(base | more))


def test_order_dedupe_and_tiers():
    rows = [row("a", 1.0), row("b", 5.0, text="same"), row("c", 4.0, text="same"), row("d", 0.5, tier=2)]
    picked = R.select_diverse(rows, [{}] * 4, 10)
    assert [rows[i].match_id for i, _, _ in picked] == ["d", "b", "a"]
    assert picked[1][1] == ["c"]


def test_diversity():
    rows = [row("a", 1.0), row("b", 0.99), row("c", 0.9)]
    salient = [{"x": 1.0}, {"x": 1.0}, {"y": 1.0}]
    assert [rows[i].match_id for i, _, _ in R.select_diverse(rows, salient, 3)] == ["a", "c", "b"]
    off = R.Options(mmr=False)
    assert [rows[i].match_id for i, _, _ in R.select_diverse(rows, salient, 3, off)] == ["a", "b", "c"]


def test_overlap_and_structure():
    a, b = row("a", 1.0, source_key="s"), row("b", 1.0, source_key="s", start_byte=1, end_byte=11)
    assert R.overlap(a, b) == pytest.approx(0.9) and R.structural(a, b) == 0.95 and R.same_content(a, b)
    c = row("c", 1.0, source_key="s", kind="session", start_byte=50, end_byte=60, start_line=2)
    assert R.structural(row("x", 1, source_key="s", kind="session"), c) == R.ADJACENT


@pytest.mark.parametrize(("sequence", "wanted", "value"), [("a x b", {"a", "b"}, 2 / 3), ("a b", {"a", "b"}, 1.0), ("a a x a b", {"a", "b"}, 1.0), ("a", {"a", "b"}, 0.0), ("a b", {"a"}, 0.0)])
def test_proximity(sequence, wanted, value):
    assert R.nearest_cover(sequence.split(), wanted) == pytest.approx(value)


def test_weighted_jaccard():
    assert R.weighted_jaccard({"a": 2.0, "b": 1.0}, {"a": 1.0}) == pytest.approx(1 / 3)
    assert R.weighted_jaccard({}, {}) == 0.0
