import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexforge.operators import sessions as N
from lexforge.sources import project as P
from lexforge.sources import session_records as J
from lexforge.streaming.incremental import appended, checkpoints


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab\né😀", max_size=400), st.integers(1, 5), st.integers(8, 40))
def test_chunks_cover(text, lines, most):
    found = list(P.chunks(text, lines, most))
    assert "".join(c[1] for c in found) == text
    at = 0
    for n, (ordinal, part, first, last, start, end) in enumerate(found):
        assert ordinal == n and start == at and end - start == len(part.encode()) <= max(most, 4) and first <= last and part.count("\n") <= lines
        at = end


@pytest.mark.parametrize(("content", "reason"), [(b"\xff\xfea\x00", None), (b"\xef\xbb\xbfx", None), (b"\xff\xff", "unsupported_encoding"), (b"a\x00b", "binary"), (b"\x01" * 8, "binary"), ("é".encode(), None)])
def test_decode(content, reason):
    assert P.decode(content)[1] == reason


def test_discover_hidden_nested_and_links(spark, tmp_path):
    files = {
        "pkg/__init__.py": "a = 1\n", "_config.yml": "b", ".github/w.yml": "c", ".gitignore": "*.log\nbuild/\n", "pkg/.gitignore": "!keep.log\n/only.py\n", "pkg/keep.log": "k", "x.log": "no", "build/o.txt": "no", "pkg/only.py": "no",
        "pkg/sub/only.py": "yes", ".ignore": "secret.txt\n", "secret.txt": "no", ".git/info/exclude": "local.txt\n", ".git/HEAD": "no", "local.txt": "no",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "link.py").symlink_to(tmp_path / "pkg/__init__.py")
    (tmp_path / "loop").symlink_to(tmp_path)
    found = P.discover(spark, str(tmp_path))
    assert sorted(r.path for r in found.select("path").collect()) == sorted([".github/w.yml", ".gitignore", ".ignore", "_config.yml", "pkg/.gitignore", "pkg/__init__.py", "pkg/keep.log", "pkg/sub/only.py"])
    reasons = {(r.path, r.reason) for r in P.excluded_entries(P.listing(spark, str(tmp_path))).collect()}
    assert {("link.py", "symlink_excluded"), ("loop", "symlink_excluded"), (".git/HEAD", "git_metadata_excluded")} <= reasons
    assert [r.path for r in P.discover(spark, str(tmp_path), only=["_config.yml"]).collect()] == ["_config.yml"]


def test_unstable_files():
    class Growing:
        n = 0

        def get_file_info(self, path):
            self.n += 1
            return type("Info", (), {"type": 1, "size": self.n, "mtime_ns": 0})

        def open_input_file(self, path):
            import io

            return io.BytesIO(b"x")

    assert P.stable_bytes(Growing(), "p") is None and P.decode(None) == (None, "unstable_source")


def test_discover(spark, tmp_path):
    for name, text in {"a.py": "x = 1\n", "skip/b.py": "y", "keep.log": "z", "drop.log": "z", ".git/config": "g", "deep/er/c.rs": "fn main() {}\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = P.discover(spark, str(tmp_path), ["skip/", "*.log", "!keep.log"])
    assert sorted(r.path for r in found.select("path").collect()) == ["a.py", "deep/er/c.rs", "keep.log"]
    chunks, excluded = P.read_project(found, "c")
    assert chunks.count() == 3 and excluded.count() == 0
    assert P.changed(found, found.select("path", "version")).count() == 0
    assert [r.path for r in P.missing(found.where("path <> 'a.py'"), found.select("path", "version")).collect()] == ["a.py"]


def test_records(spark, tmp_path):
    folder = tmp_path / "sessions"
    folder.mkdir()
    (folder / "s.jsonl").write_text(json.dumps({"a": 1}) + "\n" + '{"b": 2}')
    rows = J.read_records(spark, [str(folder)]).orderBy("line_no").collect()
    assert [(r.line_no, r.start_byte, r.end_byte, r.complete) for r in rows] == [(1, 0, 9, True), (2, 9, 17, False)]
    assert J.read_records(spark, [str(folder)]).select(J.provider_of(F.col("path")).alias("p")).first().p == "codex"


def test_append_or_rebuild(spark):
    schema = "source_key string, start_byte long, end_byte long, digest string, complete boolean, line string"
    old = spark.createDataFrame([("a", 0, 5, "d1", True, "x"), ("b", 0, 5, "e1", True, "x")], schema)
    new = spark.createDataFrame([("a", 0, 5, "d1", True, "x"), ("a", 5, 9, "d2", True, "y"), ("a", 9, 11, "d3", False, "z"), ("b", 0, 5, "other", True, "x"), ("c", 0, 3, "f", True, "n")], schema)
    fresh, rebuild = appended(new, checkpoints(old))
    assert [(r.source_key, r.line) for r in fresh.collect()] == [("a", "y")]
    assert sorted(r.source_key for r in rebuild.collect()) == ["b", "c"]


def test_kinds_that_do_not_group(spark):
    schema = "match_id string, source_key string, path string, ordinal long, agent string, session_id string, event_id string, role string, tool string, field_kind string, text string, start_line long, end_line long, start_byte long, end_byte long"
    row = lambda i, source, kind, event="e": (i, source, source, 0, "codex", "s", event, "user", None, kind, "t", 1, 1, 0, 9)
    rows = spark.createDataFrame([row("1", "a", "message"), row("2", "b", "message"), row("3", "a", "tool_call"), row("4", "b", "tool_call"), row("5", "a", None), row("6", "b", "message", " ")], schema)
    hits = N.occurrences(rows).withColumns({"query_id": F.lit(1), "score": F.lit(1.0)})
    found = {r.match_id: r.copy_count for r in N.grouped_hits(hits).collect()}
    assert found == {"1": 2, "3": 1, "4": 1, "5": 1, "6": 1}
