from types import SimpleNamespace

from lexforge.operators.manifest import Manifest, Versions
from lexforge.sources.project import narrowed_changes
from lexforge.streaming.progress import HISTORY, Progress


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "index"))
    assert v.latest() is None
    first = v.publish({"postings": spark.range(3)})
    second = v.publish({"postings": spark.range(5)})
    assert (first.generation, second.generation) == (1, 2) and v.latest() == second
    assert v.read(first, "postings").count() == 3 and v.read(second, "postings").count() == 5


def test_needed():
    assert Manifest(1).needed() == "nothing" and Manifest(1, schema=1).needed() == "all" and Manifest(1, tokenizer=1).needed() == "tokens"
    assert Manifest(1, schema=2).needed() == "statistics" and Manifest(1, declarations=0).needed() == "declarations"


def test_changes():
    assert narrowed_changes([" M a.py", "R  b.py -> c.py", "?? d e.txt"], ["f.rs"]) == {"a.py", "b.py", "c.py", "d e.txt", "f.rs"}
    assert narrowed_changes([" M sub/.gitignore"], []) is None


def test_progress():
    p = Progress()
    p.onQueryStarted(None)
    for _ in range(100):
        p.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(numInputRows=2)))
    p.onQueryTerminated(SimpleNamespace(exception=None))
    s = p.snapshot()
    assert (s["phase"], s["batches"], s["rows"]) == ("finished", 100, 200) and len(s["history"]) <= HISTORY
