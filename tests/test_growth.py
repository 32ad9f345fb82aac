"""What keeps work in proportion to the input: each row counts its own terms, and its two ways agree."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import published
from lexforge.operators.index import unreachable_terms
from lexforge.plans import catalog
from lexforge.plans.queries_search import Built, asked

CHARS = [chr(i) for i in range(0x2200) if re.match(f"[{T.TWIN}]", chr(i))]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_twin_characters(spark):
    """Every character is of one of the two classes, and its classes and fold in Java are those of the twin."""
    ids = F.col("id").cast("int")
    char = F.when(ids < 0x80, F.char(ids)).otherwise(F.decode(F.unhex(F.concat(F.hex(F.shiftright(ids, 6) + 0xC0), F.hex(ids.bitwiseAND(0x3F) + 0x80))), "UTF-8"))
    rows = spark.createDataFrame([(c,) for c in [*CHARS, "ɐ", "‏", " ", " ", "₫", "₭", "\U0001f600"]], "c string")
    assert {r.c for r in rows.where(F.col("c").rlike(T.NO_TWIN)).collect()}.isdisjoint(CHARS) and rows.where(F.col("c").rlike(T.NO_TWIN)).count() == 7
    assert spark.range(0x250).where(char.rlike(T.NO_TWIN)).count() == 0
    for r in rows.select("c", F.col("c").rlike(rf"^[{T.ALNUM}]$").alias("alnum"), T.fold(F.col("c")).alias("fold")).where(~F.col("c").rlike(T.NO_TWIN)).collect():
        assert (bool(T._ALNUM.match(r.c)), T.fold_text(r.c)) == (r.alnum, r.fold), hex(ord(r.c))


def test_twin_counts(spark):
    rng = random.Random(7)
    words = ["Foo", "bar.", "FOO", "12", "x_y", "HTTPServer/a:b.", "Straße", "ſtraße", "ÀB", "a" * 300, "A" * 300 + ".", "...", "x-", "_", "7.", "HTTP2", "aBc\\"]
    texts = ["".join(rng.choice([rng.choice(words), rng.choice(CHARS), " ", " "]) for _ in range(60)) for _ in range(200)] + ["", "ΑΣ foo ΑΣ. Foo \U0001f600 bar"]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "id int, text string")
    native = {r.id: {c.term: c.tf for c in r.c or ()} for r in rows.select("id", T.term_counts(F.col("text")).alias("c")).collect()}
    assert all(native[i] == T.text_counts(t, {}) for i, t in enumerate(texts[:-1]))
    found: dict[int, dict] = {}
    for r in T.frequencies(rows, "id", "text").collect():
        found.setdefault(r.id, {})[r.term] = r.tf
    assert found == {i: c for i, c in native.items() if c}
    assert all(Counter(T.text_tokens(t)) == native[i] for i, t in enumerate(texts))


def test_repeated_keys_count_together(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "B \U0001f600 c"), (None, "x"), (None, "x"), (2, "b"), (3, None)], "id int, text string")
    want = {(1, "a", 1), (1, "b", 2), (1, "c", 1), (None, "x", 2), (2, "b", 1)}
    assert sorted(map(repr, map(tuple, T.frequencies(rows, "id", "text").collect()))) == sorted(map(repr, want))


def test_terms_are_not_shuffled(spark, sf):
    for name in ("tokenize_documents", "tokenize_pages"):
        text = plan(catalog.queries()[name](spark, sf))
        assert "Exchange" not in text and "Aggregate" not in text, name
    assert plan(catalog.queries()["incremental_stats"](spark, sf)).count("Aggregate") <= 10


def rows_of(spark, docs):
    rows = [(str(i), "c", "project", f"src/{i}.rs", f"k{i}", d) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "match_id string, collection string, kind string, path string, source_key string, text string")


def test_scores_are_dealt_out_by_match(spark):
    """Terms of many queries meet postings that already lie by match: no exchange of (query, match)."""
    built = Built(rows_of(spark, ["a b c", "b c d", "x"]), ("c", "project"))
    hits = built.hits(asked(spark, [(1, "a b b"), (2, "c d")]))
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, match_id", plan(hits)) and len(hits.collect()) == 4


def test_tasks_follow_the_texts(spark, monkeypatch):
    rows = rows_of(spark, ["a" * 100] * 30)
    assert published.tasks_for(rows) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(published, "TASK_BYTES", 100)
    assert published.tasks_for(rows) == 30 and published.tasks_for(rows.limit(0)) == spark.sparkContext.defaultParallelism


def sorted_by_task(spark, tmp_path, monkeypatch, docs, **bounds) -> list[int]:
    """Postings that each task of a build sorts, by the files it writes."""
    for name, value in bounds.items():
        monkeypatch.setattr(published, name, value, raising=False)
    posted = published.Index.publish(rows_of(spark, docs), f"file://{tmp_path}/index", texts=False).postings
    task = F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)
    return [r["count"] for r in posted.groupBy(task.alias("task")).count().collect()]


def test_tasks_of_an_index_are_even(spark, tmp_path, monkeypatch):
    docs = [" ".join(f"w{i}x{j}" for j in range(100)) for i in range(40)]
    size = sum(map(len, docs)) // 128
    found = sorted_by_task(spark, tmp_path, monkeypatch, docs, TASK_BYTES=size, SORT_BYTES=size)
    assert max(found) <= 2.5 * sum(found) / 128


def test_a_term_of_every_chunk_is_dealt_out(spark, tmp_path, monkeypatch):
    assert max(sorted_by_task(spark, tmp_path, monkeypatch, ["the"] * 80, SORT_CHUNKS=20)) <= 40


def test_texts_of_many_tasks_are_dealt_out(spark, tmp_path, monkeypatch):
    """Tasks that keep postings in memory as they shuffle them make those of TASK_BYTES."""
    splits, made = [], published.I.postings
    monkeypatch.setattr(published.I, "postings", lambda rows: splits.append(rows.rdd.getNumPartitions()) or made(rows))
    sizes = sorted_by_task(spark, tmp_path, monkeypatch, ["a" * 100] * 60, TASK_BYTES=400, SORT_BYTES=100, MERGED=40)
    assert sum(sizes) == 60 and splits[0] >= 15


def test_neighbours_are_shuffled_once(spark, sf):
    assert plan(catalog.queries()["weighted_jaccard"](spark, sf)).count("Exchange") == 1


def test_fields_do_not_read_texts_again(spark, sf):
    assert "text" not in "".join(re.findall(r"ReadSchema: \S+", plan(catalog.queries()["field_scores_project"](spark, sf))))


def test_vocabulary_is_looked_up_first(spark):
    posted = spark.createDataFrame([("a",), ("b",), ("b",)], "term string")
    found = unreachable_terms(spark.createDataFrame([("b",), ("c",)], "term string"), posted)
    assert "LeftSemi" in plan(found) and [r.term for r in found.collect()] == ["c"]
