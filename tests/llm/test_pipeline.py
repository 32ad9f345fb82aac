"""Each stage of the pipeline against the same decisions made document by document."""

import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from lexforge.llm import minhash, quality, secrets, toxicity  # noqa: E402
from lexforge.llm.common import stored, table  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    kept = {}
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        after = stored(stage(spark, docs, sf))
        if name == "toxicity":
            memo, machine = toxicity.Memo(toxicity.learn(docs, labels)), toxicity.Grammar()
            want = {i for i, r in before.items() if toxicity.score_text(r.text, memo, machine)[0] < toxicity.THRESHOLD}
        elif name == "quality":
            shares, bias = quality.learn(docs, labels)
            memo = quality.Memo(shares)
            want = {i for i, r in before.items() if quality.score_text(r.text, memo, bias) >= quality.THRESHOLD}
        elif name == "near_dedup":
            memo = minhash.WordHash()
            sets = {i: set(minhash.shingle_set(r.text, 5, memo).tolist()) for i, r in before.items()}
            root = {i: i for i in sets}

            def find(n):
                while root[n] != n:
                    n = root[n]
                return n

            for a in sets:
                for b in sets:
                    if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
            want = {i for i in sets if find(i) == i}
        else:
            want = set(before)
        if name != "packing":
            assert after.columns == COLUMNS
            rows = after.collect()
            assert {r.doc_id for r in rows} == want and len(rows) == len(want)
            for r in rows:
                if name == "secrets":
                    assert r.text == secrets.redact_text(before[r.doc_id].text) and r.n_chars == len(r.text)
                else:
                    assert r == before[r.doc_id]
        else:
            assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == want
            sums = after.groupBy("sequence_id").sum("length").collect()
            assert max(r[1] for r in sums) <= 2048
        kept[name] = len(want)
        docs = after
    assert 0 < kept["near_dedup"] <= kept["quality"] <= kept["toxicity"]
    assert len(pipeline.STAGES) in (4, 5)


LONG = " ".join(f"word{i % 977} and{i}" for i in range(20_000))
ROWS = [(1, "The quick brown fox jumps over the lazy dog by the river"), (2, None), (3, ""), (4, LONG), (5, "The quick brown fox jumps over the lazy dog by the river"), (None, "a row without an id"), (None, None), (6, "token = abcdef99"), (6, "token = abcdef99"), (6, "another text of the same id")]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_stages_on_edge_rows(spark, sf, rows):
    """Nulls, empty and long texts, repeated rows and ids, columns with clashing names, and no rows at all."""
    clashing = ["id", "mark", "_id", "y", "c", "n", "row", "grp", "u", "v", "t", "key", "word", "set_key", "score"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars", *(f"CAST(NULL AS STRING) AS {c}" for c in clashing))
    columns, seen = docs.columns, []
    for name, stage in pipeline.STAGES:
        after = stored(stage(spark, docs, sf))
        found = after.collect()
        seen.append((name, len(found)))
        if name == "near_dedup":  # 5 is a copy of 1, and one of two equal rows stays, if they came so far
            ids = [r.doc_id for r in found]
            assert 5 not in ids or 1 not in ids
        if name == "secrets":
            assert all("abcdef99" not in (r.text or "") for r in found)
        if name == "packing":
            assert bool(found) == bool(docs.count())
        else:
            assert after.columns == columns
            docs = after
    if not rows:
        assert all(n == 0 for _, n in seen)
