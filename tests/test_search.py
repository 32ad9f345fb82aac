import math
from collections import Counter

import pytest

from lexforge.functions.text import text_tokens
from lexforge.operators import index as I
from lexforge.operators import search as S
from lexforge.plans.query_plan import QueryPlan, classify
from lexforge.plans.queries_search import Built, asked


def brute(docs, query):
    """BM25 over a list of texts."""
    bags = [Counter(text_tokens(d)) for d in docs]
    n, lengths = len(docs), [sum(b.values()) for b in bags]
    average = sum(lengths) / n
    out = []
    for b, length in zip(bags, lengths, strict=True):
        s = 0.0
        for t, w in Counter(text_tokens(query)).items():
            df = sum(t in x for x in bags)
            if b[t]:
                s += w * math.log(1 + (n - df + 0.5) / (df + 0.5)) * b[t] / (1.5 * (0.25 + 0.75 * length / average) + b[t])
        out.append(s)
    return out


def chunks(spark, docs):
    rows = [(str(i), "c", "project", f"src/{i}.rs", f"k{i}", d) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "match_id string, collection string, kind string, path string, source_key string, text string")


@pytest.mark.parametrize("query", ["timeout", "parseHTTPResponse", "snake_case", "http timeout", "timeout timeout", "nomatchqvx"])
def test_scores(spark, query):
    docs = ["parseHTTPResponse timeout timeout snake_case", "http Timeout in snake_case and snake", "nothing here", ""]
    found = {r.match_id: r.score for r in Built(chunks(spark, docs), ("c", "project")).hits(asked(spark, [(1, query)])).collect()}
    for i, want in enumerate(brute(docs, query)):
        assert found.get(str(i), 0.0) == pytest.approx(want, abs=1e-6)


def test_incremental_equals_batch(spark):
    """Rounds of replace, append and delete: signed deltas against a fresh count."""
    docs = {str(i): f"alpha beta_{i % 3} gamma{i}" for i in range(6)}
    table = lambda d: spark.createDataFrame([(k, "c", "project", f"s/{k}", k, t) for k, t in d.items()], "match_id string, collection string, kind string, path string, source_key string, text string")
    stats = lambda d: I.term_stats(I.postings(table(d)))
    now = stats(docs)
    for step in range(3):
        old = {"0": docs["0"]}
        docs["0"] = f"rewritten {step}"
        new = {"0": docs["0"], str(10 + step): "appended beta_1"}
        docs |= new
        now = I.merged_stats(now, I.negated(stats(old), ["doc_freq"]), stats(new), keys=[*I.SCOPE, "term"], values=["doc_freq"])
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, stats(docs).collect()))


def test_weak_and_filters(spark):
    docs = ["panic"] * 3
    hits = Built(chunks(spark, docs), ("c", "project")).hits(asked(spark, [(1, "panic")]))
    assert S.is_weak(hits).first().weak
    found = S.filtered(chunks(spark, docs), path_glob="src/[01].rs")
    assert found.count() == 2
    with pytest.raises(ValueError):
        S.glob_regex("{a,b")


def test_pool_keeps_reserved(spark):
    """201 strong lexical rows and one definition: the definition stays in the pool of 200."""
    lex = spark.createDataFrame([(1, f"m{i:03}", float(300 - i)) for i in range(201)], "query_id long, match_id string, score float")
    definition = spark.createDataFrame([(1, "zz")], "query_id long, match_id string")
    none = lex.limit(0)
    from pyspark.sql import functions as F

    pool = S.admitted(S.merged_lanes(lex, none, definition, definition.limit(0), none), F.lit(False), F.lit(False), F.lit(False)).collect()
    assert len(pool) == 200
    assert {r.match_id for r in pool if r.lane == "definition"} == {"zz"}


def test_classes_and_plans():
    assert [classify(q) for q in ("foo.rs", "Foo", "timeout", "E0308", '"x y"', "a b_c")] == ["path", "identifier", "natural", "diagnostic", "diagnostic", "mixed"]
    plan = QueryPlan.of("where is the crash")
    assert plan.original == ("crash",) and plan.stopwords_removed
    assert [p.query for p in plan.probes] == ["crashed", "crashing", "panic"]
    assert QueryPlan.of("is").original == ("is",)
    assert plan.expansion_terms() == {"crashed": 0.6, "crashing": 0.6, "panic": 0.4}
