"""Queries: plans, lanes, the pool, field scores, tiers, decay, proximity, diversity, quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as C
from ..functions import text as T
from ..operators import index as I
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import search as S
from ..operators.published import tasks_for
from ..sources.shared import stored
from . import oracle as O
from .api import excerpt_window
from .queries_search import TALK_SCOPE, Built, asked, best, doc_chunks, published, table, talk_chunks
from .query_plan import EXTENSIONS, QueryPlan, classified
from .ranked import Query, search

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


NOW = "2026-09-21 00:00:00"
#: Ids that are compared with their neighbours in one task.
STRETCH = 64
ASKED = [
    (1, '"connection reset"', "diagnostic"), (2, "E0308", "diagnostic"), (3, "ts2345", "diagnostic"), (4, "ERR_CONN", "diagnostic"), (5, "error[E1]", "diagnostic"), (6, "src/lib", "path"), (7, "main.rs", "path"), (8, "a\\b", "path"),
    (9, "parse_http", "identifier"), (10, "Foo::bar", "identifier"), (11, "foo.bar", "identifier"), (12, "ManagerV2", "identifier"), (13, "how does parse_http work", "mixed"), (14, "where is the crash", "natural"), (15, "timeout", "natural"), (16, "is", "natural"), (17, "  Cargo.TOML ", "path"), (18, "E1", "identifier"),
]


@query(
    rf"""SELECT query_id, CASE WHEN (starts_with(q, '"') AND ends_with(q, '"') AND strlen(q) > 2) OR regexp_matches(q, '(?i)^(((E|TS|CS|C)[0-9][0-9]+$)|ERR_|ERR-|ERROR\[|WARNING\[)') THEN 'diagnostic'
    WHEN NOT regexp_matches(q, '\s') AND regexp_matches(q, '[/\\]|\.(?i:{'|'.join(EXTENSIONS)})$') THEN 'path' WHEN NOT regexp_matches(q, '\s') AND regexp_matches(q, '_|::|\.|\p{{Lu}}') THEN 'identifier'
    WHEN regexp_matches(q, '_|::|/') THEN 'mixed' ELSE 'natural' END AS class FROM (SELECT query_id, trim(query) AS q FROM {O.values([a[:2] for a in ASKED], 'query_id, query')})"""
)
def query_classify(spark, sf_dir):
    return spark.createDataFrame([a[:2] for a in ASKED], "query_id int, query string").select("query_id", classified(F.col("query")).alias("class"))


PLANNED = [(1, "where is the crash", "crash"), (2, "how to fix the deleted file", "fix deleted file"), (3, "is it", "is it"), (4, "parse_http", "parse parse_http http"), (5, "kill the panic", "kill panic")]


@query(f"SELECT query_id, unnest(string_split(terms, ' ')) AS term FROM {O.values([(i, t) for i, _, t in PLANNED], 'query_id, terms')}")
def query_terms(spark, sf_dir):
    rows = [(i, t) for i, q, _ in PLANNED for t in QueryPlan.of(q).original]
    return spark.createDataFrame(rows, "query_id int, term string")


PROBED = [
    (1, 1, "crashed", 0.6, "morphology"), (1, 2, "crashing", 0.6, "morphology"), (1, 3, "panic", 0.4, "alias"), (2, 1, "fixed", 0.6, "morphology"), (2, 2, "fixing", 0.6, "morphology"), (2, 3, "delete", 0.6, "morphology"),
    (2, 4, "deleting", 0.6, "morphology"), (2, 5, "deletion", 0.6, "morphology"), (5, 1, "terminate", 0.4, "alias"), (5, 2, "crash", 0.4, "alias"),
]


@query(f"SELECT * FROM {O.values(PROBED, 'query_id, place, probe, weight, origin')}")
def query_probes(spark, sf_dir):
    rows = [(i, n, p.query, p.weight, p.origin) for i, q, _ in PLANNED for n, p in enumerate(QueryPlan.of(q).probes, 1)]
    return spark.createDataFrame(rows, "query_id int, place int, probe string, weight double, origin string")


@query(f"WITH a AS (SELECT match_id, term FROM {O.tf(O.DOCS, 'match_id')}) SELECT term, count(*) AS n, CAST(term IN ({', '.join(map(O.lit, T.STOPWORDS))}) AS BOOLEAN) AS stop, CAST(term IN ({', '.join(map(O.lit, (*T.STOPWORDS, *T.GENERIC)))}) OR strlen(term) < 2 AS BOOLEAN) AS generic FROM a GROUP BY term")
def term_classes(spark, sf_dir):
    terms = Built(doc_chunks(spark, sf_dir)).df.select("term", F.col("doc_freq").alias("n"))
    return terms.select("term", "n", F.col("term").isin(*T.STOPWORDS).alias("stop"), (F.col("term").isin(*T.STOPWORDS, *T.GENERIC) | (F.octet_length("term") < 2)).alias("generic"))


MEANT = [(1, "stupid trash")]


@query(f"WITH {O.scored(O.DOCS, O.values(MEANT, 'query_id, query'))} {O.top(40)}")
def meaningful_lane(spark, sf_dir):
    """Natural words without their stopwords, top 40."""
    plan = QueryPlan.of("the stupid in the trash")
    return best(Built(doc_chunks(spark, sf_dir)).hits(asked(spark, [(1, " ".join(plan.original))])), S.RESERVE)


GATED = [(1, "trash"), (2, "the"), (3, "thanedble attion"), (4, "nomatchqvx")]


@query(f"WITH {O.scored(O.DOCS, O.values(GATED, 'query_id, query'))}, lex AS ({O.top(200, columns='query_id, score')}) SELECT query_id, count(score) < 20 OR max(score) < 0.25 OR count(score) = 0 AS weak FROM {O.values(GATED, 'query_id, query')} LEFT JOIN lex USING (query_id) GROUP BY 1")
def expansion_lane_gate(spark, sf_dir):
    lexical = S.top(Built(doc_chunks(spark, sf_dir)).hits(asked(spark, GATED)), S.TOP)
    every = spark.createDataFrame(GATED, "query_id long, query string").select("query_id")
    return every.join(S.is_weak(lexical), "query_id", "left").select("query_id", F.coalesce("weak", F.lit(True)).alias("weak"))


def lanes(spark, sf_dir):
    """Lexical, meaningful and expansion lanes of a weak and a strong query; definitions and paths by rule."""
    b = Built(doc_chunks(spark, sf_dir))
    rows = b.hits(asked(spark, [(1, "the stupid trash"), (2, "trash")]))
    lexical = S.top(rows, 60)
    meaningful = S.top(b.hits(asked(spark, [(1, "stupid trash")])), S.RESERVE)
    expansion = S.top(b.hits(asked(spark, [(2, "idiot clown")])), S.TOP)
    definition = b.chunks.where(F.col("text").startswith("The ")).select(F.lit(1).cast("long").alias("query_id"), "match_id")
    path = S.path_lane(b.chunks, "11.txt").select(F.lit(2).cast("long").alias("query_id"), "match_id")
    return S.merged_lanes(lexical, meaningful, definition, path, expansion)


LANES = f"""{O.scored(O.DOCS, O.values([(1, 'the stupid trash'), (2, 'trash'), (11, 'stupid trash'), (12, 'idiot clown')], 'query_id, query'))},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS r FROM hits),
  every AS (SELECT query_id, match_id, score AS raw_bm25, NULL::FLOAT AS meaningful_bm25, NULL::BOOLEAN AS definition, NULL::BOOLEAN AS path, NULL::FLOAT AS expansion_bm25 FROM ranked WHERE query_id < 10 AND r <= 60
    UNION ALL SELECT 1, match_id, NULL, score, NULL, NULL, NULL FROM ranked WHERE query_id = 11 AND r <= 40 UNION ALL SELECT 2, match_id, NULL, NULL, NULL, NULL, score FROM ranked WHERE query_id = 12 AND r <= 200
    UNION ALL SELECT 1, match_id, NULL, NULL, TRUE, NULL, NULL FROM src WHERE starts_with(text, 'The ') UNION ALL SELECT 2, match_id, NULL, NULL, NULL, TRUE, NULL FROM src WHERE ends_with(path, '/11.txt')),
  lanes AS MATERIALIZED (SELECT CAST(query_id AS BIGINT) AS query_id, match_id, max(raw_bm25) AS raw_bm25, max(meaningful_bm25) AS meaningful_bm25, bool_or(definition) AS definition, bool_or(path) AS path, max(expansion_bm25) AS expansion_bm25 FROM every GROUP BY 1, 2)"""


@query(f"WITH {LANES} SELECT query_id, count(raw_bm25) AS n_lexical, count(meaningful_bm25) AS n_meaningful, count(definition) AS n_definition, count(path) AS n_path, count(expansion_bm25) AS n_expansion FROM lanes GROUP BY 1")
def lane_counts(spark, sf_dir):
    return S.lane_counts(lanes(spark, sf_dir))


@query(f"""WITH {LANES},
  d AS (SELECT query_id, match_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(raw_bm25, 0) DESC, match_id) AS r FROM lanes WHERE definition) WHERE r <= 40),
  m AS (SELECT query_id, match_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY meaningful_bm25 DESC, match_id) AS r FROM lanes ANTI JOIN d USING (query_id, match_id) WHERE meaningful_bm25 IS NOT NULL) WHERE r <= 40),
  x AS (SELECT query_id, match_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(expansion_bm25, 0) DESC, match_id) AS r FROM lanes ANTI JOIN d USING (query_id, match_id) WHERE query_id = 2 AND raw_bm25 IS NULL) WHERE r <= 40),
  kept AS (SELECT *, 'definition' AS lane FROM d UNION ALL SELECT *, 'meaningful' FROM m UNION ALL SELECT *, 'expansion' FROM x),
  f AS (SELECT query_id, match_id, 'fill' AS lane FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_bm25 IS NOT NULL DESC, coalesce(raw_bm25, 0) DESC, match_id) AS r FROM lanes ANTI JOIN kept USING (query_id, match_id)) LEFT JOIN (SELECT query_id, count(*) AS n FROM kept GROUP BY 1) USING (query_id) WHERE r <= 200 - coalesce(n, 0))
  SELECT query_id, match_id, lane, row_number() OVER (PARTITION BY query_id ORDER BY raw_bm25 IS NOT NULL DESC, coalesce(raw_bm25, 0) DESC, match_id) AS position FROM (SELECT * FROM kept UNION ALL SELECT * FROM f) JOIN lanes USING (query_id, match_id)""")
def admission_pool(spark, sf_dir):
    pool = S.admitted(lanes(spark, sf_dir), F.lit(False), F.lit(False), F.col("query_id") == 2)
    return pool.select("query_id", "match_id", "lane", F.col("position").cast("long").alias("position"))


WANTED = ["stupid", "trash", "the"]


@query(f"""WITH {O.index(O.TALKS)}, q(term) AS (VALUES ('the'), ('of'), ('and')),
  shares AS (SELECT match_id, term, CASE WHEN role = 'user' THEN 3.0::DOUBLE ELSE 1.5::DOUBLE END * tf / (0.1::DOUBLE + 0.9::DOUBLE * length / 128) AS share FROM post JOIN q USING (term) JOIN len USING (match_id) JOIN src USING (match_id))
  SELECT match_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * share / (1.5::DOUBLE + share)), 6) AS score FROM shares JOIN df USING (term) CROSS JOIN st GROUP BY 1""")
def field_scores_session(spark, sf_dir):
    """The body field of every session chunk by its role."""
    b = Built(talk_chunks(spark, sf_dir), TALK_SCOPE)
    fields = b.chunks.select("match_id", R.body_field().alias("field"))
    terms = spark.createDataFrame([(1, t, 1.0) for t in ("the", "of", "and")], "query_id long, term string, evidence double").join(b.df.select("term", "doc_freq"), "term", "left")
    counts = b.posted.join(terms.select("term"), "term", "left_semi").join(b.lengths, ["match_id", "collection", "kind"]).join(fields, "match_id")
    n = b.stats.first().doc_count
    return R.field_scores(R.field_shares(counts, F.lit(0.0)), terms, F.lit(n)).select("match_id", F.round("score", 6).alias("score"))


@query(f"""WITH {O.index(O.DOCS)}, q(term) AS (VALUES ('src0'), ('txt'), ('trash'), ('stupid')), fl AS (SELECT match_id, 'path' AS field, path AS value FROM src UNION ALL SELECT match_id, 'basename', regexp_extract(path, '[^/]*$') FROM src UNION ALL SELECT match_id, 'body', text FROM src),
  ft AS (SELECT match_id, field, term, tf FROM {O.tf('fl', 'match_id, field', 'value')}), flen AS (SELECT match_id, field, sum(tf) AS length FROM ft GROUP BY 1, 2),
  shares AS (SELECT match_id, term, sum(CASE field WHEN 'path' THEN 4.0::DOUBLE * tf WHEN 'basename' THEN 5.0::DOUBLE * tf ELSE tf / (0.25::DOUBLE + 0.75::DOUBLE * length / greatest(total::DOUBLE / n, 1)) END) AS share FROM ft JOIN flen USING (match_id, field) JOIN q USING (term) CROSS JOIN st GROUP BY 1, 2)
  SELECT match_id, round(sum(coalesce(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1) * share / (1.5::DOUBLE + share)), 6) AS score FROM shares LEFT JOIN df USING (term) CROSS JOIN st GROUP BY 1""")
def field_scores_project(spark, sf_dir):
    b = Built(doc_chunks(spark, sf_dir))
    chunks = b.chunks.withColumns({"field_kind": F.lit(None).cast("string"), "role": F.lit(None).cast("string")})
    names = ("src0", "txt", "trash", "stupid")
    terms = spark.createDataFrame([(1, t, 1.0) for t in names], "query_id long, term string, evidence double").join(b.index.of_terms(b.index.df, names).select("term", "doc_freq"), "term", "left")
    stats = b.stats.first()
    asked_ = F.broadcast(terms.select("term"))
    # the index knows the body: only paths are taken apart
    fields = R.field_texts(chunks.withColumn("text", F.lit(""))).where(F.col("field").isin("path", "basename"))
    counted = T.frequencies(fields, ["match_id", "field"], "value")
    sizes = counted.groupBy("match_id", "field").agg(F.sum("tf").alias("length"))
    side = counted.join(asked_, "term", "left_semi").join(sizes, ["match_id", "field"]).select("match_id", "field", "term", "tf", "length")
    posted = b.index.of_terms(b.index.postings, names).join(asked_, "term", "left_semi")
    body = posted.join(b.lengths.select("match_id", "length").distinct(), "match_id").select("match_id", F.lit("body").alias("field"), "term", "tf", "length")
    counts = side.unionByName(body)
    return R.field_scores(R.field_shares(counts, F.lit(stats.total_tokens / stats.doc_count)), terms, F.lit(stats.doc_count)).select("match_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, CASE WHEN a > 0 THEN least(b, a * 0.35::DOUBLE) ELSE least(b, 0.5::DOUBLE) END AS capped FROM (SELECT doc_id, (n_chars % 7)::DOUBLE AS a, (n_chars % 11)::DOUBLE / 4 AS b FROM documents)")
def expansion_cap(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 7).cast("double").alias("a"), ((F.col("n_chars") % 11).cast("double") / 4).alias("b"))
    return rows.select("doc_id", R.capped_expansion(F.col("a"), F.col("b")).alias("capped"))


EXACT = [
    (1, "project", "src/lib.rs", "fn parse_http() {}", "identifier", "parse_http", "symbol", 2), (2, "project", "src/lib.rs", "void Foo::bar(int x) {}", "identifier", "foo::bar", "qualified_symbol", 2), (3, "project", "a/x.rs", "see Foo::bar", "identifier", "foo::bar", "historical_identity", 1),
    (4, "session", "", "call parse_http now", "identifier", "parse_http", "historical_identity", 1), (5, "project", "src/lib.rs", "", "path", "lib.rs", "basename", 2), (6, "project", "src/lib.rs", "", "path", "src/lib.rs", "full_path", 2), (7, "project", "src/mylib.rs", "", "path", "lib.rs", None, 0),
    (8, "session", "", "open src/lib.rs", "path", "src/lib.rs", "historical_identity", 1), (9, "project", "x", "got E0308 here", "diagnostic", "e0308", "diagnostic", 2), (10, "project", "x", "got E03081", "diagnostic", "e0308", None, 0), (11, "project", "x", "mention parse_http", "identifier", "parse_http", None, 0), (12, "project", "x", "anything", "natural", "anything", None, 0),
]


@query(f"SELECT id, exact, tier FROM {O.values([(e[0], e[6], e[7]) for e in EXACT], 'id, exact, tier')}")
def exact_tier(spark, sf_dir):
    rows = spark.createDataFrame([e[:6] for e in EXACT], "id int, kind string, path string, text string, class string, literal string")
    whole = F.transform(T.occurrences(F.col("text")), lambda o: T.fold(F.regexp_replace(o, r"[-.:/\\]+$", "")))
    rows = rows.withColumns({"symbols": R.declared_symbols(F.col("text")), "identities": whole, "surfaces": F.array_union(T.tokens(F.col("text")), whole)})
    exact = R.exact_class(F.col("class"), F.col("literal"))
    return rows.select("id", exact.alias("exact"), R.tier(exact).alias("tier"))


@query(f"SELECT match_id, round(0.25::DOUBLE + 0.75::DOUBLE * pow(2, -greatest(0, epoch(TIMESTAMP '{NOW}') - epoch(CAST(replace(timestamp, 'Z', '') AS TIMESTAMP))) / 86400.0::DOUBLE / 45), 9) AS decay FROM {O.TALKS}")
def temporal_decay(spark, sf_dir):
    at = F.col("timestamp").cast("timestamp")
    return talk_chunks(spark, sf_dir).select("match_id", F.round(C.temporal_factor(at, f"{NOW}Z".replace(" ", "T"), F.lit(False), F.lit(False)), 9).alias("decay"))


@query("""WITH d AS (SELECT doc_id // 100 AS query_id, doc_id, CASE WHEN text = '' THEN CAST(doc_id AS VARCHAR) ELSE 'x' || text END AS k FROM documents)
  SELECT query_id, CAST(min(doc_id) AS VARCHAR) AS match_id, count(*) - 1 AS n_collapsed, list_sort(list(CAST(doc_id AS VARCHAR)) FILTER (doc_id <> least)) AS collapsed
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY query_id, k) AS least FROM d) GROUP BY query_id, k""")
def content_dedupe(spark, sf_dir):
    """The diverse selection over groups of a hundred documents: equal texts fall to the most relevant of them, here the one with the least id."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.floor(F.col("doc_id") / 100).alias("query_id"), F.col("doc_id").cast("string").alias("match_id"), F.lit("project").alias("kind"), F.col("doc_id").cast("string").alias("source_key"), F.lit("v").alias("source_version"), "text", F.array().cast("array<string>").alias("symbols"),
        F.lit(None).cast("map<string,double>").alias("salient"), *(F.lit(k).cast("long").alias(c) for c, k in (("start_byte", 0), ("end_byte", 1), ("start_line", 1), ("end_line", 1))), F.lit(None).cast("string").alias("exact"), F.lit(0).alias("tier"), F.lit("fill").alias("lane"),
        F.lit(1.0).alias("baseline"), F.lit(1.0).alias("original"), F.lit(0.0).alias("expansion"), (1.0 / (1 + F.col("doc_id") % 100)).alias("lexical"), F.lit(1.0).alias("decay"))
    picked = R.rerank(rows, S.POOL, R.Options(proximity=False, mmr=False))
    return picked.select("query_id", "match_id", "n_collapsed", F.when(F.size("collapsed") > 0, F.array_sort("collapsed")).alias("collapsed"))


@query(f"""WITH t AS (SELECT match_id, term, 1.0::DOUBLE + strlen(term) AS w FROM {O.tf(O.DOCS, 'match_id')}), s AS (SELECT match_id, sum(w) AS total FROM t GROUP BY 1),
  p AS (SELECT a.match_id AS a, b.match_id AS b FROM s a JOIN s b ON CAST(b.match_id AS BIGINT) = CAST(a.match_id AS BIGINT) + 1), o AS (SELECT a, b, sum(x.w) AS common FROM p JOIN t x ON x.match_id = a JOIN t y ON y.match_id = b AND x.term = y.term GROUP BY 1, 2)
  SELECT a, b, round(coalesce(common, 0) / (sa.total + sb.total - coalesce(common, 0)), 9) AS similarity FROM p LEFT JOIN o USING (a, b) JOIN s sa ON sa.match_id = a JOIN s sb ON sb.match_id = b""")
def weighted_jaccard(spark, sf_dir):
    """Of every document with the next one, over all their terms."""
    chunks, w, n = doc_chunks(spark, sf_dir), (1.0 + F.octet_length("term")).alias("w"), F.col("match_id").cast("long")
    # stretches of ids, each with the last id before it, so that both of a pair lie in one stretch; terms are shuffled once
    own, next_ = F.floor(n / STRETCH), F.floor((n + 1) / STRETCH)
    rows = I.postings(chunks.where(n.isNotNull())).select(n.alias("n"), "term", F.explode(F.array_distinct(F.array(own, next_))).alias("stretch")).repartition(tasks_for(chunks), "stretch")
    maps = rows.groupBy("stretch", "n").agg(F.map_from_entries(F.collect_list(F.struct("term", w))).alias("m"))
    before = Window.partitionBy("stretch").orderBy("n")
    both = maps.withColumns({"na": F.lag("n").over(before), "ma": F.lag("m").over(before)}).where("na = n - 1")
    return both.select(F.col("na").cast("string").alias("a"), F.col("n").cast("string").alias("b"), F.round(C.weighted_jaccard(F.col("ma"), F.col("m")), 9).alias("similarity"))


@query(r"""WITH w AS (SELECT doc_id, unnest(list) AS t, generate_subscripts(list, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS list FROM documents)), m AS (SELECT * FROM w WHERE t IN ('the', 'thin')),
  n AS (SELECT a.doc_id, min(abs(a.i - b.i)) + 1 AS best FROM m a ASOF JOIN m b ON a.doc_id = b.doc_id AND a.i > b.i WHERE a.t <> b.t GROUP BY 1) SELECT doc_id, 2.0::DOUBLE / best AS proximity FROM n""")
def proximity(spark, sf_dir):
    """The shortest stretch of words that holds both of two."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("words"))

    def near(batches):
        for batch in batches:
            yield batch.assign(proximity=[R.nearest_cover(list(w), {"the", "thin"}) for w in batch.words])[["doc_id", "proximity"]]

    return rows.where("words IS NOT NULL").mapInPandas(near, "doc_id long, proximity double").where("proximity > 0")


RANKED = [(1, "the stupid trash"), (2, "worthless clown"), (3, "11.txt")]
RANKED_TERMS = [(1, "stupid"), (1, "trash"), (2, "worthless"), (2, "clown"), (3, "11.txt"), (3, "11"), (3, "txt")]


@query(rf"""WITH {O.scored(O.DOCS, O.values(RANKED, 'query_id, query'))}, plan AS {O.values(RANKED_TERMS, 'query_id, term')},
  cand AS (SELECT query_id, match_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS r FROM hits) WHERE r <= 200 UNION SELECT 3, match_id FROM src WHERE ends_with(path, '/11.txt')),
  lines AS (SELECT match_id, unnest(string_split(text, chr(10))) AS line FROM src),
  fl AS (SELECT match_id, 'path' AS field, path AS value FROM src UNION ALL SELECT match_id, 'basename', regexp_extract(path, '[^/]*$') FROM src
    UNION ALL SELECT match_id, 'doc_comment', string_agg(line, chr(10)) FROM lines WHERE regexp_matches(line, '^\s*(///|/\*\*)') GROUP BY 1 UNION ALL SELECT match_id, 'comment', string_agg(line, chr(10)) FROM lines WHERE regexp_matches(line, '^\s*(//|#)') GROUP BY 1),
  ft AS (SELECT match_id, field, term, tf FROM {O.tf('fl', 'match_id, field', 'value')} UNION ALL SELECT match_id, 'body', term, tf FROM post), flen AS (SELECT match_id, field, sum(tf) AS length FROM ft GROUP BY 1, 2),
  shares AS (SELECT query_id, match_id, term, sum(CASE field WHEN 'path' THEN 4.0::DOUBLE * tf WHEN 'basename' THEN 5.0::DOUBLE * tf WHEN 'doc_comment' THEN 2.0::DOUBLE * tf / (0.5::DOUBLE + 0.5::DOUBLE * length / 64)
    WHEN 'comment' THEN 1.5::DOUBLE * tf / (0.5::DOUBLE + 0.5::DOUBLE * length / 64) ELSE tf / (0.25::DOUBLE + 0.75::DOUBLE * length / greatest(total::DOUBLE / n, 1)) END) AS share
    FROM cand JOIN plan USING (query_id) JOIN ft USING (match_id, term) JOIN flen USING (match_id, field) CROSS JOIN st GROUP BY 1, 2, 3),
  rel AS (SELECT query_id, match_id, sum(coalesce(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1) * share / (1.5::DOUBLE + share)) AS relevance FROM shares LEFT JOIN df USING (term) CROSS JOIN st GROUP BY 1, 2),
  tiers AS (SELECT query_id, match_id, coalesce(relevance, 0) AS relevance, CASE WHEN query_id = 3 AND ends_with(path, '/11.txt') THEN 2 ELSE 0 END AS tier FROM cand LEFT JOIN rel USING (query_id, match_id) JOIN src USING (match_id))
  SELECT CAST(query_id AS BIGINT) AS query_id, match_id, position, tier, round(relevance, 6) AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier DESC, round(relevance, 9) DESC, match_id) AS position FROM tiers WHERE relevance > 0 OR tier > 0) WHERE position <= 10""")
def ranked_search(spark, sf_dir):
    """The whole way for a batch, up to the order by tier and relevance; proximity, copies and diversity are looked at by tests."""
    hits = search(published(doc_chunks(spark, sf_dir)), [Query(i, q, "docs", "project") for i, q in RANKED], R.Options(proximity=False, dedupe=False, mmr=False), NOW).hits
    return hits.select("query_id", "match_id", "position", "tier", F.round("relevance", 6).alias("relevance"))


@query()
def ranked_search_whole(spark, sf_dir):
    """Every stage, over sessions: filters, expansion of a weak query, decay, proximity, copies and diversity."""
    index = published(talk_chunks(spark, sf_dir))
    asked_ = [Query(1, "the of and", "talks", "session", agent="claude"), Query(2, "crash", "talks", "session"), Query(3, "thanedble attion", "talks", "session", after="2026-01-02T00:00:00.000Z")]
    return search(index, asked_, now=NOW).hits.drop("collapsed")


@query()
def excerpt_windows(spark, sf_dir):
    """Excerpts of the ten best hits: final hits only."""
    hits = best(Built(doc_chunks(spark, sf_dir)).hits(asked(spark, [(1, "stupid trash")])), 10)
    rows = hits.join(doc_chunks(spark, sf_dir).select("match_id", "text"), "match_id").select("match_id", "text").collect()
    return spark.createDataFrame([(r.match_id, *excerpt_window(r.text, "stupid trash")) for r in rows], "match_id string, byte_offset int, excerpt string")


@query(f"""WITH {O.scored(O.DOCS, '(SELECT item_id AS query_id, text AS query FROM benchmark)')}, ranked AS ({O.top(10)}),
  r AS (SELECT query_id, split_part(path, '/', 1) AS source, rank, md5(text) AS text_key FROM ranked JOIN src USING (match_id)), judged AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS source, 3 AS grade FROM benchmark UNION ALL SELECT item_id, 'src0', 1 FROM benchmark WHERE item_id % 20 <> 0),
  f AS (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), source) AS i FROM r GROUP BY query_id, source),
  g AS (SELECT f.query_id, i, coalesce(grade, 0) AS grade FROM f LEFT JOIN judged USING (query_id, source) WHERE i <= 10),
  o AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(i + 1)) AS dcg, min(CASE WHEN grade > 0 THEN i END) AS first, count(*) FILTER (grade > 0) AS hits FROM g GROUP BY 1),
  b AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(i + 1)) AS ideal, count(*) AS wanted FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, source) AS i FROM judged) GROUP BY 1),
  d AS (SELECT query_id, 1 - count(DISTINCT text_key) / count(*) AS duplicate_rate FROM r GROUP BY 1)
  SELECT query_id, round(coalesce(hits / wanted, 0), 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(duplicate_rate, 0), 6) AS duplicate_rate FROM b LEFT JOIN o USING (query_id) LEFT JOIN d USING (query_id)""")
def retrieval_metrics(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    chunks = doc_chunks(spark, sf_dir)
    ranked = best(Built(chunks).hits(S.query_terms(bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))), 10)
    # scored once, and texts of winners only
    ranked = stored(ranked)
    ranked = chunks.select("match_id", "path", "text").join(F.broadcast(ranked) if S.few(ranked) else ranked, "match_id")
    ranked = ranked.select("query_id", "match_id", "score", "rank", F.split_part("path", F.lit("/"), F.lit(1)).alias("source"), F.sha2("text", 256).alias("text_key"))
    judged = bench.select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"), F.lit(3).alias("grade"))
    judged = judged.unionByName(bench.where("item_id % 20 <> 0").select(F.col("item_id").alias("query_id"), F.lit("src0").alias("source"), F.lit(1).alias("grade")))
    out = M.retrieval_metrics(ranked, judged)
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg", "duplicate_rate")))


@query("SELECT percentile_disc(0.95) WITHIN GROUP (ORDER BY n_chars) AS value FROM documents")
def nearest_rank_percentile(spark, sf_dir):
    return M.nearest_rank(table(spark, sf_dir, "documents"), "n_chars", 0.95)
