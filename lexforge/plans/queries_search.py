"""Queries: tokens, index, retrieval, filters, lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as I
from ..operators import search as S
from ..operators.published import Index
from ..sources import project as P
from ..sources.shared import stream_folder
from . import oracle as O

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "doc_id", F.lit(".txt"))
    return d.select(F.col("doc_id").cast("string").alias("match_id"), F.lit("docs").alias("collection"), F.lit("project").alias("kind"), path.alias("path"), I.source_key(F.lit("docs"), path).alias("source_key"), "text")


def talk_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    at = F.timestamp_micros(F.lit(1767225600000000) + F.col("conv_id") * 3600000000 + F.col("turn") * 60000000)  # from 2026-01-01 UTC
    return c.select(
        F.concat("conv_id", F.lit(":"), "turn").alias("match_id"), F.lit("talks").alias("collection"), F.lit("session").alias("kind"),
        F.concat(F.lit("talks/"), "conv_id", F.lit(".jsonl")).alias("path"), F.col("conv_id").cast("string").alias("session_id"), F.concat("conv_id", F.lit(":"), "turn").alias("event_id"),
        F.element_at(F.array(*map(F.lit, ("codex", "claude", "copilot"))), (F.col("conv_id") % 3 + 1).cast("int")).alias("agent"),
        F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), "role", F.lit("message").alias("field_kind"), "turn", "conv_id", "text",
    )


def build(chunks: DataFrame) -> Index:
    """A new index; a table that comes in fewer splits than there are cores is dealt out first."""
    spark = chunks.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return Index.publish(chunks, stream_folder(spark), partitions=cores if chunks.rdd.getNumPartitions() < cores else None, texts=False)


_published: dict[tuple, Index] = {}


def published(chunks: DataFrame) -> Index:
    """The index of ``chunks``, built by the first query of the application that asks for it."""
    key = (chunks.sparkSession.sparkContext.applicationId, chunks.semanticHash(), tuple(sorted(chunks.inputFiles())))
    if key not in _published:
        _published[key] = build(chunks)
    return _published[key]


class Built:
    """A published index for searches of one scope."""

    def __init__(self, chunks: DataFrame, scope: tuple[str, str] = ("docs", "project")) -> None:
        self.chunks, self.scope, self.index = chunks, scope, published(chunks)
        self.posted, self.df = self.index.postings.drop("bucket"), self.index.df.drop("bucket")
        self.lengths, self.stats = self.index.lengths, self.index.stats

    def hits(self, terms: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
        """Scores of all chunks, or of ``chunks``; the few terms of a small batch are looked up in their buckets."""
        few = terms.select("term").distinct().limit(S.TOP + 1).collect()
        names = [r.term for r in few] if len(few) <= S.TOP else None
        posted, df = (rows if names is None else self.index.of_terms(rows, names) for rows in (self.index.postings, self.index.df))
        posted = posted.drop("bucket")
        if chunks is not None:
            posted = posted.join(chunks.select("match_id"), "match_id", "left_semi")
        collection, kind = self.scope
        return S.score(terms.withColumns({"collection": F.lit(collection), "kind": F.lit(kind)}), posted, self.lengths, self.stats, df.drop("bucket"))


def asked(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    return S.query_terms(spark.createDataFrame(rows, "query_id long, query string"))


def best(hits: DataFrame, k: int) -> DataFrame:
    rounded = hits.withColumn("score", F.round(F.col("score").cast("double"), 5))
    return S.top(rounded, k).select("query_id", "match_id", "score", F.col("rank").cast("long").alias("rank"))


TWO = [(1, "stupid trash")]
TWICE = [(1, "trash trash stupid")]
NONE = [(1, "nomatchqvx")]


@query(f"WITH {O.index(O.DOCS)} SELECT (SELECT count(*) FROM post) AS n_postings, (SELECT count(*) FROM df) AS n_terms, n AS doc_count, total AS total_tokens FROM st")
def index_build(spark, sf_dir):
    """A whole build: tokens, postings by bucket, lengths, statistics, declarations, all written."""
    new = build(doc_chunks(spark, sf_dir))
    counts = [rows.agg(F.count("*").alias(name)) for rows, name in ((new.postings, "n_postings"), (new.df, "n_terms"))]
    return new.stats.select("doc_count", "total_tokens").join(F.broadcast(counts[0])).join(F.broadcast(counts[1])).select("n_postings", "n_terms", "doc_count", "total_tokens")


@query(f"SELECT match_id, term, tf FROM {O.tf(O.DOCS, 'match_id')}")
def tokenize_documents(spark, sf_dir):
    return I.postings(doc_chunks(spark, sf_dir)).select("match_id", "term", "tf")


@query(f"SELECT page_id, term, tf FROM {O.tf('pages', 'page_id', 'html')}")
def tokenize_pages(spark, sf_dir):
    return T.frequencies(table(spark, sf_dir, "pages"), "page_id", "html")


VECTORS = [(1, "parseHTTPResponse"), (2, "parse_http_response"), (3, "foo foo_bar"), (4, "Straße"), (5, "STRASSE"), (6, "foo.bar, next"), (7, "foo."), (8, "Foo::bar."), (9, "/src/HTTPServer.rs"), (10, "foo-bar"), (11, "A" * 300), (12, "HTTP2Server aBCd"), (13, "..."), (14, "")]


@query(f"SELECT id, term, tf FROM {O.tf(O.values(VECTORS, 'id, text'), 'id')}")
def tokenize_vectors(spark, sf_dir):
    return T.term_frequencies(spark.createDataFrame(VECTORS, "id int, text string"), "id", "text")


@query(f"WITH {O.index(O.DOCS)} SELECT match_id, length FROM len")
def doc_lengths(spark, sf_dir):
    return Built(doc_chunks(spark, sf_dir)).lengths.select("match_id", "length")


@query(f"WITH {O.index(O.DOCS)} SELECT 'docs' AS collection, 'project' AS kind, n AS doc_count, total AS total_tokens FROM st")
def corpus_stats(spark, sf_dir):
    return Built(doc_chunks(spark, sf_dir)).stats


@query(f"WITH {O.index(O.DOCS)} SELECT term, df AS doc_freq FROM df")
def term_stats(spark, sf_dir):
    return Built(doc_chunks(spark, sf_dir)).df.select("term", "doc_freq")


def raw(rows, k=10):
    def run(spark, sf_dir):
        return best(Built(doc_chunks(spark, sf_dir)).hits(asked(spark, rows)), k)

    return run


for _name, _rows in (("bm25_raw_topk", TWO), ("bm25_multiplicity", TWICE), ("bm25_no_match", NONE)):
    query(f"WITH {O.scored(O.DOCS, O.values(_rows, 'query_id, query'))} {O.top(10)}", _name)(raw(_rows))


@query(f"WITH {O.scored(O.DOCS, '(SELECT item_id AS query_id, text AS query FROM benchmark)')} {O.top(5)}")
def bm25_batch(spark, sf_dir):
    asked_ = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return best(Built(doc_chunks(spark, sf_dir)).hits(S.query_terms(asked_)), 5)


TALK_SCOPE = ("talks", "session")


def narrowed(chunks_of, rows, **filters):
    def run(spark, sf_dir):
        b = Built(chunks_of(spark, sf_dir), TALK_SCOPE if chunks_of is talk_chunks else ("docs", "project"))
        return best(b.hits(asked(spark, rows), S.filtered(b.chunks, **filters)), 10)

    return run


COMMON_WORDS = [(1, "the of and"), (2, "to in")]
for _name, _chunks, _src, _filters, _where in (
    ("bm25_filtered_glob", doc_chunks, O.DOCS, {"path_glob": "src1?/*[02468].txt"}, r"regexp_matches(path, '^src1./.*[02468]\.txt$')"),
    ("bm25_filtered_agent", talk_chunks, O.TALKS, {"agent": "claude"}, "agent = 'claude'"),
    ("bm25_filtered_session", talk_chunks, O.TALKS, {"session_id": "7"}, "session_id = '7'"),
    ("bm25_filtered_time", talk_chunks, O.TALKS, {"after": "2026-01-02T00:00:00.000Z", "before": "2026-01-04T03:02:00.000Z"}, "timestamp >= '2026-01-02T00:00:00.000Z' AND timestamp < '2026-01-04T03:02:00.000Z'"),
):
    query(f"WITH {O.scored(_src, O.values(COMMON_WORDS, 'query_id, query'), _where)} {O.top(10)}", _name)(narrowed(_chunks, COMMON_WORDS, **_filters))

GLOBS = [(1, "src/*.rs"), (2, "**/*.{py,toml}"), (3, "a?c/[!x]*"), (4, "src/Foo_%Bar.rs")]
PATHS = [(1, "src/lib.rs"), (2, "src/deep/er/lib.rs"), (3, "pkg/x.py"), (4, "Cargo.toml"), (5, "x/Cargo.toml"), (6, "abc/y.md"), (7, "abc/x.md"), (8, "a/c/y"), (9, "src/Foo_%Bar.rs"), (10, "src/FooxyBar.rs"), (11, "SRC/LIB.RS")]
_GLOB_SQL = {1: r"^src/.*\.rs$", 2: r"^.*/.*\.(?:py|toml)$", 3: r"^a.c/[^x].*$", 4: r"^src/Foo_%Bar\.rs$"}


@query(" UNION ALL ".join(f"SELECT {g} AS glob_id, path_id FROM {O.values(PATHS, 'path_id, path')} WHERE regexp_matches(path, {O.lit(p)})" for g, p in _GLOB_SQL.items()))
def path_globs(spark, sf_dir):
    paths = spark.createDataFrame(PATHS, "path_id int, path string")
    out = None
    for g, glob in GLOBS:
        one = S.filtered(paths, path_glob=glob).select(F.lit(g).alias("glob_id"), "path_id")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT match_id, whole FROM (SELECT match_id, path, {O.fold('path')} = '825?page=2&ref=x' AS whole FROM (SELECT CAST(page_id AS VARCHAR) AS match_id, url AS path FROM pages) WHERE {O.fold('path')} = '825?page=2&ref=x' OR ends_with({O.fold('path')}, '/825?page=2&ref=x')) ORDER BY whole DESC, path, match_id LIMIT 200")
def path_suffix_lane(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("match_id"), F.col("url").alias("path"))
    return S.path_lane(pages, "825?page=2&ref=x").select("match_id", "whole")


CODE = [
    ("a", "pub fn parse_http(x: u8) {\n}\n// fn not_this\nclass Widget:\n    pass"), ("b", "export default async function loadAll() {\nlet fn = 1;\nstruct"), ("c", "std::vector<int> Foo::bar(int x) {\n  return Foo::baz(x) {\n}"),
    ("d", "# def hidden\n  def visible(self):\n    type Alias = int"), ("e", "the class of fn things\nnamespace a::b {"), ("f", "pub(crate) const fn X.y(z)\ninterface IThing<T> {"), ("g", ""),
]
SYMBOLS = [("a", "parse_http"), ("a", "widget:"), ("b", "loadall"), ("c", "foo::bar"), ("d", "visible"), ("d", "alias"), ("e", "a::b"), ("f", "x.y"), ("f", "ithing")]


@query(f"SELECT * FROM {O.values(SYMBOLS, 'match_id, symbol')}")
def declared_symbols(spark, sf_dir):
    rows = spark.createDataFrame(CODE, "match_id string, text string").withColumn("kind", F.lit("project"))
    return I.declarations(rows)


def declaring_chunks(spark, sf_dir):
    """Documents that open with a declaration; every fiftieth one's has the same name."""
    n = (F.col("match_id").cast("long") % 50).cast("string")
    opening = F.when(F.col("match_id").cast("long") % 3 == 0, F.concat(F.lit("pub(crate) async fn Sym_"), n, F.lit("(x: u8) {\n"))).otherwise(F.concat(F.lit("  void Space::Sym_"), n, F.lit("(int x) {\n// fn hidden\n")))
    return doc_chunks(spark, sf_dir).withColumn("text", F.concat(opening, "text"))


NAMED = "(SELECT doc_id, CAST(doc_id AS VARCHAR) AS match_id, CASE WHEN doc_id % 3 = 0 THEN 'sym_' ELSE 'space::sym_' END || doc_id % 50 AS symbol FROM documents)"


@query(f"SELECT match_id, symbol FROM {NAMED}")
def declarations(spark, sf_dir):
    return I.declarations(declaring_chunks(spark, sf_dir))


@query(f"SELECT match_id FROM {NAMED} WHERE symbol = 'space::sym_7' ORDER BY match_id LIMIT 40")
def definition_lane(spark, sf_dir):
    return S.definition_lane(I.declarations(declaring_chunks(spark, sf_dir)), "space::sym_7")


@query("SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, string_agg(line, chr(10) ORDER BY n) || CASE WHEN max(n) < max(total) THEN chr(10) ELSE '' END AS text FROM (SELECT doc_id, n, line, total, (n - 1) // 60 AS ordinal FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n, len(lines) AS total FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text <> ''))) WHERE NOT (n = total AND line = '') GROUP BY doc_id, ordinal")
def chunk_60_lines(spark, sf_dir):
    return P.line_blocks(table(spark, sf_dir, "documents"), ["doc_id"])


@query()
def chunk_16k(spark, sf_dir):
    return P.chunk_texts(table(spark, sf_dir, "documents"), ["doc_id"])


@query("SELECT doc_id, sha256(coalesce(text, '')) AS version, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents")
def content_digest(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("version"), F.octet_length(text).cast("long").alias("bytes"))


@query(f"SELECT match_id, sha256('docs' || chr(0) || path) AS source_key FROM {O.DOCS}")
def source_keys(spark, sf_dir):
    return doc_chunks(spark, sf_dir).select("match_id", "source_key")


@query(f"WITH {O.index('(SELECT * FROM ' + O.DOCS + ' WHERE CAST(match_id AS BIGINT) % 3 <> 0 OR CAST(match_id AS BIGINT) % 2 = 0)')} SELECT term, df AS doc_freq FROM df")
def incremental_stats(spark, sf_dir):
    """Sources are added in two batches, then some are taken out: signed deltas against one count over what is left."""
    chunks = doc_chunks(spark, sf_dir)
    even = F.col("match_id").cast("long") % 2 == 0
    gone = (F.col("match_id").cast("long") % 3 == 0) & ~even
    delta = lambda rows: I.term_stats(I.postings(rows))
    every = I.merged_stats(delta(chunks.where(even)), delta(chunks.where(~even)), I.negated(delta(chunks.where(gone)), ["doc_freq"]), keys=[*I.SCOPE, "term"], values=["doc_freq"])
    return every.select("term", "doc_freq")


@query(f"WITH {O.index('(SELECT * FROM ' + O.DOCS + ' WHERE CAST(match_id AS BIGINT) % 4 <> 1)')} SELECT n AS doc_count, total AS total_tokens FROM st")
def invalidate_restore(spark, sf_dir):
    """Half of the sources are invalidated and some of them verified again, without tokenising anew."""
    chunks = doc_chunks(spark, sf_dir)
    sources = chunks.select("source_key", F.col("match_id").cast("long").alias("n"), F.lit(True).alias("eligible"))
    sources = I.marked(sources, sources.where("n % 2 = 1"), False)
    sources = I.marked(sources, sources.where("n % 4 = 3"), True)
    b = Built(chunks)
    kept = b.lengths.join(chunks.join(sources.where("eligible").select("source_key"), "source_key", "left_semi").select("match_id"), "match_id", "left_semi")
    return I.corpus_stats(kept).select("doc_count", "total_tokens")


@query(f"WITH {O.index(O.DOCS)}, other AS {O.tf('(SELECT item_id, text FROM benchmark)', 'item_id')} SELECT DISTINCT term FROM other WHERE term NOT IN (SELECT term FROM post)")
def unreachable_terms(spark, sf_dir):
    other = T.term_frequencies(table(spark, sf_dir, "benchmark"), "item_id", "text").select("term").distinct()
    return I.unreachable_terms(other, I.postings(doc_chunks(spark, sf_dir)))


@query("SELECT doc_id, source, text FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, source, 'rewritten' FROM documents WHERE doc_id % 5 = 0")
def replace_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    new = docs.where("doc_id % 5 = 0").withColumn("text", F.lit("rewritten"))
    return I.replaced(docs, new, "doc_id").select("doc_id", "source", "text")
