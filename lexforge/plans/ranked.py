"""One ranked search over a published index, for any number of queries at once.

Lexical, meaningful, definition, path and expansion lanes are retrieved as joins of a
small table of queries with the index, merged, and admitted to a pool of at most POOL
chunks a query; from there on work is bounded by the number of queries. The pool gets
its true raw scores, field scores, exact tiers, proximity, decay, copies collapsed and
a diverse order.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as C
from ..functions import text as T
from ..operators import index as I
from ..operators import ranking as R
from ..operators import search as S
from ..operators import sessions as N
from ..operators.published import Index, with_columns
from ..sources.shared import stored
from .query_plan import QueryPlan

#: Probes of one query are numbered below this.
PROBES = 16


@dataclass(frozen=True)
class Query:
    """``after`` is inclusive, ``before`` exclusive; both as the chunks' timestamps are written."""

    query_id: int
    text: str
    collection: str
    kind: str
    path_glob: str | None = None
    agent: str | None = None
    session_id: str | None = None
    after: str | None = None
    before: str | None = None


@dataclass(frozen=True)
class Ranked:
    """hits: query_id, match_id, position, score and the trace of every stage; pool: the admitted rows; lanes: counts by query."""

    hits: DataFrame
    pool: DataFrame
    lanes: DataFrame
    plans: dict[int, QueryPlan] = field(default_factory=dict)
    generation: int = 0


TERMS = "query_id long, term string, weight long"
ASKED = "query_id long, q_collection string, q_kind string, q_path string, q_agent string, q_session string, q_after string, q_before string, cls string, literal string"
#: What the filters look at.
LOOKED_AT = ("path", "agent", "session_id", "timestamp")


def in_scope() -> Column:
    """Over chunks joined with ASKED: what a query may see. A null column fails a filter that is set."""
    same = lambda asked, column: F.col(asked).isNull() | F.coalesce(F.col(column) == F.col(asked), F.lit(False))
    within = F.col("q_after").isNull() | F.coalesce(F.col("timestamp") >= F.col("q_after"), F.lit(False))
    until = F.col("q_before").isNull() | F.coalesce(F.col("timestamp") < F.col("q_before"), F.lit(False))
    glob = F.col("q_path").isNull() | F.coalesce(F.regexp_like("path", "q_path"), F.lit(False))
    own = F.col("eligible") & (F.col("collection") == F.col("q_collection")) & (F.col("kind") == F.col("q_kind"))
    return own & glob & same("q_agent", "agent") & same("q_session", "session_id") & within & until


class Search:
    """The stages of one call; each gives a table by query_id."""

    def __init__(self, index: Index, queries: list[Query], options: R.Options, now: str, limit: int) -> None:
        self.index, self.options, self.now, self.limit = index, options, now, limit
        self.spark = index.chunks.sparkSession
        plans = {q.query_id: QueryPlan.of(q.text, options.classification) for q in queries}
        self.queries = [q for q in queries if plans[q.query_id].original and limit > 0]
        self.plans = {q.query_id: plans[q.query_id] for q in self.queries}
        rows = [(q.query_id, q.collection, q.kind, S.glob_regex(q.path_glob) if q.path_glob else None, q.agent, q.session_id, q.after, q.before, self.plans[q.query_id].cls, self.plans[q.query_id].literal) for q in self.queries]
        self.asked = self.small(rows, ASKED)
        self.chunks = with_columns(index.chunks)
        self.meta = self.chunks.select("match_id", "collection", "kind", "eligible", *LOOKED_AT)
        self.raw = self.small([(q.query_id, t, n) for q in self.queries for t, n in Counter(T.text_tokens(q.text)).items()], TERMS)

    def small(self, rows: list[tuple], schema: str) -> DataFrame:
        """Rows made from the queries: broadcast unless there are many queries."""
        df = self.spark.createDataFrame(rows, schema)
        return F.broadcast(df) if len(rows) <= S.BROADCAST_TERMS else df

    def scores(self, terms: DataFrame, names: set[str], posted: DataFrame | None = None) -> DataFrame:
        """query_id (of ``terms``), match_id, score; ``names`` are the terms, for the look-up."""
        scope = self.asked.select("query_id", F.col("q_collection").alias("collection"), F.col("q_kind").alias("kind"))
        if "probe" in terms.columns:
            terms = terms.join(scope, "query_id").withColumn("query_id", F.col("probe")).drop("probe")
        else:
            terms = terms.join(scope, "query_id")
        posted = self.index.of_terms(self.index.postings, names).drop("bucket") if posted is None else posted
        return S.score(terms, posted, self.index.lengths, self.index.stats, self.index.of_terms(self.index.df, names).drop("bucket"))

    def scoped(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.meta, "match_id").join(self.asked, "query_id").where(in_scope()).select(rows.columns)

    def best(self, scores: DataFrame, k: int, key: str = "query_id") -> DataFrame:
        """The best ``k`` of what a query may see; of a session's copies only the one that stands for them, with their number."""
        hits = self.scoped(scores)
        if not any(q.kind == "session" for q in self.queries):
            return S.top(hits.withColumn("copy_count", F.lit(1).cast("long")), k, key=key)
        by_key = hits if key == "query_id" else hits.withColumnRenamed("query_id", "asked_by").withColumnRenamed(key, "query_id")
        grouped = N.grouped_hits(by_key.join(self.index.occurrences, "match_id"))
        grouped = grouped if key == "query_id" else grouped.withColumnRenamed("query_id", key).withColumnRenamed("asked_by", "query_id")
        single = hits.join(self.index.occurrences.select("match_id"), "match_id", "left_anti").withColumn("copy_count", F.lit(1).cast("long"))
        return S.top(grouped.select(single.columns).unionByName(single), k, key=key)

    def lexical(self) -> DataFrame:
        """All terms of the query, with multiplicity and stopwords."""
        return self.best(self.scores(self.raw, {t for q in self.queries for t in T.text_tokens(q.text)}), S.TOP)

    def meaningful(self) -> DataFrame:
        """Natural words alone, where stopwords were taken out."""
        rows = [(i, t, 1) for i, p in self.plans.items() if p.stopwords_removed for t in p.original]
        return self.best(self.scores(self.small(rows, TERMS), {t for _, t, _ in rows}), S.RESERVE)

    def definitions(self) -> DataFrame:
        """Chunks that declare an identifier that was asked for."""
        rows = [(q.query_id, self.plans[q.query_id].literal) for q in self.queries if q.kind == "project" and self.plans[q.query_id].cls == "identifier" and self.plans[q.query_id].literal]
        declared = self.index.of_terms(self.index.declared, {s for _, s in rows}).select("match_id", "symbol")
        found = self.scoped(declared.join(self.small(rows, "query_id long, symbol string"), "symbol").select("query_id", "match_id").distinct())
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("match_id"))
        return found.withColumn("n", place).where(F.col("n") <= S.RESERVE).drop("n")

    def paths(self) -> DataFrame:
        """Chunks whose path is, or ends at a / with, the path that was asked for: an equi-join on the paths' ends."""
        rows = [(q.query_id, T.fold_text(self.plans[q.query_id].literal.replace("\\", "/"))) for q in self.queries if q.kind == "project" and self.plans[q.query_id].cls == "path"]
        whole = S.normal_path(F.col("path"))
        parts = F.split(whole, "/")
        ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
        known = self.meta.where("path IS NOT NULL AND kind = 'project'").select("path").distinct().select("path", whole.alias("whole"), F.explode(F.array_distinct(ends)).alias("end"))
        hit = known.join(self.small(rows, "query_id long, end string"), "end").select("query_id", F.col("path").alias("found"), (F.col("whole") == F.col("end")).alias("exact"))
        found = self.scoped(self.meta.select("match_id", F.col("path").alias("found")).join(hit, "found").select("query_id", "match_id", "found", "exact"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact"), "found", "match_id"))
        return found.withColumn("n", place).where(F.col("n") <= S.TOP).select("query_id", "match_id")

    def weak(self, lexical: DataFrame) -> DataFrame:
        """query_id, weak: whether the query's probes are searched too."""
        found = self.asked.select("query_id").join(S.is_weak(lexical), "query_id", "left")
        return found.select("query_id", (F.coalesce("weak", F.lit(True)) & F.lit(self.options.expansion)).alias("weak"))

    def expansion(self, weak: DataFrame) -> DataFrame:
        """query_id, match_id, score: a row for each probe of a weak query that finds it."""
        rows = [(i, i * PROBES + n, t, k) for i, p in self.plans.items() for n, probe in enumerate(p.probes) for t, k in Counter(T.text_tokens(probe.query)).items()]
        terms = self.small(rows, "query_id long, probe long, term string, weight long").join(F.broadcast(weak.where("weak")), "query_id", "left_semi")
        hits = self.scores(terms, {r[2] for r in rows}).withColumn("probe", F.col("query_id")).withColumn("query_id", F.floor(F.col("probe") / PROBES))
        return self.best(hits, S.TOP, key="probe").select("query_id", "match_id", "score", "copy_count")

    def pool(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(admitted rows with their lanes, counts of the lanes, weak by query)."""
        lexical = stored(self.lexical())
        weak = stored(self.weak(lexical))
        meaningful, expansion = stored(self.meaningful()), stored(self.expansion(weak))
        self.copies = lexical.select("query_id", "match_id", "copy_count").unionByName(meaningful.select("query_id", "match_id", "copy_count")).unionByName(expansion.select("query_id", "match_id", "copy_count"))
        lanes = stored(S.merged_lanes(lexical, meaningful, self.definitions(), self.paths(), expansion).withColumnRenamed("path", "by_path"))
        # the filters hold once more where the lanes meet: no lane can go round them
        seen = lanes.join(self.meta, "match_id").join(self.asked, "query_id").join(F.broadcast(weak), "query_id").where(F.when(in_scope(), True).otherwise(F.raise_error(F.lit("a candidate is outside the query's scope")).cast("boolean")))
        exact = S.exact_path(F.col("path"), F.col("literal"))
        full = seen.select(*lanes.columns, "cls", "weak", exact.alias("exact_path"))
        pool = S.admitted(full, F.col("cls") == "path", F.coalesce("exact_path", F.lit(False)), F.col("weak"))
        return stored(pool.select(*lanes.columns, "weak", "lane", F.col("position").alias("admitted"))), S.lane_counts(lanes.withColumnRenamed("by_path", "path")), weak

    def baselines(self, pool: DataFrame) -> DataFrame:
        """query_id, match_id, baseline: the raw score of every admitted row, those outside the raw top too."""
        names = {t for q in self.queries for t in T.text_tokens(q.text)}
        posted = self.index.of_terms(self.index.postings, names).drop("bucket").join(F.broadcast(pool.select("match_id").distinct()), "match_id", "left_semi")
        true = self.scores(self.raw, names, posted).withColumnRenamed("score", "true_score")
        return pool.select("query_id", "match_id", "raw_bm25").join(true, ["query_id", "match_id"], "left").select("query_id", "match_id", F.coalesce("raw_bm25", "true_score", F.lit(0.0)).cast("float").alias("baseline"))

    def lexical_scores(self, pool: DataFrame, chunks: DataFrame) -> DataFrame:
        """query_id, match_id, original, expansion: field scores of the query's terms and of its active probes' terms."""
        rows = [(i, t, 1.0, False) for i, p in self.plans.items() for t in p.original]
        if self.options.expansion:
            rows += [(i, t, w, True) for i, p in self.plans.items() for t, w in p.expansion_terms().items()]
        names = {r[1] for r in rows}
        ids = F.broadcast(pool.select("match_id").distinct())
        active = F.broadcast(pool.select("query_id", "weak").distinct())
        terms = self.small(rows, "query_id long, term string, evidence double, expands boolean").join(active, "query_id").where("weak OR NOT expands")
        terms = terms.join(self.asked.select("query_id", F.col("q_collection").alias("collection"), F.col("q_kind").alias("kind")), "query_id")
        terms = terms.join(self.index.of_terms(self.index.df, names).drop("bucket"), [*I.SCOPE, "term"], "left").join(F.broadcast(self.index.stats), I.SCOPE)
        terms = stored(terms.select("query_id", "term", "evidence", "expands", "doc_freq", "doc_count"))

        scope = chunks.join(F.broadcast(self.index.stats), I.SCOPE).select("match_id", (F.col("total_tokens") / F.col("doc_count")).alias("mean_length"), F.when(F.col("kind") == "project", "body").otherwise(R.body_field()).alias("body"))
        others = R.field_texts(chunks.withColumn("text", R.bounded(F.col("text")))).join(scope.select("match_id", "body"), "match_id").where(F.col("field") != F.col("body"))
        counted = stored(T.term_frequencies(others, ["match_id", "field"], "value"))
        sizes = counted.groupBy("match_id", "field").agg(F.sum("tf").alias("length"))
        asked = F.broadcast(terms.select("term").distinct())
        side = counted.join(asked, "term", "left_semi").join(sizes, ["match_id", "field"])
        posted = self.index.of_terms(self.index.postings, names).join(ids, "match_id", "left_semi").join(asked, "term", "left_semi")
        body = posted.join(self.index.lengths.select("match_id", "length"), "match_id").join(scope, "match_id").select("term", "match_id", F.col("body").alias("field"), "tf", "length")
        counts = side.select("term", "match_id", "field", "tf", "length").unionByName(body).join(scope.select("match_id", "mean_length"), "match_id")
        shares = stored(R.field_shares(counts, F.col("mean_length")))
        both = [R.field_scores(shares, terms.where(f"{'' if name == 'expansion' else 'NOT '}expands"), F.col("doc_count")).withColumnRenamed("score", name) for name in ("original", "expansion")]
        found = pool.select("query_id", "match_id").join(both[0], ["query_id", "match_id"], "left").join(both[1], ["query_id", "match_id"], "left")
        original, raw = F.coalesce("original", F.lit(0.0)), F.coalesce("expansion", F.lit(0.0))
        return found.select("query_id", "match_id", original.alias("original"), R.capped_expansion(original, raw).alias("expansion"))

    def salient(self, chunks: DataFrame) -> DataFrame:
        """match_id, salient: the SALIENT rarest terms that say something, with their weights."""
        told = F.when(F.col("kind") == "project", F.concat_ws("\n", R.bounded(F.col("text")), "path")).otherwise(F.col("text"))
        terms = T.term_frequencies(chunks.select("match_id", *I.SCOPE, told.alias("told")), ["match_id", *I.SCOPE], "told")
        terms = terms.where(~(F.col("term").isin(*T.STOPWORDS, *T.GENERIC) | (F.octet_length("term") < 2)))
        if self.options.weighted_similarity:
            df = self.index.df.drop("bucket").join(F.broadcast(stored(terms.select(*I.SCOPE, "term").distinct())), [*I.SCOPE, "term"], "left_semi")
            terms = terms.join(df, [*I.SCOPE, "term"], "left").join(F.broadcast(self.index.stats), I.SCOPE)
            terms = terms.withColumn("w", C.ranker_idf(F.col("doc_count"), F.col("doc_freq")))
        else:
            terms = terms.withColumn("w", F.lit(1.0))
        first = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("w"), "term"))
        kept = terms.withColumn("n", first).where(F.col("n") <= R.SALIENT)
        return kept.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("salient"))

    def run(self) -> Ranked:
        o = self.options
        pool, counts, _ = self.pool()
        chunks = stored(self.chunks.join(F.broadcast(pool.select("match_id").distinct()), "match_id", "left_semi"))
        text = F.coalesce(R.bounded(F.col("text")), F.lit(""))
        whole = F.filter(F.transform(T.occurrences(text), lambda x: T.fold(F.regexp_replace(x, r"[-.:/\\]+$", ""))), lambda x: x != "")
        told = chunks.withColumns({
            "symbols": F.when(F.col("kind") == "project", R.declared_symbols(text)).otherwise(F.array().cast("array<string>")), "identities": whole, "surfaces": T.tokens(text), "body": T.fold(text),
        })
        rows = pool.select("query_id", "match_id", "weak", "lane", "raw_bm25", "meaningful_bm25", "definition", "by_path", "expansion_bm25").join(told, "match_id").join(self.asked.select("query_id", "cls", "literal"), "query_id")
        none = F.lit(None).cast("string")
        rows = rows.withColumn("exact", R.exact_class(F.col("cls"), F.col("literal")) if o.exact else none)
        strong = (F.col("literal") != "") & F.coalesce(R.contains(F.col("body"), F.col("literal")), F.lit(False))
        decay = C.temporal_factor(F.col("timestamp").cast("timestamp"), self.now, F.col("exact").isNotNull(), strong)
        rows = rows.withColumns({"tier": R.tier(F.col("exact")).cast("int"), "decay": F.when(F.col("kind") == "session", decay).otherwise(1.0) if o.decay else F.lit(1.0)})
        rows = rows.join(self.lexical_scores(pool, chunks), ["query_id", "match_id"]).join(self.baselines(pool), ["query_id", "match_id"]).join(self.salient(chunks), "match_id", "left")
        rows = rows.withColumn("lexical", F.col("original") + F.col("expansion") if o.fields else F.col("baseline").cast("double"))
        hits = R.rerank(rows, self.limit, o, {i: p.original for i, p in self.plans.items()})
        copies = self.copies.groupBy("query_id", "match_id").agg(F.max("copy_count").alias("copy_count"))
        hits = hits.join(F.broadcast(copies), ["query_id", "match_id"], "left").withColumn("copy_count", F.coalesce("copy_count", F.lit(1)))
        return Ranked(hits, pool, counts, self.plans, self.index.generation)


def search(index: Index, queries: list[Query], options: R.Options = R.Options(), now: str | None = None, limit: int = 10) -> Ranked:
    """The best ``limit`` hits of each query in the order of selection. ``now``: an ISO time, for decay; the present by default.

    A query without terms has no hits. query_id is a whole number of at most 2^58.
    """
    from datetime import UTC, datetime

    now = now or datetime.now(UTC).isoformat(timespec="seconds")
    return Search(index, queries, options, now, limit).run()
