"""Raw BM25 retrieval for batches of queries, its filters and lanes, and the candidate pool.

queries: query_id, collection, kind and nullable filters (path_glob, agent,
session_id, after, before). query_terms: query_id, term, weight. A batch is one
plan: the terms meet the postings in one join, and each query keeps its top k by a
window whose limit is pushed below the sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import share, weighted
from ..functions.text import fold, term_frequencies
from .index import BROADCAST_TERMS, SCOPE, few

TOP, RESERVE, POOL = 200, 40, 200
THIN_POOL, WEAK_SCORE = 20, 0.25
#: Scores that one task adds up at most.
TASK_SCORES = 1_000_000


def query_terms(queries: DataFrame, text: str = "query") -> DataFrame:
    """query_id, term, weight: all terms of the query, stopwords too, with their multiplicity."""
    return term_frequencies(queries, "query_id", text).withColumnRenamed("tf", "weight")


def score(terms: DataFrame, posted: DataFrame, lengths: DataFrame, stats: DataFrame, df: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """query_id, match_id, score (float): BM25 of every chunk that has a query term.

    ``terms`` holds collection and kind, or ``scope`` gives them by query_id. The work is
    done on narrow postings; texts are joined for winners only.
    """
    asked = terms if scope is None else terms.join(scope.select("query_id", *SCOPE), "query_id")
    small, names = few(terms), asked.select(*SCOPE, "term").distinct()
    known = df.join(F.broadcast(names) if small else names, [*SCOPE, "term"], "left_semi").join(stats, SCOPE)  # a row for each term asked, at most
    if not small:
        found = posted.join(asked.join(known, [*SCOPE, "term"]), [*SCOPE, "term"]).join(lengths.select("match_id", "length"), "match_id")
        return summed(found.withColumn("one", unweighted()))
    # postings are dealt out by match before they meet their queries: what a batch multiplies is never shuffled
    found = posted.join(F.broadcast(known), [*SCOPE, "term"])
    found = found.repartition(tasks_of(terms, stats), "match_id").join(lengths.select("match_id", "length"), "match_id")
    return summed(found.withColumn("one", unweighted()).select("match_id", *SCOPE, "term", "one").join(F.broadcast(asked), [*SCOPE, "term"]))


def unweighted() -> Column:
    return share(F.col("tf"), F.col("length"), F.col("total_tokens") / F.col("doc_count"), F.col("doc_count"), F.col("doc_freq"))


def summed(found: DataFrame) -> DataFrame:
    return found.groupBy("query_id", "match_id").agg(F.sum(weighted(F.col("one"), F.col("weight"))).cast("float").alias("score")).where("score > 0")


def tasks_of(terms: DataFrame, stats: DataFrame) -> int:
    """As many tasks as keep the scores of one, at most all chunks for all queries, within TASK_SCORES."""
    pairs = (stats.agg(F.sum("doc_count")).first()[0] or 0) * terms.select("query_id").distinct().count()
    return max(int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_SCORES))


def top(rows: DataFrame, k: int, by: str = "score", key: str = "query_id", tie: str = "match_id") -> DataFrame:
    """The k best rows of each query, ranked from 1; ties by id."""
    w = Window.partitionBy(key).orderBy(F.desc(by), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def glob_regex(glob: str) -> str:
    """An anchored pattern: ``*`` and ``?`` cross ``/``; ``**``, ``[..]``, ``[!..]`` and ``{a,b}`` as in shells; case-sensitive."""
    out, depth, i = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob[i : i + 2] == "**":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            negated = body[0] in "!^"
            out.append("[" + "^" * negated + body[negated:].replace("\\", "\\\\") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append("\\" + glob[i])
        else:
            out.append("\\" + c if not (c.isalnum() or c in "_/ ") else c)
        i += 1
    if depth:
        raise ValueError(f"unclosed group in glob: {glob}")
    return "(?s)^" + "".join(out) + "$"


def filtered(chunks: DataFrame, path_glob: str | None = None, agent: str | None = None, session_id: str | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
    """Inclusive ``after``, exclusive ``before``; an undated row fails a date filter, a null column an equality filter."""
    if path_glob is not None:
        chunks = chunks.where(F.col("path").rlike(glob_regex(path_glob)))
    for column, value in (("agent", agent), ("session_id", session_id)):
        if value is not None:
            chunks = chunks.where(F.col(column) == value)
    if after is not None:
        chunks = chunks.where(F.col("timestamp") >= after)
    if before is not None:
        chunks = chunks.where(F.col("timestamp") < before)
    return chunks


def normal_path(path: Column) -> Column:
    return fold(F.replace(path, F.lit("\\"), F.lit("/")))


def exact_path(path: Column, literal: Column) -> Column:
    """The path is the literal or ends with it at a ``/``; ``%`` and ``_`` stand for themselves."""
    p, q = normal_path(path), normal_path(literal)
    return (p == q) | F.endswith(p, F.concat(F.lit("/"), q))


def path_lane(chunks: DataFrame, literal: str, k: int = TOP) -> DataFrame:
    """Chunks whose path equals or ends with the literal: equal ones first, then by path and id."""
    whole = normal_path(F.col("path")) == normal_path(F.lit(literal))
    return chunks.where(exact_path(F.col("path"), F.lit(literal))).withColumn("whole", whole).orderBy(F.desc("whole"), "path", "match_id").limit(k)


def definition_lane(declared: DataFrame, literal: str, k: int = RESERVE) -> DataFrame:
    return declared.where(F.col("symbol") == literal).select("match_id").distinct().orderBy("match_id").limit(k)


def is_weak(lexical: DataFrame) -> DataFrame:
    """query_id, weak: fewer than THIN_POOL lexical rows or none of WEAK_SCORE. Queries without rows are not in it: they are weak."""
    return lexical.groupBy("query_id").agg(((F.count("*") < THIN_POOL) | (F.max("score") < WEAK_SCORE)).alias("weak"))


def merged_lanes(lexical: DataFrame, meaningful: DataFrame, definition: DataFrame, path: DataFrame, expansion: DataFrame) -> DataFrame:
    """query_id, match_id and one column for each lane (null: not in it). expansion: a row for each probe; the best score counts."""
    tagged = [
        lexical.select("query_id", "match_id", F.col("score").alias("raw_bm25")),
        meaningful.select("query_id", "match_id", F.col("score").alias("meaningful_bm25")),
        definition.select("query_id", "match_id", F.lit(True).alias("definition")),
        path.select("query_id", "match_id", F.lit(True).alias("path")),
        expansion.select("query_id", "match_id", F.col("score").alias("expansion_bm25")),
    ]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    best = [F.max(c).alias(c) for c in ("raw_bm25", "meaningful_bm25", "definition", "path", "expansion_bm25")]
    return every.groupBy("query_id", "match_id").agg(*best)


def lane_counts(lanes: DataFrame) -> DataFrame:
    count = lambda c: F.count(c).alias(f"n_{c.split('_')[0]}" if c != "raw_bm25" else "n_lexical")
    return lanes.groupBy("query_id").agg(*map(count, ("raw_bm25", "meaningful_bm25", "definition", "path", "expansion_bm25")))


def admitted(lanes: DataFrame, path_class: Column, exact: Column, weak: Column) -> DataFrame:
    """The pool of at most POOL candidates of each query: reservations for definitions, meaningful and (if weak) expansion
    rows, then filled by raw score. ``path_class``, ``exact`` and ``weak`` are columns over ``lanes``."""
    rows = lanes.withColumns({"_exact": exact.cast("int"), "_path_class": path_class, "_weak": weak, "_raw": F.coalesce("raw_bm25", F.lit(0.0).cast("float"))})
    rows = rows.withColumn("_expands", F.max(F.col("expansion_bm25").isNotNull()).over(Window.partitionBy("query_id")))

    def reserve(rows: DataFrame, name: str, eligible: Column, order: list[Column]) -> DataFrame:
        may = eligible & F.col("_lane").isNull()
        w = Window.partitionBy("query_id", may).orderBy(*order, "match_id")
        return rows.withColumn("_n", F.when(may, F.row_number().over(w))).withColumn("_lane", F.when(F.col("_n") <= RESERVE, F.lit(name)).otherwise(F.col("_lane")))

    rows = rows.withColumn("_lane", F.lit(None).cast("string"))
    rows = reserve(rows, "definition", F.col("definition").isNotNull(), [F.desc("_raw")])
    rows = reserve(rows, "meaningful", F.col("meaningful_bm25").isNotNull(), [F.desc("meaningful_bm25")])
    rows = reserve(rows, "expansion", F.col("_weak") & F.col("_expands") & F.col("raw_bm25").isNull(), [F.desc("_exact"), F.desc(F.coalesce("expansion_bm25", F.lit(0.0)))])
    order = [F.desc(F.when(F.col("_path_class"), F.col("_exact")).otherwise(0)), F.desc(F.col("raw_bm25").isNotNull()), F.desc("_raw"), F.col("match_id")]
    rest = Window.partitionBy("query_id", F.col("_lane").isNull()).orderBy(*order)
    taken = F.count("_lane").over(Window.partitionBy("query_id"))
    rows = rows.withColumn("_fill", F.row_number().over(rest)).withColumn("_taken", taken)
    rows = rows.where(F.col("_lane").isNotNull() | (F.col("_fill") <= POOL - F.col("_taken")))
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("position") <= POOL)
    return rows.withColumn("lane", F.coalesce("_lane", F.lit("fill"))).select(*lanes.columns, "lane", "position")
