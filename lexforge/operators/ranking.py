"""Reranking of a bounded pool: field scores, exact tiers, proximity, decay, dedupe and diversity.

Fields, exact tiers and decay are columns, so they run over any number of
candidates. Deduplication and the diverse selection look at one candidate after
another: they run grouped by query, on at most POOL rows each by construction.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import K1, ranker_idf, temporal_factor
from ..functions.text import ALNUM, bounded, fold, fold_text, text_tokens
from .index import declared_symbols, symbol_of_line
from .search import POOL, exact_path

EXPANSION_RATIO, EXPANSION_ONLY, PROXIMITY_CAP = 0.35, 0.5, 0.15
LAMBDA, OVERLAP, ADJACENT, SALIENT = 0.85, 0.8, 0.7, 128

#: Weight, length normalisation and mean length of each field (0: the corpus mean).
PROJECT_FIELDS = {"symbol": (7.0, 0.0, 1.0), "signature": (4.0, 0.2, 24.0), "basename": (5.0, 0.0, 1.0), "path": (4.0, 0.0, 1.0), "doc_comment": (2.0, 0.5, 64.0), "comment": (1.5, 0.5, 64.0), "body": (1.0, 0.75, 0.0)}
SESSION_FIELDS = {"command": (4.0, 0.9, 128.0), "tool_output": (0.5, 0.9, 128.0), "user_request": (3.0, 0.9, 128.0), "assistant_prose": (1.5, 0.9, 128.0), "diagnostic": (5.0, 0.5, 64.0), "mentioned_identity": (5.0, 0.25, 32.0)}


@dataclass(frozen=True)
class Options:
    """Each part can be switched off."""

    classification: bool = True
    fields: bool = True
    exact: bool = True
    expansion: bool = True
    proximity: bool = True
    decay: bool = True
    dedupe: bool = True
    weighted_similarity: bool = True
    mmr: bool = True


def body_field() -> Column:
    """The name of a session chunk's body field, by its kind and role."""
    return (
        F.when(F.col("field_kind") == "tool_call", "command").when((F.col("field_kind") == "tool_result") | (F.col("role") == "tool"), "tool_output")
        .when(F.col("role") == "user", "user_request").otherwise("assistant_prose")
    )


def kept_lines(text: Column, keep) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


def field_texts(chunks: DataFrame) -> DataFrame:
    """match_id, field, value: the fields of each chunk. Needs kind, path, text, field_kind, role."""
    text = F.col("text")
    strip = lambda line: F.regexp_replace(line, r"^\s+", "")
    names = F.array_compact(F.transform(F.split(text, "\n"), symbol_of_line))
    declaring = F.filter(F.split(text, "\n"), lambda line: symbol_of_line(line).isNotNull())
    project = {
        "symbol": F.array_join(names, " "),
        "signature": F.array_join(F.transform(declaring, lambda line: F.regexp_replace(F.regexp_replace(line, r"\{.*$", ""), r"^\s+|\s+$", "")), "\n"),
        "basename": F.regexp_extract(F.col("path"), r"[^/\\]*$", 0),
        "path": F.col("path"),
        "doc_comment": kept_lines(text, lambda line: strip(line).rlike(r"^(?:///|/\*\*)")),
        "comment": kept_lines(text, lambda line: strip(line).rlike(r"^(?://|#)")),
        "body": text,
    }
    session = {
        "diagnostic": kept_lines(text, lambda line: F.lower(line).rlike("error|exception|not found|panic")),
        "mentioned_identity": F.array_join(F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"/|_|::|^.\P{IsUppercase}*\p{IsUppercase}")), " "),
    }
    pair = lambda name, value: F.struct((F.lit(name) if isinstance(name, str) else name).alias("field"), F.coalesce(value, F.lit("")).alias("value"))
    fields = F.when(F.col("kind") == "project", F.array(*(pair(n, v) for n, v in project.items()))).otherwise(F.array(pair(body_field(), text), *(pair(n, v) for n, v in session.items())))
    return chunks.select("match_id", F.explode(fields).alias("f")).select("match_id", "f.field", "f.value")


def field_parameters() -> Column:
    """A literal map field -> (weight, b, mean length)."""
    every = PROJECT_FIELDS | SESSION_FIELDS
    return F.create_map(*(x for name, (w, b, m) in every.items() for x in (F.lit(name), F.struct(F.lit(w).alias("w"), F.lit(b).alias("b"), F.lit(m).alias("mean")))))


def field_shares(counts: DataFrame, mean_length: Column) -> DataFrame:
    """Adds share: w * tf / (1 - b + b * length / mean) for (match_id, field, term, tf, length)."""
    p = field_parameters()[F.col("field")]
    mean = F.when(p["mean"] == 0, F.greatest(mean_length, F.lit(1.0))).otherwise(p["mean"])
    return counts.withColumn("share", p["w"] * F.col("tf") / (1 - p["b"] + p["b"] * F.col("length") / mean))


def field_scores(shares: DataFrame, terms: DataFrame, n: Column) -> DataFrame:
    """query_id, match_id, score: sum over terms of idf * tf / (K1 + tf) * evidence, tf summed over fields.

    terms: query_id, term, evidence, doc_freq (null: unknown).
    """
    # sums run in one order, so that equal rows get equal scores
    tf = shares.join(terms, "term").groupBy("query_id", "match_id", "term").agg(
        F.array_sort(F.collect_list(F.struct("field", "share"))).alias("shares"), F.first("evidence").alias("evidence"), F.first("doc_freq").alias("doc_freq"), F.first(n).alias("n"),
    )
    tf = tf.withColumn("tf", F.aggregate("shares", F.lit(0.0), lambda s, x: s + x["share"]))
    one = ranker_idf(F.col("n"), F.col("doc_freq")) * F.col("tf") / (K1 + F.col("tf")) * F.col("evidence")
    every = tf.groupBy("query_id", "match_id").agg(F.array_sort(F.collect_list(F.struct("term", one.alias("one")))).alias("every"))
    return every.select("query_id", "match_id", F.aggregate("every", F.lit(0.0), lambda s, x: s + x["one"]).alias("score"))


def capped_expansion(original: Column, expansion: Column) -> Column:
    return F.when(original > 0, F.least(expansion, original * EXPANSION_RATIO)).otherwise(F.least(expansion, F.lit(EXPANSION_ONLY)))


def contains(body: Column, literal: Column) -> Column:
    """``literal`` stands in ``body`` with no alphanumeric or ``_`` on either side."""
    edge = rf"[{ALNUM}_]"
    quoted = F.regexp_replace(literal, r"([^\p{IsAlphabetic}\p{N}\s])", r"\\$1")
    return F.regexp_like(body, F.concat(F.lit(f"(?<!{edge})"), quoted, F.lit(f"(?!{edge})")))


def exact_class(cls: Column, literal: Column) -> Column:
    """Over chunks with kind, path, text, symbols, identities, surfaces: the exact class, or null."""
    inside = F.array_contains("symbols", literal)
    known = F.array_contains("identities", literal)
    held = contains(fold(F.col("text")), literal)
    return (
        F.when(literal == "", F.lit(None))
        .when((cls == "identifier") & inside, F.when(literal.contains("::"), "qualified_symbol").otherwise("symbol"))
        .when((cls == "identifier") & known & (literal.contains("::") | (F.col("kind") == "session")), "historical_identity")
        .when((cls == "path") & (F.col("kind") == "project") & exact_path(F.col("path"), literal), F.when(literal.rlike(r"[/\\]"), "full_path").otherwise("basename"))
        .when((cls == "path") & (F.col("kind") == "session") & F.array_contains("surfaces", literal), "historical_identity")
        .when((cls == "diagnostic") & held, "diagnostic")
    )


def tier(exact: Column) -> Column:
    return F.when(exact.isNull(), 0).when(exact == "historical_identity", 1).otherwise(2)


def nearest_cover(sequence: list[str], wanted: set[str]) -> float:
    """min(1, wanted / shortest stretch that holds every wanted term); 0 without one, or with fewer than two wanted."""
    if len(wanted) < 2:
        return 0.0
    last: dict[str, int] = {}
    best = 0
    for at, term in enumerate(sequence):
        if term in wanted:
            last[term] = at
            if len(last) == len(wanted):
                stretch = at - min(last.values()) + 1
                best = min(best or stretch, stretch)
    return min(1.0, len(wanted) / best) if best else 0.0


def proximity(sequence: list[str], terms: tuple[str, ...]) -> float:
    from ..functions.text import STOPWORDS

    return nearest_cover(sequence, {t for t in terms if t not in STOPWORDS})


def weighted_jaccard(a: dict[str, float], b: dict[str, float]) -> float:
    both = sum(min(w, b.get(t, 0.0)) for t, w in a.items())
    union = sum(a.values()) + sum(b.values()) - both
    return both / union if union > 0 else 0.0


def overlap(a, b) -> float:
    if (a.source_key, a.source_version) != (b.source_key, b.source_version):
        return 0.0
    shorter = min(a.end_byte - a.start_byte, b.end_byte - b.start_byte)
    return max(0, min(a.end_byte, b.end_byte) - max(a.start_byte, b.start_byte)) / shorter if shorter > 0 else 0.0


def structural(a, b) -> float:
    if a.source_key != b.source_key:
        return 0.0
    if overlap(a, b) >= OVERLAP:
        return 0.95
    if a.kind == "session" and abs(a.end_line - b.start_line) <= 1:
        return ADJACENT
    return 1.0 if set(a.symbols) & set(b.symbols) else 0.0


def same_content(a, b) -> bool:
    return a.kind == b.kind and ((a.text != "" and a.text == b.text) or (a.kind == "project" and overlap(a, b) >= OVERLAP))


def select_diverse(rows: list, salient: list[dict[str, float]], limit: int, options: Options = Options()) -> list[tuple]:
    """(row index, collapsed ids, selection score) in the order selected.

    ``rows`` hold tier and relevance. They are sorted; copies fall to the first of them;
    then, highest tier first, the best of LAMBDA * relevance / max - (1 - LAMBDA) *
    similarity to the selected is taken, earlier rows winning ties.
    """
    order = sorted(range(len(rows)), key=lambda i: (-rows[i].tier, -rows[i].relevance, rows[i].match_id))
    unique: list[int] = []
    collapsed: dict[int, list[str]] = {}
    for i in order:
        twin = next((u for u in unique if same_content(rows[u], rows[i])), None) if options.dedupe else None
        if twin is None:
            unique.append(i)
        else:
            collapsed.setdefault(twin, []).append(rows[i].match_id)
    most = max([rows[i].relevance for i in unique], default=0.0)
    most = max(most, 2.0**-52)
    near = dict.fromkeys(unique, 0.0)
    out = []
    while unique and len(out) < min(limit, POOL):
        level = max(rows[i].tier for i in unique)
        gain = lambda i: LAMBDA * rows[i].relevance / most - (1 - LAMBDA) * near[i] if options.mmr else rows[i].relevance / most
        best = max((i for i in unique if rows[i].tier == level), key=lambda i: (gain(i), -unique.index(i)))
        out.append((best, collapsed.get(best, []), gain(best)))
        unique.remove(best)
        if options.mmr:
            for i in unique:
                near[i] = max(near[i], weighted_jaccard(salient[best], salient[i]), structural(rows[best], rows[i]))
    return out


RANKED = (
    "query_id long, match_id string, position long, score double, tier int, exact string, lane string, baseline double, original double, expansion double, lexical double, "
    "proximity_bonus double, decay double, relevance double, selection_score double, n_collapsed long, collapsed array<string>"
)


def rerank(candidates: DataFrame, limit: int, options: Options = Options(), originals: dict[int, tuple[str, ...]] | None = None) -> DataFrame:
    """Candidates (query_id, match_id, kind, source_key, source_version, text, symbols, salient, byte and line bounds, lane,
    exact, tier, baseline, original, expansion, lexical, decay) in the order of selection, with their trace.

    A query's candidates are at most POOL by admission, so a group is small. ``originals``: the
    queries' terms, for proximity. Candidates without any evidence are left out.
    """
    originals = originals or {}

    def group(found: pd.DataFrame) -> pd.DataFrame:
        terms = originals.get(int(found.query_id.iloc[0]), ())
        keep = (found.original > 0) | (found.expansion > 0) | found.exact.notna()
        found = found[keep]
        near = [proximity(text_tokens(t or ""), terms) if options.proximity else 0.0 for t in found.text]
        bonus = found.lexical * PROXIMITY_CAP * near
        found = found.assign(bonus=bonus, relevance=(found.lexical + bonus) * found.decay, text=found.text.fillna(""))
        rows = list(found.itertuples())
        salient = [dict(s) if s is not None else {} for s in found.salient]
        picked = select_diverse(rows, salient, limit, options)
        out = []
        for k, (i, collapsed, selection) in enumerate(picked):
            r = rows[i]
            out.append((r.query_id, r.match_id, k + 1, r.relevance, r.tier, r.exact, r.lane, float(r.baseline), r.original, r.expansion, r.lexical, r.bonus, r.decay, r.relevance, float(selection), len(collapsed), collapsed))
        return pd.DataFrame(out, columns=[c.split()[0] for c in RANKED.split(", ")])

    return candidates.groupBy("query_id").applyInPandas(group, RANKED)


__all__ = ["Options", "bounded", "PROJECT_FIELDS", "SESSION_FIELDS", "declared_symbols", "fold_text", "temporal_factor"]
