"""The inverted index as tables: postings, document lengths, corpus and term statistics, declarations.

chunks: match_id, collection, kind, eligible, source_key, text and further columns.
Statistics count the chunks of eligible sources, never narrowed by a search filter.
Null texts are indexed as empty: length 0. Repeated rows of one match_id would count twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bounded, fold, frequencies

SCOPE = ["collection", "kind"]
#: A batch of terms is broadcast up to this many rows and shuffled beyond.
BROADCAST_TERMS = 100_000

#: What may open a declaration, and what may precede it.
DECLARING = tuple("fn func function class struct enum trait interface def type namespace".split())
MODIFIERS = tuple("pub public private protected internal static async unsafe export default virtual inline final abstract extern const pub(crate) mut".split())


def few(rows: DataFrame, bound: int = BROADCAST_TERMS) -> bool:
    return rows.limit(bound + 1).count() <= bound


def postings(chunks: DataFrame) -> DataFrame:
    """match_id, collection, kind, term, tf."""
    return frequencies(chunks, ["match_id", *SCOPE], "text")


def lengths(chunks: DataFrame, posted: DataFrame) -> DataFrame:
    """match_id, collection, kind, length: the number of forms emitted; 0 for chunks without terms."""
    sums = posted.groupBy("match_id", *SCOPE).agg(F.sum("tf").alias("length"))
    return chunks.select("match_id", *SCOPE).join(sums, ["match_id", *SCOPE], "left").withColumn("length", F.coalesce("length", F.lit(0)).cast("long"))


def corpus_stats(lengths_: DataFrame) -> DataFrame:
    """collection, kind, doc_count, total_tokens."""
    return lengths_.groupBy(*SCOPE).agg(F.count("*").alias("doc_count"), F.sum("length").cast("long").alias("total_tokens"))


def term_stats(posted: DataFrame) -> DataFrame:
    """collection, kind, term, doc_freq."""
    return posted.groupBy(*SCOPE, "term").agg(F.count("*").alias("doc_freq"))


def merged_stats(*deltas: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Signed deltas summed; what falls to zero or below goes."""
    both = deltas[0]
    for d in deltas[1:]:
        both = both.unionByName(d)
    out = both.groupBy(*keys).agg(*(F.sum(v).cast("long").alias(v) for v in values))
    return out.where(F.col(values[0]) > 0)


def negated(delta: DataFrame, values: list[str]) -> DataFrame:
    return delta.withColumns({v: -F.col(v) for v in values})


def replaced(table: DataFrame, rows: DataFrame, key: str = "source_key") -> DataFrame:
    """``table`` with all rows of the sources in ``rows`` replaced by ``rows``."""
    return table.join(rows.select(key).distinct(), key, "left_anti").select(table.columns).unionByName(rows.select(table.columns))


def removed(table: DataFrame, keys: DataFrame, key: str = "source_key") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti").select(table.columns)


def marked(sources: DataFrame, keys: DataFrame, eligible: bool, key: str = "source_key") -> DataFrame:
    """Invalidate or verify: ``eligible`` of the named sources is set; nothing is tokenised again."""
    hit = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    return sources.join(hit, key, "left").withColumn("eligible", F.when(F.col("_hit"), F.lit(eligible)).otherwise(F.col("eligible"))).drop("_hit").select(sources.columns)


def unreachable_terms(terms: DataFrame, posted: DataFrame) -> DataFrame:
    """Vocabulary that no posting uses: what compaction deletes. Postings of other terms go first, where the vocabulary can be broadcast."""
    asked = terms.select("term").distinct()
    asked = F.broadcast(asked) if few(asked) else asked
    return terms.join(posted.select("term").join(asked, "term", "left_semi").distinct(), "term", "left_anti")


def symbol_of_line(line: Column) -> Column:
    """The declared name in one line, or null."""
    trimmed = F.regexp_replace(line, r"^\s+|\s+$", "")
    modifiers = "|".join(m.replace("(", r"\(").replace(")", r"\)") for m in MODIFIERS)
    keyword = F.regexp_extract(trimmed, rf"^(?:(?:{modifiers})\s+)*(?:{'|'.join(DECLARING)})\s+(\S+)", 1)
    qualified = F.regexp_extract(trimmed, r"^(?!return )[^(]*?([^\s(]*::[^\s(]*)\(.*", 1)
    found = F.when(keyword != "", keyword).when(trimmed.contains("{") & (qualified != ""), qualified)
    name = F.regexp_extract(found, r"^[\p{IsAlphabetic}\p{N}_:.]+", 0)
    return F.when(~trimmed.rlike(r"^[/*#'\"]") & (name != ""), name)


def declared_symbols(text: Column) -> Column:
    """Distinct folded names declared in a text's lines."""
    return F.array_distinct(F.transform(F.array_compact(F.transform(F.split(text, "\n"), symbol_of_line)), fold))


def declarations(chunks: DataFrame) -> DataFrame:
    """match_id, symbol: of project chunks only, within the bytes that fields are taken from."""
    return chunks.where("kind = 'project'").select("match_id", F.explode(declared_symbols(bounded(F.col("text")))).alias("symbol"))


def source_key(collection: Column, path: Column) -> Column:
    return F.sha2(F.concat(collection, F.lit("\x00"), path), 256)


def match_id(key: Column, version: Column, ordinal: Column, generation: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", F.lit("lexforge-match"), key, version, ordinal.cast("string"), generation.cast("string")), 256)
