"""I-Match fingerprints, by DataFrame and SQL functions only.

A document's terms are its distinct runs of letters and digits in lower case. The
lexicon holds the terms whose inverse document frequency ln(N / df) over all
documents lies in a chosen band. A document keeps its terms that are in the
lexicon, sorted, and hashes what falls into each of CELLS randomised subsets of
it; the subsets hold 1 / (CELLS * 4^tier) of the lexicon each, with the tier set by
the number of terms kept, so that a subset meets about one of them. The
fingerprint lists the hashes of the document's tier and of the next. The likeness
of two fingerprints is the share of subsets, of those that either document has a
term in, in which both have the same terms.

The band's lower end bounds the lexicon: a term in it is in at least
exp(-idf_high) of the documents, so there are at most exp(idf_high) times the mean
number of distinct terms of a document, whatever the size of the corpus. It is
collected and comes back as a literal.

A document without a term in the band keeps all its terms; one without terms (a
null text is the empty one) hashes its text. Equal texts have equal fingerprints.
The next document is the one with the next greater id; ties in id go by text, null
ids come first, repeated rows follow each other, and after the last comes the
first. An empty table gives an empty one.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kept terms are in 0.5 % to 2 % of the documents.
IDF_LOW, IDF_HIGH = math.log(1 / 0.02), math.log(1 / 0.005)
CELLS = 48
TIERS = 8
LOOKUP = 1 << 14
#: Rows of a block of neighbouring ids, and blocks at most.
BLOCK_ROWS, BLOCKS = 512, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda's variable is not copied into it."""
    return F.transform(F.array(value), body)[0]


def term_hashes(text: Column) -> Column:
    terms = F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")
    return F.transform(terms, lambda t: F.xxhash64(t))


def lexicon(docs: DataFrame, text: Column, idf_low: float = IDF_LOW, idf_high: float = IDF_HIGH) -> list[int]:
    """Hashes of the terms in the band."""
    n = docs.count()
    low, high = n * math.exp(-idf_high) * (1 - 1e-9), n * math.exp(-idf_low) * (1 + 1e-9)  # ends belong to the band, whatever rounding does
    df = docs.select(F.explode(term_hashes(text)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return [r.term for r in df.where((F.col("df") >= low) & (F.col("df") <= high)).select("term").collect()]


def member(terms: list[int]) -> Callable[[Column], Column]:
    """Whether a hash is one of ``terms``: a literal table of short buckets."""
    buckets: list[list[int]] = [[] for _ in range(LOOKUP)]
    for t in terms:
        buckets[t % LOOKUP].append(t)
    table = F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<array<bigint>>")
    return lambda h: F.array_contains(F.element_at(table, (F.pmod(h, F.lit(LOOKUP)) + 1).cast("int")), h)


def subset_hashes(kept: Column, tier: Column) -> Column:
    """One hash for each randomised subset of the tier, empty where no term is in it; joined by commas."""
    wide = F.lit(CELLS) * F.pow(F.lit(4), tier).cast("bigint")
    placed = F.filter(F.transform(kept, lambda h: F.struct(F.pmod(F.xxhash64(h, tier), wide).alias("cell"), h.alias("h"))), lambda p: p["cell"] < CELLS)

    def one(p: Column, c: Column) -> Column:
        return let(F.filter(p, lambda x: x["cell"] == c), lambda own: F.when(F.size(own) > 0, F.hex(F.pmod(F.xxhash64(F.transform(own, lambda x: x["h"])), F.lit(1 << 32)))).otherwise(""))

    return let(placed, lambda p: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda c: one(p, c)), ","))


def fingerprint(text: Column, inside: Callable[[Column], Column]) -> Column:
    def of_terms(terms: Column) -> Column:
        return let(F.filter(terms, inside), lambda kept: F.when(F.size(kept) > 0, kept).when(F.size(terms) > 0, terms).otherwise(F.array(F.xxhash64(text))))

    def of_kept(kept: Column) -> Column:
        tier = F.lit(TIERS)
        for k in reversed(range(TIERS)):
            tier = F.when(F.size(kept) <= CELLS * 4**k, k).otherwise(tier)
        return let(tier, lambda t: F.concat_ws(";", t.cast("string"), subset_hashes(kept, t), subset_hashes(kept, t + 1)))

    return let(let(term_hashes(text), of_terms), lambda kept: let(F.array_sort(kept), of_kept))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; 1 for equal fingerprints, 0 if the documents' tiers are further apart than one."""

    def compare(x: Column, y: Column) -> Column:
        tier_x, tier_y = x[0].cast("int"), y[0].cast("int")
        at = F.greatest(tier_x, tier_y)
        own = lambda parts, tier: F.split(parts[F.when(tier == at, 1).otherwise(2)], ",")
        both = F.zip_with(own(x, tier_x), own(y, tier_y), lambda p, q: F.when((p == "") & (q == ""), F.lit(None)).otherwise((p == q).cast("int")))
        share = let(F.array_compact(both), lambda z: F.when(F.size(z) > 0, F.aggregate(z, F.lit(0), lambda s, v: s + v) / F.size(z)).otherwise(0.0))
        return F.when(F.abs(tier_x - tier_y) > 1, F.lit(0.0)).otherwise(share)

    return F.when(a == b, F.lit(1.0)).otherwise(let(F.split(a, ";"), lambda x: let(F.split(b, ";"), lambda y: compare(x, y))))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` (doc_id, text, ...) with next_<column>: those of the next row by (doc_id, text).

    Rows are dealt into blocks of neighbouring ids; each block also gets the first row
    of the next block. So the texts are shuffled once and no task holds more than a block.
    """
    blocks = max(1, min(BLOCKS, docs.count() // BLOCK_ROWS))
    cuts = docs.select(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)] or [0.5], 20 * blocks).alias("c")).first().c if blocks > 1 else []
    cuts = sorted(set(cuts or []))
    at = F.size(F.filter(F.from_json(F.lit(json.dumps(cuts)), "array<bigint>"), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    rows = docs.withColumn("block", F.coalesce(at, F.lit(0)))

    least = rows.groupBy("block").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    firsts = rows.join(F.broadcast(least), "doc_id", "left_semi").unionByName(rows.where("doc_id is null"))
    firsts = firsts.groupBy("block").agg(F.min(F.struct("doc_id", *columns)).alias("row"))
    # only the blocks' numbers, at most BLOCKS of them, are put in one order; a text goes to the block before its own
    around = Window.orderBy("block")
    everything = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = rows.select("block").distinct().select("block", F.coalesce(F.lead("block").over(around), F.first("block").over(everything)).alias("next_block"))
    ends = firsts.withColumnRenamed("block", "next_block").join(F.broadcast(before), "next_block")
    ends = ends.select(F.lit(None).cast("bigint").alias("doc_id"), *(F.col("row")[c].alias(c) for c in columns), "block", F.lit(1).alias("end"))

    within = Window.partitionBy("block").orderBy("end", "doc_id", "text")
    both = rows.withColumn("end", F.lit(0)).unionByName(ends)
    return both.select("doc_id", *columns, "end", *(F.lead(c).over(within).alias(f"next_{c}") for c in columns)).where("end = 0").drop("end")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's rows: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    inside = member(lexicon(rows, F.col("text")))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("text"), inside))
    n = F.length("text").cast("bigint")
    edited = F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 2)).cast("int")), F.substring("next_text", F.lit(1), F.floor(n / 2).cast("int")))
    rows = with_next(rows, ["text", "fingerprint"]).select("doc_id", n.alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited"), inside).alias("edited_fingerprint"), "next_fingerprint")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
