"""Personal data, with information-theoretic sanitisation of the terms around it.

Each distinct value found by the base kinds is a protected entity. Terms are the
words outside base spans, over the whole text of each document that mentions an
entity. Over all documents, a term's co-occurrence with an entity gives their
pointwise mutual information,

    PMI(e; t) = ln(N * c(e, t) / (c(e) * c(t))),

c counting documents; it reaches the entity's information content ln(N / c(e)) when
the term gives the entity away. That is so when p(e | t) = c(e, t) / c(t) is 1, which
few documents show badly: it is smoothed by PRIOR documents of the term in which the
entity is as common as anywhere,

    p(e | t) = (c(e, t) + PRIOR * c(e) / N) / (c(t) + PRIOR),

and PMI(e; t) = ln(p(e | t) * N / c(e)). A term is removed from REMOVE of the
information content on and generalised from GENERALISE on. Every pair is decided,
those of a single document too, and every occurrence of a term is marked in all
documents that mention the entity. An entity of all documents has no information
content and marks nothing. Entities of the very same documents are counted as one,
so a list of many addresses does not multiply its terms.

A null text is the empty text. Repeated rows are scanned alike and stay; an empty
table gives an empty one. Texts of any length are scanned whole, in linear time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, stored

KINDS = ("email", "ip", "card", "phone")
ACTIONS = ("generalise", "remove")
PRIOR = 1.0
REMOVE, GENERALISE = 0.9, 0.75
COUNTED = 200_000

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: As ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`` matches, whose matches begin and end with a run of digits, but in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")

Span = tuple[int, int, str]  # start, end, kind


def emails(text: str) -> list[Span]:
    """As leftmost matching of ``[A-Za-z0-9._%+-]+@`` and DOMAIN finds them, but each @ is looked at once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def within_255(number: str) -> bool:
    number = number.lstrip("0")
    return len(number) <= 3 and int(number or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out = emails(text)
    if not DIGIT.search(text):
        return out
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(map(within_255, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def words(text: str, spans: list[Span]) -> Iterator[re.Match]:
    """The words outside ``spans``."""
    at = 0
    for start, end, _ in sorted(spans):
        if start > at:
            yield from WORD.finditer(text, at, start)
        at = max(at, end)
    yield from WORD.finditer(text, at)


SPAN = "array<struct<start: long, end: long, kind: string>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def as_rows(spans: list[Span]) -> list[dict]:
    return [{"start": a, "end": b, "kind": k} for a, b, k in spans]


def as_spans(rows: list[dict]) -> list[Span]:
    return [(s["start"], s["end"], s["kind"]) for s in rows]


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, base, entities (distinct, as hashes), text (only of rows with entities): a row for every row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in sliced(batches):
            base, entities, texts = [], [], []
            for text in batch.column(2).to_pylist():
                found = base_spans(text or "")
                base.append(as_rows(found))
                entities.append(sorted({xxhash.xxh64_intdigest(f"{k}:{text[a:b].lower()}") >> 1 for a, b, k in found}))
                texts.append(text if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, SPAN_TYPE), pa.array(entities, pa.list_(pa.int64())), pa.array(texts, pa.string())], ["row", "doc_id", "base", "entities", "text"])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), F.col(text_col)).mapInArrow(run, f"row long, doc_id {kind}, base {SPAN}, entities array<long>, text string")


def pairs_by_row(held: DataFrame) -> DataFrame:
    """row, class, ce, term: each term of each row with each class of entities there; a class has the same ce rows."""
    mentions = held.select("row", F.explode("entities").alias("entity"))
    rows = F.bit_xor(F.xxhash64("row")), F.bit_xor(F.xxhash64("row", F.lit(1)))
    classes = mentions.groupBy("entity").agg(F.count("*").alias("ce"), F.xxhash64(F.count("*"), *rows).alias("class"))
    classes = stored(mentions.join(classes, "entity").select("row", "class", "ce").distinct())

    def run(batches):
        for batch in sliced(batches, 100):
            texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            terms = [list({m[0].lower() for m in words(t, as_spans(s))}) for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], ["row", "terms"])

    terms = held.select("row", "text", "base").mapInArrow(run, "row long, terms array<string>")
    return terms.join(classes, "row").select("row", "class", "ce", F.explode("terms").alias("term"))


def document_frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """term, c: the number of documents that hold it, over all documents."""

    def run(batches):
        counts: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "c"])

        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update({w.lower() for w in set(WORD.findall(text))})
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    return docs.select(text_col).mapInArrow(run, "term string, c long").groupBy("term").agg(F.sum("c").alias("c"))


def disclosing(pairs: DataFrame, n: int, docs: DataFrame, text_col: str) -> DataFrame:
    """class, term, action: the pairs whose mutual information passes a threshold, of ``n`` documents."""
    both = pairs.where(F.col("ce") < n).groupBy("class", "term").agg(F.count("*").alias("both"), F.max("ce").alias("ce"))
    # a word that touches a span may be no word of the whole text
    found = both.join(document_frequencies(docs, text_col), "term", "left").withColumn("c", F.greatest("both", "c"))
    return found.select("class", "term", action(n).alias("action")).where("action is not null")


def action(n: int) -> Column:
    """What is done with a term of ``c`` documents, ``both`` of them with an entity of ``ce`` documents; ce < n."""
    prior = F.col("ce") / F.lit(float(n))
    share = 1 - F.log((F.col("both") + PRIOR * prior) / (F.col("c") + PRIOR)) / F.log(prior)
    return F.when(share >= REMOVE, "remove").when(share >= GENERALISE, "generalise")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def marked_spans(held: DataFrame) -> DataFrame:
    """doc_id, base, spans: ``base``, then every occurrence of the terms in ``marks``."""

    def run(batches):
        for batch in sliced(batches, 100):
            spans = []
            for base, text, marks in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                actions = {m["term"]: m["action"] for m in marks or ()}
                found = as_spans(base)
                more = [(m.start(), m.end(), actions[t]) for m in words(text, found) if (t := m[0].lower()) in actions] if actions else []
                spans.append(as_rows(found + sorted(more, key=lambda s: (s[2], s[0]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, SPAN_TYPE)], ["doc_id", "base", "spans"])

    return held.select("doc_id", "base", "text", "marks").mapInArrow(run, f"doc_id {dict(held.dtypes)['doc_id']}, base {SPAN}, spans {SPAN}")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, spans: base spans, and those with the terms to generalise or remove."""
    scanned = stored(scan(docs, id_col, text_col))
    held = scanned.where(F.size("entities") > 0)
    pairs = pairs_by_row(held)
    marked = disclosing(pairs, scanned.count(), docs, text_col)
    more = pairs.join(marked, ["class", "term"]).groupBy("row", "term").agg(F.max("action").alias("action"))  # remove beats generalise
    more = more.groupBy("row").agg(F.collect_list(F.struct("term", "action")).alias("marks"))
    plain = scanned.where(F.size("entities") == 0).select("doc_id", "base", F.col("base").alias("spans"))
    return plain.unionByName(marked_spans(held.join(more, "row", "left")))


def personal(docs: DataFrame) -> DataFrame:
    """The query's rows: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(docs).select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def sanitised(text: str, spans: list[Span]) -> str:
    """``text`` with entities replaced by their kind, generalised terms by [TERM], removed ones by nothing."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start < at:
            continue
        out += [text[at:start], "" if kind == "remove" else "[TERM]" if kind == "generalise" else f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])
