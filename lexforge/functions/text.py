"""Text normalisation: folding, the token grammar, long-term digests, literals.

Column functions for tables; plain Python twins for single queries on the driver.

Grammar. An occurrence is a maximal run of alphanumerics, ``_`` and the separators
``- . : / \\``. Each run between separators that holds an alphanumeric gives its
components (cut at ``_`` and at case boundaries, never at digits) and itself, each
once. An occurrence with a separator also gives itself, less one trailing
separator if another remains. Everything is folded; a form of more than
LONG_BYTES bytes is replaced by a digest.

Null texts have no tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALNUM = r"\p{IsAlphabetic}\p{N}"
OCCURRENCE = rf"[{ALNUM}_.:/\\-]+"
SEPARATORS = r"[-.:/\\]"
#: A plain word's only form is itself, folded; one separator behind it makes the whole a second form.
WORD = r"(?:\p{IsUppercase}?\p{IsLowercase}+|\p{IsUppercase}+|[0-9]+)"
PLAIN, ENDED = rf"^{WORD}$", rf"^{WORD}[-.:/\\]$"
BOUNDARY = r"_+|(?<=\p{IsLowercase})(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})"
LONG_BYTES = 256
LONG_MARK = "\x00long:"
#: Bytes of a text that its fields, but the body, and its declarations are taken from.
FIELD_BYTES = 16_384

#: Characters whose classes and folds are the same in Java and in Python, whatever their versions of Unicode.
TWIN = r"\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac"
#: All other characters. In Java a class of what is wanted is fast to look for, a negated union is not.
NO_TWIN = r"[\u0250-\u200f\u2028-\u202f\u205f-\u20ab\u20ad-\x{10ffff}]"
#: Rows whose terms are one batch of the twin; occurrences whose forms it keeps.
TWIN_ROWS, TWIN_FORMS = 256, 200_000

#: The common folds that lower-casing alone does not make, and all of them by Unicode's full case folding.
FOLDS = (("ß", "ss"), ("ſ", "s"), ("ς", "σ"))
RARE_FOLDS = {c: f for c in map(chr, (*range(0xD800), *range(0xE000, 0x20000))) if (f := c.casefold()) != c.lower() and c not in "ßſς"}

#: Words that carry no meaning in a question.
STOPWORDS = tuple(
    "a an the is are was were be been to of in on at by for and or as it its we i you that this those what why how when where "
    "did do does have has had with from about after before yesterday thing can could would should".split()
)
#: Code words that say nothing of a text's subject.
GENERIC = tuple(
    "fn func function let const var pub public private return class struct impl self this true false null none some if else match "
    "use import export int string str void new value data".split()
)


def fold(text: Column) -> Column:
    """Full case folding: ASCII is lower-cased, common letters replaced, and only texts with rare ones go character by character."""
    common = F.lower(text)
    for a, b in FOLDS:
        common = F.replace(common, F.lit(a), F.lit(b))
    table = F.from_json(F.lit(json.dumps(RARE_FOLDS | dict(FOLDS))), "map<string, string>")
    rare = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(table, c), F.lower(c))), "")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).when(F.length(F.translate(text, "".join(RARE_FOLDS), "")) < F.length(text), rare).otherwise(common)


def bounded(text: Column) -> Column:
    """The first FIELD_BYTES bytes, less a character that they cut."""
    raw = F.encode(text, "UTF-8")
    goes_on = lambda n: F.hex(F.substring(raw, n + 1, 1)).rlike("^[89AB]")
    cut = F.lit(FIELD_BYTES - 3)
    for n in range(FIELD_BYTES - 2, FIELD_BYTES + 1):
        cut = F.when(~goes_on(n), n).otherwise(cut)
    return F.when(F.octet_length(text) <= FIELD_BYTES, text).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))


def digested(form: Column) -> Column:
    return F.when(F.octet_length(form) > LONG_BYTES, F.concat(F.lit(LONG_MARK), F.sha2(form, 256))).otherwise(form)


def occurrences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(OCCURRENCE), F.lit(0))


def run_forms(run: Column) -> Column:
    parts = F.filter(F.split(run, BOUNDARY), lambda c: c.rlike(rf"[{ALNUM}]"))
    return F.array_distinct(F.concat(F.transform(parts, fold), F.array(fold(run))))


def forms(occurrence: Column) -> Column:
    """All forms of one occurrence, with multiplicity."""
    runs = F.filter(F.split(occurrence, rf"{SEPARATORS}+"), lambda r: r.rlike(rf"[{ALNUM}]"))
    shorter = F.regexp_replace(occurrence, rf"{SEPARATORS}$", "")
    surface = F.when(shorter.rlike(SEPARATORS), shorter).otherwise(occurrence)
    whole = F.when(occurrence.rlike(SEPARATORS) & occurrence.rlike(rf"[{ALNUM}]"), F.array(fold(surface))).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.flatten(F.transform(runs, run_forms)), whole)
    word = F.substring(occurrence, F.lit(1), F.length(occurrence) - 1)
    return (
        F.when(occurrence.rlike(PLAIN), F.array(digested(fold(occurrence)))).when(occurrence.rlike(ENDED), F.array(digested(fold(word)), digested(fold(occurrence))))
        .otherwise(F.transform(every, digested))
    )


def tokens(text: Column) -> Column:
    """All terms of a short text, in order of the occurrences."""
    return F.flatten(F.transform(occurrences(text), forms))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def runs(values: Column, same, entry) -> Column:
    """One entry(values, first, length) for each run of equal neighbours of a sorted array; ``same`` compares two of them."""
    at = lambda i: F.get(values, i - 1)
    firsts = F.filter(F.sequence(F.lit(1), F.size(values)), lambda i: (i == 1) | ~same(at(i), at(i - 1)))
    ends = lambda f: F.concat(F.slice(f, F.lit(2), F.size(f)), F.array(F.size(values) + 1))
    found = let(firsts, lambda f: F.transform(F.arrays_zip(f.alias("first"), ends(f).alias("end")), lambda r: entry(values, r["first"], r["end"] - r["first"])))
    return F.when(F.size(values) > 0, found)


def term_counts(text: Column) -> Column:
    """array of (term, tf) of one text, each term once; null or empty for a text without terms. Looks at nothing but its row."""
    one = F.lit(1).cast("long")
    counted = let(F.sort_array(occurrences(text)), lambda s: runs(s, lambda a, b: a == b, lambda v, i, n: F.struct(F.get(v, i - 1).alias("o"), (one * n).alias("n"))))
    every = F.flatten(F.transform(counted, lambda c: F.transform(forms(c["o"]), lambda t: F.struct(t.alias("term"), c["n"].alias("tf")))))
    total = lambda v, i, n: F.when(n == 1, F.get(v, i - 1)["tf"]).otherwise(F.aggregate(F.slice(v, i, n), F.lit(0).cast("long"), lambda x, y: x + y["tf"]))
    return let(F.sort_array(every), lambda s: runs(s, lambda a, b: a["term"] == b["term"], lambda v, i, n: F.struct(F.get(v, i - 1)["term"].alias("term"), total(v, i, n).alias("tf"))))


def term_rows(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys..., term, tf of each row for itself: by ``term_counts``, or by its twin where a text has twin characters only."""
    twin = ~F.coalesce(F.col(text).rlike(NO_TWIN), F.lit(True))
    told = rows.select(*keys, F.when(twin, F.col(text)).alias("_text"), F.when(~twin, term_counts(F.col(text))).alias("_counts"))
    out = T.StructType([*(T.StructField(k, told.schema[k].dataType) for k in keys), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, TWIN_ROWS):
                batch = whole.slice(at, TWIN_ROWS)
                rows_, terms, tfs = [], [], []
                texts, others = batch.column(len(keys)), batch.column(len(keys) + 1)
                for i in range(batch.num_rows):
                    if len(known) > TWIN_FORMS:
                        known.clear()
                    text_ = texts[i].as_py()
                    found = text_counts(text_, known) if text_ is not None else {c["term"]: c["tf"] for c in others[i].as_py() or ()}
                    rows_ += [i] * len(found)
                    terms += found
                    tfs += found.values()
                own = [batch.column(k).take(pa.array(rows_, pa.int64())) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], names=out.names)

    return told.mapInArrow(run, out)


def term_frequencies(rows: DataFrame, key: str | list[str], text: str) -> DataFrame:
    """key..., term, tf: of a small table; shuffles the terms of each row. Rows of one key count together."""
    keys = [key] if isinstance(key, str) else key
    found = term_rows(rows, keys, text)
    return found.groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys that more than one row has; None if there are none. Reads the keys only."""
    again = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys)
    return None if again.isEmpty() else again


def frequencies(rows: DataFrame, key: str | list[str], text: str) -> DataFrame:
    """``term_frequencies`` of a table of any size: each row counts its own terms, and only rows that share a key with another are shuffled."""
    keys = [key] if isinstance(key, str) else key
    again = repeated(rows, keys)
    if again is None:
        return term_rows(rows, keys, text)
    same = reduce(and_, (F.col(f"own.{k}").eqNullSafe(F.col(f"again.{k}")) for k in keys))
    of = lambda how: rows.alias("own").join(again.alias("again"), same, how)
    return term_rows(of("left_anti"), keys, text).unionByName(term_frequencies(of("left_semi"), keys, text))


def contains_literal(body: Column, literal: str) -> Column:
    """``literal`` stands in ``body`` with no alphanumeric or ``_`` on either side."""
    edge = rf"[{ALNUM}_]"
    return body.rlike(rf"(?<!{edge}){java_quote(literal)}(?!{edge})")


def java_quote(literal: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", literal, flags=re.ASCII)


# Python twins

_OCCURRENCE = regex.compile(r"[\p{Alphabetic}\p{N}_.:/\\-]+")
_BOUNDARY = regex.compile(r"_+|(?<=\p{Lowercase})(?=\p{Uppercase})|(?<=\p{Uppercase})(?=\p{Uppercase}\p{Lowercase})")
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")
_SEPARATORS = regex.compile(SEPARATORS)
#: Occurrences of texts of TWIN characters only; the plain and ended words among them that are ASCII.
_TWIN = re.compile(f"[{re.escape(''.join(c for c in map(chr, range(0x2100)) if re.match(f'[{TWIN}]', c) and _OCCURRENCE.match(c)))}]+")
_WORD = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)([-.:/\\]?)")


def fold_text(text: str) -> str:
    return "".join(c.casefold() for c in text)


def digest_form(form: str) -> str:
    raw = form.encode("utf-8", "surrogatepass")
    return LONG_MARK + hashlib.sha256(raw).hexdigest() if len(raw) > LONG_BYTES else form


def text_tokens(text: str, whole_first: bool = False) -> list[str]:
    out: list[str] = []
    for occurrence in _OCCURRENCE.findall(text):
        found: list[str] = []
        for run in regex.split(r"[-.:/\\]+", occurrence):
            if _ALNUM.search(run):
                parts = [fold_text(c) for c in _BOUNDARY.split(run) if c and _ALNUM.search(c)]
                found += list(dict.fromkeys([fold_text(run), *parts] if whole_first else [*parts, fold_text(run)]))
        if _SEPARATORS.search(occurrence) and _ALNUM.search(occurrence):
            shorter = occurrence[:-1] if _SEPARATORS.match(occurrence[-1]) else occurrence
            whole = fold_text(shorter if _SEPARATORS.search(shorter) else occurrence)
            found = [whole, *found] if whole_first else [*found, whole]
        out += map(digest_form, found)
    return out


def text_counts(text: str, known: dict[str, list[str]]) -> dict[str, int]:
    """The twin of ``term_counts`` for texts of TWIN characters; ``known`` keeps the forms of occurrences that are no plain words."""
    found: dict[str, int] = {}
    had, word = found.get, _WORD.fullmatch
    for occurrence, n in Counter(_TWIN.findall(text)).items():
        if len(occurrence) <= LONG_BYTES and (plain := word(occurrence)):
            term = occurrence.lower()
            found[term] = had(term, 0) + n
            if plain[1]:
                found[term[:-1]] = had(term[:-1], 0) + n
            continue
        if (every := known.get(occurrence)) is None:
            every = text_tokens(occurrence)
            if len(occurrence) <= LONG_BYTES:
                known[occurrence] = every
        for term in every:
            found[term] = had(term, 0) + n
    return found


def text_surfaces(text: str) -> list[str]:
    """Whole occurrences, folded, trailing separators trimmed."""
    found = (fold_text(o.rstrip("-.:/\\")) for o in _OCCURRENCE.findall(text) if _ALNUM.search(o))
    return [o for o in found if o]


def is_generic(term: str) -> bool:
    return term in STOPWORDS or term in GENERIC or len(term.encode()) < 2
