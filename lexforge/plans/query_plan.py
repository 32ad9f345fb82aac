"""Query classes, plans and probes.

``QueryPlan`` is the driver's object for one query; ``classified`` is the same
classification as a column, for tables of queries.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, fold_text, text_surfaces, text_tokens

MAX_PROBES, MAX_TERMS, MAX_REDUCED = 6, 256, 16
DERIVED, MORPHOLOGY, ALIAS = 0.8, 0.6, 0.4

#: File name extensions that make a word a path.
EXTENSIONS = tuple("rs ts tsx js jsx py go java kt swift c h cpp hpp cs rb php json toml yaml yml xml md txt sql sh bash zsh lock".split())
#: Families of inflections.
FAMILIES = (
    ("delete", "deleted", "deleting", "deletion"), ("fix", "fixed", "fixing"),
    ("crash", "crashed", "crashing"), ("serialize", "serialized", "serialization"),
)
#: Words that stand for each other.
ALIASES = {a: b for pair in (("remove", "delete"), ("terminate", "kill"), ("panic", "crash"), ("ctor", "constructor")) for a, b in (pair, pair[::-1])}

CODE = r"(?i)^(?:(?:E|TS|CS|C)[0-9]{2,}$|ERR_|ERR-|ERROR\[|WARNING\[)"
PATH = rf"(?:[/\\]|\.(?i:{'|'.join(EXTENSIONS)})$)"


def classify(query: str) -> str:
    q = query.strip()
    if (q.startswith('"') and q.endswith('"') and len(q.encode()) > 2) or re.search(CODE, q, re.ASCII):
        return "diagnostic"
    words = q.split()
    if len(words) <= 1 and not re.search(r"\s", q):
        if re.search(PATH, q):
            return "path"
        if re.search(r"_|::|\.", q) or any(c.isupper() for c in q):
            return "identifier"
    return "mixed" if any(re.search(r"_|::|/", w) for w in words) else "natural"


def classified(query: Column) -> Column:
    q = F.regexp_replace(query, r"^\s+|\s+$", "")
    single = ~q.rlike(r"\s")
    return (
        F.when((q.startswith('"') & q.endswith('"') & (F.octet_length(q) > 2)) | q.rlike(CODE), "diagnostic")
        .when(single & q.rlike(PATH), "path")
        .when(single & q.rlike(r"_|::|\.|\p{IsUppercase}"), "identifier")
        .when(q.rlike(r"_|::|/"), "mixed").otherwise("natural")
    )


@dataclass(frozen=True)
class Probe:
    query: str
    weight: float
    origin: str


@dataclass(frozen=True)
class QueryPlan:
    query: str
    cls: str
    literal: str
    original: tuple[str, ...]
    stopwords_removed: bool
    probes: tuple[Probe, ...] = field(default=())

    @staticmethod
    def of(query: str, classification: bool = True) -> QueryPlan:
        cls = classify(query) if classification else "mixed"
        terms, surfaces = text_tokens(query, whole_first=True), text_surfaces(query)
        literal = surfaces[0] if cls == "identifier" and len(surfaces) == 1 else fold_text(query.strip().strip('"'))
        every = list(dict.fromkeys(terms))[:MAX_TERMS]
        kept = [t for t in every if t not in STOPWORDS] if cls == "natural" else every
        dropped = 0 < len(kept) < len(every)
        kept = kept or every
        return QueryPlan(query, cls, literal, tuple(kept), dropped, tuple(probes(cls, terms, kept, literal, dropped)))

    def expansion_terms(self) -> dict[str, float]:
        """term -> largest weight of a probe that has it, without the query's own terms."""
        out: dict[str, float] = {}
        for p in self.probes:
            for t in text_tokens(p.query):
                if t not in self.original:
                    out[t] = max(out.get(t, 0.0), p.weight)
        return out


def probes(cls: str, terms: list[str], kept: list[str], literal: str, dropped: bool) -> list[Probe]:
    if cls not in ("natural", "mixed"):
        return []
    found = []
    reduced = " ".join([t for t in terms if t not in STOPWORDS][:MAX_REDUCED])
    if reduced and reduced != literal and not dropped:
        found.append(Probe(reduced, DERIVED, "reduced"))
    for term in kept:
        found += [Probe(v, MORPHOLOGY, "morphology") for family in FAMILIES if term in family for v in family if v not in kept]
        if term in ALIASES:
            found.append(Probe(ALIASES[term], ALIAS, "alias"))
    first = {p.query: p for p in reversed(found)}
    return [p for p in dict.fromkeys(found) if first[p.query] is p][: MAX_PROBES - dropped]
