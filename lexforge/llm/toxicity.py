"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols of a small alphabet (insult, threat, target, copula,
intent, negation, mention, reporting verb, quotation mark, any other). Deterministic
weighted transducers are composed into one. A first one reads a clause from its end and
marks insults and threats that a target follows; the others read it from its start:
threats need intent, insults match, a negation or reported speech before a match
lowers it, and a match that no target and no copula belongs to keeps only BARE of
its weight. A clause's score is the noisy-or of its matches (a word said twice in a
clause is one), the document's that of its clauses: so a lone insulting word decides
nothing, and what is said to or of somebody does. Quotation lasts over clauses, to
its closing mark or the end of the line.

The insult lexicon is learned: words, and word beginnings written ``stem*``,
whose share of toxic documents has a high lower confidence bound in a bounded
sample of labelled rows. A null or empty text, or one without a match, scores
``FLOOR``. Repeated rows are scored alike and stay; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, held_out, labelled_sample, per_row, sliced, trim

FLOOR = 0.02
THRESHOLD = 0.7
#: Labelled rows the lexicon is learned from, at most.
TRAIN_ROWS = 24_000
#: Entries of the lexicon, at most: the strongest ones.
LEXICON_ENTRIES = 5_000
STEMS = (4, 5, 6, 7)
#: Features counted in a task before they are handed on.
COUNTED = 300_000

NEGATIONS = frozenset("not never no nobody none neither nor without hardly cannot nicht kein keine keiner nie niemand ohne pas jamais ni personne aucun aucune sans nunca tampoco nadie ningún ninguna sin".split())
REPORTS = frozenset("said says wrote claimed called quoted alleged sagte schrieb nannte dit écrit dijo escribió".split())
#: What speaks of a word instead of using it.
MENTIONS = frozenset("word words term terms expression phrase wort wörter begriff ausdruck mot mots terme expression palabra palabras término expresión".split())
TARGETS = frozenset("you your you're they them he him she her people du dich dir ihr euch sie tu toi te vous eux ellos ella usted vosotros".split())
COPULAS = frozenset("am is are was were be been being i'm he's she's they're ist sind war waren bist seid est sont es suis était étaient son eres somos era eran".split())
THREATS = frozenset("kill hurt destroy beat punish attack töten schlagen vernichten tuer frapper détruire matar golpear destruir".split())
INTENTS = frozenset("will shall gonna i'll we'll going werde werden vais allons voy vamos".split())
QUOTES = "\"“”„«»"

CLAUSE = re.compile(r"[^.!?;\n]+")
TOKEN = re.compile(rf"[\w'’]+|[{QUOTES}]")
WORD = re.compile(r"[\w'’]+")
QUOTE = re.compile(f"[{QUOTES}]")

#: Weights: of a match without target or copula, of a threat without target, of a negated one, of reported speech or a mention.
BARE, AIMLESS, NEGATED, REPORTED = 0.6, 0.25, 0.35, 0.4


class Transducer:
    """Deterministic and weighted: ``step(state, symbol) -> (state, symbol, weight)``; a missing arc copies the symbol."""

    def __init__(self, start: object, step) -> None:
        self.start, self._step, self._arcs = start, step, {}

    def step(self, state: object, symbol: str) -> tuple[object, str, float]:
        arc = self._arcs.get((state, symbol))
        if arc is None:
            arc = self._arcs[state, symbol] = self._step(state, symbol)
        return arc

    def then(self, other: Transducer) -> Transducer:
        """Composition: this one's output symbols are the other's input, weights multiply."""

        def step(state: tuple, symbol: str) -> tuple[tuple, str, float]:
            a, middle, v = self.step(state[0], symbol)
            b, out, w = other.step(state[1], middle)
            return (a, b), out, v * w

        return Transducer((self.start, other.start), step)


def aimed(reach: int = 4) -> Transducer:
    """Read from a clause's end: insults and threats that a target follows within ``reach`` words get a +."""

    def step(state: int, symbol: str):
        if symbol == "target":
            return reach, symbol, 1.0
        return max(0, state - 1), symbol + "+" if state and symbol in ("insult", "threat") else symbol, 1.0

    return Transducer(0, step)


def threat(reach: int = 4) -> Transducer:
    """A threatening verb counts only within ``reach`` words after a sign of intent, and fully only if it is aimed."""

    def step(state: int, symbol: str):
        if symbol == "intent":
            return reach, "other", 1.0
        if symbol in ("threat", "threat+"):
            return (0, "match+", 1.0 if symbol == "threat+" else AIMLESS) if state else (0, "other", 1.0)
        return max(0, state - 1), symbol, 1.0

    return Transducer(0, step)


def insult() -> Transducer:
    return Transducer(0, lambda state, symbol: (0, symbol.replace("insult", "match"), 1.0))


def negation(reach: int = 5) -> Transducer:
    def step(state: int, symbol: str):
        if symbol == "negation":
            return reach, "other", 1.0
        return max(0, state - 1), symbol, NEGATED if symbol in ("match", "match+") and state else 1.0

    return Transducer(0, step)


def reported(reach: int = 3) -> Transducer:
    """Within quotation marks, after a reporting verb until the clause ends, or within ``reach`` words after a mention."""

    def step(state: tuple[bool, bool, int], symbol: str):
        quoted, after, named = state
        if symbol == "quote":
            return (not quoted, after, named), "other", 1.0
        if symbol == "report":
            return (quoted, True, named), "other", 1.0
        if symbol == "mention":
            return (quoted, after, reach), "other", 1.0
        return (quoted, after, max(0, named - 1)), symbol, REPORTED if symbol in ("match", "match+") and (quoted or after or named) else 1.0

    return Transducer((False, False, 0), step)


def target(reach: int = 4) -> Transducer:
    """A match that neither follows a target or copula within ``reach`` words nor is aimed keeps BARE of its weight."""

    def step(state: int, symbol: str):
        if symbol in ("target", "copula"):
            return reach, "other", 1.0
        aim = symbol == "match+" or symbol == "match" and state > 0
        return max(0, state - 1), "match" if symbol in ("match", "match+") else "other", 1.0 if aim or symbol != "match" else BARE

    return Transducer(0, step)


class Grammar:
    """The composed machine, and the one that runs before it from the other end."""

    def __init__(self) -> None:
        self.back = aimed()
        self.ahead = threat().then(insult()).then(negation()).then(reported()).then(target())

    def start(self, quoted: bool) -> object:
        rest, _ = self.ahead.start
        before, _ = rest
        return (before, (quoted, False, 0)), 0

    def run(self, symbols: list[str], quoted: bool) -> list[float]:
        """The weight of each symbol's match, 0 where none is."""
        marked, state = [], self.back.start
        for s in reversed(symbols):
            state, s, _ = self.back.step(state, s)
            marked.append(s)
        out, state = [], self.start(quoted)
        for s in reversed(marked):
            state, kind, weight = self.ahead.step(state, s)
            out.append(weight if kind == "match" else 0.0)
        return out


class Memo(Recent):
    """word -> weight of the strongest lexicon entry that fits it, 0 without one."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def make(self, word: str) -> float:
        found = [self.lexicon.get(word, 0.0), *(self.lexicon.get(f"{word[:n]}*", 0.0) for n in STEMS if len(word) >= n), 0.9 if word in THREATS else 0.0]
        return max(found)


def symbol(word: str, memo: Memo) -> str:
    if word in NEGATIONS or word.endswith("n't"):
        return "negation"
    for kind, words in (("report", REPORTS), ("mention", MENTIONS), ("target", TARGETS), ("copula", COPULAS), ("intent", INTENTS), ("threat", THREATS)):
        if word in words:
            return kind
    return "quote" if word in QUOTES else "insult" if memo[word] else "other"


def clause_scores(text: str, memo: Memo, machine: Grammar) -> list[tuple[int, int, float]]:
    """(start, end, score) of every clause with a match."""
    out, quoted, at = [], False, 0
    quotes = QUOTE.search(text) is not None
    for clause in CLAUSE.finditer(text):
        if quotes and "\n" in text[at : clause.start()]:
            quoted = False
        at = clause.end()
        own = clause[0]
        if any(map(memo.__getitem__, WORD.findall(own.lower()))):
            words = TOKEN.findall(own.lower().replace("’", "'"))
            best: dict[str, float] = {}
            for word, weight in zip(words, machine.run([symbol(w, memo) for w in words], quoted), strict=True):
                if weight:
                    best[word] = max(best.get(word, 0.0), weight * memo[word])
            if best:
                out.append((clause.start(), clause.end(), 1.0 - math.prod(1.0 - w for w in best.values())))
        if quotes:
            quoted ^= len(QUOTE.findall(own)) % 2 == 1
    return out


def score_text(text: str, memo: Memo, machine: Grammar) -> tuple[float, list[tuple[int, int, float]]]:
    if not any(map(memo.__getitem__, WORD.findall(text.lower()))):
        return FLOOR, []
    clauses = clause_scores(text, memo, machine)
    return max(FLOOR, 1.0 - math.prod(1.0 - s for _, _, s in clauses)), clauses


def features(words: Iterable[str]) -> set[str]:
    words = {w for w in words if len(w) > 2 and not w.isdigit()}
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n}


def learn(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> dict[str, float]:
    """The lexicon: feature -> its share of toxic documents, smoothed; a lower bound of that share decides what is in.

    Counted in Spark over the labelled sample; at most LEXICON_ENTRIES rows come to the driver.
    """

    def counts(batches):
        import pyarrow as pa

        def out(seen: Counter, toxic: Counter) -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())], ["feature", "n", "t"])

        seen, toxic = Counter(), Counter()
        for batch in sliced(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = features(WORD.findall(text.lower()))
                found.add("")  # counts documents
                seen.update(found)
                if y == 1:
                    toxic.update(found)
                if len(seen) > COUNTED:
                    yield out(seen, toxic)
                    seen, toxic = Counter(), Counter()
        yield out(seen, toxic)

    found = labelled_sample(docs, labels, "toxic", bound, id_col, text_col).mapInArrow(counts, "feature string, n long, t long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    least = F.lit(4)
    strong = (
        found.where((F.col("t") >= least) & (F.col("feature") != ""))
        .withColumn("w", lower_bound(F.col("t"), F.col("n")))
        .where("w >= 0.45").orderBy(F.desc("w"), "feature").limit(LEXICON_ENTRIES)
    )
    rows = strong.collect()
    largest: dict[str, int] = {}
    for r in rows:
        if r.feature[-1] != "*":
            for n in STEMS:
                stem = f"{r.feature[:n]}*"
                largest[stem] = max(largest.get(stem, 0), r.t)
    # a stem says something of its own only if no single word makes most of it
    return {r.feature: (r.t + 1) / (r.n + 3) for r in rows if r.feature[-1] != "*" or r.t >= 2 * largest.get(r.feature, 1)}


def lower_bound(t, n, z: float = 2.0):
    """Wilson's lower bound of the share t / n."""
    p = t / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def score(docs: DataFrame, lexicon: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, clauses (start, end, score of each matched clause)."""

    def make():
        memo, machine = Memo(lexicon), Grammar()

        def rows(ids, texts):
            scored = [score_text(t or "", memo, machine) for t in texts]
            return ids, [s for s, _ in scored], [[{"start": a, "end": b, "score": s} for a, b, s in c] for _, c in scored]

        return rows

    kind = dict(docs.dtypes)[id_col]
    return per_row(docs, [F.col(id_col), F.col(text_col)], f"`{id_col}` {kind}, score double, clauses array<struct<start: long, end: long, score: double>>", make)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows: doc_id, held_out, score, predicted, n_clauses."""
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("clauses").cast("long").alias("n_clauses"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the grammar rejects; all columns stay."""
    lexicon = learn(docs, labels)
    return flagged_filter(docs, lexicon)


def flagged_filter(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    position = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        memo, machine = Memo(lexicon), Grammar()
        for batch in sliced(batches):
            keep = [score_text(t or "", memo, machine)[0] < THRESHOLD for t in batch.column(position).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
        del memo
        trim()

    return docs.mapInArrow(run, docs.schema)
