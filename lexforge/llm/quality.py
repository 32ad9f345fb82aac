"""Quality by supervised subword embeddings.

Words and their character n-grams are hashed to rows of one embedding table; of word
bigrams, the one of a word and itself has a row too, learned like all others. A
document is the mean of its rows, shrunk towards zero as if SHRINK rows more were
zero (so that few words say little), followed by a softmax over the two labels. The
table and the softmax are trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows. Since mean and softmax are linear up to the last
step, each row's share of the decision is one number, so scoring sums one
remembered number a word.

A null or empty text has no features: its score is that of the zero vector. Ties
do not arise. Repeated rows are scored alike and stay; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, held_out, labelled_sample, per_row, sliced, trim

#: Labelled rows the classifier is fitted on, at most, and their characters; their texts come to the driver.
TRAIN_ROWS, TRAIN_CHARS = 2_500, 40_000_000
BUCKETS = 1 << 18
DIMENSIONS = 8
NGRAMS = (3, 4)
THRESHOLD = 0.5
SHRINK = 20
#: The row of a word's bigram with itself.
REPEAT = zlib.crc32(b"same word again") & (BUCKETS - 1)


def buckets(word: str) -> list[int]:
    """The rows of a word: itself and the character n-grams of it between boundary marks."""
    marked, crc = f"<{word}>", zlib.crc32
    if marked.isascii():  # a character is a byte
        raw = marked.encode()
        grams = ((raw[i : i + n], n) for n in NGRAMS for i in range(len(raw) - n + 1))
    else:
        raw = marked.encode("utf-8", "surrogatepass")
        grams = ((marked[i : i + n].encode("utf-8", "surrogatepass"), n) for n in NGRAMS for i in range(len(marked) - n + 1))
    return [crc(raw) & (BUCKETS - 1), *(crc(g, n) & (BUCKETS - 1) for g, n in grams)]


def fit(texts: list[str], labels: list[int], epochs: int = 5, rate: float = 0.4, seed: int = 7) -> tuple[np.ndarray, float]:
    """What each row adds to the log-odds of label 1, and the bias."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    soft = np.zeros((DIMENSIONS, 2), np.float32)
    bias = np.zeros(2, np.float32)
    memo: dict[str, list[int]] = {}
    docs = []
    for text in texts:
        counts: Counter[int] = Counter()
        words = text.split()
        if again := sum(map(eq, words, words[1:])):
            counts[REPEAT] += again
        for word, k in Counter(words).items():
            rows = memo.get(word)
            if rows is None:
                rows = memo[word] = buckets(word)
            for b in rows:
                counts[b] += k
        rows = np.fromiter(counts.keys(), np.int64, len(counts))
        share = np.fromiter(counts.values(), np.float32, len(counts))
        docs.append((rows, share / (share.sum() + SHRINK)))
    y = np.asarray(labels, int)
    if not len(y):
        return np.zeros(BUCKETS, np.float32), 0.0
    weight = len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1))  # both labels count alike
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            rows, share = docs[i]
            lr = rate * (1 - done / steps)
            done += 1
            own = table[rows]
            mean = share @ own
            z = mean @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= min(weight[y[i]], 5.0)
            back = soft @ p
            soft -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            # the mean's gradient, spread over its rows as one step on their sum
            table[rows] = own - lr * np.outer(share * min(len(rows), 200), back)
    seen = np.zeros(BUCKETS, bool)
    for rows, _ in docs:
        seen[rows] = True
    return np.where(seen, table @ (soft[:, 1] - soft[:, 0]), 0).astype(np.float32), float(bias[1] - bias[0])


class Memo(Recent):
    """word -> complex(sum of its rows' shares, number of its rows)."""

    def __init__(self, shares: np.ndarray) -> None:
        super().__init__()
        self.shares = shares

    def make(self, word: str) -> complex:
        rows = buckets(word)
        return complex(float(self.shares[rows].sum()), len(rows))


def score_text(text: str, memo: Memo, bias: float) -> float:
    words = text.split()
    again = sum(map(eq, words, words[1:]))
    both = sum(map(memo.__getitem__, words), complex(again * memo.shares[REPEAT], again + SHRINK))
    z = bias + both.real / both.imag
    return float(1 / (1 + np.exp(-z)))


def learn(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    rows = labelled_sample(docs, labels, "quality", bound, chars=TRAIN_CHARS).collect()
    rows.sort(key=lambda r: (zlib.crc32(r.text.encode("utf-8", "surrogatepass")), r.text))  # one order whatever the partitions
    return fit([r.text for r in rows], [r.y for r in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score. The model is one number for each of the BUCKETS rows (1 MB)."""
    shares, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]

    def make():
        memo = Memo(shares.value)
        return lambda ids, texts: (ids, [score_text(t or "", memo, bias) for t in texts])

    return per_row(docs, [F.col(id_col), F.col(text_col)], f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double", make)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows: doc_id, held_out, score, predicted."""
    return score(docs, learn(docs, labels)).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows scored below THRESHOLD; all columns stay."""
    model = learn(docs, labels)
    shares, bias, position = docs.sparkSession.sparkContext.broadcast(model[0]), model[1], docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        memo = Memo(shares.value)
        for batch in sliced(batches):
            keep = [score_text(t or "", memo, bias) >= THRESHOLD for t in batch.column(position).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
        del memo
        trim()

    return docs.mapInArrow(run, docs.schema)
