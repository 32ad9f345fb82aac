"""MinHash near-dedup with odd sketches.

Documents of equal shingle sets form a class; its smallest id stands for it. A
class has BANDS * ROWS minimum hashes; a band's values, hashed together, make a
bucket, and members of one bucket are candidates. For their verification the hash
range is cut into BINS, whose minima are MinHash samples too (nearly the whole set, if it
is small). An odd sketch folds the samples into a parity bitmap of BITS bits. The
population count of two sketches' XOR tells how many samples differ, precisely so
where similarity is high; with the sets' sizes it estimates the Jaccard similarity
to about a hundredth. Only pairs whose estimate reaches the threshold, less SLACK
standard errors, are confirmed on their full shingle sets.

Candidates are verified in two passes, so that a bucket of near copies never emits
all its pairs. First each bucket gives a maximum spanning forest, by estimate, of
the pairs that pass; confirmed links join classes to components. Then rows with
passing partners in another component bring their full sets to the bucket, where
all those pairs are tested, until what they connect is one component: only the
links found leave the task. A link between any two candidates is thus either
confirmed or within a component.

Null and empty texts have no shingles, are linked with nothing and stand for
themselves. Repeated rows are one class. An empty table gives an empty one. With
fewer words than a shingle takes, the whole sequence is the one shingle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import GROUP, dealt, pairs_of, shared
from .common import Recent, drop_stored, sliced, stored, trim
from .components import components

BANDS, ROWS = 28, 5
BINS, BITS = 1024, 2048
#: How far below the threshold, in standard errors, a sketch's estimate may lie.
SLACK = 4.0
#: Bits for each id of the filter that says whose sets are needed, and bits at most: a bound on what comes to the driver, 16 MB.
#: Beyond it the ids are joined instead.
ID_BITS, FILTER_BITS = 12, 1 << 27

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHash(Recent):
    def make(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int, memo: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; words are runs of other than ASCII white space, A-Z lowered."""
    # bytes.split() cuts at space and \x09-\x0D exactly
    found = (text or "").encode("utf-8", "surrogatepass").translate(UPPER).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    width = min(words, len(h))
    out = mixed(h[: len(h) - width + 1] + np.uint64(width))
    for k in range(1, width):
        out = mixed(out * MIX + h[k : len(h) - width + 1 + k])
    return np.unique(out)


SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * MIX) | np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * ROWS hash functions over the set."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 4096):  # bounded memory for a very long text
        part = shingles[start : start + 4096]
        h = part[None, :] * SEEDS[:, None]
        h ^= h >> np.uint64(32)
        h *= MIX
        np.minimum(out, h.min(axis=1), out=out)
    return out


def odd_sketch(shingles: np.ndarray) -> tuple[int, bytes]:
    """The number of samples (bins that are not empty), and the parity, for each bit, of those that hash to it."""
    bins = (shingles >> np.uint64(54)).astype(np.int64)  # BINS of them; sets are sorted, so a bin's first is its least
    samples = shingles[np.concatenate([[0], np.flatnonzero(np.diff(bins)) + 1])]
    at = (mixed(samples) % np.uint64(BITS)).astype(np.int64)
    return len(samples), np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).tobytes()


class Sketches:
    """Sizes, sample counts and sketches of a unit's rows."""

    def __init__(self, found: pa.Table, threshold: float) -> None:
        self.size = found.column("size").to_numpy().astype(np.float64)
        self.samples = found.column("samples").to_numpy().astype(np.float64)
        self.bits = np.frombuffer(b"".join(found.column("sketch").to_pylist()), np.uint64).reshape(len(self.size), -1)
        self.threshold = threshold

    def estimate(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Estimated similarity of rows x against rows y; -1 for what cannot be similar enough."""
        j, out = self.threshold, np.full((len(x), len(y)), -1.0)
        a, b = self.size[x][:, None], self.size[y][None, :]
        p, q = np.nonzero(np.minimum(a, b) >= (j - 1e-9) * np.maximum(a, b))
        for start in range(0, len(p), 1 << 15):
            r, s = p[start : start + (1 << 15)], q[start : start + (1 << 15)]
            odd = np.bitwise_count(self.bits[x[r]] ^ self.bits[y[s]]).sum(axis=1).astype(np.float64)
            even = np.maximum(1 - 2 * odd / BITS, 0.02)
            differ = -BITS / 2 * np.log(even)
            union = (self.size[x[r]] + self.size[y[s]]) / (1 + j)
            bins = np.minimum(BINS * -np.expm1(-union / BINS), union)
            same = (self.samples[x[r]] + self.samples[y[s]] - differ) / 2
            by_odd = np.sqrt(np.maximum(BITS / 4 * (1 - even**2) - differ * even**2, 0)) / even / 2
            by_bins = np.sqrt(bins * j * (1 - j) * np.maximum(1 - bins / union, 0.05))
            ok = same >= j * bins - SLACK * np.hypot(by_odd, by_bins) - 1
            out[r[ok], s[ok]] = np.maximum(same[ok] / bins[ok], 0)
        return out


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A maximum spanning forest of the entries >= 0 of a symmetric matrix: each tree takes its best way out, again and again."""
    n = len(near)
    root, out = np.arange(n), []
    near = near.copy()
    while True:
        near[root[:, None] == root[None, :]] = -1
        best = near.argmax(axis=1)
        value = near[np.arange(n), best]
        order = np.argsort(-value, kind="stable")
        if n == 0 or value[order[0]] < 0:
            return out
        taken = set()
        for k in order[value[order] >= 0]:
            if root[k] in taken:
                continue
            taken.add(root[k])
            a, b = root[k], root[best[k]]
            if find(root, a) != find(root, b):
                out.append((int(k), int(best[k])))
                root[find(root, max(a, b))] = find(root, min(a, b))
        root = np.array([find(root, k) for k in range(n)])


def find(root: np.ndarray, k: int) -> int:
    while root[k] != k:
        k = root[k]
    return k


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, mark (hash of the text), n_shingles, set_key (digest of the set; null if it is empty), samples, sketch, bands."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        memo = WordHash()
        for batch in sliced(batches):
            n, key, samples, sketch, bands = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words, memo)
                n.append(len(s))
                if not len(s):
                    for column in (key, samples, sketch, bands):
                        column.append(None)
                    continue
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                least = minima(s)
                count, bits = odd_sketch(s)
                samples.append(count)
                sketch.append(bits)
                b = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
                for k in range(ROWS):
                    b = mixed(b + least[k::ROWS])
                bands.append(b.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(samples, pa.int32()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "mark", "n_shingles", "set_key", "samples", "sketch", "bands"])
        del memo
        trim()

    return docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col)).mapInArrow(run, f"id {kind}, mark long, n_shingles long, set_key binary, samples int, sketch binary, bands array<long>")


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Four bits of a filter of ``bits`` for each hash."""
    h = hashes.view(np.uint64)
    return np.concatenate([(mixed(h + k) % np.uint64(bits)).astype(np.int64) for k in np.arange(1, 5, dtype=np.uint64) * MIX])


def id_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of ``ids`` (id) as 32-bit words."""

    def run(batches):
        own = np.zeros(bits // 32, np.int32)
        for batch in sliced(batches):
            at = places(batch.column(0).to_numpy(), bits)
            np.bitwise_or.at(own, at >> 5, (np.uint32(1) << (at & 31).astype(np.uint32)).view(np.int32))
        word = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(own[word])], ["word", "bits"])

    found = ids.select(F.xxhash64("id")).mapInArrow(run, "word int, bits int").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 32, np.int32)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def shingle_sets(ids: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, shingles: the full sets of the documents with ``ids`` (distinct), and of a few others. The texts stay where they are.

    The filter grows with the ids, so that it lets through one in a few hundred others;
    of more ids than FILTER_BITS serve, the documents are joined with them instead.
    """
    kind, n = dict(docs.dtypes)[id_col], ids.count()
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col))
    bits = 1 << max(20, (ID_BITS * n - 1).bit_length())
    if bits > FILTER_BITS:
        rows, wanted = rows.join(ids, "id", "left_semi"), None
    else:
        wanted = docs.sparkSession.sparkContext.broadcast(id_filter(ids, bits))

    def run(batches):
        memo = WordHash()
        for batch in sliced(batches):
            if wanted is not None:
                own = wanted.value
                at = places(batch.column(2).to_numpy(), bits).reshape(4, -1)
                keep = (own[at >> 5].view(np.uint32) >> (at & 31).astype(np.uint32) & 1).all(axis=0)
                batch = batch.filter(pa.array(keep))
            found = [shingle_set(t, words, memo).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "shingles"])
        del memo
        trim()

    return stored(rows.mapInArrow(run, f"id {kind}, shingles binary"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets meet 100 * |A & B| >= percent * |A | B|.

    An id of repeated rows with different texts has several sets; any two may make the link.
    """

    def check(batches):
        for batch in sliced(batches):
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    kind = dict(pairs.dtypes)["u"]
    left = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u")
    both = left.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v").select("u", "v", "a", "b")
    return stored(both.mapInArrow(check, f"u {kind}, v {kind}").distinct())


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every document: id, n_shingles, component_id, kept."""
    out = labelled(docs, words, threshold, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("c", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def labelled(docs: DataFrame, words: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """A row for every document: id, mark, n_shingles, set_key, c (the least id of its component; null without words or id)."""
    percent, kind = round(100 * threshold), dict(docs.dtypes)[id_col]
    own = stored(signatures(docs, words, id_col, text_col))
    least = lambda c: F.min_by(c, "id").alias(c)
    classes = stored(own.where("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("rep"), F.min("n_shingles").alias("size"), least("samples"), least("sketch"), least("bands")))

    members = classes.select(F.lit(0).alias("t"), F.explode("bands").alias("key"), "rep")
    members = stored(shared(members))
    sketches = classes.select("rep", "size", "samples", "sketch")

    def first_pass(key, found):
        """The forest of the pairs that pass, and every row that is in such a pair."""
        i, j = key[2].as_py(), key[3].as_py()
        found = found.sort_by("key")
        bucket, block, sketch = found.column("key").to_numpy(), found.column("block").to_numpy(), Sketches(found, threshold)
        us, vs = [], []
        for x, y in pairs_of(bucket, block, i, j):
            rows = x if i == j else np.concatenate([x, y])
            near = np.full((len(rows), len(rows)), -1.0)
            if i == j:
                near = sketch.estimate(x, y)
            else:
                near[: len(x), len(x) :] = sketch.estimate(x, y)
                near[len(x) :, : len(x)] = near[: len(x), len(x) :].T
            np.fill_diagonal(near, -1)
            for a, b in forest(near):
                us.append(rows[a])
                vs.append(rows[b])
        rep = found.column("rep")
        return pa.table({"u": rep.take(pa.array(us, pa.int64())), "v": rep.take(pa.array(vs, pa.int64()))})

    def second_pass(key, found):
        """Rows with a partner that passes and lies in another component."""
        i, j = key[2].as_py(), key[3].as_py()
        found = found.sort_by("key")
        bucket, block, sketch = found.column("key").to_numpy(), found.column("block").to_numpy(), Sketches(found, threshold)
        component = np.unique(found.column("component").to_pylist(), return_inverse=True)[1]
        keep = np.zeros(len(bucket), bool)
        for x, y in pairs_of(bucket, block, i, j):
            near = (component[x][:, None] != component[y][None, :]) & (sketch.estimate(x, y) >= 0)
            keep[x[near.any(axis=1)]] = True
            keep[y[near.any(axis=0)]] = True
        return found.select(["t", "key", "rep"]).filter(pa.array(keep))

    def verified(key, found):
        """Links between components, by the full sets of all pairs that pass; none within what is connected already."""
        i, j = key[2].as_py(), key[3].as_py()
        found = found.sort_by("key")
        bucket, block, sketch = found.column("key").to_numpy(), found.column("block").to_numpy(), Sketches(found, threshold)
        root = np.unique(found.column("component").to_pylist(), return_inverse=True)[1]
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in found.column("shingles")]
        us, vs = [], []
        for x, y in pairs_of(bucket, block, i, j):
            near = sketch.estimate(x, y)
            a, b = np.nonzero(np.triu(near >= 0, 1) if i == j else near >= 0)
            order = np.argsort(-near[a, b], kind="stable")
            a, b = x[a[order]], y[b[order]]
            while True:
                apart = root[a] != root[b]
                a, b = a[apart], b[apart]
                if not len(a):
                    break
                for p, q in zip(a[:64], b[:64], strict=True):
                    if root[p] == root[q]:
                        continue
                    both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                    if 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both):
                        us.append(p)
                        vs.append(q)
                        root[root == root[q]] = root[p]
                a, b = a[64:], b[64:]
        rep = found.column("rep")
        return pa.table({"u": rep.take(pa.array(us, pa.int64())), "v": rep.take(pa.array(vs, pa.int64()))})

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    columns = ["rep", "size", "samples", "sketch"]
    work = stored(dealt(members.join(sketches, "rep"), columns))
    pairs = stored(ordered(work.groupBy(*GROUP).applyInArrow(first_pass, f"u {kind}, v {kind}")))
    # a row that passes with any other is in its bucket's forest, so these are all the ids whose sets either pass needs
    sets = shingle_sets(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), docs, words, id_col, text_col)
    links = confirmed(pairs, sets, percent)
    part = stored(components(links))

    names = part.withColumnRenamed("u", "rep")
    label = lambda rows: rows.join(names, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = label(work)
    apart = labelled.groupBy(*GROUP, "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select(*GROUP, "key")
    open_rows = stored(labelled.join(apart, [*GROUP, "key"]).groupBy(*GROUP).applyInArrow(second_pass, f"t int, key long, rep {kind}").distinct())
    unneeded = [members, work, pairs, sets, links, open_rows]
    if not open_rows.isEmpty():
        full = label(open_rows).join(sketches, "rep").join(sets.withColumnRenamed("id", "rep"), "rep")
        more = stored(dealt(shared(full), [*columns, "component", "shingles"]).groupBy(*GROUP).applyInArrow(verified, f"u {kind}, v {kind}"))
        part = stored(components(links.unionByName(ordered(more))))
        unneeded.append(more)
    for table in unneeded:
        drop_stored(docs.sparkSession, table)
    named = classes.select("set_key", "rep").join(part.withColumnRenamed("u", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("c"))
    return own.select("id", "mark", "n_shingles", "set_key").join(named, "set_key", "left")


def keep_one(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the near copies of a document with a smaller id.

    Of rows with one id and one shingle set that of the text with the least hash stays,
    of rows with one id and one text the least row; rows with one id whose texts are no
    copies all stay. Rows without an id, or whose text has no words, are no copies of
    anything and stay.
    """
    found = stored(labelled(docs, words, threshold, "doc_id", "text").where("c is not null").select("id", "mark", "set_key", "c"))
    first = found.groupBy("id", "set_key").agg(F.min("mark").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = found.where("id <> c").select("id", "mark").union(found.join(first, ["id", "set_key"]).where("mark <> first").select("id", "mark")).distinct()
    gone = stored(gone.withColumnsRenamed({"id": "__id", "mark": "__mark"}))
    marked = docs.withColumn("__mark", F.xxhash64("text"))
    left = marked.join(gone, (marked["doc_id"] == gone["__id"]) & (marked["__mark"] == gone["__mark"]), "left_anti")
    twice = found.where("id = c").groupBy("id", "mark").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("doc_id"), F.col("mark").alias("__mark"))
    if twice.isEmpty():
        return left.select(docs.columns)
    repeated = left.join(twice, ["doc_id", "__mark"], "left_semi")
    once = repeated.groupBy("doc_id", "__mark").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return left.join(twice, ["doc_id", "__mark"], "left_anti").select(docs.columns).unionByName(once.select(docs.columns))
