"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Rotations that make sign codes balanced are learned by iterative quantisation on a
bounded sample; each gives a code of up to 64 bits. The codes are cut into
substrings of about log2(N) - 4 bits, each the key of one table; the number of
tables is set so that a pair right at the threshold shares a key with probability
RECALL (by the angle between the two), closer pairs almost surely. Within a bucket
codes are compared first; only rows that have a partner there fetch their vectors,
and cosines in double precision decide.

Equal vectors form a class and are indexed once. A bucket of more than BLOCK rows
is dealt into blocks, every two of which meet in one task, so no task holds a whole
hot bucket. No pairs leave a task: only each row's number of links, counted in the
first table that the pair shares, and a forest of the block's components.

Vectors that are null, empty, zero or hold null or non-finite components, and rows
without an id, link with nothing. Vectors of different lengths do not link. Equal
ids with equal vectors are one vector. Ties do not matter: links are a threshold,
components take the smallest id. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import dealt, pairs_of
from .buckets import shared as shared_rows
from .common import stored
from .components import components

THRESHOLD = 0.9
RECALL = 0.97
#: Vectors that the rotations are learned from, at most.
SAMPLE = 4_096
BITS = 64
#: Words of 64 bits of a code that go with a table's rows: enough to tell pairs apart, whatever the number of tables.
CODE_WORDS = 4


class Index:
    """Rotations for one length of vector, and the cutting of codes into keys."""

    def __init__(self, sample: np.ndarray, dims: int, n: int, threshold: float = THRESHOLD, seed: int = 5) -> None:
        bits = min(BITS, dims)
        self.width = int(min(max(4, round(math.log2(max(n, 2))) - 4), bits, 30))
        differ = math.acos(threshold) / math.pi  # the chance that a bit of a pair at the threshold differs
        found = (1 - differ) ** self.width
        self.tables = max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - found))) if found < 1 else 1
        self.each = bits // self.width
        rng = np.random.default_rng(seed)
        self.rotations = [self.learn(sample, dims, bits, rng, k) for k in range(math.ceil(self.tables / self.each))]
        total = bits * min(len(self.rotations), CODE_WORDS)
        #: More differing bits than this do not come from a pair at the threshold.
        self.most = total * differ + 5 * math.sqrt(total * differ * (1 - differ)) + 2

    @staticmethod
    def learn(sample: np.ndarray, dims: int, bits: int, rng: np.random.Generator, k: int, rounds: int = 30) -> np.ndarray:
        """Projection and rotation: signs of the result are the code."""
        basis = np.linalg.qr(rng.normal(size=(dims, dims)))[0][:, :bits]
        if k == 0 and len(sample) > dims:
            basis = np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, :bits]
        turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        v = sample @ basis
        for _ in range(rounds if len(v) > bits else 0):
            u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        return basis @ turn

    def keys(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes as rows of 64-bit words, keys of the tables)."""
        signs = [(unit @ r >= 0) for r in self.rotations]
        words = []
        for s in signs[:CODE_WORDS]:
            wide = np.zeros((len(s), 64), np.uint8)
            wide[:, : s.shape[1]] = s
            words.append(np.packbits(wide, axis=1).view(np.uint64))
        powers = 1 << np.arange(self.width, dtype=np.int64)
        keys = [s[:, i * self.width : (i + 1) * self.width] @ powers for s in signs for i in range(self.each)]
        return np.hstack(words), np.stack(keys[: self.tables], axis=1)


def unit_vector(values: list | None) -> np.ndarray | None:
    if not values or None in values:
        return None
    x = np.asarray(values, np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top  # squares of large or tiny components stay finite
    return x / math.sqrt(float(x @ x))


def units(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, digest, unit (double bytes), dims of the vectors that can link."""
    kind = dict(vectors.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            keep, digest, unit, dims = [], [], [], []
            for i, (key, values) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                u = unit_vector(values) if key is not None else None
                if u is not None:
                    keep.append(i)
                    digest.append(hashlib.blake2b(np.asarray(values, np.float64).tobytes(), digest_size=16).digest())
                    unit.append(u.tobytes())
                    dims.append(len(u))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(digest, pa.binary()), pa.array(unit, pa.binary()), pa.array(dims, pa.int32())], ["id", "digest", "unit", "dims"])

    return vectors.select(id_col, vec_col).mapInArrow(run, f"id {kind}, digest binary, unit binary, dims int")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for every row: id, n_links, component_id, kept."""
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[id_col]
    own = stored(units(vectors, id_col, vec_col))
    classes = own.groupBy("digest", "dims").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("n"), F.min("unit").alias("unit"))
    sample = own.select("unit", "dims").orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE).collect()
    counts = {r.dims: r.n for r in own.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    index = {d: Index(np.array([np.frombuffer(r.unit) for r in sample if r.dims == d]).reshape(-1, d), d, n, threshold) for d, n in counts.items()}
    shared = spark.sparkContext.broadcast(index)

    def code(batches):
        for batch in batches:
            dims, unit = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            codes, keys = [b""] * len(dims), [[]] * len(dims)
            for d in set(dims):
                at = [i for i, x in enumerate(dims) if x == d]
                c, k = shared.value[d].keys(np.frombuffer(b"".join(unit[i] for i in at)).reshape(-1, d))
                for i, x, y in zip(at, c, k, strict=True):
                    codes[i], keys[i] = x.tobytes(), y
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["rep", "n", "unit", "dims", "code", "keys"])

    coded = stored(classes.select("rep", "n", "unit", "dims").mapInArrow(code, f"rep {kind}, n long, unit binary, dims int, code binary, keys array<long>"))
    # the length is part of the table, so vectors of different lengths do not meet
    tables = coded.select("rep", "code", "dims", F.posexplode("keys").alias("p", "key")).select("rep", "code", (F.col("dims").cast("bigint") * 4096 + F.col("p")).alias("t"), "key")

    def partners(key, found):
        """Rows with another one of their bucket within the Hamming distance."""
        t, i, j = (key[k].as_py() for k in (0, 2, 3))
        most = shared.value[t // 4096].most
        found = found.sort_by("key")
        bucket, block = found.column("key").to_numpy(), found.column("block").to_numpy()
        codes = np.frombuffer(b"".join(found.column("code").to_pylist()), np.uint64).reshape(len(bucket), -1)
        keep = np.zeros(len(bucket), bool)
        for x, y in pairs_of(bucket, block, i, j):
            apart = np.zeros((len(x), len(y)), np.int32)
            for w in range(codes.shape[1]):
                apart += np.bitwise_count(codes[x, w][:, None] ^ codes[y, w][None, :])
            near = apart <= most
            if i == j:
                np.fill_diagonal(near, False)
            keep[x[near.any(axis=1)]] = True
            keep[y[near.any(axis=0)]] = True
        at = pa.array(np.flatnonzero(keep))
        return pa.table({"t": pa.array([t] * len(at), pa.int64()), "key": found.column("key").take(at), "rep": found.column("rep").take(at)})

    groups = ["t", "part", "i", "j"]
    some = stored(dealt(shared_rows(tables), ["rep", "code"]).groupBy(*groups).applyInArrow(partners, f"t long, key long, rep {kind}").distinct())

    def rerank(key, found):
        """For every row with links first found in this table: their number, and the root of its component here."""
        t, i, j = (key[k].as_py() for k in (0, 2, 3))
        found = found.sort_by("key")
        bucket, block, n = found.column("key").to_numpy(), found.column("block").to_numpy(), found.column("n").to_numpy()
        unit = np.frombuffer(b"".join(found.column("unit").to_pylist())).reshape(len(bucket), -1)
        keys = np.array(found.column("keys").to_pylist(), np.int64)
        links, root = np.zeros(len(bucket), np.int64), np.arange(len(bucket))
        for x, y in pairs_of(bucket, block, i, j):
            near = unit[x] @ unit[y].T >= threshold
            if i == j:
                near = np.triu(near, 1)
            p, q = np.nonzero(near)
            first = np.concatenate([(keys[x[p[s : s + 65536]]] == keys[y[q[s : s + 65536]]]).argmax(axis=1) for s in range(0, len(p), 65536)] or [np.zeros(0, int)])
            p, q = x[p[first == t % 4096]], y[q[first == t % 4096]]
            np.add.at(links, p, n[q])
            np.add.at(links, q, n[p])
            while True:  # smallest label over the links, with jumps to the label's label
                low = np.minimum(root[p], root[q])
                before = root.copy()
                np.minimum.at(root, p, low)
                np.minimum.at(root, q, low)
                np.minimum.at(root, before[p], low)
                np.minimum.at(root, before[q], low)
                root = root[root]
                if (root[p] == root[q]).all():
                    break
        at = pa.array(np.flatnonzero(links))
        rep = found.column("rep")
        return pa.table({"u": rep.take(at), "n": pa.array(links).take(at), "v": rep.take(pa.array(root[np.flatnonzero(links)]))})

    with_vectors = some.join(coded.select("rep", "n", "unit", "keys").withColumnRenamed("n", "size"), "rep")
    work = dealt(shared_rows(with_vectors.select("t", "key", "rep", "size", "unit", "keys")), ["rep", "size", "unit", "keys"]).withColumnRenamed("size", "n")
    found = stored(work.groupBy(*groups).applyInArrow(rerank, f"u {kind}, n long, v {kind}"))

    links = found.groupBy("u").agg(F.sum("n").alias("links"))
    part = components(found.select("u", "v"))
    per_class = classes.select("digest", "rep", "n").join(links.withColumnRenamed("u", "rep"), "rep", "left").join(part.withColumnRenamed("u", "rep"), "rep", "left")
    per_class = per_class.select("digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    linked = own.select("id", "digest").join(per_class, "digest").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = vectors.select(F.col(id_col).alias("id")).join(linked, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
