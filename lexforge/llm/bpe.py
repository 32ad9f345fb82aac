"""Byte-level BPE: encoding by folding ranked merges, decoding by joining binary pieces.

Words are the matches of the tokenizer's pattern. Texts are cut into words once, a
chunk of texts at a time (of about CHUNK_WORDS distinct words): a text becomes the
numbers of its words, the chunk's commonest word being number 0, and the chunk's
distinct words go, packed, to the partition that their hash names. There equal words of all chunks meet and each distinct word
of the corpus is encoded once, by higher-order functions: an array of pairs of
neighbouring ids is folded over, each step joining the pair whose piece has the
lowest rank, leftmost first. The rank map is a literal: a table of all pairs of
pieces whose concatenation is a piece, under a perfect hash (displace, then look up
one slot). The ids go back to the chunks, where the texts' numbers are replaced.

Nothing is broadcast but the tokenizer, and nothing comes to the driver but a count
of bytes. A word crosses the network once for each chunk that holds it; a word that
is a piece by itself has its own rank and needs no fold and no network, so what is
common everywhere stays in place. A fold step copies the word's array, so words of
more than LONG_WORD bytes are merged over a heap instead, with the same result, in
n log n; no word is cut or left out.

A null or empty text has no ids. Repeated rows are encoded alike and stay, as do
rows with null ids. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import sliced, stored_by, trim
from .imatch import let

LONG_WORD = 1024
#: A chunk of texts ends at so many distinct words or characters; a text is never cut.
CHUNK_WORDS, CHUNK_CHARS = 300_000, 1 << 24
#: A row holds so many texts of a chunk, or one more than so many words.
ROW_TEXTS, ROW_WORDS = 500, 200_000
#: Bytes of text for each partition of distinct words, and how many buckets of chunks there may be.
PART_BYTES, BUCKETS = 1 << 24, 50_000
NO_PAIR = EDGE = 65535
#: What a row of a chunk holds: its pieces, or texts; any other is a part of distinct words.
PIECES, TEXTS = -2, -1

Ranks = dict[bytes, int]


@lru_cache(4)
def read_ranks(path: str) -> Ranks:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_ranks(ranks: Ranks) -> dict[int, int]:
    """left id << 16 | right id -> id of the joined piece, for all pairs of pieces that make one."""
    return {ranks[p[:i]] << 16 | ranks[p[i:]]: r for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks}


def literal(values: list) -> Column:
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), "array<bigint>")


class PairTable:
    """A perfect hash of the pair ranks: slot = (key * A + displacement of key's bucket) mod SLOTS, holding key and rank.

    An entry is a pair with its rank in front, rank << 32 | left id << 16 | right id,
    so that the least entry is the best merge; a pair that makes no piece has NO_PAIR.
    """

    A, BUCKETS, SLOTS = 1664525, 65521, 1 << 19
    RANK_BITS = 17

    def __init__(self, ranks: Ranks) -> None:
        if max(ranks.values()) >= EDGE:
            raise ValueError("ids of more than 16 bits")
        self.ranks = ranks
        pairs = pair_ranks(ranks)
        buckets: dict[int, list[int]] = {}
        for key in pairs:
            buckets.setdefault(key % self.BUCKETS, []).append(key)
        self.slots, self.shifts = [0] * self.SLOTS, [0] * self.BUCKETS
        for b, keys in sorted(buckets.items(), key=lambda x: -len(x[1])):
            base = [key * self.A for key in keys]
            shift = 0
            while True:
                at = [(x + shift) % self.SLOTS for x in base]
                if len(set(at)) == len(at) and not any(self.slots[i] for i in at):
                    break
                shift += 1
            self.shifts[b] = shift
            for i, key in zip(at, keys, strict=True):
                self.slots[i] = (key << self.RANK_BITS) + pairs[key]

    def entry(self):
        """key -> entry. What a slot holds less the key is the rank if the slot is the key's own, and far from any rank if not."""
        slots, shifts = literal(self.slots), literal(self.shifts)

        def of(k: Column) -> Column:
            slot = F.get(slots, (k * F.lit(self.A) + F.get(shifts, (k % F.lit(self.BUCKETS)).cast("int"))).bitwiseAND(F.lit(self.SLOTS - 1)).cast("int"))
            rank = F.least(F.abs(slot - F.shiftleft(k, self.RANK_BITS)), F.lit(NO_PAIR).cast("bigint"))
            return F.shiftleft(rank, 32).bitwiseOR(k)

        return of

    def of_bytes(self) -> Column:
        """The entries of all pairs of bytes, 256 standing for an edge, at first * 257 + second."""
        ids = [self.ranks[bytes([b])] for b in range(256)] + [EDGE]
        rank = lambda a, b: self.ranks.get(bytes([a, b]), NO_PAIR) if a < 256 and b < 256 else NO_PAIR
        return literal([rank(a, b) << 32 | ids[a] << 16 | ids[b] for a in range(257) for b in range(257)])


def byte_values(word: Column) -> Column:
    """A UTF-8 word's bytes as numbers: read as ISO-8859-1, a byte is a character."""
    return F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.ascii(c))


def folded(word: Column, table: PairTable) -> Column:
    """The ids of a word. The state is the array of its pairs' entries, from edge to edge; each step makes the best merge."""
    entry, of_bytes = table.entry(), table.of_bytes()

    def merge(pairs: Column, i: Column) -> Column:
        """The ids of pair i become one, its rank; by the edges, 1 < i < size."""
        new = F.shiftright(F.element_at(pairs, i), 32)
        left, right = F.element_at(pairs, i - 1).bitwiseAND(F.lit(0xFFFF0000)), F.element_at(pairs, i + 1).bitwiseAND(F.lit(0xFFFF))
        around = F.transform(F.array(left.bitwiseOR(new), F.shiftleft(new, 16).bitwiseOR(right)), entry)
        return F.concat(F.slice(pairs, F.lit(1), i - 2), around, F.slice(pairs, i + 2, F.size(pairs)))

    def step(pairs: Column, _: Column) -> Column:
        best = F.array_min(pairs)
        return F.when(best >= F.lit(NO_PAIR << 32), pairs).otherwise(let(F.array_position(pairs, best).cast("int"), lambda i: merge(pairs, i)))

    def run(values: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(values) - 1), lambda i: F.get(of_bytes, F.element_at(values, i) * 257 + F.element_at(values, i + 1)))
        ids = lambda p: F.transform(F.slice(p, F.lit(2), F.size(p) - 1), lambda x: F.shiftright(x, 16).bitwiseAND(F.lit(0xFFFF)).cast("int"))
        return F.aggregate(F.sequence(F.lit(3), F.size(values)), pairs, step, ids)

    edge = F.array(F.lit(256))
    return let(F.concat(edge, byte_values(word), edge), run)


def heap_encode(word: bytes, ranks: Ranks) -> list[int]:
    """The same merges for a long word, over a heap of pairs and a linked list of pieces."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(r, i) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(word) or ranks.get(parts[i] + parts[j]) != r:
            continue  # one of the two has been merged meanwhile
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = k = after[j]
        if k < len(word):
            before[k] = i
            if (new := ranks.get(parts[i] + parts[k])) is not None:
                heapq.heappush(heap, (new, i))
        h = before[i]
        if h >= 0 and (new := ranks.get(parts[h] + parts[i])) is not None:
            heapq.heappush(heap, (new, h))
    return [ranks[p] for p in parts if p is not None]


#: Texts of these characters only are cut by a plain pattern that finds the same words.
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def finder(pattern: str):
    """text -> its words. The short cut holds for the one pattern it was written for."""
    import regex

    whole = regex.compile(pattern).findall
    if pattern != GPT2:
        return whole
    plain, fits = PLAIN_WORDS.findall, PLAIN.fullmatch
    return lambda text: plain(text) if fits(text) else whole(text)


def packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays one after another, each with its number of bytes, compressed."""
    raw = b"".join(x for a in map(bytes, map(memoryview, arrays)) for x in (struct.pack("<Q", len(a)), a))
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], struct.unpack_from("<Q", blob)[0], codec="zstd")
    out, at = [], 0
    for kind in kinds:
        n = struct.unpack_from("<Q", raw, at)[0]
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def varints(values: np.ndarray) -> np.ndarray:
    """Numbers as bytes of seven bits each, lowest first, the highest bit saying that more follow."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 35, 7):
        size += values >> np.uint32(bits) > 0 if bits < 32 else 0
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        more = size > k
        out[at[more] + k] = (values[more] >> np.uint32(7 * k)) & np.uint32(127) | ((size[more] > k + 1).astype(np.uint32) << np.uint32(7))
    return out


def from_varints(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])[: len(last)]
    out = np.zeros(len(last), np.uint32)
    for k in range(5):
        here = first + k <= last
        out[here] |= (raw[first[here] + k] & np.uint8(127)).astype(np.uint32) << np.uint32(7 * k)
    return out


def strings(lengths: np.ndarray, raw: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


class Numbers(dict):
    """word -> number, in order of appearance."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


@lru_cache(2)
def piece_words(path: str) -> dict[str, int]:
    out = {}
    for p, r in read_ranks(path).items():
        try:
            out[p.decode()] = r
        except UnicodeDecodeError:
            continue
    return out


def cut(rows: DataFrame, path: str, pattern: str, parts: int) -> DataFrame:
    """Rows of a chunk: of texts (ids, blob: numbers of words each, numbers), its pieces (blob: numbers, ranks), and of each part of its other words (blob: numbers, lengths, bytes)."""
    kind = rows.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    names = ["chunk", "part", "ids", "blob"]

    def run(batches):
        find, pieces = finder(pattern), piece_words(path)
        chunk, numbers, ids, sizes, found, chars = TaskContext.get().partitionId() << 32, Numbers(), [], [], [], 0

        def row(part, blob, ids=None):
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([part], pa.int32()), pa.array([ids], pa.list_(arrow)), pa.array([blob], pa.binary())], names)

        def chunk_rows():
            every = np.concatenate(found)
            common = np.argsort(-np.bincount(every, minlength=len(numbers)), kind="stable")
            by_count = np.empty(len(numbers), np.uint32)
            by_count[common] = np.arange(len(numbers), dtype=np.uint32)
            every, ends, start = by_count[every], np.cumsum(sizes), 0
            while start < len(ids):
                before = int(ends[start - 1]) if start else 0
                end = min(start + ROW_TEXTS, max(start + 1, int(np.searchsorted(ends, before + ROW_WORDS))), len(ids))
                yield row(TEXTS, packed(np.asarray(sizes[start:end], "<u4"), varints(every[before : ends[end - 1]])), ids[start:end])
                start = end
            words = list(numbers)
            words = [words[i] for i in common]
            ranks = np.fromiter((pieces.get(w, -1) for w in words), np.int64, len(words))
            own = np.flatnonzero(ranks >= 0)
            yield row(PIECES, packed(own.astype("<u4"), ranks[own].astype("<u2")))
            for part, at, lengths, raw in by_part(words, np.flatnonzero(ranks < 0), parts):
                yield row(part, packed(np.diff(at, prepend=0).astype("<u4"), lengths, raw))

        for batch in sliced(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = find(text)
                ids.append(key)
                sizes.append(len(words))
                found.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                chars += len(text)
                if len(numbers) >= CHUNK_WORDS or chars >= CHUNK_CHARS:
                    yield from chunk_rows()
                    chunk, numbers, ids, sizes, found, chars = chunk + 1, Numbers(), [], [], [], 0
                    trim()
        if ids:
            yield from chunk_rows()
            numbers, found = None, None
            trim()

    return rows.mapInArrow(run, f"chunk long, part int, ids array<{kind.simpleString()}>, blob binary")


def by_part(words: list[str], which: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes]]:
    """part, ``which`` words it has, their lengths and bytes: the part is named by the word's hash."""
    digest = xxhash.xxh64_intdigest
    part = np.fromiter((digest(words[i]) for i in which), np.uint64, len(which)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ():
        own = [words[i].encode() for i in which[at]]
        yield int(part[at[0]]), which[at], np.asarray([len(w) for w in own], "<u4"), b"".join(own)


def distinct_words(batches):
    """(chunk, blob) of a part -> each of its distinct words, with the chunks and places that hold it."""
    chunks, places, words = [], [], []
    for batch in batches:
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at, lengths, raw = unpacked(blob, "<u4", "<u4", "u1")
            chunks.append(np.full(len(at), chunk, np.int64))
            places.append(np.cumsum(at, dtype=np.int64))
            words.append(strings(lengths, raw))
    if not words:
        return
    coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
    which, words = coded.indices.to_numpy(), coded.dictionary
    order = np.argsort(which, kind="stable")
    refs = np.stack([np.concatenate(chunks)[order], np.concatenate(places)[order]], axis=1)
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bincount(which, minlength=len(words)) * 16, out=offsets[1:])
    held = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(refs))])
    del chunks, places, coded, which, order, refs
    for start in range(0, len(words), 10_000):
        yield pa.RecordBatch.from_arrays([words.slice(start, 10_000).cast(pa.string()), held.slice(start, 10_000).cast(pa.binary())], ["word", "refs"])
    del words, held
    trim()


def of_chunks(path: str, most: int = 200_000):
    """(refs, ids, word where ids is null) -> chunk, blob: numbers, counts of ids, ids."""

    def run(batches):
        def out():
            refs, counts, ids = (np.concatenate([h[k] for h in held]) for k in range(3))
            starts = np.cumsum(counts, dtype=np.int64) - counts
            order = np.lexsort((refs[:, 1], refs[:, 0]))
            chunk, blob = [], []
            for at in np.split(order, np.flatnonzero(np.diff(refs[order, 0])) + 1):
                n = counts[at]
                chunk.append(refs[at[0], 0])
                blob.append(packed(np.diff(refs[at, 1], prepend=0).astype("<u4"), n.astype("<u4"), ids[spread(starts[at], n)].astype("<u2")))
            return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(blob, pa.binary())], ["chunk", "blob"])

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(1)
            refs = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(-1, 2)
            times = pc.binary_length(batch.column(0)).to_numpy() // 16
            counts, values = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.flatten().to_numpy()
            if ids.null_count:
                ends = np.cumsum(counts)
                for row in reversed(np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))):
                    own = heap_encode(batch.column(2)[int(row)].as_py().encode(), read_ranks(path))
                    counts[row] = len(own)
                    values = np.insert(values, ends[row], own)
            starts = np.repeat(np.cumsum(counts) - counts, times)
            counts = np.repeat(counts, times)
            held.append((refs, counts, values[spread(starts, counts)]))
            n += len(refs)
            if n >= most:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return run


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + counts[0] - 1, starts[1] .. and so on."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def fill(kind: pa.DataType):
    """A chunk's texts and pieces, and the ids of its other words -> doc_id, ids: the numbers of words replaced by ids."""

    def run(texts: pa.Table, others: pa.Table) -> pa.Table:
        texts = texts.sort_by("part")  # pieces come first
        known = []
        for blob in others.column("blob"):
            at, n, ids = unpacked(blob.as_py(), "<u4", "<u4", "<u2")
            known.append((np.cumsum(at, dtype=np.int64), n.astype(np.int64), ids))
        out, counts, starts, values = [], None, None, None
        for part, keys, blob in zip(texts.column("part").to_pylist(), texts.column("ids"), texts.column("blob"), strict=True):
            if part == PIECES:
                at, ranks = unpacked(blob.as_py(), "<u4", "<u2")
                known.append((at, np.ones(len(at), np.int64), ranks))
                at, n, values = (np.concatenate([k[j] for k in known]) for j in range(3))
                counts, starts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                counts[at], starts[at] = n, np.cumsum(n) - n
                continue
            sizes, numbers = unpacked(blob.as_py(), "<u4", "u1")
            numbers = from_varints(numbers)
            n = counts[numbers]
            ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[spread(starts[numbers], n)].astype(np.int32)))
            out.append(pa.table([keys.values.cast(kind), ids], ["doc_id", "ids"]))
        del texts, others, known, counts, starts, values
        trim()
        return pa.concat_tables(out)

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every row: doc_id, ids (array of int)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType
    parts = 1 + (rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // PART_BYTES
    held = stored_by(cut(rows, path, pattern, parts), "chunk", min(parts, BUCKETS))

    words = held.where("part >= 0").repartitionById(parts, "part").select("chunk", "blob").mapInArrow(distinct_words, "word string, refs binary")
    short = F.octet_length("word") <= LONG_WORD
    ids = words.select("refs", F.when(short, folded(F.col("word"), PairTable(read_ranks(path)))).alias("ids"), F.when(~short, F.col("word")).alias("word"))
    back = ids.mapInArrow(of_chunks(path), "chunk long, blob binary")
    texts = held.where("part < 0").select("chunk", "part", "ids", "blob")
    return texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(fill(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``bytes``: the pieces of the ids, one binary after another, each byte held as an ISO-8859-1 character. Null ids are the empty array."""
    pieces = [""] * (max(read_ranks(path).values()) + 1)
    for p, r in read_ranks(path).items():
        pieces[r] = p.decode("latin-1")
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    return encoded.withColumn("bytes", F.encode(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""), "ISO-8859-1"))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The query's rows: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    decimals = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decode(encode(docs, path, pattern), path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimals, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
