"""Packing documents into sequences: first-fit decreasing over a tournament tree.

Documents are dealt at random (by a hash of the id and of the row's place) into
groups of about GROUP_DOCS; each group is packed by itself in one task. A document
longer than a sequence gives whole sequences; what remains is an item. Items are
placed by falling length into the first open bin with room, found by descending a
tournament tree of the bins' free places. Last, the emptiest bins are dissolved:
their items are cut to fill the holes that are left, so that a group has one
sequence at most that is not full.

A null or empty text has the end id alone. Repeated rows are packed each for
itself; ties in length keep the order of (doc_id, ids). An empty table gives an
empty one. A hot id is dealt like any other since the row's place is hashed too.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, sliced

SEQUENCE = 2048
END_ID = 1
GROUP_DOCS = 512
#: Words of one of two generations of the memo.
MEMO_WORDS = 250_000


class FirstFit:
    """Bins of equal capacity under a tournament tree whose nodes hold the most room below them."""

    def __init__(self, capacity: int, most: int) -> None:
        self.leaves = 1
        while self.leaves < max(most, 1):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> int:
        """The first bin with room for ``length``, which takes it."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        room[node] -= length
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return bin_


def pack(lengths: list[int], capacity: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece."""
    pieces, items, full = [], [], 0
    for doc, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            pieces.append((doc, k * capacity, capacity, full, 0))
            full += 1
        if n % capacity:
            items.append((doc, whole * capacity, n % capacity))
    items.sort(key=lambda x: -x[2])
    tree = FirstFit(capacity, len(items))
    bins: list[list[tuple[int, int, int]]] = []
    for item in items:
        b = tree.place(item[2])
        while b >= len(bins):
            bins.append([])
        bins[b].append(item)
    # the fullest first: the rest are dissolved into the holes
    bins.sort(key=lambda b: -sum(x[2] for x in b))
    free = [capacity - sum(x[2] for x in b) for b in bins]
    i, j = 0, len(bins) - 1
    while i < j:
        while free[i] and i < j:
            doc, start, n = bins[j].pop()
            take = min(n, free[i])
            bins[i].append((doc, start, take))
            free[i] -= take
            free[j] += take
            if take < n:
                bins[j].append((doc, start + take, n - take))
            if not bins[j]:
                j -= 1
        if not free[i]:
            i += 1
    for b in bins:
        if b:
            offset = 0
            for doc, start, n in b:
                pieces.append((doc, start, n, full, offset))
                offset += n
            full += 1
    return pieces


#: The tokenizer's pre-tokens, here only for words of PLAIN characters, for which NFC changes nothing and lower case is one to one.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


class WordIds(Recent):
    """Ids of words without white space, and of pre-tokens, as little-endian unsigned 16-bit bytes.

    A pre-token's ids do not depend on its neighbours. A special token's string in a
    text has that token's id, as the library gives it by default; with ``special_as_text``
    it is ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__(MEMO_WORDS)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [] if special_as_text else [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added) or r"(?!)")
        spell = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = str.maketrans({c: spell.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))})
        self.model = self.tokenizer.model

    def make(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and word.islower():
            return self.piece(word)
        if not word:
            return b""
        if PLAIN.fullmatch(word) and not self.special.search(word):
            pieces = PRETOKEN.findall(word.lower())
            return b"".join(map(self.__getitem__, pieces)) if pieces != [word] else self.piece(word)
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return pack_ids(f"<{len(ids)}H", *ids)

    def piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.translate(self.letters)
        ids = [t.id for t in self.model.tokenize(piece)]
        return pack_ids(f"<{len(ids)}H", *ids)


@lru_cache(2)
def word_ids(path: str, special_as_text: bool = False) -> WordIds:
    """One for each worker process: its memo serves the tasks that follow."""
    return WordIds(path, special_as_text)


def split_words(text: str) -> list[str]:
    """At ASCII white space only, where the pre-tokenizer always cuts and which it drops; empty words have no ids."""
    return BLANK.sub(" ", text).split(" ")


BLANK = re.compile("[\t\n\r\x0b\x0c]")


def tokenised(docs: DataFrame, path: str, groups: int, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """doc_id, grp, ids (unsigned 16-bit, the end id last)."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        find = word_ids(path, special_as_text).__getitem__
        end = np.asarray([END_ID], "<u2").tobytes()
        for part in sliced(batches):
            ids = [b"".join(map(find, split_words(t or ""))) + end for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), part.column(2)], ["doc_id", "ids", "grp"])

    # the partition's number and the row's place in it are the same again if a task is repeated
    deal = F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(groups))
    return docs.select(F.col(id_col), F.col(text_col), deal.alias("grp")).mapInArrow(run, f"doc_id {kind}, ids binary, grp long")


def packing(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", group_docs: int = GROUP_DOCS, special_as_text: bool = False) -> DataFrame:
    """A row for every piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    groups = max(1, docs.count() // group_docs)
    kind = dict(docs.dtypes)[id_col]

    def group(key, found):
        ids, raw = found.column("doc_id"), found.column("ids").to_pylist()
        order = sorted(range(len(raw)), key=lambda i: (ids[i].as_py() is None, ids[i].as_py() or 0, raw[i]))
        wide = [np.frombuffer(raw[i], "<u2").astype("<u4") for i in order]
        pieces = pack([len(w) for w in wide])
        if not pieces:
            pieces_np = np.zeros((0, 5), np.int64)
        else:
            pieces_np = np.asarray(pieces, np.int64)
        crc = [zlib.crc32(wide[d][s : s + n]) for d, s, n, _, _ in pieces]
        doc = pa.array([order[d] for d, *_ in pieces], pa.int64())
        return pa.table({
            "doc_id": ids.take(doc), "start": pieces_np[:, 1], "length": pieces_np[:, 2], "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": pa.array([len(wide[d]) for d, *_ in pieces], pa.int64()), "sequence_id": pieces_np[:, 3] + (key[0].as_py() << 32), "offset": pieces_np[:, 4],
        })

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokenised(docs, path, groups, id_col, text_col, special_as_text).groupBy("grp").applyInArrow(group, schema)
