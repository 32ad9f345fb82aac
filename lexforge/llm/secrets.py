"""Secret scans with a recursive decoding worklist.

A text is the first layer. Each layer is scanned for the base kinds and for
encoded segments. All its percent escapes together, and all its backslash escapes,
decode to one further layer each; base64, and what is compressed behind it, to layers
of each segment, until none is left. Every character of a layer knows the range of
the whole text that it came from, so a finding at any depth has a span there. A layer
that was met before over the same range is not scanned again, so cycles end.

A null text is the empty text and has no spans. Repeated rows are scanned alike
and stay; an empty table gives an empty one. Nothing is cut: a text of any length
is scanned whole. Bytes that are not UTF-8 become U+FFFD, one each, and the layer is
scanned with them and with any control characters; bytes with a zero in every other
place are read as UTF-16 as well. Compressed data (zlib, gzip of any number of members,
bare deflate, one in another) is inflated in pieces that end where no secret and no
code can go on, so a layer of any size is scanned whole in the memory of a piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row, sliced

KINDS = ("assign", "access", "hex")
#: Bytes that are inflated at a time.
INFLATED = 1 << 18

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINT = re.compile(r"passw|secret|token|api", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}")
BACKSLASH = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: What any base kind or encoded segment needs; decoded bytes without it need no scan.
MAY_HOLD = re.compile(rb"(?i:passw|secret|token|api)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[ux]|[A-Za-z0-9+/_-]{16}")
#: A byte that is not UTF-8, as surrogateescape decodes it.
BAD = re.compile(r"[\udc80-\udcff]")
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
#: Where zlib or gzip data may begin: zlib of the usual window anywhere, any other at the start.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|\A\x78")
#: What begins like compressed data.
HEADER = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
#: Bytes that no base kind, escape or base64 over lines goes over.
BREAK = re.compile(rb"[^A-Za-z0-9+/_.=\-\"' :%\\{}\r\n\t]")
#: A base64 segment without both of these is a word.
LOWER, OTHER = re.compile(r"[a-z]"), re.compile(r"[A-Z0-9+/_=-]")

Span = tuple[int, str, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that meet its length."""
    out: list[Span] = []
    if ASSIGN_HINT.search(text):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]  # a maximal run, as the greedy pattern takes it
    return out


class Same:
    """One number for every character."""

    def __init__(self, value: int) -> None:
        self.value = value

    def __getitem__(self, at: int) -> int:
        return self.value


class Layer:
    """A text and, for each of its characters, the range of the first layer that it stands for."""

    def __init__(self, text: str, starts: list[int] | range | Same, ends: list[int] | range | Same) -> None:
        self.text, self.starts, self.ends = text, starts, ends

    def key(self) -> tuple:
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), self.starts[0], self.ends[-1]

    def below(self, raw: bytes, sources: list[tuple[int, int]]) -> Layer | None:
        """The layer of decoded ``raw``, whose byte i came from characters ``sources[i]`` of this one."""
        if not MAY_HOLD.search(raw):
            return None
        text = raw.decode("utf-8", "surrogateescape")
        starts, ends, at = [], [], 0
        for c in text:
            n = 1 if c < "\x80" or "\udc80" <= c <= "\udcff" else len(c.encode("utf-8"))
            starts.append(self.starts[sources[at][0]])
            ends.append(self.ends[sources[at + n - 1][1] - 1])
            at += n
        return Layer(BAD.sub("\ufffd", text), starts, ends)

    def below_wide(self, raw: bytes, sources: list[tuple[int, int]]) -> Iterator[Layer]:
        """The layers of ``raw`` read as UTF-16, where every other byte is mostly zero."""
        for order, high in (("utf-16-le", 1), ("utf-16-be", 0)):
            if len(raw) >= 8 and 4 * raw[high::2].count(0) >= len(raw):
                text = raw[: len(raw) // 2 * 2].decode(order, "replace")
                narrow = text.encode("utf-8", "surrogatepass")
                at, of_byte = 0, []
                for c in text:
                    n = 4 if c > "\uffff" else 2
                    of_byte += [(sources[min(at, len(sources) - 1)][0], sources[min(at + n, len(sources)) - 1][1])] * len(c.encode("utf-8", "surrogatepass"))
                    at += n
                if found := self.below(narrow, of_byte):
                    yield found

    def below_packed(self, raw: bytes, start: int, end: int) -> Iterator[Layer]:
        """The layers of inflated ``raw``: all of it stands for the same characters of this one."""
        for order, high in (("utf-8", None), ("utf-16-le", 1), ("utf-16-be", 0)):
            if high is not None and (len(raw) < 8 or 4 * raw[high::2].count(0) < len(raw)):
                continue
            text = raw.decode(order, "replace")
            if high is None and MAY_HOLD.search(raw) or high is not None and MAY_HOLD.search(text.encode()):
                yield Layer(text, Same(self.starts[start]), Same(self.ends[end - 1]))


def percent_layers(layer: Layer) -> Iterator[Layer]:
    """The whole layer with its percent escapes undone."""
    text = layer.text
    if "%" not in text or not ESCAPED.search(text):
        return
    raw, sources, i = bytearray(), [], 0
    while i < len(text):
        if text[i] == "%" and ESCAPED.match(text, i):
            raw.append(int(text[i + 1 : i + 3], 16))
            sources.append((i, i + 3))
            i += 3
        else:
            own = text[i].encode("utf-8", "surrogatepass")
            raw += own
            sources += [(i, i + 1)] * len(own)
            i += 1
    if found := layer.below(bytes(raw), sources):
        yield found


def backslash_layers(layer: Layer) -> Iterator[Layer]:
    """The whole layer with its backslash escapes undone."""
    text = layer.text
    if "\\" not in text or not BACKSLASH.search(text):
        return
    units, sources, i = [], [], 0
    while i < len(text):
        m = BACKSLASH.match(text, i) if text[i] == "\\" else None
        code = int(m[1] or m[2] or m[3], 16) if m else ord(text[i])
        end = m.end() if m else i + 1
        if code > 0x10FFFF:  # no character: stays as it is
            code, end = ord(text[i]), i + 1
        if 0xDC00 <= code < 0xE000 and units and 0xD800 <= units[-1] < 0xDC00:  # a pair of surrogates
            units[-1] = 0x10000 + ((units[-1] - 0xD800) << 10) + code - 0xDC00
            sources[-1] = (sources[-1][0], end)
        else:
            units.append(code)
            sources.append((i, end))
        i = end
    raw, of_byte = bytearray(), []
    for code, source in zip(units, sources, strict=True):
        own = chr(code).encode("utf-8", "surrogatepass")
        raw += own
        of_byte += [source] * len(own)
    if found := layer.below(bytes(raw), of_byte):
        yield found


def inflate(chunks: Iterator[bytes], bits: int) -> Iterator[bytes]:
    """What ``chunks`` inflate to, INFLATED bytes at most at a time; members that follow one another too, and what there is of damaged data."""
    machine = zlib.decompressobj(bits)
    for chunk in chunks:
        while chunk:
            try:
                out = machine.decompress(chunk, INFLATED)
            except zlib.error:
                return
            if out:
                yield out
            if machine.eof:
                chunk = machine.unused_data
                if bits != 31 or not chunk.startswith(b"\x1f\x8b"):
                    return
                machine = zlib.decompressobj(bits)
            else:
                chunk = machine.unconsumed_tail
    while out := _rest(machine):
        yield out


def _rest(machine) -> bytes:
    try:
        return b"" if machine.eof else machine.decompress(machine.unconsumed_tail, INFLATED)
    except zlib.error:
        return b""


def is_deflate(raw: bytes) -> bool:
    """Whether all of ``raw`` is one bare deflate stream."""
    machine, chunk = zlib.decompressobj(-15), raw
    try:
        while not machine.eof:
            out = machine.decompress(chunk, INFLATED)
            chunk = machine.unconsumed_tail
            if not out and not chunk and not machine.eof:
                return False
    except zlib.error:
        return False
    return not machine.unused_data


def unpacked(raw: bytes, bits: int) -> Iterator[bytes]:
    """Pieces of what ``raw`` inflates to, compressed data within inflated in turn; each ends where nothing that is looked for goes on."""
    chunks, seen, depth = inflate(iter((raw,)), bits), set(), 0
    while (first := next(chunks, None)) is not None:
        if not HEADER.match(first) or (mark := hashlib.sha256(first).digest()) in seen:  # data that inflates to itself ends here
            chunks = chain((first,), chunks)
            break
        seen.add(mark)
        depth += 1
        whole = chain((first,), chunks)
        chunks = inflate(whole if depth % 50 else iter((b"".join(whole),)), 31 if first[0] == 0x1F else 15)
    held: list[bytes] = []
    for chunk in chunks:
        last = BREAK.search(chunk[::-1])
        if last:
            cut = len(chunk) - last.start()
            yield b"".join((*held, chunk[:cut]))
            held = [chunk[cut:]]
        else:
            held.append(chunk)
    if held:
        yield b"".join(held)


def base64_layers(layer: Layer) -> Iterator[Layer]:
    """Runs, and runs that follow one another on lines as one, at each of the four alignments: a code may begin anywhere in a run."""
    for block in WRAPPED.finditer(layer.text):
        runs = [block.span()]
        if "\n" in block[0]:
            runs += [m.span() for m in BASE64.finditer(layer.text, block.start(), block.end())]
        for start, end in runs:
            word = layer.text[start:end]
            if not (LOWER.search(word) and OTHER.search(word)):
                continue
            at = [start + i for i, c in enumerate(word) if c not in "=\r\n\t "]
            body = "".join(layer.text[i] for i in at).replace("-", "+").replace("_", "/")
            for k in range(4):
                part = body[k:]
                if len(part) % 4 == 1:
                    part = part[:-1]
                raw = base64.b64decode(part + "=" * (-len(part) % 4))
                first = lambda i, k=k, at=at: k + i // 3 * 4 + i % 3
                for m in PACKED.finditer(raw):
                    for packed in unpacked(raw[m.start() :], 31 if m[0][0] == 0x1F else 15):
                        yield from layer.below_packed(packed, at[first(m.start())], end)
                if is_deflate(raw):
                    for packed in unpacked(raw, -15):
                        yield from layer.below_packed(packed, at[k], end)
                wide = b"\0" in raw
                if wide or MAY_HOLD.search(raw):
                    sources = [(at[first(i)], at[first(i) + 1] + 1) for i in range(len(raw))]
                    if found := layer.below(raw, sources):
                        yield found
                    if wide:
                        yield from layer.below_wide(raw, sources)


DECODERS = (percent_layers, backslash_layers, base64_layers)


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): both sorted by start, kind as listed, end; without repeats."""
    order = lambda s: (s[0], KINDS.index(s[1]), s[2])
    base = sorted(base_spans(text), key=order)
    found, seen = set(base), set()
    work = [Layer(text, range(len(text)), range(1, len(text) + 1))]
    while work:
        layer = work.pop()
        for decode in DECODERS:
            for below in decode(layer):
                key = below.key()
                if key in seen or below.text == layer.text:
                    continue
                seen.add(key)
                work.append(below)
                found.update((below.starts[a], kind, below.ends[b - 1]) for a, kind, b in base_spans(below.text))
    return base, sorted(found, key=order) if len(found) > len(base) else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end), code points, end exclusive."""

    def make():
        def rows(ids, texts):
            both = [all_spans(t or "") for t in texts]
            as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for a, k, b in spans]
            return ids, [as_rows(b) for b, _ in both], [as_rows(s) for _, s in both]

        return rows

    span = "array<struct<kind: string, start: long, end: long>>"
    return per_row(docs, [F.col(id_col), F.col(text_col)], f"`{id_col}` {dict(docs.dtypes)[id_col]}, base {span}, spans {span}", make)


def secrets(docs: DataFrame) -> DataFrame:
    """The query's rows: counts and digest of the base spans, and all spans."""
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", *map(count, KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redact_text(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with every span, overlapping ones merged, replaced by ``mark``."""
    spans = [(a, b) for a, _, b in all_spans(text)[1]]
    if not spans:
        return text
    out, at = [], 0
    end = -1
    for a, b in spans:
        if a >= end:
            out += [text[at:a], mark]
        end = at = max(end, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` and ``n_chars`` counted anew; all rows and columns stay."""
    position = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            texts = [None if t is None else redact_text(t) for t in batch.column(position).to_pylist()]
            yield batch.set_column(position, batch.schema.field(position), pa.array(texts, batch.schema.field(position).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
