"""Project files: discovery, decoding, binary rejection and chunking.

Spark's own file sources pass over names that begin with ``.`` or ``_``, which projects
are full of, so folders are listed and files read by tasks through Arrow's file systems.
The listing comes first; ignore rules (nested ignore files too) become path predicates on
it, and only what they leave is read. A file that cannot be decoded, is binary, or keeps
changing while it is read is an exclusion with its reason.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import glob_regex

LINES, BYTES = 60, 16_384


def ignore_regex(rule: str) -> str | None:
    """One line of an ignore file as a pattern over relative paths; None for blanks and comments. ``!`` is the caller's."""
    rule = rule.rstrip("\n").rstrip()
    if not rule or rule.startswith("#"):
        return None
    folder = rule.endswith("/")
    anchored = "/" in rule.rstrip("/")
    body = glob_regex(rule.strip("/")).removeprefix("(?s)^").removesuffix("$")
    body = body.replace(".*", "[^/]*") if "**" not in rule else body.replace("^.*/", "^(?:.*/)?")
    return rf"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}$"


Rule = str | tuple[str, str]


def is_ignored(path: Column, rules: list[Rule]) -> Column:
    """The last rule that matches decides; ``!`` takes a path back. A rule may come with the folder that it holds for. ``.git`` is always left out."""
    out = F.lit(False)
    for rule in rules:
        folder, rule = ("", rule) if isinstance(rule, str) else rule
        back = rule.startswith("!")
        if pattern := ignore_regex(rule[back:]):
            below = "".join("\\" + c if not c.isalnum() else c for c in f"{folder}/") if folder else ""
            out = F.when(path.rlike(f"^{below}{pattern.removeprefix('^')}"), F.lit(not back)).otherwise(out)
    return out | path.rlike(GIT)


GIT = r"(?:^|/)\.git(?:/|$)"
IGNORE_FILES = (".gitignore", ".ignore")
TRIES = 3


def file_system(root: str) -> tuple[pf.FileSystem, str]:
    return pf.FileSystem.from_uri(root) if "://" in root else (pf.LocalFileSystem(), os.path.abspath(root.removeprefix("file:")))


def below(fs: pf.FileSystem, base: str, entry: str) -> Iterator[tuple[str, int, int, str]]:
    """(relative path, length, modified in ns, kind) of an entry of ``base`` and all below it; links are not followed."""
    place = f"{base}/{entry}"
    if isinstance(fs, pf.LocalFileSystem):
        files = [place] if os.path.islink(place) or not os.path.isdir(place) else (os.path.join(d, n) for d, folders, names in os.walk(place) for n in [*names, *(f for f in folders if os.path.islink(os.path.join(d, f)))])
        for f in files:
            at = os.lstat(f)
            kind = "symlink" if os.path.islink(f) else "file" if os.path.isfile(f) else "other"
            yield os.path.relpath(f, base), at.st_size, at.st_mtime_ns, kind
        return
    info = fs.get_file_info(place)
    for f in fs.get_file_info(pf.FileSelector(place, recursive=True)) if info.type == pf.FileType.Directory else [info]:
        if f.type == pf.FileType.File:
            yield f.path.removeprefix(f"{base}/"), f.size, f.mtime_ns or 0, "file"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), length, modified, kind (file, symlink, other) of all below ``root``; no content is read. Each entry of the root is listed by a task."""
    fs, base = file_system(root)
    first = [f.base_name for f in fs.get_file_info(pf.FileSelector(base))]

    def run(batches):
        fs, base = file_system(root)
        for batch in batches:
            out = [row for entry in batch.column(0).to_pylist() for row in below(fs, base, entry)]
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "length", "modified", "kind"])

    rows = spark.createDataFrame([(e,) for e in first], "entry string").repartition(max(1, min(len(first), spark.sparkContext.defaultParallelism)))
    return rows.mapInArrow(run, "path string, length long, modified long, kind string").withColumn("modified", F.timestamp_micros(F.floor(F.col("modified") / 1000)))


def stable_bytes(fs: pf.FileSystem, path: str) -> bytes | None:
    """The content, if the file was the same before and after; None if it changed at each of TRIES."""
    state = lambda: (i := fs.get_file_info(path)) and (i.type, i.size, i.mtime_ns)
    for _ in range(TRIES):
        before = state()
        try:
            with fs.open_input_file(path) as f:
                content = f.read()
        except FileNotFoundError:
            continue
        if state() == before:
            return content
    return None


def with_content(files: DataFrame, root: str) -> DataFrame:
    """path, content (null if the file is not stable), version, modified, length."""

    def run(batches):
        fs, base = file_system(root)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                content = [stable_bytes(fs, f"{base}/{p}") for p in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.binary()), part.column(1), part.column(2)], ["path", "content", "modified", "length"])

    found = files.select("path", "modified", "length").mapInArrow(run, "path string, content binary, modified timestamp, length long")
    return found.select("path", "content", F.sha2("content", 256).alias("version"), "modified", "length")


def nested_rules(listed: DataFrame, root: str) -> list[Rule]:
    """The rules of all ignore files, each with its folder: the repository's own exclusions, then from the root down, ``.ignore`` after ``.gitignore``."""
    name = F.element_at(F.split("path", "/"), -1)
    files = with_content(listed.where((name.isin(*IGNORE_FILES) & ~F.col("path").rlike(GIT)) | (F.col("path") == ".git/info/exclude")), root)
    found = [(r.path.rpartition("/")[0], r.path.rpartition("/")[2], r.content or b"") for r in files.select("path", "content").collect()]  # a few small files
    found = [("" if n == "exclude" else d, n, c) for d, n, c in found]
    found.sort(key=lambda x: (x[1] != "exclude", x[0].count("/") + bool(x[0]), x[0], IGNORE_FILES.index(x[1]) if x[1] in IGNORE_FILES else 0))
    return [(d, line) for d, _, c in found for line in c.decode("utf-8", "replace").splitlines()]


def excluded_entries(listed: DataFrame) -> DataFrame:
    """path, reason of what is never read: links, repository metadata, and what is no file."""
    reason = F.when(F.col("path").rlike(GIT), "git_metadata_excluded").when(F.col("kind") == "symlink", "symlink_excluded").when(F.col("kind") != "file", "non_file_change")
    return listed.select("path", reason.alias("reason")).where("reason is not null")


def discover(spark: SparkSession, root: str, rules: list[Rule] = (), only: list[str] | None = None) -> DataFrame:
    """path (relative), content, version, modified, length of the files below ``root`` that neither ``rules`` nor the ignore files leave out; ``only`` narrows to given paths."""
    listed = listing(spark, root)
    every = [*rules, *nested_rules(listed, root)]
    files = listed.where((F.col("kind") == "file") & ~is_ignored(F.col("path"), every))
    return with_content(files.where(F.col("path").isin(only)) if only is not None else files, root)


def changed(found: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files whose (path, version) is not indexed yet: only these are read on."""
    return found.join(indexed.select("path", "version"), ["path", "version"], "left_anti")


def missing(found: DataFrame, indexed: DataFrame) -> DataFrame:
    """Indexed paths that are no longer found: deletions."""
    return indexed.join(found.select("path"), "path", "left_anti")


def is_binary(text: str) -> bool:
    """A NUL, or at some prefix 8 control characters that are a fifth of it at least."""
    if "\x00" in text:
        return True
    controls = 0
    for n, c in enumerate(text, 1):
        if (c < " " and c not in "\t\n\r\f\x1b") or c == "\x7f":
            controls += 1
            if controls >= 8 and controls * 5 >= n:
                return True
    return False


def decode(content: bytes | None) -> tuple[str | None, str | None]:
    """(text, None) or (None, reason): by byte order mark, else strict UTF-8. None is a file that did not keep still."""
    if content is None:
        return None, "unstable_source"
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            content, codec = content[len(mark) :], name
            break
    else:
        codec = "utf-8"
    try:
        text = content.decode(codec)
    except UnicodeDecodeError:
        return None, "unsupported_encoding"
    return (None, "binary") if is_binary(text) else (text, None)


def chunks(text: str, lines: int | None = LINES, most: int = BYTES) -> Iterator[tuple[int, str, int, int, int, int]]:
    """(ordinal, text, start_line, end_line, start_byte, end_byte): closed at a newline after ``lines`` of them, or before ``most`` bytes are passed."""
    ordinal = start = at_line = first_line = size = newlines = byte = 0
    for i, c in enumerate(text):
        n = len(c.encode("utf-8", "surrogatepass"))
        if size and size + n > most:
            yield ordinal, text[start:i], first_line + 1, at_line + 1, byte, byte + size
            ordinal, start, first_line, byte, size, newlines = ordinal + 1, i, at_line, byte + size, 0, 0
        size += n
        if c == "\n":
            newlines += 1
            at_line += 1
            if lines and newlines >= lines:
                yield ordinal, text[start : i + 1], first_line + 1, at_line, byte, byte + size
                ordinal, start, first_line, byte, size, newlines = ordinal + 1, i + 1, at_line, byte + size, 0, 0
    if size:
        yield ordinal, text[start:], first_line + 1, at_line + (not text.endswith("\n")), byte, byte + size


CHUNK_SCHEMA = "ordinal long, text string, start_line long, end_line long, start_byte long, end_byte long"


def chunk_texts(rows: DataFrame, keys: list[str], text: str = "text", lines: int | None = LINES, most: int = BYTES) -> DataFrame:
    """keys... and the chunks of each text; null and empty texts have none."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            at, out = [], []
            for i, value in enumerate(batch.column(len(keys)).to_pylist()):
                for chunk in chunks(value or "", lines, most):
                    at.append(i)
                    out.append(chunk)
            columns = [pa.array([c[k] for c in out], pa.string() if k == 1 else pa.int64()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))), *columns], [*keys, "ordinal", "text", "start_line", "end_line", "start_byte", "end_byte"])

    return rows.select(*keys, text).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + CHUNK_SCHEMA)


def line_blocks(rows: DataFrame, keys: list[str], text: str = "text", lines: int = LINES) -> DataFrame:
    """The fast path, by functions only, for texts whose blocks stay below BYTES: keys..., ordinal, text."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=\n)")
    line = rows.select(*keys, F.posexplode(F.filter(split, lambda x: x != "")).alias("n", "line"))
    grouped = line.groupBy(*keys, F.floor(F.col("n") / lines).alias("ordinal")).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("parts"))
    return grouped.select(*keys, "ordinal", F.array_join(F.transform("parts", lambda p: p["line"]), "").alias("text"))


def read_project(files: DataFrame, collection: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, exclusions) of discovered files."""

    def run(batches):
        for batch in batches:
            both = [decode(c) for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in both], pa.string()), pa.array([r for _, r in both], pa.string())], ["path", "version", "text", "reason"])

    decoded = files.select("path", "version", "content").mapInArrow(run, "path string, version string, text string, reason string")
    key = F.sha2(F.concat(F.lit(collection), F.lit("\x00"), "path"), 256).alias("source_key")
    found = chunk_texts(decoded.where("reason is null").select(key, "path", "version", "text"), ["source_key", "path", "version"])
    return found.withColumns({"collection": F.lit(collection), "kind": F.lit("project")}), decoded.where("reason is not null").select("path", "reason")


def narrowed_changes(porcelain: list[str], diff: list[str]) -> set[str] | None:
    """Paths to look at again, from ``git status --porcelain`` and ``git diff --name-only`` lines; None (everything) if an ignore file changed."""
    paths = {p.strip() for p in diff if p.strip()}
    for line in porcelain:
        name = line[3:].strip()
        paths |= {part.strip().strip('"') for part in name.split(" -> ")} if name else set()
    ignoring = (".gitignore", ".ignore", ".git/info/exclude")
    return None if any(p.endswith(ignoring) for p in paths) else paths
