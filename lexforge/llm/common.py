"""Shared pieces of the training-data operators.

Every operator takes DataFrames plus column names, reads only those columns (so
further columns, whatever their names, are ignored) and treats a null text as
the empty text.
"""

from __future__ import annotations

import contextlib
import ctypes
import getpass
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Entries of one generation of a memo; it never changes a result.
MEMO_ENTRIES = 120_000


class Recent(dict):
    """A memo of two generations: at ``most`` entries the young one becomes the old one, whose entries come back when met.

    A subclass says how to ``make`` a value; memory is bounded, and what is common stays.
    """

    def __init__(self, most: int = MEMO_ENTRIES) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out


def trim() -> None:
    """Hand freed memory back to the system after a large piece of work: worker processes stay."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset, as in tests, below the local one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints', getpass.getuser())}"
    return f"{base.rstrip('/')}/lexforge-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and reread: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Like ``stored``, but in ``buckets`` by ``column``: what is grouped or joined by it need not be shuffled. The catalog's entry is only a means."""
    spark, path, name = df.sparkSession, shared_dir(df.sparkSession), f"lexforge_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).saveAsTable(name, "parquet", path=path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return out


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lexforge-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column | str) -> Column:
    """True for the rows whose crc32(id as text) mod 3 is 1: never used for fitting."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches over the same memory, so that few rows at a time become Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def per_row(df: DataFrame, columns: list[str | Column], schema: str, make: Callable[[], Callable]) -> DataFrame:
    """``mapInArrow`` over ``columns``: ``make()`` runs once a task and returns rows(list of columns) -> list of columns."""
    fields = StructType.fromDDL(schema).fields
    names = [f.name for f in fields]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = make()
        for batch in sliced(batches):
            if batch.num_rows:
                out = rows(*[c.to_pylist() for c in batch.columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)
        del rows
        trim()

    return df.select(*columns).mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", text_col: str = "text", chars: int | None = None) -> DataFrame:
    """At most ``bound`` labelled documents that are not held out, by a hash of the id, of ``chars`` characters in all at most: (text, y).

    Only the ids are sampled first; they are at most ``bound`` rows, hence the
    broadcast. Of repeated rows with one id the least text counts.
    """
    order = [F.xxhash64("_id"), F.col("_id")]
    ids = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y"))
        .groupBy("_id").agg(F.max("y").alias("y"))
        .orderBy(*order).limit(bound)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), "_id").groupBy("_id", "y").agg(F.min("text").alias("text"))
    if chars is not None:
        total, taken = 0, []
        for r in rows.select("_id", F.length("text").alias("n")).orderBy(*order).collect():  # at most ``bound`` rows of two numbers
            total += r.n
            if total > chars:
                break
            taken.append(r["_id"])
        rows = rows.where(F.col("_id").isin(taken))
    return rows.select("text", "y")
