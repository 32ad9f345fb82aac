"""Published versions of an index: immutable folders, the newest complete one is read.

A version's tables are written first and its manifest row last, so a reader sees a
whole version or the one before. Versions of the schema or the tokenizer that differ
from this code's ask for a rebuild.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA, TOKENIZER, DECLARATIONS = 3, 2, 1


@dataclass(frozen=True)
class Manifest:
    generation: int
    schema: int = SCHEMA
    tokenizer: int = TOKENIZER
    declarations: int = DECLARATIONS

    def needed(self) -> str:
        """What has to be done before this version serves: nothing, declarations, statistics, tokens, or all."""
        if self.schema < 2:
            return "all"
        if self.tokenizer != TOKENIZER:
            return "tokens"
        if self.schema < SCHEMA:
            return "statistics"
        return "nothing" if self.declarations == DECLARATIONS else "declarations"


class Versions:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def latest(self) -> Manifest | None:
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.parquet(f"{self.folder}/manifest")
        except AnalysisException:
            return None
        row = rows.orderBy(F.desc("generation")).first()
        return Manifest(row.generation, row.schema, row.tokenizer, row.declarations) if row else None

    def next(self) -> Manifest:
        """The generation to write next: nobody reads it before it is committed."""
        now = self.latest()
        return Manifest(now.generation + 1 if now else 1)

    def path(self, manifest: Manifest, name: str) -> str:
        return f"{self.folder}/generation={manifest.generation}/{name}"

    def commit(self, manifest: Manifest) -> None:
        row = [(manifest.generation, manifest.schema, manifest.tokenizer, manifest.declarations)]
        self.spark.createDataFrame(row, "generation int, schema int, tokenizer int, declarations int").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def publish(self, tables: dict[str, DataFrame]) -> Manifest:
        """Writes the tables as the next generation. The generation says whether cursors still hold."""
        new = self.next()
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self.path(new, name))
        self.commit(new)
        return new

    def read(self, manifest: Manifest, name: str, schema: str | None = None) -> DataFrame:
        """``schema``: of a table that may have no file, if it is partitioned and empty."""
        if schema:
            return self.spark.read.schema(schema).parquet(self.path(manifest, name))
        return self.spark.read.parquet(self.path(manifest, name))
