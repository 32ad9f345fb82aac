"""Coverage: a ledger of scan outcomes for each source, its totals, and the collection's status.

ledger and updates: collection, source_key, pending, errors, excluded, diagnostics
(map category -> count). An update with ``gone`` set takes its source out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ["pending", "errors", "excluded"]
MOST_PATHS = 1024
#: Categories of diagnostics that clients see by name.
PUBLIC = tuple(
    "binary_excluded content_cache_hit content_cache_miss content_cache_write_error git_metadata_excluded non_file_change outside_root ownership_excluded symlink_excluded "
    "unsupported_encoding unsupported_record watcher_unavailable".split()
)


def applied(ledger: DataFrame, updates: DataFrame, full: bool, completed: bool) -> DataFrame:
    """A complete full scan replaces the set; any other is merged, and sources it has not seen stay."""
    fresh = updates.where(~F.coalesce("gone", F.lit(False))).select(ledger.columns)
    if full and completed:
        return fresh
    return ledger.join(updates.select("collection", "source_key"), ["collection", "source_key"], "left_anti").select(ledger.columns).unionByName(fresh)


def totals(ledger: DataFrame) -> DataFrame:
    """collection, pending, errors, excluded and the merged diagnostics (sorted, as category:count)."""
    sums = ledger.groupBy("collection").agg(*(F.sum(c).cast("long").alias(c) for c in COUNTS))
    each = ledger.select("collection", F.explode("diagnostics").alias("category", "n")).groupBy("collection", "category").agg(F.sum("n").alias("n"))
    merged = each.groupBy("collection").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "category", "n"))), ",").alias("diagnostics"))
    return sums.join(merged, "collection", "left").withColumn("diagnostics", F.coalesce("diagnostics", F.lit("")))


def status(pending: Column, errors: Column, reconciled: Column) -> Column:
    """An unknown number pending is building until something was reconciled once, refreshing after that."""
    return F.when(pending.isNull(), F.when(reconciled, "refreshing").otherwise("building")).when(pending > 0, "refreshing").when(errors > 0, "degraded").otherwise("ready")


@dataclass
class Scope:
    """Changed paths that wait for a scan; None is everything. Merging beyond MOST_PATHS gives everything."""

    paths: frozenset[str] | None = field(default_factory=frozenset)

    def merged(self, other: Scope) -> Scope:
        if self.paths is None or other.paths is None:
            return Scope(None)
        both = self.paths | other.paths
        return Scope(both if len(both) <= MOST_PATHS else None)


@dataclass
class Controller:
    """One active run for a collection; changes that arrive meanwhile wait for the next. Revisions tell readers that something moved."""

    pending: Scope | None = None
    active: tuple[int, Scope] | None = None
    observed: int = 0
    published: int = 0
    runs: int = 0

    def observe(self, scope: Scope) -> None:
        self.observed += 1
        self.pending = scope if self.pending is None else self.pending.merged(scope)

    def start(self) -> tuple[int, Scope] | None:
        if self.active or self.pending is None:
            return None
        self.runs += 1
        self.active, self.pending = (self.runs, self.pending), None
        return self.active

    def finish(self, ticket: int, ok: bool) -> bool:
        """False for a ticket that is not the active one. A failed run asks for everything again."""
        if not self.active or self.active[0] != ticket:
            return False
        self.active = None
        self.published += 1
        if not ok:
            self.pending = Scope(None)
        return True

    def token(self) -> tuple[int, int]:
        return self.observed, self.published

    def still_valid(self, token: tuple[int, int]) -> bool:
        return token == self.token()
