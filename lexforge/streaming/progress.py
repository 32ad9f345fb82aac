"""Progress of an index build, from Spark's own reports of its streaming queries: counts only, no paths."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql.streaming import StreamingQueryListener

PHASES = ("idle", "running", "finished", "failed")
HISTORY = 64


@dataclass
class Progress(StreamingQueryListener):
    phase: str = "idle"
    batches: int = 0
    rows: int = 0
    history: deque = field(default_factory=lambda: deque(maxlen=HISTORY))

    def enter(self, phase: str) -> None:
        self.history.append((self.phase, self.batches, self.rows))
        self.phase = phase

    def onQueryStarted(self, event) -> None:
        self.enter("running")

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.enter("failed" if event.exception else "finished")

    def snapshot(self) -> dict:
        return {"phase": self.phase, "batches": self.batches, "rows": self.rows, "history": list(self.history)}
