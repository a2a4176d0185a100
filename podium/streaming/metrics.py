"""Progress of running queries."""

from __future__ import annotations

from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Keeps, of the last ``most`` micro-batches, rows, rates, state rows and rows dropped behind the watermark."""

    def __init__(self, most: int = 1000):
        self.most, self.batches = most, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = p.stateOperators
        self.batches.append(
            {
                "query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "in_per_second": p.inputRowsPerSecond, "done_per_second": p.processedRowsPerSecond,
                "state_rows": sum(s.numRowsTotal for s in state), "late": sum(s.numRowsDroppedByWatermark for s in state),
            }
        )
        del self.batches[: -self.most]

    def late(self, spark) -> int:
        """Rows dropped behind the watermark so far, once all events have been told."""
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return sum(b["late"] for b in self.batches)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
