"""Live counters of streams, from the metrics that their micro-batches report."""

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from tidewatch.operators.reports import OBSERVED


class StageCounters(StreamingQueryListener):
    """Sums what `reports.observed` counts, over the micro-batches of all streams of a session, as each one ends.

    A micro-batch counts once: one replayed by a restarted stream has the id it had before. What it holds is one number per
    (stage, counter) and one batch id per stream.
    """

    def __init__(self):
        self._totals, self._last, self._ended = {}, {}, {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        self._end_of(str(event.runId))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        metrics = {k: v for k, v in progress.observedMetrics.items() if k.endswith(OBSERVED)}
        with self._lock:
            if not metrics or progress.batchId <= self._last.get(str(progress.id), -1):
                return
            self._last[str(progress.id)] = progress.batchId
            for name, row in metrics.items():
                for counter, n in row.asDict().items():
                    at = (name.removesuffix(OBSERVED), counter)
                    self._totals[at] = self._totals.get(at, 0) + n

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end_of(str(event.runId)).set()

    def _end_of(self, run: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run, threading.Event())

    def until_end(self, query, seconds: float = 60) -> None:
        """Waits until a stream has ended and all its reports are in; they come some time after the stream's end."""
        query.awaitTermination()
        if not self._end_of(str(query.runId)).wait(seconds):
            raise TimeoutError(f"no report of the end of stream {query.runId}")
        with self._lock:
            del self._ended[str(query.runId)]

    def rows(self, spark: SparkSession) -> DataFrame:
        """(stage, counter, n) as of now, as `reports.stage_counters` has them."""
        with self._lock:
            now = sorted((stage, counter, n) for (stage, counter), n in self._totals.items())
        return spark.createDataFrame(now, "stage string, counter string, n bigint")
