"""Per-key state of the stream detectors, kept by Spark's state store.

A processor holds what one key needs and adds it to the key's rows; what the rows mean is left to the
column expressions of the batch operators. The rows of one key in one micro-batch are put in order
in one task, so `maxFilesPerTrigger` (or the source's own limit) bounds what a task holds of a hot key.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The watermark trails by this much, so Spark never drops a row for being late; timers and limits
#: are set as much earlier. A clock of event times without loss.
TRAIL_MS = 3650 * 86_400_000
TRAIL = f"{TRAIL_MS} milliseconds"

def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def read_state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """A state variable as of the last committed batch, as rows of key and value."""
    use_state_store(spark)
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


def _none(value):
    return None if value is None or value is pd.NaT or (isinstance(value, float) and np.isnan(value)) else value


def _gathered(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    frames = list(rows)
    return (pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]).sort_values(order, kind="stable", ignore_index=True)


class LoadHistory(StatefulProcessor):
    """Per source: the moments of all earlier positive counts, and the last checksum of each day.

    Adds to a signal what was known before it: baseline_n, baseline_mean, baseline_std, previous_checksum. A day that
    is not seen again for `keep_days` leaves the state by its time to live.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.moments = handle.getValueState("moments", "n bigint, mean double, m2 double, low double, high double")
        self.checksums = handle.getMapState("checksums", "day string", "checksum string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _gathered(rows, ["ts", "event_id"])
        n, mean, m2, low, high = self.moments.get() or (0, 0.0, 0.0, np.inf, -np.inf)
        known, changed, begin = {}, set(), n
        before, previous = [], []
        for text, checksum, day in zip(frame["row_count"], frame["checksum"], frame["partition_date"]):
            std = None if n == 0 else 0.0 if n == 1 or low == high else (m2 / (n - 1)) ** 0.5
            before.append((n, mean if n else None, std))
            count = int(text) if text is not None else 0
            if count > 0:
                n, delta = n + 1, count - mean
                mean += delta / n
                m2 += delta * (count - mean)
                low, high = min(low, count), max(high, count)
            if checksum is None:
                previous.append(None)
                continue
            if day not in known:
                known[day] = self.checksums.getValue((day,))[0] if self.checksums.containsKey((day,)) else None
            previous.append(known[day])
            known[day] = checksum
            changed.add(day)
        if n > begin:
            self.moments.update((n, mean, m2, float(low), float(high)))
        for day in changed:
            self.checksums.updateValue((day,), (known[day],))
        frame["baseline_n"], frame["baseline_mean"], frame["baseline_std"] = zip(*before)
        frame["previous_checksum"] = previous
        yield frame

    def close(self) -> None:
        pass


class SourceContracts(StatefulProcessor):
    """Per source: the columns of its contract, as JSON. The first snapshot becomes the contract of a source that has none.

    Passes the signals on; a source's first row in a batch carries the contract. Contracts that exist when the stream
    begins are handed in as initial state (source, columns_json).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.contract = handle.getValueState("contract", "columns_json string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.contract.update((initialState["columns_json"].iloc[0],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored, first = self.contract.get(), None
        if stored is None:
            frame = _gathered(rows, ["ts", "run_id"])
            known = next((c for c in frame["columns_json"] if _none(c) is not None), None)
            if known is not None:
                stored = (known,)
                self.contract.update(stored)
            rows = iter([frame])
        for frame in rows:
            frame["contract"] = [stored[0] if stored and first is None else None] + [None] * (len(frame) - 1)
            yield frame
            first = True

    def close(self) -> None:
        pass


class OpenBuckets(StatefulProcessor):
    """Per run: the facts of its open bucket, and the names of its models.

    A timer per run fires when the clock passes the bucket's end, also if the run has no more rows; a row beyond the end
    closes it at once. A row older than the open bucket joins it; after the bucket was emitted it opens a new one.
    """

    FACTS = ("opened_us bigint, {flags}, rank int, n_signals bigint, suppressed boolean, first_us bigint, first_id string, "
             "first_type string, first_confidence double, first_model string")

    def __init__(self, kinds: list[str], width_us: int, delay_us: int):
        self.kinds, self.width, self.delay = list(kinds), width_us, delay_us

    def facts_schema(self) -> str:
        return self.FACTS.format(flags=", ".join(f"has_{k} boolean" for k in self.kinds))

    def result_schema(self) -> str:
        return f"run_id string, {self.facts_schema()}, models array<string>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", self.facts_schema())
        self.models = handle.getMapState("models", "model_name string", "seen boolean")

    def _timer(self, opened: int) -> int:
        return -(-(opened + self.width + self.delay) // 1000) - TRAIL_MS

    def _closed(self, key, facts: tuple, models: set) -> tuple:
        return (key[0], *facts, sorted(models))

    def _names(self) -> set:
        return {name for (name,) in self.models.keys()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _gathered(rows, ["us", "signal_id"])
        us = frame["us"].to_numpy()
        held, had = self.open.get(), None
        names = self._names() if held else set()
        stored_names, out, at = set(names), [], 0
        if held:
            had = held = tuple(held)
        while at < len(us):
            if held is None:
                held = (int(us[at]), *[False] * len(self.kinds), 1, 0, True, int(us[at]), None, None, None, None)
            end = int(np.searchsorted(us, held[0] + self.width))
            if end > at:
                held = self._merged(held, frame.iloc[at:end])
                names |= {m for m in frame["model_name"].iloc[at:end] if m}
                at = end
            if at < len(us):  # the run has moved on
                out.append(self._closed(key, held, names))
                held, names = None, set()
        if had and had[0] != held[0]:
            self.handle.deleteTimer(self._timer(had[0]))
            self.models.clear()
            stored_names = set()
        if not had or had[0] != held[0]:
            self.handle.registerTimer(self._timer(held[0]))
        self.open.update(held)
        for name in names - stored_names:
            self.models.updateValue((name,), (True,))
        yield self._frame(out)

    def _merged(self, facts: tuple, rows: pd.DataFrame) -> tuple:
        opened, k = facts[0], len(self.kinds)
        present = set(rows["anomaly_type"])
        flags = [a or kind in present for a, kind in zip(facts[1:1 + k], self.kinds)]
        rank, n, quiet, *first = facts[1 + k:]
        top = rows.iloc[0]
        # a row from before the bucket counts as one at its opening
        candidate = (max(int(top["us"]), opened), top["signal_id"], top["anomaly_type"], _none(top["confidence"]), top["model_name"])
        if opened > int(top["us"]):
            early = rows[rows["us"] <= opened].sort_values("signal_id").iloc[0]
            candidate = (opened, early["signal_id"], early["anomaly_type"], _none(early["confidence"]), early["model_name"])
        if first[1] is None or candidate[:2] < (first[0], first[1]):
            first = candidate
        return (opened, *flags, int(max(rank, rows["rank"].max())), int(n) + len(rows), bool(quiet and rows["low"].all()), *first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.open.get()
        out = []
        if held is not None and self._timer(held[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            out.append(self._closed(key, tuple(held), self._names()))
            self.open.clear()
            self.models.clear()
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        columns = [c.split()[0] for c in f"run_id string, {self.facts_schema()}".split(", ")] + ["models"]
        return pd.DataFrame(rows, columns=columns)

    def close(self) -> None:
        pass


class Lateness(StatefulProcessor):
    """Marks the rows of a source that lie more than `delay` behind the newest time of earlier batches, and counts them."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "n_rows bigint, n_late bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        clock = timerValues.getCurrentWatermarkInMs()
        limit = (clock + TRAIL_MS - self.delay_ms) * 1000 if clock > 0 else None
        n_rows, n_late = self.counts.get() or (0, 0)
        for frame in rows:  # in any order, one Arrow batch at a time
            late = frame["us"] < limit if limit is not None else pd.Series(False, index=frame.index)
            n_rows, n_late = n_rows + len(frame), n_late + int(late.sum())
            yield frame.assign(is_late=late)
        self.counts.update((n_rows, n_late))

    def close(self) -> None:
        pass


class SilentSources(StatefulProcessor):
    """Per source: its newest signal. A timer fires when the clock is more than `max_age` whole seconds past it, though the source
    says nothing, and gives that signal; a newer one sets the timer anew."""

    def __init__(self, max_age: int):
        self.max_age = max_age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "us bigint, event_id string, run_id string")

    def _timer(self, us: int) -> int:
        return (us // 1_000_000 + self.max_age + 1) * 1000 - 1 - TRAIL_MS

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored = self.newest.get()
        newest = tuple(stored) if stored else None
        for frame in rows:
            seen = max(zip(frame["us"].tolist(), frame["event_id"], frame["run_id"]))
            newest = seen if newest is None else max(newest, seen)
        if stored is None or newest != tuple(stored):
            if stored is not None:
                self.handle.deleteTimer(self._timer(stored[0]))
            self.newest.update(newest)
            self.handle.registerTimer(self._timer(newest[0]))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        us, event_id, run_id = self.newest.get()
        if self._timer(us) <= expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame({"source": [key[0]], "us": [us], "event_id": [event_id], "run_id": [run_id]})

    def close(self) -> None:
        pass


class RecentResults(StatefulProcessor):
    """Per (model, test): its last `window` results, so a new one costs the same however long the history is.

    Adds to a result total_runs and failure_count over the window that ends with the last result of its run.
    """

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.results = handle.getListState("results", "us bigint, position int, failed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _gathered(rows, ["us", "position"])
        old = [(int(us), int(position), bool(failed)) for us, position, failed in self.results.get()]
        new = list(zip(frame["us"].tolist(), frame["position"].tolist(), frame["failed"].tolist()))
        merged = sorted([(*r, -1) for r in old] + [(*r, i) for i, r in enumerate(new)])
        sums = np.concatenate([[0], np.cumsum([r[2] for r in merged])])
        ends = np.arange(1, len(merged) + 1)
        total, failed = np.minimum(ends, self.window), sums[ends] - sums[np.maximum(ends - self.window, 0)]
        at = np.array([r[3] for r in merged])
        place = np.empty(len(new), dtype=np.int64)
        place[at[at >= 0]] = np.flatnonzero(at >= 0)
        last = pd.Series(place).groupby(frame["run_id"]).transform("max").to_numpy()  # one answer for a run
        self.results.put([r[:3] for r in merged[-self.window:]])
        yield frame.assign(total_runs=total[last], failure_count=failed[last])

    def close(self) -> None:
        pass
