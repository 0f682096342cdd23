"""Streams with state that ends: an exact rate limiter in event time and heartbeats in processing time, by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern.session import configure, ship

#: Fixed value: the state store that timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds whose calls of one key are decided together.
SLOT = 1000
#: Calls of one key that are kept in one piece until they are decided; of more, one SLOT is read at a time.
FEW = 4096
_SECOND = 1_000_000


def stateful(spark: SparkSession) -> SparkSession:
    """The session with the state store that these streams need, and this package on its workers."""
    ship(configure(spark))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def _limiter(limit: int, seconds: float, columns: list[str]) -> StatefulProcessor:
    # a class of a function goes to the stream's processes by value: not all of them have this package
    class Limiter(StatefulProcessor):
        """Decides calls in order of time when the watermark has passed them.

        state holds the times of the allowed calls of the last `seconds`, `limit` at most, the calls that are not decided
        yet, and the time of the next timer. Of a key with over FEW calls, pending holds them by SLOT. One timer decides
        all slots that the watermark has passed and sets the next one; without calls it is the end of the last allowed
        call's time, which clears the key, so a key without calls has no state.
        """

        def __init__(self, limit: int, seconds: float, columns: list[str]):
            self.limit, self.span, self.columns = limit, round(seconds * _SECOND), columns

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.pending = handle.getMapState("pending", "slot long", "at array<long>, id array<long>")
            self.state = handle.getValueState("state", "held array<long>, at array<long>, id array<long>, many boolean, timer long")

        def _known(self) -> tuple[list[int], list[int], list[int], bool, int | None]:
            found = self.state.get()
            if found is None:
                return [], [], [], False, None
            held, at, ids, many, timer = found
            return list(held), list(at), list(ids), many, timer

        def _put_by_slot(self, at: list[int], ids: list[int]) -> None:
            slots: dict[int, list[tuple[int, int]]] = {}
            for t, i in zip(at, ids):
                slots.setdefault(t // (SLOT * 1000), []).append((t, i))
            for slot, calls in slots.items():
                before = self.pending.getValue((slot,)) if self.pending.containsKey((slot,)) else ([], [])
                self.pending.updateValue((slot,), ([*before[0], *(t for t, _ in calls)], [*before[1], *(i for _, i in calls)]))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            known, first = None, None
            for frame in rows:
                frame = frame[~frame["tick"]]
                if not len(frame):
                    continue
                held, at, ids, many, timer = known or self._known()
                at, ids = at + frame["us"].tolist(), ids + frame["id"].tolist()
                low = int(frame["us"].min())
                first = low if first is None else min(first, low)
                if len(at) > FEW:
                    self._put_by_slot(at, ids)
                    at, ids, many = [], [], True
                known = held, at, ids, many, timer
            if known:
                due = (first // (SLOT * 1000) + 1) * SLOT
                if known[4] is None or due < known[4]:
                    self.handle.registerTimer(due)
                    known = (*known[:4], due)
                self.state.update(known)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            held, at, ids, many, timer = self._known()
            passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) // SLOT  # slots below it are whole
            few: dict[int, list[tuple[int, int]]] = {}
            for t, i in zip(at, ids):
                few.setdefault(t // (SLOT * 1000), []).append((t, i))
            stored = {k[0] for k in self.pending.keys()} if many else set()
            slots = sorted(stored | few.keys())
            out = []
            for slot in slots:
                if slot >= passed:
                    break
                calls = few.pop(slot, [])
                if slot in stored:
                    calls += zip(*self.pending.getValue((slot,)))
                    self.pending.removeKey((slot,))
                for t, i in sorted(calls):
                    held = [h for h in held if h > t - self.span]
                    allowed = len(held) < self.limit
                    if allowed:
                        held.append(t)
                    out.append((key[0], i, allowed))
                if len(out) >= FEW:
                    yield pd.DataFrame(out, columns=self.columns)
                    out = []
            left = [s for s in slots if s >= passed]
            held = [h for h in held if h + self.span > passed * SLOT * 1000]  # calls to come are not before that
            if left or held:
                after = left[0] + 1 if left else -(-(held[-1] + self.span) // (SLOT * 1000))
                if after * SLOT != timer:
                    self.handle.registerTimer(after * SLOT)
                calls = [c for s in sorted(few) for c in few[s]]
                self.state.update((held, [t for t, _ in calls], [i for _, i in calls], bool(stored.intersection(left)), after * SLOT))
            elif timer is not None:
                self.state.clear()
            if out:
                yield pd.DataFrame(out, columns=self.columns)

        def close(self) -> None:
            pass

    return Limiter(limit, seconds, columns)


def rate_limited(calls: DataFrame, limit: int, seconds: float = 60.0, late: str = "10 seconds") -> DataFrame:
    """Each call (key, id: long, at: timestamp) with allowed: fewer than `limit` allowed calls of its key in the seconds
    before. Rejected calls don't count.

    Calls are decided in order of time and id, across batches too, when the watermark has passed them: `late` is how long
    a decision waits for earlier calls; calls that come later than that are left out, and so are those without a key or a
    time. A row without an id only tells the time, whatever its key: a source that is idle sends one now and then. A task holds FEW of one key's
    calls and those of one SLOT, and its `limit` allowed times; the rest is in the state store, and a key's state goes when its last allowed call is too old
    to count.
    """
    stateful(calls.sparkSession)
    kind = dict(calls.dtypes)["key"]
    known = calls.filter("key is not null and at is not null")
    slim = known.select("key", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("tick"), "at", F.unix_micros("at").alias("us")).withWatermark("at", late)
    return slim.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_limiter(limit, seconds, ["key", "id", "allowed"]), outputStructType=f"key {kind}, id long, allowed boolean", outputMode="Append", timeMode="EventTime"
    )


def _heartbeats(interval: float, last: tuple[str, ...], text: str) -> StatefulProcessor:
    class Heartbeats(StatefulProcessor):
        """Relays frames and adds a comment for each interval in which a run is silent, until its last event."""

        def __init__(self, interval: float, last: tuple[str, ...], text: str):
            self.interval, self.last, self.text = round(interval * 1000), last, text

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle

        def _silent_from(self, now: int) -> None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if now is not None:
                self.handle.registerTimer(now + self.interval)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            ended = False
            for frame in rows:
                ended = ended or bool(frame["event"].isin(self.last).any())
                yield pd.DataFrame({"run_id": key[0], "seq": frame["seq"], "frame": frame["frame"]})
            self._silent_from(None if ended else timerValues.getCurrentProcessingTimeInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.interval)
            yield pd.DataFrame({"run_id": [key[0]], "seq": pd.array([None], "Int32"), "frame": [f": {self.text}\n\n"]})

        def close(self) -> None:
            pass

    return Heartbeats(interval, last, text)


def frames_with_heartbeats(events: DataFrame, interval: float, last: tuple[str, ...] = ("done", "no_answer", "error"), text: str = "heartbeat") -> DataFrame:
    """run_id, seq and frame of a stream of event rows (run_id, seq: int, event, data), and a comment frame, without seq, for
    each `interval` seconds in which a run has no event, until one of the last ones. A run that ended has no timer and no
    state. Timers are looked at with each trigger, so the trigger's interval must be shorter."""
    from quern.streaming.logs import frames

    stateful(events.sparkSession)
    made = frames(events, "event")
    kind = dict(events.dtypes)["run_id"]
    return made.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=_heartbeats(interval, last, text), outputStructType=f"run_id {kind}, seq int, frame string", outputMode="Append", timeMode="ProcessingTime"
    )
