"""Structured Streaming forms: duplicate registry, rate limits, scoring, counters, custody checks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from casefile.functions import score as s


def first_by_content(stream: DataFrame, keep: str = "30 days", ts: str = "ts", key: str = "sha256") -> DataFrame:
    """STM1: the first item of each content within the time that hashes are kept; of several that come first in one
    batch, any."""
    return stream.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])


def stage_counters(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """STM5: counts and mean values by window and type; rows later than ``late`` are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


def job_progress(stream: DataFrame) -> DataFrame:
    """STM7: the latest stage and percentage of each item."""
    return stream.groupBy("evidence_id").agg(F.max_by(F.struct("stage", "progress"), F.struct("ts", "id")).alias("latest")).select("evidence_id", "latest.stage", "latest.progress")


Rows = Iterable[tuple[Any, int]]


def accepted_within(times: list[int], rows: Rows, span: int, limit: int) -> tuple[list[int], list[tuple[Any, bool, int]]]:
    """Sliding limit over accepted requests only: what stays in the window, and for each request
    whether it is allowed and how many more are."""
    out = []
    for id_, at in rows:
        times = [t for t in times if t > at - span]
        if allowed := len(times) < limit:
            times.append(at)
        out.append((id_, allowed, max(0, limit - len(times))))
    return times, out


def fixed_window(state: tuple[int, int], rows: Rows, span: int, limit: int) -> tuple[tuple[int, int], list[tuple[Any, bool, int]]]:
    """A window that opens at the first request and closes after ``span``; every request counts."""
    begin, n = state
    out = []
    for id_, at in rows:
        if n == 0 or at >= begin + span:
            begin, n = at, 0
        n += 1
        out.append((id_, n <= limit, max(0, limit - n)))
    return (begin, n), out


LIMITED = "key string, id long, allowed boolean, remaining int"


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _on_rocks(stream: DataFrame) -> None:
    """State variables and timers are kept by RocksDB; a session that names another store gets it for its next queries."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _in_order(parts: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(list(order))


class Limiter(StatefulProcessor):
    """A key's accepted times, or its window's begin and count, in one value, until the watermark has passed what they can matter
    for: a timer then clears them. Each call to the state is a message to the JVM and back, so a key makes three a batch."""

    def __init__(self, fixed: bool, seconds: int, limit: int):
        self.fixed, self.span, self.limit = fixed, seconds * 1_000_000, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("window", "begin long, n long") if self.fixed else handle.getValueState("accepted", "times array<long>")

    def _get(self):
        held = self.held.get()
        if self.fixed:
            return (0, 0) if held is None else tuple(held)
        return [] if held is None else list(held[0])

    def _put(self, state) -> None:
        self.held.update(tuple(state) if self.fixed else (list(state),))

    def _last(self, state) -> int:
        return state[0] if self.fixed else max(state, default=0)

    def _until(self, at: int) -> None:
        self.handle.registerTimer((at + self.span) // 1000 + 1)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Called for each row of a key."""
        state = (initialState["begin"], initialState["n"]) if self.fixed else sorted([*self._get(), initialState["at"]])
        self._put(state)
        self._until(self._last(state))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = sorted((r["micros"], r["id"]) for r in rows)
        fold = fixed_window if self.fixed else accepted_within
        state, out = fold(self._get(), [(id_, at) for at, id_ in new], self.span, self.limit)
        self._put(state)
        self._until(self._last(state))
        name = str(key[0])
        return (Row(key=name, id=id_, allowed=allowed, remaining=more) for id_, allowed, more in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if (self._last(self._get()) + self.span) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def _keyed(requests: DataFrame, by: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return requests.select(F.col(by).cast("string").alias("key"), F.col("id").cast("long").alias("id"), at.alias("ts"), F.unix_micros(at).alias("micros"))


def limited(stream: DataFrame, by: str, seconds: int = 60, limit: int = 100, fixed: bool = False, late: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """STM2 (sliding, accepted requests only) and STM3 (fixed window). Requests of a batch are taken in the order of (ts, id),
    those later than ``late`` are dropped. ``initial`` is where a stream takes up from a table: ``limit_state`` of it."""
    _on_rocks(stream)
    first = None if initial is None else initial.groupBy("key")
    return _keyed(stream, by).withWatermark("ts", late).groupBy("key").transformWithState(Limiter(fixed, seconds, limit), LIMITED, "Append", "EventTime", first)


def _folded(requests: DataFrame, by: str, seconds: int, limit: int, fixed: bool, states: bool) -> DataFrame:
    """A fold over the requests of each key, which come sorted: what it says of each, or what it holds at the end. A task holds a
    batch and one key's state, however many requests a key has."""
    span = seconds * 1_000_000
    fold, first = (fixed_window, (0, 0)) if fixed else (accepted_within, [])
    columns = (["key", "begin", "n"] if fixed else ["key", "at"]) if states else ["key", "id", "allowed", "remaining"]

    def ended(key, held) -> list[tuple]:
        return [(key, *held)] if fixed else [(key, t) for t in held]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, name, held = None, None, first
        for pdf in batches:
            out = []
            for key, rows in pdf.groupby(pdf["key"].fillna("\0"), sort=False):
                if key != last:
                    out += ended(name, held) if states and last is not None else []
                    held = first
                last, name = key, rows["key"].iloc[0]
                held, got = fold(held, list(zip(rows["id"].tolist(), rows["micros"].tolist())), span, limit)
                out += [] if states else [(name, *o) for o in got]
            yield pd.DataFrame(out, columns=columns)
        if states and last is not None:
            yield pd.DataFrame(ended(name, held), columns=columns)

    schema = ("key string, begin long, n long" if fixed else "key string, at long") if states else LIMITED
    return _keyed(requests, by).drop("ts").repartition("key").sortWithinPartitions("key", "micros", "id").mapInPandas(run, schema)


def limited_batch(requests: DataFrame, by: str, seconds: int = 60, limit: int = 100, fixed: bool = False) -> DataFrame:
    """The same over a whole table."""
    return _folded(requests, by, seconds, limit, fixed, False)


def limit_state(requests: DataFrame, by: str, seconds: int = 60, limit: int = 100, fixed: bool = False) -> DataFrame:
    """What the keys of a table hold at its end: the initial state of a stream that goes on from there."""
    return _folded(requests, by, seconds, limit, fixed, True)


class Chains(StatefulProcessor):
    """The output hash of each chain's last entry, cleared ``keep_days`` after it."""

    def __init__(self, keep_days: int):
        self.keep = keep_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "hash string, at long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.sort_values(["ts", "id"]).iloc[-1]
        self._put(row["output_hash"], int(row["ts"].timestamp() * 1000))

    def _put(self, hash_: str, at: int) -> None:
        self.last.update((hash_, at))
        self.handle.registerTimer(at + self.keep + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _in_order(rows, "ts", "id")
        before, known, out = None, self.last.exists(), []
        if known:
            before = self.last.get()[0]
        for id_, found, result in new[["id", "input_hash", "output_hash"]].itertuples(index=False):
            if known and found != before:
                out.append((str(key[0]), id_, before, found))
            before, known = result, True
        self._put(before, int(new["ts"].max().timestamp() * 1000))
        yield pd.DataFrame(out, columns=["evidence_id", "id", "expected", "found"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[1] + self.keep + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _entries(custody: DataFrame) -> DataFrame:
    return custody.select(F.col("evidence_id").cast("string").alias("evidence_id"), F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "input_hash", "output_hash")


def custody_breaks(stream: DataFrame, keep_days: int = 365, late: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """STM6: a row for each entry whose input hash is not the output hash before; the state is one
    hash for each evidence, forgotten ``keep_days`` after its last entry (WIN1 checks whole logs).
    Entries of a batch are taken in the order of (ts, id). ``initial``: entries that came before the stream, of which the
    last of each chain count."""
    _on_rocks(stream)
    first = None
    if initial is not None:
        last = F.max_by(F.struct("id", "ts", "output_hash"), F.struct("ts", "id")).alias("e")
        first = _entries(initial).groupBy("evidence_id").agg(last).select("evidence_id", "e.*").groupBy("evidence_id")
    return _entries(stream).withWatermark("ts", late).groupBy("evidence_id").transformWithStateInPandas(Chains(keep_days), "evidence_id string, id long, expected string, found string", "Append", "EventTime", first)


class Latest(StatefulProcessor):
    """The latest stage of each item; a change takes the item from its old stage's count to the new one's."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "stage string, micros long, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stage, micros, id_ = _in_order(rows, "micros", "id")[["stage", "micros", "id"]].iloc[-1].tolist()
        old, out = (self.latest.get() if self.latest.exists() else None), []
        if old is None or (old[1], old[2]) < (micros, id_):
            self.latest.update((stage, int(micros), int(id_)))
            if old is None or old[0] != stage:
                out = [(stage, 1)] + ([] if old is None else [(old[0], -1)])
        yield pd.DataFrame(out, columns=["stage", "delta"])

    def close(self) -> None:
        pass


def stage_changes(stream: DataFrame) -> DataFrame:
    """STM7: stage and delta, a row for each count that an item's new stage changes. The latest row of (ts, id) counts, in whatever
    batch it comes; the state is one row for each item."""
    _on_rocks(stream)
    rows = stream.select(F.col("evidence_id").cast("string").alias("evidence_id"), "stage", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("id").cast("long").alias("id"))
    return rows.groupBy("evidence_id").transformWithStateInPandas(Latest(), "stage string, delta int", "Update", "None")


def stage_counts(changes: DataFrame) -> DataFrame:
    """STM7: items by their latest stage."""
    return changes.groupBy("stage").agg(F.sum("delta").alias("n")).filter("n <> 0")


def score_arrivals(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, text: str = "text", available_now: bool = True):
    """STM4: pending items scored as they come; each batch goes to ``sink`` (which appends evidence,
    results and custody rows). Scoring has no state. Returns the started query."""
    pending = stream.filter(F.col("status") == "pending") if "status" in stream.columns else stream
    writer = s.with_scores(pending, text).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
