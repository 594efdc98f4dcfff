"""Stateful processors for live dialogue.

State is kept per dialogue; events within a micro-batch are put in order of (ts, id).
The gate numbers batches exactly as ``operators.dialogue.gate`` does in batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _columns(events: pd.DataFrame, *names: str) -> Iterator[tuple]:
    """The events' values of some columns, row by row; a column that isn't there is false throughout."""
    return zip(*(events[n].tolist() if n in events else [False] * len(events) for n in names))


class Gate(StatefulProcessor):
    """Numbers the batch of each event; a batch is full at ``least`` words.  A row whose
    ``reset`` is true starts the dialogue anew and gives no output."""

    def __init__(self, key: str, order: str, least: int):
        self.key, self.order, self.least = key, order, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", "words long, batch long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        words, batch = self.state.get() if self.state.exists() else (0, 0)
        events = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        out = []
        for at, text, reset in _columns(events, self.order, "text", "reset"):
            if reset:
                words, batch = 0, 0
                continue
            out.append((key[0], at, batch))
            words += len((text or "").split())
            if words >= self.least:
                words, batch = 0, batch + 1
        self.state.update((int(words), int(batch)))
        yield pd.DataFrame(out, columns=[self.key, self.order, "batch"])

    def close(self) -> None:
        pass


class IdleGate(StatefulProcessor):
    """Emits a dialogue's pending text when it has ``least`` words, or when none came out for ``idle_ms``.

    The clock runs from the last emission, not from the last event; a timer fires without
    new input.  Rows with ``end`` true flush at once.  Output: key, n (events), text, why.
    """

    def __init__(self, key: str, order: str, least: int, idle_ms: int, poll_ms: int = 1000):
        self.key, self.order, self.least, self.idle_ms, self.poll_ms = key, order, least, idle_ms, poll_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "text string")
        self.clock = handle.getValueState("clock", "at long")

    def _emit(self, key, texts: list[str], why: str, now: int) -> pd.DataFrame:
        self.pending.clear()
        self.clock.update((now,))
        return pd.DataFrame([(key[0], len(texts), " ".join(texts), why)], columns=[self.key, "n", "text", "why"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self.clock.exists():
            self.clock.update((now,))
        texts = [t[0] for t in self.pending.get()]
        words = sum(len(t.split()) for t in texts)
        for text, end in _columns(pd.concat(list(rows)).sort_values(self.order, kind="stable"), "text", "end"):
            if text:
                texts.append(text)
                words += len(text.split())
            if texts and (words >= self.least or end):
                yield self._emit(key, texts, "end" if end else "words", now)
                texts, words = [], 0
        if texts:
            self.pending.put([(t,) for t in texts])
            self.handle.registerTimer(now + self.poll_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        texts = [t[0] for t in self.pending.get()]
        if not texts:
            return
        if now - self.clock.get()[0] >= self.idle_ms:
            yield self._emit(key, texts, "idle", now)
        else:
            self.handle.registerTimer(now + self.poll_ms)

    def close(self) -> None:
        pass


class EventIdleGate(StatefulProcessor):
    """As :class:`IdleGate`, but on event time, so that a replay gives the same flushes however its events are split into micro-batches.

    Events wait in the state until the watermark has passed them and are then taken in order of (time, order); rows later
    than the watermark are dropped before they get here.  Pending text is due ``idle_ms`` after the last flush (at first:
    after the dialogue's first event), but not before it has waited ``poll_ms``; it comes out then, before any event of a
    later time, or at the event with which it has ``least`` words, or at one whose ``end`` is true.
    Output: key, at (microseconds), n (events), text, why.
    """

    def __init__(self, key: str, time: str, order: str, least: int, idle_ms: int, poll_ms: int):
        self.key, self.time, self.order, self.least, self.idle, self.poll = key, time, order, least, idle_ms * 1000, poll_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, text string, end boolean")
        self.pending = handle.getListState("pending", "at long, text string")
        self.clock = handle.getValueState("clock", "since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        micros = events[self.time].astype("datetime64[us]").astype("int64")
        new = [(int(a), int(i), text or "", bool(end)) for (a, (i, text, end)) in zip(micros, _columns(events, self.order, "text", "end"))]
        self.waiting.appendList(new)
        self._wake(min(a for a, *_ in new))
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(x) for x in self.waiting.get())
        ready, left = [x for x in waiting if x[0] <= upto], [x for x in waiting if x[0] > upto]
        pending = [tuple(x) for x in self.pending.get()]
        since = self.clock.get()[0] if self.clock.exists() else None
        out = []

        def flush(at: int, why: str) -> None:
            nonlocal since
            out.append((key[0], at, len(pending), " ".join(t for _, t in pending), why))
            since = at
            pending.clear()

        words = sum(len(t.split()) for _, t in pending)
        for at, _, text, end in ready:
            since = at if since is None else since
            if pending and (due := self._due(since, pending)) < at:
                flush(due, "idle")
                words = 0
            if text:
                pending.append((at, text))
                words += len(text.split())
            if pending and (words >= self.least or end):
                flush(at, "end" if end else "words")
                words = 0
        if pending and (due := self._due(since, pending)) <= upto:
            flush(due, "idle")
        for state, rows in ((self.waiting, left), (self.pending, pending)):
            state.put(rows) if rows else state.clear()
        if since is not None:
            self.clock.update((since,))
        moments = [x[0] for x in left[:1]] + ([self._due(since, pending)] if pending else [])
        if moments:
            self._wake(min(moments))
        yield self._frame(out)

    def _due(self, since: int, pending: list[tuple]) -> int:
        return max(since + self.idle, pending[0][0] + self.poll)

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, "at", "n", "text", "why"])

    def close(self) -> None:
        pass


class LineDeltas(StatefulProcessor):
    """New text of each line of a session, and changed previews.

    Input: key, order, line (null for a preview row), text.  Output: key, order, text, committed.
    """

    def __init__(self, key: str, order: str):
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getMapState("lines", "line string", "text string")
        self.preview = handle.getValueState("preview", "text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for at, line, text in _columns(pd.concat(list(rows)).sort_values(self.order, kind="stable"), self.order, "line", "text"):
            text = (text or "").strip()
            if line is None or line != line:
                before = self.preview.get()[0] if self.preview.exists() else ""
                if text and text != before:
                    out.append((key[0], at, text, False))
                self.preview.update((text,))
                continue
            if not text:
                continue
            before = self.lines.getValue((line,))[0] if self.lines.containsKey((line,)) else ""
            if text == before:
                continue
            delta = text[len(before) :].strip() if text.startswith(before) else text
            self.lines.updateValue((line,), (text,))
            if delta:
                out.append((key[0], at, delta, True))
        yield pd.DataFrame(out, columns=[self.key, self.order, "text", "committed"])

    def close(self) -> None:
        pass


class Chunks(StatefulProcessor):
    """Cuts a session's bytes into chunks of ``size``; a row whose ``end`` is true gives out what is left, if ``keep_tail``.

    Input: key, order, blob, end (optional).  Output: key, chunk, blob.  An event that cannot be read is
    given out with ``error`` and changes nothing.
    """

    def __init__(self, key: str, order: str, size: int, keep_tail: bool = True):
        self.key, self.order, self.size, self.keep_tail = key, order, size, keep_tail

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chunks", "rest binary, chunk long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rest, chunk = self.state.get() if self.state.exists() else (b"", 0)
        rest, at, out = bytearray(rest), 0, []  # what lies before ``at`` has been given out
        for blob, ended in _columns(pd.concat(list(rows)).sort_values(self.order, kind="stable"), "blob", "end"):
            try:
                rest += bytes(blob)
            except TypeError as problem:
                out.append((key[0], None, None, str(problem)))
                continue
            while len(rest) - at >= self.size or (ended and at < len(rest)):
                piece = bytes(rest[at : at + self.size])
                at += len(piece)
                if len(piece) == self.size or self.keep_tail:
                    out.append((key[0], chunk, piece, None))
                    chunk += 1
        self.state.update((bytes(rest[at:]), int(chunk)))
        yield pd.DataFrame(out, columns=[self.key, "chunk", "blob", "error"]).astype({"chunk": "Int64"})

    def close(self) -> None:
        pass


class Pending(StatefulProcessor):
    """The requests of a session that wait for an answer, at most ``most`` of them: a new one beyond that drops the oldest.

    Input: key, order, request, done (false: it comes in, true: it has been answered, in whatever order).
    Output: key, order, request, why (``done``, or ``shed`` as a warning), waiting (how many are left).
    Answers to requests that were dropped or never came in are passed over; the queue lives in the state,
    so that its bounds hold over micro-batches and restarts.
    """

    def __init__(self, key: str, order: str, request: str, most: int):
        if most < 1:
            raise ValueError("at least one request may wait")
        self.key, self.order, self.request, self.most = key, order, request, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getListState("queue", "request long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        queue = dict.fromkeys(int(r[0]) for r in self.queue.get())  # in the order of their arrival
        out = []
        for at, request, done in _columns(pd.concat(list(rows)).sort_values(self.order, kind="stable"), self.order, self.request, "done"):
            if request is None or request != request:
                continue
            request = int(request)
            if done and request in queue:
                del queue[request]
                out.append((key[0], at, request, "done", len(queue)))
            elif not done:
                queue.setdefault(request)
                if len(queue) > self.most:
                    oldest = next(iter(queue))
                    del queue[oldest]
                    out.append((key[0], at, oldest, "shed", len(queue)))
        self.queue.put([(r,) for r in queue]) if queue else self.queue.clear()
        yield pd.DataFrame(out, columns=[self.key, self.order, self.request, "why", "waiting"])

    def close(self) -> None:
        pass


def _kind(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def gate_stream(df: DataFrame, key: str, order: str, least: int = 15) -> DataFrame:
    schema = f"`{key}` {_kind(df, key)}, `{order}` {_kind(df, order)}, batch long"
    return df.groupBy(key).transformWithStateInPandas(Gate(key, order, least), outputStructType=schema, outputMode="append", timeMode="none")


def idle_gate_stream(df: DataFrame, key: str, order: str, least: int = 15, idle_ms: int = 10_000) -> DataFrame:
    schema = f"`{key}` {_kind(df, key)}, n long, text string, why string"
    return df.groupBy(key).transformWithStateInPandas(IdleGate(key, order, least, idle_ms), outputStructType=schema, outputMode="append", timeMode="ProcessingTime")


def event_idle_gate_stream(df: DataFrame, key: str, time: str, order: str, least: int = 15, idle_ms: int = 10_000, poll_ms: int = 1000, delay: str = "10 seconds") -> DataFrame:
    """``time`` is a timestamp, ``order`` a number that parts events of one time; ``delay`` is how much later than others a row may come."""
    schema = f"`{key}` {_kind(df, key)}, at long, n long, text string, why string"
    gate = EventIdleGate(key, time, order, least, idle_ms, poll_ms)
    return df.withWatermark(time, delay).groupBy(key).transformWithStateInPandas(gate, outputStructType=schema, outputMode="append", timeMode="EventTime")


def line_delta_stream(df: DataFrame, key: str, order: str) -> DataFrame:
    schema = f"`{key}` {_kind(df, key)}, `{order}` {_kind(df, order)}, text string, committed boolean"
    return df.groupBy(key).transformWithStateInPandas(LineDeltas(key, order), outputStructType=schema, outputMode="append", timeMode="none")


def chunk_stream(df: DataFrame, key: str, order: str, size: int, keep_tail: bool = True) -> DataFrame:
    schema = f"`{key}` {_kind(df, key)}, chunk long, blob binary, error string"
    return df.groupBy(key).transformWithStateInPandas(Chunks(key, order, size, keep_tail), outputStructType=schema, outputMode="append", timeMode="none")


def pending_stream(df: DataFrame, key: str, order: str, request: str, most: int = 20) -> DataFrame:
    """``request`` is a whole number; see :class:`Pending`."""
    schema = f"`{key}` {_kind(df, key)}, `{order}` {_kind(df, order)}, `{request}` long, why string, waiting long"
    return df.groupBy(key).transformWithStateInPandas(Pending(key, order, request, most), outputStructType=schema, outputMode="append", timeMode="none")
