"""Live forms of path detection and trace windows over a stream of frames.

Frames carry an event time and may arrive late, up to ``delay``. Sessions are
dealt into groups by a hash, and a group is what the stream keeps state for, so
a micro-batch costs a call per group instead of one per session. The frames of a
group wait in a list state, packed as Arrow tables, until the watermark has
passed them; a timer then hands them on by session in frame order, in a run
bounded by what arrives within the delay and one micro-batch. What the run leads
to is a few numbers for paths, and two monotonic queues of at most ``size``
entries for windows, so the state of a session doesn't grow with its length.
A session that has had no frame for ``idle`` is forgotten, at a time of the same
timer. The number of groups must stay the same over restarts; a group should
hold as many sessions as a task can hold the waiting frames of.

Frames behind the watermark, and frames at or before the last one handed on,
are dropped; of repeated frames the first counts. A row without a frame number
is a heartbeat: it only moves the time on, which lets the last frames of a
recording out. One session is one recording, so its rate is that of its camera.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from burrow.operators.paths import matches

PATHS = "session_id {key}, path_id bigint, start_frame bigint, end_frame bigint"
WINDOW = "session_id {key}, frame_number bigint, value double, y_low double, y_high double"

#: Lists and timers of a group are kept by this state store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOREVER = 1 << 62
#: Stands for a missing frame number or time.
NONE = -(1 << 63)
#: Groups that sessions are dealt into, and rows of one packed table.
GROUPS, PACKED_ROWS = 256, 200_000


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


class InOrder(StatefulProcessor):
    """Hands the frames of a group's sessions on in order, once their time has passed.

    A subclass says in ``follow`` what a run of ordered frames of a session
    gives, and how that changes what is kept of the session (``kept``, at first
    ``first``). ``columns`` are what it reads of a frame.
    """

    columns: list[str]
    kept: list[tuple[str, pa.DataType]]
    first: tuple
    output: list[str]

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        #: Last frame handed on, greatest event time and what is kept, by session.
        self.sessions = handle.getValueState("sessions", "rows binary")
        #: Next time a frame is due or a session is idle.
        self.due = handle.getValueState("due", "at bigint")
        clock = [("session", pa.string()), ("last", pa.int64()), ("latest", pa.int64())]
        self.schema = pa.schema([*clock, *self.kept])

    def _due(self) -> int:
        found = self.due.get()
        return found[0] if found is not None else FOREVER

    def _known(self) -> pa.Table:
        found = self.sessions.get()
        return _unpacked(found[0]) if found is not None else self.schema.empty_table()

    def _tables(self, table: pa.Table) -> list[tuple[bytes]]:
        return [(_packed(table.slice(k, PACKED_ROWS)),) for k in range(0, table.num_rows, PACKED_ROWS)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        names = pd.Index(known["session"].to_pylist(), dtype=object)
        last = np.append(known["last"].to_numpy(), NONE)  # behind the last one for sessions not known
        due = before = self._due()
        for batch in rows:
            batch = batch[(batch["frame"] != NONE) & (batch["at"] != NONE)]
            batch = batch[batch["frame"].to_numpy() > last[names.get_indexer(batch["session"])]]
            if batch.empty:
                continue
            self.waiting.appendList(self._tables(pa.Table.from_pandas(batch[["session", "frame", "at", *self.columns]], preserve_index=False).replace_schema_metadata()))
            due = min(due, int(batch["at"].min()))
        if due < before:
            self.handle.registerTimer(due)
            self.due.update((due,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        if self._due() > passed:
            return
        states = {name: entry for name, *entry in zip(*self._known().to_pydict().values(), strict=True)}
        tables = [_unpacked(row[0]) for row in self.waiting.get()]
        out, left = {c: [] for c in self.output}, None
        if tables:
            rows = pa.concat_tables(tables)
            ready = rows["at"].to_numpy() <= passed
            self._hand_on(rows.filter(pa.array(ready)), states, out)
            left = rows.filter(pa.array(~ready))
        due, still = FOREVER, set()
        if left:
            self.waiting.put(self._tables(left))
            due, still = int(left["at"].to_numpy().min()), set(left["session"].unique().to_pylist())
        elif tables:
            self.waiting.clear()
        if self.idle_ms is not None:
            over = {name: entry[1] + self.idle_ms for name, entry in states.items() if name not in still}
            states = {name: entry for name, entry in states.items() if over.get(name, FOREVER) > passed}
            due = min([due, *(at for at in over.values() if at > passed)])
        if states:
            entries = zip(*((name, *entry) for name, entry in states.items()), strict=True)
            self.sessions.update((_packed(pa.table([pa.array(x, f.type) for x, f in zip(entries, self.schema, strict=True)], self.schema)),))
        else:
            self.sessions.clear()
        if due < FOREVER:
            self.handle.registerTimer(due)
            self.due.update((due,))
        else:
            self.due.clear()
        if out["session_id"]:
            yield pd.DataFrame(out)

    def _hand_on(self, rows: pa.Table, states: dict[str, list], out: dict[str, list]) -> None:
        """Each session's rows in the order of frames; of repeated frames the first counts."""
        if not rows.num_rows:
            return
        session = rows["session"].combine_chunks().dictionary_encode()
        frame, at, code = rows["frame"].to_numpy(), rows["at"].to_numpy(), session.indices.to_numpy()
        order = np.lexsort((at, frame, code))
        frame, at, code = frame[order], at[order], code[order]
        columns = [rows[c].to_numpy()[order] for c in self.columns]
        anew = np.append(True, code[1:] != code[:-1])
        repeated = ~anew & np.append(False, frame[1:] == frame[:-1])
        names, starts = session.dictionary.to_pylist(), np.flatnonzero(anew)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(code)], strict=True):
            name = names[code[a]]
            last, latest, *kept = states.get(name) or [-FOREVER, -FOREVER, *self.first]
            fresh = np.flatnonzero(~repeated[a:b] & (frame[a:b] > last)) + a
            latest = max(latest, int(at[a:b].max()))
            if len(fresh):
                last = int(frame[fresh[-1]])
                kept = self.follow(name, kept, frame[fresh].tolist(), [c[fresh].tolist() for c in columns], out)
            states[name] = [last, latest, *kept]

    def follow(self, session: str, kept: Sequence, frames: list[int], columns: list[list], out: dict[str, list]) -> Sequence:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Paths(InOrder):
    """One open start, or none: the machine of the batch operator."""

    columns = ["s", "e"]
    kept = [("opened", pa.int64()), ("paths", pa.int64())]
    first = (-1, 0)
    output = ["session_id", "path_id", "start_frame", "end_frame"]

    def follow(self, session, kept, frames, columns, out):
        opened, count = kept
        for frame, start, end in zip(frames, *columns, strict=True):
            if opened < 0:
                opened = frame if start else -1
            elif end:
                for column, value in zip(out.values(), (session, count, opened, frame), strict=True):
                    column.append(value)
                opened, count = -1, count + 1
        return opened, count


class Range(InOrder):
    """Least and greatest value of the last ``size`` frames.

    Each queue holds the values that can still become the extreme of a window,
    with the number of their frame, so a frame costs constant time on average.
    """

    columns = ["value"]
    kept = [
        ("frames", pa.int64()), ("low_nth", pa.list_(pa.int64())), ("low", pa.list_(pa.float64())),
        ("high_nth", pa.list_(pa.int64())), ("high", pa.list_(pa.float64())),
    ]
    first = (0, (), (), (), ())
    output = ["session_id", "frame_number", "value", "y_low", "y_high"]

    def __init__(self, idle_ms: int | None, size: int, margin: float):
        super().__init__(idle_ms)
        self.size, self.margin = size, margin

    def follow(self, session, kept, frames, columns, out):
        n, *queues = kept
        queues = [(deque(zip(*queues[k : k + 2], strict=True)), sign) for k, sign in ((0, 1), (2, -1))]
        ends = np.full((2, len(frames)), np.nan)
        for k, value in enumerate(columns[0]):
            for side, (queue, sign) in enumerate(queues):
                while queue and queue[0][0] <= n - self.size:
                    queue.popleft()
                if value == value:
                    while queue and sign * queue[-1][1] >= sign * value:
                        queue.pop()
                    queue.append((n, value))
                if queue:
                    ends[side, k] = queue[0][1]
            n += 1
        low, high = ends
        pad = np.where(low != high, (high - low) * self.margin, 1.0)
        found = ([session] * len(frames), frames, columns[0], (low - pad).tolist(), (high + pad).tolist())
        for column, values in zip(out.values(), found, strict=True):
            column += values
        return n, *([entry[k] for entry in queue] for queue, _ in queues for k in (0, 1))


def _milliseconds(span: str | None) -> int | None:
    return None if span is None else int(pd.Timedelta(span).total_seconds() * 1000)


def _followed(rows: DataFrame, time: str, processor: InOrder, output: str, groups: int) -> DataFrame:
    """``rows`` has session_id, frame_number, the time and the processor's columns."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    session, key = F.col("session_id"), dict(rows.dtypes)["session_id"]
    # Nothing is null on its way, so that no whole number becomes a floating-point one.
    text = F.hex(session) if key == "binary" else session.cast("string")
    grouped = rows.withColumns(
        {
            "_group": F.pmod(F.xxhash64("session_id"), F.lit(groups)),
            "session": F.coalesce(F.concat(F.lit("="), text), F.lit("")),
            "frame": F.coalesce(F.col("frame_number").cast("bigint"), F.lit(NONE)),
            "at": F.coalesce(F.unix_millis(F.col(time)), F.lit(NONE)),
        }
    ).drop("session_id", "frame_number")
    followed = grouped.groupBy("_group").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output.format(key="string"), outputMode="append", timeMode="EventTime"
    )
    text = F.when(F.col("session_id") != "", F.substring("session_id", 2, 1 << 30))
    return followed.withColumn("session_id", F.unhex(text) if key == "binary" else text.cast(key))


def live_transitions(
    frames: DataFrame, start_column: str, start_value, end_column: str, end_value,
    time: str = "ts", delay: str = "10 seconds", idle: str | None = None, groups: int = GROUPS,
) -> DataFrame:
    """Start→end paths as their ends pass; the same paths as the batch operator.

    With ``idle`` a session without frames for that long is over: a later frame
    of it begins a new one, whose paths are numbered from 0.
    """
    # The time is read by the filter, so that heartbeats reach the watermark.
    beat = F.col("frame_number").isNull() & F.col(time).isNotNull()
    events = (
        frames.withWatermark(time, delay)
        .select(
            "session_id", "frame_number", time, matches(start_column, start_value).alias("s"), matches(end_column, end_value).alias("e")
        )
        .where(F.col("s") | F.col("e") | beat)
    )
    return _followed(events, time, Paths(_milliseconds(idle)), PATHS, groups)


def live_window(
    frames: DataFrame, column: str, size: int = 150, margin: float = 0.1,
    time: str = "ts", delay: str = "10 seconds", idle: str | None = None, groups: int = GROUPS,
) -> DataFrame:
    """Value and vertical range of the last ``size`` frames at every frame."""
    rows = frames.withWatermark(time, delay).select("session_id", "frame_number", time, F.col(column).cast("double").alias("value"))
    return _followed(rows, time, Range(_milliseconds(idle), size, margin), WINDOW, groups)
