"""Ordered state machines over keyed events: one step function, run over a table or over a stream.

On a table, keys are dealt to tasks and sorted by time; a task walks its rows and
holds the state of one key, never the key's rows.  On a stream, events wait in
state until the watermark has passed them and are then taken in order, so files
and batches may bring them in any order; one timer a key wakes it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: What streams with timers need: the state store that keeps lists and timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Machine:
    """The events of one key in order of (at, id); at is in microseconds.  States are plain values that JSON can hold."""

    #: Columns of an event besides key, at and id, and of what a step gives besides key, at and id.
    inputs: tuple[str, ...] = ()
    outputs: T.StructType = T.StructType()
    #: Microseconds after its last event for which a key's state matters; None: for ever.
    keeps: int | None = None

    def start(self) -> dict:
        raise NotImplementedError

    def step(self, state: dict, at: int, ident: int, event: dict) -> tuple | None:
        """Changes the state; the output of this event, if it has one."""
        raise NotImplementedError

    def alarm(self, state: dict) -> int | None:
        """When the machine wants to be woken, if it does; events at that time come later."""
        return None

    def ring(self, state: dict, at: int) -> tuple | None:
        """The alarm's output, if it has one; it has to change what ``alarm`` returns."""
        return None

    def rung(self, state: dict, until: int | None) -> Iterator[tuple]:
        """Outputs (at, 0, ...) of all alarms up to a time, or of all."""
        while (at := self.alarm(state)) is not None and (until is None or at <= until):
            got = self.ring(state, at)
            if got is not None:
                yield (at, 0, *got)

    def taken(self, state: dict, at: int, ident: int, event: dict) -> Iterator[tuple]:
        """What the alarms before an event give, and the event."""
        yield from self.rung(state, at)
        got = self.step(state, at, ident, event)
        if got is not None:
            yield (at, ident, *got)


def _schema(machine: Machine) -> T.StructType:
    return T.StructType([T.StructField("key", T.StringType()), T.StructField("at", T.LongType()), T.StructField("id", T.LongType()), *machine.outputs.fields])


def run_table(events: DataFrame, machine: Machine) -> DataFrame:
    """(key, at, id, outputs) of a table (key string, at long, id long, inputs); null keys are one key."""
    schema = _schema(machine)
    names = ["key", "at", "id", *machine.inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        state: dict = {}
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
            rows.clear()
            return pa.RecordBatch.from_pydict({f.name: pa.array(v, kind) for f, v, kind in zip(schema.fields, columns, arrow, strict=True)})

        for batch in batches:
            for key, at, ident, *values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held != [key]:
                    rows.extend((held[0], *x) for x in (machine.rung(state, None) if held else ()))
                    held, state = [key], machine.start()
                rows.extend((key, *x) for x in machine.taken(state, at, ident, dict(zip(machine.inputs, values, strict=True))))
            yield made()
        if held:
            rows.extend((held[0], *x) for x in machine.rung(state, None))
            yield made()

    arrow = [pa.string(), pa.int64(), pa.int64(), *[_arrow(f.dataType) for f in machine.outputs.fields]]
    return events.select(*names).repartition("key").sortWithinPartitions("key", "at", "id").mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[kind.typeName()]


class Ordered(StatefulProcessor):
    """Runs a machine on a stream's keys."""

    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle) -> None:
        self.handle = handle
        # the machine's state with the time of its last event, the events that wait, and the timer that is set
        self.state = handle.getValueState("state", "last long, state string")
        self.waiting = handle.getListState("waiting", "at long, id long, event string")
        self.timer = handle.getValueState("timer", "ms long")

    def _wake(self, at: int, only_earlier: bool = False) -> None:
        ms, old = at // 1000 + 1, self.timer.get()[0] if self.timer.exists() else None
        if old is not None:
            if only_earlier and old <= ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r["at"], r["id"], json.dumps({c: r[c] for c in self.machine.inputs})) for r in rows]
        self.waiting.appendList(new)
        self._wake(min(x[0] for x in new), only_earlier=True)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        machine, mark = self.machine, timerValues.getCurrentWatermarkInMs()
        row = Row(*_schema(machine).fieldNames())
        self.timer.clear()
        waiting = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        due = [x for x in waiting if x[0] // 1000 + 1 <= mark]
        later = waiting[len(due) :]
        last, state = self.state.get() if self.state.exists() else (None, None)
        state = json.loads(state) if state else machine.start()
        for at, ident, event in due:
            if last is not None and machine.keeps is not None and at - last > machine.keeps:
                state = machine.start()
            last = at
            for x in machine.taken(state, at, ident, json.loads(event)):
                yield row(key[0], *x)
        # an alarm rings once no event can come before it
        rang = list(machine.rung(state, min([mark * 1000, *[x[0] for x in later[:1]]])))
        for x in rang:
            yield row(key[0], *x)
        if due or rang:
            self.state.update((last, json.dumps(state)))
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        alarm = machine.alarm(state)
        if later or alarm is not None:
            self._wake(min([x[0] for x in later[:1]] + ([alarm] if alarm is not None else [])))
        elif machine.keeps is not None and last is not None:
            if last + machine.keeps < mark * 1000:
                self.state.clear()
            else:
                self._wake(last + machine.keeps)

    def close(self) -> None:
        pass


def run_stream(events: DataFrame, machine: Machine, late: str = "10 minutes") -> DataFrame:
    """The same rows as ``run_table`` gives, from a stream (key, ts timestamp, at, id, inputs); rows later than ``late`` are lost."""
    names = ["key", "ts", "at", "id", *machine.inputs]
    stream = events.select(*names).withWatermark("ts", late)
    return stream.groupBy("key").transformWithState(Ordered(machine), _schema(machine), "append", "EventTime")


def timed(df: DataFrame, key: str, ts: str, ident: str) -> DataFrame:
    """``df`` with the columns key, ts, at and id that machines read."""
    at = F.col(ts).cast("timestamp")
    return df.withColumn("key", F.col(key).cast("string")).withColumn("ts", at).withColumn("at", F.unix_micros(at)).withColumn("id", F.col(ident).cast("long"))
