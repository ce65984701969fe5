"""The time rules as streams: keyed state in ``transformWithState``.

Each rule is a state schema, an output schema and a step from (state, row) to (state, output
or None). Rows of a key are stepped in the order of ``order``; a micro-batch is
bounded by the source's rate limit (``maxFilesPerTrigger`` and the like).

With a ``delay`` rows may arrive in any order. They wait in keyed state until the stream's watermark, ``delay`` behind the newest
``order[0]`` of any key, has passed them, and are then stepped in order, so results do not depend on how rows fall into
batches. Rows the watermark had passed when they came are not stepped but come out with ``late`` set and the rule's
columns NULL, replays of stepped rows among them. The newest rows, within the delay, wait for more rows of any key.

Without a ``delay`` each key's rows must arrive in order over batches and are stepped at once. A row older than its key's newest
of an earlier batch ends the query with an error, since the rule has already gone past it; the newest row once more changes nothing.

The batch forms in ``operators.temporal`` give the same rows, but for late ones and for keys that were forgotten: see ``apply``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import temporal as B

#: A delay is cut into so many slots of waiting rows, and a slot is stored in parts of so many rows.
SLOTS, PART_ROWS = 64, 1024

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Rule:
    """``step(state, row) -> (state, output)``; state and output are tuples, None for "nothing"."""

    state: str
    output: str
    step: Callable[[tuple | None, Row], tuple[tuple | None, tuple | None]]
    order: Sequence[str] = ("at_us", "event_id")
    tick_us: int = 1  # microseconds of the watermark's clock in a step of ``order[0]``


class _Stepper(StatefulProcessor):
    def __init__(self, rule: Rule, columns: Sequence[str]):
        self.rule, self.columns = rule, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        order = ", ".join(f"_o{i} BIGINT" for i, _ in enumerate(self.rule.order))
        self.last = handle.getValueState("last", order)
        self.kept = handle.getValueState("kept", self.rule.state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        place = lambda row: tuple(row[c] for c in self.rule.order)
        last = tuple(self.last.get()) if self.last.exists() else None
        state = tuple(self.kept.get()) if self.kept.exists() else None
        for row in sorted(rows, key=place):
            if last is not None and place(row) < last:
                told = f"{dict(zip(self.rule.order, place(row)))} of {tuple(key)} came after {last}"
                raise ValueError(f"rows out of order: {told}; give apply() a delay")
            if place(row) == last:
                continue
            last = place(row)
            state, out = self.rule.step(state, row)
            if out is not None:
                yield Row(**dict(zip(self.columns, (*key, *last, *out), strict=True)))
        if last is not None:
            self.last.update(last)
        if state is None:
            self.kept.clear()
        else:
            self.kept.update(state)

    def close(self) -> None:
        pass


class _Sorter(StatefulProcessor):
    """Rows wait until the watermark has passed them.

    Waiting rows lie in slots of ``slot_ms`` of the clock, each in parts of at most ``PART_ROWS`` rows. A timer opens the slots that are
    due, one after the other, so a task holds one slot of one key, however many rows the key has waiting.
    """

    def __init__(self, rule: Rule, columns: Sequence[str], row: T.StructType, slot_ms: int, forget_ms: int | None):
        self.rule, self.columns, self.row = rule, columns, row
        self.slot_ms, self.forget_ms = slot_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.rule.state)
        self.slots = handle.getMapState("slots", "slot BIGINT", "parts INT, first BIGINT")
        rows = T.StructType([T.StructField("rows", T.ArrayType(self.row))])
        self.waiting = handle.getMapState("waiting", "slot BIGINT, part INT", rows)
        self.last = handle.getValueState("last", "stepped BIGINT, timer BIGINT")

    def place(self, row: Row) -> tuple:
        return tuple(row[c] for c in self.rule.order)

    def passed_ms(self, row: Row) -> int:
        """The first watermark that is past the row."""
        return row[self.rule.order[0]] * self.rule.tick_us // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, buffers, held = timerValues.getCurrentWatermarkInMs(), {}, 0
        for row in rows:
            at = self.passed_ms(row)
            if at <= now:
                yield self.out(key, self.place(row), None, True)
                continue
            buffers.setdefault(at // self.slot_ms, []).append(row)
            held += 1
            if held == PART_ROWS:
                self.put(buffers)
                buffers, held = {}, 0
        self.put(buffers)

    def put(self, buffers: dict[int, list[Row]]) -> None:
        """Append rows to their slots, with a timer at each slot's oldest row."""
        for slot, rows in buffers.items():
            parts, first = tuple(self.slots.getValue((slot,))) if self.slots.containsKey((slot,)) else (0, None)
            self.waiting.updateValue((slot, parts), ([tuple(r[c] for c in self.row.names) for r in rows],))
            oldest = min(self.passed_ms(r) for r in rows)
            if first is None or oldest < first:
                self.handle.registerTimer(oldest)
                first = oldest
            self.slots.updateValue((slot,), (parts + 1, first))

    def taken(self, slot: int, parts: int, now: int) -> list[tuple[tuple, Row]]:
        """The slot's rows the watermark has passed, in order and each place once; the rest waits on."""
        ready, rest = {}, []
        for part in range(parts):
            for values in self.waiting.getValue((slot, part))[0]:
                row = Row(*self.row.names)(*values)
                if self.passed_ms(row) <= now:
                    ready[self.place(row)] = row
                else:
                    rest.append(row)
            self.waiting.removeKey((slot, part))
        self.slots.removeKey((slot,))
        for at in range(0, len(rest), PART_ROWS):
            self.put({slot: rest[at : at + PART_ROWS]})
        return sorted(ready.items(), key=lambda x: x[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted((slot[0], info[0]) for slot, info in self.slots.iterator() if info[1] <= now)
        state = tuple(self.kept.get()) if self.kept.exists() else None
        stepped, timer = tuple(self.last.get()) if self.last.exists() else (None, None)
        for slot, parts in due:
            for place, row in self.taken(slot, parts, now):
                at = self.passed_ms(row)
                if self.forget_ms is not None and stepped is not None and at - stepped >= self.forget_ms:
                    state = None
                state, out = self.rule.step(state, row)
                stepped = at
                if out is not None:
                    yield self.out(key, place, out, False)
        if self.forget_ms is not None and stepped is not None:
            fired = expiredTimerInfo.getExpiryTimeInMs()
            if stepped + self.forget_ms <= now:
                self.kept.clear()
                self.last.clear()
                return
            if timer is None or timer <= fired:
                timer = stepped + self.forget_ms
                self.handle.registerTimer(timer)
            self.last.update((stepped, timer))
        if state is None:
            self.kept.clear()
        else:
            self.kept.update(state)

    def out(self, key: tuple, place: tuple, out: tuple | None, late: bool) -> Row:
        rule = out or (None,) * (len(self.columns) - len(key) - len(place) - 1)
        return Row(**dict(zip(self.columns, (*key, *place, *rule, late), strict=True)))

    def close(self) -> None:
        pass


def _millis(spark: SparkSession, interval: str) -> int:
    end = F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL '{interval}'"))
    return spark.range(1).select(end).first()[0]


def apply(
    stream: DataFrame, keys: Sequence[str], rule: Rule, delay: str | None = None, forget: str | None = None
) -> DataFrame:
    """``rule`` on a streaming DataFrame: (keys, order, the rule's output columns, and with a ``delay`` ``late``).

    ``delay`` is an interval like "2 minutes", on the clock of ``order[0]``; for rounds a second is a round. With ``forget``, an interval of
    the same clock, a key without a row for that long starts anew at its next row, and its state is removed once the watermark is past
    that time: the state holds keys of the last ``forget``, not all that ever were. Without it a key is kept for ever.
    """
    if forget is not None and delay is None:
        raise ValueError("forget needs a delay: without a watermark no time passes")
    fields = [stream.schema[c] for c in keys] + [T.StructField(c, T.LongType()) for c in rule.order]
    output = T.StructType([*fields, *T.StructType.fromDDL(rule.output).fields])
    if delay is None:
        return stream.groupBy(*keys).transformWithState(
            statefulProcessor=_Stepper(rule, output.names), outputStructType=output, outputMode="Append", timeMode="None"
        )
    output = output.add("late", T.BooleanType())
    row = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema])
    at = F.timestamp_micros(F.col(rule.order[0]) * rule.tick_us)
    # The engine drops rows whose event time has passed without a word, so the event time is not among the columns it sees.
    timed = stream.withColumn("__event_time", at).withWatermark("__event_time", delay)
    spark = stream.sparkSession
    slot_ms = max(_millis(spark, delay) // SLOTS, 1)
    sorter = _Sorter(rule, output.names, row, slot_ms, None if forget is None else max(_millis(spark, forget), 1))
    return timed.select(*stream.columns).groupBy(*keys).transformWithState(
        statefulProcessor=sorter, outputStructType=output, outputMode="Append", timeMode="EventTime"
    )


def configure(spark: SparkSession) -> SparkSession:
    """Keyed state needs the RocksDB store: state lives on disk and in the checkpoint, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


def dwell(column: str, value: str, length: int, order: Sequence[str] = ("at_us", "event_id")) -> Rule:
    """``column = value`` without a break for ``length`` of the clock ``order[0]``."""

    def step(state, row):
        if row[column] != value:
            return None, None
        since = state[0] if state else row[order[0]]
        return (since,), (since, row[order[0]] - since >= length)

    return Rule("since BIGINT", "since BIGINT, fired BOOLEAN", step, order, 1_000_000 if order[0] == "round" else 1)


def continuous_dwell(dwell_s: int = B.GONE_DWELL_S) -> Rule:
    return dwell("verdict", "gone", dwell_s * B.MICROS)


def stable_verdict(dwell_rounds: int) -> Rule:
    return dwell("verdict", "SAFE", dwell_rounds, ("round",))


def stuck_member(dwell_s: int = B.STUCK_DWELL_S) -> Rule:
    def step(state, row):
        since, sig = state or (None, "")
        if row.state == "ONLINE":
            return None, None
        if row.state not in ("ERROR", "RECOVERING"):
            return (None, sig), None
        if row.state == "RECOVERING" and row.signature != sig:
            since, sig = row.at_us, row.signature
        since = row.at_us if since is None else since
        return (since, sig), (row.state, since, row.at_us - since >= dwell_s * B.MICROS)

    return Rule("since BIGINT, sig STRING", "state STRING, since BIGINT, fired BOOLEAN", step)


def failure_streak(alert_at: int = B.STREAK_ALERT) -> Rule:
    def step(state, row):
        n = state[0] if state else 0
        n = {"start": n + 1, "ready": 0, "planned_stop": max(n - 1, 0)}.get(row.event, n)
        return (n,), (row.event, n, row.event == "start" and n >= alert_at)

    return Rule("n BIGINT", "event STRING, streak BIGINT, alert BOOLEAN", step)


def heal_admission(cap: int = B.HEAL_CAP, base_s: int = B.HEAL_BASE_S, reset_s: int = B.LEDGER_RESET_S) -> Rule:
    """Verdict on every trigger, counting only the attempts that were let through.

    The batch ``heal_budget`` audits attempts that did happen; what would have been let
    through depends on each earlier verdict and so needs state.
    """

    def step(state, row):
        attempts, last, online = state or (0, 0, None)
        online = (row.at_us if online is None else online) if row.state == "ONLINE" else None
        if online is not None and row.at_us - online >= reset_s * B.MICROS:
            attempts, last = 0, 0
        out = None
        if row.attempt:
            now = row.at_us // B.MICROS
            gap = base_s << min(attempts - 1, B.BACKOFF_SHIFT_MAX) if attempts else 0
            verdict = "CAP" if attempts >= cap else "BACKOFF" if now < last + gap else "GO"
            out = (attempts, verdict)
            if verdict == "GO":
                attempts, last = attempts + 1, now
        return (attempts, last, online), out

    return Rule("attempts BIGINT, last BIGINT, online BIGINT", "attempts_before BIGINT, verdict STRING", step)


def edge_alert(backends: bool = False) -> Rule:
    """With ``backends`` polls have such a column, and an alert names those of its poll."""

    def step(state, row):
        if row.primary_up is None:
            return state, None
        raised = not row.primary_up and not (state and state[0])
        alert = (True, row.backends) if backends else (True,)
        return (not row.primary_up,), (alert if raised else None)

    return Rule("down BOOLEAN", "alert BOOLEAN" + (", backends ARRAY<STRING>" if backends else ""), step)


def fall_rise(fall: int = B.FALL, rise: int = B.RISE) -> Rule:
    def step(state, row):
        passed, streak, up = state or (None, 0, None)
        streak = streak + 1 if passed == row.passed else 1
        if streak >= (rise if row.passed else fall):
            up = row.passed
        return (row.passed, streak, up), (row.passed, up)

    return Rule("passed BOOLEAN, streak BIGINT, up BOOLEAN", "passed BOOLEAN, up BOOLEAN", step)


def incident_dedupe(healthy_s: int = B.HEALTHY_RUN_S) -> Rule:
    def step(state, row):
        alert = state is None or row.end_us - row.start_us >= healthy_s * B.MICROS
        return (True,), ((True,) if alert else None)

    return Rule("seen BOOLEAN", "alert BOOLEAN", step, ("start_us", "event_id"))


def transitions(column: str) -> Rule:
    def step(state, row):
        changed = state is None or state[0] != row[column]
        return (row[column],), ((row[column],) if changed else None)

    return Rule("value STRING", f"{column} STRING", step)
