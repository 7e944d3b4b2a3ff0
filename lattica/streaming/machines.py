"""State machines over event sequences, the same steps in batch and in Structured Streaming.

A machine is a start state and a step from (state, event) to (state, output or nothing). In batch, rows are sorted
within partitions by key and time and folded as they stream by, so no key's events are gathered. In streaming, the state
of each key is kept between micro-batches, and dropped once the watermark has passed its last event by the idle time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

State = dict[str, Any]

SETTLE_DEADLINE_MS = 8000
STABLE_SAMPLES, STABLE_MOVE = 10, 0.01
TRACE_RING = 400


@dataclass(frozen=True)
class Machine:
    """A start state, a step, and the columns that a step puts out besides the event's key and time."""

    start: State
    step: Callable[[State, Any], tuple[State, tuple | None]]
    output: str


def throttle(interval: float = 25.0) -> Machine:
    """Lets an event through if the last one that got through is at least `interval` before it; drops it otherwise."""

    def step(state: State, event) -> tuple[State, tuple | None]:
        last = state["last"]
        if last is None or event.t - last >= interval:
            return {"last": float(event.t)}, (float(event.t),)
        return state, None

    return Machine({"last": None}, step, "emitted double")


def cursor(interval: float = 25.0) -> Machine:
    """throttle, and of what gets through only changes of `value`."""

    def step(state: State, event) -> tuple[State, tuple | None]:
        if state["last"] is not None and event.t - state["last"] < interval:
            return state, None
        now = {"last": float(event.t), "value": event.value}
        return now, (event.value,) if event.value != state["value"] else None

    return Machine({"last": None, "value": None}, step, "value string")


def taps(slop: float = 8.0, longest: float = 500.0, double: float = 300.0) -> Machine:
    """Pointer events (action down, move, up or cancel; x, y, t) to tap, double and drag. Moving by more than slop makes
    a drag; a press beyond `longest` is nothing; a second tap in time and within twice the slop is a double, after which
    counting starts anew."""

    def step(state: State, e) -> tuple[State, tuple | None]:
        down, dragging, last = state["down"], state["dragging"], state["last"]
        if e.action == "down":
            return {"down": [e.x, e.y, e.t], "dragging": False, "last": last}, None
        if e.action == "cancel":
            return {"down": None, "dragging": False, "last": last}, None
        if down is None:
            return state, None
        if e.action == "move":
            far = dragging or (e.x - down[0]) ** 2 + (e.y - down[1]) ** 2 > slop**2
            return {**state, "dragging": far}, ("drag",) if far else None
        lifted = {"down": None, "dragging": False, "last": last}
        if dragging:
            return lifted, ("drag",)
        if e.t - down[2] > longest:
            return lifted, None
        if last and e.t - last[2] <= double and (e.x - last[0]) ** 2 + (e.y - last[1]) ** 2 <= (2 * slop) ** 2:
            return {**lifted, "last": None}, ("double",)
        return {**lifted, "last": [e.x, e.y, e.t]}, ("tap",)

    return Machine({"down": None, "dragging": False, "last": None}, step, "outcome string")


EXITS = ("esc", "outside-pointer", "exit-affordance", "viewport-exit")


def is_full_page(preset: str) -> bool:
    return preset in ("workbench", "atlas")


def overlay(preset: str) -> Machine:
    """Preview or active: a tap activates and is consumed, an exit goes back and is consumed. A full page is always
    active and consumes nothing."""
    full = is_full_page(preset)

    def step(state: State, event) -> tuple[State, tuple | None]:
        now, used = state["state"], False
        if not full and now == "preview" and event.event == "tap":
            now, used = "active", True
        elif not full and now == "active" and event.event in EXITS:
            now, used = "preview", True
        return {"state": now}, (now, used)

    return Machine({"state": "active" if full else "preview"}, step, "state string, consumed boolean")


def settle() -> Machine:
    """Samples (is_sim, moving, elapsed) to (adopt, fire, done): once still, or once at the deadline; fires once."""

    def step(state: State, e) -> tuple[State, tuple | None]:
        adopted = state["adopted"]
        if not e.moving:
            return {"adopted": True}, (bool(e.is_sim), not adopted, True)
        if e.is_sim and not adopted and e.elapsed >= SETTLE_DEADLINE_MS:
            return {"adopted": True}, (True, True, False)
        return state, (False, False, False)

    return Machine({"adopted": False}, step, "adopt boolean, fire boolean, done boolean")


def settle_action(is_sim: Column, moving: Column, adopted: Column, elapsed: Column) -> Column:
    """One settle step as a Column, for rows that carry what was adopted."""
    late = moving & is_sim & ~adopted & (elapsed >= SETTLE_DEADLINE_MS)
    return F.struct(((~moving & is_sim) | late).alias("adopt"), ((~moving & ~adopted) | late).alias("fire"), (~moving).alias("done"))


def tracer() -> Machine:
    """Pairs of begin and end of a phase, with their duration; an end without a begin is dropped."""

    def step(state: State, e) -> tuple[State, tuple | None]:
        open_ = dict(state["open"])
        if e.action == "begin":
            open_[e.phase] = float(e.t)
            return {"open": open_}, None
        start = open_.pop(e.phase, None)
        return {"open": open_}, None if start is None else (e.phase, float(e.t) - start)

    return Machine({"open": {}}, step, "phase string, ms double")


def quiescence() -> Machine:
    """Samples (moved) to (moving): still from the tenth sample in a row that didn't move on; a re-heat starts anew."""

    def step(state: State, e) -> tuple[State, tuple | None]:
        if e.reheat:
            return {"stable": 0, "moving": True}, (True,)
        if not state["moving"]:
            return state, (False,)
        stable = 0 if e.moved else state["stable"] + 1
        return {"stable": stable, "moving": stable < STABLE_SAMPLES}, (stable < STABLE_SAMPLES,)

    return Machine({"stable": 0, "moving": True}, step, "moving boolean")


def _schema(key: str, kind: str, machine: Machine) -> str:
    return f"{key} {kind}, t double, {machine.output}"


def folded(events: DataFrame, key: str, machine: Machine) -> DataFrame:
    """Outputs of a machine over events(key, t, seq, ...), each key's in order of t and seq. One key is one sequence, so
    one task runs it, but never holds more than an Arrow batch of it."""
    kind = events.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), machine.start
        columns = [key, "t", *(c.split()[0] for c in machine.output.split(", "))]
        for frame in frames:
            out = []
            for event in frame.itertuples(index=False):
                name = getattr(event, key)
                if name != current:
                    current, state = name, machine.start
                state, put = machine.step(state, event)
                if put is not None:
                    out.append((name, float(event.t), *put))
            yield pd.DataFrame(out, columns=columns)

    return events.repartition(key).sortWithinPartitions(key, "t", "seq").mapInPandas(run, _schema(key, kind, machine))


def streamed(events: DataFrame, key: str, machine: Machine, idle_ms: int = 600_000) -> DataFrame:
    """folded over a stream with an event-time column ts and a watermark: micro-batches continue each key's state."""
    kind = events.schema[key].dataType.simpleString()
    columns = [key, "t", *(c.split()[0] for c in machine.output.split(", "))]

    def run(name: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        state = json.loads(kept.get[0]) if kept.exists else machine.start
        out, latest = [], 0
        for event in pd.concat(list(frames)).sort_values(["t", "seq"]).itertuples(index=False):
            state, put = machine.step(state, event)
            latest = max(latest, int(pd.Timestamp(event.ts).timestamp() * 1000))
            if put is not None:
                out.append((name[0], float(event.t), *put))
        kept.update((json.dumps(state),))
        kept.setTimeoutTimestamp(max(latest, kept.getCurrentWatermarkMs() + 1) + idle_ms)
        yield pd.DataFrame(out, columns=columns)

    return events.groupBy(key).applyInPandasWithState(run, _schema(key, kind, machine), "state string", "append", GroupStateTimeout.EventTimeTimeout)


def still_runs(samples: DataFrame, key: str) -> DataFrame:
    """samples(key, t, x, y) with moving, by windows: still where the last ten steps all moved by at most 0.01. The
    first sample of a key has nothing to be compared with, and is moving."""
    order = Window.partitionBy(key).orderBy("t")
    moved = F.coalesce((F.abs(F.col("x") - F.lag("x").over(order)) > STABLE_MOVE) | (F.abs(F.col("y") - F.lag("y").over(order)) > STABLE_MOVE), F.lit(True))
    marked = samples.withColumn("moved", moved).withColumn("island", F.sum(F.col("moved").cast("int")).over(order))
    run = F.row_number().over(Window.partitionBy(key, "island").orderBy("t")) - 1
    return marked.withColumn("moving", F.max((run >= STABLE_SAMPLES).cast("int")).over(order) == 0).drop("island")


def latest(rows: DataFrame, key: str, most: int = TRACE_RING) -> DataFrame:
    """Each key's last `most` rows by t."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("t")))).where(F.col("_n") <= most).drop("_n")


def sink_stream(stream: DataFrame, sink, checkpoint: str):
    """Writes a stream of element changes to a keyed sink, a micro-batch at a time."""
    return stream.writeStream.foreachBatch(sink.take_batch).option("checkpointLocation", checkpoint).start()
