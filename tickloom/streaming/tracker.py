"""Keyed tracking of in-flight items: sessions with lanes, grouped by keys in several key spaces.

A tracker reads operations (tracker, seq, op, space, key, to_space, to_key, id, name, lane, value,
status, count, time) in the order of `seq` and gives rows (tracker, what, id, name, lane, begin,
end, status, value, other): owners as they end, stage visits, events, attributes, relations and
diagnostics. `process` runs trackers in batch, `stream` with state between micro-batches; a
tracker is one sequence by definition, so it is the unit of distribution.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OP_SCHEMA = (
    "tracker string, seq long, op string, space string, key long, to_space string, to_key long, id long, parent long, name string, lane string, value string, "
    "status int, count int, time long"
)
OUT_SCHEMA = "tracker string, what string, id long, name string, lane string, begin long, end long, status int, value string, other long"
_OUT = [c.split()[0] for c in OUT_SCHEMA.split(", ")]

# Texts of the diagnostics, and the status of aborted owners.
REPLACED = "open on a key that still names an item; that item is aborted"
EVICTED = "bind to a key that still names another item; that item is aborted"
FEWER = "bind_oldest found fewer items than requested"
NOTHING = "{} on a key that names no item"
ABORTED = 3


class Tracker:
    """State of one tracker: live items by id, and the ids that each key of a space names."""

    def __init__(self, name: str, saved: str | None = None):
        self.name = name
        data = json.loads(saved) if saved else {}
        #: id -> {parent, begin, lanes: {lane: [stage, begin]}, attributes: {name: value}, names: {space: key}}
        self.items: dict[int, dict] = {int(k): v for k, v in data.get("items", {}).items()}
        self.keys: dict[tuple[str, int], list[int]] = {}
        for i in sorted(self.items):
            for space, key in self.items[i]["names"].items():
                self.keys.setdefault((space, key), []).append(i)
        self.diagnostics: dict[str, list] = data.get("diagnostics", {})
        self.rows: list[dict] = []

    def saved(self) -> str:
        return json.dumps({"items": self.items, "diagnostics": self.diagnostics})

    # -- small parts --

    def emit(self, what: str, **values) -> None:
        self.rows.append({"tracker": self.name, "what": what, **values})

    def complain(self, reason: str, space: str | None, key: int | None) -> None:
        entry = self.diagnostics.setdefault(reason, [0, f"{space} {key}"])
        entry[0] += 1
        self.emit("diagnostic", value=reason, name=f"{space} {key}")

    def named(self, op: str, space: str, key: int) -> list[int]:
        """Ids that a key names, oldest first; none is a diagnostic."""
        ids = self.keys.get((space, key), [])
        if not ids:
            self.complain(NOTHING.format(op), space, key)
        return list(ids)

    def forget(self, i: int, space: str) -> None:
        key = self.items[i]["names"].pop(space, None)
        if key is not None:
            ids = self.keys[space, key]
            ids.remove(i)
            if not ids:
                del self.keys[space, key]

    def give(self, i: int, space: str, key: int) -> None:
        """Name an item in a space; it has one key in each."""
        if self.items[i]["names"].get(space) == key:
            return
        self.forget(i, space)
        self.items[i]["names"][space] = key
        self.keys[space, key] = sorted([*self.keys.get((space, key), []), i])

    def publish(self, i: int) -> None:
        for name, value in self.items[i]["attributes"].items():
            self.emit("attribute", id=i, name=name, value=value)
        self.items[i]["attributes"] = {}

    def finish(self, ids: list[int], status: int, time: int) -> None:
        """End items: attributes are written, open visits end with their owner."""
        for i in ids:
            self.publish(i)
            item = self.items[i]
            end = max(time, item["begin"])
            for lane, (stage, begin) in item["lanes"].items():
                self.emit("stage", id=i, name=stage, lane=lane, begin=begin, end=max(end, begin))
            self.emit("owner", id=i, begin=item["begin"], end=end, status=status, other=item["parent"])
            for space in list(item["names"]):
                self.forget(i, space)
            del self.items[i]

    def enter(self, i: int, lane: str, stage: str, time: int) -> None:
        """Enter a stage: the one that the lane is in goes on, another ends, '' leaves the lane."""
        lanes = self.items[i]["lanes"]
        now = lanes.get(lane)
        if now and now[0] == stage and stage:
            return
        if now:
            self.emit("stage", id=i, name=now[0], lane=lane, begin=now[1], end=max(time, now[1]))
            del lanes[lane]
        if stage:
            lanes[lane] = [stage, time]

    def evict(self, space: str, key: int, keep: list[int], time: int) -> None:
        out = [i for i in self.keys.get((space, key), []) if i not in keep]
        if out:
            self.complain(EVICTED, space, key)
            self.finish(out, ABORTED, time)

    # -- operations --

    def apply(self, o: dict) -> None:
        getattr(self, f"op_{o['op']}")(o)

    def op_open(self, o):
        before = self.keys.get((o["space"], o["key"]))
        if before:
            self.complain(REPLACED, o["space"], o["key"])
            self.finish(list(before), ABORTED, o["time"])
        self.items[o["id"]] = {"parent": o["parent"], "begin": o["time"], "lanes": {}, "attributes": {}, "names": {}}
        self.enter(o["id"], "", o["name"] or "", o["time"])
        self.give(o["id"], o["space"], o["key"])

    def op_bind(self, o):
        moved = self.named("bind", o["space"], o["key"])
        if moved:
            self.evict(o["to_space"], o["to_key"], moved, o["time"])
            for i in moved:
                self.give(i, o["to_space"], o["to_key"])

    def op_bind_oldest(self, o):
        have = sorted(i for i, item in self.items.items() if o["space"] in item["names"])
        moved = have[: o["count"]]
        if len(moved) < o["count"]:
            self.complain(FEWER, o["to_space"], o["to_key"])
        self.evict(o["to_space"], o["to_key"], moved, o["time"])
        for i in moved:
            if i in self.items:
                self.forget(i, o["space"])
                self.give(i, o["to_space"], o["to_key"])

    def op_stage(self, o):
        for i in self.named("stage", o["space"], o["key"]):
            self.enter(i, "", o["name"] or "", o["time"])

    def op_lane(self, o):
        for i in self.named("stage", o["space"], o["key"]):
            self.enter(i, o["lane"] or "", o["name"] or "", o["time"])

    def op_event(self, o):
        for i in self.named("event", o["space"], o["key"]):
            self.emit("event", id=i, name=o["name"], begin=o["time"], end=o["time"])

    def op_attribute(self, o):
        for i in self.named("attribute", o["space"], o["key"]):
            self.items[i]["attributes"][o["name"]] = o["value"]

    def op_label(self, o):
        for i in self.named("label", o["space"], o["key"]):
            self.items[i]["attributes"]["vtr.label"] = o["value"]

    def op_close(self, o):
        self.finish(self.named("close", o["space"], o["key"]), o["status"] or 0, o["time"])

    def op_abort_younger(self, o):
        ids = self.named("abort_younger", o["space"], o["key"])
        if ids:
            self.finish(sorted(i for i in self.items if i > ids[-1]), ABORTED, o["time"])

    def op_abort_keyspace(self, o):
        self.finish(sorted(i for i, item in self.items.items() if o["space"] in item["names"]), ABORTED, o["time"])

    def op_abort_all(self, o):
        self.finish(sorted(self.items), ABORTED, o["time"])

    def op_relate(self, o):
        sources, targets = self.named("records", o["space"], o["key"]), self.named("records", o["to_space"], o["to_key"])
        for a in sources:
            for b in targets:
                self.emit("relation", id=a, name=o["name"], other=b)

    def op_detach(self, o):
        for i in sorted(self.items, reverse=True):
            self.publish(i)
            for space in list(self.items[i]["names"]):
                self.forget(i, space)
            del self.items[i]


_NUMBERS = ("seq", "key", "to_key", "id", "parent", "status", "count", "time")


def _applied(t: Tracker, ops: pd.DataFrame) -> pd.DataFrame:
    """The rows that operations, in order, add to those of a tracker."""
    t.rows = []
    for o in ops.to_dict("records"):
        o = {k: None if pd.isna(v) else int(v) if k in _NUMBERS else v for k, v in o.items()}
        t.apply(o)
    out = pd.DataFrame(t.rows, columns=_OUT)
    for c in ("id", "begin", "end", "other"):
        out[c] = out[c].astype("Int64")
    out["status"] = out["status"].astype("Int32")
    return out


def process(ops: DataFrame) -> DataFrame:
    """Trackers in batch. Items that are still live at the end give no owner row. A task holds the state
    of one tracker and one batch of its operations at a time."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Tracker | None = None
        for pdf in it:
            for name, part in pdf.groupby("tracker", sort=False):
                if now is None or now.name != name:
                    now = Tracker(name)
                yield _applied(now, part)

    return ops.filter("tracker is not null").repartition("tracker").sortWithinPartitions("tracker", "seq").mapInPandas(run, OUT_SCHEMA)


def stream(ops: DataFrame) -> DataFrame:
    """Trackers over a streaming log; the state is what is live, as text."""

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        t = Tracker(key[0], state.get[0] if state.exists else None)
        out = _applied(t, pd.concat(list(frames), ignore_index=True).sort_values("seq"))
        state.update((t.saved(),))
        yield out

    return ops.filter("tracker is not null").groupBy("tracker").applyInPandasWithState(run, OUT_SCHEMA, "live string", "append", "NoTimeout")
