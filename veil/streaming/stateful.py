"""Streams that remember: placeholders per scope, the last actions of a task, the settle timer of a page."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veil import rules
from veil.operators.redact import _fill, canonical, two_passes

# Workers need no installed copy of this package: the processors travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _known_pattern(value: str) -> re.Pattern | None:
    """What a known value is replaced in: any spacing of the same digits, or any letter case; nothing for very short ones."""
    raw = value.strip()
    if re.fullmatch(r"\+?[0-9\s-]+", raw):
        digits = re.sub("[^0-9]", "", raw)
        return re.compile(r"(?<![0-9+])\+?" + r"[\s-]*".join(digits) + "(?![0-9])") if len(digits) >= 4 else None
    return re.compile(re.escape(raw), re.IGNORECASE) if len(raw) >= 3 else None


class Vault(StatefulProcessor):
    """One scope's placeholders: value -> placeholder and order of registration, and a counter per type."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "value string", "placeholder string, at long", self.ttl_ms)
        self.counters = handle.getMapState("counters", "type string", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Known values first, longest first; then what was found and is still there, from the last to the first of each pass."""
        held = {k[0]: (v[0], v[1]) for k, v in self.known.iterator()}
        counts = {k[0]: v[0] for k, v in self.counters.iterator()}
        old_held, old_counts = dict(held), dict(counts)
        patterns = {v: _known_pattern(v) for v in held}
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            text, taken = r.text, []
            for value in sorted(held, key=lambda v: (-len(v), held[v][1])):
                if patterns[value] is not None:
                    for m in patterns[value].finditer(text):
                        if all(m.end() <= a or m.start() >= b for a, b, _ in taken):
                            taken.append((m.start(), m.end(), held[value][0]))
            for s in r.spans:  # in order of registration
                start, stop = s["start"], s["start"] + len(s["value"])
                if any(start < b and stop > a for a, b, _ in taken):
                    continue
                if s["value"] not in held:
                    counts[s["type"]] = counts.get(s["type"], 0) + 1
                    held[s["value"]] = (f"[{s['type']}_{counts[s['type']]}]", len(held))
                    patterns[s["value"]] = _known_pattern(s["value"])
                taken.append((start, stop, held[s["value"]][0]))
            for a, b, mark in sorted(taken, reverse=True):
                text = text[:a] + mark + text[b:]
            yield pd.DataFrame({"scope": [key[0]], "seq": [r.seq], "redacted": [text]})
        for value, entry in held.items():
            if old_held.get(value) != entry:
                self.known.updateValue((value,), entry)
        for kind, n in counts.items():
            if old_counts.get(kind) != n:
                self.counters.updateValue((kind,), (n,))

    def close(self) -> None:
        pass


def _raw_spans(placed: Column) -> Column:
    """Detected values in order of registration, with their places in the text as it came."""
    by_place = F.array_sort(placed)
    moved = F.transform(by_place, lambda s, i: F.struct(
        s["pass"].alias("pass"),
        (-(s["start"] + F.aggregate(F.slice(by_place, F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p["value"]) - p["size"]))).alias("back"),
        s["type"].alias("type"), s["value"].alias("value")))
    return F.transform(F.array_sort(moved), lambda s: F.struct((-s["back"]).alias("start"), s["type"].alias("type"), s["value"].alias("value")))


def redact_stream(df: DataFrame, scope: str, seq: str, text: str, ttl_ms: int | None = None) -> DataFrame:
    """Redacts records so that a value keeps its placeholder for the whole scope, across batches, wherever it occurs again.

    Detection is column code; the scope's state holds one entry per distinct value, never texts. Records of one scope must
    arrive in order across batches. A scope too hot for one task takes ``redact_stream_stateless``.
    """
    rows = two_passes(df.withColumn("scope", F.col(scope).cast("string")).withColumn("seq", F.col(seq).cast("long")), text)
    found = rows.select("scope", "seq", F.col(text).alias("text"), _raw_spans(F.col("__placed")).alias("spans"))
    return found.groupBy("scope").transformWithStateInPandas(
        Vault(ttl_ms), "scope string, seq long, redacted string", "Append", "None")


def redact_stream_stateless(df: DataFrame, scope: Column, text: str, secret: str) -> DataFrame:
    """The form for very hot scopes: a placeholder is a digest of (scope, value variant) under a secret key, so no state and no shuffle.

    Without the key nobody can test a guessed value against a placeholder. Values are replaced where the detectors find them; what
    only an earlier record gives away needs ``redact_stream``.
    """
    rows = two_passes(df, text)

    def mark(s: Column) -> Column:
        digest = F.left(F.sha2(F.concat_ws("|", F.lit(secret), F.sha2(F.concat_ws("|", F.lit(secret), scope.cast("string"), canonical(s["value"])), 256)), 256), F.lit(12))
        return F.concat(F.lit("["), s["type"], F.lit("_"), F.conv(digest, 16, 10), F.lit("]"))

    return rows.withColumn("redacted", _fill(F.col("__text"), F.col("__placed"), mark)).drop("__text", "__placed")


#: Records of actions as they are kept in state, as Arrow streams.
ACTION_ROWS = pa.schema([("task_id", pa.string()), ("at", pa.int64()), ("seq", pa.int64()), ("sig", pa.string()), ("effect", pa.string())])


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, ACTION_ROWS) as stream:
        stream.write_table(rows)
    return out.getvalue().to_pybytes()


def _unpacked(entries: list[tuple]) -> pa.Table:
    return pa.concat_tables([ACTION_ROWS.empty_table(), *[pa.ipc.open_stream(pa.py_buffer(e[0])).read_all() for e in entries]])


class LastActions(StatefulProcessor):
    """The last eight signatures and effects of each task of a group, in event time.

    Records wait until the watermark has passed them: only then is their order final, whatever batch they came in. One timer a group releases
    them. Calls and steps to the state cost far more than the flags of a record, so many tasks share them. The state holds what arrives
    within the watermark's delay, and seven records a task; a task without a record for ``idle_ms`` after its last one forgets them.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")
        self.recent = handle.getValueState("recent", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pa.concat_tables([pa.Table.from_pandas(b[ACTION_ROWS.names], ACTION_ROWS, preserve_index=False) for b in rows])
        self.waiting.appendValue((_packed(new),))
        first, due = pc.min(new["at"]).as_py(), self.due.get()
        if due is None or first < due[0]:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, due = timerValues.getCurrentWatermarkInMs(), self.due.get()
        if due is None or due[0] > passed:  # a timer that an earlier one has done the work of
            return
        waiting = _unpacked(list(self.waiting.get()) if self.waiting.exists() else [])
        over = pc.less_equal(waiting["at"], passed)
        ready, rest = waiting.filter(over), waiting.filter(pc.invert(over))
        if len(ready):
            self.waiting.put([(_packed(rest),)]) if len(rest) else self.waiting.clear()
        known = _unpacked([self.recent.get()] if self.recent.exists() else [])
        rows = pa.concat_tables([t.append_column("new", pa.array(np.full(len(t), n))) for t, n in ((known, False), (ready, True))])
        rows = rows.sort_by([(c, "ascending") for c in ("task_id", "new", "at", "seq", "sig", "effect")]).combine_chunks()
        task, sig = (pc.dictionary_encode(rows[c], null_encoding="encode").combine_chunks().indices.to_numpy() for c in ("task_id", "sig"))
        at, new, still = rows["at"].to_numpy(), rows["new"].to_numpy(), pc.fill_null(pc.equal(rows["effect"], "no_change"), False).to_numpy()
        idle = np.zeros(len(at) - 1, bool) if self.idle_ms is None else at[1:] > at[:-1] + self.idle_ms
        part = np.cumsum(np.r_[True, (task[1:] != task[:-1]) | idle])

        def same(x: np.ndarray, back: int) -> np.ndarray:
            return np.r_[np.zeros(min(back, len(x)), bool), (x[back:] == x[:-back]) & (part[back:] == part[:-back])]

        cycling = 1 + sum(same(sig, k).astype(int) for k in range(1, rules.CYCLE_WINDOW)) >= rules.CYCLE_COUNT
        stuck = np.logical_and.reduce([still, *[same(still, k) for k in range(1, rules.NO_EFFECT_STREAK)]])
        out = pd.DataFrame({"task_id": rows["task_id"].to_pandas(), "seq": rows["seq"].to_numpy(), "repeated": same(sig, 1), "cycling": cycling, "stuck": stuck})[new]

        ends = np.flatnonzero(np.r_[task[1:] != task[:-1], True])
        own = ends[np.searchsorted(ends, np.arange(len(at)))]
        kept = own - np.arange(len(at)) < rules.CYCLE_WINDOW - 1
        wake = [pc.min(rest["at"]).as_py()] if len(rest) else []
        if self.idle_ms is not None:
            kept &= at[own] + self.idle_ms > passed
            wake += [int(at[ends][at[ends] + self.idle_ms > passed].min() + self.idle_ms)] if kept.any() else []
        known = rows.select(ACTION_ROWS.names).filter(pa.array(kept))
        self.recent.update((_packed(known),)) if len(known) else self.recent.clear()
        self._wake(min(wake)) if wake else self.due.clear()
        yield out

    def close(self) -> None:
        pass


def loops_stream(actions: DataFrame, task: str, ts: str, seq: str, watermark: str, idle_ms: int | None = None, groups: int = 1024) -> DataFrame:
    """Live repeat, cycle and no-effect flags per action, in the order (ts, seq) whatever order records arrive in.

    ``actions(task, ts, seq, action, target, value, effect)``. A flag is given once the watermark has passed its record; records later than
    ``watermark`` are dropped by the stream, as are those without a time or a number. Tasks share the state of ``groups`` groups, each handled
    whole in memory; the number must stay that of the checkpoint.
    """
    from veil.operators.trajectory import signature
    rows = actions.withWatermark(ts, watermark).where(F.col(ts).isNotNull() & F.col(seq).isNotNull()).select(
        F.col(task).cast("string").alias("task_id"), F.col(ts), F.unix_millis(ts).alias("at"), F.col(seq).cast("long").alias("seq"),
        signature(F.col("action"), F.col("target"), F.col("value")).alias("sig"), "effect")
    return rows.withColumn("part", F.pmod(F.xxhash64("task_id"), F.lit(groups))).groupBy("part").transformWithStateInPandas(
        LastActions(idle_ms), "task_id string, seq long, repeated boolean, cycling boolean, stuck boolean", "Append", "EventTime")


class Generations(StatefulProcessor):
    """The newest run of a task, in event time: records of older runs after it started are superseded, copies count once.

    Records wait until the watermark has passed them; those that come behind it are given out at once as late and change nothing. The state is
    one number and what arrives within the watermark's delay.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "newest long, due long")
        # Each entry holds a batch's rows of at, run and seq as 64-bit integers.
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        new = np.concatenate([b[["at", "run", "seq"]].to_numpy("int64") for b in rows])
        late, kept = new[new[:, 0] <= passed], new[new[:, 0] > passed]
        if len(kept):
            self.waiting.appendValue((kept.tobytes(),))
            newest, due = self.known.get() or (None, None)
            first = int(kept[:, 0].min())
            if due is None or first < due:
                self.handle.registerTimer(first)
                self.known.update((newest, first))
        if len(late):
            yield pd.DataFrame({"task_id": key[0], "seq": late[:, 2], "run": late[:, 1], "status": "late"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        newest, due = self.known.get() or (None, None)
        if due is None or due > passed:  # a timer that an earlier one has done the work of
            return
        held = np.unique(np.concatenate([np.frombuffer(e[0], "int64").reshape(-1, 3) for e in self.waiting.get()]), axis=0)
        ready, rest = held[held[:, 0] <= passed], held[held[:, 0] > passed]
        # At one time the newer run counts as started.
        ready = ready[np.lexsort((ready[:, 2], -ready[:, 1], ready[:, 0]))]
        top = np.maximum.accumulate(ready[:, 1] if newest is None else np.maximum(ready[:, 1], newest))
        if len(rest):
            self.waiting.put([(rest.tobytes(),)])
            self.handle.registerTimer(int(rest[0, 0]))
        else:
            self.waiting.clear()
        self.known.update((int(top[-1]), int(rest[0, 0]) if len(rest) else None))
        yield pd.DataFrame({"task_id": key[0], "seq": ready[:, 2], "run": ready[:, 1], "status": np.where(ready[:, 1] == top, "kept", "superseded")})

    def close(self) -> None:
        pass


def runs_stream(records: DataFrame, task: str, run: str, ts: str, seq: str, watermark: str) -> DataFrame:
    """(task_id, seq, run, status) of records of runs: kept, superseded by a newer run of the task, or late (behind the watermark).

    The event time is handed on as a plain number, so the stream does not drop what is late but gives it out. Records without a time, run or
    number have no row.
    """
    rows = records.withWatermark(ts, watermark).where(F.col(ts).isNotNull() & F.col(run).isNotNull() & F.col(seq).isNotNull()).select(
        F.col(task).cast("string").alias("task_id"), F.unix_millis(ts).alias("at"), F.col(run).cast("long").alias("run"), F.col(seq).cast("long").alias("seq"))
    return rows.groupBy("task_id").transformWithStateInPandas(
        Generations(), "task_id string, seq long, run long, status string", "Append", "EventTime")


class Settle(StatefulProcessor):
    """A page is settled after a quiet time, no earlier than a grace after its first record, at the latest at a cap."""

    def __init__(self, quiet_ms: int, grace_ms: int, max_ms: int):
        self.quiet_ms, self.grace_ms, self.max_ms = quiet_ms, grace_ms, max_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "first long, last long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.times.get() if self.times.exists() else None
        first, last, due = state if state else (None, None, None)
        out = []
        for at in sorted(t for b in rows for t in b["at"]):
            if due is not None and at > due:
                out.append((key[0], first, due - first < self.max_ms, due - first))
                first = last = None
            first = at if first is None else first
            last = at
            due = min(max(last, first + self.grace_ms) + self.quiet_ms, first + self.max_ms)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(due))
        self.times.update((int(first), int(last), int(due)))
        yield pd.DataFrame(out, columns=["page", "first_ms", "settled", "waited_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, _last, due = self.times.get()
        self.times.clear()
        yield pd.DataFrame([(key[0], first, due - first < self.max_ms, due - first)], columns=["page", "first_ms", "settled", "waited_ms"])

    def close(self) -> None:
        pass


def settle_stream(mutations: DataFrame, page: str, ts: str, watermark: str, quiet_ms: int = rules.SETTLE_QUIET_MS,
                  grace_ms: int = rules.SETTLE_GRACE_MS, max_ms: int = rules.SETTLE_MAX_MS) -> DataFrame:
    """Settle verdicts of pages with the grace and the cap, by event-time timers."""
    rows = mutations.withWatermark(ts, watermark).select(F.col(page).cast("string").alias("page"), F.col(ts), F.unix_millis(ts).alias("at"))
    return rows.groupBy("page").transformWithStateInPandas(
        Settle(quiet_ms, grace_ms, max_ms), "page string, first_ms long, settled boolean, waited_ms long", "Append", "EventTime")

