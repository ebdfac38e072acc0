import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from veil.streaming import stateful as ST
from veil.streaming.queries import drain, in_waves

END = "SELECT -1L AS id, -1L AS task, timestamp'2200-01-01' AS ts, 0 AS run, 'x' AS action, 'x' AS effect"


def made(spark, seed, n=120):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), 1_700_000_000 + rng.randrange(0, 4000), rng.randrange(3), rng.choice("ab"), rng.choice(["no_change", "no_change", "moved"])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, task long, s long, run int, action string, effect string").withColumn("ts", F.timestamp_seconds("s"))
    return rows, df.select("id", "task", "ts", "run", "action", "effect")


def test_loops_in_event_time_with_an_idle_end(spark):
    rows, df = made(spark, 3)
    stream, watermark = in_waves(df, "ts", F.pmod(F.xxhash64("id"), F.lit(100)) / 100, 5, spark.sql(END))
    actions = stream.withColumn("target", F.lit(None).cast("string")).withColumn("value", F.lit(None).cast("string"))
    got = {r.seq: (r.repeated, r.cycling, r.stuck) for r in drain(ST.loops_stream(actions, "task", "ts", "id", watermark, 100_000)).collect()}
    want, window, last = {}, {}, {}
    for i, task, s, _run, action, effect in sorted(rows, key=lambda r: (r[2], r[0])):
        own = window.get(task, []) if s - last.get(task, s) <= 100 else []
        seen = (own + [(action, effect)])[-8:]
        want[i] = (bool(own) and own[-1][0] == action, sum(a == action for a, _ in seen) >= 3, len(seen) >= 3 and all(e == "no_change" for _, e in seen[-3:]))
        window[task], last[task] = seen, s
    assert got == want


def test_newer_runs_cancel_older_ones_and_late_records_are_given_out(spark):
    rows, df = made(spark, 4)
    late = F.col("id") % 10 == 3
    early = [r[2] for r in rows]
    late &= F.col("ts") < F.timestamp_seconds(F.lit(min(early) + 500))
    stream, watermark = in_waves(df.unionByName(df.where(~late)), "ts", F.pmod(F.xxhash64("id"), F.lit(100)) / 100, 8, spark.sql(END), late)
    got = sorted((r.seq, r.run, r.status) for r in drain(ST.runs_stream(stream, "task", "run", "ts", "id", watermark)).collect())
    want, newest = [], {}
    for i, task, s, run, _a, _e in sorted(rows, key=lambda r: (r[2], -r[3])):
        if i % 10 == 3 and s < min(early) + 500:
            want.append((i, run, "late"))
            continue
        newest[task] = max(newest.get(task, run), run)
        want.append((i, run, "kept" if run == newest[task] else "superseded"))
    assert got == sorted(want) and {"late", "superseded", "kept"} == {w[2] for w in want}


def test_a_batch_is_a_wave(spark):
    _rows, df = made(spark, 5)
    stream, _watermark = in_waves(df.repartition(3), "ts", F.lit(0.5), 4, spark.sql(END).repartition(8))
    got = drain(stream.select("id", F.col("_metadata.file_path").alias("file"))).collect()
    folder = got[0].file.rsplit("/", 1)[0]
    # Five waves of three files each, the end of the input in one of them.
    assert len(got) == 121 and len(spark.read.parquet(folder).inputFiles()) == 15


class _State:
    def __init__(self, calls):
        self.calls, self.value = calls, None

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("exists", "get"):
                return self.value is not None if name == "exists" else self.value
            self.value = None if name == "clear" else (self.value or []) + [args[0]] if name == "appendValue" else args[0]
        return call


def test_tasks_of_a_group_share_steps_to_the_state():
    calls, timers = [], []
    handle = SimpleNamespace(getValueState=lambda *_: _State(calls), getListState=lambda *_: _State(calls), registerTimer=timers.append)
    loops = ST.LastActions(50)
    loops.init(handle)
    rows = [(f"t{i % 400}", 10 * (i // 400), i, "ab"[i // 400 % 5 == 4], "no_change" if i % 2 else None) for i in range(4000)]
    got = {}
    for wave in (rows[2000:], rows[:2000]):
        loops.handleInputRows((0,), iter([pd.DataFrame(wave, columns=ST.ACTION_ROWS.names)]), None)
    for passed in (44, 70, 500):
        for out in loops.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda p=passed: p), None):
            got.update({r.seq: (r.repeated, r.cycling, r.stuck) for r in out.itertuples()})
    # Signatures by time: a a a a b, twice; the odd tasks never see an effect.
    repeated = [False, True, True, True, False, False, True, True, True, False]
    assert got == {i: (repeated[i // 400], i // 400 in (2, 3, 5, 6, 7, 8), i % 2 == 1 and i // 400 >= 2) for i in range(4000)}
    assert len(calls) < 40 and len(timers) == 4
    assert loops.recent.value is None and loops.waiting.value is None and loops.due.value is None
