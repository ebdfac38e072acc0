"""Timed rules: a page settles, an action's effects, waiting for evidence. The same definitions in batch and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veil import rules
from veil.plans.ordered import each, previous_rows, running_totals


def settle_sessions(mutations: DataFrame, page: str, ts: str, gap: str = f"{rules.SETTLE_QUIET_MS} milliseconds", watermark: str | None = None) -> DataFrame:
    """Runs of mutations without a pause of ``gap``: (page, mutations, first, last). Works on a stream when a watermark is given."""
    rows = mutations.withWatermark(ts, watermark) if watermark else mutations
    grouped = rows.groupBy(F.col(page), F.session_window(ts, gap).alias("w")).agg(
        F.count("*").alias("mutations"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return grouped.select(page, "mutations", "first", "last")


def settle_islands(mutations: DataFrame, page: str, ts: str, gap_ms: int = rules.SETTLE_QUIET_MS, width_ms: int = 3_600_000) -> DataFrame:
    """The batch form of ``settle_sessions``: gaps and islands over time buckets, so one page with a third of all
    mutations is spread over tasks."""
    at = F.unix_micros(ts)
    bucket = F.floor(at / (width_ms * 1000))
    rows = previous_rows(mutations.withColumn("__us", at), [page], bucket, [F.col("__us")], [F.col("__us").alias("at")], 1, "__prev")
    fresh = F.coalesce(F.col("__us") - F.get("__prev", 0)["at"] >= gap_ms * 1000, F.lit(True))
    marked = rows.select(page, ts, "__us", fresh.cast("int").alias("__fresh"))
    numbered = running_totals(marked, [page], bucket, [F.col("__us"), F.col("__fresh").desc()], {"__island": F.col("__fresh")})
    return numbered.groupBy(page, "__island").agg(F.count("*").alias("mutations"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("__island")


def settle_times(mutations: DataFrame, loads: DataFrame, page: str, ts: str, quiet_ms: int = rules.SETTLE_QUIET_MS,
                 grace_ms: int = rules.SETTLE_GRACE_MS, max_ms: int = rules.SETTLE_MAX_MS) -> DataFrame:
    """Per page load the moment it counts as settled, in milliseconds after the load, and whether it did before the cap.

    ``loads(page, loaded)``. The first quiet period that ends after the grace decides; only mutations up to the cap matter,
    which the join bounds.
    """
    near = within_batch(loads.select(page, F.col("loaded").alias("__load")), mutations.select(page, F.col(ts).alias("__ts")), page, "__load", "__ts", max_ms)
    offset = (F.unix_millis("__ts") - F.unix_millis("__load")).alias("at")
    rows = near.select(page, F.unix_millis("__load").alias("__load"), offset).filter(F.col("at") < max_ms)
    quiet_from = F.greatest(F.col("at"), F.lit(grace_ms))
    nxt = previous_rows(rows, [page, "__load"], F.floor(-F.col("at") / 1000), [F.col("at").desc()], [F.col("at").alias("at")], 1, "__next")
    silent = F.coalesce(F.get("__next", 0)["at"], F.lit(1 << 40))
    ends = F.when((silent > quiet_from + quiet_ms), quiet_from + quiet_ms)
    first = nxt.groupBy(page, "__load").agg(F.min(ends).alias("end"), F.min("at").alias("first_at"))
    every = loads.select(page, F.unix_millis("loaded").alias("__load")).join(first, [page, "__load"], "left")
    # Silence from the end of the grace to the first later mutation settles a page as well.
    start = F.when(F.col("first_at").isNull() | (F.col("first_at") > grace_ms + quiet_ms), grace_ms + quiet_ms)
    at = F.least(F.coalesce(start, F.lit(1 << 40)), F.coalesce("end", F.lit(1 << 40)))
    return every.select(page, (F.col("__load")).alias("load_ms"), (at <= max_ms).alias("settled"), F.least(at, F.lit(max_ms)).alias("waited_ms"))


def within_batch(actions: DataFrame, followers: DataFrame, key: str, action_ts: str, follower_ts: str, millis: int) -> DataFrame:
    """Followers up to ``millis`` after an action of the same key: an equi-join on (key, slice of time), so a hot key is
    many small groups. A follower lies in the action's slice or the next one."""
    def slice_of(c: Column) -> Column:
        return F.floor(F.unix_millis(c) / millis)

    left = each(actions.withColumn("__s", slice_of(F.col(action_ts))), actions.columns + ["__s"], F.array(F.col("__s"), F.col("__s") + 1), "__slice").drop("__s")
    right = followers.withColumn("__slice", slice_of(F.col(follower_ts)))
    wait = F.unix_micros(follower_ts) - F.unix_micros(action_ts)
    return left.join(right, [key, "__slice"]).filter(wait.between(0, millis * 1000)).drop("__slice")


def effect_watch(actions: DataFrame, mutations: DataFrame, key: str, action: str, action_ts: str, mutation_ts: str,
                 millis: int = rules.EFFECT_WATCH_MS, quiet_ms: int = rules.EFFECT_QUIET_MS) -> DataFrame:
    """(action, mutations, watched_ms): mutations from the action on until none follows for ``quiet_ms``, at the latest until ``millis``.

    An action without mutations is watched to the end. Only one action's mutations within its own time meet in a window.
    """
    gap = (F.unix_millis(mutation_ts) - F.unix_millis(action_ts)).alias("gap")
    pairs = within_batch(actions, mutations, key, action_ts, mutation_ts, millis).select(action, gap).filter(F.col("gap") < millis)
    order = Window.partitionBy(action).orderBy("gap")
    silent = F.when(F.col("gap") - F.lag("gap").over(order) >= quiet_ms, 1).otherwise(0)
    kept = pairs.withColumn("silent", silent).withColumn("broken", F.sum("silent").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("broken = 0")
    seen = kept.groupBy(action).agg(F.count("*").alias("mutations"), F.max("gap").alias("last"))
    return actions.select(action).join(seen, action, "left").select(
        action, F.coalesce("mutations", F.lit(0)).alias("mutations"), F.coalesce(F.least(F.col("last") + quiet_ms, F.lit(millis)), F.lit(millis)).alias("watched_ms"))


def evidence_counts(clicks: DataFrame, signals: DataFrame, key: str, click: str, click_ts: str, signal_ts: str, millis: int, width_ms: int = 86_400_000) -> DataFrame:
    """Signals up to ``millis`` after each click, both ends included: (click, signals). Two running counts, one before the click and one
    at the end of its wait, so no pair is ever made and a hot key is spread over time buckets."""
    at, wait = F.unix_micros(click_ts), millis * 1000
    # At one instant, waits begin before signals, and end after them.
    begin = clicks.select(key, click, at.alias("us"), F.lit(0).alias("turn"), F.lit(0).alias("one"))
    end = clicks.select(key, click, (at + wait).alias("us"), F.lit(2).alias("turn"), F.lit(0).alias("one"))
    mid = signals.select(key, F.lit(None).cast(clicks.schema[click].dataType).alias(click), F.unix_micros(signal_ts).alias("us"), F.lit(1).alias("turn"), F.lit(1).alias("one"))
    rows = begin.unionByName(end).unionByName(mid)
    seen = running_totals(rows, [key], F.floor(F.col("us") / (width_ms * 1000)), [F.col("us"), F.col("turn")], {"n": F.col("one")})
    signed = F.when(F.col("turn") == 2, F.col("n")).otherwise(-F.col("n"))
    return seen.filter(F.col("turn") != 1).groupBy(click).agg(F.sum(signed).alias("signals"))


def effect_join(actions: DataFrame, mutations: DataFrame, key: str, action_ts: str, mutation_ts: str,
                within: str = f"{rules.EFFECT_WATCH_MS} milliseconds", watermark: str = "10 seconds", how: str = "inner") -> DataFrame:
    """Stream-stream interval join: mutations that belong to an action. ``leftOuter`` keeps actions without any."""
    a = actions.withWatermark(action_ts, watermark).alias("a")
    m = mutations.withWatermark(mutation_ts, watermark).withColumnRenamed(key, f"{key}_2").alias("m")
    cond = (F.col(key) == F.col(f"{key}_2")) & (F.col(mutation_ts) >= F.col(action_ts)) & (F.col(mutation_ts) <= F.col(action_ts) + F.expr(f"INTERVAL {within}"))
    return a.join(m, cond, how).drop(f"{key}_2")


def evidence_join(clicks: DataFrame, signals: DataFrame, key: str, click_ts: str, signal_ts: str,
                  within: str = f"{rules.EVIDENCE_MS} milliseconds", watermark: str = "10 seconds") -> DataFrame:
    """Cart signals shortly after a click count; clicks without a signal are kept once their time has passed."""
    return effect_join(clicks, signals, key, click_ts, signal_ts, within, watermark, "leftOuter")


def dedupe_stream(df: DataFrame, keys: list[str], ts: str, watermark: str) -> DataFrame:
    """Late and duplicate records: one record per key within the watermark."""
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


__all__ = ["settle_sessions", "settle_islands", "settle_times", "within_batch", "effect_watch", "evidence_counts", "effect_join", "evidence_join", "dedupe_stream"]
