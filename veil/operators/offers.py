"""Constrained selection: offers for a price target, extremes with ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veil import rules
from veil.plans.ordered import running_totals, value_buckets


def select_offers(offers: DataFrame, targets: DataFrame, buckets: int = 64) -> DataFrame:
    """Per target (target_id, kind, amount) the best offers (offer_id, price): around within 20 %, max, min, exact within 10 %.

    Only the nearest price on either side can win, so this is an as-of search over distinct prices (running maximum and minimum over
    buckets whose bounds are quantiles of the prices), never a band of pairs.
    """
    prices = offers.groupBy("price").agg(F.count("*").alias("n_offers"), F.min("offer_id").alias("first_offer"))
    # Each distinct price and amount once, so a frequent amount is one point.
    points = prices.select(F.col("price").alias("at"), "price", F.lit(0).alias("side")).unionByName(
        targets.select(F.col("amount").alias("at"), F.lit(None).cast("double").alias("price"), F.lit(1).alias("side")).distinct())
    points = points.withColumn("__all", F.lit(0))
    bucket = value_buckets(prices, F.col("price"), buckets)
    up = running_totals(points, ["__all"], bucket(F.col("at")), [F.col("at"), F.col("side")], {"below": F.col("price")}, largest=True)
    down = running_totals(points, ["__all"], -bucket(F.col("at")), [-F.col("at"), F.col("side")], {"above": -F.col("price")}, largest=True)
    near = up.filter(F.col("side") == 1).select(F.col("at").alias("amount"), "below").join(
        down.filter(F.col("side") == 1).select(F.col("at").alias("amount"), (-F.col("above")).alias("above")), "amount")
    rows = targets.join(near, "amount")
    amount, below, above = F.col("amount"), F.col("below"), F.col("above")
    closest = F.filter(F.array_compact(F.array(below, above)), lambda p: F.abs(p - amount) == F.least(
        F.abs(F.coalesce(below, above) - amount), F.abs(F.coalesce(above, below) - amount)))

    def within(share: float) -> Column:
        return F.filter(closest, lambda p: F.abs(p - amount) <= share * amount)

    none = F.slice(closest, 1, 0)
    picked = (F.when(F.col("kind") == "max", F.array_compact(F.array(below))).when(F.col("kind") == "min", F.array_compact(F.array(above)))
              .when(F.col("kind") == "around", within(rules.AROUND_TOLERANCE)).when(F.col("kind") == "exact", within(rules.EXACT_TOLERANCE)).otherwise(none))
    chosen = rows.select("target_id", "kind", "amount", F.explode_outer(F.array_distinct(picked)).alias("price"))
    return chosen.join(prices, "price", "left")


def pick_extreme(df: DataFrame, group: list[str], value: str, key: str, largest: bool, tie: str | None = None, named: str | None = None) -> DataFrame:
    """Per group the best value and its row, or AMBIGUOUS_TARGET when several tie and no tie-breaker is named.

    ``tie`` is the attribute that the task's own tie-breaker asks the lowest of, ``named`` a column that says whether the task states one;
    rows that tie on it as well stay ambiguous.
    """
    breaker = F.col(tie) if tie else F.lit(0)
    rows = df.withColumn("__tie", breaker).withColumn("__named", F.col(named) if named else F.lit(False))
    equal = rows.groupBy(*group, value, "__tie").agg(F.count("*").alias("__n"), F.min(key).alias("__k"), F.bool_or("__named").alias("__named"))
    ties = equal.groupBy(*group, value).agg(F.sum("__n").alias("n"), F.min(F.struct("__tie", "__n", "__k")).alias("first"), F.bool_or("__named").alias("named"))
    best = (F.max if largest else F.min)(F.struct(F.col(value).alias("v"), "n", "first", "named"))
    picked = ties.groupBy(*group).agg(best.alias("b"))
    one = (F.col("b.n") == 1) | (F.col("b.named") & (F.col("b.first.__n") == 1))
    return picked.select(*group, F.col("b.v").alias(value), F.col("b.n").alias("n_best"), F.when(one, F.col("b.first.__k")).alias(key),
                         F.when(one, "OK").otherwise("AMBIGUOUS_TARGET").alias("code"))
