"""Ordered computations per key that survive one key holding a third of all rows.

A plain window partitioned by the key would sort a hot key in a single task. Here
every key is cut into buckets of its order (an hour of event time, a range of
sequence numbers): rows are windowed per (key, bucket), each bucket leaves one
small summary row, the summaries are carried forward per key, and the carry is
joined back on (key, bucket). Only summary rows are ever ordered per key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HOUR_MICROS = 3_600_000_000


def time_bucket(ts: Column, micros: int = HOUR_MICROS) -> Column:
    """Bucket of an event time; choose the width so that a hot key's bucket fits one task."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / micros)


def seq_bucket(seq: Column, width: int = 100_000) -> Column:
    return F.floor(seq / width)


def value_buckets(df: DataFrame, value: Column, n: int = 64):
    """A function from a value to its bucket, of ``n`` about equally filled ones: the bounds are quantiles of the data, one aggregate.

    Raise ``n`` so that a bucket of the largest table fits a task; a value that holds many rows is one bucket, so count equal values first.
    """
    cuts = sorted(set(df.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 10 * n)).first()[0] or []))
    return lambda c: F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda b: b < c)) if cuts else F.lit(0)


def each(df: DataFrame, keep: list[str], items: Column, name: str) -> DataFrame:
    """One row per array item. The outer form keeps the optimizer from copying the (costly) array
    expression into a pre-filter, which would evaluate it twice."""
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def where(df: DataFrame, condition: Column) -> DataFrame:
    """A filter that is not pushed below the (costly) columns it tests, which would copy and evaluate them again."""
    return df.withColumn("__keep", F.explode_outer(F.array(condition))).filter("__keep").drop("__keep")


def sealed(df: DataFrame, names: list[str]) -> DataFrame:
    """The same rows; later filters on the named (costly) columns test their values instead of copying their expressions."""
    others = [c for c in df.columns if c not in names]
    packed = df.select(*others, F.explode_outer(F.array(F.struct(*names))).alias("__o"))
    return packed.select(*others, *[F.col(f"__o.{n}").alias(n) for n in names])


def _with_carry(df: DataFrame, carry: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    renamed = carry.select(*[F.col(n).alias(f"__{n}") for n in names], *columns)
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).eqNullSafe(F.col(f"__{n}"))
    return df.join(renamed, cond, "left").drop(*[f"__{n}" for n in names])


def running_totals(df: DataFrame, keys: list[str], bucket: Column, order: list[Column],
                   totals: dict[str, Column], inclusive: bool = True, largest: bool = False) -> DataFrame:
    """Adds, per key in order, the running sum of each (integer) column, up to or before the row; the running
    maximum instead when ``largest``."""
    agg = F.max if largest else F.sum
    names = [*keys, "__bucket"]
    rows = df.withColumn("__bucket", bucket)
    for name, value in totals.items():
        rows = rows.withColumn(f"__v_{name}", value if largest else value.cast("long"))
    end = W.currentRow if inclusive else -1
    local = W.partitionBy(*names).orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    rows = rows.select("*", *[agg(f"__v_{n}").over(local).alias(f"__l_{n}") for n in totals])
    summary = rows.groupBy(*names).agg(*[agg(f"__v_{n}").alias(f"__s_{n}") for n in totals])
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = summary.select(*names, *[agg(f"__s_{n}").over(before).alias(f"__c_{n}") for n in totals])
    joined = _with_carry(rows, carry, names, [f"__c_{n}" for n in totals])
    def merged(n: str) -> Column:
        if largest:
            return F.greatest(f"__l_{n}", f"__c_{n}")
        return F.coalesce(F.col(f"__l_{n}"), F.lit(0)) + F.coalesce(F.col(f"__c_{n}"), F.lit(0))

    result = joined.select("*", *[merged(n).alias(n) for n in totals])
    return result.drop("__bucket", *[f"__{p}_{n}" for n in totals for p in "vlc"])


def previous_rows(df: DataFrame, keys: list[str], bucket: Column, order: list[Column],
                  fields: list[Column], k: int, name: str = "previous") -> DataFrame:
    """Adds an array of up to ``k`` structs: the rows just before this one per key, oldest first."""
    names = [*keys, "__bucket"]
    rows = df.withColumn("__bucket", bucket).withColumn("__row", F.struct(*fields))
    window = W.partitionBy(*names).orderBy(*order)
    rows = rows.select("*", F.collect_list("__row").over(window.rowsBetween(-k, -1)).alias("__local"),
                       F.collect_list("__row").over(window.rowsBetween(-(k - 1), 0)).alias("__tail"),
                       F.row_number().over(window).alias("__at"))
    # The last k rows of a bucket; k earlier buckets hold at least k earlier rows.
    summary = rows.groupBy(*names).agg(F.max_by("__tail", "__at").alias("__tail"))
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(-k, -1)
    carry = summary.select(*names, F.flatten(F.collect_list("__tail").over(before)).alias("__carry"))
    joined = _with_carry(rows.drop("__tail", "__at"), carry, names, ["__carry"])
    empty = F.slice(F.col("__local"), 1, 0)
    every = F.concat(F.coalesce(F.col("__carry"), empty), F.col("__local"))
    last = F.when(F.size(every) > k, F.slice(every, -k, k)).otherwise(every)
    return joined.withColumn(name, last).drop("__bucket", "__row", "__local", "__carry")


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds the row number per key in order."""
    return running_totals(df, keys, bucket, order, {name: F.lit(1)})


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key. The rank limit runs before the shuffle, so a hot key ships k rows per task."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")
