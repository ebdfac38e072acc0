"""Shared folders, row identity and connected components for the operators beside this file."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veil.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query of this subpackage with its checking SQL, if SQL can express it."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(rest: int, of: int) -> Column:
    """True where crc32 of doc_id as text leaves ``rest``; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == rest, F.lit(False))


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/veil-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from Parquet in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def meeting(df: DataFrame) -> DataFrame:
    """The same rows, to be joined by a shuffle of both sides. Spark takes the size of a stored table from its files, and a few MB of sorted, repeating
    numbers there are ten times as much in a broadcast table, more once rows are multiplied: several such at once are more than a driver holds."""
    return df.hint("merge")


@contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Rows go to Python in batches of about ``size`` bytes while the block runs, so it must itself run the jobs it is meant for; the session's
    own limit (64 MB, held by the executor and by every worker at once) comes back after it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Hand freed memory back to the system. A Python worker lives on beside the others of its executor, and its allocators would keep what a
    task's largest batch took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` for ``mapInArrow``; once a task's batches are done, or nobody reads on, the worker gives back what it no longer needs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b) of integers: (node, root), root the smallest node of the component.

    Alternating star rounds: every node hands its larger neighbours to its smallest one, then its smaller ones. Rows never exceed the
    links, and the number of rounds grows with the logarithm of the longest path. Each round is stored, so nothing is replayed. Nodes
    without links have no row; an empty input gives an empty result.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(meeting(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(meeting(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        rounds = stored(small, "edges")
        # A star forest has one parent per node and no parent that is a child; a last round then changes nothing.
        changed = rounds.join(meeting(edges), ["u", "v"], "left_anti").limit(1).count() + edges.join(meeting(rounds), ["u", "v"], "left_anti").limit(1).count()
        edges = rounds
        if not changed:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
