"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of term weights + sum over pairs of terms of the inner product of their factors), over the distinct terms of
the whole text. The factors learn pairs, such as an insult beside a group's name, that no sum of single weights can tell.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veil.llm.common import held_out, query, stored, table

SLOTS = 1 << 18
FACTORS = 4
PAIR_BITS = 22
WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Model:
    """Bias, weight per slot, factors per slot. Slots never seen in training are zero."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray


def terms(text: str | None) -> np.ndarray:
    """Slots of the distinct lower-case words, in order."""
    words = set(WORD.findall(text.lower())) if text else ()
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) & SLOTS - 1 for w in words), np.int64, len(words)))


def raw_score(model: Model, slots: np.ndarray) -> float:
    v = model.factor[slots]
    s = v.sum(axis=0)
    return float(model.bias + model.weight[slots].sum() + 0.5 * (s @ s - (v * v).sum()))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling(rows: list[np.ndarray], labels: np.ndarray, min_docs: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Slots in ``min_docs`` rows or more, and those of them whose chi-squared with the label is at least ``least``: a single weight of
    any other slot would be noise learned by heart."""
    every = np.concatenate([*rows, np.zeros(0, np.int64)])
    n, positive = max(1, len(rows)), float(labels.sum())
    seen = np.bincount(every, minlength=SLOTS).astype(float)
    hit = np.bincount(every, np.repeat(labels, [len(r) for r in rows]), SLOTS) if len(rows) else np.zeros(SLOTS)
    expected = seen * positive / n
    spread = expected * (1 - seen / n) * (1 - positive / n)
    often = (seen >= min_docs) & (spread > 0)
    return often, often & ((hit - expected) ** 2 >= least * np.maximum(spread, 1e-9))


def pair_buckets(slots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of a row's slots in blocks of about a million: their buckets, and the two slots of each."""
    height = max(1, (1 << 20) // max(1, len(slots)))
    for at in range(0, len(slots), height):
        first, second = np.nonzero(np.arange(at, min(at + height, len(slots)))[:, None] < np.arange(len(slots))[None, :])
        a, b = slots[at + first], slots[second]
        mixed = ((a << 18) | b).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        yield (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64), a, b


def paired(rows: list[np.ndarray], labels: np.ndarray, often: np.ndarray, model: Model, least: float) -> np.ndarray:
    """Slots of pairs that say more of the label than the model without them knows: a score test of each pair on the model's errors.

    Pairs are counted by hash in a table of fixed size; a pair that passes because another shares its bucket only lets two slots more learn.
    """
    error, spread = np.zeros(1 << PAIR_BITS), np.ones(1 << PAIR_BITS)
    chosen = [r[often[r]] for r in rows]
    for kept, row, label in zip(chosen, rows, labels):
        p = float(sigmoid(raw_score(model, row)))
        for buckets, _, _ in pair_buckets(kept):
            np.add.at(error, buckets, label - p)
            np.add.at(spread, buckets, p * (1 - p))
    passed, slots = error * error >= least * spread, np.zeros(SLOTS, bool)
    if passed.any():
        for kept in chosen:
            for buckets, a, b in pair_buckets(kept):
                hit = passed[buckets]
                slots[a[hit]] = slots[b[hit]] = True
    return slots


def train(rows: list[np.ndarray], labels: np.ndarray, least: float = 10.8, pair_least: float = 40.0, min_docs: int = 4, **descent) -> Model:
    """A first model over the slots that tell the label alone; then factors also for slots that tell it only in pairs, if there are any."""
    often, alone = telling(rows, labels, min_docs, least)
    model = descend(rows, labels, alone, alone, **descent)
    extra = paired(rows, labels, often, model, pair_least) & ~alone
    return descend(rows, labels, alone, alone | extra, **descent) if extra.any() else model


def descend(rows: list[np.ndarray], labels: np.ndarray, weighted: np.ndarray, factored: np.ndarray, epochs: int = 20, rate: float = 0.2,
            shrink: float = 1e-3, batch: int = 64) -> Model:
    """Adaptive gradient descent on the logistic loss; slots not ``weighted`` or not ``factored`` keep a zero weight or zero factors."""
    rng = np.random.default_rng(7)
    weight, factor = np.zeros(SLOTS), rng.normal(0, 0.01, (SLOTS, FACTORS))
    kept = weighted | factored
    factor[~factored] = 0
    rows = [r[kept[r]] for r in rows]
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    bias, seen_w, seen_v, seen_b = float(np.log(share / (1 - share))), np.full(SLOTS, 1e-6), np.full((SLOTS, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            sizes = np.array([len(rows[i]) for i in chosen])
            if not sizes.sum():
                continue
            slots, inverse = np.unique(np.concatenate([rows[i] for i in chosen]), return_inverse=True)
            owner = np.repeat(np.arange(len(chosen)), sizes)
            v = factor[slots][inverse]
            total = np.stack([np.bincount(owner, v[:, f], len(chosen)) for f in range(FACTORS)], axis=1)
            square = np.bincount(owner, (v * v).sum(axis=1), len(chosen))
            z = bias + np.bincount(owner, weight[slots][inverse], len(chosen)) + 0.5 * ((total * total).sum(axis=1) - square)
            error = sigmoid(z) - labels[chosen]
            g = np.bincount(inverse, error[owner], len(slots)) + shrink * weight[slots]
            seen_w[slots] += g * g
            weight[slots] -= weighted[slots] * rate * g / np.sqrt(seen_w[slots])
            pair = error[owner][:, None] * (total[owner] - v)
            g = np.stack([np.bincount(inverse, pair[:, f], len(slots)) for f in range(FACTORS)], axis=1) + 10 * shrink * factor[slots]
            seen_v[slots] += g * g
            factor[slots] -= factored[slots][:, None] * 0.2 * rate * g / np.sqrt(seen_v[slots])
            seen_b += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(seen_b)
    return Model(float(bias), weight.astype(np.float32), factor.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> Model:
    """Learn from documents with a label in the column ``toxic``; text is the only input.

    About ``sample`` labelled ids at most are used, chosen by a hash of the doc_id, and twice as many rows at most where ids repeat; that
    bound, and not the corpus, sets the work of the driver. Null texts, null labels and ids without a partner are left out; of several labels of one id the largest counts; without rows
    every score is 0.5.
    """
    one = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("double").alias("label"))
    share = min(1.0, sample / max(1, one.count()))
    one = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(one, "doc_id")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t.as_py()).astype(np.int32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())], names=["label", "slots"])

    kept = stored(rows.mapInArrow(slots, "label double, slots binary"), "terms")
    found = kept.orderBy(F.xxhash64("slots"), "label").limit(2 * sample).toPandas().sort_values(["label", "slots"], kind="stable")
    return train([np.frombuffer(b, np.int32).astype(np.int64) for b in found["slots"]], found["label"].to_numpy(np.float64))


def scored(text: Column, model: Model, spark: SparkSession) -> Column:
    """Probability of the label for a text column; null and empty texts get the bias alone. The model has a fixed size."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([float(sigmoid(raw_score(shared.value, terms(t)))) for t in texts], dtype="float64")

    return of(text)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document, learned from labelled rows that are not held out."""
    docs = table(spark, folder, "documents")
    seen = ~held_out(2, 4)
    model = fit(docs.where("doc_id IS NOT NULL").where(seen), table(spark, folder, "labels").where("doc_id IS NOT NULL").where(seen))
    return docs.select("doc_id", held_out(2, 4).alias("held_out"), scored(F.col("text"), model, spark).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int"))
