"""Language identification with language-bitmask n-gram filters.

A Bloom filter holds the frequent n-grams of every language at once: a slot is a mask with one bit per language, so one look-up of an
n-gram (the AND of its slots) returns all languages that contain it. A text's n-grams are looked up, the bits are counted per language,
the counts are corrected by each language's false-positive rate, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veil.llm.common import give_back, held_out, query, stored, table, tidy

GRAM = 4
SLOTS = 1 << 20
PROBES = 2
PIECE = 1 << 20


@dataclass(frozen=True)
class Model:
    """Languages in order, the slot masks, and per language the chance that an n-gram it lacks is found."""

    langs: tuple[str, ...]
    masks: np.ndarray
    false_rate: np.ndarray


def letters_table() -> np.ndarray:
    """True where a code point is a letter. The last entry, which stands for all code points past the table, is none."""
    return np.fromiter((chr(c).isalpha() for c in range(0x34000)), bool, 0x34000)


def gram_hashes(text: str, letter: np.ndarray) -> Iterator[np.ndarray]:
    """32-bit hashes of all character n-grams of the lower-cased words, parted by one blank, with two at each end; long texts in pieces."""
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at:at + PIECE + GRAM].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        known = letter[np.minimum(codes, len(letter) - 1)]
        words = np.where(known, codes, 32)
        blank = words == 32
        words = words[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint32)
        if len(words) and not (len(words) == 1 and words[0] == 32):
            words = np.pad(words, 2, constant_values=32)
        if len(words) >= GRAM:
            h = np.zeros(len(words) - GRAM + 1, np.uint32)
            for i in range(GRAM):
                h = (h ^ words[i:len(words) - GRAM + 1 + i]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            yield h


def slots_of(h: np.ndarray) -> list[np.ndarray]:
    second = (h * np.uint32(0x85EBCA6B)) ^ ((h * np.uint32(0xC2B2AE35)) >> np.uint32(13))
    return [h & np.uint32(SLOTS - 1), second >> np.uint32(32 - SLOTS.bit_length() + 1)]


def fit(docs: DataFrame, per_lang: int = 5000, min_count: int = 3, min_share: float = 0.125) -> Model:
    """Learn from the columns text and lang.

    A language with more than ``per_lang`` rows is learned from about that many, chosen by a hash of the text, so the work is bounded by
    the number of languages. An n-gram belongs to a language where it occurs ``min_count`` times or more and at ``min_share`` or more of
    the rate it has in the language where it is most frequent. Rows with null text or lang are left out; without rows the model is empty.
    """
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = tuple(sorted(sizes))
    if not langs:
        return Model((), np.zeros((1, SLOTS), np.uint64), np.zeros(0))
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, per_lang / sizes[lang])))])
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, held, waiting = letters_table(), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                grams, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int32)), pa.array(n.astype(np.int64))],
                    names=["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for h in gram_hashes(text.as_py(), letter):
                    held.setdefault(lang, []).append(h)
                    waiting += len(h)
                if waiting > 1 << 22:
                    yield from flush()
                    waiting = 0
        yield from flush()

    counts = stored(sample.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    size = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(float(totals.get(lang, 1))))])
    rated = counts.withColumn("rate", F.col("n") / size[F.col("lang")])
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    number = F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))])
    kept = rated.join(top, "gram").where((F.col("n") >= min_count) & (F.col("rate") >= min_share * F.col("top")))
    members = kept.select("gram", number[F.col("lang")].alias("number"))

    @tidy
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.asarray(batch.column("gram")).view(np.uint32)
            number = np.asarray(batch.column("number"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(number >> 6, PROBES).astype(np.int32)), pa.array(np.concatenate(slots_of(h)).astype(np.int32)),
                 pa.array(np.tile(np.left_shift(np.int64(1), (number & 63).astype(np.int64)), PROBES))],
                names=["word", "slot", "mask"])

    filled = members.mapInArrow(slots, "word int, slot int, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    cells = filled.toPandas()  # at most SLOTS rows per 64 languages
    masks = np.zeros(((len(langs) + 63) // 64, SLOTS), np.uint64)
    masks[cells["word"], cells["slot"]] = cells["mask"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([((masks[i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).mean() for i in range(len(langs))])
    if len(langs) <= 8:
        masks = masks.astype(np.uint8)
    return Model(langs, masks, fill ** PROBES)


def predict_one(text: str | None, model: Model, letter: np.ndarray) -> tuple[str, float]:
    """(language, share of the text's n-grams that the language explains); ``und`` for null, letterless or unlearned."""
    counts, total = np.zeros(len(model.langs)), 0
    if text is None or not model.langs:
        return "und", 0.0
    for h in gram_hashes(text, letter):
        first, second = slots_of(h)
        total += len(h)
        for word in range(len(model.masks)):
            found = model.masks[word][first] & model.masks[word][second]
            for i in range(word * 64, min(len(model.langs), word * 64 + 64)):
                counts[i] += np.count_nonzero(found & found.dtype.type(1 << (i & 63)))
    if not total:
        return ("und", 0.0) if not any(c.isalpha() for c in text) else (model.langs[0], 0.0)
    right = (counts - total * model.false_rate) / np.maximum(1 - model.false_rate, 1e-9)
    best = int(np.argmax(right))
    return model.langs[best], float(np.clip(right[best] / total, 0.0, 1.0))


def predicted(text: Column, model: Model, spark: SparkSession) -> Column:
    """Struct of lang and score for a text column. The model has a fixed size: SLOTS masks per 64 languages."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letter = letters_table()
        for texts in batches:
            yield pd.DataFrame([predict_one(t, shared.value, letter) for t in texts], columns=["lang", "score"])
        give_back()

    return of(text)


def known_languages(docs: DataFrame, model: Model, min_score: float = 0.2) -> DataFrame:
    """Rows of ``docs`` whose text has letters and shares at least ``min_score`` of its n-grams with a learned language.

    All columns are kept. Null, empty and letterless texts go, repeated rows share one fate, an empty model rejects everything.
    """
    name = "__veil_language"
    rows = docs.withColumn(name, predicted(F.col("text"), model, docs.sparkSession))
    return rows.where((F.col(name)["lang"] != "und") & (F.col(name)["score"] >= min_score)).drop(name)


@query("op9_language_id")
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, learned from rows that are not held out."""
    docs = table(spark, folder, "documents")
    model = fit(docs.where("doc_id IS NOT NULL").where(~held_out(1, 3)))
    return docs.select("doc_id", held_out(1, 3).alias("held_out"), predicted(F.col("text"), model, spark).alias("p")).select(
        "doc_id", "held_out", F.col("p")["lang"].alias("lang_pred"), F.col("p")["score"].alias("score"))
