"""Benchmark decontamination by pigeonhole edit matching.

An item may differ from a passage by k edits. Cut into k + 1 pieces, at least one piece then occurs unchanged. An automaton finds every
piece in every text; each hit fixes a window of the text, and Myers' bit-parallel algorithm finds the item's least edit distance there.
The same pigeonhole holds for every part of an item: a part of p pieces within p - 1 edits has a half within its own number. A hit
is therefore verified on ever larger parts, so that most chance hits end after some twenty characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veil.llm.common import query, stored, table, tidy

MATCH = "item_id long, edits int, start long, stop long"


def normal(text: str) -> str:
    """Lower case, every run of white space one blank."""
    return " ".join(text.lower().split())


def budget(length: int, error_rate: float) -> int:
    return int(length * error_rate)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of edits + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def parts(first: int, last: int, above: tuple = ()) -> Iterator[tuple]:
    """For each piece in first..last, the parts (first, last) that hold it, from the smallest to the whole."""
    above = ((first, last), *above)
    if first == last:
        yield above[1:]
    else:
        middle = (first + last) // 2
        yield from parts(first, middle, above)
        yield from parts(middle + 1, last, above)


def automaton(items: list[tuple[int, str]], error_rate: float) -> ahocorasick.Automaton:
    """Finds pieces; a piece's value lists, for every place it has, the item's index, the offset and the parts (start, stop, edits)."""
    found: dict[str, list[tuple]] = {}
    trees: dict[int, list[tuple]] = {}
    for n, (_, text) in enumerate(items):
        cut = pieces(text, budget(len(text), error_rate))
        stops = [offset + len(piece) for offset, piece in cut]
        tree = trees.setdefault(len(cut), list(parts(0, len(cut) - 1)))
        for (offset, piece), above in zip(cut, tree):
            spans = tuple((cut[i][0], stops[j], j - i) for i, j in above)
            found.setdefault(piece, []).append((n, offset, spans))
    machine = ahocorasick.Automaton()
    for piece, where in found.items():
        machine.add_word(piece, (len(piece), where))
    if found:
        machine.make_automaton()
    return machine


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def least_edits(peq: dict[str, int], start: int, stop: int, text: str, limit: int) -> tuple[int, int]:
    """(edits, end) of the best match of the pattern's part start..stop that ends anywhere in the text; over limit means no match."""
    m = stop - start
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, limit + 1, -1
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0) >> start & full
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


def matches(text: str, items: list[tuple[int, str]], machine: ahocorasick.Automaton, peqs: list[dict[str, int]], error_rate: float) -> list[tuple]:
    """(item_id, edits, start, stop) of the best match of every item within its budget, places in the normal form."""
    found: dict[int, tuple[int, int, int]] = {}
    tried: set[tuple[int, int]] = set()
    for end, (length, where) in machine.iter(text):
        for n, offset, spans in where:
            begin = end + 1 - length - offset
            if found.get(n, (1,))[0] == 0 or (n, begin) in tried:
                continue
            item = items[n][1]
            if begin >= 0 and text.startswith(item, begin):
                found[n] = (0, begin, begin + len(item))
                continue
            edits, stop, low = 0, 0, begin
            for a, b, limit in spans:
                low = max(0, begin + a - limit)
                edits, stop = least_edits(peqs[n], a, b, text[low:begin + b + limit], limit)
                if edits > limit:
                    break
            else:
                if spans:
                    tried.add((n, begin))  # the whole item was searched here
                if edits < found.get(n, (len(item) + 1,))[0]:
                    found[n] = (edits, low, low + stop)
    out = []
    for n, (edits, low, stop) in found.items():
        item_id, item = items[n]
        if edits:
            _, back = least_edits(masks(item[::-1]), 0, len(item), text[low:stop][::-1], edits)
            low = stop - back
        out.append((item_id, edits, low, stop))
    return out


def placed(original: str, start: int, stop: int) -> tuple[int, int]:
    """Places of the normal form as places of the original, at word bounds."""
    at, first, last = 0, None, 0
    for word in re.finditer(r"\S+", original):
        size = len(word.group().lower())
        if first is None and start < at + size + 1:
            first = word.start()
        if at < stop:
            last = word.end()
        at += size + 1
        if at >= stop:
            break
    return first or 0, last


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``block_bytes`` bytes of text, so that what is sent to the tasks never grows with the benchmark."""
    rows = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    held, size = [], 0
    for r in rows.distinct().orderBy("item_id", "text").toLocalIterator():
        text = normal(r["text"])
        if text:
            if held and size + len(text) > block_bytes:
                yield held
                held, size = [], 0
            held.append((r["item_id"], text))
            size += len(text)
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.1, block_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, item_id, edits, start, stop), one row for each document row and item that its text holds within the error budget.

    The budget is ``error_rate`` of the item's length in the normal form. start and stop are code points of the text, at word bounds. Null
    texts and ids of items take no part, nor do blank ones; repeated document rows give repeated results, repeated items one; an empty
    benchmark gives no rows. The benchmark is matched block by block, each block of bounded size against all texts.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows, found = docs.where("text IS NOT NULL").select("doc_id", "text"), []
    for block in blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(block)
        found.append(rows.mapInArrow(_finder(shared, error_rate), f"doc_id {kind}, {MATCH}"))
    if not found:
        return spark.createDataFrame([], f"doc_id {kind}, {MATCH}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _finder(shared, error_rate: float):
    @tidy
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        machine, peqs = automaton(items, error_rate), [masks(t) for _, t in items]
        for batch in batches:
            docs, rows = [], []
            for n, text in enumerate(batch.column("text")):
                text = text.as_py()
                for item_id, edits, start, stop in matches(normal(text), items, machine, peqs, error_rate):
                    docs.append(n)
                    rows.append((item_id, edits, *placed(text, start, stop)))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(docs, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["doc_id", "item_id", "edits", "start", "stop"])

    return find


def clean(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.1) -> DataFrame:
    """Rows of ``docs`` whose doc_id holds no benchmark item; all columns are kept. A null doc_id goes only with its own row's match."""
    found = stored(contaminated(docs.withColumn("doc_id", F.struct("doc_id", F.xxhash64("text"))), benchmark, error_rate), "leaks")
    bad = found.select(F.col("doc_id")["doc_id"].alias("__doc"), F.col("doc_id")["col2"].alias("__mark")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__doc"]) & (F.xxhash64(docs["text"]) == bad["__mark"]), "left_anti")


@query("op5_benchmark_decontamination")
def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and benchmark item that it holds, with the edits between them."""
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
