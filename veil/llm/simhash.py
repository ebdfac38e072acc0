"""SimHash near-duplicates by pivot distance tables.

Every fingerprint gets a row of Hamming distances to fixed reference fingerprints. Two fingerprints within r bits differ by at most r in
every coordinate. The references come in two kinds. Narrow ones (two set bits each, 32 of them) change only with their own bits, so r
differing bits leave all but r of the coordinate groups equal: rows meet by equi-join on the groups that stay. Wide ones (random words)
then discard pairs by their largest coordinate difference, and the exact distance verifies the rest. Equal fingerprints are one row
throughout, so copies never form pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veil.llm.common import components, meeting, query, stored, table, tidy

SEED = 42
WORDS_AT_ONCE = 1 << 16
#: The order of shingles is learned from about SAMPLED texts: those with OFTEN or more of a shingle make it common, up to COMMON shingles.
SAMPLED, OFTEN, COMMON = 4_000, 3, 50_000
#: Bits of the maps that keep texts without a candidate in their place.
SLOTS = 1 << 22
#: Rounds of linear comparisons ahead of the complete one.
ROUNDS = 2
NARROW = tuple(0b11 << (2 * i) for i in range(32))
WIDE = tuple(int(x) for x in np.random.default_rng(SEED).integers(0, 1 << 63, 16, dtype=np.int64))


def fingerprint_of(raw: bytes | None, shingle: int) -> int:
    """64-bit SimHash of a UTF-8 text: a bit is set where over half of the shingle hashes set it; 0 without words."""
    words = raw.lower().split() if raw else []  # on bytes both touch ASCII only
    if not words:
        return 0
    n, ones = max(1, len(words) - shingle + 1), np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, WORDS_AT_ONCE):
        part = words[at:at + WORDS_AT_ONCE + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.array([digest(g, SEED) for g in grams], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; null and blank texts have fingerprint 0."""
    return _prints(docs, shingle).drop("th")


def _prints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, th, fp) for every row; th is the hash of the text."""
    @tidy
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint_of(t.as_py(), shingle) for t in batch.column("raw")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(prints, pa.int64())], names=["doc_id", "th", "fp"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.encode("text", "utf-8").alias("raw"))
    return rows.mapInArrow(of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def distance(a: Column, b: Column | int) -> Column:
    return F.bit_count(a.bitwiseXOR(F.lit(_signed(b)) if isinstance(b, int) else b))


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """All pairs (a < b) of distinct fingerprints ``fp`` at most ``max_bits`` bits apart. Nulls take no part."""
    groups = max_bits + 2
    fp, per = F.col("fp"), 32 // groups
    coords = [distance(fp, p) for p in NARROW]
    # d(x, pivot) mixes the pivot's own two bits with all others; the zero word's distance takes the others out.
    own = [F.shiftright(F.bit_count(fp) + F.lit(2) - c, 1) for c in coords]
    bounds = [per * g for g in range(groups)] + [32]
    packed = [reduce(lambda acc, c: acc * 3 + c, own[bounds[g]:bounds[g + 1]], F.lit(0).cast("long")) for g in range(groups)]
    rows = prints.select("fp").where("fp IS NOT NULL").distinct().select(
        "fp", F.array(*[distance(fp, p).cast("byte") for p in WIDE]).alias("wide"), *[p.alias(f"g{g}") for g, p in enumerate(packed)])
    keys = F.array(*[
        F.struct(F.lit(n).cast("byte").alias("which"), F.col(f"g{g}").alias("one"), F.col(f"g{h}").alias("two"))
        for n, (g, h) in enumerate(combinations(range(groups), 2))])
    cells = rows.select("fp", "wide", F.explode(keys).alias("key")).select("fp", "wide", "key.*")
    left, right = (cells.select(F.col("fp").alias(n), F.col("wide").alias(f"wide_{n}"), "which", "one", "two") for n in "ab")
    near = reduce(lambda x, y: x & y, [F.abs(F.col("wide_a")[i] - F.col("wide_b")[i]) <= max_bits for i in range(len(WIDE))])
    met = meeting(left).join(right, ["which", "one", "two"]).where((F.col("a") < F.col("b")) & near & (distance(F.col("a"), F.col("b")) <= max_bits))
    return met.select("a", "b").distinct()


def grouped(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id reachable over links of ``max_bits`` bits.

    Repeated rows stay repeated; a null doc_id never names a component unless no other id is in it; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, shingle), "prints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    tree = components(links(prints, max_bits))
    roots = first.join(meeting(tree), first["fp"] == tree["node"], "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    named = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_print = roots.select("fp", "root").join(meeting(named), "root").select("fp", "component_id")
    return prints.join(meeting(of_print), "fp").select("doc_id", "fp", "component_id")


# --- near-duplicates by similarity: too far apart for fingerprints, so shingles meet instead -----------------------------------------


def _words(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()


def _shingles(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text, ascending."""
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else ([b" ".join(words)] if words else [])
    return np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], "<u8")).view("<i8")


def _common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles seen ``OFTEN`` times or more in about ``SAMPLED`` texts, rarest first, at most ``COMMON``; ties by hash."""
    @tidy
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_shingles(_words(raw.as_py()), shingle) for raw in batch.column("raw")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *found]), pa.int64())], names=["key"])

    step = max(1, docs.where("text IS NOT NULL").count() // SAMPLED)
    some = docs.where("text IS NOT NULL").where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).select(F.encode("text", "utf-8").alias("raw")).distinct()
    counts = some.mapInArrow(of, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    top = counts.orderBy(F.desc("n"), "key").limit(COMMON).collect()
    return np.array([r.key for r in reversed(top)], np.int64)


def _counts(found: np.ndarray) -> bytes:
    """How many shingle hashes fall to each value of their last bits, two to four of them to a value."""
    n = _buckets(len(found))
    counts = np.bincount(found & (n - 1), minlength=n)
    return counts.astype("u1" if counts.max() < 256 else "<u4").tobytes()


def _buckets(n: int) -> int:
    return 1 << max(4, (n // 4).bit_length())


def _most_shared(x: bytes, n_x: int, y: bytes, n_y: int) -> int:
    """What two sets of shingles share at most, by their counts: never less than what they do share."""
    one, two = (np.frombuffer(c, "u1" if len(c) == _buckets(n) else "<u4").astype(np.int64) for c, n in ((x, n_x), (y, n_y)))
    low = min(len(one), len(two))
    return int(np.minimum(one.reshape(-1, low).sum(0), two.reshape(-1, low).sum(0)).sum())


def _described(docs: DataFrame, shingle: int, similarity: float, common: np.ndarray) -> DataFrame:
    """(doc_id, th, mark, n, rare, often, counts) of every row: th is the hash of the text, mark that of its lower-cased words.

    n is the size of the text's set of shingles; rare and often are the first of them in one order of all shingles, as many as must meet those
    of any text that is similar enough. The order lists shingles by hash (rare), then the ``common`` ones (often). Any order is complete: two
    sets that share s of n have one of the first n - s + 1 in common. It only decides how many candidates there are. Texts without words, and
    copies of a mark that the same task has seen, have nulls from n on.
    """
    by_hash = np.argsort(common, kind="stable")
    known = common[by_hash]

    @tidy
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            marks, sizes, rare, often, counts = [], [], [], [], []
            for raw in batch.column("raw"):
                words = _words(raw.as_py())
                mark = _signed(xxhash.xxh64_intdigest(b" ".join(words), 1))
                marks.append(mark)
                if not words or mark in seen:
                    for column in (sizes, rare, often, counts):
                        column.append(None)
                    continue
                seen.add(mark)
                found = _shingles(words, shingle)
                n = len(found)
                first, last = found, found[:0]
                if len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    is_common = known[at] == found
                    first, last = found[~is_common], common[np.sort(by_hash[at[is_common]])]
                size = n - math.ceil(similarity * n - 1e-9) + 1
                sizes.append(n)
                rare.append(first[:size])
                often.append(last[:max(0, size - len(first))])
                counts.append(_counts(found))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(marks, pa.int64()), pa.array(sizes, pa.int32()),
                 pa.array(rare, longs), pa.array(often, longs), pa.array(counts, pa.binary())],
                names=["doc_id", "th", "mark", "n", "rare", "often", "counts"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.encode("text", "utf-8").alias("raw"))
    return rows.mapInArrow(of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, mark long, n int, rare array<long>, often array<long>, counts binary")


def _met(rows: DataFrame) -> DataFrame:
    """(key, mark, n): the first shingles that two marks or more have, each once a mark.

    A rare shingle is in few texts of the sample, so none has a large share of all rows: one shuffle and a look at the neighbours decide. The
    common ones all stay; their repeats go in an aggregate that combines before it shuffles, by shingle and mark.
    """
    rare, often = (rows.where("n IS NOT NULL").select(F.explode(c).alias("key"), "mark", "n") for c in ("rare", "often"))
    by_key = Window.partitionBy("key").orderBy("mark")
    beside = rare.withColumns({"next": F.lead("mark").over(by_key), "low": F.first("mark").over(by_key)})
    last = F.col("next").isNull()
    met = beside.where((~last & (F.col("next") != F.col("mark"))) | (last & (F.col("low") != F.col("mark"))))
    return met.select("key", "mark", "n").unionByName(often.distinct())


def _among(hashes: DataFrame):
    """A test of a column that holds for all ``hashes`` (h) and few others: a bitmap of ``SLOTS`` bits goes to all tasks, however many there are."""
    words = hashes.select(F.shiftright(F.pmod("h", F.lit(SLOTS)), 6).alias("at"), F.expr("shiftleft(1L, cast(pmod(h, 64) AS int))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(SLOTS >> 6, np.int64)
    bits[found.column("at").to_numpy()] = found.column("bits").to_numpy()

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        at = h.to_numpy() & (SLOTS - 1)
        return pd.Series((bits[at >> 6] >> (at & 63) & 1).astype(bool))

    return test


def _alike(docs: DataFrame, rows: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (x, y) of marks whose shingle sets have the Jaccard similarity, as links (a, b).

    Counts of a few bytes a text first tell the pairs that cannot have it; only texts of the others travel, one row of each mark.
    """
    @tidy
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, n_x, y, n_y in zip(*(batch.column(c).to_pylist() for c in ("counts_x", "n_x", "counts_y", "n_y"))):
                most = _most_shared(x, n_x, y, n_y)
                keep.append(most >= similarity * (n_x + n_y - most) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    @tidy
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("raw_x"), batch.column("raw_y")):
                x, y = _shingles(_words(one.as_py()), shingle), _shingles(_words(two.as_py()), shingle)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def sides(table: DataFrame, *columns: str) -> list[DataFrame]:
        return [table.select(F.col("mark").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in columns]) for n in "xy"]

    both = F.explode(F.array("x", "y"))
    pairs = stored(pairs, "pairs")
    sets = rows.where("n IS NOT NULL")
    one, two = sides(sets.where(_among(pairs.select(both.alias("h")))("mark")).select("mark", "n", "counts").dropDuplicates(["mark"]), "n", "counts")
    pairs = stored(pairs.join(meeting(one), "x").join(meeting(two), "y").select("x", "n_x", "counts_x", "y", "n_y", "counts_y").mapInArrow(possible, "x long, y long"), "possible")

    marks = pairs.select(both.alias("mark")).distinct()
    owner = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("of")
    owners = stored(sets.join(meeting(marks), "mark", "left_semi").groupBy("mark").agg(owner).select("mark", F.col("of.doc_id").alias("owner"), "of.th"), "owners")
    texts = docs.select("doc_id", F.xxhash64("text").alias("__th"), F.encode("text", "utf-8").alias("raw"))
    texts = texts.where(_among(owners.select(F.xxhash64("owner", "th").alias("h")))(F.xxhash64("doc_id", "__th")))
    texts = texts.join(meeting(owners), texts["doc_id"].eqNullSafe(owners["owner"]) & (texts["__th"] == owners["th"])).select("mark", "raw").dropDuplicates(["mark"])
    one, two = sides(texts, "raw")
    return stored(pairs.join(meeting(one), "x").join(meeting(two), "y").select("x", "y", "raw_x", "raw_y").mapInArrow(similar, "a long, b long"), "alike")


def _enough(pairs: DataFrame, similarity: float) -> DataFrame:
    """(x, y) of the candidates (x, y, n_x, n_y), one row for each shingle they meet at, that can still be similar.

    All first shingles of the text whose part ends earlier in the order can only meet first shingles of the other, so two sets share no
    more than what meets here and the later shingles of one of them.
    """
    later = F.ceil(F.greatest("n_x", "n_y") * F.lit(similarity) - 1e-9) - 1
    sums = pairs.groupBy("x", "y").agg(F.count("*").alias("met"), F.max("n_x").alias("n_x"), F.max("n_y").alias("n_y"))
    return sums.where(F.col("met") + later >= F.lit(similarity / (1 + similarity)) * (F.col("n_x") + F.col("n_y")) - 1e-9).select("x", "y")


def _rooted(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """``rows`` with the root of their mark, and only those whose key still has two roots."""
    rooted = rows.join(meeting(tree), rows["mark"] == tree["node"], "left").select(*rows.columns, F.coalesce("root", "mark").alias("root"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return stored(rooted.join(meeting(open_keys), "key"), "open")


def similar_components(docs: DataFrame, described: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root): connected components of the marks in ``described`` over all pairs of the Jaccard similarity or more.

    Complete by prefix filter: similar texts share a shingle among their first ones. Rounds first compare the texts of a shingle with one
    of them only, so a group of copies becomes one component in linear work; then every pair that shares a first shingle, fits by sizes and by
    the number of them and is not in one component yet is verified, however many a text has. A pair within a component adds nothing to it.
    """
    rows = stored(_met(described), "shared")
    # A text without edits of its own has the fewest first shingles that nobody shares, so it is the best centre.
    alone = rows.groupBy("mark").agg((F.max("n") - F.ceil(F.max("n") * F.lit(similarity) - 1e-9) + 1 - F.count("*")).alias("alone"))
    rows = stored(rows.join(meeting(alone), "mark"), "scored")
    tree, found = None, []
    for turn in range(ROUNDS):
        rest = _rooted(rows, tree).drop("root") if tree is not None else rows
        centre = F.col("alone") if turn == 0 else F.xxhash64("mark", F.lit(turn))
        heads = rest.groupBy("key").agg(F.min(F.struct(centre.alias("by"), "mark", "n")).alias("head")).select("key", "head.mark", "head.n")
        heads = heads.withColumnsRenamed({"mark": "y", "n": "n_y"})
        pairs = rest.withColumnsRenamed({"mark": "x", "n": "n_x"}).join(meeting(heads), "key").where("x <> y").select("x", "y", "n_x", "n_y")
        found.append(_alike(docs, described, _enough(pairs, similarity), shingle, similarity))
        tree = components(reduce(DataFrame.unionByName, found))
    rest = _rooted(rows, tree)
    one, two = (rest.select("key", *[F.col(c).alias(f"{c}_{n}") for c in ("mark", "n", "root")]) for n in "xy")
    fits = F.least("n_x", "n_y") >= F.lit(similarity) * F.greatest("n_x", "n_y") - 1e-9
    pairs = one.join(meeting(two), "key").where((F.col("mark_x") < F.col("mark_y")) & (F.col("root_x") != F.col("root_y")) & fits)
    pairs = pairs.withColumnsRenamed({"mark_x": "x", "mark_y": "y"}).select("x", "y", "n_x", "n_y")
    found.append(_alike(docs, described, _enough(pairs, similarity), shingle, similarity))
    return components(reduce(DataFrame.unionByName, found))


def without_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest doc_id (null last; ties by text hash).

    Texts of equal lower-cased words are copies. Other texts are linked if the Jaccard similarity of their shingle sets is ``similarity``
    or more; no such pair of groups is missed. Null and blank texts are copies of each other; of rows that repeat id and text one stays. All
    columns are kept. Rows that cannot be copies by a bitmap of those that are do not travel.
    """
    rows = stored(_described(docs, shingle, similarity, _common_shingles(docs, shingle)), "described")
    return _first_of_each(docs, rows, similar_components(docs, rows, shingle, similarity))


def one_per_print_group(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component over links of ``max_bits`` bits between fingerprints, as ``grouped`` finds them: the one with
    the smallest doc_id (null last; ties by text hash). Null and blank texts have one fingerprint; of rows that repeat id and text one
    stays. All columns are kept."""
    rows = stored(_prints(docs, shingle).withColumnRenamed("fp", "mark"), "prints")
    return _first_of_each(docs, rows, components(links(rows.select(F.col("mark").alias("fp")), max_bits)))


def _first_of_each(docs: DataFrame, rows: DataFrame, tree: DataFrame) -> DataFrame:
    """``docs`` with the first row of each component ``tree`` (node, root) of the marks of ``rows`` (doc_id, th, mark)."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    rooted = rows.join(meeting(tree), rows["mark"] == tree["node"], "left").select("doc_id", "th", F.coalesce("root", "mark").alias("root"))
    each = rooted.groupBy("doc_id", "th").agg(F.count("*").alias("copies"), F.first("root").alias("root"))
    first = each.groupBy("root").agg(F.min(order).alias("first"))
    goes = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))
    doubt = each.join(meeting(first), "root").withColumn("goes", goes).where("goes OR copies > 1")
    doubt = stored(doubt.select(F.col("doc_id").alias("owner"), "th", "goes"), "doubt")
    marked = docs.withColumn("__th", F.xxhash64("text"))
    marked = marked.withColumn("__doubt", _among(doubt.select(F.xxhash64("owner", "th").alias("h")))(F.xxhash64("doc_id", "__th")))
    unsure, gone = marked.where("__doubt"), doubt.where("goes")
    stays = unsure.join(meeting(gone), unsure["doc_id"].eqNullSafe(gone["owner"]) & (unsure["__th"] == gone["th"]), "left_anti").dropDuplicates(["doc_id", "__th"])
    return marked.where("NOT __doubt").unionByName(stays).drop("__th", "__doubt")


@query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, two bits."""
    return grouped(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
