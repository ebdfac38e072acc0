"""Secret scan: fixed patterns, and a battery of randomness tests on long tokens; DataFrame operations only.

A token of 20 or more characters is tested against the alphabet of its inferred encoding. Chi-squared over the alphabet (written text
repeats characters) and, where the alphabet has several kinds of characters, the runs of its kinds (written text seldom switches) give a
chance that written text would look as random. Runs about the alphabet's median and serial correlation of neighbouring characters (around
the alphabet as a circle, so that counting past its end is seen) must together be as those of random draws, which counting is not. A false-discovery limit per encoding and length class then
decides: the number of written tokens of a class is estimated from its chances above one half, so short tokens of small alphabets, whose
chances are never tiny, are found where few written ones of their kind occur, and need stronger evidence where many do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veil.functions.text import match_spans
from veil.llm.common import query, stored, table
from veil.plans.ordered import sealed

#: Patterns of the base kinds, in the order of their listing, and the fewest characters of group 2 or of the match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
TOKEN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"

#: Encodings by the first pattern that fits, with their alphabets in order.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("decimal", "^[0-9]+$", DIGITS),
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("lower", "^[a-z]+$", LOWER),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[0-9A-Za-z_/+-]+$", UPPER + LOWER + DIGITS + "-_+/"),
)
#: Of two characters of written text: the chance to be equal (at least twice that of the alphabet), and to differ in case or kind.
EQUAL, SWITCH = 0.065, 0.15
BINS = 300
#: Bins below this one hold chances above one half.
HALF_BIN = 3
#: Encodings whose alphabet has one kind of characters, so that there is no switch to count.
ONE_KIND = ("decimal", "lower")
SPANS = "array<struct<start:int,rank:int,stop:int,kind:string>>"


def _spans(found: Column, kind: str, rank: int, keep) -> Column:
    kept = F.filter(found, lambda s: keep(s["value"]))
    return F.transform(kept, lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), (s["start"] + F.length(s["value"])).alias("stop"), F.lit(kind).alias("kind")))


def base_spans(text: Column) -> Column:
    """Spans (start, rank, stop, kind) of the base kinds, by start, then rank; places are code points, ``stop`` exclusive."""
    assign = match_spans(text, ASSIGN, "assign", text.rlike(ASSIGN_HEAD))
    access = match_spans(text, ACCESS, "access", F.contains(text, F.lit("AKIA")))
    hexes = match_spans(text, HEX, "hex", text.rlike(HEX))
    return F.array_sort(F.concat(
        _spans(assign, "assign", 0, lambda v: F.length(F.regexp_extract(v, ASSIGN, 1)) >= ASSIGN_LEAST),
        _spans(access, "access", 1, lambda v: F.length(v) >= ACCESS_LEAST), _spans(hexes, "hex", 2, lambda v: F.lit(True)))).cast(SPANS)


def tokens(text: Column) -> Column:
    """Long tokens (start, type, value) to be tested."""
    return match_spans(text, TOKEN, "random", text.rlike(TOKEN))


def upper_tail(z: Column) -> Column:
    """Chance that a normal deviate exceeds z (rational approximation, error under 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def tested(cands: DataFrame) -> DataFrame:
    """Adds encoding, p, serial and runs to rows with a token ``value``. p: chance that written text looks as random; serial and runs: z of
    the correlation of neighbours and of the changes between the halves of the alphabet, about 0 for random tokens."""
    value = F.col("value")
    encoding = F.coalesce(*[F.when(value.rlike(p), F.lit(n)) for n, p, _ in ENCODINGS])
    alphabet = F.coalesce(*[F.when(F.col("encoding") == n, F.lit(a)) for n, _, a in ENCODINGS])
    # Each step's columns are computed once, however often the next ones use them.
    rows = sealed(cands.withColumn("encoding", encoding), ["encoding"])
    rows = sealed(rows.withColumn("alphabet", alphabet).withColumn("chars", F.split("value", "")), ["alphabet", "chars"])
    rows = sealed(rows.withColumn("at", F.transform("chars", lambda c: F.instr(F.col("alphabet"), c))), ["at"])
    n, k = F.length(value).cast("double"), F.length("alphabet").cast("double")
    squares = F.aggregate(F.array_distinct("at"), F.lit(0.0), lambda acc, d: acc + F.pow(F.size(F.filter("at", lambda x: x == d)).cast("double"), F.lit(2.0)))
    chi = k / n * squares - n
    extra = (n - 1) * (k * F.greatest(F.lit(EQUAL), 2 / k) - 1)
    z_chi = (k - 1 + extra - chi) / F.sqrt(2 * (k - 1 + 2 * extra))
    kinds = F.filter(F.transform("chars", lambda c: F.when(c.rlike("[0-9]"), 0).when(c.rlike("[a-z]"), 1).when(c.rlike("[A-Z]"), 2)), lambda x: x.isNotNull())
    pairs = lambda a: F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.size(a)), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    m = F.greatest(F.size("kinds") - 1, F.lit(1)).cast("double")
    switches = F.size(F.filter(pairs(F.col("kinds")), lambda p: p["x"] != p["y"])).cast("double")
    z_runs = (switches - m * SWITCH - 0.5) / F.sqrt(m * SWITCH * (1 - SWITCH))
    rows = sealed(rows.withColumn("kinds", kinds), ["kinds"])
    serial = F.aggregate(pairs(F.col("at")), F.lit(0.0), lambda acc, p: acc + F.cos((p["x"] - p["y"]) * 2 * math.pi / k)) / F.sqrt((n - 1) / 2)
    half = F.size(F.filter(pairs(F.col("at")), lambda p: (p["x"] > k / 2) != (p["y"] > k / 2))).cast("double")
    runs = (half - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    z = F.when(F.col("encoding").isin(*ONE_KIND), z_chi).otherwise((z_chi + z_runs) / math.sqrt(2))
    return rows.withColumns({"p": upper_tail(z), "serial": serial, "runs": runs}).drop("alphabet", "chars", "at", "kinds")


def discoveries(cands: DataFrame, limit: float = 0.01, alone: float = 0.1, order: float = 13.8) -> DataFrame:
    """Rows that are random under a false-discovery limit per encoding and length class (powers of the square root of two).

    The written tokens of a class are estimated as twice those with a chance above one half, and one half more, all its tokens at most. No token
    passes above ``alone``, nor where the squares of its serial and runs z add up to more than ``order`` (a thousandth of random tokens).
    Chances are counted in bins of a tenth of a power of ten, each taken at its larger end, so the limit holds and the counts stay small.
    """
    rows = tested(cands).withColumn("size", F.floor(2 * F.log2(F.length("value").cast("double")))).withColumn(
        "bin", F.least(F.floor(-10 * F.log10(F.greatest("p", F.lit(1e-40)))), F.lit(BINS)))
    counts = rows.groupBy("encoding", "size", "bin").agg(F.count("*").alias("n"))
    same = Window.partitionBy("encoding", "size")
    written = F.least(2 * F.sum(F.when(F.col("bin") < HALF_BIN, F.col("n")).otherwise(0)).over(same) + 1, F.sum("n").over(same))
    counts = counts.withColumn("upto", F.sum("n").over(same.orderBy(F.desc("bin")))).withColumn("written", written)
    passed = counts.where(F.col("bin") >= -10 * math.log10(alone)).where(F.pow(F.lit(10.0), -F.col("bin") / 10) * F.col("written") <= limit * F.col("upto"))
    least = passed.groupBy("encoding", "size").agg(F.min("bin").alias("least"))
    return rows.join(least, ["encoding", "size"]).where((F.col("bin") >= F.col("least")) & (F.pow("serial", F.lit(2)) + F.pow("runs", F.lit(2)) <= order))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def scan(docs: DataFrame, limit: float = 0.01) -> DataFrame:
    """(doc_id, base, spans) for every row: spans of the base kinds, and all spans with those of kind ``random``.

    A null text is empty and has none. Rows of equal doc_id and text share their spans. Random tokens that a base span covers are left out.
    """
    text = F.coalesce("text", F.lit(""))
    found = stored(docs.select(F.col("doc_id"), F.xxhash64("text").alias("mark"), base_spans(text).alias("base"), tokens(text).alias("tokens")), "spans")
    cands = found.where("size(tokens) > 0").select("doc_id", "mark", F.explode("tokens").alias("t")).select("doc_id", "mark", "t.start", "t.value").distinct()
    hits = discoveries(stored(cands, "tokens"), limit).groupBy("doc_id", "mark").agg(F.collect_set(F.struct(
        "start", F.lit(3).alias("rank"), (F.col("start") + F.length("value")).alias("stop"), F.lit("random").alias("kind"))).alias("more"))
    hits = hits.withColumnsRenamed({"doc_id": "__doc", "mark": "__mark"})
    rows = found.join(hits, found["doc_id"].eqNullSafe(hits["__doc"]) & (found["mark"] == hits["__mark"]), "left")
    new = F.filter(F.coalesce(F.col("more").cast(SPANS), F.array().cast(SPANS)),
                   lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["stop"] >= s["stop"])))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", new)).alias("spans"))


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(table(spark, folder, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
