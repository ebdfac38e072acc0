"""Which known values occur in which texts, by equi-joins instead of comparing every text with every value.

A text has a place for a value at every character, so places are tested before any of them becomes a row: the beginnings of all values are
bits of one bitmap of fixed size, built by a distributed bit-or, and only places whose own beginning is a set bit are joined and verified.
Before that a regular expression leaves out all places that hold a character which no value's beginning has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veil import rules
from veil.functions.text import digits_of, has, jvm, let, trimmed
from veil.plans.ordered import each
from veil.session import settled

LOCAL_CHARS = 6
GRAM_SIZES = [(3, 6), (6, 12), (12, 1 << 30)]
#: Bits of the bitmap (128 KB, however many values there are), in words of 64; and the characters of a piece of text that is searched.
BITS, WORD, PIECE = 1 << 20, 64, 64
#: Different characters of beginnings up to which texts are searched in their runs of such characters only; beyond it everywhere.
ALPHABET = 1000


def _at_keys(low: Column) -> Column:
    """For every '@': the 0..6 characters before it, as one key each."""
    parts = F.split(low, "@", -1)
    heads = F.slice(parts, 1, F.size(parts) - 1)
    return F.array_distinct(F.flatten(F.transform(heads, lambda h: F.transform(
        F.sequence(F.lit(0), F.least(F.length(h), F.lit(LOCAL_CHARS))), lambda n: F.right(h, n)))))


def _key(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _place(key: Column) -> tuple[Column, Column]:
    """Word and bit of a key in the bitmap."""
    bit = key.bitwiseAND(F.lit(BITS - 1))
    return F.shiftright(bit, 6).cast("int"), bit.bitwiseAND(F.lit(WORD - 1)).cast("int")


def bitmaps(values: DataFrame) -> dict[int, Column]:
    """A bitmap of the keys of each beginning's ``size`` that occurs, from rows (size, key): at most 3 x 16,384 words reach the driver."""
    word, bit = _place(F.col("key"))
    words = values.groupBy("size", word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(key & {WORD - 1} AS INT))")).alias("bits"))
    out: dict[int, dict[int, int]] = {}
    for r in words.collect():
        out.setdefault(r["size"], {})[r["word"]] = r["bits"]
    lists = {size: "[" + ",".join(str(held.get(i, 0)) for i in range(BITS // WORD)) + "]" for size, held in out.items()}
    return {size: F.from_json(F.lit(text), "array<bigint>") for size, text in lists.items()}


def alphabets(heads: DataFrame) -> dict[int, str]:
    """A regular expression of the characters that beginnings are made of, by their ``size``, from rows (size, head); none where they are many."""
    chars = heads.select("size", F.explode(F.split("head", "")).alias("char")).where("char <> ''").distinct()
    rows = chars.groupBy("size").agg(F.slice(F.collect_list("char"), 1, ALPHABET + 1).alias("chars")).collect()
    return {r["size"]: "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(r["chars"])) + "]" for r in rows if len(r["chars"]) <= ALPHABET}


def _grams(low: Column, size: int, on: list[str], bits: Column, alphabet: str | None) -> Column:
    """Keys of the distinct runs of ``size`` characters that a bitmap holds. Texts are cut into pieces first, so the cost is linear; with an
    ``alphabet`` only runs of its characters are searched."""
    def held(key: Column) -> Column:
        word, bit = _place(key)
        return F.getbit(F.get(bits, word), bit) == 1

    def of(piece: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(1), F.length(piece) - size + 1), lambda i: _key(*[F.col(c) for c in on], F.substring(piece, i, F.lit(size))))
        return F.when(F.length(piece) >= size, F.filter(keys, held)).otherwise(F.array().cast("array<bigint>"))

    def pieces(parts: Column) -> Column:
        # A piece goes on into the next one by what its last place needs.
        return F.transform(parts, lambda p, i: F.concat(p, F.left(F.coalesce(F.get(parts, i + 1), F.lit("")), F.lit(size - 1))))

    def searched(text: Column) -> Column:
        cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        return F.flatten(F.transform(let(cut, pieces), lambda p: let(p, of)))

    if alphabet is None:
        return F.array_distinct(searched(low))
    # A beginning lies within one longest run of its characters.
    runs = F.regexp_extract_all(low, F.lit(f"{alphabet}{{{size},}}+"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(runs, searched)))


def textual_hits(texts: DataFrame, values: DataFrame, on: list[str], row_keys: list[str], text: str) -> DataFrame:
    """(row keys, value columns) for every value contained in a text, any letter case.

    Values with '@' meet texts on the characters before an '@'; others on their leading 3, 6 or 12 characters, which are a bitmap first. Only
    row keys and hashes of places that the bitmap holds are shuffled; a text is read again for its few candidates.
    """
    low = F.lower(F.col(text))
    own = [F.col(c) for c in on]
    lowered = values.withColumn("__low", F.lower(trimmed(F.col("value"))))
    at = lowered.filter(F.contains("__low", F.lit("@"))).withColumn(
        "__key", _key(F.right(F.substring_index("__low", "@", 1), F.lit(LOCAL_CHARS))))
    heads = F.transform(_at_keys(low), lambda h: _key(h))
    candidates = each(texts.filter(F.contains(F.col(text), F.lit("@"))), [*on, *row_keys], heads, "__key").join(at, [*on, "__key"])
    size = F.when(F.length("__low") < GRAM_SIZES[0][0], F.lit(None).cast("int"))
    for least, above in GRAM_SIZES:
        size = size.when(F.length("__low") < above, least)
    other = lowered.filter(~F.contains("__low", F.lit("@"))).withColumn("__size", size).filter(F.col("__size").isNotNull())
    other = other.withColumn("__key", _key(*own, F.left("__low", F.col("__size"))))
    letters = alphabets(other.select(F.col("__size").alias("size"), F.left("__low", F.col("__size")).alias("head")))
    for least, bits in bitmaps(other.select(F.col("__size").alias("size"), F.col("__key").alias("key"))).items():
        sized = other.filter(F.col("__size") == least).drop("__size")
        candidates = candidates.unionByName(each(texts, [*on, *row_keys], _grams(low, least, on, bits, letters.get(least)), "__key").join(sized, [*on, "__key"]))
    candidates = candidates.drop("__key").distinct()
    met = candidates.join(texts.select(*on, *row_keys, text), [*on, *row_keys])
    return met.filter(F.contains(low, F.col("__low"))).drop("__low", text).distinct()


def known_value_hits(bodies: DataFrame, vault: DataFrame, row_keys: list[str], body: str = "body",
                     on: list[str] | None = None) -> DataFrame:
    """(row keys, type, value) for every known value that leaks into a body.

    Digit values of six or more digits must stand digit-bounded in the body without blanks and dashes, i.e. equal a
    maximal digit run of it: an equi-join on runs. Other values of three or more characters: any case.
    """
    on = on or []
    raw = trimmed(F.col("value"))
    values = settled(vault.filter(F.length(raw) >= rules.MIN_KNOWN).select(*on, "type", "value"))  # read by every join below
    numeric = has(F.col("value"), r"^\s*[\d\s-]+$")
    digits = values.filter(numeric).withColumn("__run", digits_of(F.col("value"))).filter(
        F.length("__run") >= rules.MIN_KNOWN_DIGITS)
    runs = F.array_distinct(F.regexp_extract_all(
        F.regexp_replace(F.col(body), jvm(r"[\s-]"), ""), F.lit(rf"[0-9]{{{rules.MIN_KNOWN_DIGITS},}}"), F.lit(0)))
    by_digits = each(bodies, [*on, *row_keys], runs, "__run").join(digits, [*on, "__run"]).drop("__run")
    by_text = textual_hits(bodies.select(*on, *row_keys, body), values.filter(~numeric), on, row_keys, body)
    return by_digits.select(*on, *row_keys, "type", "value").unionByName(by_text.select(*on, *row_keys, "type", "value"))
