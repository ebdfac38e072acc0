"""Redaction: stable typed placeholders per scope, and the way back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from veil import rules
from veil.functions.detect import find_spans, leak_spans, values_only
from veil.functions.text import digits_of, has, jvm, let, trimmed
from veil.plans.ordered import each, numbered, sealed, seq_bucket
from veil.operators.known import textual_hits
from veil.session import settled, splits_for

PLACED = "array<struct<start:int,size:int,type:string,value:string,pass:int>>"
VAULT = "array<struct<placeholder:string,type:string,n:int,value:string>>"
PLACES = "array<struct<start:int,stop:int,mark:string>>"


def detect(df: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """Adds the detected spans of a text column."""
    return df.withColumn(name, find_spans(F.col(text)))


def detections(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per detected span: keys, start, type, value."""
    spans = each(df, keys, find_spans(F.col(text)), "s")
    return spans.select(*keys, F.col("s.start").alias("start"), F.col("s.type").alias("type"), F.col("s.value").alias("value"))


def pii_summary(found: DataFrame, levels: list[str]) -> DataFrame:
    """Counts per roll-up level, without values."""
    return found.rollup(*levels).agg(F.count("*").alias("n"))


# --- the two detection passes of one text -------------------------------------------------------


def _stand_in(s: Column) -> Column:
    return F.concat(F.lit("["), s["type"], F.lit("_0]"))


def _first_pass(text: Column, spans: Column) -> Column:
    """Text with numberless stand-ins, and the spans in its coordinates."""
    state = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"), F.array().cast(PLACED).alias("placed"))

    def step(acc: Column, s: Column) -> Column:
        ahead = F.concat(acc["out"], F.substring(text, acc["at"], s["start"] + 1 - acc["at"]))
        mark = F.struct(F.length(ahead).alias("start"), F.length(_stand_in(s)).alias("size"), s["type"].alias("type"),
                        s["value"].alias("value"), F.lit(1).alias("pass"))
        return F.struct((s["start"] + F.length(s["value"]) + 1).alias("at"), F.concat(ahead, _stand_in(s)).alias("out"),
                        F.array_append(acc["placed"], mark).alias("placed"))

    def finish(acc: Column) -> Column:
        return F.struct(F.concat(acc["out"], F.substring(text, acc["at"], F.length(text))).alias("text"),
                        acc["placed"].alias("placed"))

    return F.aggregate(spans, state, step, finish)


def two_passes(df: DataFrame, text: str) -> DataFrame:
    """Adds ``__text`` (stand-ins in place) and ``__placed``: detector spans, then what the verifier would still flag."""
    first = df.withColumn("__spans", values_only(find_spans(F.col(text))))
    plain = F.struct(F.col(text).alias("text"), F.array().cast(PLACED).alias("placed"))
    first = first.withColumn("__first", F.when(F.size("__spans") == 0, plain).otherwise(
        _first_pass(F.col(text), F.col("__spans"))))
    left = F.transform(values_only(leak_spans(F.col("__first.text"))), lambda s: F.struct(
        s["start"].alias("start"), F.length(s["value"]).alias("size"), s["type"].alias("type"),
        s["value"].alias("value"), F.lit(2).alias("pass")))
    return (first.withColumn("__placed", F.array_sort(F.concat(F.col("__first.placed"), left)))
            .withColumn("__text", F.col("__first.text")).drop("__spans", "__first"))


def _fill(text: Column, placed: Column, placeholder) -> Column:
    state = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    filled = F.aggregate(
        placed, state,
        lambda acc, s: F.struct(
            (s["start"] + s["size"] + 1).alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"], s["start"] + 1 - acc["at"]), placeholder(s)).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"], F.length(text))),
    )
    return F.when(F.size(placed) == 0, text).otherwise(filled)


# --- one text is one scope: no shuffle at all ----------------------------------------------------------


def registration_order(placed: Column) -> Column:
    """Spans in the order they enter the vault: by pass, and inside a pass from the last to the first."""
    return F.transform(
        F.array_sort(F.transform(placed, lambda s: F.struct(
            s["pass"].alias("pass"), (-s["start"]).alias("back"), s["type"].alias("type"), s["value"].alias("value")))),
        lambda s: F.struct(s["type"].alias("type"), s["value"].alias("value")))


def row_vault(placed: Column) -> Column:
    """Vault of a single text: ``[TYPE_n]`` by order of first registration, first type of a value wins."""
    entries = let(registration_order(placed), _numbered_by_type)
    return F.when(F.size(placed) == 0, F.array().cast(VAULT)).otherwise(entries)


def _numbered_by_type(ordered: Column) -> Column:
    by_type = [F.struct(F.lit(kind).alias("type"), F.array_distinct(F.transform(
        F.filter(ordered, lambda s: s["type"] == kind), lambda s: s["value"])).alias("values")) for kind in rules.PII_TYPES]

    def owned(t: Column) -> Column:
        # A value seen under two types belongs to the type that registered it first.
        return F.filter(t["values"], lambda v: F.get(F.filter(ordered, lambda s: s["value"] == v), 0)["type"] == t["type"])

    return F.flatten(F.transform(F.array(*by_type), lambda t: F.transform(
        owned(t), lambda v, i: F.struct(
            F.concat(F.lit("["), t["type"], F.lit("_"), (i + 1).cast("string"), F.lit("]")).alias("placeholder"),
            t["type"].alias("type"), (i + 1).cast("int").alias("n"), v.alias("value")))))


def _from_vault(vault: Column):
    return lambda s: F.get(F.filter(vault, lambda e: e["value"] == s["value"]), 0)["placeholder"]


def redact_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """Redacts every row as its own scope. Adds ``redacted`` and ``vault``; one scan, no shuffle, no Python."""
    rows = two_passes(df, text)
    rows = rows.withColumn("vault", row_vault(F.col("__placed")))
    rows = rows.withColumn("redacted", _fill(F.col("__text"), F.col("__placed"), _from_vault(F.col("vault"))))
    return sealed(rows.drop("__text", "__placed"), ["vault", "redacted"])


def rehydrate_rows(df: DataFrame, redacted: str = "redacted", vault: str = "vault", name: str = "restored") -> DataFrame:
    """Placeholders back to values, for rows that carry their own vault (local use only)."""
    text, entries = F.col(redacted), F.col(vault)
    marks = F.regexp_extract_all(text, F.lit(rules.PLACEHOLDER_IN_TEXT), F.lit(0))
    gaps = F.split(text, rules.PLACEHOLDER_IN_TEXT, -1)
    back = F.transform(marks, lambda m: F.coalesce(F.get(F.filter(entries, lambda e: e["placeholder"] == m), 0)["value"], m))
    pieces = F.zip_with(gaps, back, lambda gap, value: F.concat(gap, F.coalesce(value, F.lit(""))))
    return sealed(df.withColumn(name, F.array_join(pieces, "")), [name])


# --- many texts share a scope ---------------------------------------------------------------------------


def is_numeric_value(value: Column) -> Column:
    return has(value, r"^\+?[\d\s-]+$")


def canonical(value: Column) -> Column:
    """Equal for the variants a known value is replaced in: any spacing of the same digits, or any letter case."""
    raw = trimmed(value)
    digits = digits_of(raw)
    return (F.when(is_numeric_value(raw) & (F.length(digits) >= 4), digits)
            .when(is_numeric_value(raw), F.concat(F.lit("="), value)).otherwise(F.lower(raw)))


def known_pattern(value: Column) -> Column:
    """Regular expression for a known value and its variants; null when it is too short to be replaced."""
    raw = trimmed(value)
    digits = digits_of(raw)
    spaced = F.array_join(F.split(digits, ""), jvm(r"[\s-]*"))
    literal = F.regexp_replace(raw, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return (F.when(is_numeric_value(raw) & (F.length(digits) >= 4), F.concat(F.lit(r"(?<![\d+])\+?"), spaced, F.lit(r"(?!\d)")))
            .when(is_numeric_value(raw), F.lit(None)).when(F.length(raw) >= 3, F.concat(F.lit("(?iu)"), literal)))


def _occurrences(text: Column, entry: Column) -> Column:
    """Places (start, stop, mark) of a known value in a text, from the left and clear of each other; none for a value too short to be replaced."""
    none = F.array().cast(PLACES)

    def placed(found: Column, pattern: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        return F.aggregate(
            F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))),
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, p: F.struct(
                (acc["at"] + p["gap"] + p["size"]).alias("at"),
                F.array_append(acc["out"], F.struct((acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + p["size"]).alias("stop"),
                                                    entry["mark"].alias("mark"))).alias("out")),
            lambda acc: acc["out"])

    def of(pattern: Column) -> Column:
        return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found, pattern)))

    return let(known_pattern(entry["value"]), lambda p: F.coalesce(F.when(p.isNotNull(), of(p)), none))


def _spliced(text: Column, places: Column) -> Column:
    """The text with its (sorted, disjoint) places replaced by their marks."""
    def pieces(own: Column) -> Column:
        ahead = lambda i: F.coalesce(F.get(own, i - 1)["stop"], F.lit(0))
        return F.transform(own, lambda p, i: F.concat(F.substring(text, ahead(i) + 1, p["start"] - ahead(i)), p["mark"]))

    return let(places, lambda own: F.concat(F.array_join(pieces(own), ""), F.substring(text, F.coalesce(F.element_at(own, -1)["stop"], F.lit(0)) + 1, F.length(text))))


def replace_listed(text: Column, entries: Column) -> Column:
    """A text with the known values of an array of (size, order, value, mark) replaced, all of them found in the text as it stands.

    The longest value claims its places first, equal lengths in order of registration; a place that touches a claimed one is left. Marks are
    put in once, at the end, so no value is ever looked for inside a placeholder.
    """
    ordered = F.array_sort(entries, lambda a, b: F.coalesce(
        F.nullif((b["size"] - a["size"]).cast("int"), F.lit(0)),
        F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1)
        .when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0)))
    claimed = F.aggregate(ordered, F.array().cast(PLACES), lambda taken, e: F.concat(taken, F.filter(
        _occurrences(text, e), lambda p: ~F.exists(taken, lambda t: (p["start"] < t["stop"]) & (p["stop"] > t["start"])))))
    return F.coalesce(F.when(F.size(entries) > 0, _spliced(text, F.array_sort(claimed))), text)


def _number_keys(text: Column, longest: Column) -> Column:
    """Digit strings of at most ``longest`` digits of all sequences of neighbouring digit groups (blanks and dashes between).

    A group has a digit at least, so a group starts at most ``longest`` sequences: the cost is linear in the length of a table of numbers.
    """
    runs = F.regexp_extract_all(text, F.lit(jvm(r"\d[\d\s-]*")), F.lit(0))

    def windows(run: Column) -> Column:
        return let(F.regexp_extract_all(run, F.lit(r"\d+"), F.lit(0)), lambda groups: F.flatten(F.transform(groups, lambda _g, i: F.transform(
            F.sequence(F.lit(1), F.least(F.size(groups) - i, longest)), lambda n: F.array_join(F.slice(groups, i + 1, n), "")))))

    return F.array_distinct(F.filter(F.flatten(F.transform(runs, windows)), lambda d: F.length(d) <= longest))


def known_present(texts: DataFrame, vault: DataFrame, row_keys: list[str], text: str) -> DataFrame:
    """(scope, row keys, vault columns) for values that may occur in a text of their scope: equi-joins on digit strings and on the values'
    beginnings, so neither a whole vault nor a whole scope meets in one task."""
    numeric = vault.filter(is_numeric_value(F.col("value"))).withColumn("__key", canonical(F.col("value")))
    longest = numeric.groupBy("scope").agg(F.max(F.length("__key")).alias("__longest"))
    by_number = each(texts.join(longest, "scope"), ["scope", *row_keys], _number_keys(F.col(text), F.col("__longest")), "__key").join(
        numeric, ["scope", "__key"]).drop("__key")
    textual = vault.filter(~is_numeric_value(F.col("value")))
    return by_number.unionByName(textual_hits(texts, textual, ["scope"], row_keys, text))


def replace_known(texts: DataFrame, vault: DataFrame, row_keys: list[str], text: str = "text", name: str = "replaced",
                  splits: int | None = None) -> DataFrame:
    """Replaces known values of the scope in every text; one way for vaults of any size.

    ``texts(scope, seq, row_keys..., text)``; ``vault(scope, value, mark, since)``, and ``order`` where values of one row must keep an order. A
    value is known to rows with ``seq > since``. Only values that occur in a text reach its row, where they claim their places
    (``replace_listed``); with ``splits`` the rows are dealt out into so many before that.
    """
    if "order" not in vault.columns:
        vault = vault.withColumn("order", F.struct(F.col("since").cast("long").alias("seq"), F.lit(0).alias("pass"), F.lit(0).alias("back")))
    vault = settled(vault.select("scope", "value", "mark", F.col("since").cast("long").alias("since"), "order"))
    keys = list(dict.fromkeys(["seq", *row_keys]))
    present = known_present(texts.select("scope", *keys, text), vault, keys, text).filter(F.col("since") < F.col("seq"))
    entry = F.struct(F.length("value").alias("size"), "order", "value", "mark")
    listed = present.groupBy("scope", *keys).agg(F.collect_set(entry).alias("__listed"))
    rows = texts.join(listed, ["scope", *keys], "left")
    rows = rows if splits is None else rows.repartition(splits)
    out = F.when(F.col("__listed").isNull(), F.col(text)).otherwise(replace_listed(F.col(text), F.col("__listed")))
    return rows.withColumn(name, out).drop("__listed")


def first_registrations(found: DataFrame) -> DataFrame:
    """(scope, value) with its first type and order, from rows (scope, seq, pass, back, type, value)."""
    order = F.struct("seq", "pass", "back")
    return (found.groupBy("scope", "value")
            .agg(F.min(F.struct(order.alias("order"), F.col("type").alias("type"))).alias("first"))
            .select("scope", "value", F.col("first.type").alias("type"), F.col("first.order.seq").alias("seq"),
                    F.col("first.order.pass").alias("pass"), F.col("first.order.back").alias("back")))


def assign_placeholders(found: DataFrame, width: int = 100_000) -> DataFrame:
    """Vault (scope, value, type, n, placeholder): numbers per scope and type in order of first registration.

    Distinct values are formed by a combining aggregate first; the numbering is bucketed by ``seq``, so one scope
    with very many values is spread over tasks.
    """
    n = numbered(first_registrations(found), ["scope", "type"], seq_bucket(F.col("seq"), width),
                 [F.col("seq"), F.col("pass"), F.col("back"), F.col("value")], "n")
    mark = F.concat(F.lit("["), F.col("type"), F.lit("_"), F.col("n").cast("string"), F.lit("]"))
    return n.withColumn("placeholder", mark)


def _placed_rows(rows: DataFrame) -> DataFrame:
    return (each(rows, ["scope", "seq"], F.col("__placed"), "s")
            .select("scope", "seq", F.col("s.pass").alias("pass"), (-F.col("s.start")).alias("back"),
                    F.col("s.type").alias("type"), F.col("s.value").alias("value")))


def _registered(step: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """Vault of what a step found: seeds first, then values in order of registration, numbered per type."""
    found = _placed_rows(step)
    if seeds is not None:
        found = found.unionByName(seeds.select("scope", F.col("seq").cast("long").alias("seq"), F.lit(0).alias("pass"),
                                               F.lit(0).alias("back"), "type", "value"))
    return settled(assign_placeholders(settled(first_registrations(found))))


def redact(df: DataFrame, row_keys: list[str], text: str = "text", scope: str = "scope", seq: str = "seq",
           seeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Redacts texts that share a scope, in ``seq`` order. Returns (rows with ``redacted``, vault).

    ``seeds(scope, seq, type, value)`` enter the vault before any text (form fields, values read from lines); their
    ``seq`` must be below every text's. In every row, values known from earlier rows are replaced first, in all their
    variants and with their final placeholders; the detector and the verifier's patterns then run on what is left.

    What a row registers depends on the values before it, so the vault is found as a fixed point: from the values of the
    texts as they stand, each round replaces what the vault knows and registers what is still found. After round n the
    first n rows of every scope are settled, and a round usually settles all but those where one value cuts another. A scope
    whose vault a round left as it was is done: later rounds read only the texts and values of scopes that moved.
    """
    given = settled(df.withColumn("scope", F.col(scope)).withColumn("seq", F.col(seq).cast("long")))
    splits = splits_for(given)  # detection takes seconds a MB
    texts = given.repartition(splits)
    vault = _registered(two_passes(texts, text), seeds)
    entry = ["scope", "value", "type", "seq", "placeholder"]
    order = F.struct("seq", "pass", "back")
    steps, vaults = [], []
    while True:
        marks = vault.select("scope", "value", F.col("seq").alias("since"), F.col("placeholder").alias("mark"), order.alias("order"))
        step = settled(two_passes(replace_known(texts, marks, row_keys, text, "__known", splits), "__known"))
        again = _registered(step, seeds)
        moved = again.select(*entry).exceptAll(vault.select(*entry)).unionByName(vault.select(*entry).exceptAll(again.select(*entry)))
        moved = settled(moved.select("scope").distinct())
        steps.append(step.join(moved, "scope", "left_anti"))
        vaults.append(again.join(moved, "scope", "left_anti"))
        if moved.isEmpty():
            break
        texts, vault = texts.join(moved, "scope", "left_semi"), again.join(moved, "scope", "left_semi")
        seeds = None if seeds is None else seeds.join(moved, "scope", "left_semi")
    step, vault = reduce(DataFrame.unionByName, steps), reduce(DataFrame.unionByName, vaults)
    # A value found is one lookup in the vault, by (scope, value).
    found = F.array_distinct(F.transform("__placed", lambda s: s["value"]))
    lookups = (each(step, ["scope", *row_keys], found, "value")
               .join(vault.select("scope", "value", "placeholder"), ["scope", "value"])
               .groupBy("scope", *row_keys).agg(F.collect_list(F.struct("value", "placeholder")).alias("__own")))
    rows = step.join(lookups, ["scope", *row_keys], "left")
    filled = _fill(F.col("__text"), F.col("__placed"), _from_vault(F.col("__own")))
    return rows.withColumn("redacted", filled).drop("__text", "__placed", "__known", "__own"), vault


def rehydrate(df: DataFrame, vault: DataFrame, row_keys: list[str], text: str = "redacted", name: str = "restored") -> DataFrame:
    """Placeholders back to values by an equi-join on (scope, placeholder) with the protected vault."""
    marks = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(rules.PLACEHOLDER_IN_TEXT), F.lit(0)))
    own = (each(df, ["scope", *row_keys], marks, "placeholder")
           .join(vault.select("scope", "placeholder", "value"), ["scope", "placeholder"])
           .groupBy("scope", *row_keys).agg(F.collect_list(F.struct("placeholder", "value")).alias("__vault")))
    return rehydrate_rows(df.join(own, ["scope", *row_keys], "left").withColumn(
        "__vault", F.coalesce("__vault", F.array().cast("array<struct<placeholder:string,value:string>>"))),
        text, "__vault", name).drop("__vault")


def redact_for_log(text: Column) -> Column:
    """Value-free form of a text when no vault exists: long digit runs become [NUMBER]."""
    return F.regexp_replace(text, "[0-9]{6,}", "[NUMBER]")


def resolve_type(placeholder: Column) -> Column:
    return F.nullif(F.regexp_extract(placeholder, r"^\[([A-Z]+)_[0-9]+\]\z", 1), F.lit(""))


def redact_with_context(df: DataFrame, text: str, context: str, name: str = "redacted") -> DataFrame:
    """Redacts an element's text with its field context in front, then takes the prefix off again.

    When the prefix itself was redacted the bare text is redacted instead.
    """
    prefix = F.concat(F.col(context), F.lit(": "))
    plain = (F.col(context) == "") | (F.col(text) == "")
    both = redact_rows(df.withColumn("__in", F.when(plain, F.col(text)).otherwise(F.concat(prefix, F.col(text)))), "__in")
    both = both.withColumnRenamed("redacted", "__with").drop("vault")
    bare = redact_rows(both, text).withColumnRenamed("redacted", "__bare").drop("vault")
    kept = F.when(plain, F.col("__bare")).when(
        F.col("__with").startswith(prefix), F.substring(F.col("__with"), F.length(prefix) + 1, F.length("__with"))
    ).otherwise(F.col("__bare"))
    return bare.withColumn(name, kept).drop("__in", "__with", "__bare")
