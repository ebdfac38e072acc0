"""Reconciling text lines located by boxes with the text and controls of the page they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veil import rules
from veil.functions.geometry import bottom, box
from veil.functions.text import has, jvm, normalize, trimmed
from veil.operators.boxes import touching
from veil.plans.ordered import each


def is_price(text: Column) -> Column:
    return has(text, rules.CURRENCY_AMOUNT) | has(text, rules.PRICE_LABEL_DIGITS) | (has(text, rules.PRICE_LABEL) & text.rlike("[0-9]{2,}"))


def price_amount(text: Column) -> Column:
    """Integer at the end of a line; commas and decimals are dropped."""
    digits = F.regexp_replace(F.regexp_extract(text, jvm(rules.TRAILING_AMOUNT), 1), ",", "")
    return F.nullif(digits, F.lit("")).try_cast("double")


def match_buttons(lines: DataFrame, buttons: DataFrame, on: list[str], key: list[str], text: str = "text") -> DataFrame:
    """Per line the first button of the lowest tier: same words, same letters (5 or more), or a button label that begins
    or ends the line. ``buttons(on, button_pos, button_id, label)``. Adds tier and target, null when none.

    All three tiers are equi-joins; for the last, a line offers its own beginnings and ends as keys.
    """
    norm = normalize(F.col("label"))
    b = buttons.select(*on, "button_pos", "button_id", norm.alias("__n")).filter(F.col("__n") != "")
    b = b.groupBy(*on, "__n").agg(F.min(F.struct("button_pos", "button_id")).alias("__b"))
    names = lines.select(*on, normalize(F.col(text)).alias("__w")).distinct().filter(F.col("__w") != "")
    tight = F.regexp_replace("__w", " ", "")
    letters = b.withColumn("__c", F.regexp_replace("__n", " ", "")).filter(F.length("__c") >= 5).groupBy(*on, "__c").agg(F.min("__b").alias("__b"))
    exact = names.withColumn("__n", F.col("__w")).join(b, [*on, "__n"])
    same = names.withColumn("__c", tight).join(letters, [*on, "__c"])
    size = F.length("__w")
    ends = F.when(size > 5, F.flatten(F.transform(F.sequence(F.lit(5), F.least(size - 1, F.lit(rules.MAX_LABEL))), lambda n: F.array(
        F.left("__w", n), F.right("__w", n))))).otherwise(F.array().cast("array<string>"))
    edge = each(names, [*on, "__w"], F.array_distinct(ends), "__n").join(b.filter(F.length("__n") >= 5), [*on, "__n"])
    tiers = None
    for tier, hit in enumerate((exact, same, edge), 1):
        hit = hit.select(*on, "__w", F.struct(F.lit(tier).alias("tier"), F.col("__b.button_pos").alias("pos"), F.col("__b.button_id").alias("id")).alias("__m"))
        tiers = hit if tiers is None else tiers.unionByName(hit)
    best = tiers.groupBy(*on, "__w").agg(F.min("__m").alias("__m"))
    rows = lines.withColumn("__w", normalize(F.col(text))).join(best, [*on, "__w"], "left")
    return rows.withColumn("tier", F.col("__m.tier")).withColumn("target", F.col("__m.id")).drop("__w", "__m")


def observations(lines: DataFrame, buttons: DataFrame, page: list[str]) -> DataFrame:
    """Confident, non-blank lines typed as button (with its element), price or text."""
    kept = lines.filter((F.col("confidence") >= rules.MIN_CONFIDENCE) & (trimmed(F.col("text")) != "")).withColumn("text", trimmed(F.col("text")))
    rows = match_buttons(kept, buttons, page, ["line"])
    kind = F.when(F.col("target").isNotNull(), "button").when(is_price(F.col("text")), "price").otherwise("text")
    return rows.withColumn("kind", kind).withColumn("confidence", F.round("confidence", 2)).drop("tier")


def name_for_price(obs: DataFrame, page: list[str]) -> DataFrame:
    """Per price line the closest text line above it that overlaps horizontally (as-of join in space)."""
    prices = obs.filter(F.col("kind") == "price").withColumn("amount", price_amount(F.col("text"))).filter(F.col("amount").isNotNull()).select(
        *page, "line", "amount", F.col("bbox").alias("__p"))
    texts = obs.filter(F.col("kind") == "text").groupBy(*page, F.col("bbox").alias("__t")).agg(
        F.min(F.struct(F.col("line").alias("line"), F.col("text").alias("text"))).alias("__n"))
    t, p = F.col("__t"), F.col("__p")
    pairs = touching(prices, texts, page, box(p["x"], p["y"], p["width"], F.lit(0.0)), box(t["x"], t["y"], t["width"], t["height"] + rules.MAX_NAME_DISTANCE))
    above = pairs.filter((t["y"] < p["y"]) & (p["y"] - bottom(t) <= rules.MAX_NAME_DISTANCE)
                         & (t["x"] < p["x"] + p["width"]) & (p["x"] < t["x"] + t["width"]))
    nearest = above.groupBy(*page, "line", "amount").agg(F.max(F.struct(t["y"].alias("y"), (-F.col("__n.line")).alias("i"), F.col("__n.text").alias("text"))).alias("__m"))
    return nearest.select(*page, "line", "amount", F.col("__m.text").alias("display_name"), normalize(F.col("__m.text")).alias("name"))


def dom_prices(pages: DataFrame, page: list[str], text: str = "text") -> DataFrame:
    """Name line followed by a price line in page text; the last pair of a name wins."""
    pattern = F.lit(jvm(rules.DOM_PRICE))
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(text), pattern, F.lit(1)).alias("n"), F.regexp_extract_all(F.col(text), pattern, F.lit(2)).alias("a"))
    rows = pages.select(*page, F.posexplode(pairs).alias("pos", "p")).select(
        *page, "pos", normalize(F.col("p.n")).alias("name"), F.regexp_replace("p.a", ",", "").try_cast("double").alias("amount"))
    return rows.filter((F.col("name") != "") & F.col("amount").isNotNull()).groupBy(*page, "name").agg(F.max_by("amount", "pos").alias("amount"))


def fuse(obs: DataFrame, pages: DataFrame, page: list[str], text: str = "text") -> DataFrame:
    """Adds ``fate`` to every observation: button, price_duplicate, price_conflict, dom_duplicate or visual_only, and the
    conflict message. The page text wins. ``pages(page, text, labels array)``."""
    named = name_for_price(obs, page)
    known = dom_prices(pages, page, text).withColumnRenamed("amount", "dom_amount")
    priced = named.join(known, [*page, "name"]).select(*page, "line", "amount", "dom_amount", "display_name")
    whole = pages.select(*page, normalize(F.concat_ws(" ", F.col(text), F.array_join("labels", " "))).alias("__dom"))
    rows = obs.join(priced, [*page, "line"], "left").join(whole, page, "left")
    fate = (F.when(F.col("kind") == "button", "button")
            .when(F.col("dom_amount") == F.col("amount"), "price_duplicate").when(F.col("dom_amount").isNotNull(), "price_conflict")
            .when(F.contains(F.coalesce("__dom", F.lit("")), normalize(F.col("text"))), "dom_duplicate").otherwise("visual_only"))
    message = F.concat(F.col("display_name"), F.lit(": page text says "), F.col("dom_amount").cast("long").cast("string"), F.lit(", vision read "), F.col("text"))
    return rows.withColumn("fate", fate).withColumn("conflict", F.when(F.col("fate") == "price_conflict", message)).drop("__dom", "display_name")


def fusion_stats(fused: DataFrame, by: list[str]) -> DataFrame:
    fate = F.col("fate")
    return fused.groupBy(*by).agg(
        F.count("*").alias("lines"), F.count_if(fate.isin("price_duplicate", "dom_duplicate")).alias("duplicates_dropped"),
        F.count_if(fate == "visual_only").alias("visual_only"), F.count_if(fate == "button").alias("buttons_mapped"),
        F.count_if(fate == "price_conflict").alias("conflicts_dropped"))


def reconcile(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """Two sources by normalised key: match, conflict, left_only or right_only."""
    left = a.select(F.col(key).alias("key"), F.col(value).alias("left_value"))
    right = b.select(F.col(key).alias("key"), F.col(value).alias("right_value"))
    both = left.join(right, "key", "full_outer")
    state = (F.when(F.col("right_value").isNull(), "left_only").when(F.col("left_value").isNull(), "right_only")
             .when(F.abs(F.col("left_value") - F.col("right_value")) <= tolerance, "match").otherwise("conflict"))
    return both.withColumn("state", state)
