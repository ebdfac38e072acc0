"""Classification of form fields by weighted evidence, all inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veil import rules
from veil.functions.detect import keyword_types, value_shape
from veil.functions.text import let
from veil.plans.ordered import sealed, where

VOTES = "array<struct<type:string,weight:int,signal:string>>"
ATTRIBUTES = [("name", "name"), ("id", "id"), ("class", "class"), ("placeholder", "placeholder"), ("aria_label", "aria-label"), ("field_label", "label")]


def _vote(kind: Column, weight: int, signal: Column) -> Column:
    return F.struct(kind.alias("type"), F.lit(weight).alias("weight"), signal.alias("signal"))


def _lookup(pairs: list[tuple[str, str]], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), key)


def strong_votes() -> Column:
    """Input type and autocomplete tokens, weight 3."""
    kind = F.lower(F.coalesce("input_type", F.lit("")))
    by_type = F.array(_vote(_lookup(rules.INPUT_TYPE_RULES, kind), rules.STRONG, F.concat(F.lit("type="), kind)))
    tokens = F.split(F.lower(F.coalesce("autocomplete", F.lit(""))), r"\s+")
    by_token = F.transform(tokens, lambda t: _vote(_lookup(rules.AUTOCOMPLETE_RULES, t), rules.STRONG, F.concat(F.lit("autocomplete="), t)))
    return F.filter(F.concat(by_type, by_token), lambda v: v["type"].isNotNull())


def keyword_votes() -> Column:
    """Keywords in naming attributes (weight 2 each) and in nearby text (weight 1)."""
    def of(column: str, name: str, weight: int) -> Column:
        return F.transform(keyword_types(F.coalesce(column, F.lit(""))), lambda t: _vote(t, weight, F.concat(F.lit(name + "~"), F.lower(t))))

    return F.concat(*[of(c, n, rules.MEDIUM) for c, n in ATTRIBUTES], of("nearby", "nearby", rules.WEAK))


def shape_votes() -> Column:
    kind = value_shape(F.coalesce("value", F.lit("")))
    return F.filter(F.array(_vote(kind, rules.WEAK, F.concat(F.lit("value-shape~"), F.lower(kind)))), lambda v: v["type"].isNotNull())


def classify_fields(fields: DataFrame) -> DataFrame:
    """Adds ``type``, ``score`` and ``signals`` (evidence names, never values); null type below the threshold.

    Highest score wins, then strong evidence, then the fixed type order.
    """
    def entry(votes: Column, kind: str, rank: int) -> Column:
        mine = F.filter(votes, lambda v: v["type"] == kind)
        score = F.aggregate(mine, F.lit(0), lambda acc, v: acc + v["weight"])
        strong = F.exists(mine, lambda v: v["weight"] >= rules.STRONG).cast("int")
        return F.struct(score.alias("score"), strong.alias("strong"), F.lit(-rank).alias("rank"), F.lit(kind).alias("type"),
                        F.transform(mine, lambda v: v["signal"]).alias("signals"))

    votes = F.concat(strong_votes(), keyword_votes(), shape_votes()).cast(VOTES)
    rows = fields.withColumn("__best", let(votes, lambda all_votes: F.array_max(F.array(
        *[entry(all_votes, kind, rank) for rank, kind in enumerate(rules.PII_TYPES)]))))
    counts = F.col("__best.score") >= rules.FIELD_THRESHOLD
    out = (rows.withColumn("type", F.when(counts, F.col("__best.type"))).withColumn("score", F.when(counts, F.col("__best.score")))
            .withColumn("signals", F.when(counts, F.col("__best.signals"))).drop("__best"))
    return sealed(out, ["type", "score", "signals"])


def field_seeds(classified: DataFrame, scope: str, seq: Column | int = 0) -> DataFrame:
    """Values of sensitive fields, as the first entries of their scope's vault; ``seq`` orders the fields, and the first type of a value wins."""
    kept = where(classified, F.col("type").isNotNull() & (F.trim("value") != ""))
    return kept.select(F.col(scope).alias("scope"), (F.lit(seq) if isinstance(seq, int) else seq).cast("long").alias("seq"), "type", F.trim("value").alias("value"))


def line_seeds(found: DataFrame, scope: str, seq: int = 1) -> DataFrame:
    """Values read from lines (in-line and layout), entered before any page text is redacted."""
    return found.select(F.col(scope).alias("scope"), F.lit(seq).cast("long").alias("seq"), "type", "value")
