"""Personal-data detection in free text, as column expressions (no shuffle, no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veil import rules
from veil.functions.text import (
    claim, digits_of, group, has, match_list, match_spans, no_spans, span, sub, trimmed,
)


PAIRS = "array<struct<start:int,label:string,tail:string>>"


def luhn_valid(value: Column) -> Column:
    digits = digits_of(value)
    return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))


def looks_like_identifier(text: Column, start: Column) -> Column:
    """The 40 characters before ``start`` name an order or reference number, and no phone."""
    reach = F.least(start, F.lit(rules.CONTEXT_WINDOW))
    before = F.substring(text, start - reach + 1, reach)
    return has(before, rules.IDENTIFIER_BEFORE) & ~has(before, rules.PHONE_BEFORE)


def _not_identifier(text: Column):
    return lambda s: ~looks_like_identifier(text, s["start"])


def _holds(text: Column, *marks: str) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | F.contains(text, F.lit(mark))
    return found


def email_spans(text: Column) -> Column:
    return match_spans(text, rules.EMAIL, "EMAIL", _holds(text, "@"))


def _long_number(text: Column) -> Column:
    return text.rlike("[0-9][0-9 -]{11}")


def card_span_lists(text: Column) -> list[Column]:
    return [F.filter(match_spans(text, p, "CARD", _long_number(text)), lambda s: luhn_valid(s["value"]))
            for p in rules.CARDS]


def phone_span_lists(text: Column) -> list[Column]:
    guards = [text.rlike("[6-9][0-9]{4}"), _holds(text, "+"), text.rlike("[0-9]{3}")]
    return [F.filter(match_spans(text, p, "PHONE", guard), _not_identifier(text))
            for p, guard in zip(rules.PHONES, guards)]


def labelled_kind(label: Column, value: Column) -> Column:
    """Type named by an in-line label, null unless the value has that type's shape."""
    kind = F.lit(None).cast("string")
    for label_pattern, name, shape in reversed(rules.LABELLED_SHAPES):
        kind = F.when(has(label, label_pattern), F.when(has(value, shape), F.lit(name))).otherwise(kind)
    return kind


def labelled_spans(text: Column) -> Column:
    """'Label: value' pairs. The value ends the match, so its start follows from the lengths."""
    found = match_list(text, rules.LABELLED, _holds(text, ":", "="), ["$1", "$0", "$2"], 1, F.array().cast(PAIRS), lambda start, match: F.struct(
        (start + F.length(match[1]) - F.length(match[2])).cast("int").alias("start"), match[0].alias("label"),
        F.right(match[1], F.length(match[2])).alias("tail")))
    # Label and value are bound before they are tested: each is looked at by several patterns.
    pairs = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["label"].alias("label"), sub(m["tail"], r"[.,;:]+$", "").alias("value")))

    def typed(m: Column) -> Column:
        kind = F.when(has(m["value"], rules.PLACEHOLDER_ANY), F.lit(None)).otherwise(labelled_kind(m["label"], m["value"]))
        return span(m["start"], kind, m["value"])

    return F.filter(F.transform(pairs, typed), lambda s: s["type"].isNotNull())


def find_spans(text: Column) -> Column:
    """All personal data in a text: labelled values, then e-mails, cards, phones; earlier claims win."""
    lists = [labelled_spans(text), email_spans(text), *card_span_lists(text), *phone_span_lists(text)]
    worth_it = _holds(text, "@", ":", "=") | text.rlike("[0-9]{3}")
    return F.when(worth_it, claim(lists)).otherwise(no_spans())


def leak_spans(text: Column) -> Column:
    """Spans the independent verifier would flag: e-mail, Luhn digit run, mobile outside identifier context."""
    cards = F.filter(match_spans(text, rules.LEAK_CARD, "CARD", _long_number(text)), lambda s: luhn_valid(s["value"]))
    mobiles = F.filter(match_spans(text, rules.LEAK_MOBILE, "PHONE", text.rlike("[6-9][0-9]{4}")), _not_identifier(text))
    worth_it = _holds(text, "@") | text.rlike("(?:[0-9][ -]?){3}")
    return F.when(worth_it, claim([email_spans(text), cards, mobiles])).otherwise(no_spans())


def values_only(spans: Column) -> Column:
    """Spans without existing placeholders."""
    return F.filter(spans, lambda s: ~has(s["value"], rules.PLACEHOLDER_ANY))


# --- form fields ------------------------------------------------------------------------


def keyword_types(text: Column) -> Column:
    """Types whose keywords occur in an attribute; underscores and dashes read as blanks."""
    spaced = F.regexp_replace(text, "[_-]+", " ")
    votes = F.array(*[F.when(has(spaced, p), F.lit(kind)) for p, kind in rules.KEYWORD_RULES])
    return F.array_distinct(F.array_compact(votes))


def label_type(text: Column) -> Column:
    """Type named by a label text: the first keyword rule that matches."""
    spaced = F.regexp_replace(text, "[_-]+", " ")
    return F.coalesce(*[F.when(has(spaced, p), F.lit(kind)) for p, kind in rules.KEYWORD_RULES])


def matches_shape(kind: Column, value: Column) -> Column:
    clean = trimmed(value)
    test = F.lit(False)
    for name, pattern in rules.TYPE_SHAPES:
        test = F.when(kind == name, has(clean, pattern)).otherwise(test)
    return test


def value_shape(value: Column) -> Column:
    """Type suggested by a field's current value, null when none."""
    clean = trimmed(value)
    kind = F.coalesce(
        F.when(luhn_valid(clean) & has(clean, r"^[\d\s-]+$"), F.lit("CARD")),
        *[F.when(has(clean, p), F.lit(name)) for p, name in rules.VALUE_SHAPES],
    )
    return F.when(clean != "", kind)
