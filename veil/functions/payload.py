"""Checks on a serialised request body. Each returns a value-free reason, null when the check passes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veil import rules
from veil.functions.detect import leak_spans
from veil.functions.text import bounded_digits, digits_of, has, jvm, let, trimmed


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _object(v: Column) -> Column:
    return F.when(F.startswith(_kind(v), F.lit("OBJECT")), F.try_variant_get(v, "$", "map<string,variant>"))


def _list(v: Column) -> Column:
    return F.when(F.startswith(_kind(v), F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>"))


def _at(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def _is_text(v: Column) -> Column:
    return F.coalesce(_kind(v) == "STRING", F.lit(False))


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _is_null(v: Column) -> Column:
    return F.coalesce(_kind(v) == "VOID", F.lit(False))


def _is_number(v: Column) -> Column:
    return F.coalesce(_kind(v).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.lit(False))


def _has_keys(m: Column, required: list[str], optional: list[str] = []) -> Column:
    keys = F.map_keys(m)
    missing = F.array_except(F.array(*[F.lit(k) for k in required]), keys)
    extra = F.array_except(keys, F.array(*[F.lit(k) for k in required + optional]))
    return F.coalesce((F.size(missing) == 0) & (F.size(extra) == 0), F.lit(False))


def _has(m: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(m, F.lit(key)), F.lit(False))


def _fail(cond: Column, reason: str) -> Column:
    return F.when(cond, F.lit(reason))


def _text_within(v: Column, limit: int) -> Column:
    return _is_text(v) & (F.length(_text(v)) <= limit)


def _in(v: Column, allowed: list[str]) -> Column:
    return _is_text(v) & F.coalesce(_text(v).isin(allowed), F.lit(False))


def _first_reason(items: Column, reason) -> Column:
    return F.get(F.array_compact(F.transform(items, reason)), 0)


def _element_reason(v: Column) -> Column:
    return let(_object(v), _element_reason_of)


def _element_reason_of(m: Column) -> Column:
    options = _list(_at(m, "options"))
    good_options = F.coalesce((F.size(options) <= rules.MAX_OPTIONS) & F.forall(
        options, lambda o: _text_within(o, rules.MAX_OPTION)), F.lit(False))
    return F.coalesce(
        _fail(~_has_keys(m, rules.ELEMENT_KEYS, rules.ELEMENT_OPTIONAL), "element has unexpected shape"),
        *[_fail(~_is_text(_at(m, k)), "element fields are not strings") for k in rules.ELEMENT_KEYS],
        _fail(_has(m, "context") & ~_text_within(_at(m, "context"), rules.MAX_CONTEXT), "element context invalid"),
        _fail(_has(m, "options") & ~good_options, "element options invalid"),
    )


def _history_entry_reason(v: Column) -> Column:
    return let(_object(v), _history_entry_reason_of)


def _history_entry_reason_of(m: Column) -> Column:
    target, value = _at(m, "target"), _at(m, "value")
    return F.coalesce(
        _fail(~_has_keys(m, rules.HISTORY_KEYS, rules.HISTORY_OPTIONAL), "history entry has unexpected shape"),
        _fail(~_in(_at(m, "action"), rules.ACTIONS), "history entry has unknown action"),
        _fail(~(_is_null(target) | _is_text(target)), "history target invalid"),
        _fail(~(_is_null(value) | _text_within(value, rules.MAX_HISTORY_VALUE)), "history value invalid"),
        _fail(_has(m, "effect") & ~_in(_at(m, "effect"), rules.EFFECTS), "history effect invalid"),
        _fail(_has(m, "note") & ~_text_within(_at(m, "note"), rules.MAX_NOTE), "history note invalid"),
    )


def check_history(v: Column) -> Column:
    return let(_list(v), _check_history_of)


def _check_history_of(entries: Column) -> Column:
    return F.coalesce(
        _fail(entries.isNull(), "history is not a list"),
        _fail(F.size(entries) > rules.MAX_HISTORY, "history is too long"),
        _first_reason(entries, _history_entry_reason),
    )


def _observation_reason(v: Column) -> Column:
    return let(_object(v), _observation_reason_of)


def _observation_reason_of(m: Column) -> Column:
    box, target = _object(_at(m, "bbox")), _at(m, "target")
    numbers = F.lit(True)
    for key in rules.BBOX_KEYS:
        numbers = numbers & _is_number(_at(box, key))
    return F.coalesce(
        _fail(~_has_keys(m, rules.OBSERVATION_KEYS), "observation has unexpected shape"),
        _fail(~_in(_at(m, "type"), rules.OBSERVATION_TYPES), "observation has unknown type"),
        _fail(~_is_text(_at(m, "text")), "observation text is not a string"),
        _fail(~_text_within(_at(m, "text"), rules.MAX_OBSERVATION_TEXT), "observation text is too long"),
        _fail(~_is_number(_at(m, "confidence")), "observation confidence invalid"),
        _fail(~(_is_null(target) | _is_text(target)), "observation target invalid"),
        _fail(~_has_keys(box, rules.BBOX_KEYS), "observation bbox has unexpected shape"),
        _fail(~numbers, "observation bbox invalid"),
    )


def check_visual(v: Column) -> Column:
    return let(_object(v), _check_visual_of)


def _check_visual_of(m: Column) -> Column:
    conflicts, observations = _list(_at(m, "conflicts")), _list(_at(m, "observations"))
    return F.coalesce(
        _fail(~_has_keys(m, rules.VISUAL_KEYS), "visual block has unexpected shape"),
        _fail(~_is_text(_at(m, "engine")), "visual engine is not a string"),
        _fail(~F.coalesce(F.forall(conflicts, _is_text), F.lit(False)), "visual conflicts are not strings"),
        _fail(observations.isNull(), "visual observations is not a list"),
        _first_reason(observations, _observation_reason),
    )


def check_structure(body: Column) -> Column:
    """First way a body departs from the request contract."""
    return let(F.try_parse_json(body), lambda v: F.coalesce(
        _fail(v.isNull(), "verification error (fail closed)"), let(_object(v), _check_request)))


def _check_request(m: Column) -> Column:
    return F.coalesce(
        _fail(m.isNull(), "payload is not an object"),
        _fail(~_has_keys(m, rules.REQUEST_KEYS, rules.REQUEST_OPTIONAL), "payload has unexpected fields"),
        _fail(~_is_text(_at(m, "task")), "task is not a string"),
        let(_object(_at(m, "page")), _check_page),
        let(_list(_at(m, "placeholders")), _check_placeholders),
        F.when(_has(m, "history"), check_history(_at(m, "history"))),
        _fail(_has(m, "guidance") & ~_text_within(_at(m, "guidance"), rules.MAX_GUIDANCE), "guidance invalid"),
        F.when(_has(m, "visual"), check_visual(_at(m, "visual"))),
    )


def _check_placeholders(placeholders: Column) -> Column:
    return F.coalesce(
        _fail(placeholders.isNull(), "placeholders is not a list"),
        _fail(~F.forall(placeholders, lambda p: _is_text(p) & has(_text(p), rules.PLACEHOLDER_KNOWN)), "malformed placeholder name"),
    )


def _check_page(page: Column) -> Column:
    page_texts = _is_text(_at(page, "url")) & _is_text(_at(page, "title")) & _is_text(_at(page, "text"))
    return F.coalesce(
        _fail(~_has_keys(page, rules.PAGE_KEYS), "page has unexpected shape"),
        _fail(~page_texts, "page fields are not strings"),
        let(_list(_at(page, "elements")), lambda elements: F.coalesce(
            _fail(elements.isNull(), "elements is not a list"), _first_reason(elements, _element_reason))),
    )


def longest_string(body: Column) -> Column:
    """Length of the longest JSON string in a body; an escape counts as one character."""
    literals = F.regexp_extract_all(body, F.lit(r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'), F.lit(1))
    plain = F.transform(literals, lambda s: F.length(F.regexp_replace(s, r"\\u[0-9a-fA-F]{4}|\\.", "x")))
    return F.coalesce(F.array_max(plain), F.lit(0))


def check_image(body: Column) -> Column:
    return F.coalesce(
        _fail(has(body, rules.IMAGE_DATA), "image data detected in payload"),
        _fail((F.length(body) >= 400) & has(body, rules.BASE64_RUN), "encoded binary data detected in payload"),
        _fail((F.length(body) > rules.MAX_STRING) & (longest_string(body) > rules.MAX_STRING), "oversized field detected in payload"),
    )


def check_known(body: Column, known: Column) -> Column:
    """Type of the first known value (array of struct<type,value>) found in the body in an obvious variant."""
    forms = F.struct(F.lower(body).alias("low"), F.regexp_replace(body, jvm(r"[\s-]"), "").alias("tight"))

    def leaks(form: Column, e: Column) -> Column:
        raw = trimmed(e["value"])
        digits = digits_of(raw)
        numeric = (F.length(digits) >= rules.MIN_KNOWN_DIGITS) & bounded_digits(form["tight"], digits)
        return (F.length(raw) >= rules.MIN_KNOWN) & F.when(has(raw, r"^[\d\s-]+$"), numeric).otherwise(F.contains(form["low"], F.lower(raw)))

    first = let(forms, lambda form: F.get(F.filter(known, lambda e: leaks(form, e)), 0)["type"])
    return F.when(F.size(known) > 0, first)


def check_patterns(body: Column) -> Column:
    """Type still present by the verifier's own patterns, in the order e-mail, card, mobile."""
    email = F.when(F.contains(body, F.lit("@")) & has(body, rules.EMAIL), F.lit("EMAIL"))
    return F.coalesce(email, let(leak_spans(body), lambda left: F.coalesce(
        *[F.when(F.exists(left, lambda s: s["type"] == kind), F.lit(kind)) for kind in ("CARD", "PHONE")])))
