"""What a task text says: authorised intents, safety, goal, quantity and price facts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veil import rules
from veil.functions.text import has, jvm, sentences, trimmed
from veil.operators.elements import site_label


def authorized_intents(task: Column) -> Column:
    """Categories of consequential action named in sentences without a negation word."""
    said = sentences(task)
    named = [F.when(F.exists(said, lambda s: has(s, intents)), F.lit(name)) for name, intents, _labels in rules.CONSEQUENTIAL_RULES]
    return F.array_compact(F.array(*named))


def consequential_category(label: Column) -> Column:
    """First category whose wording a control label carries, null for an ordinary control."""
    text = trimmed(label)
    return F.when(text != "", F.coalesce(*[F.when(has(text, labels), F.lit(name)) for name, _i, labels in rules.CONSEQUENTIAL_RULES]))


def consequential_block(label: Column, authorized: Column, ignore: list[str] = []) -> Column:
    """Category for which a click is refused, null when it is ordinary, authorised or ignored."""
    category = consequential_category(label)
    free = F.array_contains(authorized, category)
    if ignore:
        free = free | category.isin(ignore)
    return F.when(category.isNotNull() & ~free, category)


def allows_repeated_adds(task: Column) -> Column:
    return has(task, rules.MULTIPLE_ITEMS)


def navigation_block(url: Column, task: Column, current: Column) -> Column:
    """Reason to refuse opening a url: only a site the task names, or the site already open."""
    parsed = url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:")
    scheme = F.lower(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    label, here = site_label(url), site_label(current)
    spoken = F.concat(F.lit("(?i)(^|[^a-z0-9])"), F.regexp_replace(label, "([^a-z0-9])", r"\\$1"), F.lit(r"([^a-z0-9]|\z)"))
    return (
        F.when(~F.coalesce(parsed, F.lit(False)), "invalid_url").when(~scheme.isin("http", "https"), "scheme")
        .when(label == "", "no_host").when(F.rlike(task, spoken), F.lit(None))
        .when(here == label, F.lit(None)).otherwise("not_named")
    )


# --- safety ----------------------------------------------------------------------------------


def _plain(text: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(F.lower(text), "[’`]", "'"), "[^a-z0-9' ]+", " ")
    return F.trim(F.regexp_replace(spaced, " +", " "))


def _sentence_category(s: Column) -> Column:
    g = {name: has(s, pattern) for name, pattern in rules.GUARD.items()}
    calm = ~g["negated"]
    return (
        F.when(g["self_harm"], "self-harm").when(g["dangerous_device"], "dangerous-device")
        .when(g["verb_target"] & calm, "harm-to-person").when(g["noun_target"] & calm, "harm-to-person")
        .when((g["object_purpose"] | g["harm_with"]) & calm & ~g["benign"], "means-for-harm")
        .when(g["targeting"], "targeting-person")
        .when(g["substance"] & g["object"] & calm, "means-for-harm")
        .when(g["intimidation"] & g["object"] & g["person"] & calm & ~g["benign"], "ambiguous-harm")
    )


def task_category(task: Column) -> Column:
    """Harm category of the first sentence that has one; null for a safe task."""
    said = F.filter(F.transform(F.split(task, jvm(rules.SENTENCE_BREAK)), _plain), lambda s: s != "")
    return F.get(F.array_compact(F.transform(said, _sentence_category)), 0)


# --- facts -----------------------------------------------------------------------------------


def requested_quantity(task: Column) -> Column:
    n = F.coalesce(*[F.nullif(F.regexp_extract(task, jvm(rules.QUANTITY), i), F.lit("")) for i in (1, 2, 3)]).try_cast("long")
    return F.when(n > 0, n)


def price_target(task: Column) -> Column:
    """struct<kind,amount,currency> of the first amount with a currency before it, else after it; null when none."""
    first = has(task, rules.PRICE_BEFORE_AMOUNT)

    def part(i: int, j: int) -> Column:
        return F.when(first, F.regexp_extract(task, jvm(rules.PRICE_BEFORE_AMOUNT), i)).otherwise(
            F.regexp_extract(task, jvm(rules.PRICE_AFTER_AMOUNT), j))

    qualifier, money, amount = F.lower(part(1, 1)), F.lower(part(2, 3)), part(3, 2)
    number = F.nullif(F.regexp_replace(amount, ",", ""), F.lit("")).try_cast("double")
    kind = F.coalesce(*[F.when(has(qualifier, p), F.lit(name)) for p, name in rules.PRICE_KINDS], F.lit("exact"))
    currency = F.coalesce(*[F.when(has(money, p), F.lit(sign)) for sign, p in rules.CURRENCY_NAMES], money)
    return F.when(number > 0, F.struct(kind.alias("kind"), number.alias("amount"), currency.alias("currency")))


def names_tie_breaker(task: Column) -> Column:
    return has(task, rules.TIE_BREAKER)


def goal_kind(task: Column) -> Column:
    """cart, purchase, search, open or other, from sentences without a negation word."""
    parts = F.filter(F.split(F.lower(task), jvm(rules.SENTENCE_BREAK)), lambda s: (trimmed(s) != "") & ~has(s, rules.NEGATION))
    text = F.array_join(parts, ". ")
    kind = F.lit("other")
    for name, pattern in reversed(rules.GOAL_RULES):
        kind = F.when(has(text, pattern), name).otherwise(kind)
    return F.when(has(text, rules.CART_ADD) | has(text, rules.CART_PUT), "cart").otherwise(kind)


def cart_count(labels: Column, text: Column) -> Column:
    """Count shown by the first label that carries one, else by the text (below 1000)."""
    def read(t: Column) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract(t, jvm(p), 1), F.lit("")) for p in rules.CART_COUNTS])

    shown = F.array_compact(F.transform(F.filter(labels, lambda t: has(t, rules.CART_WORD)), read))
    below = F.coalesce(*[F.when(n < rules.CART_COUNT_TEXT_BOUND, n) for n in (
        F.nullif(F.regexp_extract(text, jvm(p), 1), F.lit("")).try_cast("long") for p in rules.CART_COUNTS)])
    return F.coalesce(F.get(shown, 0).try_cast("long"), below)


def shown_quantity(text: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, jvm(rules.SHOWN_QUANTITY), i), F.lit("")) for i in (1, 2, 3)]).try_cast("long")


def goes_to_cart(labels: Column) -> Column:
    return F.exists(labels, lambda t: has(t, rules.GO_TO_CART))


def confirms_cart(text: Column) -> Column:
    return has(text, rules.CART_CONFIRMATION)


def query_of_url(url: Column) -> Column:
    """Search words in a url: the first known query parameter, else the last path part of a search path."""
    values = [F.nullif(F.try_parse_url(url, F.lit("QUERY"), F.lit(k)), F.lit("")) for k in rules.QUERY_PARAMS]
    path = F.try_parse_url(url, F.lit("PATH"))
    tail = F.when(has(path, r"\/search\b"), F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[-_]+", " "))
    given = F.lower(F.trim(F.regexp_replace(F.try_url_decode(F.coalesce(*values)), r"\+", " ")))
    return F.coalesce(given, tail)


def blocker_claim(reason: Column, text: Column, labels: Column, title: Column) -> Column:
    """struct<claimed, supported, phrase>: whether a claimed blocker's wording is on the page."""
    said = F.filter(F.array(*[F.lit(p) for p in rules.BLOCKERS]), lambda p: F.contains(F.lower(reason), p))
    page = F.concat_ws(" ", text, F.array_join(labels, " "), title)
    shown = F.get(F.filter(said, lambda p: F.contains(page, p)), 0)
    claimed = trimmed(reason) != ""
    return F.struct(claimed.alias("claimed"), (claimed & shown.isNotNull()).alias("supported"),
                    F.when(claimed, F.coalesce(shown, F.get(said, 0))).alias("phrase"))


def outcome_of(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in rules.OUTCOME_BY_CODE.items() for x in pair])
    return F.when(code.isNull(), rules.OUTCOME_NONE).otherwise(F.coalesce(F.try_element_at(known, code), F.lit(rules.OUTCOME_OTHER)))


def classify_error(message: Column) -> Column:
    text = F.lower(message)
    return F.coalesce(*[F.when(has(text, p), F.lit(name)) for p, name in rules.ERROR_RULES], F.lit("UNKNOWN_ERROR"))
