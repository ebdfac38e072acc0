"""Policy checks on proposed actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veil import rules
from veil.functions.tasks import allows_repeated_adds, authorized_intents, consequential_block, navigation_block
from veil.functions.text import has, trimmed
from veil.plans.ordered import running_totals

_FENCE = r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$"


def sensitive_policy(value: Column, field_type: Column, placeholder_type: Column) -> Column:
    """True when typing breaks the rule: a placeholder only into a field of its own known type, never a raw value into
    a sensitive field."""
    is_placeholder = has(value, rules.PLACEHOLDER_ANY)
    fits = F.coalesce(field_type == placeholder_type, F.lit(False))
    return F.when(is_placeholder, placeholder_type.isNull() | ~fits).otherwise(field_type.isNotNull())


def cart_repeats(actions: DataFrame, task: list[str], bucket: Column, order: list[Column]) -> DataFrame:
    """Adds ``prior_adds``, ``prior_confirmed`` and ``repeated``: a further add-to-cart click the task does not allow.
    ``actions(task keys, action, label, cart_added, context, task)``."""
    is_add = (F.col("action") == "click") & has(F.coalesce("label", F.lit("")), rules.CART_ADD_LABEL)
    sure = is_add & F.coalesce("cart_added", F.lit(False))
    context = F.coalesce("context", F.lit(""))
    rows = actions.withColumn("__context", context)
    rows = running_totals(rows, task, bucket, order, {
        "prior_adds": is_add.cast("int"), "prior_confirmed": sure.cast("int"),
        "__vague": (sure & (context == "")).cast("int")}, inclusive=False)
    rows = running_totals(rows, [*task, "__context"], bucket, order, {"__alike": sure.cast("int")}, inclusive=False)
    many = allows_repeated_adds(F.col("task"))
    alike = (F.col("__alike") > 0) | (F.col("__vague") > 0) | (F.col("__context") == "")
    after = F.when(F.col("prior_confirmed") > 0, ~many | alike).otherwise(F.lit(False))
    repeated = is_add & (after | ((F.col("prior_adds") >= rules.CART_ADD_LIMIT) & ~many))
    return rows.withColumn("repeated", repeated).drop("__context", "__vague", "__alike")


def parse_replies(replies: DataFrame, elements: DataFrame, on: list[str], text: str = "reply") -> DataFrame:
    """Model replies to actions. Adds the reply's fields and ``reject`` (null for a usable reply).
    ``elements(on, element_id)`` are the ids the request supplied."""
    raw = trimmed(F.col(text))
    bare = F.when(raw.rlike(_FENCE), F.regexp_extract(raw, _FENCE, 1)).otherwise(raw)
    rows = replies.withColumn("__v", F.try_parse_json(bare))
    m = F.when(F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT")), F.try_variant_get("__v", "$", "map<string,variant>"))
    rows = rows.withColumn("__m", m)

    def field(name: str) -> Column:
        return F.try_element_at(F.col("__m"), F.lit(name))

    def kind(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(field(name)), F.lit("VOID"))

    def text_of(name: str) -> Column:
        return F.when(kind(name) == "STRING", F.try_variant_get(field(name), "$", "string"))

    number = F.try_variant_get(field("confidence"), "$", "double")
    rows = rows.select("*", text_of("action").alias("action"), text_of("target").alias("target"), text_of("value").alias("value"),
                       number.alias("confidence"), text_of("reason").alias("reason"),
                       F.coalesce(F.try_variant_get(field("final"), "$", "boolean"), F.lit(False)).alias("final"))
    contract = (
        F.coalesce(F.col("action").isin(rules.ACTIONS), F.lit(False)) & kind("target").isin("STRING", "VOID")
        & kind("value").isin("STRING", "VOID") & F.coalesce(number.between(0, 1), F.lit(False)) & (kind("reason") == "STRING"))
    ids = elements.select(*on, F.col("element_id").alias("target"), F.lit(True).alias("__known")).distinct()
    rows = rows.join(ids, [*on, "target"], "left")
    reject = (
        F.when(F.col("__v").isNull(), "response is not valid JSON").when(F.col("__m").isNull(), "response JSON is not an object")
        .when(~contract, "action does not match the contract")
        .when(F.col("action").isin(rules.TARGET_ACTIONS) & (F.coalesce("target", F.lit("")) == ""), "action requires a target")
        .when(F.col("action").isin(rules.VALUE_ACTIONS) & F.col("value").isNull(), "action requires a value")
        .when(F.col("target").isNotNull() & F.col("__known").isNull(), "target is not one of the supplied element IDs"))
    return rows.withColumn("reject", reject).drop("__v", "__m", "__known")


def validate_actions(actions: DataFrame, elements: DataFrame, vault: DataFrame, on: list[str]) -> DataFrame:
    """Adds ``code``: null for a valid action, else the first rule it breaks, in the fixed order of the rules.

    ``actions(on, body JSON, task, current_url, repeated)``; ``elements(on, element_id, tag, input_type, disabled, multiple,
    editable, options array<string>, pii_type, label, matches)``, and ``option_values array<string>`` where options have values of their
    own; matches > 1 marks an ambiguous control;
    ``vault(on, placeholder, type)``. Facts arrive by left joins, the rules are one column.
    """
    v = F.try_parse_json(F.col("body"))
    rows = actions.withColumn("__m", F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.try_variant_get(v, "$", "map<string,variant>")))

    def field(name: str) -> Column:
        return F.try_element_at(F.col("__m"), F.lit(name))

    def kind(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(field(name)), F.lit("ABSENT"))

    def text_of(name: str) -> Column:
        return F.when(kind(name) == "STRING", F.try_variant_get(field(name), "$", "string"))

    extra = F.size(F.array_except(F.map_keys("__m"), F.array(*[F.lit(k) for k in rules.ACTION_FIELDS])))
    rows = rows.select("*", text_of("action").alias("action"), text_of("target").alias("target"), text_of("value").alias("value"), text_of("reason").alias("reason"),
                       F.when(kind("confidence").rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.try_variant_get(field("confidence"), "$", "double")).alias("confidence"),
                       extra.alias("__extra"), kind("final").isin("BOOLEAN", "ABSENT").alias("__final_ok"),
                       (kind("target").isin("STRING", "VOID", "ABSENT") & kind("value").isin("STRING", "VOID", "ABSENT")
                        & kind("reason").isin("STRING", "ABSENT")).alias("__typed"))
    # Several controls of one id are one ambiguous control, and never several rows of the action.
    names = ("tag", "input_type", "disabled", "multiple", "editable", "options", "pii_type", "label")
    chosen = F.array().cast("array<string>")
    both = F.concat(F.coalesce("options", chosen), F.coalesce("option_values", chosen) if "option_values" in elements.columns else chosen)
    elements = elements.withColumn("options", both)
    one = elements.groupBy(*on, "element_id").agg(F.min(F.struct(*names)).alias("__e"), F.greatest(F.max("matches"), F.count("*")).alias("matches"))
    one = one.select(*on, "element_id", *[F.col(f"__e.{n}").alias(n) for n in names], "matches")
    facts = one.select(*on, F.col("element_id").alias("target"), F.col("tag").alias("e_tag"), F.col("input_type").alias("e_type"),
                            F.col("disabled").alias("e_disabled"), F.col("multiple").alias("e_multiple"), F.col("editable").alias("e_editable"),
                            F.col("options").alias("e_options"), F.col("pii_type").alias("e_pii"), F.col("label").alias("e_label"),
                            F.col("matches").alias("e_matches"))
    marks = vault.groupBy(*on, F.col("placeholder").alias("value")).agg(F.min("type").alias("p_type"))
    rows = rows.join(facts, [*on, "target"], "left").join(marks, [*on, "value"], "left")
    action, target, value = F.col("action"), F.coalesce("target", F.lit("")), F.col("value")
    needs = action.isin(rules.TARGET_ACTIONS)
    typeable = (F.col("e_tag") == "textarea") | ((F.col("e_tag") == "input") & F.coalesce("e_type", F.lit("")).isin(rules.TYPEABLE_TYPES)) | F.coalesce("e_editable", F.lit(False))
    unsafe = F.lit(False)
    for name in ("target", "value", "reason"):
        unsafe = unsafe | F.coalesce(has(F.col(name), rules.EXECUTABLE_CONTENT), F.lit(False))
    option = F.exists("e_options", lambda o: F.lower(trimmed(o)) == F.lower(trimmed(value)))
    refused = consequential_block(F.coalesce("e_label", F.lit("")), authorized_intents(F.col("task")))
    closed = navigation_block(value, F.col("task"), F.coalesce("current_url", F.lit("")))
    code = (
        F.when(F.col("__m").isNull(), "malformed").when(F.col("__extra") > 0, "unexpected_field").when(~F.col("__final_ok"), "malformed")
        .when(~F.coalesce(action.isin(rules.ACTIONS), F.lit(False)), "unsupported_action")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "invalid_confidence")
        .when(~F.col("__typed"), "malformed").when(unsafe, "executable_content")
        .when(~needs & (target != ""), "invalid_target").when(needs & (target == ""), "missing_target")
        .when(needs & ~has(target, rules.TARGET_FORMAT), "invalid_target")
        .when(needs & F.col("e_tag").isNull(), "unknown_target").when(needs & (F.col("e_matches") > 1), "ambiguous_target")
        .when(needs & F.coalesce("e_disabled", F.lit(False)), "incompatible_target")
        .when(action.isin("type", "press") & ~typeable, "incompatible_target")
        .when((action == "select") & ((F.col("e_tag") != "select") | F.coalesce("e_multiple", F.lit(False))), "incompatible_target")
        .when((action == "navigate") & (F.coalesce(value, F.lit("")) == ""), "missing_value")
        .when((action == "navigate") & ~has(value, rules.SAFE_NAVIGATION), "dangerous_navigation")
        .when((action == "navigate") & closed.isNotNull(), "navigation_not_authorised")
        .when((action == "scroll") & value.isNotNull() & ~value.isin(rules.SCROLL_VALUES), "invalid_value")
        .when(action.isin("select", "type", "press") & value.isNull(), "missing_value")
        .when((action == "select") & ~F.coalesce(option, F.lit(False)), "invalid_value")
        .when((action == "type") & sensitive_policy(value, F.col("e_pii"), F.col("p_type")), "sensitive_policy")
        .when((action == "press") & (value != "Enter"), "invalid_value")
        .when((action == "click") & refused.isNotNull(), "consequential_action")
        .when((action == "click") & F.coalesce("repeated", F.lit(False)), "repeated_action")
        .when((action == "type") & has(value, rules.PLACEHOLDER_ANY), "unsupported_by_executor")
    )
    drop = ["__m", "__extra", "__final_ok", "__typed", *[c for c in rows.columns if c.startswith("e_")], "p_type"]
    return rows.withColumn("code", code).drop(*drop)
