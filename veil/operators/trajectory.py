"""Recorded runs: what each action did, loops, budgets, and whether the goal was reached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veil import rules
from veil.functions.tasks import (
    cart_count, confirms_cart, goal_kind, goes_to_cart, outcome_of, query_of_url, requested_quantity, shown_quantity,
)
from veil.functions.text import has, trimmed
from veil.plans.ordered import previous_rows, running_totals


def effect(url_changed: Column, anything_changed: Column) -> Column:
    return F.when(url_changed, "url_changed").when(anything_changed, "dom_changed").otherwise("no_change")


def action_effects(snapshots: DataFrame, task: list[str], bucket: Column, order: list[Column]) -> DataFrame:
    """Adds ``effect`` of the action before each snapshot (url, title, controls, dialogs, mutations); null for the first."""
    fields = [F.col(c) for c in ("url", "title", "controls", "dialogs")]
    rows = previous_rows(snapshots, task, bucket, order, fields, 1, "__prev")
    p = F.get("__prev", 0)
    other = (F.col("mutations") > 0) | (F.col("controls") != p["controls"]) | (F.col("title") != p["title"]) | (F.col("dialogs") != p["dialogs"])
    return rows.withColumn("effect", F.when(p.isNotNull(), effect(F.col("url") != p["url"], other))).drop("__prev")


def reconcile_effects(rows: DataFrame, task: list[str], bucket: Column, order: list[Column]) -> DataFrame:
    """Adds ``corrected``: a 'no_change' or 'unknown' effect is corrected when the next observation differs.

    Rows hold an action, its effect and the observation it was chosen from; ``order`` must be ascending, so the next row is
    read by walking the buckets backwards.
    """
    fields = [F.col("url").alias("url"), F.col("title").alias("title"), F.col("labels").alias("labels")]
    ahead = previous_rows(rows, task, -bucket, [c.desc() for c in order], fields, 1, "__next")
    n = F.get("__next", 0)
    found = F.when(n["url"] != F.col("url"), "url_changed").when((n["title"] != F.col("title")) | (n["labels"] != F.col("labels")), "dom_changed")
    open_effect = F.col("effect").isin("no_change", "unknown") & (F.col("action") != "done")
    return ahead.withColumn("corrected", F.when(open_effect, F.coalesce(found, F.col("effect"))).otherwise(F.col("effect"))).drop("__next")


def signature(action: Column, target: Column, value: Column) -> Column:
    return F.concat_ws("|", action, F.coalesce(target, F.lit("∅")), F.coalesce(value, F.lit("∅")))


def loops(actions: DataFrame, task: list[str], bucket: Column, order: list[Column]) -> DataFrame:
    """Adds ``repeated`` (same signature twice in a row) and ``cycling`` (three times in the last eight)."""
    rows = actions.withColumn("__sig", signature(F.col("action"), F.col("target"), F.col("value")))
    rows = previous_rows(rows, task, bucket, order, [F.col("__sig").alias("sig")], rules.CYCLE_WINDOW - 1, "__prev")
    last = F.get("__prev", F.size("__prev") - 1)["sig"]
    seen = F.size(F.filter("__prev", lambda p: p["sig"] == F.col("__sig"))) + 1
    return (rows.withColumn("repeated", F.coalesce(last == F.col("__sig"), F.lit(False)))
            .withColumn("cycling", seen >= rules.CYCLE_COUNT).drop("__sig", "__prev"))


def no_effect_streak(actions: DataFrame, task: list[str], bucket: Column, order: list[Column]) -> DataFrame:
    """Executed actions with ``stuck``: this one and the two before it all had no effect."""
    real = actions.filter((F.col("action") != "done") & ~F.coalesce("synthetic", F.lit(False)))
    k = rules.NO_EFFECT_STREAK - 1
    rows = previous_rows(real, task, bucket, order, [F.col("effect").alias("effect")], k, "__prev")
    still = (F.size("__prev") == k) & F.forall("__prev", lambda p: p["effect"] == "no_change") & (F.col("effect") == "no_change")
    return rows.withColumn("stuck", still).drop("__prev")


def budget_breaches(actions: DataFrame, task: list[str], bucket: Column, order: list[Column], step: str = "step") -> DataFrame:
    """Per task the first step at which a budget is exceeded, and which one. ``actions(rounds, failed, recovery, data_stop,
    repeat_warning, policy_recovery)`` as 0/1 counters."""
    names = ["failed", "recovery", "repeat_warning", "policy_recovery"]
    rows = running_totals(actions, task, bucket, order, {"__steps": F.lit(1), **{f"__{n}": F.col(n) for n in names}})
    allowed = F.when(F.col("data_stop") == 1, 1).otherwise(rules.MAX_RECOVERIES)
    breach = (
        F.when(F.col("__steps") > rules.MAX_STEPS, "steps").when(F.col("rounds") > rules.MAX_ROUNDS, "rounds")
        .when(F.col("__recovery") > allowed, "recoveries").when(F.col("__failed") > rules.MAX_FAILED, "failed_actions")
        .when(F.col("__repeat_warning") > rules.MAX_REPEAT_WARNINGS, "repeat_warnings")
        .when(F.col("__policy_recovery") > rules.MAX_POLICY_RECOVERIES, "policy_recoveries"))
    hit = rows.withColumn("breach", breach).filter(F.col("breach").isNotNull())
    return hit.groupBy(*task).agg(F.min(step).alias("first_step"), F.min_by("breach", step).alias("breach"))


def history_for_wire(actions: DataFrame, task: list[str], step: str = "step", kept: int = rules.HISTORY_KEPT, seeds: DataFrame | None = None) -> DataFrame:
    """The last actions of a task as they may leave: local fields dropped, value and note redacted through the task's vault, then cut.

    ``seeds(scope, seq, type, value)`` are values known before, scope being the task's columns as JSON and seq negative.
    """
    from veil.operators.redact import redact
    from veil.plans.ordered import top_per_key
    rows = top_per_key(actions, task, [F.col(step).desc()], kept).withColumn("__scope", F.to_json(F.struct(*task), {"ignoreNullFields": "false"}))
    parts = F.explode(F.array(*[F.struct((F.col(step).cast("long") * 2 + i).alias("seq"), F.col(c).alias("text")) for i, c in enumerate(("value", "note"))]))
    texts = rows.select(F.col("__scope").alias("scope"), parts.alias("p")).select("scope", "p.seq", "p.text").filter(F.col("text").isNotNull())
    clean, _vault = redact(texts, ["seq"], seeds=seeds)
    clean = clean.select(F.col("scope").alias("__scope"), F.col("seq"), F.col("redacted"))
    for i, (c, limit) in enumerate((("value", rules.MAX_HISTORY_VALUE), ("note", rules.MAX_NOTE))):
        own = clean.select("__scope", F.col("seq").alias("__seq"), F.left("redacted", F.lit(limit)).alias(f"__{c}"))
        rows = rows.withColumn("__seq", F.col(step).cast("long") * 2 + i).join(own, ["__scope", "__seq"], "left").drop("__seq")
    return rows.select(*task, step, "action", "target", F.col("__value").alias("value"), "effect", F.col("__note").alias("note"))


# --- goals ---------------------------------------------------------------------------------------


def cart_evidence(before_labels: Column, before_text: Column, before_dialogs: Column, after_labels: Column, after_text: Column,
                  after_dialogs: Column) -> Column:
    """struct of the cart signals between two observations."""
    a, b = cart_count(before_labels, before_text), cart_count(after_labels, after_text)
    up = F.coalesce(b > a, F.lit(False))
    confirmed = ~confirms_cart(before_text) & confirms_cart(after_text)
    control = ~goes_to_cart(before_labels) & goes_to_cart(after_labels)
    return F.struct(a.alias("count_before"), b.alias("count_after"), confirmed.alias("confirmation"), control.alias("go_to_cart"),
                    (after_dialogs > before_dialogs).alias("dialog"), (up | confirmed | control).alias("added"))


def task_facts(tasks: DataFrame, actions: DataFrame, observations: DataFrame, key: str) -> DataFrame:
    """One row per task: goal, action facts and the first and last observation. Only combining aggregates, no lists."""
    step, act, eff = F.col("step"), F.col("action"), F.coalesce("effect", F.lit(""))
    real = act != "done"
    label = F.coalesce("label", F.lit(""))
    typed = (act == "type") & F.col("value").isNotNull()
    sent = act.isin("press", "click") & ~F.coalesce(F.col("effect"), F.lit("")).isin("no_change", "unknown")
    add = (act == "click") & has(label, rules.CART_ADD)
    facts = actions.filter(real).groupBy(key).agg(
        F.count("*").alias("n_actions"), F.max(F.when(typed, step)).alias("typed_at"), F.max_by(F.when(typed, F.col("value")), F.when(typed, step)).alias("typed"),
        F.max(F.when(sent, step)).alias("sent_at"), F.max(F.when(sent & (eff == "url_changed"), step)).alias("moved_at"),
        F.max(F.when(sent & ((act == "press") | has(label, rules.SEARCH_CONTROL)), step)).alias("control_at"),
        F.count_if(add).alias("n_adds"), F.count_if(add & F.coalesce("cart_added", F.lit(False))).alias("n_added"),
        F.count_if(add & (eff == "no_change")).alias("n_still"),
        F.count_if((act == "click") & has(label, rules.PURCHASE_LABEL) & (eff != "no_change")).alias("n_purchases"),
        F.bool_or((eff == "url_changed") | (act == "navigate")).alias("moved"))
    page = F.struct("url", "title", "labels", "text")
    seen = observations.groupBy(key).agg(F.count("*").alias("n_obs"), F.min_by(page, "step").alias("first"), F.max_by(page, "step").alias("last"))
    rows = tasks.withColumn("goal", goal_kind(F.col("task"))).join(facts, key, "left").join(seen, key, "left")
    zero = ["n_actions", "n_adds", "n_added", "n_still", "n_purchases", "n_obs"]
    return rows.fillna(0, zero).fillna(False, ["moved"])


def _evidence(*pairs) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in pairs]))


def _verdict(state: Column, evidence: Column) -> Column:
    return F.struct(state.alias("state"), evidence.alias("evidence"))


def verify_search() -> Column:
    last, first = F.col("last"), F.col("first")
    typed = F.lower(trimmed(F.coalesce("typed", F.lit(""))))
    after = F.col("typed_at").isNotNull()
    sent, moved, control = [F.coalesce(after & (F.col(c) > F.col("typed_at")), F.lit(False)) for c in ("sent_at", "moved_at", "control_at")]
    query = query_of_url(last["url"])
    in_url = (query != "") & ((typed == "") | F.contains(query, typed) | F.contains(typed, query))
    evidence = _evidence(
        (moved, "submitted_to_results"), (sent & ~moved & control, "submitted_by_control"), (sent & ~moved & ~control, "changed_after_typing"),
        (in_url, "url_query"), ((typed != "") & F.contains(last["title"], typed), "title_query"),
        (has(last["text"], rules.RESULTS_TEXT) & ((typed == "") | F.contains(last["text"], typed)), "results_text"),
        ((last["url"] != first["url"]) & has(last["url"], rules.RESULTS_URL), "results_url"))
    n = F.size(evidence)
    page_sign = F.exists(evidence, lambda e: e.isin("url_query", "title_query", "results_text", "results_url", "submitted_to_results"))
    state = (F.when((typed != "") & ~sent & ~page_sign, "not_complete")
             .when((n >= 2) | ((n == 1) & page_sign) | moved, "verified")
             .when(F.col("n_actions") == 0, "not_complete").otherwise("unverified"))
    return _verdict(state, evidence)


def verify_cart() -> Column:
    last, first = F.col("last"), F.col("first")
    two = F.col("n_obs") >= 2
    signs = cart_evidence(first["labels"], first["text"], F.lit(0), last["labels"], last["text"], F.lit(0))
    evidence = _evidence(
        (F.col("n_added") > 0, "executor_saw_change"), (two & (signs["count_after"] > signs["count_before"]), "count_up"),
        (two & signs["go_to_cart"], "go_to_cart"), (two & signs["confirmation"], "confirmation"))
    wanted, shown = requested_quantity(F.col("task")), shown_quantity(last["text"])
    state = (F.when((F.size(evidence) > 0) & wanted.isNotNull(),
                    F.when(shown == wanted, "verified").when(shown.isNotNull(), "not_complete").otherwise("unverified"))
             .when(F.size(evidence) > 0, "verified").when(F.col("n_adds") == 0, "not_complete")
             .when(F.col("n_still") == F.col("n_adds"), "not_complete").otherwise("unverified"))
    return _verdict(state, evidence)


def verify_purchase() -> Column:
    last = F.col("last")
    evidence = _evidence(
        (F.col("n_purchases") > 0, "purchase_click"),
        (has(last["url"], rules.CHECKOUT_STATE) | has(last["title"], rules.CHECKOUT_STATE), "checkout_page"),
        (has(last["text"], rules.ORDER_CONFIRMED), "order_confirmed"))
    state = F.when(F.size(evidence) >= 2, "verified").when(F.col("n_purchases") == 0, "not_complete").otherwise("unverified")
    return _verdict(state, evidence)


def verify_open() -> Column:
    last = F.col("last")
    words = F.filter(F.split(F.regexp_replace(F.lower("task"), "[^a-z0-9 ]+", " "), " +"), lambda w: (F.length(w) >= 4) & ~w.isin(rules.STOPWORDS))
    named = F.exists(words, lambda w: F.contains(last["title"], w) | F.contains(last["url"], w))
    evidence = _evidence((F.col("moved"), "moved"), (named, "named"))
    n = F.size(evidence)
    state = (F.when((n >= 2) | ((n == 1) & ~F.col("moved")), "verified")
             .when(~F.col("moved") & (F.col("n_actions") == 0), "not_complete").otherwise("unverified"))
    return _verdict(state, evidence)


def verify_completion(facts: DataFrame) -> DataFrame:
    """Adds ``state`` and ``evidence`` by the goal of each task."""
    nothing = F.col("n_actions") == 0
    other = _verdict(F.when(nothing, "verified").otherwise("unverified"), F.when(nothing, F.array(F.lit("no_state_change_requested"))).otherwise(
        F.array().cast("array<string>")))
    chosen = (F.when(F.col("goal") == "search", verify_search()).when(F.col("goal") == "cart", verify_cart())
              .when(F.col("goal") == "purchase", verify_purchase()).when(F.col("goal") == "open", verify_open()).otherwise(other))
    return facts.withColumn("__v", chosen).withColumn("state", F.col("__v.state")).withColumn("evidence", F.col("__v.evidence")).drop("__v")


def run_outcomes(runs: DataFrame) -> DataFrame:
    """Adds ``status`` and ``code`` of a run from: safe, cancelled, claim, stop_code, state, blocker_supported, acted,
    last_code, looping, breach, and failed (the last action failed beyond its budget)."""
    c = F.col
    claimed_blocked = c("stop_code").isin(rules.STOP_CODES)
    data_stop = c("stop_code").isin("MISSING_REQUIRED_DATA", "AMBIGUOUS_TARGET")
    done = c("claim") == "done"
    verified = c("state") == "verified"
    refused = c("last_code").isNotNull()
    rounds = F.when(c("last_code") == "ambiguous_target", "AMBIGUOUS_TARGET").when(c("last_code") == "target_occluded", "TARGET_OCCLUDED").when(
        refused, "STALE_TARGET").otherwise("INVALID_MODEL_RESPONSE")
    code = (
        F.when(~c("safe"), "SAFETY_BLOCK").when(c("cancelled"), "CANCELLED")
        .when(verified & (done | c("looping") | (c("last_code") == "repeated_action")), "COMPLETED")
        .when(done & claimed_blocked & c("blocker_supported"), "TASK_BLOCKED").when(done & data_stop, c("stop_code"))
        .when(done & (claimed_blocked | (~c("acted") & (c("state") == "not_complete"))), "INSUFFICIENT_EVIDENCE")
        .when(done, "COMPLETION_UNVERIFIED").when(c("breach") == "rounds", rounds).when(refused, outcome_of(c("last_code")))
        .when(c("failed"), "ACTION_FAILED").when(c("looping"), "NO_PROGRESS").otherwise("STEP_LIMIT"))
    status = F.when(c("code") == "COMPLETED", "completed").when(c("code") == "COMPLETION_UNVERIFIED", "unverified").when(
        c("code") == "ACTION_FAILED", "failed").otherwise("blocked")
    return runs.withColumn("code", code).withColumn("status", status)
