"""Queries over tasks, action logs, runs and their scores; the timed rules in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.functions import tasks as TK
from veil.functions.text import normalize
from veil.operators import metrics as M, offers as OF, policy as P, trajectory as T
from veil.operators.redact import detections
from veil.plans import check_sql as C, derived as G
from veil.plans.ordered import each, time_bucket
from veil.plans.registry import query
from veil.sources import logs as L
from veil.streaming import rules_in_time as S

ACTIONS = G.as_cte(G.ACTIONS)
TASKS = G.as_cte(G.TASKS)


def _in_time():
    """Bucket and order of an event log."""
    return time_bucket(F.col("ts"), 24 * 3_600_000_000), [F.col("ts"), F.col("event_id")]


def _actions(spark, sf):
    return G.derive(spark, sf, G.ACTIONS, "events").withColumn("labels", F.split("labels", "[|]"))


def _tasks(spark, sf):
    return G.derive(spark, sf, G.TASKS, "events")


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


# --- policy ---------------------------------------------------------------------------------------

_REPLIES = """SELECT event_id, user_id, CASE event_id % 8 WHEN 0 THEN '```json ' ELSE '' END || CASE event_id % 8 WHEN 1 THEN 'no json' WHEN 2 THEN '[1]' ELSE '{{"action":"' || CASE event_id % 8 WHEN 3 THEN 'fly' WHEN 4 THEN 'type' ELSE 'click' END
  || '","target":' || CASE event_id % 8 WHEN 5 THEN '""' WHEN 6 THEN '"el_9"' ELSE '"el_' || CAST(user_id % 5 AS STRING) || '"' END || ',"value":null,"confidence":' || CASE event_id % 8 WHEN 7 THEN '1.5' ELSE '0.5' END || ',"reason":"r"}}' END
  || CASE event_id % 8 WHEN 0 THEN ' ```' ELSE '' END AS reply FROM {events}"""


@query("s09_model_reply_load", """SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'response is not valid JSON' WHEN 2 THEN 'response JSON is not an object' WHEN 3 THEN 'action does not match the contract' WHEN 4 THEN 'action requires a value'
    WHEN 5 THEN 'action requires a target' WHEN 6 THEN 'target is not one of the supplied element IDs' WHEN 7 THEN 'action does not match the contract' END AS reject FROM events""")
def s09(spark, sf):
    replies = G.derive(spark, sf, _REPLIES, "events")
    ids = _events(spark, sf).select("user_id").distinct().select("user_id", F.concat(F.lit("el_"), (F.col("user_id") % 5).cast("string")).alias("element_id"))
    return P.parse_replies(replies, ids, ["user_id"]).select("event_id", "reject")


_BODIES = """SELECT event_id, user_id, '{{"action":"' || CASE event_id % 24 WHEN 0 THEN 'fly' WHEN 1 THEN 'scroll' WHEN 2 THEN 'scroll' WHEN 3 THEN 'navigate' WHEN 4 THEN 'navigate' WHEN 5 THEN 'navigate' WHEN 6 THEN 'type' WHEN 7 THEN 'type' WHEN 8 THEN 'type'
    WHEN 9 THEN 'press' WHEN 10 THEN 'select' WHEN 11 THEN 'select' WHEN 12 THEN 'type' WHEN 20 THEN 'scroll' WHEN 22 THEN 'navigate' WHEN 23 THEN 'type' ELSE 'click' END || '","confidence":' || CASE event_id % 24 WHEN 13 THEN '2' ELSE '0.9' END
  || ',"target":' || CASE event_id % 24 WHEN 1 THEN 'null' WHEN 2 THEN 'null' WHEN 3 THEN 'null' WHEN 4 THEN 'null' WHEN 5 THEN 'null' WHEN 22 THEN 'null' WHEN 6 THEN '"el_mail"' WHEN 7 THEN '"el_mail"' WHEN 8 THEN '"el_name"' WHEN 9 THEN '"el_name"' WHEN 10 THEN '"el_size"' WHEN 11 THEN '"el_size"' WHEN 12 THEN '"el_buy"'
    WHEN 23 THEN '"el_name"' WHEN 14 THEN 'null' WHEN 15 THEN '"bad id"' WHEN 16 THEN '"el_gone"' WHEN 17 THEN '"el_twin"' WHEN 18 THEN '"el_off"' WHEN 20 THEN '"el_buy"' ELSE '"el_buy"' END
  || ',"value":' || CASE event_id % 24 WHEN 1 THEN '"down"' WHEN 2 THEN '"left"' WHEN 3 THEN 'null' WHEN 4 THEN '"ftp://shop.example.com"' WHEN 5 THEN '"https://evil.test/x"' WHEN 22 THEN '"https://www.shop.example.com/x"' WHEN 6 THEN '"[EMAIL_1]"' WHEN 7 THEN '"me@x.org"' WHEN 8 THEN '"plain"' WHEN 9 THEN '"Tab"' WHEN 10 THEN CASE event_id % 48 WHEN 10 THEN '"large"' ELSE '" x-1 "' END
    WHEN 11 THEN '"huge"' WHEN 12 THEN '"x"' WHEN 23 THEN '"[PHONE_9]"' ELSE 'null' END || ',"reason":' || CASE event_id % 24 WHEN 19 THEN '"javascript:x"' ELSE '"r"' END || CASE event_id % 24 WHEN 21 THEN ',"extra":1' ELSE '' END || '}}' AS body,
  'go to example and look' AS task, 'https://shop.example.com/' AS current_url, false AS repeated FROM {events}"""
_CONTROLS = """SELECT DISTINCT user_id, 'el_buy' AS element_id, 'button' AS tag, '' AS input_type, false AS disabled, 'Buy now' AS label, 1 AS matches, '' AS opts, '' AS pii FROM {events}
  UNION ALL SELECT DISTINCT user_id, 'el_mail', 'input', 'email', false, 'mail', 1, '', 'EMAIL' FROM {events} UNION ALL SELECT DISTINCT user_id, 'el_name', 'input', 'text', false, 'name', 1, '', '' FROM {events}
  UNION ALL SELECT DISTINCT user_id, 'el_size', 'select', '', false, 'size', 1, 'Small|Large', '' FROM {events} UNION ALL SELECT DISTINCT user_id, 'el_twin', 'button', '', false, 'twin', 2, '', '' FROM {events}
  UNION ALL SELECT DISTINCT user_id, 'el_off', 'button', '', true, 'off', 1, '', '' FROM {events}"""
_CODE = """CASE event_id % 24 WHEN 0 THEN 'unsupported_action' WHEN 2 THEN 'invalid_value' WHEN 3 THEN 'missing_value' WHEN 4 THEN 'dangerous_navigation' WHEN 5 THEN 'navigation_not_authorised' WHEN 6 THEN 'unsupported_by_executor' WHEN 7 THEN 'sensitive_policy'
    WHEN 9 THEN 'invalid_value' WHEN 11 THEN 'invalid_value' WHEN 12 THEN 'incompatible_target' WHEN 13 THEN 'invalid_confidence' WHEN 14 THEN 'missing_target' WHEN 15 THEN 'invalid_target' WHEN 16 THEN 'unknown_target' WHEN 17 THEN 'ambiguous_target'
    WHEN 18 THEN 'incompatible_target' WHEN 19 THEN 'executable_content' WHEN 20 THEN 'invalid_target' WHEN 21 THEN 'unexpected_field' WHEN 23 THEN 'sensitive_policy' WHEN 1 THEN NULL WHEN 8 THEN NULL WHEN 10 THEN NULL WHEN 22 THEN NULL ELSE 'consequential_action' END"""


def _validated(spark, sf):
    controls = G.derive(spark, sf, _CONTROLS, "events").withColumn("options", F.split("opts", "[|]")).withColumn(
        "option_values", F.when(F.col("tag") == "select", F.array(F.lit("X-0"), F.lit("X-1")))).withColumn("pii_type", F.nullif("pii", F.lit(""))).withColumn(
        "multiple", F.lit(False)).withColumn("editable", F.lit(False))
    vault = _events(spark, sf).select("user_id").distinct().withColumn("placeholder", F.lit("[EMAIL_1]")).withColumn("type", F.lit("EMAIL"))
    return P.validate_actions(G.spread(G.derive(spark, sf, _BODIES, "events")), controls, vault, ["user_id"])


@query("a01_validate_action", f"SELECT event_id, {_CODE} AS code FROM events")
def a01(spark, sf):
    return _validated(spark, sf).select("event_id", "code")


@query("a02_sensitive_value_policy", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 4 <> 0 WHEN event_id % 3 = 1 THEN event_id % 4 < 2 ELSE true END AS broken FROM events")
def a02(spark, sf):
    k = F.col("event_id")
    value = F.when(k % 3 == 0, "[EMAIL_1]").when(k % 3 == 1, "plain").otherwise("[CARD_7]")
    field = F.when(k % 4 == 0, "EMAIL").when(k % 4 == 1, "OTP")
    known = F.when(k % 3 == 0, "EMAIL")
    return _events(spark, sf).select("event_id", P.sensitive_policy(value, field, known).alias("broken"))


_INTENTS = "CASE user_id % 8 WHEN 3 THEN 'purchase' WHEN 4 THEN 'checkout' WHEN 6 THEN 'account' WHEN 7 THEN 'destructive' ELSE '' END"


@query("a04_authorized_intents", f"SELECT DISTINCT user_id AS task_id, {_INTENTS} AS intents FROM events")
def a04(spark, sf):
    return _tasks(spark, sf).select("task_id", F.array_join(TK.authorized_intents(F.col("task")), ",").alias("intents"))


@query("a05_consequential_block", f"SELECT event_id, CASE WHEN label = 'Buy now' AND task_id % 8 <> 3 THEN 'purchase' END AS blocked FROM ({ACTIONS})")
def a05(spark, sf):
    intents = _tasks(spark, sf).withColumn("intents", TK.authorized_intents(F.col("task")))
    rows = _actions(spark, sf).join(intents, "task_id")
    return rows.select("event_id", TK.consequential_block(F.col("label"), F.col("intents")).alias("blocked"))


_MANY = "task_id % 8 IN (0, 3, 6, 7)"


@query("a06_cart_add_bound", f"""WITH a AS (SELECT *, action = 'click' AND label = 'Add to cart' AS is_add FROM ({ACTIONS})),
  w AS (SELECT *, coalesce(sum(CASE WHEN is_add THEN 1 ELSE 0 END) OVER p, 0) AS prior_adds, coalesce(sum(CASE WHEN is_add AND cart_added THEN 1 ELSE 0 END) OVER p, 0) AS sure,
    coalesce(sum(CASE WHEN is_add AND cart_added AND context = '' THEN 1 ELSE 0 END) OVER p, 0) AS vague, coalesce(sum(CASE WHEN is_add AND cart_added THEN 1 ELSE 0 END) OVER q, 0) AS alike
    FROM a WINDOW p AS (PARTITION BY task_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY task_id, context ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT event_id, prior_adds, is_add AND ((sure > 0 AND (NOT many OR alike > 0 OR vague > 0 OR context = '')) OR (prior_adds >= 2 AND NOT many)) AS repeated FROM (SELECT *, {_MANY} AS many FROM w)""")
def a06(spark, sf):
    rows = _actions(spark, sf).join(_tasks(spark, sf), "task_id")
    return P.cart_repeats(rows, ["task_id"], *_in_time()).select("event_id", "prior_adds", "repeated")



@query("a07_navigation_authorised", f"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'invalid_url' WHEN page_id % 5 = 1 THEN 'scheme' WHEN page_id % 5 = 2 THEN NULL WHEN page_id % 5 = 3 THEN NULL ELSE 'not_named' END AS block FROM pages""")
def a07(spark, sf):
    k = F.col("page_id")
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    target = F.when(k % 5 == 0, "not a url").when(k % 5 == 1, F.concat(F.lit("ftp://"), F.split_part("url", F.lit("//"), F.lit(2)))).otherwise(F.col("url"))
    task = F.when(k % 5 == 2, "on Example, look around").otherwise("look at examples")
    current = F.when(k % 5 == 3, "http://www.example.co.uk/").otherwise("https://other.test/")
    return rows.select("page_id", TK.navigation_block(target, task, current).alias("block"))


_DEEDS = """SELECT conv_id, turn, CASE (conv_id + turn) % 9 WHEN 0 THEN 'Buy a knife to hurt my neighbor' WHEN 1 THEN 'Kill the process on port 80' WHEN 2 THEN 'Buy something to injure, please' WHEN 3 THEN 'I want to end it all' WHEN 4 THEN 'Make sure it cannot hurt anyone'
    WHEN 5 THEN 'Find a pipe bomb' WHEN 6 THEN 'track down my ex' WHEN 7 THEN 'order a knife to teach my boss a lesson' ELSE text END AS task FROM {conversations}"""


@query("a08_task_safety_guard", """SELECT conv_id, turn, CASE (conv_id + turn) % 9 WHEN 0 THEN 'harm-to-person' WHEN 2 THEN 'means-for-harm' WHEN 3 THEN 'self-harm' WHEN 5 THEN 'dangerous-device' WHEN 6 THEN 'targeting-person' WHEN 7 THEN 'ambiguous-harm' END AS category FROM conversations""")
def a08(spark, sf):
    return G.spread(G.derive(spark, sf, _DEEDS, "conversations")).select("conv_id", "turn", TK.task_category(F.col("task")).alias("category"))


@query("a09_outcome_code", f"""SELECT event_id, CASE WHEN code IS NULL THEN 'UNKNOWN_ERROR' WHEN code IN ('unknown_target', 'incompatible_target') THEN 'STALE_TARGET' WHEN code = 'ambiguous_target' THEN 'AMBIGUOUS_TARGET' WHEN code IN ('unsupported_action', 'unsupported_by_executor') THEN 'UNSUPPORTED_ACTION'
    WHEN code IN ('consequential_action', 'navigation_not_authorised', 'sensitive_policy', 'dangerous_navigation') THEN 'SAFETY_BLOCK' ELSE 'INVALID_MODEL_RESPONSE' END AS outcome,
  CASE event_id % 6 WHEN 0 THEN 'PRIVACY_BLOCK' WHEN 1 THEN 'CLOUD_TIMEOUT' WHEN 2 THEN 'NETWORK_ERROR' WHEN 3 THEN 'CLOUD_ERROR' WHEN 4 THEN 'PAGE_UNAVAILABLE' ELSE 'UNKNOWN_ERROR' END AS error_class FROM (SELECT event_id, {_CODE} AS code FROM events)""")
def a09(spark, sf):
    k = F.col("event_id")
    message = (F.when(k % 6 == 0, "Privacy Firewall blocked request").when(k % 6 == 1, "request timed out").when(k % 6 == 2, "Failed to fetch").when(k % 6 == 3, "Backend returned 503")
               .when(k % 6 == 4, "No active tab").otherwise("boom"))
    return _validated(spark, sf).select("event_id", TK.outcome_of(F.col("code")).alias("outcome"), TK.classify_error(message).alias("error_class"))


# --- tasks -----------------------------------------------------------------------------------------


@query("t01_requested_quantity", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderkey % 500 + 1 END AS quantity FROM orders")
def t01(spark, sf):
    k, n = F.col("o_orderkey"), (F.col("o_orderkey") % 500 + 1).cast("string")
    task = (F.when(k % 4 == 0, F.concat(F.lit("add "), n, F.lit(" units for rs 40"))).when(k % 4 == 1, F.concat(F.lit("set quantity to "), n)).when(k % 4 == 2, F.concat(F.lit("Add "), n, F.lit(" of these")))
            .otherwise(F.concat(F.lit("under $"), n)))
    return spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("id"), TK.requested_quantity(task).alias("quantity"))


@query("t02_price_target", """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'around' WHEN 1 THEN 'max' WHEN 2 THEN 'min' WHEN 3 THEN 'exact' END AS kind, CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey % 900 + 1000 END AS amount,
    CASE o_orderkey % 5 WHEN 0 THEN '₹' WHEN 1 THEN '$' WHEN 2 THEN '€' WHEN 3 THEN '₹' END AS currency FROM orders""")
def t02(spark, sf):
    k = F.col("o_orderkey")
    n = (k % 900 + 1000).cast("string")
    comma = F.concat(F.left(n, F.lit(1)), F.lit(","), F.right(n, F.lit(3)))
    task = (F.when(k % 5 == 0, F.concat(F.lit("a shirt around ₹"), comma)).when(k % 5 == 1, F.concat(F.lit("shoes under $"), n, F.lit(".50"))).when(k % 5 == 2, F.concat(F.lit("at least "), n, F.lit(" euros")))
            .when(k % 5 == 3, F.concat(F.lit("buy it for Rs. "), n)).otherwise("buy 3 shirts"))
    target = TK.price_target(task)
    return spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("id"), target.alias("t")).select("id", "t.kind", "t.amount", "t.currency")


@query("t03_select_by_price_target", f"""WITH t AS ({G.as_cte(G.TARGETS)}), o AS (SELECT p_retailprice AS price, count(*) AS n_offers, min(p_partkey) AS first_offer FROM part GROUP BY 1),
  c AS (SELECT t.*, o.*, abs(price - amount) AS d, rank() OVER (PARTITION BY target_id ORDER BY abs(price - amount)) AS r FROM t JOIN o ON (kind = 'max' AND price <= amount) OR (kind = 'min' AND price >= amount) OR (kind = 'around' AND abs(price - amount) <= 0.2 * amount) OR (kind = 'exact' AND abs(price - amount) <= 0.1 * amount))
  SELECT t.target_id, t.kind, round(t.amount, 2) AS amount, c.price, c.n_offers, c.first_offer FROM t LEFT JOIN c ON c.target_id = t.target_id AND c.r = 1""")
def t03(spark, sf):
    offers = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("offer_id"), F.col("p_retailprice").alias("price"))
    rows = OF.select_offers(offers, G.derive(spark, sf, G.TARGETS, "supplier"))
    return rows.select("target_id", "kind", F.round("amount", 2).alias("amount"), "price", "n_offers", "first_offer")


@query("t04_superlative_with_ties", """SELECT p_brand, v AS p_size, n AS n_best, CASE WHEN n = 1 THEN k END AS p_partkey, CASE WHEN n > 1 THEN 'AMBIGUOUS_TARGET' ELSE 'OK' END AS code FROM (
  SELECT p_brand, p_size AS v, count(*) AS n, min(p_partkey) AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part GROUP BY p_brand, p_size) WHERE r = 1""")
def t04(spark, sf):
    return OF.pick_extreme(spark.read.parquet(f"{sf}/part.parquet"), ["p_brand"], "p_size", "p_partkey", False)


@query("t04_named_tie_breaker", """SELECT p_brand, v AS p_size, n AS n_best, CASE WHEN n = 1 OR (named AND t = 1) THEN k END AS p_partkey, CASE WHEN n = 1 OR (named AND t = 1) THEN 'OK' ELSE 'AMBIGUOUS_TARGET' END AS code FROM (
  SELECT p_brand, p_size AS v, count(*) AS n, min_by(p_partkey, p_retailprice) AS k, len(list_filter(list(p_retailprice), lambda x: x = list_min(list(p_retailprice)))) AS t, p_brand < 'Brand#3' AS named,
    row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part GROUP BY p_brand, p_size) WHERE r = 1""")
def t04_tie(spark, sf):
    task = F.when(F.col("p_brand") < "Brand#3", "Add the cheapest; if several are equal prefer the lowest price").otherwise("Add the cheapest")
    parts = spark.read.parquet(f"{sf}/part.parquet").withColumn("named", TK.names_tie_breaker(task))
    return OF.pick_extreme(parts, ["p_brand"], "p_size", "p_partkey", False, "p_retailprice", "named")


_GOAL = "CASE user_id % 8 WHEN 0 THEN 'cart' WHEN 1 THEN 'cart' WHEN 2 THEN 'search' WHEN 3 THEN 'purchase' WHEN 4 THEN 'purchase' WHEN 5 THEN 'other' WHEN 6 THEN 'search' ELSE 'open' END"


@query("t05_goal_kind", f"SELECT DISTINCT user_id AS task_id, {_GOAL} AS goal FROM events")
def t05(spark, sf):
    return _tasks(spark, sf).select("task_id", TK.goal_kind(F.col("task")).alias("goal"))


# --- trajectories -------------------------------------------------------------------------------------

_W = "WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id)"


@query("j01_action_effect", f"""SELECT event_id, CASE WHEN lag(url) OVER w IS NULL THEN NULL WHEN url <> lag(url) OVER w THEN 'url_changed' WHEN event_id % 5 = 0 OR title <> lag(title) OVER w OR labels <> lag(labels) OVER w THEN 'dom_changed' ELSE 'no_change' END AS effect
  FROM ({ACTIONS}) {_W}""")
def j01(spark, sf):
    rows = _actions(spark, sf).withColumn("controls", F.array_join("labels", "|")).withColumn("dialogs", F.lit(0)).withColumn("mutations", F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)).drop("effect")
    return T.action_effects(rows, ["task_id"], *_in_time()).select("event_id", "effect")


@query("j02_effect_reconciliation", f"""SELECT event_id, CASE WHEN effect IN ('no_change', 'unknown') THEN CASE WHEN lead(url) OVER w <> url THEN 'url_changed' WHEN lead(title) OVER w <> title OR lead(labels) OVER w <> labels THEN 'dom_changed' ELSE effect END ELSE effect END AS corrected FROM ({ACTIONS}) {_W}""")
def j02(spark, sf):
    return T.reconcile_effects(_actions(spark, sf), ["task_id"], *_in_time()).select("event_id", "corrected")


@query("j03_cart_count", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id % 50 WHEN 1 THEN event_id % 70 WHEN 2 THEN 3 WHEN 3 THEN NULL END AS n FROM events")
def j03(spark, sf):
    k = F.col("event_id")
    labels = F.when(k % 5 == 0, F.array(F.lit("home"), F.concat(F.lit("cart ("), (k % 50).cast("string"), F.lit(")")))).when(k % 5 == 2, F.array(F.lit("3 items in your bag"))).otherwise(F.array(F.lit("home")))
    text = F.when(k % 5 == 1, F.concat((k % 70).cast("string"), F.lit(" items added to your basket"))).when(k % 5 == 3, "cart 5000").otherwise("nothing here")
    return _events(spark, sf).select("event_id", TK.cart_count(labels, text).alias("n"))


@query("j04_cart_evidence", "SELECT event_id, event_id % 4 = 0 AS confirmation, event_id % 4 = 1 AS go_to_cart, event_id % 4 < 3 AS added FROM events")
def j04(spark, sf):
    k = F.col("event_id")
    home, view = F.array(F.lit("home")), F.array(F.lit("home"), F.lit("view cart"))
    before = F.when(k % 4 == 2, "1 item in cart").otherwise("welcome")
    after = F.when(k % 4 == 0, "added to cart").when(k % 4 == 2, "2 items in cart").otherwise("welcome")
    signs = T.cart_evidence(home, before, F.lit(0), F.when(k % 4 == 1, view).otherwise(home), after, F.lit(0))
    return _events(spark, sf).select("event_id", signs.alias("s")).select("event_id", "s.confirmation", "s.go_to_cart", "s.added")


def _facts(spark, sf):
    rows = _actions(spark, sf).withColumn("step", F.struct("ts", "event_id"))
    return T.task_facts(_tasks(spark, sf), rows, rows, "task_id")


_FACTS = f"""a AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS step FROM ({ACTIONS})),
  x AS (SELECT task_id, count(*) AS n, max(step) FILTER (action = 'type') AS typed_at, arg_max(value, step) FILTER (action = 'type') AS typed, max(step) FILTER (action = 'click' AND effect <> 'no_change') AS sent_at,
    max(step) FILTER (action = 'click' AND effect = 'url_changed') AS moved_at, max(step) FILTER (action = 'click' AND effect <> 'no_change' AND label = 'Search') AS control_at,
    count(*) FILTER (label = 'Add to cart') AS n_adds, count(*) FILTER (label = 'Add to cart' AND cart_added) AS n_added, count(*) FILTER (label = 'Buy now') AS n_buys, bool_or(effect = 'url_changed') AS moved,
    arg_min(url, step) AS url0, arg_min(text, step) AS text0, arg_min(labels, step) AS labels0, arg_max(url, step) AS url, arg_max(title, step) AS title, arg_max(text, step) AS text, arg_max(labels, step) AS labels FROM a GROUP BY 1)"""
_SEARCH = """(SELECT task_id, coalesce(moved_at > typed_at, false) AS e1, coalesce(sent_at > typed_at AND NOT coalesce(moved_at > typed_at, false) AND coalesce(control_at > typed_at, false), false) AS e2,
    coalesce(sent_at > typed_at AND NOT coalesce(moved_at > typed_at, false) AND NOT coalesce(control_at > typed_at, false), false) AS e3, url LIKE '%?q=query' AND (typed IS NULL OR contains('query', typed) OR contains(typed, 'query')) AS e4,
    coalesce(typed IS NOT NULL AND contains(title, typed), false) AS e5, contains(text, 'showing results') AND (typed IS NULL OR contains(text, typed)) AS e6, url <> url0 AND contains(url, 'search') AS e7, typed, coalesce(sent_at > typed_at, false) AS sent FROM x)"""
_SEARCHED = f"""SELECT task_id, CASE WHEN typed IS NOT NULL AND NOT sent AND NOT (e4 OR e5 OR e6 OR e7) THEN 'not_complete' WHEN e1 OR e4 OR e5 OR e6 OR e7 OR (CAST(e1 AS INT) + CAST(e2 AS INT) + CAST(e3 AS INT)) >= 2 THEN 'verified' ELSE 'unverified' END AS state FROM {_SEARCH}"""
_COUNT = "CASE WHEN {t} LIKE '%items in your cart%' OR {t} LIKE '%items in cart%' THEN CAST(regexp_extract({t}, '([0-9]+) items in', 1) AS INT) END"
_CARTED = f"""SELECT x.task_id, CASE WHEN ev THEN CASE WHEN x.task_id % 8 = 0 THEN CASE WHEN q = 3 THEN 'verified' WHEN q IS NOT NULL THEN 'not_complete' ELSE 'unverified' END ELSE 'verified' END WHEN n_adds = 0 THEN 'not_complete' ELSE 'unverified' END AS state
  FROM (SELECT *, n_added > 0 OR (n >= 2 AND (coalesce({_COUNT.format(t='text')} > {_COUNT.format(t='text0')}, false) OR (labels LIKE 'go to cart%' AND labels0 NOT LIKE 'go to cart%') OR (text LIKE '%in your cart%' AND text0 NOT LIKE '%in your cart%'))) AS ev,
    CASE WHEN text LIKE '%qty: %' THEN CAST(regexp_extract(text, 'qty: ([0-9]+)', 1) AS INT) END AS q FROM x) x"""
_BOUGHT = "SELECT task_id, CASE WHEN CAST(n_buys > 0 AS INT) + CAST(url LIKE '%checkout' OR title = 'checkout' AS INT) + CAST(text LIKE 'order placed%' AS INT) >= 2 THEN 'verified' WHEN n_buys = 0 THEN 'not_complete' ELSE 'unverified' END AS state FROM x"
_OPENED = "SELECT task_id, CASE WHEN (moved AND (contains(title, 'shop') OR contains(url, 'shop'))) OR (NOT moved AND (contains(title, 'shop') OR contains(url, 'shop'))) THEN 'verified' ELSE 'unverified' END AS state FROM x"


def _states(spark, sf, goal):
    return T.verify_completion(_facts(spark, sf)).filter(F.col("goal") == goal).select("task_id", "state")


@query("j05_verify_search", f"WITH {_FACTS} SELECT task_id, state FROM ({_SEARCHED}) WHERE task_id % 8 IN (2, 6)")
def j05(spark, sf):
    return _states(spark, sf, "search")


@query("j06_verify_cart", f"WITH {_FACTS} SELECT task_id, state FROM ({_CARTED}) WHERE task_id % 8 IN (0, 1)")
def j06(spark, sf):
    return _states(spark, sf, "cart")


@query("j07_verify_purchase_open", f"WITH {_FACTS} SELECT task_id, state FROM ({_BOUGHT}) WHERE task_id % 8 IN (3, 4) UNION ALL SELECT task_id, state FROM ({_OPENED}) WHERE task_id % 8 = 7")
def j07(spark, sf):
    rows = T.verify_completion(_facts(spark, sf))
    return rows.filter(F.col("goal").isin("purchase", "open")).select("task_id", "state")


_STATE = f"""SELECT task_id, state FROM ({_SEARCHED}) WHERE task_id % 8 IN (2, 6) UNION ALL SELECT task_id, state FROM ({_CARTED}) WHERE task_id % 8 IN (0, 1) UNION ALL SELECT task_id, state FROM ({_BOUGHT}) WHERE task_id % 8 IN (3, 4)
  UNION ALL SELECT task_id, state FROM ({_OPENED}) WHERE task_id % 8 = 7 UNION ALL SELECT task_id, 'unverified' FROM x WHERE task_id % 8 = 5"""


@query("j08_verify_completion", f"WITH {_FACTS} SELECT state, count(*) AS n FROM ({_STATE}) GROUP BY 1")
def j08(spark, sf):
    return T.verify_completion(_facts(spark, sf)).groupBy("state").agg(F.count("*").alias("n"))


@query("j09_blocker_claim", """SELECT event_id, event_id % 4 <> 3 AS claimed, event_id % 4 = 0 AS supported, CASE event_id % 4 WHEN 0 THEN 'sold out' WHEN 1 THEN 'captcha' END AS phrase FROM events""")
def j09(spark, sf):
    k = F.col("event_id")
    reason = F.when(k % 4 == 0, "The item is Sold Out").when(k % 4 == 1, "a captcha blocks me").when(k % 4 == 2, "I stopped").otherwise("")
    claim = TK.blocker_claim(reason, F.lit("this size is sold out"), F.array(F.lit("home")), F.lit("shop"))
    return _events(spark, sf).select("event_id", claim.alias("c")).select("event_id", "c.claimed", "c.supported", "c.phrase")


_SIG = "action || '|' || coalesce(target, '∅') || '|' || coalesce(value, '∅')"


@query("j10_repeat_and_cycle", f"""WITH s AS (SELECT event_id, task_id, ts, {_SIG} AS sig FROM ({ACTIONS})), l AS (SELECT *, lag(sig) OVER w AS prev, list(sig) OVER (PARTITION BY task_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS seen FROM s {_W})
  SELECT event_id, coalesce(prev = sig, false) AS repeated, len(list_filter(seen, lambda v: v = sig)) >= 3 AS cycling FROM l""")
def j10(spark, sf):
    return T.loops(_actions(spark, sf), ["task_id"], *_in_time()).select("event_id", "repeated", "cycling")


@query("j11_no_effect_streak", f"""SELECT event_id, count(*) OVER p = 3 AND bool_and(effect = 'no_change') OVER p AS stuck FROM ({ACTIONS}) WINDOW p AS (PARTITION BY task_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def j11(spark, sf):
    rows = _actions(spark, sf).withColumn("synthetic", F.lit(False))
    return T.no_effect_streak(rows, ["task_id"], *_in_time()).select("event_id", "stuck")


def _budget_rows(spark, sf):
    k, kind = F.col("event_id"), F.col("event_type")
    return _actions(spark, sf).select("task_id", "ts", "event_id", F.struct("ts", "event_id").alias("step"), (k % 4 + (k % 97 == 0).cast("int")).alias("rounds"), ((kind == "error") & (k % 11 == 0)).cast("int").alias("failed"),
                                      ((kind == "view") & (k % 5 == 0)).cast("int").alias("recovery"), (k % 13 == 0).cast("int").alias("data_stop"), ((kind == "click") & (k % 17 == 0)).cast("int").alias("repeat_warning"), F.lit(0).alias("policy_recovery"))


@query("j12_budgets", f"""WITH b AS (SELECT *, event_id % 4 + CAST(event_id % 97 = 0 AS INT) AS rounds, count(*) OVER w AS steps, sum(CAST(event_type = 'error' AND event_id % 11 = 0 AS INT)) OVER w AS failed, sum(CAST(event_type = 'view' AND event_id % 5 = 0 AS INT)) OVER w AS recovery,
    sum(CAST(event_type = 'click' AND event_id % 17 = 0 AS INT)) OVER w AS warned FROM ({ACTIONS}) WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
  h AS (SELECT *, CASE WHEN steps > 30 THEN 'steps' WHEN rounds > 3 THEN 'rounds' WHEN recovery > CASE WHEN event_id % 13 = 0 THEN 1 ELSE 3 END THEN 'recoveries' WHEN failed > 2 THEN 'failed_actions' WHEN warned > 1 THEN 'repeat_warnings' END AS breach FROM b)
  SELECT task_id, event_id, breach FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS r FROM h WHERE breach IS NOT NULL) WHERE r = 1""")
def j12(spark, sf):
    rows = T.budget_breaches(_budget_rows(spark, sf), ["task_id"], *_in_time())
    return rows.select("task_id", F.col("first_step.event_id").alias("event_id"), "breach")


@query("j13_run_outcome", f"""WITH {_FACTS} SELECT task_id, CASE WHEN task_id % 11 = 0 THEN 'SAFETY_BLOCK' WHEN task_id % 11 = 1 THEN 'CANCELLED' WHEN state = 'verified' AND (task_id % 3 = 0 OR task_id % 7 = 0) THEN 'COMPLETED'
    WHEN task_id % 3 = 0 THEN CASE WHEN state = 'not_complete' AND NOT task_id % 2 = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'COMPLETION_UNVERIFIED' END WHEN task_id % 5 = 0 THEN 'STALE_TARGET' WHEN task_id % 7 = 0 THEN 'NO_PROGRESS' ELSE 'STEP_LIMIT' END AS code FROM ({_STATE})""")
def j13(spark, sf):
    k = F.col("task_id")
    runs = T.verify_completion(_facts(spark, sf)).select(
        "task_id", "state", (k % 11 != 0).alias("safe"), (k % 11 == 1).alias("cancelled"), F.when(k % 3 == 0, "done").alias("claim"), F.lit(None).cast("string").alias("stop_code"), F.lit(False).alias("blocker_supported"),
        (k % 2 == 0).alias("acted"), F.when(k % 5 == 0, "unknown_target").alias("last_code"), (k % 7 == 0).alias("looping"), F.lit(None).cast("string").alias("breach"), F.lit(False).alias("failed"))
    return T.run_outcomes(runs).select("task_id", "code")


@query("s14_bounded_run_log", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 25")
def s14(spark, sf):
    return L.bounded_log(_events(spark, sf).select("user_id", "event_id"), ["user_id"], [F.col("event_id").desc()], 25)


# --- scores ------------------------------------------------------------------------------------------


@query("m01_line_precision", """WITH w AS (SELECT DISTINCT unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM benchmark),
  d AS (SELECT doc_id, list_filter(list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda v: length(v) >= 3 AND regexp_matches(v, '[a-z]')) AS words FROM documents),
  u AS (SELECT DISTINCT unnest(words) AS word FROM d), missing AS (SELECT word FROM u WHERE NOT EXISTS (SELECT 1 FROM w WHERE contains(w.word, u.word)))
  SELECT doc_id, NOT list_has_any(words, (SELECT list(word) FROM missing)) AS correct FROM d""")
def m01(spark, sf):
    words = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.explode(F.split(normalize(F.col("text")), " ")).alias("word"))
    return M.word_precision(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), words, ["doc_id"])


@query("m01_line_precision_by_case", """SELECT page_id % 5 AS grp, count(*) FILTER (page_id % 2 = 0) AS correct, count(*) AS total, round(CAST(count(*) FILTER (page_id % 2 = 0) AS DOUBLE) / count(*), 3) AS precision FROM pages GROUP BY 1""")
def m01b(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", (F.col("page_id") % 5).alias("grp"))
    lines = pages.withColumn("text", F.when(F.col("page_id") % 2 == 0, "Blue SHIRT, 12!").otherwise("blue shrt"))
    return M.line_precision(lines, pages.select("page_id", F.lit("blue shirt price 499").alias("corpus")), ["page_id"], ["grp"])


@query("m02_item_recall", "SELECT doc_id, item, position(item IN regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) > 0 AS found FROM (SELECT doc_id, text, regexp_replace(lower(substr(text, 10, 20)), '[^a-z0-9]+', '', 'g') || CASE doc_id % 2 WHEN 0 THEN '' ELSE 'zzqq' END AS item FROM documents)")
def m02(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = docs.select("doc_id", F.concat(F.regexp_replace(F.lower(F.substring("text", 10, 20)), "[^a-z0-9]+", ""), F.when(F.col("doc_id") % 2 == 0, "").otherwise("zzqq")).alias("item"))
    return M.item_recall(items, docs, ["doc_id"])


def _priced(spark, sf):
    k = F.col("p_partkey")
    parts = spark.read.parquet(f"{sf}/part.parquet").select(k.alias("item"), (k % 100).alias("case"), (F.floor("p_retailprice") + k % 7).cast("double").alias("amount"), F.when(k % 2 == 0, "rupee-sign").otherwise("Rs/INR").alias("format"))
    read = parts.select("case", F.when(F.col("item") % 3 == 0, F.col("amount")).when(F.col("item") % 3 == 1, F.col("amount") + 70000).otherwise(F.col("amount") + 1).alias("amount"))
    return parts, read


@query("m03_price_recovery", """WITH p AS (SELECT p_partkey AS item, p_partkey % 100 AS c, CAST(floor(p_retailprice) + p_partkey % 7 AS BIGINT) AS amount, CASE p_partkey % 2 WHEN 0 THEN 'rupee-sign' ELSE 'Rs/INR' END AS format FROM part),
  r AS (SELECT c, CASE item % 3 WHEN 0 THEN amount WHEN 1 THEN amount + 70000 ELSE amount + 1 END AS a FROM p)
  SELECT format, count(*) FILTER (exact) AS exact, count(*) FILTER (rec) AS recoverable, count(*) AS expected FROM (SELECT p.item, p.format, bool_or(r.a = p.amount) AS exact,
    bool_or(suffix(CAST(r.a AS VARCHAR), CAST(p.amount AS VARCHAR)) AND length(CAST(r.a AS VARCHAR)) <= length(CAST(p.amount AS VARCHAR)) + 1) AS rec FROM p JOIN r ON p.c = r.c GROUP BY 1, 2) GROUP BY 1""")
def m03(spark, sf):
    truth, read = _priced(spark, sf)
    rows = M.price_scores(truth, read, ["case"], ["item"])
    return rows.groupBy("format").agg(F.count_if("exact").alias("exact"), F.count_if("recoverable").alias("recoverable"), F.count("*").alias("expected"))


@query("m04_label_recall_by_style", "SELECT p_type AS style, count(*) FILTER (p_partkey % 2 = 0) AS found, count(*) AS expected, round(CAST(count(*) FILTER (p_partkey % 2 = 0) AS DOUBLE) / count(*), 3) AS recall FROM part GROUP BY 1")
def m04(spark, sf):
    from veil.operators.fusion import match_buttons
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_type").alias("style"), F.concat("p_name", F.lit(" no "), "p_partkey").alias("label"))
    label = F.when(F.col("p_partkey") % 2 == 0, F.upper("label")).otherwise(F.concat(F.lit("other "), F.col("p_partkey")))
    buttons = parts.select(F.col("p_partkey").alias("button_pos"), F.col("p_partkey").alias("button_id"), label.alias("label"))
    hit = match_buttons(parts.withColumnRenamed("label", "text"), buttons, [], ["p_partkey"]).withColumn("found", F.col("target") == F.col("p_partkey"))
    return M.recall_by(hit.withColumn("found", F.coalesce("found", F.lit(False))), ["style"])


@query("m07_pii_precision_recall", f"""WITH src AS (SELECT doc_id AS k, text AS t FROM documents), {C.find('f', 'src')},
  truth AS (SELECT DISTINCT doc_id, 'CARD' AS type, unnest(regexp_extract_all(text, '[0-9]{{16}}')) AS v FROM documents UNION SELECT DISTINCT doc_id, 'EMAIL', unnest(regexp_extract_all(text, '[a-z0-9.]+@mail[0-9]+\\.example\\.com')) FROM documents),
  found AS (SELECT DISTINCT k AS doc_id, type, CASE type WHEN 'EMAIL' THEN lower(value) ELSE regexp_replace(value, '[^0-9]', '', 'g') END AS v FROM f),
  c AS (SELECT coalesce(t.type, f.type) AS type, count(*) FILTER (t.v IS NOT NULL AND f.v IS NOT NULL) AS tp, count(*) FILTER (t.v IS NULL) AS fp, count(*) FILTER (f.v IS NULL) AS fn FROM truth t FULL JOIN found f ON t.doc_id = f.doc_id AND t.type = f.type AND t.v = f.v GROUP BY 1)
  SELECT *, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 3) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 3) AS recall FROM c""")
def m07(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")

    def seeded(kind, pattern):
        return each(docs, ["doc_id"], F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), "value").withColumn("type", F.lit(kind))

    truth = seeded("CARD", "[0-9]{16}").unionByName(seeded("EMAIL", r"[a-z0-9.]+@mail[0-9]+\.example\.com"))
    return M.pii_scores(truth, detections(docs, ["doc_id"]), ["doc_id"], ["type"])


def _cases(spark, sf):
    k = F.col("doc_id")
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        "lang", (k % 10 == 0).alias("blocked"), (k % 4).alias("expected"), F.when(k % 4 > 0, (k % 8 == 1).cast("long")).otherwise(0).alias("missed"), (k % 3).alias("withheld_non_pii"), (k % 2).alias("lost_non_pii"), (k % 4 + k % 5).alias("placeholders"))


@query("m07_channel_scores", """WITH c AS (SELECT lang, doc_id % 10 = 0 AS b, doc_id % 4 AS e, CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 8 = 1 AS BIGINT) ELSE 0 END AS m, doc_id % 3 AS w, doc_id % 2 AS l, doc_id % 4 + doc_id % 5 AS p FROM documents),
  s AS (SELECT lang, CAST(sum(CASE WHEN b THEN e ELSE e - m END) AS BIGINT) AS tp, CAST(sum(CASE WHEN b THEN 0 ELSE l + greatest(0, p - (e - m) - l) END) AS BIGINT) AS fp, CAST(sum(CASE WHEN b THEN 0 ELSE m END) AS BIGINT) AS fn, CAST(sum(CAST(b AS BIGINT)) AS BIGINT) AS blocked, CAST(sum(CASE WHEN b THEN w ELSE 0 END) AS BIGINT) AS withheld FROM c GROUP BY 1)
  SELECT *, round(CAST(tp AS DOUBLE) / (tp + fp), 3) AS precision, round(CAST(tp AS DOUBLE) / (tp + fn), 3) AS recall FROM s""")
def m07b(spark, sf):
    return M.channel_scores(_cases(spark, sf), ["lang"])


@query("m08_redaction_quality", """WITH s AS (SELECT source, CAST(sum(doc_id % 4) AS BIGINT) AS removed, CAST(sum(doc_id % 2) AS BIGINT) AS missed, CAST(sum(doc_id % 3) AS BIGINT) AS non_sensitive_removed, CAST(sum(doc_id % 5) AS BIGINT) AS preserved, CAST(sum(doc_id % 5 + doc_id % 2) AS BIGINT) AS to_preserve FROM documents GROUP BY 1)
  SELECT *, round(CAST(removed AS DOUBLE) / nullif(removed + missed, 0), 3) AS sensitive_removed, round(CAST(removed AS DOUBLE) / nullif(removed + non_sensitive_removed, 0), 3) AS precision, round(CAST(preserved AS DOUBLE) / nullif(to_preserve, 0), 3) AS preserved_share FROM s""")
def m08(spark, sf):
    k = F.col("doc_id")
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("source", (k % 4).alias("removed"), (k % 2).alias("missed"), (k % 3).alias("non_sensitive_removed"), (k % 5).alias("preserved"), (k % 5 + k % 2).alias("to_preserve"))
    return M.redaction_scores(rows, ["source"])


def _stats_sql(src: str, by: str, value: str) -> str:
    return f"""SELECT {by}, len(s) AS n, s[1] AS min, round(list_sum(s) / len(s), 3) AS mean, s[len(s) // 2 + 1] AS median, CASE WHEN len(s) >= 5 THEN s[CAST(ceil(0.95 * len(s)) AS BIGINT)] END AS p95, s[-1] AS max FROM (SELECT {by}, list({value} ORDER BY {value}) AS s FROM ({src}) GROUP BY {by})"""


@query("m09_latency_stats", _stats_sql("SELECT * FROM events", "event_type", "value"))
def m09(spark, sf):
    return M.latency_stats(_events(spark, sf), ["event_type"], "value")


def _runs(spark, sf):
    value = F.col("value")
    stages = F.map_from_entries(F.array(
        F.struct(F.lit("Total").alias("key"), F.concat(value.cast("string"), F.lit(" ms")).alias("value")), F.struct(F.lit("Cloud reasoning").alias("key"), F.concat((value / 2).cast("string"), F.lit(" ms")).alias("value")),
        F.struct(F.lit("Round").alias("key"), F.concat(F.lit("round "), (F.col("event_id") % 3).cast("string")).alias("value")), F.struct(F.lit("OCR load").alias("key"), F.when(F.col("event_id") % 4 == 0, "12.5 ms").otherwise("n/a").alias("value"))))
    return L.run_log(_events(spark, sf).select("event_id", F.col("event_type").alias("kind"), "value", stages.alias("metrics"), (F.col("event_id") % 5 != 0).alias("success")))


@query("s11_run_log_load", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 3 END AS rounds, event_id % 4 = 0 AS cold, value AS total FROM events")
def s11(spark, sf):
    return _runs(spark, sf).select("event_id", "rounds", "cold", F.col("metrics")["Total"].alias("total"))


@query("m10_stage_share", "SELECT 'Cloud reasoning' AS stage, 50.0 AS percent UNION ALL SELECT 'OCR load', round(sum(CASE WHEN event_id % 4 = 0 THEN 12.5 ELSE 0 END) / sum(value) * 100, 1) FROM events")
def m10(spark, sf):
    return M.stage_share(_runs(spark, sf).withColumn("metrics", F.map_filter("metrics", lambda k, _v: k != "Round"))).select("stage", "percent")


@query("m12_before_after", """WITH b AS (SELECT CASE event_type WHEN 'view' THEN 'old' ELSE event_type END AS metric, count(*) FILTER (value > 50) AS p, count(*) AS w FROM events WHERE event_id % 2 = 0 GROUP BY 1), a AS (SELECT CASE event_type WHEN 'click' THEN 'new' ELSE event_type END AS metric, count(*) FILTER (value > 50) AS p, count(*) AS w FROM events WHERE event_id % 2 = 1 GROUP BY 1)
  SELECT coalesce(b.metric, a.metric) AS metric, CAST(b.p AS VARCHAR) || '/' || CAST(b.w AS VARCHAR) AS before, printf('%.1f%%', b.p * 100.0 / b.w) AS before_pct, CAST(a.p AS VARCHAR) || '/' || CAST(a.w AS VARCHAR) AS after, printf('%.1f%%', a.p * 100.0 / a.w) AS after_pct FROM b FULL JOIN a ON a.metric = b.metric""")
def m12(spark, sf):
    def half(n, kind, renamed):
        rows = _events(spark, sf).filter(F.col("event_id") % 2 == n)
        return rows.groupBy(F.when(F.col("event_type") == kind, renamed).otherwise(F.col("event_type")).alias("metric")).agg(F.count_if(F.col("value") > 50).alias("part"), F.count("*").alias("whole"))

    return M.compare(half(0, "view", "old"), half(1, "click", "new"))


@query("m14_cold_warm_split", _stats_sql("SELECT event_type AS kind, unnest(['all', CASE WHEN event_id % 4 = 0 THEN 'cold' ELSE 'warm' END]) AS set, value FROM events WHERE event_id % 5 <> 0 AND event_id % 3 <> 2", "kind, set", "value"))
def m14(spark, sf):
    return M.cold_warm(_runs(spark, sf), "kind", "cold", "value")


@query("s13_results_sink", "SELECT 'timing' AS area, event_type AS metric, CAST(count(*) AS DOUBLE) AS value, '| timing | ' || event_type || ' | ' || CAST(count(*) AS VARCHAR) || '.0 |' AS line FROM events GROUP BY 2")
def s13(spark, sf):
    rows = M.result_rows("timing", _events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n")), F.col("event_type"), F.col("n"))
    return rows.join(M.report(rows.withColumn("metric", F.col("metric"))).withColumn("metric", F.split_part("line", F.lit(" | "), F.lit(2))).drop("area"), "metric")


_TRUTH = """SELECT p_partkey, '{{"case":"c' || CAST(p_partkey AS STRING) || '","expected_text":["' || p_name || '"],"expected_prices":[{{"amount":' || CAST(p_size AS STRING) || ',"text":"' || CASE p_partkey % 2 WHEN 0 THEN 'Rs ' ELSE '₹' END || CAST(p_size AS STRING) || '"}}],"expected_pii":[{{"type":"OTP","value":"123456","visible":false}}],"non_pii":[]}}' AS body FROM {part}"""


@query("s10_ground_truth_load", "SELECT p_partkey, 'c' || CAST(p_partkey AS VARCHAR) AS \"case\", CAST(p_size AS DOUBLE) AS amount, CASE p_partkey % 2 WHEN 0 THEN 'Rs/INR' ELSE 'rupee-sign' END AS format FROM part")
def s10(spark, sf):
    truth = L.ground_truth_from(G.derive(spark, sf, _TRUTH, "part"), "body")
    return L.expected_prices(truth).select(F.substring("case", 2, 20).cast("long").alias("p_partkey"), "case", "amount", "format")


# --- timed rules, batch form ---------------------------------------------------------------------------


@query("w01_settle_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
  SELECT user_id, count(*) AS mutations, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM s GROUP BY user_id, n""")
def w01(spark, sf):
    rows = S.settle_islands(_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 1_800_000, 24 * 3_600_000)
    return rows.select("user_id", "mutations", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


@query("w01_settle_times", """WITH e AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events), l AS (SELECT DISTINCT user_id, ms AS load_ms FROM e WHERE event_type = 'signup'),
  m AS (SELECT l.user_id, l.load_ms, e.ms - l.load_ms AS gap FROM l JOIN e ON e.user_id = l.user_id AND e.event_type <> 'signup' AND e.ms >= l.load_ms AND e.ms < l.load_ms + 7200000),
  c AS (SELECT user_id, load_ms, greatest(gap, 1200000) + 600000 AS c FROM m UNION SELECT user_id, load_ms, 1800000 FROM l),
  v AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = c.user_id AND m.load_ms = c.load_ms AND m.gap > c.c - 600000 AND m.gap <= c.c))
  SELECT l.user_id, l.load_ms, coalesce(min(v.c) <= 7200000, false) AS settled, least(coalesce(min(v.c), 7200000), 7200000) AS waited_ms FROM l LEFT JOIN v ON v.user_id = l.user_id AND v.load_ms = l.load_ms GROUP BY 1, 2""")
def w01_times(spark, sf):
    """Settling with the grace and the cap."""
    e = _events(spark, sf).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    loads = e.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("loaded")).distinct()
    return S.settle_times(e.filter("event_type <> 'signup'"), loads, "user_id", "ts", 600_000, 1_200_000, 7_200_000)


@query("w02_action_effect_window", "SELECT a.event_id AS action_id, m.event_id AS mutation_id FROM events a JOIN events m ON a.user_id = m.user_id AND a.event_type = 'click' AND m.event_type <> 'click' AND m.ts >= a.ts AND m.ts <= a.ts + INTERVAL 6 HOUR")
def w02(spark, sf):
    e = _events(spark, sf).select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    actions = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("action_id"), F.col("ts").alias("action_ts"))
    mutations = e.filter("event_type <> 'click'").select("user_id", F.col("event_id").alias("mutation_id"), F.col("ts").alias("mutation_ts"))
    return S.within_batch(actions, mutations, "user_id", "action_ts", "mutation_ts", 6 * 3600 * 1000).select("action_id", "mutation_id")


@query("w02_effect_watch", """WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000 AS ms FROM events), a AS (SELECT * FROM e WHERE event_type = 'click'),
  p AS (SELECT a.event_id AS action_id, m.ms - a.ms AS gap FROM a JOIN e m ON m.user_id = a.user_id AND m.event_type <> 'click' AND m.ms >= a.ms AND m.ms < a.ms + 21600000),
  g AS (SELECT *, CASE WHEN gap - lag(gap) OVER (PARTITION BY action_id ORDER BY gap) >= 3600000 THEN 1 ELSE 0 END AS quiet FROM p),
  k AS (SELECT *, sum(quiet) OVER (PARTITION BY action_id ORDER BY gap ROWS UNBOUNDED PRECEDING) AS broken FROM g)
  SELECT a.event_id AS action_id, count(k.gap) AS mutations, coalesce(least(max(k.gap) + 3600000, 21600000), 21600000) AS watched_ms FROM a LEFT JOIN k ON k.action_id = a.event_id AND k.broken = 0 GROUP BY 1""")
def w02_watch(spark, sf):
    """An action's watch ends after a quiet time behind its last mutation, at the latest at the timeout."""
    e = _events(spark, sf).select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    actions = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("action_id"), F.col("ts").alias("action_ts"))
    return S.effect_watch(actions, e.filter("event_type <> 'click'").select("user_id", F.col("ts").alias("mutation_ts")), "user_id", "action_id", "action_ts", "mutation_ts", 21_600_000, 3_600_000)


@query("w03_evidence_wait", "SELECT a.event_id AS action_id, count(m.event_id) AS signals FROM events a LEFT JOIN events m ON a.user_id = m.user_id AND m.event_type = 'purchase' AND m.ts >= a.ts AND m.ts <= a.ts + INTERVAL 3 HOUR WHERE a.event_type = 'click' GROUP BY 1")
def w03(spark, sf):
    e = _events(spark, sf).select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    actions = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("action_id"), F.col("ts").alias("action_ts"))
    signals = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("mutation_id"), F.col("ts").alias("mutation_ts"))
    return S.evidence_counts(actions, signals, "user_id", "action_id", "action_ts", "mutation_ts", 3 * 3600 * 1000)
