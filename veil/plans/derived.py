"""Inputs the given tables do not hold (forms, boxes, action logs, payloads), as arithmetic over them.

Each recipe is one SQL text that Spark and a checking engine read alike; tables are named in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LABELLED_TEXT = """
SELECT o_orderkey AS id, o_custkey AS owner,
  'Order ID: ' || CAST(9000000000 + o_orderkey AS STRING) || '.' || chr(10)
  || 'Phone: 9' || lpad(CAST((o_orderkey * 7919) % 1000000000 AS STRING), 9, '0') || chr(10)
  || 'OTP: ' || lpad(CAST((o_orderkey * 31) % 1000000 AS STRING), 6, '0')
  || ', Email: user' || CAST(o_custkey AS STRING) || '@mail.example.com; password: hunter' || CAST(o_orderkey % 50 AS STRING)
  || chr(10) || 'Shipping address: ' || CAST(o_orderkey % 90 + 1 AS STRING) || ' Park Street' AS text
FROM {orders}
"""

FIELDS = """
SELECT c_custkey AS field_id,
  CASE c_custkey % 7 WHEN 0 THEN 'password' WHEN 1 THEN 'email' WHEN 2 THEN 'tel' ELSE 'text' END AS input_type,
  CASE c_custkey % 11 WHEN 0 THEN 'section-a cc-number' WHEN 1 THEN 'one-time-code' WHEN 2 THEN 'email'
    WHEN 3 THEN 'street-address' ELSE '' END AS autocomplete,
  CASE c_custkey % 13 WHEN 0 THEN 'card_number' WHEN 1 THEN 'cvv' WHEN 2 THEN 'user-email' WHEN 3 THEN 'phone'
    WHEN 4 THEN 'shipping-address' WHEN 5 THEN 'otp' WHEN 6 THEN 'passcode' ELSE 'field' || CAST(c_custkey AS STRING) END AS name,
  CASE c_custkey % 3 WHEN 0 THEN 'headphones' ELSE '' END AS id, '' AS class,
  CASE c_custkey % 17 WHEN 0 THEN 'Verification code' WHEN 1 THEN 'Security code' ELSE '' END AS placeholder,
  CASE c_custkey % 19 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'E-mail' ELSE '' END AS aria_label,
  CASE c_custkey % 5 WHEN 0 THEN 'Credit card' WHEN 1 THEN 'Order reference' ELSE '' END AS field_label,
  CASE c_custkey % 4 WHEN 0 THEN 'Phone' WHEN 1 THEN 'OTP' ELSE '' END AS nearby,
  CASE c_custkey % 9 WHEN 0 THEN '4111 1111 1111 1111' WHEN 1 THEN 'u' || CAST(c_custkey AS STRING) || '@mail.example.com'
    WHEN 2 THEN '98765' || lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') WHEN 3 THEN CAST(c_custkey % 900 + 100 AS STRING)
    WHEN 4 THEN CAST(c_custkey % 900000 + 100000 AS STRING) WHEN 5 THEN '' ELSE 'value ' || CAST(c_custkey AS STRING) END AS value
FROM {customer}
"""

BOXES = """
SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS line,
  CAST((l_partkey % 40) * 20 AS DOUBLE) AS x, CAST(l_linenumber * 20 + (l_suppkey % 10) AS DOUBLE) AS y,
  CAST(40 + l_quantity * 4 AS DOUBLE) AS width, CAST(18 + (l_linenumber % 3) * 6 AS DOUBLE) AS height,
  CAST(40 + (l_partkey % 61) AS DOUBLE) / 100 AS confidence, l_partkey AS partkey, l_suppkey AS suppkey
FROM {lineitem}
"""

ACTIONS = """
SELECT event_id, user_id AS task_id, ts, event_type,
  CASE event_type WHEN 'view' THEN 'scroll' WHEN 'signup' THEN 'type' ELSE 'click' END AS action,
  CASE WHEN event_type = 'view' THEN NULL ELSE 'el_' || CAST(CAST(floor(value) AS BIGINT) % 5 AS STRING) END AS target,
  CASE WHEN event_type = 'signup' THEN 'query ' || CAST(event_id % 3 AS STRING) ELSE NULL END AS value,
  CASE event_type WHEN 'purchase' THEN 'url_changed' WHEN 'error' THEN 'no_change' WHEN 'view' THEN 'unknown' ELSE 'dom_changed' END AS effect,
  CASE event_type WHEN 'purchase' THEN 'Buy now' WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'Add to cart' ELSE 'Search' END ELSE '' END AS label,
  CASE WHEN event_type = 'click' AND event_id % 6 = 0 THEN true ELSE false END AS cart_added,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE 'item ' || CAST(event_id % 3 AS STRING) END AS context,
  'https://shop.example.com/' || CASE event_type WHEN 'purchase' THEN 'checkout' WHEN 'signup' THEN 'search?q=query' ELSE 'list' END AS url,
  CASE event_type WHEN 'purchase' THEN 'checkout' WHEN 'error' THEN 'error page' ELSE 'shop' END AS title,
  CASE WHEN event_type = 'purchase' THEN 'go to cart|home' ELSE 'add to cart|home' END AS labels,
  CASE event_type WHEN 'purchase' THEN 'order placed. ' || CAST(event_id % 7 AS STRING) || ' items in your cart. qty: ' || CAST(event_id % 4 AS STRING)
    WHEN 'click' THEN 'showing results for query ' || CAST(event_id % 3 AS STRING) || '. 2 items in cart' ELSE 'welcome' END AS text
FROM {events}
"""

TASKS = """
SELECT DISTINCT user_id AS task_id,
  CASE user_id % 8 WHEN 0 THEN 'Add to cart 3 units of the blue shirt' WHEN 1 THEN 'Add the red shirt to my cart'
    WHEN 2 THEN 'Search for query 1. Do not buy anything' WHEN 3 THEN 'Buy the cheapest shirt under rs 800'
    WHEN 4 THEN 'Open the checkout page' WHEN 5 THEN 'Never buy. Tell me what you see' WHEN 6 THEN 'Find shirts around $40 and sign in'
    ELSE 'Go to shop and delete my account for 499 rupees' END AS task
FROM {events}
"""

TARGETS = """
SELECT s_suppkey AS target_id, CASE s_suppkey % 4 WHEN 0 THEN 'around' WHEN 1 THEN 'max' WHEN 2 THEN 'min' ELSE 'exact' END AS kind,
  CAST(850 + (s_suppkey * 37) % 400 AS DOUBLE) + 0.05 AS amount
FROM {supplier}
"""

# A request body per document, with one fault per value of doc_id modulo 12.
PAYLOADS = """
SELECT doc_id, '{{"task":' || CASE doc_id % 12 WHEN 1 THEN '5' ELSE '"read"' END
  || ',"page":{{"url":"https://example.com/' || CAST(doc_id AS STRING) || '","title":"' || lang || '","elements":[{{"id":"el_a","tag":"a","text":"Go"'
  || CASE doc_id % 12 WHEN 2 THEN ',"onclick":"x"' WHEN 3 THEN ',"context":"' || repeat('c', 161) || '"' ELSE '' END || ',"role":"link"}}],"text":"'
  || CASE doc_id % 12 WHEN 4 THEN 'mail user' || CAST(doc_id AS STRING) || '@example.com' WHEN 5 THEN 'card 4111-1111-1111-1111'
       WHEN 6 THEN 'call 98765 43210' WHEN 7 THEN 'Order ID: 9876543210' WHEN 8 THEN 'data:image/png;base64,AAAA' WHEN 11 THEN 'pin 12-34-56' ELSE 'plain' END
  || '"}},"placeholders":[' || CASE doc_id % 12 WHEN 9 THEN '"[NAME_1]"' WHEN 10 THEN '"[EMAIL_1]","[CARD_2]"' ELSE '' END || ']}}' AS body
FROM {documents}
"""


# A whole request per conversation: fields, lines, task, url, title, elements with options, page text, visual, history and guidance.
REQUESTS = """
SELECT conv_id AS request_id, first_text || ' mail task' || CAST(conv_id AS STRING) || '@mail.example.com' AS task,
  'https://shop.example.com/list?q=Task' || CAST(conv_id AS STRING) || '@mail.example.com' AS url, 'Cart of user' || CAST(conv_id AS STRING) || '@mail.example.com' AS title,
  all_text || ' code ' || otp || ' or 98765-4' || tail || ' for "user' || CAST(conv_id AS STRING) || '@MAIL.example.com"' AS text,
  CASE WHEN conv_id % 4 = 0 THEN NULL ELSE repeat('g', 380) || ' ask guide' || CAST(conv_id AS STRING) || '@mail.example.com' END AS guidance,
  'secret' || CAST(conv_id AS STRING) || 'x' AS secret, otp, '98765 4' || tail AS phone, n_turns
FROM (SELECT conv_id, first_text, all_text, n_turns, CAST(100000 + (conv_id * 7919) % 900000 AS STRING) AS otp, lpad(CAST(conv_id % 10000 AS STRING), 4, '0') AS tail
  FROM (SELECT conv_id, min_by(text, turn) AS first_text, max_by(text, turn) AS all_text, count(*) AS n_turns FROM {conversations} GROUP BY conv_id))
"""


def spread(df: DataFrame) -> DataFrame:
    """Deals a table of few splits out to all cores, for steps that cost far more than the bytes by which Spark cuts files; a table of
    enough splits is left as it is. Only for tables as they are read, whose splits are known without running anything."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def derive(spark: SparkSession, sf_dir: str, recipe: str, *names: str) -> DataFrame:
    """Runs a recipe over the named tables."""
    return spark.sql(recipe, **tables(spark, sf_dir, *names))


def as_cte(recipe: str) -> str:
    """The same recipe as SQL text over registered views."""
    names = ("region nation customer supplier part orders lineitem events documents pages benchmark labels conversations").split()
    return recipe.format(**{n: n for n in names})
