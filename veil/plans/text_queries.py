"""Queries over text: detection, fields, redaction, verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil import rules
from veil.functions import detect as D, text as X
from veil.functions.payload import check_image, check_patterns, check_structure
from veil.operators import fields as FL, known as K, redact as R, request as Q, verify as V
from veil.plans import check_sql as C, derived as G
from veil.plans.ordered import each, where
from veil.plans.registry import query

DOCS = "SELECT doc_id AS k, text AS t FROM documents"
LABELLED = G.as_cte(G.LABELLED_TEXT)
FIELDS = G.as_cte(G.FIELDS)
PAYLOADS = G.as_cte(G.PAYLOADS)


def _docs(spark, sf, *columns):
    return G.spread(G.table(spark, sf, "documents").select("doc_id", "text", *columns))


def _labelled(spark, sf):
    return G.spread(G.derive(spark, sf, G.LABELLED_TEXT, "orders"))


def _fields(spark, sf):
    return G.spread(G.derive(spark, sf, G.FIELDS, "customer"))


def _payloads(spark, sf):
    return G.spread(G.derive(spark, sf, G.PAYLOADS, "documents"))


def _rows(df, key, spans):
    out = each(df, [key], spans, "s")
    return out.select(key, F.col("s.start").cast("long").alias("start"), F.col("s.type").alias("type"), F.col("s.value").alias("value"))


def _span_oracle(key: str, src: str, parts: str, name: str = "f") -> str:
    return f"WITH src AS ({src}), {parts} SELECT k AS {key}, start, type, value FROM {name}"


@query("d01_email_spans", f"WITH src AS ({DOCS}) SELECT k AS doc_id, start, type, value FROM ({C.plain('src', C.EMAIL, 'EMAIL', 0)})")
def d01(spark, sf):
    return _rows(_docs(spark, sf), "doc_id", D.email_spans(F.col("text")))


@query("d02_card_spans", f"WITH src AS ({DOCS}) SELECT k AS doc_id, rank AS pattern, start, value FROM ("
       + " UNION ALL ".join(C.bounded("src", p, "CARD", i, C.luhn("value")) for i, p in enumerate(C.CARDS)) + ")")
def d02(spark, sf):
    lists = F.array(*[F.struct(F.lit(i).cast("long").alias("pattern"), spans.alias("spans")) for i, spans in enumerate(D.card_span_lists(F.col("text")))])
    rows = each(each(_docs(spark, sf), ["doc_id"], lists, "l"), ["doc_id", "l"], F.col("l.spans"), "s")
    return rows.select("doc_id", F.col("l.pattern").alias("pattern"), F.col("s.start").cast("long").alias("start"), F.col("s.value").alias("value"))


@query("d03_phone_spans", f"WITH src AS ({DOCS} UNION ALL SELECT -1 - id, text FROM ({LABELLED})) SELECT k AS key, rank AS pattern, start, value FROM ("
       + " UNION ALL ".join(C.bounded("src", p, "PHONE", i, f"NOT {C.identifier('t', 'start')}") for i, p in enumerate(C.PHONES)) + ")")
def d03(spark, sf):
    texts = _docs(spark, sf).withColumnRenamed("doc_id", "key").unionByName(_labelled(spark, sf).select((F.lit(-1) - F.col("id")).alias("key"), "text"))
    lists = F.array(*[F.struct(F.lit(i).cast("long").alias("pattern"), spans.alias("spans")) for i, spans in enumerate(D.phone_span_lists(F.col("text")))])
    rows = each(each(texts, ["key"], lists, "l"), ["key", "l"], F.col("l.spans"), "s")
    return rows.select("key", F.col("l.pattern").alias("pattern"), F.col("s.start").cast("long").alias("start"), F.col("s.value").alias("value"))


@query("d04_identifier_guard", f"WITH src AS (SELECT id AS k, text AS t FROM ({LABELLED})) SELECT c.k AS id, start, {C.identifier('s.t', 'start')} AS identifier "
       f"FROM ({C.bounded('src', C.MOBILE, 'PHONE', 0)}) c JOIN src s ON s.k = c.k")
def d04(spark, sf):
    text = F.col("text")
    found = X.match_spans(text, rules.PHONES[0], "PHONE", F.lit(True))
    judged = F.transform(found, lambda s: F.struct(s["start"].alias("start"), D.looks_like_identifier(text, s["start"]).alias("identifier")))
    return each(_labelled(spark, sf), ["id"], judged, "s").select("id", F.col("s.start").cast("long").alias("start"), F.col("s.identifier").alias("identifier"))


@query("d05_labelled_values", f"WITH src AS (SELECT id AS k, text AS t FROM ({LABELLED})) SELECT k AS id, start, type, value FROM ({C.labelled('src', 0)})")
def d05(spark, sf):
    return _rows(_labelled(spark, sf), "id", D.labelled_spans(F.col("text")))


@query("d06_claimed_spans", _span_oracle("doc_id", DOCS, C.find("f", "src")))
def d06(spark, sf):
    return _rows(_docs(spark, sf), "doc_id", D.find_spans(F.col("text")))


@query("d06_claimed_labelled", _span_oracle("id", f"SELECT id AS k, text AS t FROM ({LABELLED})", C.find("f", "src")))
def d06b(spark, sf):
    return _rows(_labelled(spark, sf), "id", D.find_spans(F.col("text")))


_STRONG = f"""SELECT field_id, CASE input_type WHEN 'password' THEN 'PASSWORD' WHEN 'email' THEN 'EMAIL' WHEN 'tel' THEN 'PHONE' END AS type, 3 AS weight, 'type=' || input_type AS signal FROM ({FIELDS}) WHERE input_type <> 'text'
  UNION ALL SELECT field_id, CASE tok WHEN 'cc-number' THEN 'CARD' WHEN 'one-time-code' THEN 'OTP' WHEN 'email' THEN 'EMAIL' WHEN 'street-address' THEN 'ADDRESS' END, 3, 'autocomplete=' || tok
    FROM (SELECT field_id, unnest(string_split(autocomplete, ' ')) AS tok FROM ({FIELDS})) WHERE tok IN ('cc-number', 'one-time-code', 'email', 'street-address')"""
_KEYWORDS = [
    (r"(?i)\bpassw(?:or)?d\b|\bpasscode\b", "PASSWORD"), (r"(?i)\botp\b|\bone[\s_-]?time\b|\bverification code\b", "OTP"),
    (r"(?i)\bcv[vc]2?\b|\bsecurity code\b", "CVV"),
    (r"(?i)\bcard[\s_-]?(?:number|no|num)\b|\bcc[\s_-]?(?:number|num)\b|\bcredit card\b|\bdebit card\b", "CARD"),
    (r"(?i)\be[\s_-]?mail\b", "EMAIL"), (r"(?i)\bphone\b|\bmobile\b|\btel\b|\btelephone\b|\bcontact number\b|\bwhatsapp\b", "PHONE"),
    (r"(?i)\b(?:street|shipping|billing|delivery|home|postal)?[\s_-]?address\b", "ADDRESS"),
]
_ATTRS = " UNION ALL ".join(
    f"SELECT field_id, '{signal}' AS attr, {weight} AS weight, regexp_replace({column}, '[_-]+', ' ', 'g') AS v FROM ({FIELDS})"
    for column, signal, weight in [("name", "name", 2), ("id", "id", 2), ("class", "class", 2), ("placeholder", "placeholder", 2),
                                   ("aria_label", "aria-label", 2), ("field_label", "label", 2), ("nearby", "nearby", 1)])
_KEYWORD = " UNION ALL ".join(f"SELECT field_id, '{kind}' AS type, weight, attr || '~' || lower('{kind}') AS signal FROM ({_ATTRS}) WHERE regexp_matches(v, {C.lit(p)})" for p, kind in _KEYWORDS)
_SHAPE = f"""SELECT field_id, CASE WHEN {C.luhn('value')} AND regexp_matches(value, '^[0-9 -]+$') THEN 'CARD' WHEN regexp_matches(value, '(?i)^[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}$') THEN 'EMAIL'
  WHEN regexp_matches(value, '^(\\+?91[ -]?)?[6-9][0-9]{{4}}[ -]?[0-9]{{5}}$') THEN 'PHONE' WHEN regexp_matches(value, '^[0-9]{{3,4}}$') THEN 'CVV' WHEN regexp_matches(value, '^[0-9]{{4,8}}$') THEN 'OTP' END AS type FROM ({FIELDS})"""


def _votes(df, votes):
    return each(df, ["field_id"], votes, "v").select("field_id", F.col("v.type").alias("type"), F.col("v.weight").cast("long").alias("weight"), F.col("v.signal").alias("signal"))


@query("d07_strong_field_votes", f"SELECT field_id, type, CAST(weight AS BIGINT) AS weight, signal FROM ({_STRONG})")
def d07(spark, sf):
    return _votes(_fields(spark, sf), FL.strong_votes())


@query("d08_keyword_field_votes", f"SELECT field_id, type, CAST(weight AS BIGINT) AS weight, signal FROM ({_KEYWORD})")
def d08(spark, sf):
    return _votes(_fields(spark, sf), FL.keyword_votes())


@query("d09_value_shape_vote", f"SELECT field_id, type FROM ({_SHAPE})")
def d09(spark, sf):
    return _fields(spark, sf).select("field_id", D.value_shape(F.col("value")).alias("type"))


_CLASSES = f"""SELECT field_id, type, score FROM (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY score DESC, strong DESC, o) AS r FROM (
  SELECT field_id, type, sum(weight) AS score, max(CASE WHEN weight >= 3 THEN 1 ELSE 0 END) AS strong,
    list_position(['PASSWORD','OTP','CVV','CARD','EMAIL','PHONE','ADDRESS'], type) AS o
  FROM (SELECT field_id, type, weight FROM ({_STRONG}) UNION ALL SELECT field_id, type, weight FROM ({_KEYWORD})
    UNION ALL SELECT field_id, type, 1 FROM ({_SHAPE}) WHERE type IS NOT NULL) GROUP BY 1, 2) WHERE score >= 2) WHERE r = 1"""


@query("d10_classify_field", f"SELECT f.field_id, c.type, CAST(c.score AS BIGINT) AS score FROM ({FIELDS}) f LEFT JOIN ({_CLASSES}) c ON c.field_id = f.field_id")
def d10(spark, sf):
    return FL.classify_fields(_fields(spark, sf)).select("field_id", "type", F.col("score").cast("long").alias("score"))


@query("d11_label_type_and_shape", f"""SELECT field_id, label_type, CASE label_type WHEN 'CARD' THEN regexp_matches(value, '^([0-9][ -]?){{12,18}}[0-9]$') WHEN 'CVV' THEN regexp_matches(value, '^[0-9]{{3,4}}$')
    WHEN 'OTP' THEN regexp_matches(value, '^[0-9]{{4,8}}$') WHEN 'PHONE' THEN regexp_matches(value, '^\\+?[0-9 ()-]{{8,16}}$') WHEN 'EMAIL' THEN regexp_matches(value, '^[^@\\s]+@[^@\\s]+\\.[a-z]{{2,}}$')
    WHEN 'PASSWORD' THEN regexp_matches(value, '[0-9•*#@!$%^&_]') AND regexp_matches(value, '^\\S{{4,}}$')
    WHEN 'ADDRESS' THEN length(value) BETWEEN 6 AND 120 AND regexp_matches(value, '(?i)[a-z]') AND regexp_matches(value, '[0-9]') ELSE false END AS fits
  FROM (SELECT field_id, value, CASE {' '.join(f"WHEN regexp_matches(v, {C.lit(p)}) THEN '{kind}'" for p, kind in _KEYWORDS)} END AS label_type
    FROM (SELECT field_id, value, regexp_replace(name, '[_-]+', ' ', 'g') AS v FROM ({FIELDS})))""")
def d11(spark, sf):
    kind = D.label_type(F.col("name"))
    return _fields(spark, sf).select("field_id", kind.alias("label_type"), D.matches_shape(F.coalesce(kind, F.lit("")), F.col("value")).alias("fits"))


@query("d12_leak_spans", _span_oracle("doc_id", DOCS, C.leaks("f", "src")))
def d12(spark, sf):
    return _rows(_docs(spark, sf), "doc_id", D.leak_spans(F.col("text")))


@query("d15_pii_summary", f"WITH src AS ({DOCS}), {C.find('f', 'src')} SELECT d.lang, d.source, f.type, count(*) AS n FROM f JOIN documents d ON d.doc_id = f.k GROUP BY ROLLUP (d.lang, d.source, f.type)")
def d15(spark, sf):
    return R.pii_summary(R.detections(_docs(spark, sf, "lang", "source"), ["lang", "source"]), ["lang", "source", "type"])


# --- redaction -----------------------------------------------------------------------------------


@query("r01_placeholder_assignment", f"WITH {C.redacted(DOCS)} SELECT k AS doc_id, type, n, placeholder, value FROM vault")
def r01(spark, sf):
    vault = each(R.redact_rows(_docs(spark, sf)), ["doc_id"], F.col("vault"), "e")
    return vault.select("doc_id", F.col("e.type").alias("type"), F.col("e.n").cast("long").alias("n"), F.col("e.placeholder").alias("placeholder"), F.col("e.value").alias("value"))


@query("r01_placeholders_per_owner", f"""WITH lt AS ({LABELLED}), src AS (SELECT id AS k, text AS t FROM lt), {C.find('f', 'src')},
  firsts AS (SELECT owner, value, arg_min(type, id * 1000 - start) AS type, min(id * 1000 - start) AS o FROM f JOIN lt ON lt.id = f.k GROUP BY owner, value)
  SELECT owner, type, value, row_number() OVER (PARTITION BY owner, type ORDER BY o) AS n FROM firsts""")
def r01b(spark, sf):
    spans = each(_labelled(spark, sf), ["owner", "id"], D.find_spans(F.col("text")), "s")
    found = spans.select(F.col("owner").alias("scope"), F.col("id").alias("seq"), F.lit(1).alias("pass"), (-F.col("s.start")).alias("back"),
                         F.col("s.type").alias("type"), F.col("s.value").alias("value"))
    return R.assign_placeholders(found).select(F.col("scope").alias("owner"), "type", "value", "n")


_OTHER = """SELECT c_custkey AS scope, 1 AS seq, 'first' AS step, 'call 98765 4' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || ' or User' || CAST(c_custkey AS STRING) || '@Mail.example.com' AS text FROM {customer}
  UNION ALL SELECT c_custkey, 2, 'second', 'again 987654' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || ', user' || CAST(c_custkey AS STRING) || '@mail.example.com and 9-8-7-6-5-4-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') FROM {customer}"""


@query("r02_replace_known_values", f"""SELECT scope, CAST(seq AS BIGINT) AS seq, CASE seq WHEN 1 THEN text
  ELSE 'again [PHONE_1], [EMAIL_1] and [PHONE_1]' END AS replaced FROM ({G.as_cte(_OTHER)})""")
def r02(spark, sf):
    texts = G.derive(spark, sf, _OTHER, "customer").withColumn("seq", F.col("seq").cast("long"))
    spans = each(texts.filter(F.col("seq") == 1), ["scope", "seq"], D.find_spans(F.col("text")), "s")
    found = spans.select("scope", "seq", F.lit(1).alias("pass"), (-F.col("s.start")).alias("back"), F.col("s.type").alias("type"), F.col("s.value").alias("value"))
    vault = R.assign_placeholders(found).select("scope", "value", F.col("placeholder").alias("mark"), F.col("seq").alias("since"))
    return R.replace_known(texts, vault, ["seq"]).select("scope", "seq", "replaced")


@query("r03_redact_text", f"WITH {C.redacted(DOCS)} SELECT k AS doc_id, redacted FROM final")
def r03(spark, sf):
    return R.redact_rows(_docs(spark, sf)).select("doc_id", "redacted")


@query("r03_redact_labelled", f"WITH {C.redacted(f'SELECT id AS k, text AS t FROM ({LABELLED})')} SELECT k AS id, redacted FROM final")
def r03b(spark, sf):
    return R.redact_rows(_labelled(spark, sf)).select("id", "redacted")


@query("r04_register_field_values", f"""WITH seeds AS (SELECT f.field_id, f.field_id % 100 AS scope, c.type, trim(f.value) AS value FROM ({FIELDS}) f JOIN ({_CLASSES}) c ON c.field_id = f.field_id WHERE trim(f.value) <> ''),
  firsts AS (SELECT scope, value, min_by(type, field_id) AS type FROM seeds GROUP BY scope, value) SELECT scope, type, value FROM firsts""")
def r04(spark, sf):
    scoped = FL.classify_fields(_fields(spark, sf)).withColumn("scope", F.col("field_id") % 100)
    seeds = FL.field_seeds(scoped, "scope", F.col("field_id"))
    vault = R.first_registrations(seeds.select("*", F.lit(0).alias("pass"), F.lit(0).alias("back")))
    return vault.select("scope", "type", "value")


@query("r06_redact_with_context", f"SELECT field_id, CASE WHEN field_id % 10 = 0 AND field_id % 3 <> 0 THEN '9876512345' ELSE '[PHONE_1]' END AS redacted FROM ({FIELDS})")
def r06(spark, sf):
    rows = _fields(spark, sf).select("field_id", F.lit("9876512345").alias("text"),
                                     F.when((F.col("field_id") % 10 == 0) & (F.col("field_id") % 3 != 0), "Order reference")
                                     .when(F.col("field_id") % 3 == 0, "Phone").otherwise("").alias("context"))
    return R.redact_with_context(rows, "text", "context").select("field_id", "redacted")


_VALUES = "SELECT field_id, CASE WHEN field_label <> '' THEN field_label ELSE nearby END AS context, value AS text FROM ({fields})"
_VALUES_SQL = _VALUES.format(fields=FIELDS)
_IN_CONTEXT = f"SELECT field_id AS k, CASE WHEN context = '' OR text = '' THEN text ELSE context || ': ' || text END AS t FROM ({_VALUES_SQL})"


@query("r06_field_values_in_context", f"""WITH both_ AS (WITH {C.redacted(_IN_CONTEXT)} SELECT k, redacted FROM final), bare AS (WITH {C.redacted(f'SELECT field_id AS k, text AS t FROM ({_VALUES_SQL})')} SELECT k, redacted FROM final)
  SELECT v.field_id, CASE WHEN context = '' OR text = '' OR NOT starts_with(both_.redacted, context || ': ') THEN bare.redacted ELSE substr(both_.redacted, length(context) + 3) END AS redacted
  FROM ({_VALUES_SQL}) v JOIN both_ ON both_.k = v.field_id JOIN bare ON bare.k = v.field_id""")
def r06_values(spark, sf):
    """Every field's own value behind its label."""
    context = F.when(F.col("field_label") != "", F.col("field_label")).otherwise(F.col("nearby"))
    rows = _fields(spark, sf).select("field_id", context.alias("context"), F.col("value").alias("text"))
    return R.redact_with_context(rows, "text", "context").select("field_id", "redacted")


_TURNS = """SELECT conv_id, turn, text || ' mail c' || CAST(conv_id AS STRING) || '@mail.example.com or t' || CAST(turn AS STRING) || '@mail.example.com' AS text FROM {conversations}"""


@query("r07_sanitize_request", f"""WITH turns AS ({G.as_cte(_TURNS)}), low AS (SELECT conv_id, min(turn) AS lo FROM turns GROUP BY conv_id)
  SELECT t.conv_id, t.turn, c.text || ' mail [EMAIL_2] or [EMAIL_' || CAST(CASE WHEN t.turn = lo THEN 1 ELSE 1 + dense_rank() OVER (PARTITION BY t.conv_id ORDER BY t.turn) END AS VARCHAR) || ']' AS redacted
  FROM turns t JOIN low ON low.conv_id = t.conv_id JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn""")
def r07(spark, sf):
    turns = G.derive(spark, sf, _TURNS, "conversations")
    rows, _vault = R.redact(turns, ["conv_id", "turn"], "text", "conv_id", "turn")
    return rows.select("conv_id", "turn", "redacted")


_REQUEST_BODY = f"""SELECT request_id, '{{"task":' || to_json(replace(task, 'task' || request_id || '@mail.example.com', '[EMAIL_1]'))
  || ',"page":{{"url":"https://shop.example.com/list?q=[EMAIL_1]","title":"Cart of [EMAIL_2]","elements":[{{"id":"el_a","tag":"input","text":"[PHONE_1]","role":"textbox","context":"near [PASSWORD_1]","options":["ship to [EMAIL_2]","none"]}},'
  || '{{"id":"el_b","tag":"b","text":"Order ID: 9876512345","role":"note"}},{{"id":"el_c","tag":"b","text":"send [EMAIL_3]","role":"note"}}],"text":'
  || to_json(replace(replace(replace(text, otp, '[OTP_1]'), '98765-4' || right(phone, 4), '[PHONE_1]'), 'user' || request_id || '@MAIL.example.com', '[EMAIL_2]'))
  || '}},"placeholders":["[PASSWORD_1]","[OTP_1]","[EMAIL_1]","[EMAIL_2]","[PHONE_1]","[EMAIL_3]"' || CASE WHEN guidance IS NULL THEN '' ELSE ',"[EMAIL_4]"' END || ']'
  || CASE WHEN n_turns % 2 = 0 THEN ',"visual":{{"engine":"lines","observations":[{{"type":"text","text":"Total for [EMAIL_2]","bbox":{{"x":1,"y":2,"width":30,"height":4}},"confidence":1,"target":null}}],"conflicts":["price"]}}' ELSE '' END
  || ',"history":[' || array_to_string(list_transform(range(3, 13), lambda i: '{{"action":"type","target":"el_a","value":"step ' || i || ' [PASSWORD_1]"'
       || CASE WHEN i % 2 = 0 THEN '' ELSE ',"effect":"dom_changed","note":"saw [OTP_1]"' END || '}}'), ',') || ']'
  || CASE WHEN guidance IS NULL THEN '' ELSE ',"guidance":"' || repeat('g', 380) || ' ask [EMAIL_4]"' END || '}}' AS body, CASE WHEN guidance IS NULL THEN 6 ELSE 7 END AS n_placeholders,
  'allowed' AS verdict, CAST(NULL AS VARCHAR) AS reason FROM ({G.as_cte(G.REQUESTS)})"""


def _requests(spark, sf):
    base = G.derive(spark, sf, G.REQUESTS, "conversations")
    text = lambda ahead, c: F.concat(F.lit(ahead), F.col(c))
    mail = lambda name: F.concat(F.lit(name), F.col("request_id").cast("string"), F.lit("@mail.example.com"))
    element = lambda i, tag, t, role, label, context, options: F.struct(
        F.lit(i).alias("id"), F.lit(tag).alias("tag"), t.alias("text"), F.lit(role).alias("role"), F.lit(label).alias("label"), context.alias("context"), options.alias("options"))
    absent, none = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    elements = F.array(
        element("el_a", "input", F.col("phone"), "textbox", "Phone", text("near ", "secret"), F.array(F.concat(F.lit("ship to "), mail("user")), F.lit("none"))),
        element("el_b", "b", F.lit("Order ID: 9876512345"), "note", "Order reference", absent, none),
        # Its label holds a value itself, so the bare text is redacted.
        element("el_c", "b", F.concat(F.lit("send "), mail("own")), "note", "write to first@mail.example.com", absent, none))
    box = F.struct(F.lit(1).alias("x"), F.lit(2).alias("y"), F.lit(30).alias("width"), F.lit(4).alias("height"))
    seen = F.struct(F.lit("text").alias("type"), F.concat(F.lit("Total for "), mail("user")).alias("text"), box.alias("bbox"), F.lit(1).alias("confidence"), absent.alias("target"))
    visual = F.when(F.col("n_turns") % 2 == 0, F.struct(F.lit("lines").alias("engine"), F.array(seen).alias("observations"), F.array(F.lit("price")).alias("conflicts")))
    past = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.struct(
        F.lit("type").alias("action"), F.lit("el_a").alias("target"), F.concat(F.lit("step "), i.cast("string"), F.lit(" "), F.col("secret")).alias("value"),
        F.when(i % 2 == 1, F.lit("dom_changed")).alias("effect"), F.when(i % 2 == 1, text("saw ", "otp")).alias("note")))
    value = lambda kind, c: F.array(F.struct(F.lit(kind).alias("type"), F.col(c).alias("value")))
    return base.select("request_id", "task", "url", "title", "text", "guidance", elements.alias("elements"), visual.alias("visual"), past.alias("history"),
                       value("PASSWORD", "secret").alias("fields"), value("OTP", "otp").alias("lines"))


@query("r07_whole_request", _REQUEST_BODY)
def r07b(spark, sf):
    done = Q.sanitize(_requests(spark, sf))
    return done.select("request_id", "body", F.size("placeholders").alias("n_placeholders"), "verdict", "reason")


@query("r11_resolve_placeholder", "SELECT doc_id, text AS restored FROM documents")
def r11(spark, sf):
    return R.rehydrate_rows(R.redact_rows(_docs(spark, sf))).select("doc_id", "restored")


@query("r12_redact_for_log", "SELECT doc_id, regexp_replace(text, '[0-9]{6,}', '[NUMBER]', 'g') AS logged FROM documents")
def r12(spark, sf):
    return _docs(spark, sf).select("doc_id", R.redact_for_log(F.col("text")).alias("logged"))


# --- verification ------------------------------------------------------------------------------------

_STRUCTURE = "CASE doc_id % 12 WHEN 1 THEN 'task is not a string' WHEN 2 THEN 'element has unexpected shape' WHEN 3 THEN 'element context invalid' WHEN 9 THEN 'malformed placeholder name' END"


@query("l01_structure_check", f"SELECT doc_id, {_STRUCTURE} AS reason FROM documents")
def l01(spark, sf):
    return _payloads(spark, sf).select("doc_id", check_structure(F.col("body")).alias("reason"))


@query("l02_image_data_check", """SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)data:\\s*image/|base64,|image/(png|jpe?g|webp)|\\bPNG\\b.{0,4}IHDR') THEN 'image data detected in payload'
  WHEN regexp_matches(text, '[A-Za-z0-9+/]{400,}') THEN 'encoded binary data detected in payload' WHEN length(text) > 32000 THEN 'oversized field detected in payload' END AS reason FROM documents""")
def l02(spark, sf):
    body = F.to_json(F.struct("text"))
    return _docs(spark, sf).select("doc_id", check_image(body).alias("reason"))


@query("l03_known_value_check", """WITH vault AS (SELECT 'CARD' AS type, regexp_replace(v, '[^0-9]', '', 'g') AS value FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]{16}')) AS v FROM documents)
    UNION ALL SELECT 'EMAIL', v FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z0-9.]+@mail[0-9]+\\.example\\.com')) AS v FROM documents)
    UNION ALL SELECT 'PASSWORD', v FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9a-f]{40}')) AS v FROM documents)),
  runs AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[\\s-]', '', 'g'), '[0-9]{6,}')) AS run FROM documents)
  SELECT DISTINCT doc_id, type, value FROM runs JOIN vault ON run = value WHERE type = 'CARD'
  UNION ALL SELECT doc_id, type, value FROM documents JOIN vault ON contains(lower(text), lower(value)) WHERE type IN ('EMAIL', 'PASSWORD')""")
def l03(spark, sf):
    docs = _docs(spark, sf)

    def values(kind, pattern):
        return each(docs, [], F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), "value").distinct().withColumn("type", F.lit(kind))

    vault = values("CARD", "[0-9]{16}").unionByName(values("EMAIL", r"[a-z0-9.]+@mail[0-9]+\.example\.com")).unionByName(
        values("PASSWORD", "[0-9a-f]{40}"))
    return K.known_value_hits(docs, vault, ["doc_id"], "text")


@query("l04_pattern_check", "SELECT doc_id, CASE doc_id % 12 WHEN 4 THEN 'EMAIL' WHEN 5 THEN 'CARD' WHEN 6 THEN 'PHONE' END AS type FROM documents")
def l04(spark, sf):
    return _payloads(spark, sf).select("doc_id", check_patterns(F.col("body")).alias("type"))


@query("l04_redacted_is_clean", "SELECT doc_id, CAST(NULL AS VARCHAR) AS type FROM documents")
def l04b(spark, sf):
    return R.redact_rows(_docs(spark, sf)).select("doc_id", check_patterns(F.col("redacted")).alias("type"))


#: A body around each document's text as JSON has it; the checks read the whole body.
BODY = """'{"task":"read","page":{"url":"https://example.com/' || CAST(doc_id AS VARCHAR) || '","title":"' || lang || '","elements":[],"text":' || CAST(to_json(coalesce(text, '')) AS VARCHAR)
  || '},"placeholders":[]}'"""


def document_bodies(docs: DataFrame) -> DataFrame:
    """(doc_id, body): requests that carry whole documents as their page text."""
    element = "array<struct<id:string,tag:string,text:string,role:string>>"
    page = F.struct(F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")).alias("url"), F.col("lang").alias("title"),
                    F.array().cast(element).alias("elements"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", V.to_payload(F.lit("read"), page, F.array().cast("array<string>")).alias("body"))


_IMAGE = """CASE WHEN regexp_matches(t, '(?i)data:\\s*image/|base64,|image/(png|jpe?g|webp)|\\bPNG\\b.{0,4}IHDR') THEN 'image data detected in payload'
  WHEN regexp_matches(t, '[A-Za-z0-9+/]{400,}') THEN 'encoded binary data detected in payload' WHEN length(text) > 32000 THEN 'oversized field detected in payload' END"""


@query("l05_verify_documents", f"""WITH src AS (SELECT doc_id AS k, text, {BODY} AS t FROM documents), {C.leaks('f', 'src')},
  kinds AS (SELECT k, min(CASE type WHEN 'EMAIL' THEN '1EMAIL' WHEN 'CARD' THEN '2CARD' ELSE '3PHONE' END) AS kind FROM f GROUP BY k),
  r AS (SELECT src.k AS doc_id, {_IMAGE} AS image, substr(kind, 2) AS kind FROM src LEFT JOIN kinds ON kinds.k = src.k)
  SELECT doc_id, CASE WHEN image IS NULL AND kind IS NULL THEN 'allowed' ELSE 'blocked' END AS verdict, coalesce(image, kind || ' pattern detected') AS reason,
    CASE WHEN image IS NOT NULL THEN 2 ELSE 4 END AS n_checks FROM r""")
def l05_documents(spark, sf):
    """Bodies that carry whole documents, as they are."""
    rows = V.verify(document_bodies(G.spread(G.table(spark, sf, "documents"))), "body")
    return rows.select("doc_id", "verdict", "reason", F.size("checks").alias("n_checks"))


_VERDICT = f"""CASE WHEN doc_id % 12 = 11 THEN 'OTP leakage detected' WHEN doc_id % 12 IN (1, 2, 3, 9) THEN {_STRUCTURE} WHEN doc_id % 12 = 8 THEN 'image data detected in payload'
  WHEN doc_id % 12 = 4 THEN 'EMAIL pattern detected' WHEN doc_id % 12 = 5 THEN 'CARD pattern detected' WHEN doc_id % 12 = 6 THEN 'PHONE pattern detected' END"""


def _known(df):
    return df.withColumn("known", F.array(F.struct(F.lit("OTP").alias("type"), F.lit("123456").alias("value"))))


@query("l05_verify_payload", f"""SELECT doc_id, CASE WHEN reason IS NULL THEN 'allowed' ELSE 'blocked' END AS verdict, reason,
    CASE WHEN doc_id % 12 IN (4, 5, 6, 11) THEN split_part(reason, ' ', 1) WHEN reason IS NOT NULL THEN 'UNKNOWN' END AS type,
    CASE WHEN doc_id % 12 IN (1, 2, 3, 9) THEN 1 WHEN doc_id % 12 = 8 THEN 2 WHEN doc_id % 12 = 11 THEN 3 ELSE 4 END AS n_checks FROM (SELECT doc_id, {_VERDICT} AS reason FROM documents)""")
def l05(spark, sf):
    rows = V.verify(_known(_payloads(spark, sf)), "body", "known")
    return rows.select("doc_id", "verdict", "reason", "type", F.size("checks").alias("n_checks"))


@query("l06_gate_counts", f"""SELECT gate, gate_reason, count(*) AS n FROM (SELECT CASE WHEN reason IS NULL THEN 'allowed' ELSE 'blocked' END AS gate, '{rules.BLOCK_PREFIX}: ' || reason AS gate_reason
    FROM (SELECT doc_id, {_VERDICT} AS reason FROM documents)) GROUP BY 1, 2""")
def l06(spark, sf):
    return V.gate(_known(_payloads(spark, sf)), "body", "known").groupBy("gate", "gate_reason").agg(F.count("*").alias("n"))


_HISTORY = """SELECT event_id, '{{"task":"t","page":{{"url":"u","title":"t","elements":[],"text":"x"}},"placeholders":[],"history":[{{"action":"'
  || CASE event_id % 7 WHEN 1 THEN 'jump' ELSE 'click' END || '","target":' || CASE event_id % 7 WHEN 2 THEN '7' ELSE 'null' END || ',"value":"' || CASE event_id % 7 WHEN 3 THEN repeat('v', 201) ELSE 'v' END || '"'
  || CASE event_id % 7 WHEN 4 THEN ',"effect":"boom"' ELSE '' END || '}}],"visual":{{"engine":"e","conflicts":[],"observations":[{{"type":"text","text":"a","bbox":{{"x":1,"y":2,"width":3,"height":'
  || CASE event_id % 7 WHEN 5 THEN '"4"' ELSE '4.5' END || '}},"confidence":' || CASE event_id % 7 WHEN 6 THEN 'null' ELSE '0.9' END || ',"target":null}}]}}}}' AS body FROM {events}"""
_HISTORY_REASON = """CASE event_id % 7 WHEN 1 THEN 'history entry has unknown action' WHEN 2 THEN 'history target invalid' WHEN 3 THEN 'history value invalid'
  WHEN 4 THEN 'history effect invalid' WHEN 5 THEN 'observation bbox invalid' WHEN 6 THEN 'observation confidence invalid' END"""


@query("l07_history_visual_checks", f"SELECT event_id, {_HISTORY_REASON} AS reason FROM events")
def l07(spark, sf):
    return G.derive(spark, sf, _HISTORY, "events").select("event_id", check_structure(F.col("body")).alias("reason"))


@query("a10_closed_contract", f"SELECT reason, count(*) AS n FROM (SELECT {_HISTORY_REASON} AS reason FROM events) WHERE reason IS NOT NULL GROUP BY 1")
def a10(spark, sf):
    rows = G.derive(spark, sf, _HISTORY, "events").select(check_structure(F.col("body")).alias("reason"))
    return where(rows, F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))


@query("s08_request_payload", """SELECT id, '{"task":"read order ' || CAST(id AS VARCHAR) || '","page":{"url":"https://example.com/' || CAST(id AS VARCHAR) || '","title":"order","elements":[{"id":"el_a","tag":"a","text":"Go","role":"link"}],"text":"'
    || replace(text, chr(10), '\\n') || '"},"placeholders":["[OTP_1]"]' || CASE WHEN id % 2 = 0 THEN ',"history":[{"action":"click","target":null,"value":null}]' ELSE '' END || CASE WHEN id % 3 = 0 THEN ',"guidance":"next"' ELSE '' END || '}' AS body """
       + f"FROM ({LABELLED})")
def s08(spark, sf):
    ident = F.col("id").cast("string")
    element = F.struct(F.lit("el_a").alias("id"), F.lit("a").alias("tag"), F.lit("Go").alias("text"), F.lit("link").alias("role"))
    page = F.struct(F.concat(F.lit("https://example.com/"), ident).alias("url"), F.lit("order").alias("title"), F.array(element).alias("elements"), F.col("text").alias("text"))
    none = F.lit(None).cast("string")
    history = F.when(F.col("id") % 2 == 0, F.array(F.struct(F.lit("click").alias("action"), none.alias("target"), none.alias("value"))))
    body = V.to_payload(F.concat(F.lit("read order "), ident), page, F.array(F.lit("[OTP_1]")), history=history, guidance=F.when(F.col("id") % 3 == 0, F.lit("next")))
    return _labelled(spark, sf).select("id", body.alias("body"))


@query("s12_gate_routes", f"SELECT CASE WHEN reason IS NULL THEN 'allowed' ELSE 'quarantine' END AS route, reason IS NULL AS has_body, count(*) AS n FROM (SELECT {_VERDICT} AS reason FROM documents) GROUP BY 1, 2")
def s12(spark, sf):
    gated = V.gate(_known(_payloads(spark, sf)), "body", "known")
    kept = where(gated, F.col("gate") == "allowed").select(F.lit("allowed").alias("route"), F.col("body").isNotNull().alias("has_body"))
    held = where(gated, F.col("gate") == "blocked").select(F.lit("quarantine").alias("route"), F.lit(False).alias("has_body"))
    return kept.unionByName(held).groupBy("route", "has_body").agg(F.count("*").alias("n"))


@query("m11_network_audit", """SELECT doc_id, octet_length(encode(body)) AS bytes, 'task,page,placeholders' AS fields, CASE doc_id % 12 WHEN 9 THEN '[NAME_1]' WHEN 10 THEN '[EMAIL_1],[CARD_2]' ELSE '' END AS placeholders,
    contains(body, '9876543210') AS raw_value_present, doc_id % 12 = 8 AS image_data_present, false AS base64_run_present """ + f"FROM ({PAYLOADS})")
def m11(spark, sf):
    rows = _payloads(spark, sf).withColumn("known", F.array(F.struct(F.lit("PHONE").alias("type"), F.lit("9876543210").alias("value"))))
    return V.network_audit(rows, "body", "known").drop("page_text_chars")


@query("m13_line_level_scores", f"""WITH lt AS ({LABELLED}), src AS (SELECT id AS k, text AS t FROM lt), {C.find('f', 'src')}
  SELECT owner, count(*) FILTER (ok) AS tp, count(*) FILTER (NOT ok) AS fp FROM (SELECT owner, k, bool_or(type = 'EMAIL' AND value = 'user' || CAST(owner AS VARCHAR) || '@mail.example.com') AS ok
  FROM f JOIN lt ON lt.id = f.k GROUP BY 1, 2) GROUP BY 1""")
def m13(spark, sf):
    from veil.operators.metrics import line_scores
    texts = _labelled(spark, sf)
    spans = each(texts, ["owner", "id"], D.find_spans(F.col("text")), "s").select("owner", F.col("id").alias("line"), "s.type", "s.value")
    truth = texts.select("owner").distinct().withColumn("type", F.lit("EMAIL")).withColumn("value", F.concat(F.lit("user"), F.col("owner"), F.lit("@mail.example.com")))
    return line_scores(spans, truth, ["owner"])
