import re

from pyspark.sql import functions as F

from veil import rules
from veil.functions import detect as D, text as X
from veil.operators import fields as FL

TEXTS = [
    ("mail jane.doe@mail.example.com now", [("EMAIL", "jane.doe@mail.example.com")]),
    ("card 4111 1111 1111 1111 ok", [("CARD", "4111 1111 1111 1111")]),
    ("card 4111 1111 1111 1112 ok", []),
    ("amex 3782-822463-10005.", [("CARD", "3782-822463-10005")]),
    ("call 98765 43210", [("PHONE", "98765 43210")]),
    ("call +91 98765 43210 today", [("PHONE", "+91 98765 43210")]),
    ("ring (555) 123-4567", [("PHONE", "(555) 123-4567")]),
    ("Order ID: 9876543210", []),
    ("Invoice 9876543210 phone 9876543210", [("PHONE", "9876543210")]),
    ("OTP: 482913, thanks", [("OTP", "482913")]),
    ("OTP: contact support", []),
    ("password: hunter2.", [("PASSWORD", "hunter2")]),
    ("cvv=123", [("CVV", "123")]),
    ("otp: [OTP_1]", []),
    ("Shipping address: 42 Park Street", []),
    ("é9876543210 über", [("PHONE", "9876543210")]),
    ("no personal data, 2 items, 12:30", []),
]


def test_spans_match_the_specified_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "i int, text string")
    rows = {r.i: r.s for r in df.select("i", D.find_spans(F.col("text")).alias("s")).collect()}
    for i, (text, expected) in enumerate(TEXTS):
        got = [(s.type, s.value) for s in rows[i]]
        assert [g for g in got if g in expected] == expected and len(got) == len(expected), (text, got)
        assert all(text[s.start:s.start + len(s.value)] == s.value for s in rows[i])


def test_offsets_hold_on_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spans = docs.select("text", F.explode_outer(D.find_spans(F.col("text"))).alias("s")).filter("s is not null")
    assert spans.filter(F.substring("text", F.col("s.start") + 1, F.length("s.value")) != F.col("s.value")).count() == 0
    assert spans.count() > 0


def test_field_classification_needs_agreeing_evidence(spark):
    cols = "input_type string, autocomplete string, name string, id string, class string, placeholder string, aria_label string, field_label string, nearby string, value string"
    rows = [
        ("password", "", "", "", "", "", "", "", "", ""), ("text", "cc-number", "", "", "", "", "", "", "", ""), ("text", "", "user_email", "", "", "", "", "", "", ""),
        ("text", "", "order", "", "", "", "", "", "", "9876543210"), ("text", "", "x", "", "", "", "", "", "Mobile", "9876543210"), ("text", "", "", "", "", "", "headphones", "", "", ""),
        ("text", "", "email_address", "", "", "", "", "", "", ""), ("email", "", "phone", "", "", "", "", "Phone", "", ""),
    ]
    got = [(r.type, r.score) for r in FL.classify_fields(spark.createDataFrame(rows, cols)).collect()]
    assert got == [("PASSWORD", 3), ("CARD", 3), ("EMAIL", 2), (None, None), ("PHONE", 2), (None, None), ("EMAIL", 2), ("PHONE", 4)]


def test_a_pattern_runs_once_a_text(spark):
    text = F.col("text")
    df = spark.createDataFrame([("otp: 1234",)], "text string")
    for pattern, spans in ((rules.LABELLED, D.labelled_spans(text)), (rules.EMAIL, D.email_spans(text)), ("[0-9a-f]{16,}", X.match_spans(text, "[0-9a-f]{16,}", "x", F.lit(True)))):
        assert df.select(spans.alias("s"))._jdf.queryExecution().analyzed().toString().count(X.jvm(pattern)) == 1


def test_places_and_values_with_control_characters(spark):
    texts = ["", "\x01", "\x02a@b.co\x01", "password: x\x01\x02y.z1; otp=4321\x01mail é𝒳\x01 u\x01v@w.com, E-mail : q\x02@w.com", "pin\x01\x01 passcode = \x01\x01\x01\x01.",
             "Phone: +91 98765 43210. address: 7 Park\x01 Street 9;", "\x01" * 5 + "cvv: 123,cvc=4567;;"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = rows.select("i", D.labelled_spans(F.col("text")).alias("pairs"), D.email_spans(F.col("text")).alias("mails")).collect()
    blank = re.compile(r"[.,;:]+$")
    for r in got:
        assert [(s.start, s.value) for s in r.mails] == [(m.start(), m[0]) for m in re.finditer(rules.EMAIL, texts[r.i])]
        every = [(m.start(2), blank.sub("", m[2])) for m in re.finditer(rules.LABELLED, texts[r.i], re.ASCII)]
        assert [(s.start, s.value) for s in r.pairs] == [x for x in every if x in {(s.start, s.value) for s in r.pairs}]
        assert all(texts[r.i][s.start:s.start + len(s.value)] == s.value for s in r.pairs)
    assert [[s.type for s in r.pairs] for r in sorted(got)] == [[], [], [], ["PASSWORD", "EMAIL"], ["PASSWORD"], ["PHONE"], ["CVV", "CVV"]]
