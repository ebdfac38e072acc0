import re

import pytest
from pyspark.sql import functions as F

from veil.functions.payload import check_patterns
from veil.operators import known as K, redact as R, verify as V
from veil.session import settled, splits_for


def _one(spark, text):
    return R.redact_rows(spark.createDataFrame([(text,)], "text string")).first()


def test_later_spans_register_first(spark):
    assert _one(spark, "a@x.com and b@x.com").redacted == "[EMAIL_2] and [EMAIL_1]"
    assert _one(spark, "a@x.com and a@x.com").redacted == "[EMAIL_1] and [EMAIL_1]"
    assert _one(spark, "keep [EMAIL_1] as is").redacted == "keep [EMAIL_1] as is"
    assert _one(spark, "card 4111-1111 1111-1111").redacted == "card [CARD_1]"


def test_redacted_text_is_clean_reversible_and_stable(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    once = R.rehydrate_rows(R.redact_rows(docs))
    assert once.filter(F.col("restored") != F.col("text")).count() == 0
    assert once.filter(check_patterns(F.col("redacted")).isNotNull()).count() == 0
    twice = R.redact_rows(once.select("doc_id", F.col("redacted").alias("text")))
    assert twice.filter(F.col("redacted") != F.col("text")).count() == 0


TURNS = [("s", 1, "mail A@x.com, otp: 4455"), ("s", 2, "a@X.COM wrote 44-55 and b@x.com, 9876543210"), ("s", 3, "x 4455 98765 43210"), ("t", 1, "b@x.com")]
EXPECTED = ["mail [EMAIL_1], otp: [OTP_1]", "[EMAIL_1] wrote [OTP_1] and [EMAIL_2], [PHONE_1]", "x [OTP_1] [PHONE_1]", "[EMAIL_1]"]


def test_a_value_keeps_its_placeholder_in_its_scope(spark):
    rows, vault = R.redact(spark.createDataFrame(TURNS, "scope string, seq long, text string"), ["seq"])
    assert [r.redacted for r in rows.orderBy("scope", "seq").collect()] == EXPECTED
    assert vault.count() == 5


def brute_known(text, entries):
    """Known values replaced by the definition: places in the text as it stands, the longest value first, marks put in at the end."""
    taken = []
    for value, mark in sorted(entries, key=lambda e: -len(e[0])):
        raw = value.strip()
        if re.fullmatch(r"\+?[0-9\s-]+", raw):
            digits = re.sub("[^0-9]", "", raw)
            pattern = r"(?<![0-9+])\+?" + r"[\s-]*".join(digits) + "(?![0-9])" if len(digits) >= 4 else None
        else:
            pattern = re.escape(raw) if len(raw) >= 3 else None
        for m in re.finditer(pattern, text, re.I) if pattern else ():
            if all(m.end() <= a or m.start() >= b for a, b, _ in taken):
                taken.append((m.start(), m.end(), mark))
    for a, b, mark in sorted(taken, reverse=True):
        text = text[:a] + mark + text[b:]
    return text


KNOWN = [("a@x.com", "[EMAIL_1]"), ("email", "[PASSWORD_1]"), ("card", "[PASSWORD_2]"), ("4455", "[OTP_1]"), ("1234", "[OTP_2]"), ("hunter22", "[PASSWORD_3]"), ("hunter22 end", "[PASSWORD_4]"),
         ("123", "[CVV_1]"), ("no", "[PASSWORD_5]"), ("4111 1111 1111 1111", "[CARD_1234]"), ("(02) 555", "[PHONE_1]"), ("é$1\\", "[PASSWORD_6]")]
KNOWN_TEXTS = ["to a@x.com and b", "a@X.COM wrote 44-55, pw HUNTER22x, 1234567", "nothing 14455", "my Email card is 4111-1111 11111111 ok", "[EMAIL_1] stays? 1234", "hunter22 end hunter22 endhunter22",
               "call (02) 555 or 123 or no", "x" * 254 + "hunter22" + "y" * 300 + " EMAIL", "É$1\\ é$1\\", "", "4455 +4455 4 4 5 5"]


@pytest.mark.parametrize("more", [0, 3000])
def test_known_values_are_replaced_in_the_text_as_it_stands(spark, more):
    """Small and big vaults alike: no value is found inside a placeholder."""
    vault = spark.createDataFrame([("s", v, m, 1) for v, m in KNOWN] + [("s", f"absent{i}", f"[PASSWORD_{i + 10}]", 1) for i in range(more)]
                                  + [("t", "to", "[PASSWORD_1]", 1)], "scope string, value string, mark string, since long")
    texts = spark.createDataFrame([("s", 2 + i, t) for i, t in enumerate(KNOWN_TEXTS)] + [("s", 1, "a@x.com early")], "scope string, seq long, text string")
    got = {r.seq: r.replaced for r in R.replace_known(texts, vault, ["seq"]).collect()}
    assert got == {1: "a@x.com early"} | {2 + i: brute_known(t, KNOWN) for i, t in enumerate(KNOWN_TEXTS)}
    assert got[2] == "to [EMAIL_1] and b"


def test_known_values_across_scopes(spark):
    bodies = spark.createDataFrame([(1, "code 98 76-54 end"), (2, "x USER@mail.example.com"), (3, "1987654")], "k int, body string")
    vault = spark.createDataFrame([("OTP", "987654"), ("EMAIL", "user@mail.example.com"), ("CVV", "12"), ("PASSWORD", "secret1")], "type string, value string")
    assert sorted((r.k, r.type) for r in K.known_value_hits(bodies, vault, ["k"]).collect()) == [(1, "OTP"), (2, "EMAIL")]


GOOD = ('{"task":"t","page":{"url":"u","title":"t","elements":[{"id":"a","tag":"b","text":"c","role":"d","options":["x"]}],"text":"z"},"placeholders":["[EMAIL_1]"],'
        '"history":[{"action":"click","target":null,"value":"x"}],"visual":{"engine":"e","observations":[{"type":"text","text":"a","bbox":{"x":1,"y":2.5,"width":3,"height":4},"confidence":0.5,"target":null}],"conflicts":[]}}')
CASES = [
    (GOOD, "allowed", None, 4), (GOOD.replace('"t","page"', '5,"page"'), "blocked", "task is not a string", 1), (GOOD.replace('"d"', "null"), "blocked", "element fields are not strings", 1),
    (GOOD.replace("0.5", '"x"'), "blocked", "observation confidence invalid", 1), (GOOD.replace('"z"', '"a@b.com"'), "blocked", "EMAIL pattern detected", 4),
    (GOOD.replace('"z"', '"pass hunter22"'), "blocked", "PASSWORD leakage detected", 3), ('{"a":1}', "blocked", "payload has unexpected fields", 1), ("[]", "blocked", "payload is not an object", 1),
    ("{x", "blocked", "verification error (fail closed)", 0), (GOOD.replace('"z"', '"4111 1111-1111 1111"'), "blocked", "CARD pattern detected", 4),
    (GOOD.replace('"z"', '"98 76-54"'), "blocked", "OTP leakage detected", 3), (GOOD.replace('"z"', '"' + "A" * 400 + '"'), "blocked", "encoded binary data detected in payload", 2),
    (GOOD.replace('"z"', '"' + "ab " * 11000 + '"'), "blocked", "oversized field detected in payload", 2), (GOOD.replace('"visual"', '"extra"'), "blocked", "payload has unexpected fields", 1),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, c[0], [("PASSWORD", "Hunter22"), ("OTP", "987654")]) for i, c in enumerate(CASES)], "i int, body string, known array<struct<type:string,value:string>>")
    got = [(r.verdict, r.reason, len(r.checks)) for r in V.verify(df, "body", "known").orderBy("i").collect()]
    assert got == [c[1:] for c in CASES]


def test_gate_writes_two_places_and_no_blocked_body(spark, tmp_path):
    df = spark.createDataFrame([(1, GOOD), (2, GOOD.replace('"z"', '"a@b.com"'))], "k int, body string")
    V.write_gated(V.gate(df), ["k"], str(tmp_path / "out"), str(tmp_path / "held"))
    assert [r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
    held = spark.read.parquet(str(tmp_path / "held"))
    assert held.columns == ["k", "gate_reason"] and held.count() == 1


ALL_TYPES = [
    ("a", 1, "password: hunter2"), ("a", 2, "pw hunter2 again"), ("a", 3, "HUNTER2@x.com and mail b@x.com"), ("a", 4, "B@X.com otp: 12345678"),
    ("a", 5, "code 1234-5678 or 4111 1111 1111 1111"), ("a", 6, "card 4111-1111-1111-1111, call 98765 43210"), ("a", 7, "x 9876543210 y 12345678 z"),
    ("b", 1, "otp: 1234567"), ("b", 2, "1234567 then 12 34 567"), ("b", 3, "no value here"), ("b", 4, ""), ("c", 1, "cvv: 123"), ("c", 2, "cvv: 123 and 123"),
]
ALL_TYPES_OUT = [
    "password: [PASSWORD_1]", "pw [PASSWORD_1] again", "[PASSWORD_1]@x.com and mail [EMAIL_1]", "[EMAIL_1] otp: [OTP_1]", "code [OTP_1] or [CARD_1]",
    "card [CARD_1], call [PHONE_1]", "x [PHONE_1] y [OTP_1] z", "otp: [OTP_1]", "[OTP_1] then [OTP_1]", "no value here", "",
]


def test_every_type_keeps_its_placeholder_in_later_records(spark):
    rows, vault = R.redact(spark.createDataFrame(ALL_TYPES, "scope string, seq long, text string"), ["seq"])
    got = [r.redacted for r in rows.orderBy("scope", "seq").collect()]
    assert got[:11] == ALL_TYPES_OUT
    assert not [t for t in got if "␂" in t]
    assert not vault.filter(F.col("value").contains("@x.com") & F.col("value").startswith("H")).count()


def test_seeds_enter_the_vault_first(spark):
    seeds = spark.createDataFrame([("a", -1, "EMAIL", "b@x.com"), ("a", -1, "ADDRESS", "12 High Street")], "scope string, seq long, type string, value string")
    rows, vault = R.redact(spark.createDataFrame([("a", 1, "to 12 high street or B@x.com, c@x.com")], "scope string, seq long, text string"), ["seq"], seeds=seeds)
    assert rows.first().redacted == "to [ADDRESS_1] or [EMAIL_1], [EMAIL_2]" and vault.count() == 3


def test_long_texts_and_tables_of_numbers_meet_big_vaults(spark):
    rng = __import__("random").Random(1)
    long = "".join(rng.choice("abcdefgh é") for _ in range(100_000)) + " Secret-Word end"
    numbers = " ".join(str(rng.randrange(10, 99)) for _ in range(5000)) + " 98-76-54-32"
    texts = spark.createDataFrame([("s", 2, long), ("s", 3, numbers)], "scope string, seq long, text string")
    vault = spark.createDataFrame([("s", "secret-word", "[PASSWORD_1]", 1), ("s", "98765432", "[OTP_1]", 1), ("s", "absent12", "[PASSWORD_2]", 1)], "scope string, value string, mark string, since long")
    out = [r.replaced for r in R.replace_known(texts, vault, ["seq"]).orderBy("seq").collect()]
    assert out[0].endswith("[PASSWORD_1] end") and out[1].endswith(" [OTP_1]") and "[PASSWORD_2]" not in out[0]
    hits = K.known_value_hits(texts.selectExpr("seq AS k", "text AS body"), vault.selectExpr("'X' AS type", "value"), ["k"])
    assert sorted((r.k, r.value) for r in hits.collect()) == [(2, "secret-word")]


def test_known_values_are_searched_in_runs_of_their_characters_only(spark):
    """Beginnings in every place and case, beyond the basic plane and with signs of patterns, are found; many characters switch the runs off."""
    values = ["abc]-^\\x.d", "ÄöÜ straße", "0123456789abcdef", "𝒳𝒴𝒵 tail", "a\nb c"]
    texts = [f"{a}{v.upper() if i % 2 else v}{a}" for i, v in enumerate(values) for a in ("", " ", "0", "abc", "ß]", "y" * 63, "a" * 130)] + ["abc", ""]
    many = [chr(0x4E00 + i) + "xy" for i in range(1100)]
    for known in (values, values + many):
        vault = spark.createDataFrame([("NAME", v) for v in known], "type string, value string")
        rows = spark.createDataFrame(list(enumerate(texts + many[:3])), "id long, body string")
        want = {(i, v) for i, t in enumerate(texts + many[:3]) for v in known if v.lower() in t.lower()}
        assert {(r.id, r.value) for r in K.known_value_hits(rows, vault, ["id"]).collect()} == want
    heads = spark.createDataFrame([(3, v[:3]) for v in many] + [(6, "cabcab")], "size int, head string")
    assert K.alphabets(heads) == {6: r"[\x{61}\x{62}\x{63}]"}


def test_rows_of_few_splits_are_dealt_out_before_detection(spark):
    """Texts of few bytes come out of a join as one split; the steps after it run on all cores, with the same result."""
    texts = settled(spark.createDataFrame([(1, i, f"to ann{i % 3}@x.com") for i in range(40)], "scope int, seq long, text string").coalesce(1))
    vault = spark.createDataFrame([(1, f"ann{i}@x.com", f"[EMAIL_{i}]", -1) for i in range(3)], "scope int, value string, mark string, since int")
    assert splits_for(texts) == max(2 * spark.sparkContext.defaultParallelism, 16)
    out = R.replace_known(texts, vault, ["seq"], splits=splits_for(texts))
    assert {(r.seq, r.replaced) for r in out.collect()} == {(i, f"to [EMAIL_{i % 3}]") for i in range(40)}
    assert out.rdd.getNumPartitions() == splits_for(texts)
