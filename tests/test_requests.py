import json

from veil.operators import redact as R, request as Q

BARE = dict(request_id=None, task=None, url=None, title=None, text=None, guidance=None, elements=None, visual=None, history=None, fields=None, lines=None)


def made(spark, *requests):
    return spark.createDataFrame([tuple({**BARE, "request_id": i, **r}.values()) for i, r in enumerate(requests)], Q.REQUEST)


def sanitized(spark, *requests):
    rows = {r.request_id: r for r in Q.sanitize(made(spark, *requests)).collect()}
    return [(json.loads(rows[i].body), rows[i].placeholders, rows[i].verdict, rows[i].reason) for i in range(len(requests))]


def element(text, label=None, context=None, options=None):
    return ("el_a", "b", text, "note", label, context, options)


def test_requests_of_all_shapes(spark):
    history = [("type", None, f"call 98765 4321{i}" if i < 3 else None, None, "x" * 300 if i == 11 else None) for i in range(12)]
    got = sanitized(
        spark, {},
        {"task": "mail a@x.com or b@x.com", "text": "B@X.com, then c@x.com", "elements": [element("a@x.com", "Contact", "by c@x.com", ["d@x.com", ""]), element("")]},
        {"history": history, "guidance": "g" * 399 + " a@x.com", "fields": [("PASSWORD", "hunter22"), ("CVV", " ")], "lines": [("OTP", "445566")], "title": "44-55 66 and HUNTER22"},
        {"elements": [element("see x", "write to first@x.com"), element("second@x.com", "Mail")], "text": "first"},
        {"task": "card 4111 1111 1111 1112", "text": "plain"})
    body, marks, verdict, _ = got[0]
    assert body == {"task": "", "page": {"url": "", "title": "", "elements": [], "text": ""}, "placeholders": []} and (marks, verdict) == ([], "allowed")
    body, marks, verdict, _ = got[1]
    # The later of two values of one text is registered first; elements come before the page text.
    assert body["task"] == "mail [EMAIL_2] or [EMAIL_1]" and body["page"]["text"] == "[EMAIL_1], then [EMAIL_3]"
    assert body["page"]["elements"][0] == {"id": "el_a", "tag": "b", "text": "[EMAIL_2]", "role": "note", "context": "by [EMAIL_3]", "options": ["[EMAIL_4]", ""]}
    assert "context" not in body["page"]["elements"][1] and marks == ["[EMAIL_1]", "[EMAIL_2]", "[EMAIL_3]", "[EMAIL_4]"] and verdict == "allowed"
    body, marks, _, _ = got[2]
    assert body["page"]["title"] == "[OTP_1] and [PASSWORD_1]" and marks[:2] == ["[PASSWORD_1]", "[OTP_1]"]
    assert len(body["history"]) == 10 and body["history"][0] == {"action": "type", "target": None, "value": "call [PHONE_1]"}
    assert body["history"][9]["note"] == "x" * 200 and body["history"][9]["value"] is None and body["guidance"] == "g" * 399 + " "
    body, marks, _, _ = got[3]
    assert [e["text"] for e in body["page"]["elements"]] == ["see x", "[EMAIL_1]"] and marks == ["[EMAIL_1]"]
    assert got[4][2] == "allowed" or "4111" not in json.dumps(got[4][0])


def test_rounds_read_only_scopes_that_moved(spark, monkeypatch):
    """A value that cuts another needs a further round; scopes without one are done after the first."""
    sizes = []
    real = R.replace_known
    monkeypatch.setattr(R, "replace_known", lambda texts, *a, **k: (sizes.append(texts.select("scope").distinct().count()), real(texts, *a, **k))[1])
    turns = [("a", 1, "password: hunter2"), ("a", 2, "HUNTER2@x.com and mail b@x.com"), ("b", 1, "c@x.com"), ("b", 2, "d@x.com and c@x.com")]
    rows, vault = R.redact(spark.createDataFrame(turns, "scope string, seq long, text string"), ["seq"])
    assert [r.redacted for r in rows.orderBy("scope", "seq").collect()] == ["password: [PASSWORD_1]", "[PASSWORD_1]@x.com and mail [EMAIL_1]", "[EMAIL_1]", "[EMAIL_2] and [EMAIL_1]"]
    assert sizes == [2, 1] and vault.count() == 4
