"""Building blocks of the checking SQL: span search without lookaround, Luhn, claims.

The checking engine's patterns cannot look around. Every character that is no digit is doubled first, so a boundary can be
consumed on both sides of a match without hiding the next one; offsets are mapped back by counting.
"""

from __future__ import annotations

W = r"\b"
ID_BEFORE = r"(?i)\b(order|invoice|ref(erence)?|tracking|txn|transaction|receipt|ticket)\b[^\n]{0,20}$"
PHONE_BEFORE = r"(?i)\b(phone|mobile|tel|call|contact|whatsapp)\b"
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9-]+(?:\.[A-Z0-9-]+)*\.[A-Z]{2,}"
LABELLED = (
    r"(?i)\b(otp|one[\s-]?time (?:code|password)|verification code|passw(?:or)?d|passcode|cvv|cvc"
    r"|card(?: number| no\.?)?|phone|mobile|e-?mail|(?:shipping |delivery |billing |home |street )?address)"
    r"\s*[:=]\s*([^\s,;|]+(?:[ \-][0-9]{3,6}){0,4}|(?:[^\n,;|]{6,120}))"
)
# Separators are doubled in these.
SEP, BLANK = r"(?:  |--)?", r"(?:\s\s|--)?"
CARDS = [
    (r"[^0-9]", rf"(?:[0-9]{{4}}{SEP}){{3}}[0-9]{{4}}(?:{SEP}[0-9]{{1,3}})?"),
    (r"[^0-9]", rf"[0-9]{{4}}{SEP}[0-9]{{6}}{SEP}[0-9]{{5}}"),
    (r"[^0-9]", r"[0-9]{13,19}"),
]
MOBILE = (r"[^0-9+]", rf"(?:(?:\+\+)?91{BLANK})?[6-9][0-9]{{4}}{BLANK}[0-9]{{5}}")
PHONES = [
    MOBILE,
    (r"[^0-9]", rf"\+\+[0-9]{{1,3}}{BLANK}(?:\(\()?[0-9]{{2,4}}(?:\)\))?{BLANK}[0-9]{{3,4}}{BLANK}[0-9]{{3,4}}"),
    (r"[^0-9]", r"(?:\(\()?[0-9]{3}(?:\)\))?(?:\s\s|--)[0-9]{3}(?:\s\s|--)[0-9]{4}"),
]
LEAK_CARD = (r"[^0-9]", rf"(?:[0-9]{SEP}){{12,18}}[0-9]")


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def luhn(value: str) -> str:
    d = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    x = f"CAST(substr({d}, i + 1, 1) AS INT)"
    return (f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length({d})), lambda i: "
            f"CASE WHEN (length({d}) - 1 - i) % 2 = 1 THEN CASE WHEN {x} > 4 THEN 2 * {x} - 9 ELSE 2 * {x} END ELSE {x} END)) % 10 = 0)")


def identifier(text: str, start: str) -> str:
    before = f"substr({text}, greatest({start} - 40, 0) + 1, least({start}, 40))"
    return f"(regexp_matches({before}, {lit(ID_BEFORE)}) AND NOT regexp_matches({before}, {lit(PHONE_BEFORE)}))"


def plain(src: str, pattern: str, kind: str, rank: int) -> str:
    """Rows (k, rank, start, type, value) of a pattern without boundaries over ``src(k, t)``."""
    return f"""SELECT k, {rank} AS rank, CAST(coalesce(list_sum(list_transform(g[1:i], lambda v: length(v))), 0)
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS BIGINT) AS start, '{kind}' AS type, m[i] AS value
    FROM (SELECT k, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT k, regexp_extract_all(t, {lit(pattern)}) AS m,
      string_split_regex(t, {lit(pattern)}) AS g FROM {src}))"""


def bounded(src: str, edge_pattern: tuple[str, str], kind: str, rank: int, keep: str = "true") -> str:
    """Rows of a digit pattern with boundaries; ``keep`` may use t, start and value."""
    edge, core = edge_pattern
    p = lit(f"(^|{edge})({core})([^0-9]|$)")
    return f"""SELECT k, {rank} AS rank, start, '{kind}' AS type, value FROM (
      SELECT k, t, CAST(length(regexp_replace(head, '[^0-9]', '', 'g')) + length(regexp_replace(head, '[0-9]', '', 'g')) // 2 AS BIGINT) AS start, value
      FROM (SELECT k, t, regexp_replace(c[i], '([^0-9])[^0-9]', '\\1', 'g') AS value, substr(d, 1, CAST(
          coalesce(list_sum(list_transform(g[1:i], lambda v: length(v))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0)
          + length(b[i]) AS BIGINT)) AS head
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT k, t, d, regexp_extract_all(d, {p}) AS m, regexp_extract_all(d, {p}, 1) AS b,
          regexp_extract_all(d, {p}, 2) AS c, string_split_regex(d, {p}) AS g
          FROM (SELECT k, t, regexp_replace(t, '([^0-9])', '\\1\\1', 'g') AS d FROM {src} WHERE regexp_matches(t, '[0-9]{{3}}|([0-9][ -]?){{3}}'))))))
    WHERE {keep}"""


def labelled(src: str, rank: int) -> str:
    p = lit(LABELLED)
    shape = """CASE WHEN regexp_matches(v, '^\\[[A-Z]+_[0-9]+\\]$') THEN NULL
      WHEN regexp_matches(l, '^(otp|one|verification)') THEN CASE WHEN regexp_matches(v, '^[0-9]{4,8}$') THEN 'OTP' END
      WHEN regexp_matches(l, '^pass') THEN CASE WHEN regexp_matches(v, '^\\S{4,}$') THEN 'PASSWORD' END
      WHEN regexp_matches(l, '^cv') THEN CASE WHEN regexp_matches(v, '^[0-9]{3,4}$') THEN 'CVV' END
      WHEN regexp_matches(l, '^card') THEN CASE WHEN regexp_matches(v, '^([0-9][ -]?){12,18}[0-9]$') THEN 'CARD' END
      WHEN regexp_matches(l, '^phone|^mobile') THEN CASE WHEN regexp_matches(v, '^\\+?[0-9 ()-]{8,16}$') THEN 'PHONE' END
      WHEN regexp_matches(l, '^e-?mail') THEN CASE WHEN regexp_matches(v, '(?i)^[^@\\s]+@[^@\\s]+\\.[a-z]{2,}$') THEN 'EMAIL' END
      WHEN regexp_matches(l, 'address$') THEN CASE WHEN length(v) BETWEEN 6 AND 120 AND regexp_matches(v, '(?i)[a-z]') AND regexp_matches(v, '[0-9]') THEN 'ADDRESS' END END"""
    return f"""SELECT k, {rank} AS rank, start, type, v AS value FROM (SELECT *, {shape} AS type FROM (
      SELECT k, lower(a[i]) AS l, regexp_replace(b[i], '[.,;:]+$', '') AS v, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) - length(b[i]) AS BIGINT) AS start
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT k, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, 1) AS a,
        regexp_extract_all(t, {p}, 2) AS b, string_split_regex(t, {p}) AS g FROM {src} WHERE t LIKE '%:%' OR t LIKE '%=%')))) WHERE type IS NOT NULL"""


def claimed(name: str, parts: list[str]) -> str:
    """CTEs ``name`` with the accepted spans of candidate lists in order of precedence."""
    out = [f"{name}_c AS MATERIALIZED ({' UNION ALL '.join(parts)})", f"{name}_0 AS MATERIALIZED (SELECT * FROM {name}_c WHERE rank = 0)"]
    for r in range(1, len(parts)):
        out.append(f"""{name}_{r} AS MATERIALIZED (SELECT * FROM {name}_{r - 1} UNION ALL SELECT * FROM {name}_c c WHERE rank = {r} AND NOT EXISTS (
          SELECT 1 FROM {name}_{r - 1} a WHERE a.k = c.k AND c.start < a.start + length(a.value) AND c.start + length(c.value) > a.start))""")
    out.append(f"{name} AS (SELECT * FROM {name}_{len(parts) - 1})")
    return ",\n".join(out)


def find(name: str, src: str) -> str:
    not_id = f"NOT {identifier('t', 'start')}"
    parts = [labelled(src, 0), plain(src, EMAIL, "EMAIL", 1)]
    parts += [bounded(src, p, "CARD", 2 + i, luhn("value")) for i, p in enumerate(CARDS)]
    parts += [bounded(src, p, "PHONE", 5 + i, not_id) for i, p in enumerate(PHONES)]
    return claimed(name, parts)


def leaks(name: str, src: str) -> str:
    return claimed(name, [plain(src, EMAIL, "EMAIL", 0), bounded(src, LEAK_CARD, "CARD", 1, luhn("value")),
                          bounded(src, MOBILE, "PHONE", 2, f"NOT {identifier('t', 'start')}")])


def spliced(text: str, spans: str, size: str, mark: str) -> str:
    """Text with a list ``spans`` of structs (start ...) replaced; ``size`` and ``mark`` use s for a span."""
    def at(i: str, expr: str) -> str:
        return expr.replace("§", f"{spans}[{i}]")
    gap = (f"substr({text}, CAST(CASE WHEN i = 1 THEN 1 ELSE {at('i - 1', '§.start')} + {at('i - 1', size)} + 1 END AS BIGINT), CAST("
           f"CASE WHEN i > len({spans}) THEN length({text}) ELSE {at('i', '§.start')} - CASE WHEN i = 1 THEN 0 ELSE {at('i - 1', '§.start')} + {at('i - 1', size)} END END AS BIGINT))")
    return f"array_to_string(list_transform(range(1, len({spans}) + 2), lambda i: {gap} || CASE WHEN i <= len({spans}) THEN {at('i', mark)} ELSE '' END), '')"


def redacted(src: str) -> str:
    """CTEs ending in ``vault(k, placeholder, type, value)`` and ``final(k, redacted)`` for rows that are their own scope."""
    return f"""src AS MATERIALIZED ({src}), {find('f', 'src')},
    l1 AS MATERIALIZED (SELECT k, list({{'start': start, 'type': type, 'value': value}} ORDER BY start) AS s FROM f WHERE NOT regexp_matches(value, '^\\[[A-Z]+_[0-9]+\\]$') GROUP BY k),
    prov AS MATERIALIZED (SELECT src.k, s, CASE WHEN s IS NULL THEN src.t ELSE {spliced('src.t', 's', 'length(§.value)', "('[' || §.type || '_0]')")} END AS t FROM src LEFT JOIN l1 ON src.k = l1.k),
    {leaks('g', 'prov')},
    placed AS MATERIALIZED (SELECT k, 1 AS pass, CAST(s[i].start + coalesce(list_sum(list_transform(s[1:i - 1], lambda x: length(x.type) + 4 - length(x.value))), 0) AS BIGINT) AS start,
        length(s[i].type) + 4 AS size, s[i].type AS type, s[i].value AS value FROM (SELECT k, s, unnest(range(1, len(s) + 1)) AS i FROM prov WHERE s IS NOT NULL)
      UNION ALL SELECT k, 2, start, length(value), type, value FROM g WHERE NOT regexp_matches(value, '^\\[[A-Z]+_[0-9]+\\]$')),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY k, value ORDER BY pass, -start) AS r FROM placed),
    vault AS MATERIALIZED (SELECT k, type, value, row_number() OVER (PARTITION BY k, type ORDER BY pass, -start) AS n,
        '[' || type || '_' || CAST(row_number() OVER (PARTITION BY k, type ORDER BY pass, -start) AS VARCHAR) || ']' AS placeholder FROM firsts WHERE r = 1),
    l2 AS (SELECT p.k, list({{'start': p.start, 'size': p.size, 'mark': v.placeholder}} ORDER BY p.start) AS z FROM placed p JOIN vault v ON p.k = v.k AND p.value = v.value GROUP BY p.k),
    final AS (SELECT prov.k, CASE WHEN z IS NULL THEN prov.t ELSE {spliced('prov.t', 'z', '§.size', '§.mark')} END AS redacted FROM prov LEFT JOIN l2 ON prov.k = l2.k)"""
