"""Licence scan by ordered signature rules; DataFrame operations only.

A text is read as words with two blanks between them, so that matches end on whole words and never share a blank. Each rule is a pattern over
words with a keyword phrase in front: rules run only on texts that hold their keyword, and texts are brought into words only if they hold a
stem of any keyword. Overlapping detections are then resolved: one that lies within another of better or equal priority is suppressed.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veil.functions.text import let
from veil.llm.common import query, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of a text as it stands, and the ASCII characters of which words are not made.
ANY_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
BLANKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())

#: Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Hand-written signatures: label, keyword phrase, title. A label with its version also gives the rules for its identifier.
SIGNATURES = """
0bsd | bsd | (?:zero clause bsd|bsd zero clause|bsd 0 clause)(?: licen[sc]e)?
afl-3.0 | academic free | academic free licen[sc]e(?: version)? v?3(?: 0)?
agpl-3.0 | affero | (?:gnu )?affero general public licen[sc]e(?: version)? v?3(?: 0)?
agpl-3.0 | agpl | (?:gnu )?agpl(?: version)? v?3
agpl | affero | (?:gnu )?affero general public licen[sc]e
apache-1.1 | apache | apache(?: software)? licen[sc]e(?: version)? v?1 1
apache-2.0 | apache | (?:asf |apache )(?:software )?licen[sc]e(?: version)? v?2(?: 0)?
apache-2.0 | apache | apache v?2(?: 0)? licen[sc]e
apsl-2.0 | apple public | apple public source licen[sc]e(?: version)? v?2(?: 0)?
artistic-1.0 | artistic | (?:perl )?artistic licen[sc]e(?: version)? v?1(?: 0)?
artistic-2.0 | artistic | (?:perl )?artistic licen[sc]e(?: version)? v?2(?: 0)?
blueoak-1.0.0 | blue oak | blue oak model licen[sc]e(?: version)? 1(?: 0 0)?
bsd-1-clause | bsd | (?:1|one) clause bsd(?: licen[sc]e)?
bsd-2-clause | bsd | (?:2|two) clause bsd(?: licen[sc]e)?
bsd-2-clause | bsd | (?:simplified|freebsd) bsd licen[sc]e
bsd-3-clause | bsd | (?:3|three) clause bsd(?: licen[sc]e)?
bsd-3-clause | bsd | (?:new|modified|revised) bsd licen[sc]e
bsd-4-clause | bsd | (?:4|four) clause bsd(?: licen[sc]e)?
bsd-4-clause | bsd | (?:original|old) bsd licen[sc]e
bsd | bsd | bsd(?: style)? licen[sc]e
bsl-1.0 | boost software | boost software licen[sc]e(?: version)? 1(?: 0)?
busl-1.1 | business source | business source licen[sc]e(?: version)? 1 1
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | creative commons | creative commons(?: zero| cc0| public domain dedication)(?: 1 0)?(?: universal)?
cc-by-1.0 | creative commons | creative commons attribution 1 0(?: generic)?
cc-by-2.0 | creative commons | creative commons attribution 2 0(?: generic)?
cc-by-2.5 | creative commons | creative commons attribution 2 5(?: generic)?
cc-by-3.0 | creative commons | creative commons attribution 3 0(?: unported)?
cc-by-4.0 | creative commons | creative commons attribution 4 0(?: international)?
cc-by-nc-2.0 | creative commons | creative commons attribution non ?commercial 2 0(?: generic)?
cc-by-nc-3.0 | creative commons | creative commons attribution non ?commercial 3 0(?: unported)?
cc-by-nc-4.0 | creative commons | creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nc-nd-3.0 | creative commons | creative commons attribution non ?commercial no ?deriv(?:s|atives) 3 0(?: unported)?
cc-by-nc-nd-4.0 | creative commons | creative commons attribution non ?commercial no ?deriv(?:s|atives) 4 0(?: international)?
cc-by-nc-sa-3.0 | creative commons | creative commons attribution non ?commercial share ?alike 3 0(?: unported)?
cc-by-nc-sa-4.0 | creative commons | creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nd-3.0 | creative commons | creative commons attribution no ?deriv(?:s|atives) 3 0(?: unported)?
cc-by-nd-4.0 | creative commons | creative commons attribution no ?deriv(?:s|atives) 4 0(?: international)?
cc-by-sa-2.0 | creative commons | creative commons attribution share ?alike 2 0(?: generic)?
cc-by-sa-3.0 | creative commons | creative commons attribution share ?alike 3 0(?: unported)?
cc-by-sa-4.0 | creative commons | creative commons attribution share ?alike 4 0(?: international)?
creative-commons | creative commons | creative commons(?: attribution)?(?: non ?commercial| share ?alike| no ?deriv(?:s|atives))*(?: licen[sc]e)?
cddl-1.0 | common development | common development and distribution licen[sc]e(?: version)?(?: 1 0)?
cecill-2.1 | cecill | cecill(?: free software licen[sc]e(?: agreement)?)?(?: version)? v?2 1
cpl-1.0 | common public | common public licen[sc]e(?: version)? v?1(?: 0)?
ecl-2.0 | educational community | educational community licen[sc]e(?: version)? v?2(?: 0)?
epl-1.0 | eclipse public | eclipse public licen[sc]e(?: version)? v?1(?: 0)?
epl-2.0 | eclipse public | eclipse public licen[sc]e(?: version)? v?2(?: 0)?
eupl-1.2 | european union | european union public licen[sc]e(?: version)? v?1 2
gfdl-1.3 | free documentation | gnu free documentation licen[sc]e(?: version)? v?1 3
gfdl | free documentation | gnu free documentation licen[sc]e
gpl-1.0 | general public | gnu general public licen[sc]e(?: version)? v?1(?: 0)?
gpl-2.0 | general public | gnu general public licen[sc]e(?: version)? v?2(?: 0)?
gpl-2.0-or-later | general public | gnu general public licen[sc]e(?: version)? v?2(?: 0)? or(?: at your option any)? later(?: version)?
gpl-3.0 | general public | gnu general public licen[sc]e(?: version)? v?3(?: 0)?
gpl-3.0-or-later | general public | gnu general public licen[sc]e(?: version)? v?3(?: 0)? or(?: at your option any)? later(?: version)?
gpl-2.0 | gpl | (?:gnu )?gpl(?: version)? v?2
gpl-2.0 | gplv2 | gplv2(?: 0)?
gpl-3.0 | gpl | (?:gnu )?gpl(?: version)? v?3
gpl-3.0 | gplv3 | gplv3(?: 0)?
gnu-gpl | general public | (?:gnu )?general public licen[sc]e
isc | isc license | isc license
lgpl-2.0 | library general | gnu library general public licen[sc]e(?: version)? v?2(?: 0)?
lgpl-2.1 | lesser general | gnu lesser general public licen[sc]e(?: version)? v?2 1
lgpl-3.0 | lesser general | gnu lesser general public licen[sc]e(?: version)? v?3(?: 0)?
lgpl-2.1 | lgpl | (?:gnu )?lgpl(?: version)? v?2 1
lgpl-3.0 | lgpl | (?:gnu )?lgpl(?: version)? v?3
lgpl | lesser general | (?:gnu )?lesser general public licen[sc]e
lppl-1.3c | latex project | latex project public licen[sc]e(?: version)? v?1 3c?
mit | mit license | (?:the )?(?:expat )?mit license(?: expat)?
mit | mit licence | (?:the )?mit licence
mit | free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software
mit-0 | mit no attribution | mit no attribution(?: licen[sc]e)?
mpl-1.1 | mozilla public | mozilla public licen[sc]e(?: version)? v?1 1
mpl-2.0 | mozilla public | mozilla public licen[sc]e(?: version)? v?2(?: 0)?
mpl | mozilla public | mozilla public licen[sc]e
ms-pl | microsoft public | microsoft public licen[sc]e
ms-rl | microsoft reciprocal | microsoft reciprocal licen[sc]e
ncsa | open source license | (?:university of illinois )?ncsa open source license
odbl-1.0 | open database | (?:odc )?open database licen[sc]e(?: odbl)?(?: version)?(?: v?1 0)?
odc-by-1.0 | open data commons | open data commons attribution licen[sc]e(?: version)?(?: v?1 0)?
ofl-1.1 | open font | (?:sil )?open font licen[sc]e(?: version)? v?1 1
osl-3.0 | open software | open software licen[sc]e(?: version)? v?3(?: 0)?
pddl-1.0 | public domain dedication | public domain dedication and licen[sc]e(?: pddl)?(?: version)?(?: v?1 0)?
php-3.01 | php license | php license(?: version)? v?3 01
postgresql | postgresql license | postgresql license
proprietary | rights reserved | all rights reserved
proprietary | without permission | may not be (?:copied|reproduced|redistributed)(?: or \\S+)? without(?: prior)?(?: written)? permission
public-domain | public domain | (?:released|placed|dedicated)(?: in)?(?:to)? the public domain
python-2.0 | python software | python software foundation licen[sc]e(?: version)?(?: v?2(?: 0)?)?
qpl-1.0 | q public | q public licen[sc]e(?: version)?(?: v?1 0)?
sspl-1.0 | server side public | server side public licen[sc]e(?: version)?(?: v?1(?: 0)?)?
unlicense | unlicense | (?:the )?unlicense
upl-1.0 | universal permissive | universal permissive licen[sc]e(?: version)?(?: v?1 0)?
vim | vim license | vim license
w3c | w3c software | w3c software(?: notice and)? licen[sc]e
wtfpl | wtfpl | wtfpl(?: version)?(?: v?2)?
x11 | x11 license | x11 license
zlib | zlib license | (?:the )?zlib license
zpl-2.1 | zope public | zope public licen[sc]e(?: version)? v?2 1
"""
#: Hand-written signatures of addresses: label, the address as words.
ADDRESSES = """
apache-2.0 | apache org licenses license 2 0
agpl-3.0 | gnu org licenses agpl(?: 3 0)?
artistic-2.0 | opensource org licenses artistic(?: license)? 2 0
bsd-2-clause | opensource org licenses bsd 2 clause
bsd-3-clause | opensource org licenses bsd 3 clause
bsl-1.0 | boost org license 1 0
cc0-1.0 | creativecommons org publicdomain zero 1 0
cc-by-2.0 | creativecommons org licenses by 2 0
cc-by-3.0 | creativecommons org licenses by 3 0
cc-by-4.0 | creativecommons org licenses by 4 0
cc-by-nc-3.0 | creativecommons org licenses by nc 3 0
cc-by-nc-4.0 | creativecommons org licenses by nc 4 0
cc-by-nc-nd-4.0 | creativecommons org licenses by nc nd 4 0
cc-by-nc-sa-4.0 | creativecommons org licenses by nc sa 4 0
cc-by-nd-4.0 | creativecommons org licenses by nd 4 0
cc-by-sa-3.0 | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | creativecommons org licenses by sa 4 0
epl-2.0 | eclipse org legal epl 2 0
eupl-1.2 | eupl eu 1 2
gfdl | gnu org licenses fdl(?: 1 3)?
gpl-2.0 | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | gnu org licenses gpl 3 0
isc | opensource org licenses isc
lgpl-2.1 | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | gnu org licenses lgpl 3 0
mit | opensource org licenses mit
mpl-1.1 | mozilla org mpl 1 1
mpl-2.0 | mozilla org mpl 2 0
odbl-1.0 | opendatacommons org licenses odbl
ofl-1.1 | scripts sil org ofl
unlicense | unlicense org
wtfpl | wtfpl net
zlib | opensource org licenses zlib
"""
#: First words of identifiers that stand for the licence without more; others count only after the words of an SPDX tag.
IDENTIFIERS = "agpl apache apsl artistic bsd busl cc cc0 cddl cecill eupl gfdl gpl lgpl lppl mpl odbl pddl sspl".split()
#: What leads to a licence that is granted, not only named.
GRANT = ("(?:licensed|released|distributed|available|published|provided|covered|governed) (?:by|under|with) (?:the )?"
         "(?:terms (?:and conditions )?of (?:the )?)?")
#: Priorities, the best first, and how much one detection says.
LEVELS = ("identifier", "grant", "address", "version", "name")
WEIGHTS = (0.95, 0.9, 0.8, 0.7, 0.5)
BASE_WEIGHT = 0.5

DETECTION = "array<struct<rule:int,k:int,gap:int,size:int>>"
SPAN = "array<struct<start:int,stop:int,level:int,rule:int,label:string>>"


def doubled(pattern: str) -> str:
    """A pattern over words for texts with two blanks between words and one at either end."""
    return " (?:" + pattern.replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?") + ") "


def lines(text: str) -> list[list[str]]:
    return [[f.strip() for f in line.split("|", text.split("\n")[1].count(" | "))] for line in text.strip().split("\n")]


def rules() -> list[tuple[int, str, str, str]]:
    """(level, label, keyword, pattern over words) in the order of priority: signatures, and what follows from them by rule."""
    out, seen = [], set()
    for label, keyword, title in lines(SIGNATURES):
        name = re.sub("[-.]", " ", label)
        if label not in seen:
            out.append((0, label, "spdx license", f"spdx license identifier {name}(?: only)?"))
            first = name.split(" ")[0]
            if first in IDENTIFIERS and name != first:
                out += [(3, label, "cc by" if first == "cc" else first, name), (1, label, "cc by" if first == "cc" else first, f"{GRANT}{name}")]
        seen.add(label)
        out.append((1, label, keyword, f"{GRANT}{title}"))
        out.append((3 if re.search("[0-9]", label) else 4, label, keyword, title))
    out += [(2, label, " ".join(address.split(" ")[:2]), f"(?:https? )?(?:www )?{address}") for label, address in lines(ADDRESSES)]
    return sorted(out, key=lambda r: r[0])


def stem(keyword: str, pattern: str) -> str:
    """What a text must hold, as it stands, for a rule to match: "licen" if the pattern cannot do without it, else the keyword's longest word."""
    needed = pattern
    while "(" in needed:
        needed = re.sub(r"\([^()]*\)[?*]?", "", needed)  # groups hold what is optional and what has alternatives
    return "licen" if "licen" in needed and "|" not in needed else max(keyword.split(" "), key=len)


def held(text: Column, signatures: list[tuple[int, str, str, str]]) -> Column:
    """Whether a text may hold a match: a stem of any rule or base phrase or, for very short ones, the keyword's words in a row."""
    pairs = [(k, p) for _, _, k, p in signatures] + [(p, p) for p, _ in PHRASES]
    some = sorted({stem(k, p) for k, p in pairs if len(stem(k, p)) > 2})
    short = sorted({"[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+".join(k.split(" ")) for k, p in pairs if len(stem(k, p)) <= 2})
    found = let(F.lower(text), lambda low: F.exists(F.array(*[F.lit(s) for s in some]), lambda s: F.contains(low, s))) if some else F.lit(False)
    return found | text.rlike(f"(?i)(?:{'|'.join(short)})") if short else found


def words_of(text: Column) -> Column:
    """The text as its words, two blanks between them and one at either end: A-Z lower-cased, all else kept."""
    plain = F.trim(F.translate(text, UPPER + BLANKS, LOWER + " " * len(BLANKS)))
    return F.concat(F.lit(" "), F.regexp_replace(plain, " +", "  "), F.lit(" "))


def counted(part: Column) -> Column:
    """Words of a piece: two blanks each."""
    return F.floor((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("int")


def base_places(words: Column) -> Column:
    """Places (start, stop, label) where a base phrase stands, in the order of the phrases, then of the words. Linear in the text."""
    def places(phrase: str, label: str) -> Column:
        wanted = phrase.split(" ")

        def at(each: Column) -> Column:
            fits = lambda i: reduce(and_, [F.get(each, i + j) == w for j, w in enumerate(wanted)])
            starts = F.filter(F.sequence(F.lit(0), F.size(each) - len(wanted)), fits)
            return F.transform(starts, lambda i: F.struct(i.alias("start"), (i + len(wanted)).alias("stop"), F.lit(label).alias("label")))

        own = let(F.split(F.trim(words), "  "), at)
        return F.coalesce(F.when(F.contains(words, F.lit(" " + phrase.replace(" ", "  ") + " ")), own), F.array().cast("array<struct<start:int,stop:int,label:string>>"))

    return F.concat(*[places(p, name) for p, name in PHRASES])


def detections(words: Column, signatures: list[tuple[int, str, str, str]]) -> Column:
    """Matches (rule, k, gap, size) of all rules whose keyword the words hold: words before each since the last one of its rule, and its own."""
    keywords = sorted({k for _, _, k, _ in signatures})
    known = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(" " + k.replace(" ", "  ") + " ").alias("phrase")) for i, k in enumerate(keywords)])
    every = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(keywords.index(k)).alias("keyword"), F.lit(doubled(p)).alias("pattern"))
                      for i, (_, _, k, p) in enumerate(signatures)])

    def of(rule: Column) -> Column:
        def placed(found: Column) -> Column:
            gaps = F.slice(F.split(words, rule["pattern"], -1), 1, F.size(found))
            pairs = F.zip_with(gaps, found, lambda g, m: F.struct(counted(g).alias("gap"), counted(m).alias("size")))
            return F.transform(pairs, lambda p, k: F.struct(rule["rule"].alias("rule"), k.alias("k"), p["gap"].alias("gap"), p["size"].alias("size")))

        return let(F.regexp_extract_all(words, rule["pattern"], F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(DETECTION)))

    present = F.transform(F.filter(known, lambda k: F.contains(words, k["phrase"])), lambda k: k["i"])
    return let(present, lambda ids: F.flatten(F.transform(F.filter(every, lambda r: F.array_contains(ids, r["keyword"])), of)))


def resolved(found: DataFrame, levels: int) -> DataFrame:
    """Rows (id, start, stop, level, rule) of each text that stay: those that no detection of better or equal priority contains.

    Of equal intervals the better priority stays, then the earlier rule. What contains a row comes before it in the order of the window, so one
    running maximum a level decides; containment is transitive, so suppressed rows may suppress.
    """
    before = Window.partitionBy("id").orderBy("start", F.desc("stop"), "level", "rule").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.array(*[F.max(F.when(F.col("level") <= n, F.col("stop"))).over(before) for n in range(levels)])
    return found.withColumn("within", F.element_at(ends, F.col("level") + 1)).where(F.coalesce("within", F.lit(-1)) < F.col("stop")).drop("within")


def scan(docs: DataFrame, signatures: list[tuple[int, str, str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, base, spans) for every row: base places (start, stop, label) and the detections that stay (start, stop, level, rule,
    label), places being words from 0, ``stop`` exclusive, both in order.

    A null text is empty: no words, no places. Every row is scanned for itself, so repeated rows and null ids have rows of their own. Columns
    beside doc_id and text are left alone. Only detections meet in a window per text; texts stay where they are.
    """
    signatures = signatures or rules()
    text = F.coalesce("text", F.lit(""))
    words = F.when(held(text, signatures), words_of(text))
    row = let(words, lambda w: F.struct(
        F.coalesce(base_places(w), F.array().cast("array<struct<start:int,stop:int,label:string>>")).alias("base"),
        F.coalesce(F.when(w.isNotNull(), detections(w, signatures)), F.array().cast(DETECTION)).alias("found")))
    rows = docs.select("doc_id", F.regexp_count(text, F.lit(ANY_WORD)).cast("long").alias("n_words"), row.alias("r"))
    rows = stored(rows.select("doc_id", "n_words", "r.base", "r.found", F.monotonically_increasing_id().alias("id")), "licences")

    along = Window.partitionBy("id", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = rows.where("size(found) > 0").select("id", F.explode("found").alias("f")).select("id", "f.*")
    placed = each.repartition("id").withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(along).cast("int"))
    placed = placed.select("id", (F.col("stop") - F.col("size")).alias("start"), "stop",
                           F.element_at(F.array(*[F.lit(level) for level, *_ in signatures]), F.col("rule") + 1).alias("level"), "rule")
    label = F.element_at(F.array(*[F.lit(name) for _, name, *_ in signatures]), F.col("rule") + 1)
    spans = resolved(placed, len(LEVELS)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "level", "rule", label.alias("label")))).alias("spans"))
    return rows.drop("found").join(spans, "id", "left").select(
        "doc_id", "n_words", F.array_sort("base").alias("base"), F.coalesce(F.col("spans").cast(SPAN), F.array().cast(SPAN)).alias("spans"))


def score(base: Column, spans: Column) -> Column:
    """How sure it is that a licence is named: the chance that not all labels err, each at its best evidence."""
    labelled = F.concat(F.transform(base, lambda b: F.struct(b["label"].alias("label"), F.lit(BASE_WEIGHT).alias("weight"))),
                        F.transform(spans, lambda s: F.struct(s["label"].alias("label"), F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), s["level"] + 1).alias("weight"))))
    names = lambda rows: F.array_distinct(F.transform(rows, lambda r: r["label"]))
    best = lambda rows, n: F.array_max(F.transform(F.filter(rows, lambda r: r["label"] == n), lambda r: r["weight"]))
    return let(F.array_distinct(labelled), lambda rows: F.round(1 - F.aggregate(names(rows), F.lit(1.0), lambda acc, n: acc * (1 - best(rows, n))), 6))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    found = rules()
    values = ",\n  ".join(f"({i}, {level}, {quote(name)}, {quote(' ' + k.replace(' ', '  ') + ' ')}, {quote(doubled(p))})" for i, (level, name, k, p) in enumerate(found))
    blanks = lambda s: f"(length({s}) - length(replace({s}, ' ', ''))) // 2"
    base = " UNION ALL ".join(
        f"SELECT id, '{name}' AS label, i - 1 AS start FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM listed) WHERE "
        + " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(p.split(" "))) for p, name in PHRASES)
    weights = "[" + ", ".join(map(str, WEIGHTS)) + "]"
    return f"""
WITH rules(rule, level, label, phrase, pattern) AS (VALUES
  {values}),
texts AS (SELECT row_number() OVER () AS id, doc_id,
  trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ') AS t FROM documents),
listed AS (SELECT id, doc_id, ' ' || replace(t, ' ', '  ') || ' ' AS words, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w FROM texts),
base AS ({base}),
hit AS (SELECT id, rule, level, label, regexp_extract_all(words, pattern) AS m, string_split_regex(words, pattern) AS gaps
  FROM listed JOIN rules ON contains(words, phrase) WHERE regexp_matches(words, pattern)),
each AS (SELECT id, rule, level, label, m, gaps, unnest(range(1, len(m) + 1)) AS k FROM hit),
placed AS (SELECT id, rule, level, label, k, sum({blanks('gaps[k]')} + {blanks('m[k]')}) OVER (PARTITION BY id, rule ORDER BY k) AS stop, {blanks('m[k]')} AS size,
  stop - size AS start FROM each),
kept AS (SELECT * FROM placed d WHERE NOT EXISTS (SELECT 1 FROM placed e WHERE e.id = d.id AND e.start <= d.start AND e.stop >= d.stop AND e.level <= d.level
  AND (e.start < d.start OR e.stop > d.stop OR e.rule < d.rule))),
named AS (SELECT id, label, {BASE_WEIGHT} AS weight FROM base UNION ALL SELECT id, label, {weights}[level + 1] FROM kept),
best AS (SELECT id, label, max(weight) AS weight FROM named GROUP BY id, label),
every AS (SELECT id, string_agg(label, ',' ORDER BY label) AS labels, round(1 - product(1 - weight), 6) AS score FROM best GROUP BY id),
bases AS (SELECT id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_sort(list_distinct(list(label))) AS names FROM base GROUP BY id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(names, ','), '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM listed l LEFT JOIN bases b ON b.id = l.id LEFT JOIN every e ON e.id = l.id"""


@query("op11_license_scan", _sql())
def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Base phrases, labels and score of every document."""
    names = lambda c: F.transform(c, lambda s: s["label"])
    starts = F.transform("base", lambda s: s["start"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scan(table(spark, folder, "documents")).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), joined(names(F.col("base"))).alias("base_labels"),
        joined(F.concat(names(F.col("base")), names(F.col("spans")))).alias("labels"), score(F.col("base"), F.col("spans")).alias("score"))
