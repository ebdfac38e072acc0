import random
import re

from pyspark.sql import functions as F

from veil.llm import licenses


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, rules):
    """Words, base places and the detections that stay, straight from the definitions."""
    own = words(text)
    base = sorted((i, i + len(p.split()), name) for p, name in licenses.PHRASES for i in range(len(own)) if own[i:i + len(p.split())] == p.split())
    line = " " + "  ".join(own) + " "
    found = []
    for rule, (level, label, keyword, pattern) in enumerate(rules):
        if " " + keyword.replace(" ", "  ") + " " in line:
            for m in re.finditer(licenses.doubled(pattern), line):
                start = line[:m.start()].count(" ") // 2
                found.append((start, start + m[0].count(" ") // 2, level, rule, label))
    kept = [d for d in found if not any(e[2] <= d[2] and e[0] <= d[0] and e[1] >= d[1] and (e[:2] != d[:2] or e[3] < d[3]) for e in found)]
    return len(own), base, sorted(kept)


TEXTS = [
    None, "", "  \n--", "no words here", "Licensed under the Apache License, Version 2.0.", "MIT License MIT license™ mit-license", "CC BY CC-BY/cc_by ccby",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "GNU   General\nPublic License v2 or (at your option) any later version",
    "SPDX-License-Identifier: GPL-3.0-or-later", "see https://www.apache.org/licenses/LICENSE-2.0 or http://creativecommons.org/licenses/by-sa/4.0/",
    "released under the terms of the BSD 3-Clause License; all rights reserved", "the mit license, the MIT Licence and the expat mit license", "Kelvin KIT LİCENSE ſoftware licenſe",
    "creative commons attribution non-commercial share-alike 4.0 international", "may not be copied or sold without prior written permission", "漢字 apache license 漢字",
]


def test_rules_are_many_and_in_order():
    rules = licenses.rules()
    assert licenses.stem("mozilla public", "mozilla public licen[sc]e(?: 2)?") == "licen" and licenses.stem("bsd", "bsd(?: licen[sc]e)?") == "bsd"
    assert len(rules) > 300 and [r[0] for r in rules] == sorted(r[0] for r in rules)
    for _, label, keyword, pattern in rules:
        assert len(licenses.stem(keyword, pattern)) > 1 and re.compile(licenses.doubled(pattern)), label


def test_places_and_detections_against_brute_force(spark):
    rng = random.Random(5)
    pieces = [t for t in TEXTS if t] + ["mit", "license", "apache", "gnu general public", "2.0", "version", "licensed under the", "x", "GPLv3", "cc by sa 3.0", "spdx-license-identifier: mit"]
    texts = TEXTS + [" ".join(rng.choice(pieces) for _ in range(rng.randint(2, 40))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("start", F.lit(1)).withColumn("id", F.lit(7)).withColumn("label", F.lit("x"))
    rules = licenses.rules()
    got = {r.doc_id: (r.n_words, [tuple(b) for b in r.base], [tuple(s) for s in r.spans]) for r in licenses.scan(docs).collect()}
    for i, t in rows:
        assert got[i] == brute(t, rules), t


def labels(spark, text):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).withColumn("score", licenses.score(F.col("base"), F.col("spans"))).first()
    return sorted({s.label for s in row.spans}), row.score


def test_better_detections_suppress_others(spark):
    assert labels(spark, "Licensed under the Apache License, Version 2.0.") == (["apache-2.0"], 0.95)  # 0.9 of the grant, 0.5 of the base phrase
    assert labels(spark, "GNU General Public License version 3 or any later version")[0] == ["gpl-3.0"]
    assert labels(spark, "GNU General Public License version 3 or later")[0] == ["gpl-3.0-or-later"]
    assert labels(spark, "GNU Lesser General Public License")[0] == ["lgpl"]
    assert labels(spark, "a house by the sea") == ([], 0.0)


def test_long_repeated_and_empty_input(spark):
    text = "mit license " * 30_000
    docs = spark.createDataFrame([(1, text), (1, text), (None, "cc by"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert licenses.scan(docs).count() == 4
    assert (rows[1].n_words, len(rows[1].base), rows[1].base[-1].start, len(rows[1].spans)) == (60_000, 30_000, 59_998, 30_000)
    assert (rows[None].n_words, [tuple(b) for b in rows[None].base]) == (2, [(0, 2, "cc-by")])
    assert licenses.scan(docs.limit(0)).count() == 0
