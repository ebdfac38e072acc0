"""Operators on documents against brute force on small fixtures with hard rows."""

import hashlib
import re
import sys
import types
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from veil.llm import decontamination, language, line_dedup, packing, secrets, simhash, toxicity
from veil.llm.common import components, small_batches, stored, tidy

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark string, fp int, th string, id int, rank int, value string"


def _words(rng, n, letters="abcdefghijklmnop"):
    return [" ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(n))][0]


def _rows():
    rng = np.random.default_rng(3)
    run = "\n".join(_words(rng, 12) for _ in range(6))
    body = [_words(rng, 60) for _ in range(8)]
    texts = [
        None, "", "   \n\t ", "x", run + "\n" + body[0], body[1] + "\n" + run, body[1] + "\n" + run, body[2], body[2].upper(), body[2] + " tail",
        "\n".join(["same line of a few words here"] * 40), body[3] + "\n\n" + run + "\n\n" + body[4], _words(rng, 30_000), "short line\nshort line", "short line\nshort line",
        "päss wörd Ünïcode 𝒳 " + body[5], "password = hunter2hunter2x AKIA" + "Q7" * 8 + " é " + "0f" * 9 + " k=Zr8Kq1Wv7Pt3Lx9Bn5Md2Hs6",
    ]
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or ""), "m", i, "t", 1, 2, "v") for i, t in enumerate(texts)]
    return rows + [rows[4], (None, body[6], "en", None, 1, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _cut(rows, limit=50):
    """Later copies of runs by comparing every minimal run of every text, followed line by line as far as it equals its first occurrence."""
    order = sorted({(r[0], xxhash_of(r[1]), r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    first, gone = {}, defaultdict(set)
    kept = {(doc, mark): [(n, x.strip(" ")) for n, x in enumerate(text.split("\n")) if x.strip(" ")] for doc, mark, text in order}
    for doc, mark, _text in order:
        lines = kept[doc, mark]
        for i in range(len(lines)):
            words, j = 0, i
            while j < len(lines) and words < limit:
                words += lines[j][1].count(" ") + 1
                j += 1
            if words >= limit:
                key = tuple(x for _, x in lines[i:j])
                head = first.setdefault(key, (doc, mark, i))
                if head[:2] != (doc, mark) or i >= head[2] + j - i:
                    other, at = kept[head[:2]], head[2] + j - i
                    while j < len(lines) and at < len(other) and lines[j][1] == other[at][1]:
                        j, at = j + 1, at + 1
                    gone[doc, mark] |= set(range(lines[i][0], lines[j - 1][0] + 1))
    return sorted(((r[0], None if r[1] is None else "\n".join(x for n, x in enumerate(r[1].split("\n")) if n not in gone[r[0], xxhash_of(r[1])])) for r in rows), key=str)


def xxhash_of(text):
    n = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return 42 if text is None else n - (1 << 64) if n >= 1 << 63 else n


def test_line_dedup(docs, none):
    got = line_dedup.deduplicated(docs)
    assert got.columns == docs.columns + ["__deleted"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == _cut(_rows())
    assert got.where("doc_id = 5").first().text == _rows()[5][1].split("\n")[0]
    assert line_dedup.deduplicated(none).count() == 0


def test_repeated_runs_go_whole(spark):
    """Tails of fewer words than the limit, long tails behind another first occurrence, blank lines between, runs that repeat in one text."""
    rng = np.random.default_rng(9)
    line = lambda n: _words(rng, n)
    a, b, c, d, e = line(60), line(40), line(25), line(25), line(3)
    shorts = [line(2) for _ in range(120)]
    texts = [f"{a}\n{b}\nx", f"y\n{a}\n\n{b}\nz", f"{c}\n{d}\n{e}\nw", f"{c}\n{d}\n{e}", "\n".join(shorts[70:100]), "\n".join([a, *shorts]), "\n".join(["q", a, *shorts, "end"]),
             "\n".join([c, d, e, c, d, e, c, d]), "\n".join([e] * 90)]
    rows = [(i, t, "en", "s", len(t), "m", i, "t", 1, 2, "v") for i, t in enumerate(texts)]
    got = sorted(((r.doc_id, r.text) for r in line_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == _cut(rows)
    assert dict(got)[1] == "y\nz" and dict(got)[3] == "" and dict(got)[6] == "q\nend"


def _print(text, k):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_growing_tables_are_not_broadcast(spark, docs):
    """A stored table counts by its files' bytes, a tenth or less of what it takes in the driver when it is broadcast."""
    rows, lines = line_dedup.intervals(docs.select("doc_id", "text"), 50)
    copies = rows.select("doc_id", "mark", "first", F.col("i").alias("next"), F.col("doc_id").alias("head_doc"), F.col("mark").alias("head_mark"), F.col("i").alias("head_next"))
    tree = components(stored(spark.range(20).selectExpr("id AS a", "id + 1 AS b"), "links"))
    for df in (rows, line_dedup.followed(copies, lines, 50), line_dedup.deduplicated(docs), simhash._first_of_each(
            docs.select("doc_id", "text"), docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("id").cast("long").alias("mark")), tree)):
        assert "SortMergeJoin" in _plan(df) and "BroadcastHashJoin" not in _plan(df)


def test_simhash(docs, none):
    rows = [r for r in _rows() if len(r[1] or "") < 50_000]
    got = {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.grouped(docs.where("length(text) < 50000 OR text IS NULL")).collect()}
    assert {(i, f) for i, f, _ in got} == {(r[0], _print(r[1], 3)) for r in rows}
    assert {c for i, _, c in got if i in (7, 8)} == {7} and {c for i, _, c in got if i in (0, 1, 2)} == {0}
    assert simhash.grouped(none).count() == 0


def test_simhash_links_all_pairs_within_two_bits(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    prints = list({b ^ sum(1 << int(i) for i in rng.choice(63, rng.integers(0, 5), replace=False)) for b in base for _ in range(8)} | {0, -1, 1, 3, 7})
    want = {(min(a, b), max(a, b)) for a in prints for b in prints if a != b and ((a ^ b) % (1 << 64)).bit_count() <= 2}
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    assert got == want and len(want) > 20


def test_near_copies(spark, docs, none):
    rng = np.random.default_rng(5)
    base = [_words(rng, 200) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(20):
        words = base[i].split(" ")
        words[10 + i] = "changed"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, base[0].upper()), (201, base[0])]
    kept = {r.doc_id for r in simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(30)) <= kept and len(kept) <= 31
    got = simhash.without_near_copies(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == len(set(ids)) and {0, 4, 5, 7, None} <= set(ids) and not {1, 2, 6, 8, 9} & set(ids)
    assert simhash.without_near_copies(none).count() == 0


def _edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination(spark, docs, none):
    rng = np.random.default_rng(9)
    items = [(i, _words(rng, 12)) for i in range(5)] + [(7, None), (8, " "), (None, "a b c"), (0, _words(rng, 12))]
    texts, want = [], set()
    for n in range(24):
        item = items[n % 5]
        s = list(item[1])
        for _ in range(n // 4):
            at = int(rng.integers(len(s)))
            [lambda: s.__setitem__(at, "q"), lambda: s.pop(at), lambda: s.insert(at, "z")][int(rng.integers(3))]()
        texts.append((n, "Lead words\n" + "".join(s).upper().replace(" ", "  ") + "\n tail words " + _words(rng, 5)))
        for i, t in items:
            if t and t.strip() and i is not None:
                t, x = decontamination.normal(t), decontamination.normal(texts[-1][1])
                if _edits(t, x) <= decontamination.budget(len(t), 0.1):
                    want.add((n, i, _edits(t, x)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    for size in (1 << 20, 100):  # one block, and a block for each item
        found = decontamination.contaminated(rows, bench, block_bytes=size).collect()
        assert {(r.doc_id, r.item_id, r.edits) for r in found} == want and len(want) > 8
    exact = next(r for r in found if r.edits == 0)
    assert texts[exact.doc_id][1][exact.start:exact.stop].split() == items[exact.item_id][1].upper().split()
    kept = decontamination.clean(docs.unionByName(rows, allowMissingColumns=True), bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() + len(texts) - len({n for n, _, _ in want})
    assert decontamination.clean(none, bench).count() == 0 and decontamination.clean(docs, bench.limit(0)).count() == docs.count()


def test_packing(docs, none):
    js = packing.tokenizer_json()
    tokenizer = Tokenizer.from_str(js)
    odd = ["it's <|endoftext|> ok", "é é J̌ ΑΣ İstanbul ﬁ ½ ²x", "don't\n\n I'LL 12345 a\tb c", ""]
    for text in odd + [r[1] or "" for r in _rows()[:12]]:
        assert packing.Ids(js, 1)(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]
    rows = packing.packed(docs, js, window=64).collect()
    pieces, used = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        used[r.sequence_id].append((r.offset, r.length))
    seen = 0
    for source in {(r[0], r[1]) for r in _rows()}:
        ids = np.array(tokenizer.encode(source[1] or "", add_special_tokens=False).ids + [1], "<u4")
        copies = sum(r[:2] == source for r in _rows())
        own = pieces[source[0], len(ids)]
        spans = sorted((r.start, r.length) for r in own)
        if source[0] is not None:
            assert sum(n for _, n in spans) == copies * len(ids)
            assert all(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
        seen += copies * len(ids)
    assert sum(r.length for r in rows) == seen
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.packed(none, js).count() == 0


def test_packing_holds_little(spark):
    """Few words kept give the same ids, and rows come to Python in batches of bounded size; the session's limit comes back."""
    js, rng = packing.tokenizer_json(), np.random.default_rng(5)
    few, many = packing.Ids(js, 1, cache=50), packing.Ids(js, 1)
    for text in [_words(rng, 40) for _ in range(20)]:
        assert few(pa.array([text]))[0].tolist() == many(pa.array([text]))[0].tolist()
    assert len(few.known) + len(few.old) < 400 < len(many.known)
    name, rows = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 4000, 1, 1).select(F.expr("repeat('x', 1000)").alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes]})

    before = spark.conf.get(name)
    with small_batches(spark, 1 << 18):
        got = rows.mapInArrow(sizes, "bytes long").collect()
    assert len(got) > 10 and max(r.bytes for r in got) < 1 << 19 and spark.conf.get(name) == before


def test_workers_give_memory_back():
    """What a task held goes back to the system at its end, also where something that stays lies above it."""
    def anonymous():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("Pss_Anon:")) / 1024

    stays = []

    def work(batches):
        held = [bytes(1000) for _ in range(100_000)]
        stays.append(bytes(1000))
        yield anonymous() + 0 * len(held)

    task = tidy(work)(iter([]))
    assert next(task) - (list(task) or anonymous()) > 50


def test_pipeline_keeps_workers_small(spark, docs):
    """The pipeline's packing leaves no words in a Python worker, with the same pieces, and from its first stage on texts come in small batches."""
    js, size = packing.tokenizer_json(), 77

    def kept(batches):
        names = list(vars(sys.modules.get("_kept_token_ids", types)))
        yield from (pa.RecordBatch.from_pydict({"n": [sum(str(name).endswith(f":1:{size}") for name in names)]}) for _ in batches)

    def workers_with_words():
        return sum(r.n for r in spark.range(0, 32, 1, 32).mapInArrow(kept, "n long").collect())

    own = packing.pieces(docs, js, 64, cache=size, keep=False).collect()
    assert own and workers_with_words() == 0
    assert sorted(map(str, own)) == sorted(map(str, packing.pieces(docs, js, 64, cache=size).collect())) and workers_with_words() > 0

    @F.pandas_udf("long")
    def together(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = spark.conf.get(name)
    try:
        corpus_pipeline.in_small_batches(spark)
        rows = spark.range(0, 9000, 1, 1).select(together(F.expr("repeat('x', 10000)")).alias("n")).collect()
    finally:
        spark.conf.set(name, limit)
    assert len(rows) == 9000 and max(r.n for r in rows) <= 2 * corpus_pipeline.BATCH // 10_000


def test_packing_keeps_parts_once(monkeypatch):
    """Forms of a word that differ in case and signs are one entry; odd words and long texts cut at blanks give the tokenizer's ids."""
    js, rng = packing.tokenizer_json(), np.random.default_rng(6)
    tokenizer, encode = Tokenizer.from_str(js), packing.Ids(js, 1)
    words = sorted(set(_words(rng, 200).split(" ")))
    forms = [form for w in words for form in (w, w.title(), w.upper(), w + ",", w.title() + ".", f"({w})", w + ";")]
    odd = ["É e\u0301 a\u0338 <b>it's</b> x<|endoftext|>y", "\u0391\u03a3 \u0130 \u212a \u023a\u1e9e \u1112\u1161\u11ab \uac01 \u0663\u2460", "a\u00a0b\u200bc\x1cd\re\tf", "''s '", "\U0001f44d\U0001f3fd \U0001d4b3"]
    every = ["".join(f"a{c}{c}1{c}. {c} " for c in map(chr, range(a, a + 64)) if c.isprintable()) for a in range(0, 0x3400, 64)]
    texts = [" ".join(forms), None, "", " \n", *odd, *every]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert [ids.tolist() for ids in encode(pa.array(texts[:1]))] == want[:1] and len(encode.known) <= len(words) + 20
    assert [ids.tolist() for ids in encode(pa.array(texts))] == want
    slices = packing.Ids.slices
    assert all(b"".join(part for _, part in slices(b"ab c\n" * 9 + b"x" * 50 + b" y", n)) == b"ab c\n" * 9 + b"x" * 50 + b" y" for n in range(1, 60))
    monkeypatch.setattr(packing.Ids, "slices", staticmethod(lambda text: slices(text, 30)))
    assert [ids.tolist() for ids in packing.Ids(js, 1)(pa.array(texts))] == want
    assert packing.Ids(js, 1)(pa.array([], pa.string())) == []


def test_packing_fill_is_the_fullest():
    """Of all choices beside the longest length left, the one with the least padding, for small windows."""
    rng = np.random.default_rng(7)
    for window in (8, 12, 20):
        for _ in range(60):
            lengths = rng.integers(1, window + 1, rng.integers(1, 8)).tolist()
            counts = packing.fill(np.bincount(lengths, minlength=window + 1), window)
            taken = [s for s, n in counts.items() for _ in range(n)]
            longest, rest = max(lengths), sorted(lengths)[:-1]
            sums = {longest + sum(s for i, s in enumerate(rest) if chosen >> i & 1) for chosen in range(1 << len(rest))}
            assert all(lengths.count(s) >= n for s, n in counts.items()) and longest in counts
            assert packing.padding(sum(taken), window) == min(packing.padding(u, window) for u in sums if u <= window)


def test_packing_windows_are_full():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 2048, 3000)
    sequence, offset = packing.windows_of(lengths, 2048)
    used = np.bincount(sequence, weights=lengths).astype(int)
    assert used.max() <= 2048 and sum(packing.padding(int(u), 2048) for u in used) < 0.01 * lengths.sum()
    for size in (1, 3, 1500, 2047):
        sequence, _ = packing.windows_of(np.full(50, size), 2048)
        assert np.bincount(sequence, weights=np.full(50, size)).max() <= 2048


def test_language(spark, docs, none, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    got = entry.queries()["op9_language_id"](spark, sf).join(rows.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    model = language.fit(rows)
    kept = language.known_languages(rows, model)
    assert kept.columns == rows.columns and kept.count() >= 0.99 * rows.count()
    out = language.known_languages(docs, model).select("doc_id").collect()
    assert not {0, 1, 2} & {r.doc_id for r in out}
    assert language.fit(none).langs == () and language.known_languages(docs, language.fit(none)).count() == 0
    assert language.predict_one("1234 !?", model, language.letters_table()) == ("und", 0.0)


def test_toxicity(spark, docs, none, sf):
    rows, labels = spark.read.parquet(f"{sf}/../sf0.1/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.1/labels.parquet")
    got = entry.queries()["op4_toxicity"](spark, f"{sf}/../sf0.1").join(labels, "doc_id").where("held_out").toPandas()
    truth, score = got.toxic.to_numpy(), got.score.to_numpy()
    ranks = score.argsort().argsort() + 1
    n = truth.sum()
    assert (ranks[truth == 1].sum() - n * (n + 1) / 2) / (n * (len(truth) - n)) > 0.93
    assert got[got.predicted == 1].toxic.mean() > 0.9
    empty = toxicity.fit(none, labels)
    out = docs.select("doc_id", toxicity.scored(docs["text"], empty, spark).alias("score")).collect()
    assert len(out) == len(_rows()) and {r.score for r in out} == {0.5}


def test_factorization_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array(sorted({100 + int(a), 200 + int(b), int(rng.integers(1000, 1040))})))
        labels.append(float(a == b))
    model = toxicity.train(rows, np.array(labels))
    right = [(toxicity.raw_score(model, r) > 0) == (y > 0.5) for r, y in zip(rows, labels)]
    assert np.mean(right) > 0.95  # no sum of single weights exceeds one half by much
    assert not np.flatnonzero(model.factor.any(axis=1) & (np.arange(toxicity.SLOTS) >= 1000)).size  # the rest are noise
    blocks = np.concatenate([np.stack([a, b]) for _, a, b in toxicity.pair_buckets(np.arange(2000))], axis=1)
    assert blocks.shape[1] == 2000 * 1999 // 2 and (blocks[0] < blocks[1]).all()
    odd = toxicity.train([np.zeros(0, np.int64)] * 3, np.ones(3))
    assert not odd.weight.any() and not odd.factor.any()


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(1)) >= 12]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(spans)


def test_secrets(spark, docs, none):
    extra = ["secret: token = abcdefghijklmnop", "secret: token=abcdefghijklmnop", "API_KEY='x.y/z+abcdefgh'", "tokentoken::abcabcabcabc", 'passwd" : "0123456789abcdef0"']
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    got = [(r.doc_id, ",".join(f"{s.kind}:{s.start}:{s.stop}" for s in r.base)) for r in secrets.scan(rows).collect()]
    assert sorted(got, key=str) == sorted(((i, ",".join(f"{k}:{a}:{b}" for a, _, b, k in _base(t))) for i, t in texts), key=str)
    found = {r.doc_id: [s for s in r.spans if s.kind == "random"] for r in secrets.scan(rows).collect()}
    assert len(found[16]) == 1 and not found[12] and not found[7]
    text = _rows()[16][1]
    assert text[found[16][0].start:found[16][0].stop] == "Zr8Kq1Wv7Pt3Lx9Bn5Md2Hs6"
    assert secrets.scan(none).count() == 0


def test_random_tokens_of_every_encoding(spark):
    """Detection share of random tokens beside written ones, of which no more are found than the false-discovery limit admits."""
    rng = np.random.default_rng(21)
    words = "the quick brown international information between government university development understanding experience something".split()
    rows = [("written", 0, "".join(rng.choice(words, 4))) for _ in range(60)]
    rows += [("written", 0, "".join(w.title() for w in rng.choice(words, 4))) for _ in range(60)]
    rows += [("written", 0, sep.join(rng.choice(words, 5))) for _ in range(60) for sep in "-_/"]
    rows += [("regular", 0, t) for t in ("0" * 24, "12345678901234567890", "abcdefghijklmnopqrstuvwxyz", "20240101000020240102", "ABABABABABABABABABABABAB")]
    for name, _, alphabet in secrets.ENCODINGS:
        rows += [(name, n, "".join(rng.choice(list(alphabet), n))) for n in (20, 32, 64) for _ in range(100)]
    frame = spark.createDataFrame(rows, "planted string, n int, value string")
    found = {(r.planted, r.n): r.c for r in secrets.discoveries(frame).groupBy("planted", "n").agg(F.count("*").alias("c")).collect()}
    assert found.get(("written", 0), 0) <= 0.01 * sum(found.values()) and not found.get(("regular", 0))
    assert all(found.get((name, n), 0) >= {20: 60, 32: 75, 64: 95}[n] for name, _, _ in secrets.ENCODINGS for n in (20, 32, 64))


def test_secret_digest(spark, sf):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    for r in entry.queries()["op8_secret_scan"](spark, sf).collect():
        spans = _base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[3] == k for s in spans) for k in ("assign", "access", "hex"))


def _components_by_brute_force(texts, shingle=5, similarity=0.8):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= similarity * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in range(len(texts))}


def _edited(rng, words, places):
    words = list(words)
    for at in places:
        words[at] = "new" + str(rng.integers(1 << 40))
    return " ".join(words)


def test_near_copies_of_one_original_all_meet_it(spark):
    rng = np.random.default_rng(11)
    base = _words(rng, 300).split(" ")
    # Six spread edits: 0.82 to the original, 0.69 between copies. The original is neither first nor last.
    texts = [_edited(rng, base, rng.permutation(49)[:6] * 6 + 3) for _ in range(300)]
    texts.insert(150, " ".join(base))
    texts += [_words(rng, 120) for _ in range(40)]
    got = simhash.without_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = _components_by_brute_force(texts)
    assert {r.doc_id for r in got.collect()} == want and len(want) == 41


def test_near_copies_among_many_alike(spark):
    rng = np.random.default_rng(12)
    common = _words(rng, 60).split(" ")
    # All texts share half of their words, so fingerprints crowd; every sixth has a copy of similarity 0.80 to 0.85 somewhere else.
    own = [_words(rng, 60).split(" ") for _ in range(900)]
    texts = [" ".join(common + w) for w in own]
    texts += [_edited(rng, common + w, (63, 75, 118)[:2 + i % 2]) for i, w in enumerate(own[::6])]
    got = simhash.without_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = _components_by_brute_force(texts)
    assert {r.doc_id for r in got.collect()} == want and len(want) == 900


def test_counts_bound_what_is_shared():
    rng = np.random.default_rng(13)
    for n_x, n_y in ((1, 1), (5, 90), (400, 430), (70_000, 300), (3_000, 2_900)):
        pool = rng.integers(-(1 << 63), (1 << 63) - 1, n_x + n_y, dtype=np.int64)
        x, y = np.unique(pool[:n_x]), np.unique(pool[max(0, n_x - min(n_x, n_y) // 2):][:n_y])
        most = simhash._most_shared(simhash._counts(x), len(x), simhash._counts(y), len(y))
        assert len(np.intersect1d(x, y)) <= most <= min(len(x), len(y))
    same = np.arange(1000, dtype=np.int64) << 32  # all in one value: counts beyond a byte
    assert simhash._most_shared(simhash._counts(same), 1000, simhash._counts(same), 1000) == 1000


def test_near_copies_with_ids_of_text_and_repeated_rows(spark):
    rng = np.random.default_rng(14)
    base = _words(rng, 120)
    rows = [("b", base, 1), ("b", base, 2), ("a", base.upper(), 3), (None, base + " tail", 4), (None, base + " tail", 5), ("c", None, 6), (None, " ", 7), ("d", _words(rng, 90), 8)]
    got = simhash.without_near_copies(spark.createDataFrame(rows * 2, "doc_id string, text string, th int")).collect()
    assert sorted((r.doc_id or "", r.th) for r in got) == [("a", 3), ("c", 6), ("d", 8)]
    alone = simhash.without_near_copies(spark.createDataFrame([(None, base, 1)] * 3, "doc_id long, text string, th int")).collect()
    assert [r.doc_id for r in alone] == [None]


def test_letters_of_all_planes():
    letter = language.letters_table()
    assert not letter[-1] and not any(chr(c).isalpha() for c in range(len(letter), 0x110000))
    assert not list(language.gram_hashes("\ue000 \U000f0000\U0010fffd 12 \U000e0101", letter)) and list(language.gram_hashes("\U00031350\U00020000", letter))
