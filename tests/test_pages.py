import random

from pyspark.sql import functions as F

from veil.functions import geometry as GE, text as X
from veil.operators import boxes as B, elements as E, metrics as M
from veil.sources import html as H

HTML = """<html><head><title>T &amp; x</title></head><body><nav><a href="/a">Home</a></nav><main>%s
<div class=card><h2>Blue Shirt</h2><p>₹ 1,299</p><button>Add to cart</button></div><div class=card><h2>Red Shirt</h2><button id="b2">Add to cart</button></div>
<form><label for=em>E-mail</label><input id=em name=user_email type=email value="a@b.com"><label>Card <input name=cc></label><select name=s><option>One<option selected>Two<option disabled>Three</select>
<button>✕</button><span><input type=submit><b>Go on</b></span><div aria-hidden="true"><button>Ghost</button></div></form></main><footer>foot</footer></body></html>""" % ("word " * 60)


def test_elements_labels_roles_and_context(spark):
    parsed = H.parse_pages(spark.createDataFrame([(1, HTML)], "page_id long, html string"), ["page_id"])
    rows = H.page_elements(parsed, ["page_id"])
    got = [(r.label, r.role) for r in rows.orderBy("pos").collect()]
    assert got == [("Home", "link"), ("Add to cart", "button"), ("Add to cart", "button"), ("a@b.com", "textbox"), ("", "textbox"), ("Two", "combobox"), ("✕ (icon: close)", "button"), ("Go on", "button")]
    contexts = [r.c for r in rows.filter("label = 'Add to cart'").select("pos", H.card_context(F.col("node"), F.col("nodes"), F.col("label")).alias("c")).orderBy("pos").collect()]
    assert contexts == ["Blue Shirt | ₹ 1,299", "Red Shirt"]
    text = parsed.select(H.page_text(parsed).alias("t")).first().t
    assert text.startswith("word word") and text.endswith("Home\nfoot") and parsed.first().title == "T & x"
    fields = [(r.field_label, r.context) for r in H.form_fields(rows, ["page_id"]).orderBy("pos").collect()]
    assert fields == [("E-mail", "E mail user email"), ("Card", "Card cc")]


def test_ids_skip_values_and_count_collisions(spark):
    rows = spark.createDataFrame([(1, 0, "el_go"), (1, 1, "el_go"), (1, 2, None), (1, 3, "el_stop"), (2, 0, "el_go")], "page int, pos long, base string")
    got = [r.element_id for r in E.assign_ids(rows, ["page"]).orderBy("page", "pos").collect()]
    assert got == ["el_go", "el_1", "el_2", "el_stop", "el_go"]
    ids = spark.createDataFrame([("", "Call 98765 43210"), ("Main-Btn", "x"), ("", "→"), ("", "3 left Buy now")], "i string, t string").select(E.base_id(F.col("i"), F.col("t")).alias("b")).collect()
    assert [r.b for r in ids] == [None, "el_main_btn", None, "el_buy_now"]


def test_names_and_sites(spark):
    pairs = [("add to cart", "go to cart", False), ("blue shirt large", "blue shirt large 2", True), ("a very long label", "a very long label that goes on and on", True), ("", "x", False)]
    got = spark.createDataFrame(pairs, "a string, b string, e boolean").select(X.same_name(F.col("a"), F.col("b")).alias("s"), "e").collect()
    assert all(r.s == r.e for r in got)
    urls = [("http://www.amazon.co.uk:80/x", "amazon"), ("https://en.wikipedia.org/", "wikipedia"), ("http://localhost/", "localhost"), ("nothing", "")]
    got = spark.createDataFrame(urls, "u string, e string").select(E.site_label(F.col("u")).alias("s"), "e").collect()
    assert all(r.s == r.e for r in got)


def _lines(spark, rows):
    return spark.createDataFrame(rows, "page int, line int, text string, x double, y double, w double, h double").withColumn("bbox", GE.box("x", "y", "w", "h"))


def test_layout_pairs_and_both_ways_of_claiming(spark):
    lines = _lines(spark, [(1, 0, "OTP", 0., 0., 40., 20.), (1, 1, "482913", 200., 0., 60., 20.), (1, 2, "OTP:", 0., 30., 40., 20.), (1, 3, "771122", 100., 31., 60., 20.),
                           (1, 4, "Ticket", 0., 300., 60., 20.), (1, 5, "88451200", 90., 300., 60., 20.), (1, 6, "Password", 0., 400., 60., 20.), (1, 7, "hunter2", 0., 430., 60., 20.)])
    want = [(1, "OTP", "482913"), (3, "OTP", "771122"), (7, "PASSWORD", "hunter2")]
    for small in (5000, 0):
        got = sorted((r.line, r.type, r.value) for r in B.layout_values(lines, ["page"], small).collect())
        assert got == want


def test_grid_pairs_equal_brute_force(spark):
    rows = [(p, i, "t", float((i * 97) % 700), float((i * 53) % 500), float(10 + i % 90), float(5 + i % 300)) for p in (1, 2) for i in range(60)]
    boxes = _lines(spark, rows).select("page", "line", "bbox")
    other = boxes.select("page", F.col("line").alias("o"), F.col("bbox").alias("b"))
    got = {(r.page, r.line, r.o) for r in B.touching(boxes, other, ["page"], F.col("bbox"), F.col("b")).filter(GE.intersection(F.col("bbox"), F.col("b")) > 0).collect()}

    def meets(a, b):
        return min(a[3] + a[5], b[3] + b[5]) > max(a[3], b[3]) and min(a[4] + a[6], b[4] + b[6]) > max(a[4], b[4])

    assert got == {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and meets(a, b)}


def test_signature_is_of_keys_in_order_and_range_names_the_edit(spark):
    rng = random.Random(3)
    pages, edits = {}, {}
    for p in range(40):
        keys = [rng.choice("abc") for _ in range(rng.choice([1, 2, 5, 30]))]
        other = list(keys)
        at = rng.randrange(len(keys))
        other[at:at + rng.randrange(3)] = [rng.choice("abc") for _ in range(rng.randrange(3))]
        pages[p], edits[p] = keys, other
    edits[1], pages[2], edits[3] = [], [], list(pages[3])
    frames = [spark.createDataFrame([(p, i * 3, k) for p, ks in side.items() for i, k in enumerate(ks)], "page int, pos long, label string") for side in (pages, edits)]
    got = {r.page: (r.change, r.first, r.before_end, r.after_end) for r in E.changed_range(*frames, ["page"], key=F.col("label"), widths=(8, 2)).collect()}
    want = {}
    for p in pages:
        a, b = pages[p], edits[p]
        if not a and not b:
            continue
        first = next((i for i in range(max(len(a), len(b))) if a[i:i + 1] != b[i:i + 1]), None)
        back = next((i for i in range(max(len(a), len(b))) if a[::-1][i:i + 1] != b[::-1][i:i + 1]), None)
        if first is None:
            want[p] = ("same", None, None, None)
            continue
        back = min(back, len(a) - first, len(b) - first)
        want[p] = ("added" if not a else "removed" if not b else "changed", first, len(a) - back, len(b) - back)
    assert got == want
    hashes = [{r.page: r.hash for r in E.page_signature(f, ["page"], key=F.col("label")).collect()} for f in frames]
    for p in pages:
        if pages[p] and edits[p]:
            assert (hashes[0][p] == hashes[1][p]) == (pages[p] == edits[p])
    assert E.changed_range(frames[0].limit(0), frames[1].limit(0), ["page"], key=F.col("label")).count() == 0


def test_similar_names_equal_brute_force(spark):
    rng = random.Random(4)
    names = {"", "add to c", "add to cart", "add to cart 12", "add to", "ab", "ab cd"}
    names |= {" ".join(rng.choice(["add", "to", "cart", "blue", "shirt", "large", "x"]) for _ in range(rng.randrange(1, 7)))[: rng.choice([7, 8, 12, 99])] for _ in range(150)}
    rows = [(i % 2, n) for n in names for i in range(3)]
    frame = spark.createDataFrame(rows, "page int, name string")
    got = {(r.page, r.name, r.name_2) for r in E.similar_names(frame, frame, ["page"]).collect()}
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    same = {(r.a, r.b) for r in pairs.filter(X.same_name(F.col("a"), F.col("b"))).collect()}
    assert got == {(p, a, b) for p in (0, 1) for a, b in same}


def test_words_lie_within_corpus_words(spark):
    rng = random.Random(5)
    corpus = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))) for _ in range(40)] + ["", "12345"]
    lines = [(i, " ".join("".join(rng.choice("ab") for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(3)))) for i in range(300)]
    lines += [(1000 + i, w[j:j + n]) for i, (w, j, n) in enumerate((w, j, n) for w in corpus for j in (0, 3) for n in (9, 12, 30))]
    got = {r.id: r.correct for r in M.word_precision(spark.createDataFrame(lines, "id int, text string"), spark.createDataFrame([(w,) for w in corpus], "word string"), ["id"]).collect()}
    assert got == {i: all(len(w) < 3 or any(w in c for c in corpus) for w in t.split() if any(x.isalpha() for x in w)) for i, t in lines}


def test_similar_names_are_complete_for_short_and_long_names(spark):
    rng, words = random.Random(8), [f"w{i}" for i in range(12)]
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 10))) for _ in range(500)})
    left, right = names[::2], names[1::2] + names[:20]

    def same(a, b):
        x, y = set(a.split()), set(b.split())
        return a == b or min(len(a), len(b)) >= 8 and (a.startswith(b) or b.startswith(a)) or len(x & y) / len(x | y) >= 0.6

    want = {(p, a, b) for p in (1, 2) for a in left for b in right if same(a, b)}
    one, two = (spark.createDataFrame([(p, n) for p in (1, 2) for n in side], "page int, name string") for side in (left, right))
    assert {tuple(r) for r in E.similar_names(one, two, ["page"]).collect()} == want and len(want) > 500


def test_frequent_words_alone_bring_no_short_names_together(spark):
    # 600 names of five tokens, each of a few words: 17 or more of a name's own number of copies used to meet at one word.
    rows = [(f"a{i % 8} n{i // 8 % 8} t{i % 6} brand {i % 50}",) for i in range(600)]
    keys = spark.createDataFrame(rows, "name string").select(F.explode(E._together(
        F.lit(5), F.array(*[F.split("name", " ")[i] for i in (4, 0, 1, 2, 3)]), F.array(F.lit(4), F.lit(5)))).alias("k"))
    assert keys.groupBy("k").count().agg(F.max("count")).first()[0] <= 25
