import random
import zlib
from collections import Counter

from veil.llm import spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced letter, by trying all of them."""
    short, long = sorted((a, b), key=len)
    if len(short) == len(long):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(words):
    out = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best is not None and words[best] >= 5 * n else None, n, len(others))
    rows = []
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, n, k, words[form] if form is not None else None))
    return sorted(rows)


def rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def made(seed, letters, count):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))): rng.choice([5, 6, 30, 31, 160, 160, 900]) for _ in range(count)}
    for w in list(words)[::3]:
        i = rng.randrange(len(w))
        for v in (w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i + 1:], w[:i] + rng.choice(letters) + w[i:]):
            words.setdefault(v, rng.choice([5, 25, 125]))
    return words


def test_near_forms_and_roots_against_brute_force(spark):
    """Branches of all sizes down to divided leaves: the same pairs."""
    words = made(1, "abcmnéÿ", 300) | {"": 7, "a": 40, "aaaaaa": 9, "aaaaaaa": 45, "aaaaaaaa": 300, "x" * 5000: 5, "x" * 4999 + "y": 25}
    df = spark.createDataFrame(list(words.items()), "word string, n int")
    for most in (20_000, 40, 2):
        assert rows(spelling.variants(df, most=most)) == brute(words)


def test_one_hot_branch_is_divided(spark):
    """Words of one length and equal counts in every group (letters twelve apart count as one group)."""
    words = {w: n for w, n in made(2, "am", 250).items() if len(w) < 12} | {f"qrstuv{'ao'[i % 2]}": 5 * (i + 1) for i in range(2)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling.variants(df, most=5)) == brute(words)


def test_counts_of_whole_texts(spark):
    texts = [(i, f"Straße ÉCOLE naïve x× {'Wort' * (i % 5)} commander_commander’s " + "lang" * (3_000 if i == 7 else 0)) for i in range(400)]
    texts += [(None, "alone words"), (5, None), (6, ""), (8, "12 34"), (9, "漢字 ABC")] + [(400, "again again")] * 3
    want = Counter()
    for name, text in texts:
        run, out = "", []
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
            elif run:
                out, run = [*out, run], ""
        for run in out:
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    want.pop("", None)
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in texts], "doc_id long, text string, n long, word string")
    assert {r.word: r.n for r in spelling.counted(docs).collect()} == dict(want)
    assert spelling.counted(docs.limit(0)).count() == 0
    assert spelling.variants(spelling.counted(docs.limit(0))).count() == 0


def test_search_spends_one_surplus_and_one_deficit():
    trie = spelling.Trie()
    for w in ("commander", "comander", "commandeer", "commandar", "command", "demmanocr"):
        trie.add(w, 1)
    assert sorted(w for w, _ in trie.near("commander")) == ["commandar", "commandeer"]
    assert sorted(w for w, _ in trie.near("comander")) == ["commander"]
    q = spelling.vector("commander")
    for depth in range(spelling.GROUPS + 1):
        ways = list(spelling.around(q, depth))
        assert len(ways) == len(set(ways))
        assert all(spelling.vector(w)[:depth + 1] in ways for w in ("commander", "commandar", "commandeer"))
