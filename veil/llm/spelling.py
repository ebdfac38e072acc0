"""Spelling variants: words one edit apart, each led to its most frequent near word.

Words are arranged in a trie by their length and then by how many letters of each of twelve letter groups they hold. One edit moves these
counts by at most one surplus and one deficit, so a depth-first search with a budget of one each reaches every word that can be one edit
away, and the words in the leaves it ends in are verified. The trie is spread over tasks by its upper levels: a branch of too many words is
cut one level further down, and a leaf of too many is dealt out by the halves of its words, one of which every edit leaves whole. A word
looks for words of its own length and one letter longer; shorter ones find it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veil.llm.common import query, stored, table
from veil.llm.merkle import LOWER, UPPER

#: Letter groups (the rest of the code point by their number), and the most words that one task's branch of the trie holds.
GROUPS, BRANCH = 12, 20_000
#: A run in a document loses a letter where this divides its checksum.
SLIP = 199
#: Bytes of Latin-1 that are part of a run, with A-Z lower-cased; all others are blanks.
RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Distinct words that a task counts before it hands them on.
HELD = 500_000

Vector = tuple[int, ...]


def runs(text: str) -> list[bytes]:
    """Maximal letter runs (A-Z, a-z, U+00C0 to U+00FF) as Latin-1, only A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(RUNS).split()


def slipped(prefix: int, run: bytes) -> bytes:
    """The run as this document spells it; ``prefix`` is the checksum of its id and a colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    return run[:h % len(run)] + run[h % len(run) + 1:] if h % SLIP == 0 else run


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) of all documents, shortest words and rare ones included. A null id is the empty text, a null text has no word."""
    def run(batches: Iterator[pa.RecordBatch]):
        held: Counter[bytes] = Counter()

        def handed():
            out = pa.RecordBatch.from_pydict({"word": [w.decode("latin-1") for w in held], "n": list(held.values())},
                                             schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))
            held.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                prefix = zlib.crc32(f"{name}:".encode())
                for word, n in Counter(runs(text)).items():
                    held[slipped(prefix, word)] += n
                if len(held) > HELD:
                    yield handed()
        yield handed()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").where("text IS NOT NULL")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("word <> ''")


def vector(word: str) -> Vector:
    """The way of a word through the trie: its length, then its letters of each group."""
    out = [len(word)] + [0] * GROUPS
    for c in word:
        out[1 + ord(c) % GROUPS] += 1
    return tuple(out)


def around(q: Vector, depth: int) -> Iterator[Vector]:
    """Upper parts, ``depth`` counts after the length, of all ways that a search for ``q`` may take."""
    head = q[1:depth + 1]

    def moved(counts: Vector, d: int):
        return (counts[:i] + (counts[i] + d,) + counts[i + 1:] for i in range(depth) if counts[i] + d >= 0)

    for counts in (head, *moved(head, 1)):
        yield (q[0] + 1, *counts)
        yield (q[0], *counts)
    for less in moved(head, -1):
        yield (q[0], *less)
        for i in range(depth):
            if less[i] == head[i]:
                yield (q[0], *less[:i], less[i] + 1, *less[i + 1:])


def one_edit(short: str, long: str) -> bool:
    """Whether ``long`` (as long or one letter longer) is exactly one replaced or inserted letter away."""
    at = next((i for i, (a, b) in enumerate(zip(short, long)) if a != b), len(short))
    if len(short) == len(long):
        return at < len(short) and short[at + 1:] == long[at + 1:]
    return short[at:] == long[at + 1:]


class Leaf:
    """Words of equal counts, found by either half: an edit leaves one of them whole."""

    def __init__(self, way: Vector) -> None:
        self.way = way
        self.heads: dict[str, list[tuple[str, int]]] = {}
        self.tails: dict[str, list[tuple[str, int]]] = {}

    def add(self, word: str, n: int) -> None:
        half = len(word) // 2
        self.heads.setdefault(word[:half], []).append((word, n))
        self.tails.setdefault(word[half:], []).append((word, n))

    def near(self, word: str, only: str) -> Iterator[tuple[str, int]]:
        """Words one edit from ``word``; ``only`` names the half by which a divided leaf is asked."""
        half = self.way[0] // 2
        head, tail = word[:half], word[len(word) - (self.way[0] - half):]
        if only != "t":
            yield from (x for x in self.heads.get(head, ()) if one_edit(word, x[0]))
        if only != "h":
            yield from (x for x in self.tails.get(tail, ()) if not x[0].startswith(head) and one_edit(word, x[0]))


class Trie:
    """Branches by length, then by the count of each letter group. A leaf stands where its words' counts are the only ones of the branch."""

    def __init__(self) -> None:
        self.top: dict = {}

    def add(self, word: str, n: int) -> None:
        node, way, level = self.top, vector(word), 0
        while True:
            below = node.get(way[level])
            if below is None or isinstance(below, Leaf) and below.way == way:
                if below is None:
                    below = node[way[level]] = Leaf(way)
                below.add(word, n)
                return
            if isinstance(below, Leaf):
                below = node[way[level]] = {below.way[level + 1]: below}
            node, level = below, level + 1

    def near(self, word: str, only: str = "") -> Iterator[tuple[str, int]]:
        """Words one edit away that are as long or one letter longer: depth first, with one surplus and one deficit to spend."""
        q = vector(word)
        # (node, its level, surplus and deficit left); one letter more is a surplus without a deficit.
        open_ = [(self.top[length], 1, 1, deficit) for length, deficit in ((q[0], 1), (q[0] + 1, 0)) if length in self.top]
        while open_:
            node, level, surplus, deficit = open_.pop()
            if isinstance(node, Leaf):
                yield from node.near(word, only)
                continue
            count = q[level]
            if (below := node.get(count)) is not None:
                open_.append((below, level + 1, surplus, deficit))
            if surplus and (below := node.get(count + 1)) is not None:
                open_.append((below, level + 1, 0, deficit))
            if deficit and (below := node.get(count - 1)) is not None:
                open_.append((below, level + 1, surplus, 0))


def name_of(way: Vector) -> str:
    return ".".join(map(str, way))


def branches(words: DataFrame, most: int) -> DataFrame:
    """(branch, depth, divided): the uppermost branches of the trie with at most ``most`` words; a full-depth one with more is divided."""
    open_, out, depth = words, None, 0
    while True:
        counts = open_.groupBy(F.slice("way", 1, depth + 1).alias("head")).agg(F.count("*").alias("n"))
        counts = stored(counts.withColumn("settled", (F.col("n") <= most) | F.lit(depth == GROUPS)), "branches")
        done = counts.where("settled").select(F.array_join(F.transform("head", lambda x: x.cast("string")), ".").alias("branch"),
                                              F.lit(depth).alias("depth"), (F.col("n") > most).alias("divided"))
        out = done if out is None else out.unionByName(done)
        if depth == GROUPS or not counts.where("NOT settled").limit(1).count():
            return stored(out, "branches")
        more = counts.where("NOT settled").select("head")
        open_ = open_.join(more, F.slice("way", 1, depth + 1) == F.col("head"), "left_semi")
        depth += 1


def near_words(words: DataFrame, most: int = BRANCH) -> DataFrame:
    """(word, n, near, near_n) for all pairs of distinct words (word, n) exactly one edit apart, both ways round.

    Words hold one row each. Any text is a word, the empty one included; nulls have no near words.
    """
    def ways(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([vector(w) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))],
                                             names=["word", "n", "way"])

    rows = stored(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")).mapInArrow(ways, "word string, n long, way array<int>"), "ways")
    cut = branches(rows, most)
    depths = sorted(r[0] for r in cut.select("depth").distinct().collect())  # 13 at most

    def sought(batches: Iterator[pa.RecordBatch]):
        for batch in (part.slice(i, 2_000) for part in batches for i in range(0, part.num_rows, 2_000)):
            heads = [[h for d in depths for h in around(tuple(way), d)] for way in batch.column(2).to_pylist()]
            each = pa.array([i for i, own in enumerate(heads) for _ in own], pa.int32())
            flat = [h for own in heads for h in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name_of(h) for h in flat], pa.string()), pa.array([h[0] for h in flat], pa.int32()), batch.column(0).take(each), batch.column(1).take(each)],
                names=["branch", "length", "word", "n"])

    upper = [F.array_join(F.transform(F.slice("way", 1, d + 1), lambda x: x.cast("string")), ".") for d in depths]
    own = rows.select(F.explode(F.array(*upper) if upper else F.array().cast("array<string>")).alias("branch"), F.length("word").alias("length"), "word", "n")
    asked = rows.mapInArrow(sought, "branch string, length int, word string, n long")
    both = own.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1))).join(cut.drop("depth"), "branch")
    half = F.expr("length div 2")
    parts = F.when(F.col("divided"), F.array(F.concat(F.lit("h"), F.left("word", half)), F.concat(F.lit("t"), F.right("word", F.col("length") - half)))).otherwise(
        F.array(F.lit("")))
    dealt = both.withColumn("part", F.explode(parts)).select("branch", "part", "kind", "word", "n").repartition("branch", "part").sortWithinPartitions("branch", "part", "kind")

    def found(batches: Iterator[pa.RecordBatch]):
        name, trie = None, Trie()
        names = ["word", "n", "near", "near_n"]
        schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
        for batch in batches:
            out: list[tuple] = []
            for branch, part, kind, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (branch, part) != name:
                    name, trie = (branch, part), Trie()
                if kind == 0:
                    trie.add(word, n)
                    continue
                for near, near_n in trie.near(word, part[:1]):
                    out.append((word, n, near, near_n))
                    if len(near) > len(word):
                        out.append((near, near_n, word, n))
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], names=names)

    return dealt.mapInArrow(found, "word string, n long, near string, near_n long")


def rooted(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form): from each word along the forms to the last, by doubling the steps in each round."""
    cur = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = cur.select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        nxt = stored(cur.join(further, F.col("root") == F.col("__at"), "left").select(
            "word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")), "roots")
        cur = nxt.drop("__moved")
        if not nxt.where("__moved").limit(1).count():
            return cur


def variants(words: DataFrame, ratio: int = 5, most: int = BRANCH) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct words (word, n).

    The form is the near word of largest n, ties to the smallest in code-point order, if it has at least ``ratio`` times the word's n; the
    root is the last word along the forms, which ends because n grows at every step (``ratio`` above 1). An empty table gives no rows.
    """
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words, most).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word"))).alias("best"))
    rows = words.join(near, "word", "left")
    formed = -F.col("best.less") >= ratio * F.col("n")
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best.word")).alias("form"),
                              F.when(formed, -F.col("best.less")).alias("form_n")), "forms")
    roots = rooted(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _sql() -> str:
    marks = ", -1" * 8
    crc = (f"xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(s, ''), lambda ch: CASE WHEN unicode(ch) < 128 "
           f"THEN [unicode(ch){marks}] ELSE [192 + unicode(ch) // 64{marks}, 128 + unicode(ch) % 64{marks}] END))), "
           "lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c // 2, 3988292384 * (c % 2)) END), 4294967295)")
    return f"""
WITH RECURSIVE found AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
once AS (SELECT id, run, count(*) AS c, id || ':' || run AS s FROM found GROUP BY id, run),
sums AS (SELECT run, c, {crc} AS h FROM once),
spelt AS (SELECT CASE WHEN h % {SLIP} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM sums),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (SELECT word, word AS root, form AS nxt FROM formed UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.nxt = f.word)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN chain c ON f.word = c.word WHERE c.nxt IS NULL"""


@query("op12_spelling_variants", _sql())
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of six letters or more and five occurrences or more, with their near words, forms and roots."""
    words = counted(table(spark, folder, "documents")).where((F.length("word") >= 6) & (F.col("n") >= 5))
    return variants(words)
