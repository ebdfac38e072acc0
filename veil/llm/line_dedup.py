"""Removal of later copies of repeated line runs, over all documents, in DataFrame operations only.

The corpus is one sequence of line ids per document. Suffixes are ranked by prefix doubling: the rank by 2^k lines of the suffixes at i
and i + 2^k gives the rank by 2^(k+1) lines. Ranks keep the sorted order (a class starts at the number of smaller suffixes), and only
suffixes that still share their prefix with another go on. A run of lines long enough to count has a prefix of some length l that just
reaches the limit, and its suffixes form one longest-common-prefix interval of depth l: two overlapping blocks of 2^k lines fix it, as in
a range-minimum table, so doubling ends at the limit whatever the length of a run. The first occurrence of each interval stays. Every other
one is a later copy and is followed on against the first occurrence, line by line, to the end of the run that they share, so maximal runs
go whole, with a tail of fewer words than the limit too. A later copy that starts inside another with the same first occurrence needs no
following of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veil.llm.common import meeting, query, stored, table

RANGES = 4096
#: Lines by which a copy is followed at once.
STRETCH = 50
ROW = ["doc_id", "mark"]


def _mark() -> Column:
    return F.xxhash64("text")


def line_ids(docs: DataFrame, min_words: int) -> DataFrame:
    """Non-blank lines: (doc_id, mark, i, id, len, first, last); the ``len`` lines from i are the fewest with ``min_words`` words.

    ``first`` and ``last`` are those lines' places among all lines. Too few words left: len is null. Blanks at the ends of a line do not
    count, words are parted by blanks.
    """
    line = F.trim(F.col("line"))
    lines = docs.where("text IS NOT NULL").select("doc_id", _mark().alias("mark"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.where(line != "").select(
        *ROW, "at", F.xxhash64(line).alias("id"), (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).alias("words"))
    lines = lines.dropDuplicates([*ROW, "at"])
    order = Window.partitionBy(*ROW)
    lines = lines.withColumn("i", F.row_number().over(order.orderBy("at")) - 1).withColumn(
        "before", F.sum("words").over(order.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)))
    lines = lines.withColumn("before", F.coalesce("before", F.lit(0)))
    reach = order.orderBy("before").rangeBetween(0, min_words - 1)
    return lines.withColumn("len", F.count("*").over(reach)).withColumn("last", F.max("at").over(reach)).withColumn(
        "enough", F.sum("words").over(reach) >= min_words).select(
        *ROW, "i", "id", F.when(F.col("enough"), F.col("len").cast("int")).alias("len"), F.col("at").alias("first"), "last")


def first_ranks(lines: DataFrame) -> DataFrame:
    """(id, rank) of the line ids that occur twice or more; rank is the number of such lines with a smaller id."""
    counts = stored(lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").withColumn("range", F.pmod(F.shiftright("id", 52), F.lit(RANGES))), "lines")
    # Signed order of ids is the order of ranges from the sign bit on.
    turned = ((F.col("range") + RANGES // 2) % RANGES).alias("range")
    counts = counts.select("id", "n", turned)
    total = counts.groupBy("range").agg(F.sum("n").alias("n"))  # at most RANGES rows
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select("range", F.coalesce(F.sum("n").over(before.orderBy("range")), F.lit(0)).alias("offset"))
    inner = F.coalesce(F.sum("n").over(before.partitionBy("range").orderBy("id")), F.lit(0))
    return counts.select("id", "range", inner.alias("inner")).join(offset, "range").select("id", (F.col("inner") + F.col("offset")).alias("rank"))


def doubled(state: DataFrame, span: int) -> DataFrame:
    """Ranks by twice ``span`` lines of the suffixes whose prefix of that length occurs again."""
    follow = state.select(*ROW, (F.col("i") - span).alias("i"), F.col("rank").alias("next"))
    pairs = stored(_on_row(state, follow, ["i"]), "pairs")
    classes = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1")
    before = Window.partitionBy("rank").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
    named = classes.select("rank", "next", (F.col("rank") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("to"))
    return pairs.join(meeting(named), ["rank", "next"]).select(*ROW, "i", "len", "first", "last", F.col("to").alias("rank"))


def _on_row(left: DataFrame, right: DataFrame, also: list[str], how: str = "inner") -> DataFrame:
    """Join on the document row, where a null doc_id equals itself."""
    right = right.select(*[F.col(c).alias(f"__{c}") if c in ROW + also else F.col(c) for c in right.columns])
    on = [left["doc_id"].eqNullSafe(right["__doc_id"]), *[left[c] == right[f"__{c}"] for c in ["mark", *also]]]
    return left.join(meeting(right), reduce(lambda a, b: a & b, on), how).drop(*[f"__{c}" for c in ROW + also])


def intervals(docs: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Suffixes in a longest-common-prefix interval that reaches the limit: (doc_id, mark, i, len, first, last, one, two), and the lines that
    occur again: (doc_id, mark, i, first, rank), equal lines having one rank."""
    lines = stored(line_ids(docs, min_words), "lines")
    state = stored(lines.join(meeting(first_ranks(lines)), "id").select(*ROW, "i", "len", "first", "last", "rank"), "ranks")
    again = state.select(*ROW, "i", "first", "rank")
    found, span = [], 1
    while True:
        ready = state.where(f"len >= {span} AND len < {2 * span}")
        tails = state.select(*ROW, F.col("i").alias("tail"), F.col("rank").alias("two"))
        ready = ready.withColumn("tail", F.col("i") + F.col("len") - span).withColumnRenamed("rank", "one")
        found.append(_on_row(ready, tails, ["tail"]).select(*ROW, "i", "len", "first", "last", "one", "two"))
        if not state.where(f"len >= {2 * span}").limit(1).count():
            return reduce(DataFrame.unionByName, found), again
        state, span = stored(doubled(state, span), "ranks"), 2 * span


def followed(ends: DataFrame, lines: DataFrame, step: int) -> DataFrame:
    """Of later copies (doc_id, mark, first, next, head_doc, head_mark, head_next) those whose next lines equal the first occurrence's: how many
    of up to ``step`` lines do (``size``), and the place of the last of them (``last``)."""
    own = ["first", "next", "head_doc", "head_mark", "head_next"]
    ahead = ends.select(*ROW, *own, F.explode(F.sequence(F.lit(0), F.lit(step - 1))).alias("k"))
    mine = _on_row(ahead.withColumn("i", F.col("next") + F.col("k")), lines.select(*ROW, "i", F.col("first").alias("place"), "rank"), ["i"])
    mine = mine.select(F.col("head_doc").alias("doc_id"), F.col("head_mark").alias("mark"), (F.col("head_next") + F.col("k")).alias("i"),
                       F.col("doc_id").alias("own_doc"), F.col("mark").alias("own_mark"), "first", "next", "head_next", "k", "place", F.col("rank").alias("own_rank"))
    both = _on_row(mine, lines.select(*ROW, "i", "rank"), ["i"]).where("rank = own_rank")
    both = both.select(F.col("own_doc").alias("doc_id"), F.col("own_mark").alias("mark"), "first", "next", F.col("doc_id").alias("head_doc"),
                       F.col("mark").alias("head_mark"), "head_next", "k", "place")
    each = both.groupBy(*ROW, *own).agg(F.array_sort(F.collect_list(F.struct("k", "place"))).alias("equal"))
    unbroken = F.filter("equal", lambda e, at: e["k"] == at)
    return each.select(*ROW, *own, F.size(unbroken).alias("size"), F.array_max(F.transform(unbroken, lambda e: e["place"])).alias("last")).where("size > 0")


def later_copies(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Line ranges to delete: (doc_id, mark, start, stop), both ends included, disjoint; mark tells rows of one doc_id apart.

    A run counts from ``min_words`` words on and goes as far as it equals the first occurrence. Occurrences are ordered by doc_id (null first),
    then by text hash and place; one that overlaps the first occurrence of its beginning stays.
    """
    rows, lines = intervals(docs, min_words)
    rows = stored(rows, "intervals")
    key = ["len", "one", "two"]
    firsts = rows.groupBy(*key).agg(F.min(F.struct("doc_id", "mark", "i")).alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    head = F.col("head")
    same = head["doc_id"].eqNullSafe(F.col("doc_id")) & (head["mark"] == F.col("mark"))
    later = stored(rows.join(meeting(firsts), key).where(~same | (F.col("i") >= head["i"] + F.col("len"))).select(*ROW, "i", "len", "first", "last", "head"), "later")

    after = Window.partitionBy(*ROW).orderBy("i")
    on = F.lead(F.struct("i", "head")).over(after)
    goes_on = (on["i"] == F.col("i") + 1) & on["head"]["doc_id"].eqNullSafe(head["doc_id"]) & (on["head"]["mark"] == head["mark"]) & (on["head"]["i"] == head["i"] + 1)
    ends = later.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).where("NOT goes_on").select(
        *ROW, "first", (F.col("i") + F.col("len")).alias("next"), head["doc_id"].alias("head_doc"), head["mark"].alias("head_mark"), (head["i"] + F.col("len")).alias("head_next"))
    ranges, step = [later.select(*ROW, "first", "last")], 1
    while True:
        # Most copies end at once, so one line is tried before a stretch of them.
        more = stored(followed(ends, lines, step), "followed")
        ranges.append(more.select(*ROW, "first", "last"))
        ends = more.where(F.col("size") == step).withColumn("next", F.col("next") + step).withColumn("head_next", F.col("head_next") + step).drop("size", "last")
        if not ends.limit(1).count():
            break
        step = STRETCH
    every = reduce(DataFrame.unionByName, ranges)
    order = Window.partitionBy(*ROW).orderBy("first", "last")
    ahead = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(ahead.isNull() | (F.col("first") > ahead + 1), 1).otherwise(0)
    return every.withColumn("apart", apart).withColumn("run", F.sum("apart").over(order)).groupBy(*ROW, "run").agg(
        F.min("first").alias("start"), F.max("last").alias("stop")).drop("run")


def deduplicated(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with later copies of repeated runs cut from ``text``, and ``__deleted``: the number of lines cut.

    Null and empty texts stay as they are; rows with the same doc_id and text are one occurrence and share one fate; all columns are kept.
    """
    cuts = later_copies(docs, min_words).groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__cuts"))
    cuts = cuts.withColumnsRenamed({c: f"__{c}" for c in ROW})
    rows = docs.withColumn("__text_mark", _mark())
    joined = rows.join(meeting(cuts), rows["doc_id"].eqNullSafe(cuts["__doc_id"]) & (rows["__text_mark"] == cuts["__mark"]), "left")
    edges = F.concat(F.array(F.lit(-1)), F.col("__cuts")["stop"]), F.concat(F.col("__cuts")["start"], F.array(F.lit(1 << 30)))
    lines = F.split("text", "\n", -1)
    kept = F.flatten(F.zip_with(*edges, lambda stop, start: F.slice(lines, stop + 2, start - stop - 1)))
    gone = F.aggregate("__cuts", F.lit(0), lambda n, c: n + c["stop"] - c["start"] + 1)
    text = F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text).withColumn("__deleted", F.coalesce(gone, F.lit(0))).drop("__text_mark", "__cuts", "__doc_id", "__mark")


_SQL = """
WITH RECURSIVE pieces AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
lines AS (SELECT *, length(trim(line)) - length(replace(trim(line), ' ', '')) + 1 AS words FROM pieces WHERE trim(line) <> ''),
placed AS (SELECT *, row_number() OVER w AS i, coalesce(sum(words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
runs AS (SELECT doc_id, i, place, count(*) OVER r AS len, max(place) OVER r AS last, sum(words) OVER r AS words, string_agg(trim(line), chr(10)) OVER r AS run
         FROM placed WINDOW r AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
heads AS (SELECT *, first(doc_id) OVER h AS head_doc, first(i) OVER h AS head_i FROM runs WHERE words >= 50
          WINDOW h AS (PARTITION BY run ORDER BY doc_id, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
later AS (SELECT * FROM heads WHERE doc_id <> head_doc OR i >= head_i + len),
tails AS (SELECT doc_id, place, last, i + len AS nxt, head_doc, head_i + len AS head_nxt FROM later
  UNION ALL SELECT t.doc_id, t.place, a.place, t.nxt + 1, t.head_doc, t.head_nxt + 1 FROM tails t JOIN placed a ON a.doc_id = t.doc_id AND a.i = t.nxt
    JOIN placed b ON b.doc_id = t.head_doc AND b.i = t.head_nxt AND trim(b.line) = trim(a.line)),
gone AS (SELECT DISTINCT doc_id, unnest(range(place, last + 1)) AS place FROM (SELECT doc_id, place, max(last) AS last FROM tails GROUP BY doc_id, place)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS text FROM pieces p
         WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.place = p.place) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce((SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id), 0) AS deleted_lines
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@query("op1_line_dedup", _SQL)
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without later copies of line runs of 50 words or more."""
    return deduplicated(table(spark, folder, "documents")).select("doc_id", "text", F.col("__deleted").cast("long").alias("deleted_lines"))
