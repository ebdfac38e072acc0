"""Collapse of cumulative conversation snapshots, then rendering; DataFrame operations only.

A logged conversation that is a prefix of a longer one says nothing new. A rolling hash over the turns gives every prefix a name, so one
anti-join of whole conversations against the proper prefixes of all keeps the maximal ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veil.llm.common import query, stored, table

#: The form of a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conv_id: (conv_id, turns, prefix), turns in order of (turn, role, text), nulls first.

    prefix[i] is the rolling hash of the first i + 1 turns. A null role or text differs from an empty one; repeated rows are repeated turns;
    rows with a null conv_id form one conversation.
    """
    rows = turns.select("conv_id", F.struct("turn", "role", "text").alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    start = F.struct(F.lit(0).cast("long").alias("h"), F.array().cast("array<bigint>").alias("all"))

    def step(acc: Column, t: Column) -> Column:
        marks = F.concat(t["role"].isNull().cast("string"), t["text"].isNull().cast("string"))
        h = F.xxhash64(acc["h"], marks, t["role"], t["text"])
        return F.struct(h.alias("h"), F.array_append(acc["all"], h).alias("all"))

    return whole.select("conv_id", "turns", F.aggregate("turns", start, step, lambda acc: acc["all"]).alias("prefix"))


def maximal(turns: DataFrame) -> DataFrame:
    """Conversations that no longer one begins with: (conv_id, turns, copies); of equal ones the smallest conv_id stays, null last.

    ``copies`` counts the equal ones. An empty table gives no rows.
    """
    convs = stored(conversations(turns), "conversations")
    name = convs.select("conv_id", F.size("prefix").alias("n"), F.element_at("prefix", -1).alias("name"))
    order = F.struct(F.col("conv_id").isNull().alias("none"), F.col("conv_id").alias("id"))
    one = name.groupBy("name", "n").agg(F.min(order).alias("first"), F.count("*").alias("copies"))
    proper = convs.select(F.posexplode(F.slice("prefix", F.lit(1), F.size("prefix") - 1)).alias("i", "name")).select("name", (F.col("i") + 1).alias("n")).distinct()
    kept = one.join(proper, ["name", "n"], "left_anti").select(F.col("first")["id"].alias("kept"), "copies")
    return convs.join(kept, convs["conv_id"].eqNullSafe(kept["kept"])).select("conv_id", "turns", "copies")


def rendered(turns: Column) -> Column:
    """Chat text of an array of turns; a null role or text is empty."""
    one = F.transform(turns, lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE)))
    return F.array_join(one, "")


_SQL = """
WITH t AS (SELECT conv_id, turn, role, text, concat(role IS NULL, '|', text IS NULL, '|', length(coalesce(role, '')), '|', length(coalesce(text, '')), '|', role, text) AS mark FROM conversations),
c AS (SELECT conv_id, list(mark ORDER BY turn, role, text) AS marks,
      string_agg(concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10)), '' ORDER BY turn, role, text) AS rendered, count(*) AS n_turns FROM t GROUP BY conv_id),
e AS (SELECT *, count(*) OVER (PARTITION BY marks) AS copies, row_number() OVER (PARTITION BY marks ORDER BY conv_id) AS k FROM c),
p AS (SELECT DISTINCT list_slice(marks, 1, i) AS marks FROM c, LATERAL (SELECT unnest(range(1, n_turns)) AS i) r)
SELECT conv_id, n_turns, copies, rendered FROM e WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM p WHERE p.marks = e.marks)
"""


@query("op6_chat_formatting", _SQL)
def op6_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Maximal conversations with their rendered text."""
    found = maximal(table(spark, folder, "conversations"))
    return found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "copies", rendered(F.col("turns")).alias("rendered"))
