"""Merkle manifest of a dataset: a tree per source in runs of 16, a root over the sources, and tampered leaves as versions of the tree.

Leaves are numbered per source by one range sort, so that no source, however large, has to pass through one task. Aligned blocks of
4,096 nodes (three levels of a tree) are built by one task each; their roots are the nodes of the next tier, which is blocks again. A tree
in a block is persistent: a changed leaf makes a version that copies the leaf's ancestors and shares every other node. A version goes on
above its block along the siblings that the upper tiers send down, a few digests a level and one row a block, so that versions meet no
upper node that they do not change and stay spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veil.llm.common import query, stored, table

#: Nodes of a run, levels of a tree in a block, and the nodes of a block.
RUN, LEVELS = 16, 3
BLOCK = RUN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<at:int,others:string>>"
NODE = "key string, at bigint, total bigint, digest string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Node:
    """A node of a persistent tree: never changed, shared by all versions that do not differ below it."""

    __slots__ = ("digest", "children")

    def __init__(self, digest_: str, children: tuple["Node", ...] = ()):
        self.digest, self.children = digest_, children

    @classmethod
    def over(cls, children: tuple["Node", ...]) -> "Node":
        return cls(digest("".join(c.digest for c in children)), children)


def grown(digests: list[str], whole: bool) -> list[list[Node]]:
    """Levels of the tree over a block's nodes: up to one node; always three levels where the block is one of several of its key."""
    levels = [[Node(d) for d in digests]]
    while len(levels[-1]) > 1 or (not whole and len(levels) <= LEVELS):
        below = levels[-1]
        levels.append([Node.over(tuple(below[i:i + RUN])) for i in range(0, len(below), RUN)])
    return levels


def copied(node: Node, way: list[int], leaf: str) -> list[Node]:
    """The version of a tree in which the leaf at the end of ``way`` has another digest: its new nodes, root first. All else is shared."""
    if not way:
        return [Node(leaf)]
    new = copied(node.children[way[0]], way[1:], leaf)
    return [Node.over((*node.children[:way[0]], new[0], *node.children[way[0] + 1:])), *new]


def steps(levels: list[list[Node]]) -> list[list[tuple[int, str]]]:
    """Of every node of each level but the last: its place in its run, and the digests of the run's others, joined."""
    out = []
    for nodes in levels[:-1]:
        row = []
        for i in range(0, len(nodes), RUN):
            own = [n.digest for n in nodes[i:i + RUN]]
            row += [(j, "".join(own[:j] + own[j + 1:])) for j in range(len(own))]
        out.append(row)
    return out


def continued(leaf: str, path: list[tuple[int, str]]) -> list[str]:
    """Digests of the ancestors that a changed node gets along its path upward."""
    out = []
    for at, others in path:
        leaf = digest(others[:64 * at] + leaf + others[64 * at:])
        out.append(leaf)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Runs of rows of one (key, block) of a sorted partition, as lists of dicts; holds one block at a time."""
    held, name = [], None
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["key"], row["at"] // BLOCK)
            if own != name and held:
                yield held
                held = []
            name = own
            held.append(row)
    if held:
        yield held


def _grouped(rows: DataFrame) -> DataFrame:
    block = F.floor(F.col("at") / BLOCK)
    return rows.withColumn("__block", block).repartition("key", "__block").sortWithinPartitions("key", "__block", "kind", "at").drop("__block")


def _emitted(rows: DataFrame, schema: StructType, made: Callable[[list[dict]], Iterator[dict]]) -> DataFrame:
    arrow = to_arrow_schema(schema)

    def run(batches):
        out = []
        for block in _blocks(batches):
            out += made(block)
            if len(out) >= BLOCK:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def reduced(nodes: DataFrame) -> DataFrame:
    """The root of every block as a node of the next tier."""
    def made(block: list[dict]):
        total = block[0]["total"]
        yield {"key": block[0]["key"], "at": block[0]["at"] // BLOCK, "total": -(-total // BLOCK),
               "digest": grown([r["digest"] for r in block], total <= BLOCK)[-1][0].digest}

    rows = nodes.select("key", "at", "total", "digest", F.lit(1).alias("kind"))
    return _emitted(_grouped(rows), StructType.fromDDL(NODE), made)


def descended(nodes: DataFrame, above: DataFrame, manifest: bool) -> DataFrame:
    """Every node with what lies above it: its path of siblings, or (``manifest``) its proof, and the version that its change makes.

    ``nodes`` have key, at, total, digest, payload and, for a manifest, the changed digest (null: none). ``above`` has one row (key, at,
    path, subroot, root) for each block.
    """
    payload = nodes.schema["payload"].dataType
    result = StructType.fromDDL(
        "leaf string, subroot string, root string, proof_sha256 string, folded_root string, copied array<string>" if manifest
        else f"key string, at bigint, path {STEP}, subroot string, root string").add("payload", payload)

    def made(block: list[dict]):
        top, own = block[0], block[1:]
        path = [(s["at"], s["others"]) for s in top["path"]]
        levels = grown([r["digest"] for r in own], own[0]["total"] <= BLOCK)
        beside = steps(levels)
        rest = "".join(o for _, o in path)
        for i, r in enumerate(own):
            mine = [row[i // RUN ** k] for k, row in enumerate(beside)]
            base = {"subroot": top["subroot"], "root": top["root"], "payload": r["payload"]}
            if not manifest:
                yield {**base, "key": r["key"], "at": r["at"], "path": [{"at": a, "others": o} for a, o in [*mine, *path]]}
                continue
            new = None
            if r["changed"] is not None:
                inside = [n.digest for n in copied(levels[-1][0], [a for a, _ in reversed(mine)], r["changed"])][::-1]
                new = inside + continued(inside[-1], path)
            yield {**base, "leaf": r["digest"], "proof_sha256": digest("".join(o for _, o in mine) + rest),
                   "folded_root": new[-1] if new else top["root"], "copied": new}

    wide = nodes.select("key", "at", "total", "digest", "payload", F.col("changed") if manifest else F.lit(None).cast("string").alias("changed"),
                        F.lit(1).alias("kind"))
    upper = above.select("key", (F.col("at") * BLOCK).alias("at"), "path", "subroot", "root", F.lit(0).alias("kind"))
    return _emitted(_grouped(upper.unionByName(wide, allowMissingColumns=True)), result, made)


def ranked(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds at (from 0) and total per ``key`` in order, by one range sort: no key is gathered in one task."""
    rows = stored(rows.orderBy("key", *order).withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)), name)
    runs = rows.groupBy("key", "__part").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    same = Window.partitionBy("key")
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(same.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.withColumn("total", F.sum("__n").over(same))
    return rows.join(runs, ["key", "__part"]).withColumn("at", F.col("__id") - F.col("__first") + F.col("__before")).drop(
        "__id", "__part", "__first", "__n", "__before")


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of those' blocks, and so on until every key has one node (total 1)."""
    out = [nodes, stored(reduced(nodes), "tier")]
    while out[-1].where("total > 1").limit(1).count():
        out.append(stored(reduced(out[-1].where("total > 1")), "tier"))
    return out


def paths(levels: list[DataFrame], finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, at, path, subroot, root) of every block of the first tier. ``finish`` gives the rows (key, path, subroot, root) of whole trees."""
    tops = levels[1].where("total = 1")
    for level in levels[2:]:
        tops = tops.unionByName(level.where("total = 1"))
    whole = stored(finish(tops.select("key", "digest")), "paths").withColumn("at", F.lit(0).cast("long"))
    above = whole
    for level in reversed(levels[1:-1]):
        inner = level.where("total > 1").withColumn("payload", F.lit(0))
        several = inner.select("key").distinct()
        down = descended(inner, above.join(several, "key", "left_semi"), False).drop("payload")
        above = stored(down.unionByName(whole.join(several, "key", "left_anti")), "paths")
    return above


def over_sources(tops: DataFrame) -> DataFrame:
    """The tree over the subroots, in the order of their keys: the path from each of them to the root."""
    rows = stored(ranked(tops.select(F.lit("").alias("key"), F.col("key").alias("payload"), "digest"), ["payload"], "subroots"), "subroots")
    last = lambda t: t.select("key", F.array().cast(STEP).alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    down = descended(rows, paths(tiers(rows), last), False)
    # Here the tree's own root is the root of all; the subroot of a source is its leaf.
    return down.select("at", "path", "root", F.col("payload").alias("key")).join(
        rows.select("at", F.col("digest").alias("subroot")), "at").select("key", "path", "subroot", "root")


def leaf(text: Column | None = None) -> Column:
    """The digest of a row: each field as its UTF-8 byte count, a colon and its value, or ``-`` if null."""
    def part(name: str) -> Column:
        value = text if name == "text" and text is not None else F.col(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in FIELDS]), 256)


def manifest(docs: DataFrame, changed: Column, text: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, copied) for every row of ``docs``.

    Rows for which ``changed`` holds are versions: their text is ``text``, ``folded_root`` is the root that this leaf and the original
    siblings give, and ``copied`` holds the digests that the version does not share, from the leaf up to the root (null for other rows).
    Rows of equal doc_id are ordered by their leaves, so repeated rows are leaves of their own; null ids and null sources come first.
    An empty table gives no rows. Columns beside the five fields are left alone. Works for any type of doc_id.
    """
    # A null source orders before all others, "-" before "=".
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("key"), F.col("doc_id").alias("payload"),
                       leaf().alias("digest"), F.when(changed, leaf(text)).alias("changed"))
    nodes = stored(ranked(stored(rows, "leaves"), ["payload", "digest"], "leaves"), "leaves")
    down = descended(nodes, paths(tiers(nodes), over_sources), True)
    return down.select(F.col("payload").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "copied")


def versions(result: DataFrame) -> DataFrame:
    """The nodes that each version of a manifest holds for itself: (doc_id, level, digest), level 0 the leaf, the last level the root."""
    return result.where("copied IS NOT NULL").select("doc_id", F.posexplode("copied").alias("level", "digest"))


def tamper_rule() -> tuple[Column, Column]:
    """The rows tampered with in the query, and their texts: a fifth by the checksum of the id, A-Z lower-cased."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)), F.translate("text", UPPER, LOWER)


def _crc(text: str) -> str:
    """SQL for the checksum of an ASCII text, a byte at a time: eight shifts follow each byte."""
    marks = f"flatten(list_transform(string_split({text}, ''), lambda ch: [unicode(ch), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {marks}), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) "
            "ELSE xor(c // 2, 3988292384 * (c % 2)) END), 4294967295)")


def _sql(levels: int = 8, upper: int = 3) -> str:
    """SQL with one step a level, good for 16^8 rows a source and 4,096 sources."""
    parts = lambda text: " || ".join(
        f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in [*FIELDS[:-1], text])
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    fold = "sha256(array_to_string(list_concat(m[:pos % 16], [f], m[pos % 16 + 2:]), ''))"
    rest = "array_to_string(list_concat(m[:pos % 16], m[pos % 16 + 2:]), '')"
    sql = [f"""WITH w0 AS (
  SELECT coalesce('=' || source, '-') AS k, doc_id, sha256({parts('text')}) AS leaf,
         CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN sha256({parts(lowered)}) END AS other FROM documents),
n0 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS d FROM w0),
v0 AS (SELECT k, doc_id, leaf, pos, coalesce(other, leaf) AS f, '' AS proof FROM n0)"""]
    for i in range(levels):
        sql.append(f"""g{i} AS (SELECT k, pos // 16 AS pos, array_agg(d ORDER BY pos) AS m, sum(count(*)) OVER (PARTITION BY k) AS total FROM n{i} GROUP BY k, pos // 16),
n{i + 1} AS (SELECT k, pos, CASE WHEN total > 1 THEN sha256(array_to_string(m, '')) ELSE m[1] END AS d FROM g{i}),
v{i + 1} AS (SELECT v.k, doc_id, leaf, v.pos // 16 AS pos, CASE WHEN total > 1 THEN {fold.replace('pos %', 'v.pos %')} ELSE f END AS f,
  CASE WHEN total > 1 THEN proof || {rest.replace('pos %', 'v.pos %')} ELSE proof END AS proof FROM v{i} v JOIN g{i} g ON v.k = g.k AND g.pos = v.pos // 16)""")
    sql.append(f"""s0 AS (SELECT k, d AS subroot, d, row_number() OVER (ORDER BY k) - 1 AS pos FROM n{levels}),
u0 AS (SELECT doc_id, leaf, subroot, s.pos, f, proof FROM v{levels} v JOIN s0 s USING (k))""")
    for i in range(upper):
        sql.append(f"""h{i} AS (SELECT pos // 16 AS pos, array_agg(d ORDER BY pos) AS m, sum(count(*)) OVER () AS total FROM s{i} GROUP BY pos // 16),
s{i + 1} AS (SELECT pos, CASE WHEN total > 1 THEN sha256(array_to_string(m, '')) ELSE m[1] END AS d FROM h{i}),
u{i + 1} AS (SELECT doc_id, leaf, subroot, u.pos // 16 AS pos, CASE WHEN total > 1 THEN {fold.replace('pos %', 'u.pos %')} ELSE f END AS f,
  CASE WHEN total > 1 THEN proof || {rest.replace('pos %', 'u.pos %')} ELSE proof END AS proof FROM u{i} u JOIN h{i} h ON h.pos = u.pos // 16)""")
    return ",\n".join(sql) + f"""
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = d AS verified FROM u{upper}, s{upper}"""


@query("op13_merkle_manifest", _sql())
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, subroot, root, proof and folded root of every document, a fifth of them tampered with."""
    return manifest(table(spark, folder, "documents"), *tamper_rule()).drop("copied").withColumn("verified", F.col("folded_root") == F.col("root"))
