import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from veil.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def folded(nodes):
    """Root of a list of digests, straight from the definition."""
    while len(nodes) > 1:
        nodes = [h("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0]


def proof(nodes, at):
    out = []
    while len(nodes) > 1:
        run = at // 16 * 16
        out += [d for i, d in enumerate(nodes[run:run + 16], run) if i != at]
        nodes, at = [h("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)], at // 16
    return out


def brute(rows, full=lambda i: True):
    """All columns of the query by building a whole tree for every version."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1]))) for s in names}
    leaves = {s: [leaf_of(r, r[1]) for r in own[s]] for s in names}
    subs = [folded(leaves[s]) for s in names]
    root, out = folded(subs), []
    for k, s in enumerate(names):
        for i, r in enumerate(own[s]):
            if not full(i):
                continue
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = r[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            new = root
            if tampered:
                new = folded([*subs[:k], folded([*leaves[s][:i], leaf_of(r, text), *leaves[s][i + 1:]]), *subs[k + 1:]])
            out.append((r[0], leaves[s][i], subs[k], root, h("".join(proof(leaves[s], i) + proof(subs, k))), new))
    return sorted(out, key=str)


def got(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("payload", F.lit("x")).withColumn("at", F.lit(2))
    return merkle.manifest(docs, *merkle.tamper_rule())


def test_every_shape_of_tree_against_brute_force(spark):
    """One leaf, 16, 17, 257 and repeated leaves; null and many sources; null columns, empty and long texts."""
    rows = [(1, "One LEAF", "en", "a", 8)]
    rows += [(i, f"Text {i}" if i % 3 else None, None, "b", i) for i in range(100, 116)]
    rows += [(i, f"Ä {i}" * (i % 4), "de", None, None) for i in range(200, 217)]
    rows += [(i, "X" * (50_000 if i == 300 else 2), "en", "c é", i) for i in range(300, 557)]
    rows += [(700, "same", "en", "d", 4)] * 20 + [(None, "No id", "en", "d", 5), (None, None, None, "d", None)]
    rows += [(1000 + i, f"S {i}", "en", f"s{i}", 1) for i in range(40)]
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")
    assert sorted((tuple(r[c] for c in columns) for r in got(spark, rows).collect()), key=str) == brute(rows)


def test_more_than_one_block_of_a_source(spark):
    rows = [(i, f"T{i}", "en", "hot", i) for i in range(4096 * 2 + 1)] + [(9000 + i, "Z", "en", "other", 1) for i in range(5000)]
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")
    every = [tuple(r[c] for c in columns) for r in got(spark, rows).collect()]
    assert len(every) == len(rows)
    some = brute(rows, lambda i: i % 511 == 0)
    assert set(some) <= set(every)


def test_versions_share_all_but_their_ancestors(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 2}", i) for i in range(600)]
    result = got(spark, rows)
    copied = merkle.versions(result).groupBy("doc_id").agg(F.count("*").alias("n"), F.max_by("digest", "level").alias("top")).collect()
    tampered = [r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sorted(r.doc_id for r in copied) == tampered
    assert {r.n for r in copied} == {1 + 3 + 1}  # a leaf, three levels of a tree of 300 leaves, the root over two sources
    roots = {r.doc_id: r.folded_root for r in result.where("copied is not null").collect()}
    assert all(roots[r.doc_id] == r.top for r in copied)
    base = merkle.Node.over(tuple(merkle.Node.over(tuple(merkle.Node(h(f"{i}{j}")) for j in range(16))) for i in range(16)))
    new = merkle.copied(base, [3, 5], h("changed"))
    assert [x is y for x, y in zip(base.children, new[0].children)] == [i != 3 for i in range(16)]
    assert base.children[3].children[5].digest == h("35")


def test_empty_table_and_text_ids(spark):
    assert got(spark, []).count() == 0
    rows = spark.createDataFrame([("b", "T", "en", "x", 1), ("a", "U", "en", "x", 1), (None, None, None, None, None)],
                                 "doc_id string, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in merkle.manifest(rows, *merkle.tamper_rule()).collect()} == {"a", "b", None}


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4096])
def test_tree_in_a_block(n):
    digests = [h(str(i)) for i in range(n)]
    levels = merkle.grown(digests, True)
    assert levels[-1][0].digest == folded(digests)
    at = n // 2
    mine = [row[at // 16 ** k] for k, row in enumerate(merkle.steps(levels))]
    assert merkle.continued(digests[at], mine)[-1:] == ([folded(digests)] if n > 1 else [])
    assert "".join(o for _, o in mine) == "".join(proof(digests, at))
