"""Queries against their SQL, operators on other tables on small fixtures, and the pipeline against its stages."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from veil.llm import chat, simhash, topk, warc
from veil.llm.common import new_folder

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_warc", "op3_exact_top_k", "op6_chat_formatting"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 40)], 1) for i in range(900)]
    rows += [(1000 + i, [0.5] * 40, 0) for i in range(30)] + [(2000, None, 0), (2020, [float("nan")] * 40, 0), (2040, [None] * 40, 0), (2060, [], 0), (2080, [1e300, 1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    for blocks in (1 << 20, 4000):
        topk.BLOCK_NUMBERS = blocks
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(frame.where("vec_id <> 2080"), k=7).collect()}
        vec = {i: np.floor(64 * np.array((v + [0.0] * 40)[:40])).astype(np.int64) for i, v, _ in rows if i < 2000 or i == 2060}
        for q in (x for x in vec if x % 20 == 0):
            best = sorted(((-int(vec[q] @ v), i) for i, v in vec.items() if i != q))[:7]
            assert [got[q, n + 1] for n in range(7)] == [(i, -s) for s, i in best]
    topk.BLOCK_NUMBERS = 1 << 20
    assert topk.top_k(frame).where("query_id = 2080").count() == 20 and topk.top_k(frame.limit(0)).count() == 0


def test_warc_round_trip(spark):
    pages = [(5, "http://a/ b", "x" * 100), (3, None, "x" * 100), (9, "u", None), (8, "u", ""), (1, "u", "y\r\n\r\nWARC/1.1\r\n"), ((1 << 60) + 1, "u", "é" * 300_000),
             ((1 << 60) + 3, "u", "é" * 300_000), (None, "u", "z")]
    frame = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, archive string")
    place = new_folder(spark, "warc-test")
    index = warc.write_monolithic(frame, place, archive_bytes=1000)
    out = {r.page_id: r for r in warc.read_back(warc.normalised(warc.decided(index), place), place).collect()}
    assert len(out) == len(pages)
    for page, _, html in pages:
        payload = (html or "").encode()
        assert (out[page].payload_bytes, out[page].payload_digest) == (len(payload), warc.digest(payload))
    assert (out[5].record_type, out[5].refers_to, out[3].record_type, out[3].refers_to) == ("revisit", 3, "response", None)
    assert (out[9].record_type, out[9].refers_to, out[(1 << 60) + 3].refers_to) == ("revisit", 8, (1 << 60) + 1)
    long_only = warc.decided(index, least_bytes=101).where("record_type = 'revisit'").count()
    assert long_only == 1
    empty = new_folder(spark, "warc-test")
    assert warc.read_back(warc.normalised(warc.decided(warc.write_monolithic(frame.limit(0), empty)), empty), empty).count() == 0


def test_chat_snapshots(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (4, 0, "user", "a"), (4, 1, "bot", "c"), (5, 0, None, "a"),
             (6, 0, "", "a"), (6, 1, "bot", None), (7, 0, "user", "q"), (7, 0, "user", "q"), (8, 0, "user", "q"), (None, 0, "user", "n")]
    frame = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, prefix int")
    got = {r.conv_id: (len(r.turns), r.copies) for r in chat.maximal(frame).collect()}
    assert got == {1: (2, 2), 4: (2, 1), 5: (1, 1), 6: (2, 1), 7: (2, 1), None: (1, 1)}
    assert chat.maximal(frame.limit(0)).count() == 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == columns, name
    assert 0 < kept.count() < docs.count()
    assert set(r.doc_id for r in entry.queries()["pipeline"](spark, sf).select("doc_id").distinct().collect()) == set(r.doc_id for r in kept.collect())


def test_near_copies_of_the_pipeline_meet_by_fingerprints_first(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = {r.doc_id for r in entry.queries()["op7_simhash_near_dedup"](spark, sf).where("doc_id = component_id").collect()}
    assert {r.doc_id for r in simhash.one_per_print_group(docs).collect()} == first and len(first) < docs.count()
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()} <= first
