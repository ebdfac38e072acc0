"""Queries over tables of a test's own: in folders of many files, with large keys, with texts cut short."""

import __spark_entry__ as entry
from veil.plans import derived as G
from veil.sources import html as H


def test_streams_read_tables_in_folders(spark, sf, tmp_path):
    for name in ("conversations", "documents"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in ("w04_redact_stream", "w05_gate_stream"):
        whole, parts = (sorted(map(tuple, entry.queries()[query](spark, folder).collect())) for folder in (sf, str(tmp_path)))
        assert whole and whole == parts


def test_references_without_their_end_are_read_as_in_sql(spark, tmp_path):
    page = ("<html><head><title>a &amp; b &ampx; &amp</title></head><body><article>" + "word " * 50 + "x&amp</article>"
            "<a href=\"/?a=1&copy=2\">go &lt;&amp</a></body></html>")
    pages = spark.createDataFrame([(1, "https://example.com/", page)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    row = entry.queries()["s01_page_snapshot"](spark, str(tmp_path)).first()
    assert row.title == "a & b &ampx; &amp" and row.labels == "go <&amp" and row.text.endswith("x&amp\ngo <&amp")
    assert entry.queries()["s02_page_text_main_first"](spark, str(tmp_path)).first().text == row.text
    # As browsers read it.
    assert H.parse_pages(pages, ["page_id"]).first().title == "a & b &x; &"


def test_words_of_a_line_with_large_keys(spark, tmp_path):
    rows = [(1, 1200000, 1, 1, 1.0), (1, 40, 1, 2, 1.0), (1, 1200040, 1, 1, 2.0)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.text for r in entry.queries()["v03_split_line_by_gaps"](spark, str(tmp_path)).collect()] == ["w1200000 w1200040 w40"]


def test_costly_rows_are_dealt_out_only_where_splits_are_few(spark, sf):
    cores = spark.sparkContext.defaultParallelism
    few = spark.read.parquet(f"{sf}/customer.parquet")
    assert G.spread(few).rdd.getNumPartitions() == 2 * cores
    assert G.spread(few.repartition(5 * cores)).rdd.getNumPartitions() == 5 * cores
