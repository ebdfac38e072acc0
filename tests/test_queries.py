import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
STREAMS = [n for n in entry.queries() if n.endswith("_stream")]
SAMPLE = ["d06_claimed_spans", "d10_classify_field", "r03_redact_text", "l05_verify_payload", "s03_interactive_elements", "v02_merge_passes", "e07_resolve_target", "e03_ids_with_numeric_labels", "r04_register_field_values", "r08_history_trim", "a01_validate_action", "j08_verify_completion", "m09_latency_stats"]


def _same(rows, columns, relation):
    names = [d[0] for d in relation.description]
    assert sorted(names) == sorted(columns)
    order = sorted(columns)

    def norm(v):
        return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    left = sorted(tuple(norm(r[c]) for c in order) for r in rows)
    right = sorted(tuple(norm(r[names.index(c)]) for c in order) for r in relation.fetchall())
    assert left == right


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE + [s for s in STREAMS if s in entry.oracle_sql()])
def test_query_equals_sql(spark, sf, sql, name):
    df = entry.queries()[name](spark, sf)
    _same(df.collect(), df.columns, sql.execute(entry.oracle_sql()[name]))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
