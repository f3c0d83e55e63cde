"""Queries read every row of their tables; the SQL here leaves none out."""

import os

import pytest

import __spark_entry__ as entry

from .test_entry import SF, duck, rows  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

def equal(spark, duck, name, sql):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_no_query_or_sql_leaves_rows_out():
    import inspect

    from foliolake.plans import catalog, changes

    # Remainders stand for values of columns, never for a choice of rows.
    for sql in entry.oracle_sql().values():
        assert "% 10 = 0" not in sql.replace("CASE WHEN c_custkey % 10 = 0", "") and "% 50 = 0)" not in sql and "conv_id <" not in sql
    for module in (catalog, changes):
        assert "substring(" not in inspect.getsource(module).lower().replace('f.substring("p_name", 1, 3)', "").replace("substring_index(", "").replace('f.substring("picture", k, 4)', "")


def test_turns_are_compared_to_their_ends(spark, tmp_path):
    same = "word " * 100
    spark.createDataFrame([(1, 0, "user", same + "one"), (1, 1, "user", same + "two")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    r = entry.queries()["word_lcs"](spark, str(tmp_path)).first()
    assert r["likeness"] == round(200 / 202, 6) and r["words"] == 102


def test_every_order_is_exported(spark, duck):  # noqa: F811
    equal(spark, duck, "table_csv", "SELECT o_orderstatus, string_agg(CAST(o_orderkey AS VARCHAR) || ',' || o_orderpriority, chr(13) || chr(10) ORDER BY o_orderkey) AS csv FROM orders GROUP BY o_orderstatus")


@pytest.mark.parametrize(
    "name, sql",
    [
        ("merge_renumber", "SELECT conv_id, CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS page_index, role FROM conversations"),
        ("search_ignore_case", "SELECT doc_id, CAST((len(f) - len(replace(f, 'ss', ''))) / 2 AS BIGINT) AS n FROM (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS f FROM documents)"),
        ("bates_label", "SELECT doc_id, 'Page ' || CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR) || ' of ' || CAST(count(*) OVER (PARTITION BY source) AS VARCHAR) AS label FROM documents"),
    ],
)
def test_every_conversation_language_and_source(spark, duck, name, sql):  # noqa: F811
    equal(spark, duck, name, sql)


def test_conversations_of_any_id_are_merged(spark, tmp_path):
    spark.createDataFrame([(c, t, "user", "a") for c in (49, 50, 51, 900) for t in range(2)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = entry.queries()["merge_renumber"](spark, str(tmp_path)).collect()
    assert sorted((r["page_index"], r["conv_id"]) for r in got) == [(2 * i + t, c) for i, c in enumerate((49, 50, 51, 900)) for t in range(2)]
