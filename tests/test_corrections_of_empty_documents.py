"""Correction queries next to their SQL on documents without text, language or length."""

import duckdb
import pytest

import __spark_entry__

ROWS = [
    (1, "Some words of a page.", "en", "a", 21), (2, "", "en", "a", 0), (3, "", "de", "a", 0), (4, None, "fr", "b", None), (5, "", "es", "b", 3),
    (6, "x" * 700, "fr", "b", 700), (7, "A text.", None, "a", 7), (8, "A text.", "en", "b", None), (9, "A text.", "fr", "b", -3), (10, "A text.", None, "b", 8),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, 0.0]) for i in (1, 2, 5)], "vec_id bigint, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


def _same(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = __spark_entry__.queries()[name](spark, folder)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    assert got == sorted(map(repr, want.select(*columns).fetchall()))


@pytest.mark.parametrize("name", ["class_summary", "correction_documents", "index_sample", "sink_index", "split_by_class", "union_corpus", "verify_index"])
def test_empty_documents_do_not_stop_the_corpus(spark, folder, name):
    _same(spark, folder, name)


def test_verdict_of_empty_documents(spark, folder):
    _same(spark, folder, "scan_corrections")
