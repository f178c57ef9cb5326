"""The way from question to prompt starts from written tables and looks for references on the pages it needs."""

import pytest

from marginalia.operators import context as X
from marginalia.plans import bindings as B
from marginalia.plans import context_cases as CC
from marginalia.plans import navigation_cases as NC
from marginalia.plans import search_cases as SC
from marginalia.session import scratch_folders


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("answer"))
    rows = [(i, f"Title {i}, with a list and more.\nanother line of page {i}\n" + "words and words " * (i % 5), "en", "ab"[i % 2], 100 + i) for i in range(24)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id bigint, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "Title 9 with a list"), (2, "page 12 and more")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_placed_pages_are_the_pages(spark, folder):
    columns = ["book", "category", "text", "doc_id", "n_chars", "pdf_page", "logical_page"]
    want = B.pages(spark, folder).select(columns)
    assert _rows(B.placed(spark, folder).select(columns)) == _rows(want)
    at = want.where("pdf_page % 5 = 0").select("book", "pdf_page")
    assert _rows(B.placed(spark, folder, at).select(columns)) == _rows(want.where("pdf_page % 5 = 0"))
    some = X.reference_edges(CC._pages(spark, folder, B.placed(spark, folder, at)))
    assert _rows(some) == _rows(X.reference_edges(CC._pages(spark, folder)).where("pdf_page % 5 = 0"))


def test_searches_share_written_tables(spark, folder):
    before = len(scratch_folders())
    SC.structured(spark, folder)
    NC.navigation(spark, folder)
    made = [f.rsplit("/", 1)[-1].rsplit("-", 1)[0] for f in scratch_folders()[before:]]
    assert [made.count(name) for name in ("chunks", "index_terms", "toc")] == [1, 1, 1]


def test_table_search_normalizes_texts_behind_the_shuffle(spark, folder, monkeypatch):
    from marginalia.operators import retrieval as R

    plans, keep = [], R.written
    monkeypatch.setattr(R, "written", lambda df, name: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), keep(df, name))[1])
    docs = B.stored_searchable(spark, folder)
    R.structured_search(docs, B.questions(spark, folder), SC.variants(spark, folder), B.book_weights(spark, folder), B.LATIN_TABLE_TERMS, B.LATIN_MARKERS)
    rated = next(p for name, p in plans if name == "rated")
    shuffled = rated[rated.index("RepartitionByExpression"):]
    assert "regexp_replace" not in shuffled
