"""Reports on corrections count the finished records, with their payload and number."""

import pytest

import __spark_entry__
from marginalia.session import scratch_folders


@pytest.mark.parametrize("name", ["normalization_report", "errata_quality", "correction_eligibility", "correction_totals", "correction_manifest"])
def test_reports_count_the_finished_records(spark, tmp_path, name):
    lines = "\n".join(f"word{i} some more words of line {'x' * (i % 7)}" for i in range(12))
    rows = [(i, lines, "en", "ab"[i % 2], len(lines)) for i in range(8)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    before = len(scratch_folders())
    report = __spark_entry__.queries()[name](spark, str(tmp_path))
    made = [f for f in scratch_folders()[before:] if "/records-" in f]
    assert len(made) == 1
    finished = spark.read.parquet(made[0])
    assert {"target_page", "location", "before", "after", "raw_text", "extract_method", "append_text", "delete_text", "note"} <= set(finished.columns)
    if name == "normalization_report":
        assert sum(r.record_count for r in report.collect()) == finished.count() > 0
