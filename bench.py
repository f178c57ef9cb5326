"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from marginalia.plans import registry  # noqa: E402
from marginalia.session import build_session  # noqa: E402

HEADLINE = (
    "corpus_summary", "join_logical_page", "page_text", "chunk_documents", "page_map_job", "toc_merge", "index_merge",
    "term_containment_join", "vector_search", "lexical_search", "hybrid_search", "context_pack", "citation_numbering",
    "carry_forward_records", "correction_target_pages", "link_graph", "crawl_frontier", "contextual_question", "stream_chat_sources",
    "structured_search", "definition_search", "navigation_search", "fuzzy_ratio_join", "correction_select", "correction_resolve",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    jobs, _ = registry.load()
    spark.read.parquet(f"{sf}/documents.parquet").count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        jobs[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf).name, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
