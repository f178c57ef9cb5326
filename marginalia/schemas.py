"""Declared schemas of the JSON inputs; nothing is inferred."""

RAW_PAGE = "book STRING, page STRING, text STRING"

PAGE_MAP = (
    "book STRING, status STRING, reason STRING, `offset` INT, detection_source STRING, "
    "statistics STRUCT<match_count: INT, candidate_page_count: INT, match_ratio: DOUBLE, longest_consecutive_run: INT>, "
    "mappings ARRAY<STRUCT<pdf_page: STRING, logical_page: STRING, source: STRING>>"
)

NAVIGATION = (
    "book STRING, status STRING, reason STRING, "
    "toc ARRAY<STRUCT<title: STRING, logical_page: INT, pdf_page: INT, level: INT, source_toc_pages: ARRAY<INT>>>, "
    "`index` ARRAY<STRUCT<term: STRING, index_type: STRING, logical_pages: ARRAY<INT>, pdf_pages: ARRAY<INT>, "
    "source_index_pages: ARRAY<INT>, candidate_index_types: ARRAY<STRING>>>, "
    "errors ARRAY<STRUCT<kind: STRING, pdf_page: INT, error_type: STRING, error: STRING>>"
)

CORRECTION_ROW = (
    "id STRING, text STRING, metadata STRUCT<chunk_id: STRING, source_class: STRING, source_type: STRING, "
    "official: BOOLEAN, authority_priority: INT, source_id: STRING, source_name: STRING, source_key: STRING, "
    "source_url: STRING, record_index: INT, target_page: STRING, location: STRING, operation: STRING, "
    "before: STRING, after: STRING, append_instruction: STRING, append_text: STRING, append_location: STRING, "
    "delete_instruction: STRING, delete_text: STRING, delete_location: STRING, note: STRING, "
    "recovery_method: STRING, parse_status: STRING, extract_method: STRING, source_pdf_pages: ARRAY<INT>, "
    "rag_eligible: BOOLEAN, override_candidate: BOOLEAN, supplement_candidate: BOOLEAN>"
)

MANIFEST = (
    "version INT, source STRUCT<id: STRING, name: STRING, index_url: STRING>, documents ARRAY<STRUCT<source_id: STRING, "
    "url: STRING, requested_url: STRING, discovered_from: STRING, depth: INT, content_type: STRING, status_code: INT, "
    "sha256: STRING, size_bytes: BIGINT, etag: STRING, last_modified: STRING, retrieved_at: TIMESTAMP, local_path: STRING>>"
)
