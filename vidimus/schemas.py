"""The tables of the data model. Times are unix seconds, media times double seconds, JSON columns strings."""

SOURCES = "id string, type string, config string, status string, last_poll_at long, created_at long"
ITEMS = (
    "id string, source_id string, content_type string, external_id string, title string, duration_sec double, raw_path string,"
    " indexed_at long, status string, error string, metadata string, search_index_version int, search_index_status string,"
    " search_index_error string, search_index_unit_count long, search_index_vector_count long, discovered_at long"
)
CHUNKS = "id string, item_id string, chunk_type string, start_sec double, end_sec double, text string, frame_path string, metadata string"
UNITS = (
    "id string, item_id string, unit_index int, unit_kind string, start_sec double, end_sec double, content_text string, transcript_text string,"
    " ocr_text string, visual_text string, summary_text string, representative_chunk_id string, representative_frame_path string,"
    " embedding_profile_id string, index_version int, metadata string, created_at long, updated_at long"
)
VECTORS = "point_key string, unit_id string, item_id string, vector array<float>, profile_id string, index_version int"
PROFILES = "id string, provider_id string, model_id string, model_revision string, output_dimension int, distance_metric string, instruction_template string, index_version int, status string"
UNDERSTANDINGS = "item_id string, provider_id string, model_id string, status string, summary string, result string, error string, created_at long, updated_at long"
JOBS = "id string, item_id string, job_type string, status string, started_at long, finished_at long, error string, progress double, stage string, stage_message string"
USAGE = (
    "id string, created_at long, provider_mode string, capability string, provider_id string, provider_type string, model_id string, item_id string, job_id string,"
    " status string, request_count long, input_tokens long, output_tokens long, audio_seconds double, image_count long, video_seconds double,"
    " estimated_usd double, billed_credits double, price_snapshot_id string, metadata string"
)
MOMENTS = "id string, item_id string, chunk_id string, start_sec double, end_sec double, title string, quote string, note string, created_at long"
IGNORED = "source_id string, external_id string, ignored_at long, reason string, raw_path string"
QUERIES = "query_id string, q string, `limit` int, preference string, query_vector array<float>, locale string"

SEARCH_INDEX_VERSION = 2
MODEL_INDEX_VERSION = 3
