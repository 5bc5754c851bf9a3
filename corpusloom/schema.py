"""Schemas of the stages."""

from __future__ import annotations

from pyspark.sql.types import StructType

REPLY = "subjectivity string, polarity string, confidence double, domain string, narrative_voice string, sentiment_target string, rationale string"
DOCUMENT = "url string, text string, meta map<string, string>"
RECORD = "id string, raw_text string, cleaned_text string, source_url string, source_name string, scrape_timestamp string, lid_label string, lid_confidence double, category string"
ENRICHED = f"{RECORD}, register string, license_class string, script string, text_type string"
LID = f"{ENRICHED}, lid_model_label string, lid_model_confidence double, lid_verdict string"
RUN_CONFIG = "struct<repo_id: string, revision: string, quantization: string, prompt_file: string, seed: bigint, max_model_len: bigint>"
SHARD = f"id string, model string, prompt_variant string, run_config {RUN_CONFIG}, {REPLY}, parse_failed boolean, raw_response string, prompt_tokens bigint"
SIDECAR = "repo_id string, revision string, quantization string, prompt_file string, prompt_file_sha256 string, date string, hardware string, max_model_len bigint, max_num_seqs bigint, seed bigint, enable_prefix_caching boolean, guided_decoding boolean, total_generation_seconds double"


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
