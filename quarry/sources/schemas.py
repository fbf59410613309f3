"""Declared schemas.  Readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T


def ddl(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


POSITION = "struct<line:int,column:int>"
SPAN = f"struct<start:{POSITION},end:{POSITION}>"

TASK = "id string, preamble string, declaration string, declaration_name string"
PROVIDED = "task_id string, candidate_id string, candidate_text string, expected_category string"
RESULT = (
    "task_id string, candidate_id string, candidate_index int, candidate_text string, category string, lean_exit_code int, diagnostics map<string,string>, "
    "generation_latency_seconds double, verification_latency_seconds double, total_latency_seconds double, generated_token_count int, finish_reason string"
)
RAW = (
    f"file_path string, declaration_name string, declaration_kind string, source_span {SPAN}, declaration_span {SPAN}, proof_span {SPAN}, "
    "declaration string, proof string, premises array<string>, is_private boolean"
)
RECORD = (
    "schema_version string, id string, source_repository string, source_revision string, file_path string, declaration_name string, declaration_kind string, "
    f"source_span {SPAN}, declaration_span {SPAN}, proof_span {SPAN}, declaration string, proof string, completion string, premises array<string>, file_group string, "
    "component_id string, split string, statement_fingerprint string, "
    "token_lengths struct<declaration:bigint,proof:bigint,completion:bigint,declaration_and_proof:bigint,declaration_and_completion:bigint>"
)
VARIANT = (
    "struct<proof_variant_id:string,source_expression:string,canonical_proof:string,completion:string,transformation_kind:string,proof_fingerprint:string,"
    "resolved_dependencies:array<string>,verification:struct<status:string,environment_id:string,method:string,evidence_id:string,diagnostic:string>,"
    "source_declaration_name:string,source_repository:string,source_revision:string,source_file:string>"
)
ENVIRONMENT = (
    "struct<environment_id:string,lean_toolchain:string,repository:string,revision:string,mathlib_revision:string,file_path:string,module:string,imports:array<string>,"
    f"source_span:{SPAN},context_kind:string,target_compatibility:string>"
)
RECORD_V2 = (
    "schema_version string, statement_id string, canonical_declaration string, normalized_statement_fingerprint string, role string, sampling_group_id string, provenance string, "
    f"environment {ENVIRONMENT}, proof_variants array<{VARIANT}>, topic_tags array<string>, memberships array<string>, "
    "length struct<declaration_chars:int,proof_chars:int,completion_chars:int,declaration_lines:int,proof_lines:int,utf8_bytes:int>, derivation_family_fingerprint string, "
    "generator_family string, structural_class string, normalized_proof_dag string, source_lemma_ids array<string>, "
    "source_relation_edges array<struct<src:string,dst:string,relation:string>>, shortcut_retrieval_ids array<string>, "
    "shortcut_retrieval_index array<struct<name:string,origins:string>>, shortcut_checks array<string>"
)
CANDIDATE = (
    "repository string, revision string, file_path string, declaration_name string, declaration string, proof string, transformation_kind string, source_span " + SPAN +
    ", imports array<string>, resolved_dependencies array<string>, verification_status string"
)
NODE = "record_id string, declaration_name string, file_path string, split string, component_id string, statement_fingerprint string, relevance_class string"
EDGE = "type string, source string, target string"
ATLAS_ENTRY = "id string, canonical_name string, display_name string, aliases array<string>, statement string, formalization_status string, topic_tags array<string>, source_ids array<string>"
ATLAS_EDGE = "source string, target string, type string, source_ids array<string>"
EVENT = "type string, thread_id string, item struct<type:string,text:string>, usage map<string,bigint>, timestamp string"
MEMBERSHIP = "record_id string, phase2_split string, phase2_component string, phase2_fingerprint string, file_path string, declaration_name string, relevance_class string"
PROBE = "optimizer_step int, mean_target_token_cross_entropy double"
RUN = "run_id string, schema_version string, model string, candidates_per_task int, generation_settings map<string,string>, verifier_environment map<string,string>, runtime map<string,string>"

#: Enumerations and their orders.
CATEGORIES = ("empty_candidate", "generation_error", "lean_rejected", "verified", "verifier_error", "verifier_timeout")
INFRASTRUCTURE = ("generation_error", "verifier_error")
FINISH_REASONS = ("eos", "token_limit")
SPLITS = ("train", "validation", "heldout")
ROLES = ("training", "validation", "test")
RELEVANCE = ("core", "premise-1", "premise-2", "user-1", "user-2", "source-neighborhood", "number-theory-control")
BUBBLE = RELEVANCE[:6]
EDGE_TYPES = ("premise", "user", "same-source")
