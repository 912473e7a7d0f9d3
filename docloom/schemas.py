"""Schemas of the tables that the engine keeps; always explicit, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BBOX = "struct<x1:int,y1:int,x2:int,y2:int>"
SCHEMAS: dict[str, str] = {
    "chunk": "id string, dataset_id string, document_id string, document_name string, content string, embedding array<float>, keywords array<string>, department string, doc_type string, scope string, status string, chunk_no int",
    "layout_element": f"document_id string, ord int, page int, category string, text string, bbox {BBOX}",
    "retrieved_chunk": "query_id long, chunk_id string, content string, document_id string, document_name string, image_id string, similarity double",
    "user": "username string, display_name string, password_hash string, is_admin boolean, dataset_id string, assistant_id string, dataset_bound boolean, profile_json string, created_at timestamp",
    "session": "id string, name string, username string, created_at timestamp",
    "message": "id string, session_id string, role string, content string, chunks_json string, turn long, created_at timestamp",
    "rating": "session_id string, message_id string, username string, positive boolean, rated_at timestamp",
    "pending_document": "id string, submitted_by string, file_name string, content_type string, storage_key string, file_path string, submitted_at timestamp, status string, department string, doc_type string",
    "form_template": "id string, name string, file_name string, uploaded_by string, fields_json string, docx_data binary, created_at timestamp",
    "form_cache": "file_hash string, fields_json string, cached_at timestamp",
    "form_field": "key string, label string, suggested_value string, source string",
    "eval_question": "id int, question string, ground_truth string",
    "eval_result": "id int, answer string, chunk_count int, faithfulness double, relevancy double, error string",
    "job_status": "job_id string, file_name string, state string, message string, queued_at timestamp, finished_at timestamp",
}

DEPARTMENTS = ("HR", "DEV", "TEST", "BA", "FINANCE")
DOC_TYPES = ("policy", "procedure", "guide", "form", "report", "contract")
SCOPES = ("company", "department", "board")
STATUSES = ("in_force", "draft", "expired")
TAG_VALUES = {"department": DEPARTMENTS, "doc_type": DOC_TYPES, "scope": SCOPES, "status": STATUSES}
JOB_STATES = ("pending", "processing", "done", "failed")
CATEGORIES = ("Text", "Title", "SectionHeader", "ListItem", "Table", "Picture", "Caption", "Footnote", "Formula", "PageHeader", "PageFooter", "Unknown")


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with exactly the columns of a schema: absent ones become null (the only schema evolution there is)."""
    schema = T._parse_datatype_string(SCHEMAS[name]) if hasattr(T, "_parse_datatype_string") else T.StructType.fromDDL(SCHEMAS[name])
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
