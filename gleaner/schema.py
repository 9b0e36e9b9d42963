"""Table layouts."""

from __future__ import annotations

CHUNKS = (
    "chunk_id string, file_id string, file_path string, content string, content_type string, chunk_index int, start_byte long, end_byte long, "
    "start_line int, end_line int, parent_chunk_id string, depth short, embedding array<float>, embedding_model string, indexed_at timestamp, "
    "file_mime_type string, file_size_bytes long, language string, symbol_type string, symbol_name string"
)
FILES = (
    "file_id string, path string, size_bytes long, mime_type string, content_hash string, modified_at timestamp, indexed_at timestamp, "
    "chunk_count int, status string, error_message string"
)
STATUSES = ("pending", "indexing", "indexed", "error", "deleted")
ELEMENT = (
    "struct<kind:string,level:int,text:string,language:string,ordered:boolean,items:array<string>,headers:array<string>,"
    "rows:array<array<string>>,byte_offset:bigint>"
)
HISTORY = "entry_id string, operation string, path string, logged_at timestamp, success boolean, reversible boolean, undo_data string, error_message string"
TRASH = "trash_id string, original_path string, trash_path string, deleted_at timestamp, expires_at timestamp, content_hash string, size_bytes long"
EVENT = "kind string, path string, to_path string, ts timestamp"
