"""Table schemas: explicit, never inferred."""

from __future__ import annotations

SCHEMA_VERSION = 1

FILES = "id long, path string, rel_path string, language string, size_bytes long, mtime_ms long, content_hash string, parse_status string, max_tier string"
SYMBOLS = (
    "id long, file_id long, name string, qualified_name string, kind string, language string, start_line long, start_col long, end_line long, end_col long,"
    " body_start_line long, body_end_line long, nesting_depth long, lines_of_code long, complexity_proxy long, param_count long, parent_symbol_id long"
)
OCCURRENCES = "id long, file_id long, enclosing_symbol_id long, kind string, raw_text string, start_line long, start_col long, end_line long, end_col long"
EDGES = "id long, kind string, from_file_id long, from_symbol_id long, to_symbol_id long, occurrence_id long, raw_text string, confidence string"
CHUNKS = "id long, symbol_id long, parent_chunk_id long, file_id long, kind string, text string, text_hash string, token_count long, start_line long, end_line long, qualified_name string"

#: The vocabulary of kinds.
SYMBOL_KINDS = ["Function", "Method", "Impl", "Struct", "Class", "Enum", "Trait", "Module", "Test"]
CONTAINER_KINDS = ["Class", "Struct", "Module", "Trait", "Impl"]
EDGE_KINDS = ["Call", "Reference", "Import", "Export", "TypeUse", "Inherits", "Implements", "DataFlow", "Contains", "SemanticSimilarity", "Unknown"]
