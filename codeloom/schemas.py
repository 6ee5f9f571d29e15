"""Explicit schemas of all tables; nothing is inferred."""

REPOS = "id string, name string, url string, branch string, added_at timestamp"
FILES = "repo_id string, relative_path string, absolute_path string, language string, size long"
FILE_NODES = "repo_id string, file_path string, language string"
FUNCTIONS = "repo_id string, file_path string, name string, class_name string, start_line int, end_line int, signature string, language string, ordinal int"
CLASSES = "repo_id string, file_path string, name string, start_line int, end_line int, language string, ordinal int"
TYPES = CLASSES
IMPORTS = "repo_id string, file_path string, module_path string, symbols array<string>, ordinal int"
CALL_SITES = "repo_id string, file_path string, callee_name string, caller_name string, ordinal int"
CALL_EDGES = "repo_id string, caller_name string, caller_file string, callee_name string, callee_file string, cross_file boolean"
CONTAINS = "repo_id string, file_path string, kind string, name string"
HAS_METHOD = "repo_id string, file_path string, class_name string, method string"
CHUNKS = (
    "repo_id string, file_path string, symbol_name string, base_name string, class_name string, symbol_type string, start_line int, "
    "end_line int, language string, source_text string"
)
EMBEDDINGS = CHUNKS + ", model string, dim int, vector array<float>"
CHECKPOINTS = "repo_id string, processed_files array<string>, last_commit string, updated_at timestamp"
CHANGES = "repo_id string, seq int, status string, path string, old_path string"
TRIGGERS = "repo_id string, ts timestamp"
PROGRESS = "repo_id string, event string, at timestamp, details map<string,string>"
