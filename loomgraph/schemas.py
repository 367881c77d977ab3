"""Column contracts of the code-graph tables and the domains of their enumerated columns."""

from __future__ import annotations

FILES = (
    "id string, path string, name string, language string, sha256 string, parse_status string, "
    "parse_error string, size bigint, mtime double, updated_at double"
)
SYMBOLS = (
    "id string, file_id string, parent_id string, kind string, name string, signature string, docstring string, "
    "start_line int, end_line int, source_hash string, is_test boolean, updated_at double"
)
MODULE_LOOKUP = "module_name string, file_id string"
SYMBOL_LOOKUP = "lookup_name string, symbol_id string"
EDGES = "source string, target string, relation string, confidence double, confidence_tier string"
IMPORTS = (
    "file_id string, import_name string, resolved_file_id string, start_line int, end_line int, source string"
)
IMPORT_BINDINGS = (
    "file_id string, import_name string, local_name string, imported_name string, qualified_name string, "
    "binding_kind string, resolved_file_id string, resolved_symbol_id string, resolution_status string, "
    "start_line int, end_line int, source string"
)
EDGE_OCCURRENCES = (
    "occurrence_key binary, source string, target string, relation string, source_file_id string, "
    "enclosing_symbol_id string, name string, start_line int, end_line int, source_text string, "
    "resolution_status string, resolution_strategy string, candidate_targets array<string>"
)
SUMMARIES = "node_id string, source_hash string, summary string, kind string, updated_at double"
LEXICAL_DOCUMENTS = (
    "node_id string, name string, path string, signature string, docstring string, summary string, source string"
)
METADATA = "key string, value string"
_REF = "struct<kind:string,name:string,start_line:int,end_line:int,text:string>"
_SYMBOL = (
    "struct<kind:string,name:string,parent:string,signature:string,docstring:string,start_line:int,end_line:int,"
    f"source:string,source_hash:string,is_test:boolean,refs:array<{_REF}>>"
)
_BINDING = "struct<local:string,imported:string,kind:string>"
_IMPORT = f"struct<name:string,source:string,start_line:int,end_line:int,bindings:array<{_BINDING}>>"
_LITERAL = "struct<name:string,relation:string,line:int>"
#: Parsed files as nested records; also the cache that saves parsing what has not changed.
PARSED_FILES = (
    "path string, language string, sha256 string, size bigint, status string, error string, "
    f"symbols array<{_SYMBOL}>, imports array<{_IMPORT}>, literals array<{_LITERAL}>"
)

#: Index terms by document, in order of term, and the documents' lengths.
POSTINGS = "node_id string, dl double, term string, tf double"
LEXICAL_LENGTHS = "node_id string, dl double"

TABLES = {
    "files": FILES, "symbols": SYMBOLS, "module_lookup": MODULE_LOOKUP, "symbol_lookup": SYMBOL_LOOKUP,
    "edges": EDGES, "imports": IMPORTS, "import_bindings": IMPORT_BINDINGS,
    "edge_occurrences": EDGE_OCCURRENCES, "summaries": SUMMARIES, "lexical_documents": LEXICAL_DOCUMENTS,
    "metadata": METADATA, "parsed_files": PARSED_FILES, "postings": POSTINGS, "lexical_lengths": LEXICAL_LENGTHS,
}

#: The column by which a row belongs to a file: an id that has the path, or the path itself.
OWNERS = {
    "files": "id", "symbols": "id", "module_lookup": "file_id", "symbol_lookup": "symbol_id", "edges": "source",
    "imports": "file_id", "import_bindings": "file_id", "edge_occurrences": "source_file_id", "summaries": "node_id",
    "lexical_documents": "node_id", "parsed_files": "path", "postings": "node_id", "lexical_lengths": "node_id",
}

#: Primary keys, for upserts and integrity checks.
KEYS = {
    "files": ["id"], "symbols": ["id"], "module_lookup": ["module_name", "file_id"],
    "symbol_lookup": ["lookup_name", "symbol_id"], "edges": ["source", "target", "relation"],
    "imports": ["file_id", "import_name", "start_line", "end_line", "source"],
    "import_bindings": ["file_id", "import_name", "local_name", "imported_name", "binding_kind", "start_line", "end_line"],
    "edge_occurrences": ["occurrence_key"], "summaries": ["node_id"], "lexical_documents": ["node_id"],
    "metadata": ["key"],
}

#: (table, column, referenced table): what a snapshot has to satisfy before it is published.
FOREIGN_KEYS = (
    ("symbols", "file_id", "files"), ("symbols", "parent_id", "symbols"), ("module_lookup", "file_id", "files"),
    ("symbol_lookup", "symbol_id", "symbols"), ("imports", "file_id", "files"),
    ("imports", "resolved_file_id", "files"), ("import_bindings", "file_id", "files"),
    ("import_bindings", "resolved_file_id", "files"), ("import_bindings", "resolved_symbol_id", "symbols"),
    ("edge_occurrences", "source_file_id", "files"),
)

TIERS = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
IMPACT_RELATIONS = ("calls", "decorates", "dispatches", "imports", "inherits", "registers", "tested_by")
