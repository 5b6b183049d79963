"""Table schemas, as Spark DDL."""

FILES = "repo_id STRING, path STRING, content STRING, size_bytes BIGINT"
# A landed row replaces older rows of its file; `deleted` takes the file away.
LANDED_FILES = f"{FILES}, version BIGINT, deleted BOOLEAN"
RAW_FILES = "repo_id STRING, path STRING, content BINARY, size_bytes BIGINT"
REPOSITORIES = "repo_id STRING, url STRING, default_branch STRING, commit_sha STRING"
PROJECTS = (
    "project_id STRING, name STRING, created_at TIMESTAMP, status STRING, error_message STRING"
)
ISSUES = (
    "repo_id STRING, number BIGINT, title STRING, body STRING,"
    " labels ARRAY<STRUCT<name: STRING>>, comments INT, html_url STRING,"
    " pull_request STRUCT<url: STRING>"
)
TEST_LOGS = (
    "session_id STRING, attempt BIGINT, command STRING, output STRING,"
    " duration_seconds DOUBLE, timed_out BOOLEAN"
)
SESSION_EVENTS = (
    "session_id STRING, repo_id STRING, issue_number BIGINT, branch_name STRING,"
    " event STRING, changed_files ARRAY<STRING>, ts TIMESTAMP"
)
DIFFS = "session_id STRING, diff STRING"

# Fact tables.
FILE_INVENTORY = (
    "repo_id STRING, path STRING, size_bytes BIGINT, extension STRING, is_important BOOLEAN"
)
TECHNOLOGIES = (
    "repo_id STRING, name STRING, version STRING, source STRING, confidence DOUBLE"
)
DEPENDENCIES = (
    "repo_id STRING, name STRING, version STRING, ecosystem STRING, source STRING"
)
IMPORT_EDGES = (
    "repo_id STRING, from_component STRING, to_component STRING, type STRING,"
    " confidence DOUBLE, inferred BOOLEAN"
)
COLUMN_STRUCT = (
    "STRUCT<name: STRING, data_type: STRING, primary_key: BOOLEAN, foreign_key: STRING,"
    " nullable: BOOLEAN, unique: BOOLEAN, default: STRING>"
)
RELATION_STRUCT = (
    "STRUCT<from_column: STRING, to_table: STRING, to_column: STRING,"
    " relationship_type: STRING, inferred: BOOLEAN>"
)
MODEL_STRUCT = (
    f"STRUCT<name: STRING, columns: ARRAY<{COLUMN_STRUCT}>,"
    f" relationships: ARRAY<{RELATION_STRUCT}>, source_type: STRING, confidence: DOUBLE,"
    " is_table: BOOLEAN>"
)

# One whole-project JSON document.
KNOWLEDGE_DOC = f"""
metadata STRUCT<project_id: STRING, name: STRING, created_at: TIMESTAMP, status: STRING, error_message: STRING>,
repository STRUCT<url: STRING, default_branch: STRING, commit_sha: STRING, clone_path: STRING>,
technologies ARRAY<STRUCT<name: STRING, version: STRING, source: STRING, confidence: DOUBLE>>,
dependencies ARRAY<STRUCT<name: STRING, version: STRING, ecosystem: STRING, source: STRING>>,
files ARRAY<STRUCT<path: STRING, size_bytes: BIGINT, extension: STRING, is_important: BOOLEAN>>,
components ARRAY<STRUCT<name: STRING, path: STRING, type: STRING>>,
relationships ARRAY<STRUCT<from_component: STRING, to_component: STRING, type: STRING, confidence: DOUBLE, inferred: BOOLEAN>>,
database STRUCT<
  tables: ARRAY<STRUCT<name: STRING,
    columns: ARRAY<STRUCT<name: STRING, data_type: STRING, primary_key: BOOLEAN, foreign_key: STRING,
      nullable: BOOLEAN, unique: BOOLEAN, default: STRING, source: STRING>>,
    source: STRING, source_type: STRING, confidence: DOUBLE>>,
  relationships: ARRAY<STRUCT<from_table: STRING, from_column: STRING, to_table: STRING, to_column: STRING,
    relationship_type: STRING, source: STRING, inferred: BOOLEAN>>,
  detected: BOOLEAN>,
_corrupt STRING
"""
