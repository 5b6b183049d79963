"""DuckDB SQL that states what each registered query must return.

The SQL restates the rule on the given tables, or the truth a text was rendered from. It
never parses a rendered text.
"""

from __future__ import annotations

from fleetfacts import constants as C

ORACLES: dict[str, str] = {}


def words(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# --- documents and pages -------------------------------------------------------------

DOCS = """(
  SELECT source AS repo_id, doc_id, lang, text AS content,
    CASE doc_id % 4 WHEN 0 THEN 'tests/tion/' WHEN 1 THEN 'that_with/' WHEN 2 THEN 'spec/' ELSE 'src/build/' END
      || lang || doc_id || ext AS path,
    CASE ext WHEN '.test.js' THEN '.js' ELSE ext END AS extension
  FROM (SELECT *, CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.tsx' WHEN 2 THEN '.test.js'
          WHEN 3 THEN '' WHEN 4 THEN '.rs' ELSE '.sql' END AS ext FROM documents)
)"""
SEEN_DOCS = f"(SELECT * FROM {DOCS} WHERE doc_id % 4 <> 3)"
PAGES = """(
  SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS repo_id, page_id, length(html) AS size_bytes,
    CASE page_id % 5 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/dist/' ELSE '' END
      || regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) || '/p' || page_id
      || CASE page_id % 7 WHEN 0 THEN '/build' ELSE '.html' END AS path
  FROM pages
)"""

ORACLES["decode_ignore"] = (
    "SELECT source AS repo_id, CAST(doc_id AS VARCHAR) AS path, md5(text) AS digest FROM documents"
)
ORACLES["decode_strict"] = ORACLES["decode_ignore"] + " WHERE doc_id % 4 <> 0"
ORACLES["undecodable_files"] = """
SELECT source AS repo_id, CAST(doc_id AS VARCHAR) AS path, 'content is not valid UTF-8' AS reason
FROM documents WHERE doc_id % 4 = 0"""
ORACLES["read_repo_files"] = f"""
SELECT repo_id, path, CAST(strlen(coalesce(content, '')) AS BIGINT) AS size_bytes,
  sha256(coalesce(content, '')) AS content_sha256
FROM {SEEN_DOCS}"""
ORACLES["exclude_vendored"] = (
    f"SELECT repo_id, path FROM {PAGES} WHERE page_id % 5 > 1 AND page_id % 7 <> 0"
)
ORACLES["exclude_vendored_dirs"] = f"SELECT repo_id, path FROM {PAGES} WHERE page_id % 5 > 1"
ORACLES["file_inventory"] = f"""
SELECT repo_id, path, CAST(strlen(content) AS BIGINT) AS size_bytes, extension, false AS is_important
FROM {SEEN_DOCS}"""
ORACLES["repository_tree"] = (
    ORACLES["file_inventory"] + " WHERE repo_id IN ('src1', 'src4')"
)

# --- scalar functions ----------------------------------------------------------------

ORACLES["parse_requirement"] = """
SELECT p_partkey,
  CASE p_size % 4 WHEN 0 THEN 'My_' || p_brand WHEN 1 THEN 'lib-' || p_size WHEN 2 THEN 'pkg.sub'
    ELSE 'git+https://x/' || p_name END AS name,
  CASE p_size % 4 WHEN 1 THEN '>=1.' || p_size WHEN 2 THEN '~=' || p_size || ' ; python_version > "3"' END AS spec
FROM part"""
ORACLES["version_number"] = """
SELECT event_id, replace(replace(props, '{"k": ', ''), '}', '') AS version FROM events"""
ORACLES["normalise_sql_type"] = "SELECT p_partkey, upper(p_type) AS sql_type FROM part"
ORACLES["repo_slug"] = r"""
SELECT page_id, CASE name WHEN '' THEN 'project' ELSE name END AS slug FROM (
  SELECT page_id, lower(trim(regexp_replace(CASE WHEN page_id % 3 = 0 THEN segment[:-5] ELSE segment END,
      '[^a-zA-Z0-9]+', '-', 'g'), '-')) AS name
  FROM (SELECT page_id, string_split(rtrim(u, '/'), '/')[-1] AS segment
    FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.git' WHEN 1 THEN '/' ELSE '/--' END AS u FROM pages)))"""
ORACLES["owner_repo"] = """
SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN p_type END AS owner,
  CASE WHEN p_partkey % 4 < 3 THEN replace(p_name, ' ', '-') END AS repo
FROM part"""
TITLE_SLUG = "lower(trim(regexp_replace(split_part(text, '.', 1), '[^a-zA-Z0-9]+', '-', 'g'), '-'))"
ORACLES["branch_name"] = f"""
SELECT conv_id * 100 + turn AS number,
  'contrib/' || (conv_id * 100 + turn) || '-' || rtrim(substr({TITLE_SLUG}, 1, 50), '-') AS branch
FROM conversations"""
ORACLES["format_size"] = """
SELECT bytes, CASE WHEN bytes < 1024 THEN bytes || ' B'
    WHEN bytes < 1048576 THEN printf('%.1f KB', floor(CAST(bytes AS DOUBLE) / 1024 * 10 + 0.5) / 10)
    ELSE printf('%.1f MB', floor(CAST(bytes AS DOUBLE) / 1048576 * 10 + 0.5) / 10) END AS size,
  count(*) AS n
FROM (SELECT CAST(floor(CASE l_linenumber % 3 WHEN 0 THEN l_quantity * 20 WHEN 1 THEN l_extendedprice
    ELSE l_extendedprice * 100 END) AS BIGINT) AS bytes FROM lineitem) GROUP BY bytes"""
ORACLES["confidence_band"] = """
SELECT CASE WHEN l_discount * 10 >= 0.9 THEN 'high' WHEN l_discount * 10 >= 0.7 THEN 'medium' ELSE 'low' END AS band,
  count(*) AS n
FROM lineitem GROUP BY 1"""
ORACLES["diff_stat"] = """
SELECT o_orderkey, n || ' file(s) changed, ' || 2 * n || ' insertion(s), ' || n || ' deletion(s)' AS diff_stat
FROM (SELECT o_orderkey, 1 + o_orderkey % 3 AS n FROM orders)"""

# --- manifests -----------------------------------------------------------------------

# k: which manifests a part's repository has; s: the number its texts carry.
PARTS = (
    "(SELECT 'pkg' || p_partkey AS repo_id, p_partkey % 8 AS k, p_size AS s,"
    " lower(p_brand) AS brand, p_partkey, p_name FROM part)"
)
FRAMEWORK = "CASE s % 3 WHEN 0 THEN 'FastAPI' WHEN 1 THEN 'Flask' ELSE 'Django' END"
FRAMEWORK_VERSION = "CASE s % 3 WHEN 0 THEN s || '.2' WHEN 1 THEN CAST(s AS VARCHAR) END"


def _evidence(*facts: tuple[str, str, str, str, str, int]) -> str:
    """UNION ALL of (name, version, source, confidence, condition, order)."""
    return " UNION ALL ".join(
        f"SELECT repo_id, {name} AS name, CAST({version} AS VARCHAR) AS version, {source} AS source,"
        f" CAST({confidence} AS DOUBLE) AS confidence, {seq} AS seq FROM {PARTS} WHERE {when}"
        for name, version, source, confidence, when, seq in facts
    )


EVIDENCE = {
    "npm_evidence": _evidence(
        ("'Node.js'", "NULL", "'package.json'", "0.9", "k IN (0, 1, 5)", 1),
        ("'JavaScript'", "NULL", "'package.json'", "0.8", "k IN (0, 1, 5)", 1),
        ("'React'", "s || '.1.0'", "'package.json'", "1", "k IN (0, 1, 5)", 1),
        ("'TypeScript'", "s", "'package.json'", "1", "k IN (0, 1, 5)", 1),
        ("'Express'", "NULL", "'package.json'", "1", "k IN (0, 1, 5) AND s % 2 = 0", 1),
    ),
    "pyproject_evidence": _evidence(
        ("'Python'", "NULL", "'pyproject.toml'", "1", "k IN (2, 3)", 2),
        (FRAMEWORK, FRAMEWORK_VERSION, "'pyproject.toml'", "1", "k IN (2, 3)", 2),
    ),
    "requirements_evidence": _evidence(
        ("'Python'", "NULL", "'requirements.txt'", "0.9", "k IN (1, 2)", 3),
        (FRAMEWORK, FRAMEWORK_VERSION, "'requirements.txt'", "1", "k IN (1, 2)", 3),
    ),
    "go_evidence": _evidence(("'Go'", "'1.' || s", "'go.mod'", "1", "k IN (3, 4)", 4)),
    "rust_evidence": _evidence(("'Rust'", "NULL", "'Cargo.toml'", "1", "k IN (4, 5)", 5)),
    "docker_evidence": _evidence(
        ("'Docker'", "NULL", "'Dockerfile'", "1", "k IN (5, 6)", 6),
        ("'Python'", "NULL", "'Dockerfile'", "0.9", "k IN (5, 6) AND s % 2 = 0", 6),
        ("'Node.js'", "NULL", "'Dockerfile'", "0.9", "k IN (5, 6) AND s % 2 = 1", 6),
    ),
    "workflow_evidence": _evidence(
        ("'GitHub Actions'", "NULL", "'.github/workflows/a' || s || '.yml'", "1", "k = 6", 7)
    ),
    "extension_evidence": _evidence(
        ("'TypeScript'", "NULL", "'file_extension'", "0.7", "s % 5 = 1", 8),
        ("'Rust'", "NULL", "'file_extension'", "0.7", "s % 5 = 2", 8),
    ),
}
for _name, _sql in EVIDENCE.items():
    ORACLES[_name] = f"SELECT repo_id, name, version, source, confidence FROM ({_sql})"
ALL_EVIDENCE = "(" + " UNION ALL ".join(EVIDENCE.values()) + ")"


def _merged(evidence: str) -> str:
    return f"""
SELECT repo_id, name, version, source, confidence FROM {evidence}
QUALIFY row_number() OVER (PARTITION BY repo_id, name
  ORDER BY confidence DESC, (version IS NOT NULL) DESC, seq) = 1"""


TECHNOLOGIES = _merged(ALL_EVIDENCE)
ORACLES["detect_technologies"] = TECHNOLOGIES
LINEITEM_EVIDENCE = """(
  SELECT 's' || l_suppkey AS repo_id, l_returnflag || l_linestatus AS name,
    CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_orderkey % 50 AS VARCHAR) END AS version,
    'o' || l_orderkey AS source, (l_orderkey % 7 + l_linenumber) / 20 AS confidence,
    l_orderkey * 10 + l_linenumber AS seq
  FROM lineitem)"""
ORACLES["merge_evidence"] = _merged(LINEITEM_EVIDENCE)
ORACLES["unique_technologies"] = f"""
SELECT repo_id, name, version, source, confidence FROM {LINEITEM_EVIDENCE}
QUALIFY row_number() OVER (PARTITION BY repo_id, name ORDER BY seq DESC) = 1"""


def _dependencies(*facts: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT repo_id, {name} AS name, CAST({version} AS VARCHAR) AS version FROM {PARTS} WHERE {when}"
        for name, version, when in facts
    )


REQUIREMENT = "CASE s % 3 WHEN 0 THEN 'fastapi' WHEN 1 THEN 'flask-login' ELSE 'django' END"
REQUIREMENT_SPEC = "CASE s % 3 WHEN 0 THEN '==' || s || '.2' WHEN 1 THEN '>=' || s END"
DEPENDENCIES = {
    ("npm", "package.json"): _dependencies(
        ("'react'", "'^' || s || '.1.0'", "k IN (0, 1, 5)"),
        ("brand", "'~1.' || s", "k IN (0, 1, 5)"),
        ("'express'", "NULL", "k IN (0, 1, 5) AND s % 2 = 0"),
        ("'typescript'", "'>=' || s", "k IN (0, 1, 5)"),
        ("'react'", "'*'", "k IN (0, 1, 5)"),
    ),
    ("pypi", "requirements.txt"): _dependencies(
        (REQUIREMENT, REQUIREMENT_SPEC, "k IN (1, 2)"),
        ("'lib-' || s", "'>=1.' || s", "k IN (1, 2)"),
        ("'pytest'", "NULL", "k IN (1, 2) AND s % 5 = 0"),
    ),
    ("pypi", "pyproject.toml"): _dependencies(
        (REQUIREMENT, REQUIREMENT_SPEC, "k IN (2, 3)"), ("'tool-' || s", "NULL", "k IN (2, 3)")
    ),
    ("go", "go.mod"): _dependencies(
        ("'mod/a' || s", "'v1.' || s || '.0'", "k IN (3, 4)"),
        ("'mod/single'", "'v' || s", "k IN (3, 4)"),
    ),
    ("cargo", "Cargo.toml"): _dependencies(
        ("'serde'", "'1.' || s", "k IN (4, 5)"),
        ("'tokio'", "s", "k IN (4, 5)"),
        ("'local'", "NULL", "k IN (4, 5)"),
    ),
}
_tagged = [
    f"SELECT repo_id, name, version, '{eco}' AS ecosystem, '{source}' AS source FROM ({sql})"
    for (eco, source), sql in DEPENDENCIES.items()
]
for _name, _sql in zip(["npm", "requirements", "pyproject", "go", "cargo"], _tagged):
    ORACLES[f"{_name}_dependencies"] = _sql
ALL_DEPENDENCIES = " UNION ALL ".join(_tagged)
ORACLES["extract_dependencies"] = ALL_DEPENDENCIES
ORACLES["dependencies_by_ecosystem"] = f"""
SELECT repo_id, ecosystem, count(*) AS dependency_count,
  string_agg(name || ' ' || coalesce(version, '-'), '|' ORDER BY name, version NULLS FIRST) AS dependencies
FROM ({ALL_DEPENDENCIES}) GROUP BY repo_id, ecosystem"""
LINEITEM_DEPENDENCIES = """(
  SELECT 's' || l_suppkey AS repo_id, p_brand AS name, l_returnflag AS ecosystem,
    CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS version
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
ORACLES["fleet_dependency_versions"] = f"""
SELECT ecosystem, name, count(DISTINCT repo_id) AS repo_count, count(DISTINCT version) AS version_count,
  min(version) AS min_version, max(version) AS max_version
FROM {LINEITEM_DEPENDENCIES} GROUP BY ecosystem, name"""
ORACLES["dependency_version_usage"] = f"""
SELECT ecosystem, name, version, count(DISTINCT repo_id) AS repo_count
FROM {LINEITEM_DEPENDENCIES} GROUP BY ecosystem, name, version"""

MANIFEST_FILES = " UNION ALL ".join(
    f"SELECT repo_id, {path} AS path, '{ext}' AS extension, {important} AS important FROM {PARTS} WHERE {when}"
    for path, ext, important, when in [
        ("'package.json'", ".json", "true", "k IN (0, 1, 5, 7)"),
        ("'requirements.txt'", ".txt", "true", "k IN (1, 2)"),
        ("'pyproject.toml'", ".toml", "true", "k IN (2, 3, 6)"),
        ("'go.mod'", ".mod", "true", "k IN (3, 4)"),
        ("'Cargo.toml'", ".toml", "true", "k IN (4, 5)"),
        ("'Dockerfile'", "", "true", "k IN (5, 6)"),
        ("'.github/workflows/b.yml'", ".yml", "true", "k = 6"),
        ("'.github/workflows/a' || s || '.yml'", ".yml", "true", "k = 6"),
        ("'src/main.tsx'", ".tsx", "false", "s % 5 = 1"),
        ("'src/main.rs'", ".rs", "false", "s % 5 = 2"),
        ("'docs/package.json'", ".json", "true", "true"),
    ]
)
ORACLES["important_files"] = (
    f"SELECT repo_id, path, extension FROM ({MANIFEST_FILES}) WHERE important"
)

# --- imports -------------------------------------------------------------------------

LINES = """(
  SELECT 'repo' || (l_partkey % 20) AS repo_id, l_partkey AS p, l_suppkey AS s,
    l_partkey % 20 = l_suppkey % 20 AS same_repo,
    'o' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS stem
  FROM lineitem)"""
ORACLES["python_imports"] = f"""
SELECT repo_id, 'app/' || stem || '.py' AS path,
  unnest(['os,', 'svc.s_' || s, 'lib.p_' || p, '.lib.p_2']) AS module
FROM {LINES}"""
ORACLES["ts_imports"] = f"""
SELECT repo_id, 'web/' || stem || '.ts' AS path,
  unnest(['../lib/p_' || p, './../svc/x/../s_' || s, '../../lib/p_1', 'react']) AS target
FROM {LINES}"""
PY_EDGES = f"""
SELECT repo_id, 'app/' || stem || '.py' AS from_component,
  CASE p % 3 WHEN 0 THEN 'lib/p_' || p || '.py' WHEN 1 THEN 'src/lib/p_' || p || '.py'
    ELSE 'lib/p_' || p || '/__init__.py' END AS to_component
FROM {LINES} JOIN part ON p_partkey = p
UNION ALL
SELECT repo_id, 'app/' || stem || '.py', 'src/svc/s_' || s || '/__init__.py'
FROM {LINES} JOIN supplier ON s_suppkey = s WHERE same_repo"""
TS_EDGES = f"""
SELECT repo_id, 'web/' || stem || '.ts' AS from_component,
  'lib/p_' || p || CASE p % 2 WHEN 0 THEN '.tsx' ELSE '/index.js' END AS to_component
FROM {LINES} JOIN part ON p_partkey = p
UNION ALL
SELECT repo_id, 'web/' || stem || '.ts', 'svc/s_' || s || '.jsx'
FROM {LINES} JOIN supplier ON s_suppkey = s WHERE same_repo"""
ORACLES["resolve_python_imports"] = PY_EDGES
ORACLES["resolve_ts_imports"] = TS_EDGES
EDGES = f"({PY_EDGES} UNION ALL {TS_EDGES})"
ORACLES["import_edges"] = f"""
SELECT repo_id, from_component, to_component, 'imports' AS type, CAST(0.6 AS DOUBLE) AS confidence, true AS inferred
FROM {EDGES}"""
ORACLES["graph_nodes"] = f"""
SELECT repo_id, path, string_split(path, '/')[-1] AS name, 'unknown' AS type FROM (
  SELECT repo_id, from_component AS path FROM {EDGES} UNION SELECT repo_id, to_component FROM {EDGES})"""
ORACLES["architecture"] = f"""
SELECT repo_id, from_component AS "from", to_component AS "to", 'imports' AS type, true AS inferred,
  CAST(0.6 AS DOUBLE) AS confidence
FROM {EDGES} WHERE repo_id IN ('repo3', 'repo7')"""

# --- database schemas ----------------------------------------------------------------

KINDS = ["sql", "sqlalchemy", "django", "prisma"]
DECLARED = """(
  SELECT 'repo' || (o_custkey % 20) AS repo_id, 't' || o_custkey AS name, 't' || (o_custkey + 1) AS owner,
    o_orderstatus AS st, o_orderpriority IN ('1-URGENT', '2-HIGH') AS required,
    o_orderpriority = '3-MEDIUM' AS uniq, o_orderkey % 3 = 0 AS owned, o_orderkey % 8 = 0 AS table_level,
    ['sql', 'sqlalchemy', 'django', 'prisma'][1 + o_orderkey % 4] AS source_type,
    CASE o_orderkey % 4 WHEN 0 THEN 'db/o' || o_orderkey || '.sql' WHEN 1 THEN 'app/o' || o_orderkey || '.py'
      WHEN 2 THEN 'dj/o' || o_orderkey || '.py' ELSE 'p/o' || o_orderkey || '/schema.prisma' END AS source,
    CAST(CASE WHEN o_orderkey % 4 IN (0, 3) THEN 1.0 ELSE 0.9 END AS DOUBLE) AS confidence
  FROM orders)"""
COLUMNS = f"""(
  SELECT repo_id, source, source_type, name AS table_name, 0 AS ordinal, 'id' AS name, 'INTEGER' AS data_type,
    true AS primary_key, CAST(NULL AS VARCHAR) AS foreign_key, false AS nullable, false AS "unique",
    CASE source_type WHEN 'prisma' THEN 'autoincrement(' END AS "default"
  FROM {DECLARED}
  UNION ALL
  SELECT repo_id, source, source_type, name, 1, 'amount',
    CASE st WHEN 'O' THEN 'INTEGER' WHEN 'F' THEN CASE source_type WHEN 'sqlalchemy' THEN 'NUMERIC' ELSE 'DECIMAL' END
      ELSE CASE source_type WHEN 'sqlalchemy' THEN 'STRING' ELSE 'VARCHAR' END END,
    false, NULL, NOT required, uniq, CASE WHEN source_type <> 'django' THEN '0' END
  FROM {DECLARED}
  UNION ALL
  SELECT repo_id, source, source_type, name, 2, 'owner_id', 'INTEGER', false,
    CASE WHEN source_type = 'django' THEN owner WHEN source_type = 'prisma' OR table_level THEN NULL
      ELSE owner || '.id' END, true, false, NULL
  FROM {DECLARED} WHERE owned)"""
RELATIONS = f"""(
  SELECT repo_id, source, source_type, name AS from_table, 'owner_id' AS from_column, owner AS to_table,
    CASE source_type WHEN 'django' THEN NULL ELSE 'id' END AS to_column, 'one_to_many' AS relationship_type,
    false AS inferred
  FROM {DECLARED} WHERE owned
  UNION ALL
  SELECT repo_id, source, source_type, name, 'owner', owner, NULL, 'unknown', true
  FROM {DECLARED} WHERE source_type = 'sqlalchemy'
  UNION ALL
  SELECT repo_id, source, source_type, name, 'tags', 'tag', NULL, 'many_to_many', false
  FROM {DECLARED} WHERE source_type = 'django')"""
COLUMN_FIELDS = 'name, data_type, primary_key, foreign_key, nullable, "unique", "default"'
RELATION_FIELDS = "from_table, from_column, to_table, to_column, relationship_type"

ORACLES["schema_candidates"] = f"""
SELECT repo_id, source AS path, source_type = 'sql' AS is_sql, source_type = 'prisma' AS is_prisma,
  source_type = 'sqlalchemy' AS is_sqlalchemy, source_type = 'django' AS is_django
FROM {DECLARED}"""
for _kind in KINDS:
    ORACLES[f"{_kind}_tables"] = (
        f"SELECT repo_id, name, source, confidence FROM {DECLARED} WHERE source_type = '{_kind}'"
    )
    ORACLES[f"{_kind}_columns"] = (
        f"SELECT repo_id, source, table_name, {COLUMN_FIELDS} FROM {COLUMNS} WHERE source_type = '{_kind}'"
    )
    ORACLES[f"{_kind}_relationships"] = (
        f"SELECT repo_id, source, {RELATION_FIELDS}, inferred FROM {RELATIONS} WHERE source_type = '{_kind}'"
    )
WINNERS = f"""(
  SELECT * FROM {DECLARED}
  QUALIFY row_number() OVER (PARTITION BY repo_id, name ORDER BY confidence DESC, source) = 1)"""
ORACLES["dedupe_tables"] = f"""
SELECT repo_id, name, source, source_type, confidence,
  CAST(2 + CASE WHEN owned THEN 1 ELSE 0 END AS INTEGER) AS column_count
FROM {WINNERS}"""
ORACLES["schema_columns"] = f"""
SELECT c.repo_id, c.table_name, CAST(c.ordinal AS INTEGER) AS ordinal, c.name, c.data_type, c.primary_key,
  c.foreign_key, c.nullable, c."unique", c."default", c.source
FROM {COLUMNS} c JOIN {WINNERS} w ON c.repo_id = w.repo_id AND c.table_name = w.name AND c.source = w.source"""
UNIQUE_RELATIONS = f"""(
  SELECT repo_id, {RELATION_FIELDS}, source, inferred FROM {RELATIONS}
  QUALIFY row_number() OVER (PARTITION BY repo_id, from_table, from_column, to_table, to_column ORDER BY source) = 1)"""
ORACLES["dedupe_relationships"] = f"SELECT * FROM {UNIQUE_RELATIONS}"
ORACLES["schema_overview"] = f"""
SELECT r.repo_id, coalesce(t.tables, 0) > 0 AS detected, coalesce(t.tables, 0) AS table_count,
  CAST(coalesce(t.columns, 0) AS BIGINT) AS column_count, coalesce(t.tables, 0) AS primary_key_count,
  CAST(coalesce(t.fks, 0) AS BIGINT) AS foreign_key_count, CAST(coalesce(t.uniques, 0) AS BIGINT) AS unique_count,
  CAST(coalesce(t.nullables, 0) AS BIGINT) AS nullable_count, coalesce(l.relations, 0) AS relationship_count
FROM (SELECT 'repo' || n_nationkey AS repo_id FROM nation) r
LEFT JOIN (SELECT repo_id, count(*) AS tables, sum(2 + owned::INTEGER) AS columns,
    sum((owned AND source_type <> 'prisma' AND NOT table_level)::INTEGER) AS fks, sum(uniq::INTEGER) AS uniques,
    sum((NOT required)::INTEGER + owned::INTEGER) AS nullables
  FROM {WINNERS} GROUP BY repo_id) t ON t.repo_id = r.repo_id
LEFT JOIN (SELECT repo_id, count(*) AS relations FROM {UNIQUE_RELATIONS} GROUP BY repo_id) l ON l.repo_id = r.repo_id"""

# --- search and ranking --------------------------------------------------------------

NEEDLES = (
    "(VALUES (1, NULL, 'the'), (2, NULL, 'license'), (3, 'src3', 'é'), (4, 'src5', 'tion'))"
    " q(query_id, repo, needle)"
)


PHRASES = """(
  SELECT CAST(item_id * 10000 + p AS INTEGER) AS query_id, CASE WHEN item_id % 3 <> 0 THEN 'src' || (item_id % 10) END AS repo,
    lower(array_to_string(words[p:p + 2], ' ')) AS needle
  FROM (SELECT item_id, words, unnest(generate_series(1, greatest(len(words) - 2, 1), 4)) AS p
    FROM (SELECT item_id, string_split_regex(text, '[ \\n]+') AS words FROM benchmark))) q"""


def _matches(files: str, queries: str = NEEDLES) -> str:
    return f"""(
  SELECT repo_id, query_id, path, line, text FROM (
    SELECT repo_id, path, unnest(parts) AS text, CAST(generate_subscripts(parts, 1) AS INTEGER) AS line
    FROM (SELECT repo_id, path, string_split(content, chr(10)) AS parts FROM {files})) l
  JOIN {queries} ON (repo IS NULL OR repo = repo_id) AND contains(lower(text), needle))"""


def _limited(files: str, n: int) -> str:
    return f"""(
  SELECT * FROM {_matches(files)}
  QUALIFY row_number() OVER (PARTITION BY repo_id, query_id ORDER BY path, line) <= {n})"""


ORACLES["code_search"] = f"""
SELECT *, count(*) OVER (PARTITION BY repo_id, query_id) >= 50 AS truncated FROM {_limited(SEEN_DOCS, 50)}"""
ORACLES["search_queries"] = f"SELECT * FROM {_matches(SEEN_DOCS, PHRASES)}"
ORACLES["search_queries_first_matches"] = ORACLES["code_search"]
ORACLES["code_search_all"] = f"""
SELECT repo_id, query_id, path, count(*) AS matches, min(line) AS first_line
FROM {_matches(SEEN_DOCS)} GROUP BY repo_id, query_id, path"""
ORACLES["code_search_first_matches"] = f"""
SELECT m.*, count(*) OVER (PARTITION BY m.repo_id, query_id) >= 5 AS truncated
FROM {_limited(SEEN_DOCS, 5)} m WHERE query_id <= 2"""


def _keywords(texts: str, keys: str) -> str:
    """Top 20 words of `t` in a relation with the given keys."""
    return f"""(
  SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY frequency DESC, first_pos) AS INTEGER) AS rank,
    keyword, frequency
  FROM (SELECT {keys}, keyword, count(*) AS frequency, min(pos) AS first_pos
    FROM (SELECT {keys}, unnest(toks) AS keyword, generate_subscripts(toks, 1) AS pos
      FROM (SELECT {keys}, regexp_extract_all(lower(t), '[a-z][a-z0-9_]{{2,}}') AS toks FROM {texts}))
    WHERE NOT list_contains({words(C.STOP_WORDS)}, keyword) GROUP BY {keys}, keyword)
  QUALIFY rank <= 20)"""


ORACLES["extract_keywords"] = (
    f"SELECT * FROM {_keywords('(SELECT conv_id, turn, text AS t FROM conversations)', 'conv_id, turn')}"
)
ISSUES = "(SELECT 'src' || (item_id % 20) AS repo_id, item_id AS number, text AS t FROM benchmark)"
KEYWORDS = _keywords(ISSUES, "repo_id, number")
ORACLES["issue_keywords"] = f"SELECT * FROM {KEYWORDS}"
SCORES = f"""(
  SELECT repo_id, number, path, CAST(sum(2 * in_path + in_content) AS BIGINT) AS score, max(in_path) > 0 AS in_path,
    list('"' || keyword || '"' ORDER BY rank) FILTER (in_path + in_content > 0) AS matched
  FROM (SELECT k.repo_id, k.number, k.rank, k.keyword, f.path,
      CAST(contains(lower(f.path), k.keyword) AS INTEGER) AS in_path,
      CAST(contains(lower(f.content), k.keyword) AS INTEGER) AS in_content
    FROM {KEYWORDS} k JOIN {SEEN_DOCS} f ON f.repo_id = k.repo_id)
  GROUP BY repo_id, number, path HAVING score > 0)"""
ORACLES["score_files"] = f"SELECT repo_id, number, path, score, in_path FROM {SCORES}"
TOP_FILES = f"""(
  SELECT repo_id, number,
    CAST(row_number() OVER (PARTITION BY repo_id, number ORDER BY score DESC, path) AS INTEGER) AS position,
    path, score,
    'Matched keyword(s) ' || array_to_string(matched[1:4], ', ') || ' in '
      || CASE WHEN in_path THEN 'path and content' ELSE 'content' END || '.' AS reason,
    true AS inferred
  FROM {SCORES} QUALIFY position <= 10)"""
ORACLES["top_files_per_issue"] = f"SELECT * FROM {TOP_FILES}"
ORACLES["top_files_heavy_keywords"] = ORACLES["top_files_per_issue"]

# --- issues --------------------------------------------------------------------------


def _or(text: str, values) -> str:
    return "(" + " OR ".join(f"contains({text}, '{v}')" for v in values) + ")"


def _analysis(issues: str) -> str:
    """The triage rules over (repo_id, issue_number, title, body, labels, comments, url)."""
    title_type = " ".join(
        f"WHEN {_or('lower(title)', values)} THEN '{kind}'" for kind, values in C.TYPE_TITLE_WORDS
    )
    label_type = " ".join(
        f"WHEN list_contains({words(values)}, l) THEN '{kind}'" for kind, values in C.TYPE_LABELS
    )
    topics = ", ".join(
        f"CASE WHEN contains(lower(body), '{w}') THEN '{w}' END" for w in C.COMPLEX_BODY_WORDS
    )

    def picked(values) -> str:
        return f"list_filter(low, lambda l: list_contains({words(values)}, l))"

    return f"""(
  SELECT repo_id, issue_number, title,
    coalesce(list_filter(list_transform(low, lambda l: CASE {label_type} END), lambda t: t IS NOT NULL)[1],
      CASE {title_type} ELSE 'unknown' END) AS type,
    CASE WHEN len({picked(C.SMALL_SCOPE_LABELS)}) > 0 THEN 'small' WHEN len({picked(C.LARGE_SCOPE_LABELS)}) > 0 THEN 'large'
      WHEN n = 0 THEN 'unknown' WHEN n < 800 THEN 'small' WHEN n > 2500 THEN 'large' ELSE 'medium' END AS scope,
    list_filter([
      CASE WHEN len({picked(C.APPROACHABLE_LABELS)}) > 0
        THEN 'Labelled as approachable: ' || array_to_string({picked(C.APPROACHABLE_LABELS)}, ', ') END,
      CASE WHEN n > 0 THEN 'Issue includes a description.' END,
      CASE WHEN {_or('lower(body)', C.REPRODUCTION_WORDS)} THEN 'Reproduction steps or expected vs actual behavior described.' END,
      CASE WHEN {_or('lower(title)', C.FOCUSED_TITLE_WORDS)} THEN 'Title suggests a focused, well-scoped change.' END,
      CASE WHEN n BETWEEN 200 AND 1500 THEN 'Description length suggests a focused scope.' END,
      CASE WHEN comments > 0 THEN 'Has ' || comments || ' comment(s) — community is engaged.' END
    ], lambda r: r IS NOT NULL) AS reasons,
    list_filter([
      CASE WHEN trim(body) = '' THEN 'No description provided — scope is unclear.' END,
      CASE WHEN len({picked(C.COMPLEX_LABELS)}) > 0
        THEN 'Labels suggest complexity: ' || array_to_string({picked(C.COMPLEX_LABELS)}, ', ') || '.' END,
      CASE WHEN {_or('lower(body)', C.COMPLEX_BODY_WORDS)} THEN 'Description mentions complex topics: '
        || array_to_string(list_filter([{topics}], lambda w: w IS NOT NULL)[1:3], ', ') || '.' END,
      CASE WHEN n > 3000 THEN 'Very long description — may indicate high complexity.' END,
      CASE WHEN comments = 0 AND n = 0 THEN 'No description and no comments — issue may be abandoned.' END,
      CASE WHEN len(regexp_extract_all(body, '\\b\\w+\\.\\w{{1,5}}\\b')) > 15
        THEN 'References many files/paths — may touch multiple modules.' END
    ], lambda c: c IS NOT NULL) AS concerns,
    labels, url
  FROM (SELECT repo_id, issue_number, coalesce(title, '') AS title, coalesce(body, '') AS body,
      length(coalesce(body, '')) AS n, labels, list_transform(labels, lambda l: lower(l)) AS low, comments, url
    FROM {issues}))"""


def _flat(analysis: str) -> str:
    return f"""
SELECT repo_id, issue_number, title, type, scope, array_to_string(reasons, '|') AS reasons,
  array_to_string(concerns, '|') AS concerns, array_to_string(labels, '|') AS labels, url
FROM {analysis}"""


TURNS = _analysis("""(
  SELECT role AS repo_id, conv_id * 100 + turn AS issue_number, split_part(text, '.', 1) AS title, text AS body,
    CASE turn % 3 WHEN 0 THEN ['Docs', 'Bug'] ELSE [] END AS labels, turn AS comments, '' AS url
  FROM conversations)""")
ORDER_ISSUES = """(
  SELECT 'repo' || (o_custkey % 20) AS repo_id, o_orderkey AS issue_number,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Crash in module ' || o_custkey WHEN '2-HIGH' THEN 'Readme typo'
      WHEN '3-MEDIUM' THEN 'Implement export' WHEN '4-NOT SPECIFIED' THEN NULL
      ELSE 'Move things, item ' || o_orderkey END AS title,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE
      CASE WHEN o_orderkey % 2 = 0 THEN 'Steps to Reproduce: ' ELSE '' END
      || CASE WHEN o_orderkey % 5 = 0 THEN 'OAuth migration design. ' ELSE '' END
      || repeat('abcd efgh ', CAST(floor(o_totalprice / 1000) AS INTEGER))
      || CASE WHEN o_orderkey % 7 = 0 THEN repeat('see a.py ', 16) ELSE '' END END AS body,
    CASE o_orderstatus WHEN 'F' THEN ['Help Wanted', 'Enhancement'] WHEN 'O' THEN ['Security', 'RFC'] ELSE [] END AS labels,
    CAST(o_orderkey % 4 AS INTEGER) AS comments, 'https://example.org/i/' || o_orderkey AS url
  FROM orders)"""
TRIAGE = _analysis(ORDER_ISSUES)
ORACLES["open_issues"] = f"""
SELECT repo_id, issue_number AS number, title, CAST(coalesce(length(body), -1) AS INTEGER) AS body_length,
  CASE len(labels) WHEN 0 THEN NULL ELSE array_to_string(labels, ',') END AS labels, comments
FROM {ORDER_ISSUES} WHERE issue_number % 11 <> 0"""
ORACLES["analyze_issues"] = _flat(TURNS)
ORACLES["analyze_order_issues"] = _flat(TRIAGE)
ORACLES["issue_type"] = f"SELECT repo_id, type, count(*) AS n FROM {TRIAGE} GROUP BY repo_id, type"
ORACLES["issue_scope"] = f"SELECT repo_id, scope, count(*) AS n FROM {TRIAGE} GROUP BY repo_id, scope"
ORACLES["issue_reasons"] = (
    f"SELECT repo_id, issue_number, array_to_string(reasons, '|') AS reasons FROM {TRIAGE}"
)
ORACLES["issue_concerns"] = (
    f"SELECT repo_id, issue_number, array_to_string(concerns, '|') AS concerns FROM {TRIAGE}"
)
ORACLES["issue_board"] = f"""
SELECT repo_id, issue_number, title, type, scope, array_to_string(reasons[1:2], '|') AS reasons,
  array_to_string(concerns[1:1], '|') AS concerns, array_to_string(labels, '|') AS labels
FROM {TRIAGE}"""
ORACLES["commit_message"] = f"""
SELECT repo_id, issue_number,
  CASE WHEN length(header) > 72 THEN substr(header, 1, 69) || '...' ELSE header END
    || chr(10) || chr(10) || 'Closes #' || issue_number AS message
FROM (SELECT repo_id, issue_number,
    CASE type WHEN 'bug' THEN 'fix' WHEN 'docs' THEN 'docs' WHEN 'feature' THEN 'feat' WHEN 'refactor' THEN 'refactor'
      ELSE 'chore' END || ': '
    || CASE WHEN title = '' THEN 'address issue #' || issue_number
         WHEN issue_number % 3 = 0 THEN repeat(title, 4) ELSE title END AS header
  FROM {TRIAGE})"""

# --- planning ------------------------------------------------------------------------

FLAGS = f"""(
  SELECT repo_id, k IN (1, 2, 3) OR (k IN (5, 6) AND s % 2 = 0) AS python,
    k IN (0, 1, 5) OR s % 5 = 1 OR (k = 6 AND s % 2 = 1) AS node,
    k IN (4, 5) OR s % 5 = 2 AS rust, k IN (3, 4) AS go,
    k IN (1, 2) AND s % 5 = 0 AS pytest, k IN (0, 1, 5) AND s % 3 = 0 AS npm_test
  FROM {PARTS})"""
ORACLES["test_command"] = f"""
SELECT repo_id, CASE WHEN python AND pytest THEN 'python -m pytest -v' WHEN python THEN 'python -m unittest discover'
    WHEN node AND npm_test THEN 'npm test' WHEN rust THEN 'cargo test' WHEN go THEN 'go test ./...' END AS test_command
FROM {FLAGS}"""
ORACLES["test_hint"] = f"""
SELECT repo_id, CASE WHEN python AND pytest THEN 'pytest' WHEN python THEN 'python -m unittest' WHEN node THEN 'npm test'
    WHEN rust THEN 'cargo test' WHEN go THEN 'go test ./...' ELSE 'the project''s test suite' END AS test_hint
FROM {FLAGS}"""
DOC_HINTS = f"""(
  SELECT repo_id, CASE WHEN bool_or(extension = '.py') THEN 'python -m unittest'
    WHEN bool_or(extension IN ('.tsx', '.js')) THEN 'npm test' WHEN bool_or(extension = '.rs') THEN 'cargo test'
    ELSE 'the project''s test suite' END AS hint
  FROM {SEEN_DOCS} GROUP BY repo_id)"""
PLANNED = f"""(
  SELECT i.repo_id, i.number, coalesce(p.paths, []) AS paths, coalesce(p.tests, []) AS tests,
    coalesce(h.hint, 'the project''s test suite') AS hint
  FROM {ISSUES} i
  LEFT JOIN (SELECT repo_id, number, list(path ORDER BY position) AS paths,
      list(path ORDER BY position) FILTER (contains(lower(path), 'test') OR contains(lower(path), 'spec')) AS tests
    FROM {TOP_FILES} GROUP BY repo_id, number) p ON p.repo_id = i.repo_id AND p.number = i.number
  LEFT JOIN {DOC_HINTS} h ON h.repo_id = i.repo_id)"""
# Issues made of benchmark passages have no title and no labels, so their type is unknown.
ORACLES["plan_steps"] = f"""
SELECT repo_id, number AS issue_number, CAST(generate_subscripts(steps, 1) AS INTEGER) AS "index",
  unnest(steps) AS description
FROM (SELECT repo_id, number, list_filter([
    'Read issue #' || number || ' carefully. Understand what is broken or missing and what the expected behaviour should be.',
    CASE WHEN len(paths) > 0 THEN 'Review the likely relevant files: ' || array_to_string(paths[1:4], ', ') || '.' END,
    CASE WHEN len(tests) > 0 THEN 'Read the existing tests related to this area: ' || array_to_string(tests[1:3], ', ') || '.'
      ELSE 'Look for existing tests related to the affected functionality.' END,
    'Create an isolated branch for this contribution: contrib/' || number || '-<short-description>.',
    'Write a test that reproduces the problem described in the issue. The test should fail with the current code and pass after the fix.',
    'Implement the smallest change that fixes the issue. Follow the existing code style and do not introduce new dependencies.',
    'Run the test suite (' || hint || ') and confirm all tests pass.',
    'Review the diff to make sure the changes are minimal, correct, and do not include unrelated modifications.',
    'Commit the changes with a clear message following the conventional commits format: type(scope): short description.'
  ], lambda x: x IS NOT NULL) AS steps FROM {PLANNED})"""
ORACLES["issue_plans"] = f"""
SELECT repo_id, number AS issue_number, 'contrib/' || number || '-' AS branch_name,
  array_to_string(paths, '|') AS relevant_files, false AS approved, hint AS test_command,
  coalesce(tests[1], 'tests/test_something.py') AS test_file_hint
FROM {PLANNED}"""

# --- sessions ------------------------------------------------------------------------

RUNS = """(
  SELECT 's' || user_id AS session_id, event_id AS attempt,
    ['python -m pytest -v', 'npm test', 'cargo test', 'go test ./...', 'make check'][1 + event_id % 5] AS command,
    CASE WHEN event_id % 5 < 4 THEN event_id % 17 ELSE 0 END AS passed,
    CASE WHEN event_id % 5 < 4 AND event_type = 'error' THEN 1 + event_id % 3 ELSE 0 END AS failed,
    CASE WHEN event_id % 5 = 0 THEN event_id % 2 ELSE 0 END AS errors,
    round(value, 2) AS duration_seconds, event_type = 'signup' AND event_id % 10 = 3 AS timed_out,
    event_id % 17 AS p, CASE WHEN event_type = 'error' THEN 1 + event_id % 3 ELSE 0 END AS f, event_id
  FROM events)"""
OUTPUT_LENGTH = """CAST(CASE event_id % 5 WHEN 0 THEN 59 + length(p::VARCHAR) WHEN 1 THEN 34 + length(p::VARCHAR)
    WHEN 2 THEN 72 + length(p::VARCHAR) WHEN 3 THEN 12 * (p + f) ELSE 18 END AS INTEGER)"""
ORACLES["parse_test_logs"] = f"""
SELECT session_id, attempt, command, passed, failed, errors, duration_seconds, timed_out, {OUTPUT_LENGTH} AS output
FROM {RUNS}"""
TOTALS = f"""(
  SELECT session_id, CAST(sum(passed + failed + errors) AS BIGINT) AS tests_run, CAST(sum(passed) AS BIGINT) AS tests_passed,
    CAST(sum(failed) AS BIGINT) AS tests_failed, count(*) AS test_runs
  FROM {RUNS} GROUP BY session_id)"""
ORACLES["session_totals"] = f"SELECT * FROM {TOTALS}"
ORACLES["session_attempts"] = f"""
SELECT session_id, attempt, passed, failed, errors, duration_seconds, timed_out, failed = 0 AS shown_as_passed
FROM {RUNS}"""
STATES = f"""(
  SELECT session_id, repo_id, issue_number, branch_name, state, coalesce(n, 0) AS files_analyzed,
    CAST(coalesce(s.files_modified, 0) AS INTEGER) AS files_modified,
    CASE WHEN s.files_modified IS NOT NULL THEN array_to_string(['a.py', 'b.py', 'c.py'][1:s.files_modified], '|') END AS changed_files,
    started_at, CASE WHEN state <> 'GUIDING' THEN decided_at END AS finished_at
  FROM (SELECT e.*, CASE e.last WHEN 'branch_failed' THEN 'FAILED' WHEN 'no_command' THEN 'DONE'
        WHEN 'test' THEN CASE WHEN r.timed_out OR (r.failed = 0 AND r.errors = 0) THEN 'DONE' ELSE 'GUIDING' END
        ELSE 'GUIDING' END AS state
    FROM (SELECT 's' || user_id AS session_id, 'repo' || (user_id % 20) AS repo_id, user_id AS issue_number,
        'contrib/' || user_id || '-x' AS branch_name, min(ts) AS started_at,
        arg_max(event, ts) FILTER (event <> 'start') AS last, max(ts) FILTER (event <> 'start') AS decided_at,
        arg_max(event_id % 4, ts) FILTER (event IN ('test', 'no_command')) AS files_modified
      FROM (SELECT *, CASE WHEN event_id % 1009 = 0 THEN 'branch_failed' WHEN event_type = 'view' THEN 'start'
          WHEN event_type = 'purchase' THEN 'no_command' ELSE 'test' END AS event FROM events)
      GROUP BY user_id) e
    LEFT JOIN (SELECT * FROM {RUNS} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY attempt DESC) = 1) r
      ON r.session_id = e.session_id) s
  LEFT JOIN (SELECT 'repo' || (o_custkey % 20) AS r2, count(*) AS n FROM orders GROUP BY 1) c ON r2 = repo_id)"""
ORACLES["session_state"] = f"SELECT * FROM {STATES}"
REPORTS = f"""(
  SELECT s.session_id, s.repo_id, s.issue_number, coalesce(i.title, '') AS issue_title, branch_name, state,
    files || ' file(s) changed, ' || 2 * files || ' insertion(s), ' || files || ' deletion(s)' AS diff_stat,
    '## Summary

<!-- One-sentence summary of the change -->
Addresses issue #' || s.issue_number || ': ' || coalesce(i.title, '') || '

## Problem

<!-- Describe what the issue reported -->

## Changes

<!-- List each changed file and what was modified -->
- Branch: `' || branch_name || '`
- Files modified: ' || files_modified || '

## Testing

' || CASE WHEN coalesce(tests_run, 0) > 0 THEN '- ' || tests_passed || ' test(s) passed, ' || tests_failed || ' failed'
      ELSE '- No test suite detected' END || '
' || CASE WHEN coalesce(test_runs, 0) > 0 THEN '- Verification attempts: ' || test_runs ELSE '' END || '

## Related Issue

Closes #' || s.issue_number AS draft,
    files_analyzed, files_modified, changed_files, started_at, finished_at, coalesce(tests_run, 0) AS tests_run, coalesce(tests_passed, 0) AS tests_passed,
    coalesce(tests_failed, 0) AS tests_failed, coalesce(test_runs, 0) AS test_runs
  FROM (SELECT *, 1 + issue_number % 3 AS files FROM {STATES} WHERE state <> 'GUIDING') s
  LEFT JOIN {TOTALS} t ON t.session_id = s.session_id
  LEFT JOIN {ORDER_ISSUES} i ON i.repo_id = s.repo_id AND i.issue_number = s.issue_number)"""
ORACLES["session_report"] = f"SELECT * FROM {REPORTS}"
ORACLES["report_draft"] = f"SELECT session_id, draft FROM {REPORTS}"
ORACLES["project_status"] = """
SELECT 'p' || user_id AS project_id,
  arg_max(CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'analyzing' WHEN 'view' THEN 'ready' ELSE 'error' END, ts) AS status,
  CASE WHEN arg_max(event_type, ts) = 'error' THEN arg_max(props, ts) END AS error_message, max(ts) AS updated_at
FROM events WHERE event_type <> 'purchase' GROUP BY user_id"""

# --- projects ------------------------------------------------------------------------

OVERVIEW = f"""(
  SELECT p.repo_id AS project_id, p.p_name AS name, CASE WHEN k = 7 THEN 'error' ELSE 'ready' END AS status,
    '' AS repository_url, TIMESTAMP '1970-01-01' + to_seconds(1700000000 + p_partkey) AS created_at,
    coalesce(t.names, '') AS technologies, coalesce(f.n, 0) AS file_count, coalesce(d.n, 0) AS dependency_count,
    coalesce(t.n, 0) AS technology_count, CAST(0 AS BIGINT) AS component_count,
    CASE WHEN k = 7 THEN 'bad manifest' END AS error_message
  FROM {PARTS} p
  LEFT JOIN (SELECT repo_id, count(*) AS n FROM ({MANIFEST_FILES}) GROUP BY repo_id) f ON f.repo_id = p.repo_id
  LEFT JOIN (SELECT repo_id, count(*) AS n FROM ({ALL_DEPENDENCIES}) GROUP BY repo_id) d ON d.repo_id = p.repo_id
  LEFT JOIN (SELECT repo_id, count(*) AS n, string_agg(name, '|' ORDER BY name) AS names FROM ({TECHNOLOGIES}) GROUP BY repo_id) t
    ON t.repo_id = p.repo_id)"""
ORACLES["project_overview"] = f"SELECT * FROM {OVERVIEW}"
ORACLES["list_projects"] = (
    f"SELECT project_id, name, status, created_at, file_count FROM {OVERVIEW} ORDER BY created_at DESC"
)
ANCESTORS = f"""(
  SELECT repo_id, array_to_string(parts[1:i], '/') AS directory, parts[i] AS name, CAST(i AS INTEGER) AS depth,
    count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes
  FROM (SELECT repo_id, size_bytes, parts, unnest(range(1, len(parts))) AS i
    FROM (SELECT repo_id, size_bytes, string_split(path, '/') AS parts FROM {PAGES}))
  GROUP BY 1, 2, 3, 4)"""
ORACLES["directory_rollup"] = f"SELECT * FROM {ANCESTORS}"
ORACLES["tree_nodes"] = f"""
SELECT repo_id, path, name, is_dir, size_bytes, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent,
  CASE WHEN is_dir THEN '0' ELSE '1' END || name AS sort_key
FROM (SELECT repo_id, directory AS path, name, true AS is_dir, total_bytes AS size_bytes FROM {ANCESTORS}
  UNION ALL SELECT repo_id, path, string_split(path, '/')[-1], false, size_bytes FROM {PAGES})"""
ORACLES["snapshot_changes"] = f"""
SELECT repo_id, path, CASE lang WHEN 'es' THEN 'added' WHEN 'de' THEN 'deleted' ELSE 'modified' END AS change
FROM {DOCS} WHERE lang IN ('es', 'de') OR repo_id IN ('src3', 'src7')"""
VALID_PARTS = "(SELECT * FROM part WHERE p_partkey % 10 NOT IN (3, 4, 5))"
ORACLES["knowledge_technologies"] = f"""
SELECT 'pkg' || p_partkey AS repo_id, p_brand AS name, 'package.json' AS source, CAST(p_size AS DOUBLE) / 100 AS confidence
FROM {VALID_PARTS}"""
ORACLES["knowledge_dependencies"] = f"""
SELECT 'pkg' || p_partkey AS repo_id, p_type AS name, 'npm' AS ecosystem, 'package.json' AS source FROM {VALID_PARTS}
UNION ALL SELECT 'pkg' || p_partkey, p_name, 'pypi', 'requirements.txt' FROM {VALID_PARTS}"""
ORACLES["knowledge_rejects"] = """
SELECT CASE p_partkey % 10 WHEN 3 THEN 'unknown status' WHEN 4 THEN 'confidence outside [0, 1]' ELSE 'unreadable' END AS reason,
  count(*) AS documents
FROM part WHERE p_partkey % 10 IN (3, 4, 5) GROUP BY 1"""

# --- written and read back -----------------------------------------------------------

ORACLES["read_issues"] = f"""
SELECT repo_id, issue_number AS number, comments, url AS html_url FROM {ORDER_ISSUES} WHERE issue_number % 11 <> 0"""
ORACLES["read_test_logs"] = f"""
SELECT session_id, attempt, command, duration_seconds, timed_out, {OUTPUT_LENGTH} AS output FROM {RUNS}"""
ORACLES["issue_rejects"] = """
SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'unreadable' ELSE 'no repo_id' END AS reason, count(*) AS records
FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 GROUP BY 1"""
ORACLES["read_session_events"] = """
SELECT 's' || user_id AS session_id,
  CASE WHEN event_id % 1009 = 0 THEN 'branch_failed' WHEN event_type = 'view' THEN 'start'
    WHEN event_type = 'purchase' THEN 'no_command' ELSE 'test' END AS event,
  epoch_us(ts) AS micros, array_to_string(['a.py', 'b.py', 'c.py'][1:event_id % 4], '|') AS changed_files
FROM events"""
ORACLES["read_knowledge_docs"] = ORACLES["knowledge_technologies"]
ORACLES["write_facts"] = """
SELECT 'pkg' || p_partkey AS repo_id, CASE p_type WHEN 'PROMO' THEN p_name ELSE p_brand END AS name, p_type AS version
FROM part WHERE p_type <> 'PROMO' OR p_size > 10"""
ORACLES["compact_facts"] = ORACLES["write_facts"]
ORACLES["incremental_dependencies"] = ORACLES["extract_dependencies"]
