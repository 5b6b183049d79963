"""Input tables of the engine, rendered by Spark from the given tables.

Every given row becomes its own file, issue, log or event by a projection, so a corpus grows
with its table and nothing is grouped to build it. What each text says is known from the row
it was rendered from; the oracles state that directly and parse nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPOS = 20


# Rows that one task takes at most, so that the number of tasks grows with a table.
TASK_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, spread when its rows lie in fewer splits than there are cores or in large ones.

    A split without the start of a row group is empty, so rows are counted, from the files' footers.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    splits = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("n"))
    filled, largest, rows = splits.agg(F.count("*"), F.max("n"), F.sum("n")).first()
    cores = spark.sparkContext.defaultParallelism
    if filled >= cores and largest <= TASK_ROWS:
        return df
    return df.repartition(max(cores, -(-(rows or 0) // TASK_ROWS)))


def _files(df: DataFrame, repo: str, *files: tuple[str, str, str]) -> DataFrame:
    """Rows of the file table from (path, content, condition) in SQL.

    As with a stored table, a content is made only where it is asked for: rows are multiplied
    with their paths alone.
    """
    entries = ", ".join(
        f"if({when}, named_struct('path', {path}, 'kind', {kind}), null)"
        for kind, (path, _, when) in enumerate(files)
    )
    content = " ".join(f"WHEN {kind} THEN {text}" for kind, (_, text, _) in enumerate(files))
    multiplied = df.select("*", F.explode(F.expr(f"array({entries})")).alias("f")).where("f IS NOT NULL")
    return multiplied.select(
        F.expr(repo).alias("repo_id"), "f.path", F.expr(f"CASE f.kind {content} END").alias("content")
    )


def _file(path: str, content: str, when: str = "true") -> tuple[str, str, str]:
    return path, content, when


# --- documents and pages as files ----------------------------------------------------

DOC_DIR = (
    "CASE doc_id % 4 WHEN 0 THEN 'tests/tion/' WHEN 1 THEN 'that_with/'"
    " WHEN 2 THEN 'spec/' ELSE 'src/build/' END"
)
DOC_EXT = (
    "CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.tsx' WHEN 2 THEN '.test.js'"
    " WHEN 3 THEN '' WHEN 4 THEN '.rs' ELSE '.sql' END"
)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "source AS repo_id",
        f"concat({DOC_DIR}, lang, doc_id, {DOC_EXT}) AS path",
        "text AS content",
        "lang",
    )


def _file_writer(folder: str):
    """A task's writing of (repo_id, path, content) as files; a repeated task writes the same files again."""

    def run(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs

        if folder.startswith("file:") or "://" not in folder:
            system, root = fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
        else:
            system, root = fs.FileSystem.from_uri(folder)
        made, n = set(), 0
        for batch in batches:
            for row in batch.to_pylist():
                target = f"{root}/{row['repo_id']}/{row['path']}"
                above = os.path.dirname(target)
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                with system.open_output_stream(target, compression=None) as stream:
                    stream.write(row["content"].encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    return run


def write_checkouts(spark: SparkSession, sf_dir: str, folder: str) -> int:
    """Write the documents as checkouts below `folder`, one repository per source; the number of files."""
    files = document_files(spark, sf_dir).select("repo_id", "path", F.coalesce("content", F.lit("")).alias("content"))
    return files.mapInArrow(_file_writer(folder), "files BIGINT").agg(F.sum("files")).first()[0]


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, repo_id, needle): every fourth run of three words of each benchmark text, asked of all or of one repository."""
    starts = "sequence(1, greatest(size(words) - 2, 1), 4)"
    return (
        table(spark, sf_dir, "benchmark").selectExpr("item_id", "split(text, '[ \\n]+') AS words")
        .selectExpr("item_id", "words", f"explode({starts}) AS p")
        .selectExpr(
            "CAST(item_id * 10000 + p AS INT) AS query_id",
            "if(item_id % 3 = 0, null, concat('src', item_id % 10)) AS repo_id",
            "array_join(slice(words, p, 3), ' ') AS needle",
        )
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host; some below directories that are left out of analysis."""
    return table(spark, sf_dir, "pages").selectExpr(
        "regexp_extract(url, '^https?://([^/]+)/', 1) AS repo_id",
        "concat(CASE page_id % 5 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/dist/' ELSE '' END,"
        " regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/p', page_id,"
        " CASE page_id % 7 WHEN 0 THEN '/build' ELSE '.html' END) AS path",
        "html AS content",
        "CAST(length(html) AS BIGINT) AS size_bytes",
        "page_id",
    )


# --- import graph --------------------------------------------------------------------

PY_FILE = "concat('app/o', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey, '.py')"
TS_FILE = "concat('web/o', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey, '.ts')"


def import_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Python and one TypeScript file per line item, importing its part and supplier.

    Parts live in the importer's repository, suppliers often do not.
    """
    lineitem = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    part = table(spark, sf_dir, "part").select("p_partkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey")
    python = (
        "concat('import os, sys\\nfrom lib.p_', l_partkey, ' import run\\nimport svc.s_', l_suppkey,"
        " ' as s\\n    import lib.p_0\\n# import lib.p_1\\nfrom .lib.p_2 import x\\nfrom lib.p_',"
        " l_partkey, ' import again\\n')"
    )
    script = (
        "concat('import { run } from \\'../lib/p_', l_partkey, '\\';\\nimport s from \"./../svc/x/../s_',"
        " l_suppkey, '\";\\nimport out from \\'../../lib/p_1\\';\\nimport React from \\'react\\';\\n')"
    )
    sources = _files(
        lineitem, f"concat('repo', l_partkey % {REPOS})", _file(PY_FILE, python), _file(TS_FILE, script)
    )
    parts = _files(
        part,
        f"concat('repo', p_partkey % {REPOS})",
        _file("concat('lib/p_', p_partkey, '.py')", "'x = 1'", "p_partkey % 3 = 0"),
        _file("concat('src/lib/p_', p_partkey, '.py')", "'x = 1'", "p_partkey % 3 < 2"),
        _file("concat('lib/p_', p_partkey, '/__init__.py')", "'x = 1'", "p_partkey % 3 = 2"),
        _file("concat('lib/p_', p_partkey, '.tsx')", "'let x'", "p_partkey % 2 = 0"),
        _file("concat('lib/p_', p_partkey, '/index.js')", "'let x'", "p_partkey % 4 > 0"),
    )
    suppliers = _files(
        supplier,
        f"concat('repo', s_suppkey % {REPOS})",
        _file("concat('src/svc/s_', s_suppkey, '/__init__.py')", "'x = 1'"),
        _file("concat('svc/s_', s_suppkey, '.jsx')", "'let x'"),
    )
    return sources.unionByName(parts).unionByName(suppliers)


# --- manifests -----------------------------------------------------------------------


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repository per part; the manifests it has depend on p_partkey % 8."""
    part = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_size", "lower(p_brand) AS brand", "p_partkey % 8 AS k"
    )
    npm = (
        "concat('{\"name\": \"x\", \"dependencies\": {\"react\": \"^', p_size, '.1.0\", \"', brand,"
        " '\": \"~1.', p_size, '\"', if(p_size % 2 = 0, ', \"express\": \"\"', ''),"
        " '}, \"devDependencies\": {\"typescript\": \">=', p_size, '\", \"react\": \"*\"}',"
        " if(p_size % 3 = 0, ', \"scripts\": {\"test\": \"jest\"}', ''), '}')"
    )
    framework = (
        "CASE p_size % 3 WHEN 0 THEN concat('fastapi==', p_size, '.2')"
        " WHEN 1 THEN concat('Flask-Login>=', p_size) ELSE 'django' END"
    )
    requirements = (
        f"concat('# tools\\n\\n', {framework}, '\\n  Lib_', p_size, '[fast] >=1.', p_size, '\\n',"
        " if(p_size % 5 = 0, 'pytest\\n', ''))"
    )
    pyproject = (
        f"concat('[project]\\nname = \"x\"\\ndependencies = [\"', {framework}, '\", \"', 'Tool_',"
        " p_size, '\"]\\n')"
    )
    go_mod = (
        "concat('module example.com/x\\n\\ngo 1.', p_size, '\\n\\nrequire (\\n\\tmod/a', p_size,"
        " ' v1.', p_size, '.0 // indirect\\n\\t// note on mod\\n)\\n\\nrequire mod/single v', p_size, '\\n')"
    )
    cargo = (
        "concat('[package]\\nname = \"x\"\\n[dependencies]\\nserde = \"1.', p_size, '\"\\ntokio = { version = \"',"
        " p_size, '\" }\\nlocal = { path = \"../l\" }\\n[dev-dependencies]\\nrand = \"0.8\"\\n')"
    )
    docker = (
        "concat('# base\\nFROM ', if(p_size % 2 = 0, 'python:3.12-slim', 'node:20'), '\\nRUN true\\n')"
    )
    return _files(
        part,
        "concat('pkg', p_partkey)",
        _file("'package.json'", npm, "k IN (0, 1, 5)"),
        _file("'package.json'", "'{\"dependencies\": {'", "k = 7"),
        _file("'requirements.txt'", requirements, "k IN (1, 2)"),
        _file("'pyproject.toml'", pyproject, "k IN (2, 3)"),
        _file("'pyproject.toml'", "'[project'", "k = 6"),
        _file("'go.mod'", go_mod, "k IN (3, 4)"),
        _file("'Cargo.toml'", cargo, "k IN (4, 5)"),
        _file("'Dockerfile'", docker, "k IN (5, 6)"),
        _file("'.github/workflows/b.yml'", "'on: push'", "k = 6"),
        _file("concat('.github/workflows/a', p_size, '.yml')", "'on: push'", "k = 6"),
        _file("'src/main.tsx'", "'let x'", "p_size % 5 = 1"),
        _file("'src/main.rs'", "'fn x'", "p_size % 5 = 2"),
        _file("'node_modules/dep/Main.java'", "'class X'"),
        _file("'docs/package.json'", "'{\"dependencies\": {\"nested\": \"1\"}}'"),
    )


# --- database schemas ----------------------------------------------------------------

DDL_PATH = (
    "CASE o_orderkey % 4 WHEN 0 THEN concat('db/o', o_orderkey, '.sql')"
    " WHEN 1 THEN concat('app/o', o_orderkey, '.py') WHEN 2 THEN concat('dj/o', o_orderkey, '.py')"
    " ELSE concat('p/o', o_orderkey, '/schema.prisma') END"
)


def schema_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table per order in one of four dialects; a customer's orders share a table name.

    Columns: id (key), amount (type by order status; not null and unique by priority) and, for
    every third order, owner_id referring to the next customer's table. In SQL the reference is
    a table constraint for every eighth order.
    """
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus AS st",
        "o_orderpriority IN ('1-URGENT', '2-HIGH') AS required",
        "o_orderpriority = '3-MEDIUM' AS uniq",
        "o_orderkey % 3 = 0 AS owned",
        "o_orderkey % 8 = 0 AS table_level",
        "concat('t', o_custkey) AS name",
        "concat('t', o_custkey + 1) AS owner",
        "concat('T', o_custkey) AS class",
        "concat('T', o_custkey + 1) AS owner_class",
    )
    sql = (
        "concat('-- CREATE TABLE follows\\ncreate table if not exists \"', name, '\" (\\n  id INTEGER NOT NULL PRIMARY KEY,\\n  amount ',"
        " CASE st WHEN 'F' THEN 'decimal(10, 2)' WHEN 'O' THEN 'INTEGER' ELSE 'VARCHAR(20)' END,"
        " if(required, ' NOT NULL', ''), if(uniq, ' UNIQUE', ''), ' DEFAULT 0',"
        " if(owned, concat(',\\n  owner_id INTEGER', if(table_level, ',\\n  FOREIGN KEY (owner_id)', ''),"
        " ' REFERENCES \"', owner, '\" (id)'), ''),"
        " ',\\n  CHECK ((amount > (0)))\\n);\\nSELECT 1;\\n')"
    )
    sqlalchemy = (
        "concat('from sqlalchemy import Column\\n\\nclass ', class, '(Base):\\n    __tablename__ = \"', name,"
        " '\"\\n\\n    id = Column(Integer, primary_key=True)\\n# note\\n    amount = Column(',"
        " CASE st WHEN 'F' THEN 'Numeric(10, 2)' WHEN 'O' THEN 'Integer' ELSE 'String(20)' END,"
        " if(uniq, ', unique=True', ''), ', default=0, nullable=', if(required, 'False', 'True'), ')\\n',"
        " if(owned, concat('    owner_id = Column(Integer, ForeignKey(\"', owner, '.id\"))\\n'), ''),"
        " '    owner = relationship(\"', owner_class, '\")\\n\\nlater = Column(Integer)\\n')"
    )
    django = (
        "concat('from django.db import models\\n\\nclass ', class, '(models.Model):\\n    id = models.AutoField(primary_key=True)\\n    amount = models.',"
        " CASE st WHEN 'F' THEN 'DecimalField' WHEN 'O' THEN 'IntegerField' ELSE 'CharField' END, '(max_length=20',"
        " if(required, '', ', null=True'), if(uniq, ', unique=True', ''), ')\\n',"
        " if(owned, concat('    owner_id = models.ForeignKey(', owner_class, ', null=True)\\n'), ''),"
        " '    tags = models.ManyToManyField(\"Tag\")\\n\\nlater = models.CharField()\\n')"
    )
    prisma = (
        "concat('model ', class, ' {\\n  id Int @id @default(autoincrement())\\n  amount ',"
        " CASE st WHEN 'F' THEN 'Decimal' WHEN 'O' THEN 'Int' ELSE 'String' END, if(required, '', '?'),"
        " if(uniq, ' @unique', ''), ' @default(0)\\n',"
        " if(owned, concat('  owner_id Int?\\n  owner ', owner_class, '? @relation(fields: [owner_id], references: [id])\\n'), ''),"
        " '  items Item[]\\n}\\n')"
    )
    content = (
        f"CASE o_orderkey % 4 WHEN 0 THEN {sql} WHEN 1 THEN {sqlalchemy} WHEN 2 THEN {django} ELSE {prisma} END"
    )
    # Rendered once, below the explode: several gates read the content.
    file = F.expr(f"array(named_struct('path', {DDL_PATH}, 'content', {content}))")
    repo = F.expr(f"concat('repo', o_custkey % {REPOS})").alias("repo_id")
    return orders.select(repo, F.explode(file).alias("f")).select("repo_id", "f.path", "f.content")


# --- issues --------------------------------------------------------------------------


def order_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One issue per order; every eleventh is a pull request."""
    return table(spark, sf_dir, "orders").selectExpr(
        f"concat('repo', o_custkey % {REPOS}) AS repo_id",
        "o_orderkey AS number",
        "CASE o_orderpriority WHEN '1-URGENT' THEN concat('Crash in module ', o_custkey)"
        " WHEN '2-HIGH' THEN 'Readme typo' WHEN '3-MEDIUM' THEN 'Implement export'"
        " WHEN '4-NOT SPECIFIED' THEN NULL ELSE concat('Move things, item ', o_orderkey) END AS title",
        "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE"
        " concat(if(o_orderkey % 2 = 0, 'Steps to Reproduce: ', ''), if(o_orderkey % 5 = 0,"
        " 'OAuth migration design. ', ''), repeat('abcd efgh ', CAST(o_totalprice / 1000 AS INT)),"
        " if(o_orderkey % 7 = 0, repeat('see a.py ', 16), '')) END AS body",
        "CASE o_orderstatus WHEN 'F' THEN array(named_struct('name', 'Help Wanted'), named_struct('name', 'Enhancement'))"
        " WHEN 'O' THEN array(named_struct('name', 'Security'), named_struct('name', 'RFC')) ELSE NULL END AS labels",
        "CAST(o_orderkey % 4 AS INT) AS comments",
        "concat('https://example.org/i/', o_orderkey) AS html_url",
        "if(o_orderkey % 11 = 0, named_struct('url', 'https://example.org/p'), NULL) AS pull_request",
    )


def conversation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as an issue: its first sentence as title, all as body."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "role AS repo_id",
        "conv_id * 100 + turn AS number",
        "substring_index(text, '.', 1) AS title",
        "text AS body",
        "CASE turn % 3 WHEN 0 THEN array(named_struct('name', 'Docs'), named_struct('name', 'Bug')) ELSE NULL END AS labels",
        "CAST(turn AS INT) AS comments",
        "CAST(NULL AS STRING) AS html_url",
    )


def benchmark_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage as an issue of one of the document repositories."""
    return table(spark, sf_dir, "benchmark").selectExpr(
        "concat('src', item_id % 20) AS repo_id",
        "item_id AS number",
        "CAST(NULL AS STRING) AS title",
        "text AS body",
        "CAST(NULL AS ARRAY<STRUCT<name: STRING>>) AS labels",
        "0 AS comments",
        "CAST(NULL AS STRING) AS html_url",
    )


# --- sessions ------------------------------------------------------------------------


def test_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One test log per event; `error` events failed. The runner is event_id % 5."""
    passed = "event_id % 17"
    failed = "if(event_type = 'error', 1 + event_id % 3, 0)"
    output = (
        "CASE event_id % 5"
        f" WHEN 0 THEN concat('collected\\n===== ', {passed}, ' passed, ', {failed}, ' failed, ', event_id % 2, ' errors in 2s\\n99 passed')"
        f" WHEN 1 THEN concat('Tests: ', {passed}, ' PASSED, ', {failed}, ' Failed, 7 errors')"
        f" WHEN 2 THEN concat('test result: ok. ', {passed}, ' passed; ', {failed}, ' failed\\ntest result: ok. 50 passed; 50 failed')"
        f" WHEN 3 THEN concat(repeat('--- PASS: x\\n', CAST({passed} AS INT)), repeat('--- FAIL: y\\n', CAST({failed} AS INT)))"
        " ELSE '3 passed, 4 failed' END"
    )
    return table(spark, sf_dir, "events").selectExpr(
        "concat('s', user_id) AS session_id",
        "event_id AS attempt",
        "CASE event_id % 5 WHEN 0 THEN 'python -m pytest -v' WHEN 1 THEN 'npm test'"
        " WHEN 2 THEN 'cargo test' WHEN 3 THEN 'go test ./...' ELSE 'make check' END AS command",
        f"{output} AS output",
        "value AS duration_seconds",
        "event_type = 'signup' AND event_id % 10 = 3 AS timed_out",
    )


test_logs.__test__ = False


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('s', user_id) AS session_id",
        f"concat('repo', user_id % {REPOS}) AS repo_id",
        "user_id AS issue_number",
        "concat('contrib/', user_id, '-x') AS branch_name",
        "CASE WHEN event_id % 1009 = 0 THEN 'branch_failed' WHEN event_type = 'view' THEN 'start'"
        " WHEN event_type = 'purchase' THEN 'no_command' ELSE 'test' END AS event",
        "slice(array('a.py', 'b.py', 'c.py'), 1, CAST(event_id % 4 AS INT)) AS changed_files",
        "ts",
    )


def session_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One diff per user of the event stream, from a user's distinct id."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.selectExpr("concat('s', user_id) AS session_id", f"{diff_text('user_id')} AS diff")


def diff_text(key: str) -> str:
    """SQL text of a diff with 1 + key % 3 files, 2 added and 1 removed line in each."""
    one = (
        "concat('diff --git a/f', i, ' b/f', i, '\\n--- a/f', i, '\\n+++ b/f', i,"
        " '\\n@@ -1 +1 @@\\n-old\\n+new\\n+more\\n same\\n')"
    )
    return f"array_join(transform(sequence(0, CAST({key} % 3 AS INT)), i -> {one}), '')"


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('p', user_id) AS project_id",
        "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'analyzing'"
        " WHEN 'view' THEN 'ready' WHEN 'error' THEN 'error' ELSE 'bogus' END AS status",
        "if(event_type = 'error', props, NULL) AS error_message",
        "ts",
    )


# --- projects ------------------------------------------------------------------------


def part_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project per part, whose repository is that part's manifest repository."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat('pkg', p_partkey) AS project_id",
        "p_name AS name",
        "timestamp_seconds(1700000000 + p_partkey) AS created_at",
        "CASE WHEN p_partkey % 8 = 7 THEN 'error' ELSE 'ready' END AS status",
        "if(p_partkey % 8 = 7, 'bad manifest', NULL) AS error_message",
    )
