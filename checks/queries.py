"""Registered queries: every operator on a corpus rendered from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import corpus as K
from fleetfacts import schemas as S
from fleetfacts.functions import text as X
from fleetfacts.operators import (
    dbschema,
    dependencies,
    imports,
    inventory,
    issues,
    needles,
    overview,
    planning,
    search,
    sessions,
    technologies,
)
from fleetfacts.plans.staging import cut_lineage, staging_folder
from fleetfacts.sources import readers, writers
from fleetfacts.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

NEEDLES = [(1, None, "The"), (2, None, "license"), (3, "src3", "É"), (4, "src5", "tion")]


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def joined(column: str, sep: str = "|") -> F.Column:
    return F.array_join(column, sep).alias(column)


# --- sources -------------------------------------------------------------------------


def _raw_documents(spark, sf):
    broken = F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("FF")))
    content = F.when(F.col("doc_id") % 4 == 0, broken).otherwise(F.encode("text", "utf-8"))
    return K.table(spark, sf, "documents").select(
        F.col("source").alias("repo_id"), F.col("doc_id").cast("string").alias("path"),
        content.alias("content"),
    )


@query
def decode_ignore(spark, sf):
    decoded = inventory.decode_content(_raw_documents(spark, sf))
    return decoded.select("repo_id", "path", F.md5("content").alias("digest"))


@query
def decode_strict(spark, sf):
    decoded = inventory.decode_content(_raw_documents(spark, sf), "strict")
    return decoded.select("repo_id", "path", F.md5("content").alias("digest"))


@query
def undecodable_files(spark, sf):
    return inventory.undecodable_files(_raw_documents(spark, sf))


@query
def open_issues(spark, sf):
    """Issue JSON text read with the fixed schema, pull requests dropped."""
    json = K.order_issues(spark, sf).select(F.to_json(F.struct("*")).alias("json"))
    opened = issues.drop_pull_requests(readers.parse_issues(json, "json"))
    return opened.select(
        "repo_id", "number", "title", F.coalesce(F.length("body"), F.lit(-1)).alias("body_length"),
        F.array_join("labels.name", ",").alias("labels"), "comments",
    )


def _knowledge_text(spark, sf):
    part = K.table(spark, sf, "part")
    doc = F.struct(
        F.struct(
            F.concat(F.lit("pkg"), "p_partkey").alias("project_id"),
            F.col("p_name").alias("name"),
            F.when(F.col("p_partkey") % 10 == 3, "lost").otherwise("ready").alias("status"),
        ).alias("metadata"),
        F.array(
            F.struct(
                F.col("p_brand").alias("name"),
                F.lit("package.json").alias("source"),
                F.when(F.col("p_partkey") % 10 == 4, 1.1).otherwise(F.col("p_size") / 100).alias("confidence"),
            )
        ).alias("technologies"),
        F.array(
            F.struct(F.col("p_type").alias("name"), F.lit("npm").alias("ecosystem"), F.lit("package.json").alias("source")),
            F.struct(F.col("p_name").alias("name"), F.lit("pypi").alias("ecosystem"), F.lit("requirements.txt").alias("source")),
        ).alias("dependencies"),
    )
    text = F.to_json(doc)
    text = F.when(F.col("p_partkey") % 10 == 5, F.substring(text, 1, 40)).otherwise(text)
    return part.select(text.alias("json"))


def _knowledge(spark, sf):
    return readers.parse_knowledge_docs(_knowledge_text(spark, sf), "json")


@query
def knowledge_technologies(spark, sf):
    return readers.knowledge_tables(_knowledge(spark, sf))["technologies"].select(
        "repo_id", "name", "source", "confidence"
    )


@query
def knowledge_dependencies(spark, sf):
    return readers.knowledge_tables(_knowledge(spark, sf))["dependencies"].select(
        "repo_id", "name", "ecosystem", "source"
    )


@query
def knowledge_rejects(spark, sf):
    rejects = readers.knowledge_tables(_knowledge(spark, sf))["rejects"]
    return rejects.groupBy("reason").agg(F.count("*").alias("documents"))


@query
def read_issues(spark, sf):
    path = staging_folder(spark, "issues")
    K.order_issues(spark, sf).write.json(path, compression="gzip")
    opened = issues.drop_pull_requests(readers.read_issues(spark, path))
    return opened.select("repo_id", "number", "comments", "html_url")


@query
def read_test_logs(spark, sf):
    path = staging_folder(spark, "logs")
    K.test_logs(spark, sf).write.json(path, compression="gzip")
    return readers.read_test_logs(spark, path).withColumn("output", F.length("output"))


@query
def issue_rejects(spark, sf):
    """Some issues are cut off, some name no repository."""
    path = staging_folder(spark, "issues")
    key = F.col("number")
    repo = F.when(key % 17 != 0, F.col("repo_id"))
    text = K.order_issues(spark, sf).withColumn("repo_id", repo).select("number", F.to_json(F.struct("*")).alias("json"))
    cut = F.when(key % 13 == 0, F.substring("json", 1, 40)).otherwise(F.col("json"))
    text.select(cut.alias("json")).write.text(path, compression="gzip")
    return readers.read_rejects(spark, path, "issues").groupBy("reason").agg(F.count("*").alias("records"))


@query
def read_session_events(spark, sf):
    path = staging_folder(spark, "events")
    exact = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    events = K.session_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.option("timestampFormat", exact).json(path, compression="gzip")
    events = readers.read_session_events(spark, path)
    return events.select(
        "session_id", "event", F.unix_micros("ts").alias("micros"), F.array_join("changed_files", "|").alias("changed_files")
    )


@query
def read_knowledge_docs(spark, sf):
    path = staging_folder(spark, "docs")
    _knowledge_text(spark, sf).write.text(path, compression="gzip")
    return readers.knowledge_tables(readers.read_knowledge_docs(spark, path))["technologies"].select(
        "repo_id", "name", "source", "confidence"
    )


def _written_facts(spark, sf):
    """A fact table of all parts, then replaced for those of one type (some have none left)."""
    path = staging_folder(spark, "facts")
    part = K.table(spark, sf, "part")
    facts = part.selectExpr("concat('pkg', p_partkey) AS repo_id", "p_brand AS name", "p_type AS version")
    writers.write_facts(facts, path, buckets=16)
    promo = part.where("p_type = 'PROMO'").selectExpr(
        "concat('pkg', p_partkey) AS repo_id", "p_name AS name", "p_type AS version", "p_size"
    )
    writers.write_facts(promo.where("p_size > 10").drop("p_size"), path, promo.select("repo_id"), buckets=16)
    return path


@query
def write_facts(spark, sf):
    return writers.read_facts(spark, _written_facts(spark, sf), buckets=16)


@query
def compact_facts(spark, sf):
    """The same after its batches have become one."""
    path = _written_facts(spark, sf)
    writers.compact_facts(spark, path, buckets=16)
    writers.vacuum_facts(spark, path)
    return writers.read_facts(spark, path, buckets=16)


@query
def incremental_dependencies(spark, sf):
    """Manifests land in three steps; each step is analysed as a stream that stops when done.

    First early manifests as they are and empty late ones; then the late ones are changed and the
    early ones deleted; then the early ones come back.
    """
    landed, facts, mark = (staging_folder(spark, n) for n in ("files", "facts", "mark"))
    files = K.manifest_files(spark, sf)
    early = F.col("path").isin("package.json", "go.mod")
    empty = F.when(early, F.col("content")).otherwise("").alias("content")
    steps = (
        files.select("repo_id", "path", empty),
        files.withColumn("deleted", early),
        files.where(early),
    )
    for version, step in enumerate(steps, 1):
        writers.land_files(step.withColumn("version", F.lit(version).cast("long")), landed, mode="append", buckets=16)
        stream = incremental.start_incremental(
            spark, landed, facts, mark, tables=["dependencies"], buckets=16
        )
        stream.awaitTermination()
    return writers.read_facts(spark, f"{facts}/dependencies", buckets=16)


# --- filters and scalar functions ----------------------------------------------------


@query
def read_repo_files(spark, sf):
    """The documents, written as checkouts and read back."""
    folder = staging_folder(spark, "checkouts")
    K.write_checkouts(spark, sf, folder)
    raw = readers.read_repo_files(spark, folder)
    return raw.select("repo_id", "path", "size_bytes", F.sha2("content", 256).alias("content_sha256"))


@query
def exclude_vendored(spark, sf):
    return inventory.exclude_vendored(K.page_files(spark, sf)).select("repo_id", "path")


@query
def exclude_vendored_dirs(spark, sf):
    return inventory.exclude_vendored(K.page_files(spark, sf), False).select("repo_id", "path")


@query
def file_inventory(spark, sf):
    return inventory.file_inventory(K.document_files(spark, sf))


@query
def important_files(spark, sf):
    return inventory.file_inventory(K.manifest_files(spark, sf)).where("is_important").select(
        "repo_id", "path", "extension"
    )


@query
def parse_requirement(spark, sf):
    line = F.expr(
        "CASE p_size % 4 WHEN 0 THEN concat(' My_', p_brand, ' ') WHEN 1 THEN concat('Lib_', p_size, '[a,b] >=1.', p_size)"
        " WHEN 2 THEN concat('pkg.sub~=', p_size, ' ; python_version > \"3\"') ELSE concat('git+https://x/', p_name) END"
    )
    part = K.table(spark, sf, "part").select("p_partkey", line.alias("line"))
    return part.select(
        "p_partkey",
        X.requirement_name(F.col("line")).alias("name"),
        X.requirement_spec(F.col("line")).alias("spec"),
    )


@query
def version_number(spark, sf):
    return K.table(spark, sf, "events").select(
        "event_id",
        X.version_number(F.concat(F.lit("~>"), F.col("event_type"), "props", F.lit(".4.2-x"))).alias("version"),
    )


@query
def normalise_sql_type(spark, sf):
    raw = F.expr("concat(' ', lower(p_type), CASE p_size % 3 WHEN 0 THEN '(10, 2)' WHEN 1 THEN ' varying' ELSE '' END)")
    return K.table(spark, sf, "part").select("p_partkey", X.normalise_sql_type(raw).alias("sql_type"))


@query
def repo_slug(spark, sf):
    url = F.concat("url", F.expr("CASE page_id % 3 WHEN 0 THEN '.git' WHEN 1 THEN '/' ELSE '/--' END"))
    return K.table(spark, sf, "pages").select("page_id", X.repo_slug(url).alias("slug"))


@query
def owner_repo(spark, sf):
    url = F.expr(
        "concat(CASE p_partkey % 4 WHEN 0 THEN 'https://github.com/' WHEN 1 THEN 'git@github.com:'"
        " WHEN 2 THEN ' http://www.github.com/' ELSE 'https://example.org/' END,"
        " p_type, '/', replace(p_name, ' ', '-'), CASE p_partkey % 3 WHEN 0 THEN '.git' WHEN 1 THEN '/' ELSE '/tree/x' END)"
    )
    parsed = K.table(spark, sf, "part").select("p_partkey", X.owner_repo(url).alias("o"))
    return parsed.select("p_partkey", "o.owner", "o.repo")


@query
def branch_name(spark, sf):
    issue = K.conversation_issues(spark, sf)
    return issue.select("number", X.branch_name(F.col("number"), F.col("title")).alias("branch"))


@query
def format_size(spark, sf):
    size = F.expr("CAST(CASE l_linenumber % 3 WHEN 0 THEN l_quantity * 20 WHEN 1 THEN l_extendedprice ELSE l_extendedprice * 100 END AS BIGINT)")
    sized = K.table(spark, sf, "lineitem").select(size.alias("bytes")).groupBy("bytes").agg(F.count("*").alias("n"))
    return sized.select("bytes", X.format_size(F.col("bytes")).alias("size"), "n")


@query
def confidence_band(spark, sf):
    band = X.confidence_band(F.col("l_discount") * 10)
    return K.table(spark, sf, "lineitem").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query
def diff_stat(spark, sf):
    diff = F.expr(K.diff_text("o_orderkey"))
    return K.table(spark, sf, "orders").select("o_orderkey", X.diff_stat(diff).alias("diff_stat"))


@query
def commit_message(spark, sf):
    issue = issues.analyze_issues(K.order_issues(spark, sf))
    title = F.when(F.col("issue_number") % 3 == 0, F.repeat("title", 4)).otherwise(F.col("title"))
    return issue.select(
        "repo_id", "issue_number",
        X.commit_message(F.col("issue_number"), title, F.col("type")).alias("message"),
    )


# --- technologies --------------------------------------------------------------------


def _evidence_query(name: str, fn) -> None:
    def run(spark, sf):
        return fn(K.manifest_files(spark, sf)).select("repo_id", "name", "version", "source", "confidence")

    run.__name__ = name
    query(run)


_evidence_query("npm_evidence", technologies.npm_evidence)
_evidence_query("pyproject_evidence", technologies.pyproject_evidence)
_evidence_query("requirements_evidence", technologies.requirements_evidence)
_evidence_query("go_evidence", technologies.go_evidence)
_evidence_query("rust_evidence", technologies.rust_evidence)
_evidence_query("docker_evidence", technologies.docker_evidence)
_evidence_query(
    "workflow_evidence",
    lambda files: technologies.workflow_evidence(inventory.exclude_vendored(files, False)),
)
_evidence_query(
    "extension_evidence",
    lambda files: technologies.extension_evidence(inventory.exclude_vendored(files, False)),
)


@query
def detect_technologies(spark, sf):
    return technologies.detect_technologies(K.manifest_files(spark, sf))


def _lineitem_evidence(spark, sf):
    return K.table(spark, sf, "lineitem").selectExpr(
        "concat('s', l_suppkey) AS repo_id",
        "concat(l_returnflag, l_linestatus) AS name",
        "if(l_linenumber % 2 = 0, CAST(l_orderkey % 50 AS STRING), NULL) AS version",
        "concat('o', l_orderkey) AS source",
        "(l_orderkey % 7 + l_linenumber) / 20 AS confidence",
        "l_orderkey * 10 + l_linenumber AS seq",
    )


@query
def merge_evidence(spark, sf):
    return technologies.merge_evidence(_lineitem_evidence(spark, sf))


@query
def unique_technologies(spark, sf):
    return technologies.unique_technologies(_lineitem_evidence(spark, sf))


# --- dependencies --------------------------------------------------------------------


def _dependency_query(name: str, fn) -> None:
    def run(spark, sf):
        return fn(K.manifest_files(spark, sf))

    run.__name__ = name
    query(run)


_dependency_query("npm_dependencies", dependencies.npm_dependencies)
_dependency_query("requirements_dependencies", dependencies.requirements_dependencies)
_dependency_query("pyproject_dependencies", dependencies.pyproject_dependencies)
_dependency_query("go_dependencies", dependencies.go_dependencies)
_dependency_query("cargo_dependencies", dependencies.cargo_dependencies)
_dependency_query("extract_dependencies", dependencies.extract_dependencies)


@query
def dependencies_by_ecosystem(spark, sf):
    grouped = dependencies.dependencies_by_ecosystem(
        dependencies.extract_dependencies(K.manifest_files(spark, sf))
    )
    entry = lambda d: F.concat(d["name"], F.lit(" "), F.coalesce(d["version"], F.lit("-")))
    return grouped.select(
        "repo_id", "ecosystem", "dependency_count",
        F.array_join(F.transform("dependencies", entry), "|").alias("dependencies"),
    )


def _lineitem_dependencies(spark, sf):
    lineitem = K.table(spark, sf, "lineitem").join(
        K.table(spark, sf, "part").select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey")
    )
    return lineitem.selectExpr(
        "concat('s', l_suppkey) AS repo_id", "p_brand AS name",
        "CAST(CAST(l_quantity AS INT) AS STRING) AS version", "l_returnflag AS ecosystem",
        "'package.json' AS source",
    )


@query
def fleet_dependency_versions(spark, sf):
    return dependencies.fleet_dependency_versions(_lineitem_dependencies(spark, sf))


@query
def dependency_version_usage(spark, sf):
    return dependencies.dependency_version_usage(_lineitem_dependencies(spark, sf))


# --- imports -------------------------------------------------------------------------


@query
def python_imports(spark, sf):
    return imports.python_imports(K.import_files(spark, sf))


@query
def resolve_python_imports(spark, sf):
    files = K.import_files(spark, sf)
    edges = imports.resolve_python_imports(imports.python_imports(files), files)
    return edges.select("repo_id", "from_component", "to_component")


@query
def ts_imports(spark, sf):
    return imports.ts_imports(K.import_files(spark, sf))


@query
def resolve_ts_imports(spark, sf):
    files = K.import_files(spark, sf)
    edges = imports.resolve_ts_imports(imports.ts_imports(files), files)
    return edges.select("repo_id", "from_component", "to_component")


@query
def import_edges(spark, sf):
    return imports.import_edges(K.import_files(spark, sf))


@query
def graph_nodes(spark, sf):
    return imports.graph_nodes(imports.import_edges(K.import_files(spark, sf)))


@query
def architecture(spark, sf):
    return imports.architecture(imports.import_edges(K.import_files(spark, sf)), ["repo3", "repo7"])


# --- database schemas ----------------------------------------------------------------


@query
def schema_candidates(spark, sf):
    return dbschema.schema_candidates(K.schema_files(spark, sf)).drop("content")


def _models(spark, sf, dialects=tuple(dbschema.PARSERS)):
    return dbschema.schema_models(K.schema_files(spark, sf), dialects)


def _model_query(source_type: str) -> None:
    def tables(spark, sf):
        models = _models(spark, sf, [source_type])
        return models.where("is_table").select("repo_id", "name", "source", "confidence")

    def columns(spark, sf):
        models = _models(spark, sf, [source_type])
        return models.select("repo_id", "source", F.col("name").alias("table_name"), F.inline("columns"))

    def relationships(spark, sf):
        found = dbschema.declared_relationships(_models(spark, sf, [source_type]))
        return found.select(
            "repo_id", "source", "from_table", "from_column", "to_table", "to_column",
            "relationship_type", "inferred",
        )

    for fn in (tables, columns, relationships):
        fn.__name__ = f"{source_type}_{fn.__name__}"
        query(fn)


for _kind in ("sql", "sqlalchemy", "django", "prisma"):
    _model_query(_kind)


@query
def dedupe_tables(spark, sf):
    tables = dbschema.schema_tables(_models(spark, sf))
    return tables.withColumn("column_count", F.size("columns")).drop("columns")


@query
def schema_columns(spark, sf):
    return dbschema.schema_columns(dbschema.schema_tables(_models(spark, sf)))


@query
def dedupe_relationships(spark, sf):
    return dbschema.schema_relationships(_models(spark, sf))


@query
def schema_overview(spark, sf):
    models = cut_lineage(_models(spark, sf), "models")
    repositories = K.table(spark, sf, "nation").selectExpr("concat('repo', n_nationkey) AS repo_id")
    return dbschema.schema_overview(
        repositories, dbschema.schema_tables(models), dbschema.schema_relationships(models)
    )


# --- search and ranking --------------------------------------------------------------


@query
def code_search(spark, sf):
    return search.code_search(K.document_files(spark, sf), NEEDLES, max_matches=50)


@query
def code_search_all(spark, sf):
    found = search.code_search(K.document_files(spark, sf), NEEDLES, max_matches=None)
    return found.groupBy("repo_id", "query_id", "path").agg(
        F.count("*").alias("matches"), F.min("line").alias("first_line")
    )


@query
def code_search_first_matches(spark, sf):
    return search.code_search(K.document_files(spark, sf), NEEDLES[:2], max_matches=5)


@query
def search_queries(spark, sf):
    """Three-word phrases of all benchmark texts, asked of all documents or of those of one source."""
    return needles.search_queries(K.document_files(spark, sf), K.search_queries(spark, sf)).drop("truncated")


@query
def search_queries_first_matches(spark, sf):
    asked = spark.createDataFrame(NEEDLES, "query_id INT, repo_id STRING, needle STRING")
    return needles.search_queries(K.document_files(spark, sf), asked, max_matches=50)


@query
def extract_keywords(spark, sf):
    turns = K.table(spark, sf, "conversations")
    return search.extract_keywords(turns, ["conv_id", "turn"], F.col("text"))


@query
def issue_keywords(spark, sf):
    return search.issue_keywords(K.benchmark_issues(spark, sf))


@query
def score_files(spark, sf):
    keywords = search.issue_keywords(K.benchmark_issues(spark, sf))
    scored = search.score_files(keywords, K.document_files(spark, sf))
    return scored.select("repo_id", "number", "path", "score", "in_path")


@query
def top_files_per_issue(spark, sf):
    keywords = search.issue_keywords(K.benchmark_issues(spark, sf))
    return search.top_files_per_issue(keywords, K.document_files(spark, sf))


@query
def top_files_heavy_keywords(spark, sf):
    """The same with so low a limit that common keywords make no pairs."""
    keywords = search.issue_keywords(K.benchmark_issues(spark, sf))
    return search.top_files_per_issue(keywords, K.document_files(spark, sf), heavy_term=3)


# --- issues --------------------------------------------------------------------------


def _flat(analysis: DataFrame) -> DataFrame:
    return analysis.select(
        *[joined(c) if c in ("reasons", "concerns", "labels") else c for c in analysis.columns]
    )


@query
def analyze_issues(spark, sf):
    return _flat(issues.analyze_issues(K.conversation_issues(spark, sf)))


@query
def analyze_order_issues(spark, sf):
    return _flat(issues.analyze_issues(K.order_issues(spark, sf)))


@query
def issue_type(spark, sf):
    return issues.analyze_issues(K.order_issues(spark, sf)).groupBy("repo_id", "type").agg(F.count("*").alias("n"))


@query
def issue_scope(spark, sf):
    return issues.analyze_issues(K.order_issues(spark, sf)).groupBy("repo_id", "scope").agg(F.count("*").alias("n"))


@query
def issue_reasons(spark, sf):
    analysis = issues.analyze_issues(K.order_issues(spark, sf))
    return analysis.select("repo_id", "issue_number", joined("reasons"))


@query
def issue_concerns(spark, sf):
    analysis = issues.analyze_issues(K.order_issues(spark, sf))
    return analysis.select("repo_id", "issue_number", joined("concerns"))


@query
def issue_board(spark, sf):
    return _flat(issues.issue_board(issues.analyze_issues(K.order_issues(spark, sf))))


# --- planning ------------------------------------------------------------------------


def _part_repositories(spark, sf):
    return K.table(spark, sf, "part").selectExpr("concat('pkg', p_partkey) AS repo_id")


@query
def test_command(spark, sf):
    files = K.manifest_files(spark, sf)
    return planning.test_command(
        _part_repositories(spark, sf), technologies.detect_technologies(files),
        dependencies.extract_dependencies(files), files,
    )


@query
def test_hint(spark, sf):
    files = K.manifest_files(spark, sf)
    return planning.test_hint(
        _part_repositories(spark, sf), technologies.detect_technologies(files),
        dependencies.extract_dependencies(files),
    )


def _plan_inputs(spark, sf):
    raw = K.benchmark_issues(spark, sf)
    files = K.document_files(spark, sf)
    ranked = search.top_files_per_issue(search.issue_keywords(raw), files)
    repositories = files.select("repo_id").distinct()
    hints = planning.test_hint(
        repositories, technologies.detect_technologies(files), dependencies.extract_dependencies(files)
    )
    return issues.analyze_issues(raw), ranked, hints


@query
def plan_steps(spark, sf):
    return planning.plan_steps(*_plan_inputs(spark, sf))


@query
def issue_plans(spark, sf):
    plans = planning.issue_plans(*_plan_inputs(spark, sf))
    return plans.withColumn("relevant_files", F.array_join("relevant_files", "|"))


# --- sessions ------------------------------------------------------------------------


def _runs(spark, sf):
    return sessions.parse_test_logs(K.test_logs(spark, sf))


@query
def parse_test_logs(spark, sf):
    return _runs(spark, sf).withColumn("output", F.length("output"))


@query
def session_totals(spark, sf):
    return sessions.session_totals(_runs(spark, sf))


@query
def session_attempts(spark, sf):
    return sessions.session_attempts(_runs(spark, sf))


def _states(spark, sf):
    inventory_ = inventory.file_inventory(K.schema_files(spark, sf))
    return sessions.session_state(K.session_events(spark, sf), _runs(spark, sf), inventory_)


@query
def session_state(spark, sf):
    return _states(spark, sf).withColumn("changed_files", joined("changed_files"))


def _reports(spark, sf):
    return sessions.session_report(
        _states(spark, sf), sessions.session_totals(_runs(spark, sf)),
        K.session_diffs(spark, sf), K.order_issues(spark, sf),
    )


@query
def session_report(spark, sf):
    return _reports(spark, sf).withColumn("changed_files", joined("changed_files"))


@query
def report_draft(spark, sf):
    return _reports(spark, sf).select("session_id", "draft")


@query
def project_status(spark, sf):
    return sessions.project_status(K.status_events(spark, sf))


# --- projects ------------------------------------------------------------------------


@query
def project_overview(spark, sf):
    files = K.manifest_files(spark, sf)
    result = overview.project_overview(
        K.part_projects(spark, sf), inventory.file_inventory(files),
        technologies.detect_technologies(files), dependencies.extract_dependencies(files),
    )
    return result.withColumn("technologies", F.array_join("technologies", "|"))


@query
def list_projects(spark, sf):
    files = K.manifest_files(spark, sf)
    result = overview.project_overview(
        K.part_projects(spark, sf), inventory.file_inventory(files),
        technologies.detect_technologies(files), dependencies.extract_dependencies(files),
    )
    return overview.list_projects(result).select("project_id", "name", "status", "created_at", "file_count")


@query
def repository_tree(spark, sf):
    return inventory.repository_tree(inventory.file_inventory(K.document_files(spark, sf)), ["src1", "src4"])


@query
def directory_rollup(spark, sf):
    return inventory.directory_rollup(K.page_files(spark, sf))


@query
def tree_nodes(spark, sf):
    return inventory.tree_nodes(K.page_files(spark, sf))


@query
def snapshot_changes(spark, sf):
    """Spanish documents come, German ones go, two repositories are edited throughout."""
    files = K.document_files(spark, sf)
    edited = F.when(F.col("repo_id").isin("src3", "src7"), F.concat("content", F.lit("x")))
    old = files.where("lang <> 'es'")
    new = files.where("lang <> 'de'").withColumn("content", F.coalesce(edited, "content"))
    return inventory.snapshot_changes(old, new)
