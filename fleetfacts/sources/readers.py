"""Readers for landed files, issues, project documents, session events and test logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfacts import constants as C
from fleetfacts import schemas as S
from fleetfacts.sources.checkouts import list_repo_files, read_repo_files  # noqa: F401


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed file table."""
    return spark.read.parquet(path)


# Schema and keys of each kind of record; one without a key is a reject.
RECORDS = {
    "issues": (S.ISSUES, ["repo_id", "number"]),
    "test_logs": (S.TEST_LOGS, ["session_id", "attempt"]),
    "session_events": (S.SESSION_EVENTS, ["session_id", "event", "ts"]),
}


def _read_json(spark: SparkSession, path: str, kind: str, whole_files: bool) -> DataFrame:
    """Records and their first fault in `reason`, null when valid.

    One object or array a line; with `whole_files` a file is one object or array over any lines.
    """
    records = (
        spark.read.schema(f"{RECORDS[kind][0]}, _corrupt STRING")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("multiLine", whole_files)
        .json(path)
    )
    return _with_reason(records, kind)


def _with_reason(records: DataFrame, kind: str) -> DataFrame:
    reason = F.when(F.col("_corrupt").isNotNull(), "unreadable")
    for key in RECORDS[kind][1]:
        reason = reason.when(F.col(key).isNull(), f"no {key}")
    return records.withColumn("reason", reason)


def _valid(checked: DataFrame) -> DataFrame:
    return checked.where("reason IS NULL").drop("_corrupt", "reason")


def read_rejects(spark: SparkSession, path: str, kind: str, whole_files: bool = False) -> DataFrame:
    """(record, reason) of the records that the reader of this kind leaves out."""
    checked = _read_json(spark, path, kind, whole_files).where("reason IS NOT NULL")
    fields = [c for c in checked.columns if c not in ("_corrupt", "reason")]
    return checked.select(
        F.coalesce("_corrupt", F.to_json(F.struct(*fields))).alias("record"), "reason"
    )


def read_issues(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Valid issues of exported JSON."""
    return _valid(_read_json(spark, path, "issues", whole_files))


def parse_issues(texts: DataFrame, column: str) -> DataFrame:
    """Valid issues from a column of JSON objects, with the same schema as `read_issues`."""
    options = {"columnNameOfCorruptRecord": "_corrupt"}
    parsed = F.from_json(column, f"{S.ISSUES}, _corrupt STRING", options)
    return _valid(_with_reason(texts.select(parsed.alias("i")).select("i.*"), "issues"))


def read_test_logs(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    return _valid(_read_json(spark, path, "test_logs", whole_files))


def read_session_events(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    return _valid(_read_json(spark, path, "session_events", whole_files))


def read_knowledge_docs(spark: SparkSession, path: str) -> DataFrame:
    """Whole-project JSON documents, one per line, with unreadable text in `_corrupt`."""
    return (
        spark.read.schema(S.KNOWLEDGE_DOC)
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )


def parse_knowledge_docs(texts: DataFrame, column: str) -> DataFrame:
    """Project documents from a column of JSON objects, as `read_knowledge_docs`."""
    options = {"columnNameOfCorruptRecord": "_corrupt"}
    return texts.select(F.from_json(column, S.KNOWLEDGE_DOC, options).alias("d")).select("d.*")


def _bad_confidence(facts: str) -> Column:
    outside = lambda f: (f["confidence"] < 0) | (f["confidence"] > 1)
    return F.coalesce(F.exists(facts, outside), F.lit(False))


def document_errors(docs: DataFrame) -> DataFrame:
    """Documents with their first violated constraint in `reason` (null when valid)."""
    status = F.col("metadata.status")
    reason = (
        F.when(
            F.col("_corrupt").isNotNull() | F.col("metadata.project_id").isNull(), "unreadable"
        )
        .when(~F.coalesce(status, F.lit("pending")).isin(C.PROJECT_STATUSES), "unknown status")
        .when(
            _bad_confidence("technologies")
            | _bad_confidence("relationships")
            | _bad_confidence("database.tables"),
            "confidence outside [0, 1]",
        )
    )
    return docs.withColumn("reason", reason)


def knowledge_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of the valid documents, and `rejects` for the others."""
    checked = document_errors(docs)
    valid = checked.where("reason IS NULL").withColumn("repo_id", F.col("metadata.project_id"))

    def exploded(column: str) -> DataFrame:
        return valid.select("repo_id", F.inline(column))

    tables = valid.select("repo_id", F.inline("database.tables"))
    return {
        "projects": valid.select("metadata.*"),
        "repositories": valid.select("repo_id", "repository.*"),
        "technologies": exploded("technologies"),
        "dependencies": exploded("dependencies"),
        "file_inventory": exploded("files"),
        "components": exploded("components"),
        "import_edges": exploded("relationships"),
        "schema_tables": tables,
        "schema_columns": tables.select(
            "repo_id", F.col("name").alias("table_name"), F.posexplode("columns")
        ).select("repo_id", "table_name", F.col("pos").alias("ordinal"), "col.*"),
        "schema_relationships": valid.select("repo_id", F.inline("database.relationships")),
        "rejects": checked.where("reason IS NOT NULL").select(
            F.col("metadata.project_id").alias("project_id"), "reason"
        ),
    }
