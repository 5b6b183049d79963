"""Test logs, contribution sessions and project status.

Sessions are summed with map-side combine and their last state is an arg-max, so a session
or project with very many events is never gathered in one place. Attempts stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfacts import constants as C
from fleetfacts.functions import text as X

TERMINAL = ["DONE", "FAILED"]


def _number(output: Column, pattern: str) -> Column:
    found = X.extract(output, pattern)
    return F.when(found.isNull(), F.lit(0).cast("bigint")).otherwise(found.try_cast("bigint"))


def _marks(output: Column, mark: str) -> Column:
    return F.regexp_count(output, F.lit(mark)).cast("bigint")


def parse_test_logs(logs: DataFrame) -> DataFrame:
    """Passed, failed and error counts by the runner named in the command.

    pytest reports three counts; npm two, in any case; cargo two; go prints one mark per
    test. A runner's count that no bigint holds is null. The whole output is kept.
    """
    out, command = F.col("output"), F.col("command")
    pytest = command.contains("pytest")
    npm = command.contains("npm test")
    cargo = command.contains("cargo test")
    go = command.contains("go test")
    zero = F.lit(0).cast("bigint")

    def counted(word: str, mark: str) -> Column:
        return (
            F.when(pytest | (~npm & cargo), _number(out, rf"(\d+) {word}"))
            .when(npm, _number(out, rf"(?i)(\d+) {word}"))
            .when(go, _marks(out, mark))
            .otherwise(zero)
        )

    errors = F.when(pytest, _number(out, r"(\d+) error")).otherwise(zero)
    return logs.select(
        "session_id",
        "attempt",
        "command",
        counted("passed", "--- PASS").alias("passed"),
        counted("failed", "--- FAIL").alias("failed"),
        errors.alias("errors"),
        "output",
        F.round("duration_seconds", 2).alias("duration_seconds"),
        "timed_out",
    )


def session_totals(runs: DataFrame) -> DataFrame:
    """Counters per session over its parsed test runs."""
    tests = F.col("passed") + F.col("failed") + F.col("errors")
    return runs.groupBy("session_id").agg(
        F.sum(tests).alias("tests_run"),
        F.sum("passed").alias("tests_passed"),
        F.sum("failed").alias("tests_failed"),
        F.count("*").alias("test_runs"),
    )


def session_attempts(runs: DataFrame) -> DataFrame:
    """Attempt history as rows; order by (session_id, attempt) to read it."""
    return runs.select(
        "session_id", "attempt", "passed", "failed", "errors", "duration_seconds", "timed_out",
        (F.col("failed") == 0).alias("shown_as_passed"),
    )


def last_runs(runs: DataFrame) -> DataFrame:
    """Outcome of each session's last run; fixed-width buffers keep this a hash aggregate."""
    fields = ["passed", "failed", "errors", "timed_out"]
    return runs.groupBy("session_id").agg(
        F.max("attempt").alias("attempt"),
        *[F.max_by(f, "attempt").alias(f) for f in fields],
    )


def session_state(
    events: DataFrame, runs: DataFrame, inventory: DataFrame | None = None
) -> DataFrame:
    """Where each session stands: the outcome of its last deciding event.

    Events: `start`, `branch_failed`, `test` (a test request) and `no_command` (a request in a
    repository without a runner). A failed branch fails the session; a passing, timed-out or
    impossible run completes it; a failing run returns it to guiding. `finished_at` is the
    time of the event that ended the session; `changed_files` are those of its last request,
    null before the first.
    """
    is_run = F.col("event").isin("test", "no_command")
    decides = is_run | (F.col("event") == "branch_failed")
    latest = events.groupBy("session_id").agg(
        F.max("repo_id").alias("repo_id"),
        F.max("issue_number").alias("issue_number"),
        F.max("branch_name").alias("branch_name"),
        F.max(F.when(decides, F.struct("ts", "event"))).alias("last"),
        F.max_by(F.size("changed_files"), F.when(is_run, F.col("ts"))).alias("files_modified"),
        F.max_by("changed_files", F.when(is_run, F.col("ts"))).alias("changed_files"),
        F.min("ts").alias("started_at"),
    )
    passed = F.col("timed_out") | ((F.col("failed") == 0) & (F.col("errors") == 0))
    state = (
        F.when(F.col("last.event") == "branch_failed", "FAILED")
        .when(F.col("last.event") == "no_command", "DONE")
        .when((F.col("last.event") == "test") & passed, "DONE")
        .otherwise("GUIDING")
    )
    joined = latest.join(last_runs(runs), "session_id", "left")
    if inventory is not None:
        counted = inventory.groupBy("repo_id").agg(F.count("*").alias("files_analyzed"))
        joined = joined.join(counted, "repo_id", "left")
    else:
        joined = joined.withColumn("files_analyzed", F.lit(0).cast("bigint"))
    return joined.withColumn("state", state).select(
        "session_id",
        "repo_id",
        "issue_number",
        "branch_name",
        "state",
        F.coalesce("files_analyzed", F.lit(0)).alias("files_analyzed"),
        F.coalesce("files_modified", F.lit(0)).alias("files_modified"),
        "changed_files",
        "started_at",
        F.when(F.col("state").isin(TERMINAL), F.col("last.ts")).alias("finished_at"),
    )


def report_draft(
    number: Column,
    title: Column,
    branch: Column,
    files_modified: Column,
    tests_run: Column,
    tests_passed: Column,
    tests_failed: Column,
    attempts: Column,
) -> Column:
    """Markdown draft of the report on a session."""

    def text(column: Column) -> Column:
        return column.cast("string")

    tests_line = F.when(
        tests_run > 0,
        F.concat(
            F.lit("- "), text(tests_passed), F.lit(" test(s) passed, "),
            text(tests_failed), F.lit(" failed"),
        ),
    ).otherwise("- No test suite detected")
    attempts_line = F.when(
        attempts > 0, F.concat(F.lit("- Verification attempts: "), text(attempts))
    ).otherwise("")
    return X.strip(
        F.concat(
            F.lit("## Summary\n\n<!-- One-sentence summary of the change -->\nAddresses issue #"),
            text(number),
            F.lit(": "),
            F.coalesce(title, F.lit("")),
            F.lit(
                "\n\n## Problem\n\n<!-- Describe what the issue reported -->\n\n## Changes\n\n"
                "<!-- List each changed file and what was modified -->\n- Branch: `"
            ),
            branch,
            F.lit("`\n- Files modified: "),
            text(files_modified),
            F.lit("\n\n## Testing\n\n"),
            tests_line,
            F.lit("\n"),
            attempts_line,
            F.lit("\n\n## Related Issue\n\nCloses #"),
            text(number),
        )
    )


def session_report(
    states: DataFrame, totals: DataFrame, diffs: DataFrame, issues: DataFrame
) -> DataFrame:
    """Report of each finished session; an unknown issue has an empty title."""
    zero = F.lit(0)
    titles = issues.select("repo_id", F.col("number").alias("issue_number"), "title")
    joined = (
        states.where(F.col("state").isin(TERMINAL))
        .join(totals, "session_id", "left")
        .join(diffs.select("session_id", "diff"), "session_id", "left")
        .join(titles, ["repo_id", "issue_number"], "left")
        .withColumn("title", F.coalesce("title", F.lit("")))
    )
    counters = ["tests_run", "tests_passed", "tests_failed", "test_runs"]
    joined = joined.na.fill(0, counters)
    return joined.select(
        "session_id",
        "repo_id",
        "issue_number",
        F.col("title").alias("issue_title"),
        "branch_name",
        "state",
        X.diff_stat(F.coalesce("diff", F.lit(""))).alias("diff_stat"),
        report_draft(
            F.col("issue_number"), F.col("title"), F.col("branch_name"),
            F.coalesce("files_modified", zero), F.col("tests_run"), F.col("tests_passed"),
            F.col("tests_failed"), F.col("test_runs"),
        ).alias("draft"),
        "files_analyzed",
        "files_modified",
        "changed_files",
        *counters,
        "started_at",
        "finished_at",
    )


def project_status(status_events: DataFrame) -> DataFrame:
    """Latest status and error message per project."""
    last = F.max_by(F.struct("status", "error_message"), "ts")
    return (
        status_events.where(F.col("status").isin(C.PROJECT_STATUSES))
        .groupBy("project_id")
        .agg(last.alias("l"), F.max("ts").alias("updated_at"))
        .select("project_id", "l.status", "l.error_message", "updated_at")
    )
