"""Test commands and contribution plans.

Facts are reduced to flags per repository before they are joined, so the joins carry one row
per repository and one row per issue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfacts.functions import text as X
from fleetfacts.operators.technologies import manifests, section

DEFAULT_TEST_FILE = "tests/test_something.py"


def _technology_flags(technologies: DataFrame) -> DataFrame:
    def has(*names: str) -> Column:
        return F.bool_or(F.lower("name").isin(*names))

    return technologies.groupBy("repo_id").agg(
        has("python").alias("python"),
        has("node.js", "javascript", "typescript").alias("node"),
        has("rust").alias("rust"),
        has("go").alias("go"),
    )


def _dependency_flags(dependencies: DataFrame) -> DataFrame:
    return dependencies.groupBy("repo_id").agg(
        F.bool_or(F.lower("name") == "pytest").alias("pytest_dependency")
    )


def _flags(repositories: DataFrame, *facts: DataFrame) -> DataFrame:
    joined = repositories.select("repo_id")
    for fact in facts:
        joined = joined.join(fact, "repo_id", "left")
    flags = [c for c in joined.columns if c != "repo_id"]
    return joined.na.fill(False, flags)


def test_command(
    repositories: DataFrame, technologies: DataFrame, dependencies: DataFrame, files: DataFrame
) -> DataFrame:
    """Command that runs a repository's tests; null when no supported runner is found."""
    texts = (
        files.where(F.col("path").isin("requirements.txt", "pyproject.toml"))
        .groupBy("repo_id")
        .agg(F.bool_or(F.lower("content").contains("pytest")).alias("pytest_text"))
    )
    scripts = manifests(files, ["package.json"]).select(
        "repo_id", F.map_contains_key(section("scripts"), "test").alias("npm_test")
    )
    flags = _flags(
        repositories,
        _technology_flags(technologies),
        _dependency_flags(dependencies),
        texts,
        scripts,
    )
    command = (
        F.when(
            F.col("python") & (F.col("pytest_dependency") | F.col("pytest_text")),
            "python -m pytest -v",
        )
        .when(F.col("python"), "python -m unittest discover")
        .when(F.col("node") & F.col("npm_test"), "npm test")
        .when(F.col("rust"), "cargo test")
        .when(F.col("go"), "go test ./...")
    )
    return flags.select("repo_id", command.alias("test_command"))


def test_hint(
    repositories: DataFrame, technologies: DataFrame, dependencies: DataFrame
) -> DataFrame:
    """Test command as shown to a person, from facts alone."""
    flags = _flags(
        repositories, _technology_flags(technologies), _dependency_flags(dependencies)
    )
    hint = (
        F.when(F.col("python") & F.col("pytest_dependency"), "pytest")
        .when(F.col("python"), "python -m unittest")
        .when(F.col("node"), "npm test")
        .when(F.col("rust"), "cargo test")
        .when(F.col("go"), "go test ./...")
        .otherwise("the project's test suite")
    )
    return flags.select("repo_id", hint.alias("test_hint"))


test_command.__test__ = False
test_hint.__test__ = False


def _with_files(analysis: DataFrame, issue_files: DataFrame, hints: DataFrame) -> DataFrame:
    """Issue analysis with its ranked paths (at most the ranking's top-k) and its hint."""
    paths = issue_files.groupBy("repo_id", F.col("number").alias("issue_number")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", "path"))), lambda p: p["path"]
        ).alias("paths")
    )
    none = F.array().cast("array<string>")
    is_test = lambda p: F.lower(p).contains("test") | F.lower(p).contains("spec")
    return (
        analysis.join(paths, ["repo_id", "issue_number"], "left")
        .join(hints, "repo_id", "left")
        .withColumn("paths", F.coalesce("paths", none))
        .withColumn("test_paths", F.filter("paths", is_test))
        .withColumn("test_hint", F.coalesce("test_hint", F.lit("the project's test suite")))
    )


def _steps(prefix: str) -> Column:
    number = F.col("issue_number").cast("string")
    return F.array_compact(
        F.array(
            F.concat(
                F.lit("Read issue #"),
                number,
                F.lit(
                    " carefully. Understand what is broken or missing and what the expected"
                    " behaviour should be."
                ),
            ),
            F.when(
                F.size("paths") > 0,
                F.concat(
                    F.lit("Review the likely relevant files: "),
                    F.array_join(F.slice("paths", 1, 4), ", "),
                    F.lit("."),
                ),
            ),
            F.when(
                F.size("test_paths") > 0,
                F.concat(
                    F.lit("Read the existing tests related to this area: "),
                    F.array_join(F.slice("test_paths", 1, 3), ", "),
                    F.lit("."),
                ),
            ).otherwise("Look for existing tests related to the affected functionality."),
            F.concat(
                F.lit(f"Create an isolated branch for this contribution: {prefix}/"),
                number,
                F.lit("-<short-description>."),
            ),
            F.when(
                F.col("type").isin("bug", "unknown"),
                "Write a test that reproduces the problem described in the issue. "
                "The test should fail with the current code and pass after the fix.",
            ),
            F.lit(
                "Implement the smallest change that fixes the issue. "
                "Follow the existing code style and do not introduce new dependencies."
            ),
            F.concat(
                F.lit("Run the test suite ("),
                F.col("test_hint"),
                F.lit(") and confirm all tests pass."),
            ),
            F.lit(
                "Review the diff to make sure the changes are minimal, correct, "
                "and do not include unrelated modifications."
            ),
            F.lit(
                "Commit the changes with a clear message following the conventional commits "
                "format: type(scope): short description."
            ),
        )
    )


def plan_steps(
    analysis: DataFrame, issue_files: DataFrame, hints: DataFrame, prefix: str = "contrib"
) -> DataFrame:
    """Numbered plain-language steps per issue."""
    return (
        _with_files(analysis, issue_files, hints)
        .select("repo_id", "issue_number", F.posexplode(_steps(prefix)).alias("pos", "description"))
        .select("repo_id", "issue_number", (F.col("pos") + 1).alias("index"), "description")
    )


def issue_plans(
    analysis: DataFrame, issue_files: DataFrame, hints: DataFrame, prefix: str = "contrib"
) -> DataFrame:
    """One plan per issue: branch, relevant files, test hint and first test file."""
    return _with_files(analysis, issue_files, hints).select(
        "repo_id",
        "issue_number",
        X.branch_name(F.col("issue_number"), F.col("title"), prefix).alias("branch_name"),
        F.col("paths").alias("relevant_files"),
        F.lit(False).alias("approved"),
        F.col("test_hint").alias("test_command"),
        F.coalesce(F.get("test_paths", F.lit(0)), F.lit(DEFAULT_TEST_FILE)).alias(
            "test_file_hint"
        ),
    )
