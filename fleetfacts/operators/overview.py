"""Per-project overviews over the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project_overview(
    projects: DataFrame,
    inventory: DataFrame,
    technologies: DataFrame,
    dependencies: DataFrame,
    components: DataFrame | None = None,
    repositories: DataFrame | None = None,
) -> DataFrame:
    """Counts of facts per project; zeros for a project that has not been analysed.

    Every fact table is reduced to one row per repository before it is joined.
    """

    def counted(facts: DataFrame, name: str) -> DataFrame:
        return facts.groupBy("repo_id").agg(F.count("*").alias(name))

    techs = technologies.groupBy("repo_id").agg(
        F.count("*").alias("technology_count"),
        F.sort_array(F.collect_set("name")).alias("technologies"),
    )
    joined = (
        projects.withColumnRenamed("project_id", "repo_id")
        .join(counted(inventory, "file_count"), "repo_id", "left")
        .join(counted(dependencies, "dependency_count"), "repo_id", "left")
        .join(techs, "repo_id", "left")
    )
    if components is not None:
        joined = joined.join(counted(components, "component_count"), "repo_id", "left")
    else:
        joined = joined.withColumn("component_count", F.lit(0).cast("bigint"))
    if repositories is not None:
        urls = repositories.select("repo_id", F.col("url").alias("repository_url"))
        joined = joined.join(urls, "repo_id", "left")
    else:
        joined = joined.withColumn("repository_url", F.lit(""))
    counts = ["file_count", "dependency_count", "technology_count", "component_count"]
    return joined.na.fill(0, counts).select(
        F.col("repo_id").alias("project_id"),
        "name",
        "status",
        F.coalesce("repository_url", F.lit("")).alias("repository_url"),
        "created_at",
        F.coalesce("technologies", F.array().cast("array<string>")).alias("technologies"),
        *counts,
        "error_message",
    )


def list_projects(overview: DataFrame) -> DataFrame:
    """Newest project first."""
    return overview.orderBy(F.desc("created_at"), "project_id")
