"""From issues and facts to triage, ranked files and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetfacts.operators import dependencies, issues, planning, search, technologies


def plan_contributions(
    repositories: DataFrame, files: DataFrame, raw_issues: DataFrame, prefix: str = "contrib"
) -> dict[str, DataFrame]:
    """Lazy tables `analysis`, `issue_files`, `plan_steps` and `plans` for open issues."""
    open_issues = issues.drop_pull_requests(raw_issues)
    analysis = issues.analyze_issues(open_issues)
    ranked = search.top_files_per_issue(search.issue_keywords(open_issues), files)
    hints = planning.test_hint(
        repositories,
        technologies.detect_technologies(files),
        dependencies.extract_dependencies(files),
    )
    return {
        "analysis": analysis,
        "issue_files": ranked,
        "plan_steps": planning.plan_steps(analysis, ranked, hints, prefix),
        "plans": planning.issue_plans(analysis, ranked, hints, prefix),
    }
