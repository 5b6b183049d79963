import pytest
from conftest import rows

from fleetfacts import schemas as S
from fleetfacts.operators import issues as I
from fleetfacts.operators import planning as P

FIELDS = ["repo_id", "number", "title", "body", "labels", "comments", "html_url", "pull_request"]


@pytest.fixture(scope="module")
def make_issue(spark):
    def make(*issues):
        data = []
        for n, issue in enumerate(issues, 1):
            row = {"repo_id": "r", "number": n, **issue}
            row["labels"] = [(name,) for name in row["labels"]] if row.get("labels") is not None else None
            data.append(tuple(row.get(f) for f in FIELDS))
        return spark.createDataFrame(data, S.ISSUES)

    return make


def analyzed(df):
    return {r.issue_number: r for r in I.analyze_issues(df).collect()}


def test_type(make_issue):
    cases = [
        ({"labels": ["question", "Docs", "bug"]}, "docs"),
        ({"labels": ["tech debt"]}, "refactor"),
        ({"labels": ["enhancement"], "title": "fix"}, "feature"),
        ({"title": "Wrong docs"}, "bug"),
        ({"title": "README comment"}, "docs"),
        ({"title": "Support x"}, "feature"),
        ({"title": "Rename y"}, "refactor"),
        ({"title": "Hello"}, "unknown"),
        ({}, "unknown"),
    ]
    found = analyzed(make_issue(*[c for c, _ in cases]))
    assert [found[n].type for n in range(1, len(cases) + 1)] == [t for _, t in cases]


def test_scope(make_issue):
    cases = [
        ({"labels": ["Typo", "rfc"], "body": "x" * 3000}, "small"),
        ({"labels": ["major"], "body": "x"}, "large"),
        ({"body": None}, "unknown"),
        ({"body": "x" * 799}, "small"),
        ({"body": "x" * 800}, "medium"),
        ({"body": "x" * 2500}, "medium"),
        ({"body": "x" * 2501}, "large"),
    ]
    found = analyzed(make_issue(*[c for c, _ in cases]))
    assert [found[n].scope for n in range(1, len(cases) + 1)] == [s for _, s in cases]


def test_reasons_and_concerns(make_issue):
    found = analyzed(
        make_issue(
            {"labels": ["Bug", "EASY", "Security"], "title": "Add typo", "comments": 2,
             "body": "Steps to reproduce " + "Auth DESIGN rewrite migration " * 10},
            {"body": " \n", "comments": 0},
            {},
            {"body": "see a.py " * 16 + "x" * 3000},
        )
    )
    assert found[1].reasons == [
        "Labelled as approachable: bug, easy",
        "Issue includes a description.",
        "Reproduction steps or expected vs actual behavior described.",
        "Title suggests a focused, well-scoped change.",
        "Description length suggests a focused scope.",
        "Has 2 comment(s) — community is engaged.",
    ]
    assert found[1].concerns == [
        "Labels suggest complexity: security.",
        "Description mentions complex topics: migration, auth, design.",
    ]
    assert found[1].labels == ["Bug", "EASY", "Security"]
    assert found[2].concerns == ["No description provided — scope is unclear."]
    assert found[2].reasons == ["Issue includes a description."]
    assert found[3].concerns == [
        "No description provided — scope is unclear.",
        "No description and no comments — issue may be abandoned.",
    ]
    assert found[4].concerns == [
        "Very long description — may indicate high complexity.",
        "References many files/paths — may touch multiple modules.",
    ]


def test_pull_requests_drop_out(make_issue):
    df = make_issue({"title": "a"}, {"title": "b", "pull_request": ("u",)})
    assert rows(I.drop_pull_requests(df), "title") == [("a",)]


def test_commands_and_hints(spark, make_files):
    files = make_files(
        ("py_dep", "requirements.txt", "pytest>=8\n"),
        ("py_text", "pyproject.toml", '[tool.pytest]\n'),
        ("py", "requirements.txt", "flask\n"),
        ("node", "package.json", '{"scripts": {"test": "jest"}}'),
        ("node_no_script", "package.json", '{"scripts": {}}'),
        ("rust", "Cargo.toml", ""),
        ("go", "go.mod", "module x\n"),
    )
    from fleetfacts.operators import dependencies, technologies

    repos = files.select("repo_id").distinct().union(spark.createDataFrame([("none",)], "repo_id string"))
    techs, deps = technologies.detect_technologies(files), dependencies.extract_dependencies(files)
    assert rows(P.test_command(repos, techs, deps, files)) == [
        ("go", "go test ./..."), ("node", "npm test"), ("node_no_script", None), ("none", None),
        ("py", "python -m unittest discover"), ("py_dep", "python -m pytest -v"),
        ("py_text", "python -m pytest -v"), ("rust", "cargo test"),
    ]
    assert rows(P.test_hint(repos, techs, deps)) == [
        ("go", "go test ./..."), ("node", "npm test"), ("node_no_script", "npm test"),
        ("none", "the project's test suite"), ("py", "python -m unittest"), ("py_dep", "pytest"),
        ("py_text", "python -m unittest"), ("rust", "cargo test"),
    ]


def test_plan(spark, make_issue):
    analysis = I.analyze_issues(make_issue({"title": "Crash: bad"}, {"title": "Add docs", "labels": ["docs"]}))
    ranked = spark.createDataFrame(
        [("r", 1, p, f"{name}.py") for p, name in enumerate(["a", "test_b", "c", "spec_d", "e"], 1)],
        "repo_id string, number bigint, position int, path string",
    )
    hints = spark.createDataFrame([("r", "pytest")], "repo_id string, test_hint string")
    steps = rows(P.plan_steps(analysis, ranked, hints), "issue_number", "index", "description")
    assert [s[1] for s in steps] == list(range(1, 10)) + list(range(1, 8))
    texts = {(s[0], s[1]): s[2] for s in steps}
    assert texts[1, 2] == "Review the likely relevant files: a.py, test_b.py, c.py, spec_d.py."
    assert texts[1, 3] == "Read the existing tests related to this area: test_b.py, spec_d.py."
    assert texts[1, 7] == "Run the test suite (pytest) and confirm all tests pass."
    assert texts[2, 2] == "Look for existing tests related to the affected functionality."
    plans = {r.issue_number: r for r in P.issue_plans(analysis, ranked, hints, prefix="fix").collect()}
    assert plans[1].branch_name == "fix/1-crash-bad" and plans[1].test_file_hint == "test_b.py"
    assert plans[2].relevant_files == [] and plans[2].test_file_hint == "tests/test_something.py"
