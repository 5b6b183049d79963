from datetime import datetime, timedelta

from conftest import rows

from fleetfacts import schemas as S
from fleetfacts.operators import overview as O
from fleetfacts.operators import sessions as K

START = datetime(2024, 5, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_parse_test_logs(spark):
    logs = [
        ("a", 1, "python -m pytest -v", "== 7 passed, 1 failed, 2 errors in 3s ==\n9 passed", 1.239, False),
        ("a", 2, "npm test", "Tests: 3 PASSED, 1 Failed, 4 errors", 1.0, False),
        ("a", 3, "cargo test", "ok. 5 passed; 0 failed\nok. 50 passed; 6 failed", 1.0, False),
        ("a", 4, "go test ./...", "--- PASS: A\n--- PASS: B\n--- FAIL: C\n", 1.0, False),
        ("a", 5, "make", "5 passed", 1.0, True),
        ("a", 6, "python -m pytest", "x" * 5000 + " 3 passed", 1.0, False),
        ("a", 7, "python -m pytest", None, 1.0, False),
    ]
    runs = K.parse_test_logs(spark.createDataFrame(logs, S.TEST_LOGS))
    assert rows(runs, "attempt", "passed", "failed", "errors") == [
        (1, 7, 1, 2), (2, 3, 1, 0), (3, 5, 0, 0), (4, 2, 1, 0), (5, 0, 0, 0), (6, 3, 0, 0), (7, 0, 0, 0),
    ]
    assert runs.where("attempt = 6").selectExpr("length(output)").first()[0] == 5009
    assert runs.where("attempt = 1").first().duration_seconds == 1.24
    totals = K.session_totals(runs).first()
    assert (totals.tests_run, totals.tests_passed, totals.tests_failed, totals.test_runs) == (25, 20, 3, 7)


def test_states_and_reports(spark, make_files):
    def events(session, *names):
        return [
            (session, "r", 5, f"contrib/{session}", name, ["a.py"] * n, at(n)) for n, name in enumerate(names)
        ]

    data = (
        events("ok", "start", "test", "test")
        + events("bad", "start", "test")
        + events("slow", "start", "test")
        + events("nocmd", "start", "no_command")
        + events("nobranch", "start", "branch_failed")
        + events("new", "start")
    )
    logs = [
        ("ok", 1, "python -m pytest", "1 failed", 1.0, False),
        ("ok", 2, "python -m pytest", "4 passed", 1.0, False),
        ("bad", 1, "python -m pytest", "1 passed, 2 errors", 1.0, False),
        ("slow", 1, "python -m pytest", "1 failed", 120.0, True),
    ]
    runs = K.parse_test_logs(spark.createDataFrame(logs, S.TEST_LOGS))
    inventory = make_files(("r", "a", ""), ("r", "b", ""))
    states = K.session_state(spark.createDataFrame(data, S.SESSION_EVENTS), runs, inventory)
    assert rows(states, "session_id", "state", "files_analyzed", "files_modified", "finished_at") == [
        ("bad", "GUIDING", 2, 1, None),
        ("new", "GUIDING", 2, 0, None),
        ("nobranch", "FAILED", 2, 0, at(1)),
        ("nocmd", "DONE", 2, 1, at(1)),
        ("ok", "DONE", 2, 2, at(2)),
        ("slow", "DONE", 2, 1, at(1)),
    ]
    issues = spark.createDataFrame([("r", 5, "Crash")], "repo_id string, number bigint, title string")
    diffs = spark.createDataFrame([("ok", "diff --git a/x b/x\n--- a/x\n+++ b/x\n+n\n")], S.DIFFS)
    reports = {
        r.session_id: r for r in K.session_report(states, K.session_totals(runs), diffs, issues).collect()
    }
    assert sorted(reports) == ["nobranch", "nocmd", "ok", "slow"]
    ok = reports["ok"]
    assert ok.diff_stat == "1 file(s) changed, 1 insertion(s), 0 deletion(s)"
    assert "Addresses issue #5: Crash\n" in ok.draft and ok.draft.endswith("Closes #5")
    assert "- 4 test(s) passed, 1 failed\n- Verification attempts: 2\n" in ok.draft
    assert (ok.files_analyzed, ok.changed_files, ok.started_at, ok.finished_at) == (2, ["a.py", "a.py"], at(0), at(2))
    assert reports["nobranch"].changed_files is None
    assert "- No test suite detected\n\n" in reports["nocmd"].draft


def test_project_status_and_overview(spark, make_files):
    events = spark.createDataFrame(
        [("p", "pending", None, at(0)), ("p", "error", "boom", at(2)), ("p", "analyzing", None, at(1)),
         ("q", "ready", None, at(1)), ("q", "odd", None, at(9))],
        "project_id string, status string, error_message string, ts timestamp",
    )
    assert rows(K.project_status(events), "project_id", "status", "error_message") == [
        ("p", "error", "boom"), ("q", "ready", None),
    ]
    projects = spark.createDataFrame(
        [("p", "P", at(0), "ready", None), ("q", "Q", at(5), "pending", None)], S.PROJECTS
    )
    techs = spark.createDataFrame([("p", "Go", None, "go.mod", 1.0)], S.TECHNOLOGIES)
    deps = spark.createDataFrame([("p", "x", "1", "go", "go.mod")] * 2, S.DEPENDENCIES)
    repos = spark.createDataFrame([("p", "https://x/p", "main", None)], S.REPOSITORIES)
    overview = O.project_overview(projects, make_files(("p", "a", "")), techs, deps, repositories=repos)
    listed = O.list_projects(overview).collect()
    assert [r.project_id for r in listed] == ["q", "p"]
    q, p = listed
    assert (q.file_count, q.dependency_count, q.technology_count, q.technologies, q.repository_url) == (0, 0, 0, [], "")
    assert (p.file_count, p.dependency_count, p.technologies, p.repository_url) == (1, 2, ["Go"], "https://x/p")
