import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F
from texts import DB_REPO, NODE_REPO, PYTHON_REPO

from fleetfacts import schemas as S
from fleetfacts.operators import inventory as V
from fleetfacts.plans.analyze import analyze_files, write_analysis
from fleetfacts.plans.contribute import plan_contributions
from fleetfacts.sources import checkouts as C
from fleetfacts.sources import readers as R
from fleetfacts.sources import writers as W
from fleetfacts.streaming.incremental import start_incremental


def write_lines(path, *objects):
    with open(path, "w", encoding="utf-8") as out:
        for item in objects:
            out.write((item if isinstance(item, str) else json.dumps(item)) + "\n")
    return str(path)


def test_read_repo_files(spark, tmp_path):
    for path, data in {
        "one/src/a b.py": b"x\r\ny", "one/.git/config": b"", "one/build/x": b"", "two/%41.bin": b"\xff",
    }.items():
        target = tmp_path / "checkouts" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    raw = R.read_repo_files(spark, str(tmp_path / "checkouts"))
    assert rows(raw, "repo_id", "path", "size_bytes") == [("one", "src/a b.py", 4), ("two", "%41.bin", 1)]
    assert rows(V.decode_content(raw), "content") == [("",), ("x\ny",)]


def test_listing_enters_no_vendored_directory_and_follows_no_link(spark, tmp_path):
    root = tmp_path / "build" / "checkouts"
    repo = root / "one"
    (repo / ".git").mkdir(parents=True)
    os.mkfifo(repo / ".git" / "config")  # Opening this would never return.
    (repo / ".git" / "HEAD").write_text("x")
    for path, text in {"inside.py": "# inside", "a/b/c.py": "c", "a/dist/d.py": "d", "a/dist.py": "e", "empty": ""}.items():
        (repo / path).parent.mkdir(parents=True, exist_ok=True)
        (repo / path).write_text(text)
    outside = tmp_path / "outside"
    outside.mkdir()
    (outside / "secret.py").write_text("secret")
    os.symlink(outside / "secret.py", repo / "escaped.py")
    os.symlink(outside, repo / "escaped")
    os.symlink(repo / "inside.py", repo / "again.py")
    os.symlink(repo, repo / "a" / "loop")
    os.symlink(outside / "absent", repo / "broken")
    with open(os.fsencode(repo) + b"/\xff.py", "wb") as out:
        out.write(b"odd")
    os.symlink(repo, root / "linked")  # A repository may be a link.
    (root / "beside.py").write_text("of no repository")
    expected = [("a/b/c.py", "c"), ("a/dist.py", "e"), ("empty", ""), ("inside.py", "# inside"), ("\ufffd.py", "odd")]
    expected = sorted((r, p, len(t), t.encode()) for r in ("linked", "one") for p, t in expected)
    dotted = f"{root}/../checkouts"
    for form in (str(root), dotted):
        found = R.read_repo_files(spark, form).select("repo_id", "path", "size_bytes", F.col("content").cast("string"))
        assert sorted((r, p, n, t.encode()) for r, p, n, t in rows(found)) == expected


def test_listing_in_rounds_and_large_or_lost_files(spark, tmp_path):
    root = tmp_path / "checkouts"
    expected = []
    for i in range(60):
        path = f"d{i % 3}/e{i % 5}/f{i % 2}/{i}.txt"
        target = root / f"repo{i % 4}" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("x" * i)
        expected.append((f"repo{i % 4}", path, i))
    for most in (1, 7, 10_000):
        listed = R.list_repo_files(spark, str(root), walk_entries=most)
        assert rows(listed, "repo_id", "path", "size_bytes") == sorted(expected, key=lambda t: tuple(map(str, t)))
    (root / "repo0" / "d0/e0/f0/0.txt").unlink()
    read = {p: (n, c) for _, p, n, c in rows(C.read_listed(listed, str(root), max_bytes=50), "repo_id", "path", "size_bytes", "content")}
    assert len(read) == 60 and read["d0/e0/f0/0.txt"] == (0, None)
    assert [n for n, c in read.values() if c is None and n > 50] and all(c is None for n, c in read.values() if n > 50)
    assert all(bytes(c) == b"x" * n for n, c in read.values() if 0 < n <= 50)
    empty = tmp_path / "none"
    empty.mkdir()
    assert R.read_repo_files(spark, str(empty)).count() == 0


def test_read_issues(spark, tmp_path):
    path = write_lines(
        tmp_path / "issues.json",
        {"repo_id": "r", "number": 1, "title": "a", "labels": [{"name": "bug", "color": "f00"}], "comments": 2},
        {"repo_id": "r", "number": 2, "pull_request": {"url": "u"}},
    )
    issues = R.read_issues(spark, path)
    assert rows(issues.where("pull_request IS NULL"), "number", "title", "labels.name") == [(1, "a", ["bug"])]


def test_repository_ids_where_the_root_occurs_twice(spark, tmp_path):
    root = tmp_path / "checkouts" / "fleet-checkouts" / "checkouts"
    target = root / "one" / "checkouts" / "a.py"
    target.parent.mkdir(parents=True)
    target.write_bytes(b"x")
    for form in (str(root), f"{root}/", f"file://{root}"):
        assert rows(R.read_repo_files(spark, form), "repo_id", "path") == [("one", "checkouts/a.py")]


def test_bad_records_are_rejects(spark, tmp_path):
    good = {"repo_id": "r", "number": 1, "title": "a"}
    path = write_lines(tmp_path / "issues.json", good, '{"repo_id": "r", "num', {"repo_id": "r", "title": "b"}, {"number": 3})
    assert rows(R.read_issues(spark, path), "repo_id", "number", "title") == [("r", 1, "a")]
    assert R.read_issues(spark, path).count() == 1
    assert rows(R.read_rejects(spark, path, "issues"), "reason") == [("no number",), ("no repo_id",), ("unreadable",)]
    kept = {r.reason: r.record for r in R.read_rejects(spark, path, "issues").collect()}
    assert kept["unreadable"] == '{"repo_id": "r", "num' and json.loads(kept["no repo_id"]) == {"number": 3}
    texts = spark.createDataFrame([(json.dumps(good),), ("{",), (None,)], "j string")
    assert rows(R.parse_issues(texts, "j"), "number") == [(1,)]
    # An array over several lines is one file of records, or else all of its lines are rejects.
    array = tmp_path / "array.json"
    array.write_text(json.dumps([good, dict(good, number=2)], indent=1))
    assert rows(R.read_issues(spark, str(array), whole_files=True), "number") == [(1,), (2,)]
    assert R.read_issues(spark, str(array)).count() == 0 and R.read_rejects(spark, str(array), "issues").count() > 0
    logs = write_lines(tmp_path / "logs.json", {"session_id": "s", "attempt": 1}, {"attempt": 2}, "nothing")
    assert rows(R.read_test_logs(spark, logs), "attempt") == [(1,)]
    assert rows(R.read_rejects(spark, logs, "test_logs"), "reason") == [("no session_id",), ("unreadable",)]
    events = write_lines(tmp_path / "events.json", {"session_id": "s", "event": "test", "ts": "2024-05-01T00:00:00Z"}, {"session_id": "s", "event": "test"})
    assert R.read_session_events(spark, events).count() == 1
    assert rows(R.read_rejects(spark, events, "session_events"), "reason") == [("no ts",)]


def test_logs_and_events(spark, tmp_path):
    logs = write_lines(tmp_path / "logs.json", {"session_id": "s", "attempt": 1, "command": "x", "timed_out": False})
    events = write_lines(
        tmp_path / "events.json",
        {"session_id": "s", "event": "test", "changed_files": ["a"], "ts": "2024-05-01T00:00:00Z"},
    )
    assert rows(R.read_test_logs(spark, logs), "session_id", "attempt") == [("s", 1)]
    assert R.read_session_events(spark, events).first().changed_files == ["a"]


def test_knowledge_documents(spark, tmp_path):
    def doc(project, status="ready", confidence=0.5):
        return {
            "metadata": {"project_id": project, "name": project, "created_at": "2024-05-01T00:00:00Z", "status": status},
            "repository": {"url": "u", "clone_path": "/x"},
            "technologies": [{"name": "Go", "source": "go.mod", "confidence": confidence}],
            "files": [{"path": "go.mod", "size_bytes": 3, "extension": ".mod", "is_important": True}],
            "database": {"tables": [{"name": "t", "columns": [{"name": "id"}], "confidence": 1.0}], "detected": True},
        }

    path = write_lines(
        tmp_path / "docs.json", doc("good"), doc("low", confidence=-0.1), doc("high", confidence=1.1),
        doc("odd", status="lost"), '{"metadata": {"project_id": "cut"',
    )
    tables = R.knowledge_tables(R.read_knowledge_docs(spark, path))
    assert rows(tables["technologies"], "repo_id", "name") == [("good", "Go")]
    assert rows(tables["file_inventory"], "repo_id", "path") == [("good", "go.mod")]
    assert rows(tables["schema_columns"], "repo_id", "table_name", "ordinal", "name") == [("good", "t", 0, "id")]
    assert tables["dependencies"].count() == 0
    reasons = sorted(r.reason for r in tables["rejects"].collect())
    assert reasons == ["confidence outside [0, 1]"] * 2 + ["unknown status", "unreadable"]


def test_write_facts_replaces_only_named_repositories(spark, tmp_path):
    path = str(tmp_path / "deps")

    def facts(*pairs):
        return spark.createDataFrame([(r, n, None, "npm", "package.json") for r, n in pairs], S.DEPENDENCIES)

    W.write_facts(facts(("a", "x"), ("b", "y"), ("c", "z")), path, buckets=2)
    W.write_facts(facts(("a", "new")), path, buckets=2)
    assert rows(W.read_facts(spark, path, buckets=2), "repo_id", "name") == [("a", "new"), ("b", "y"), ("c", "z")]
    with pytest.raises(ValueError):
        W.write_facts(facts(("a", "x")), path, buckets=3)
    # Repositories whose last fact is gone.
    gone = spark.createDataFrame([("a",), ("b",), ("c",)], "repo_id string")
    W.write_facts(facts(), path, gone, buckets=2)
    assert W.read_facts(spark, path, buckets=2).count() == 0
    W.write_facts(facts(("b", "w")), path, buckets=2)
    assert rows(W.read_facts(spark, path, ["b", "q"], buckets=2), "repo_id", "name") == [("b", "w")]


def fact_files(path):
    """Names of the files of each batch."""
    out = {}
    for folder, _, names in os.walk(path):
        if "/facts/batch=" in folder:
            batch = folder.split("batch=")[1].split("/")[0]
            out.setdefault(batch, set()).update(f"{folder}/{n}" for n in names if n.endswith(".parquet"))
    return out


def test_a_batch_writes_its_repositories_only_and_a_killed_writer_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "deps")

    def facts(*pairs):
        return spark.createDataFrame([(r, n, None, "npm", "package.json") for r, n in pairs], S.DEPENDENCIES)

    many = [(f"r{i}", f"x{i}") for i in range(50)]
    W.write_facts(facts(*many), path, buckets=2)
    before = fact_files(path)
    W.write_facts(facts(("r7", "new")), path, buckets=2)
    after = fact_files(path)
    assert all(after[b] == names for b, names in before.items())
    (batch,) = after.keys() - before.keys()
    written = spark.read.parquet(*after[batch]).where("repo_id IS NOT NULL")
    assert rows(written, "repo_id", "name") == [("r7", "new")]
    # Facts are written, repositories are not: the batch doesn't count.
    expected = rows(W.read_facts(spark, path, buckets=2))
    half = f"{path}/facts/batch=000000000003-killed"
    W.write_facts(facts(("r7", "lost"), ("r8", "lost")), str(tmp_path / "other"), buckets=2)
    os.rename(next(f"{tmp_path}/other/facts/{n}" for n in os.listdir(tmp_path / "other" / "facts")), half)
    assert rows(W.read_facts(spark, path, buckets=2)) == expected
    # The next writer is not disturbed by it, and vacuum takes it away.
    W.write_facts(facts(("r8", "again")), path, buckets=2)
    found = rows(W.read_facts(spark, path, ["r7", "r8"], buckets=2), "repo_id", "name")
    assert found == [("r7", "new"), ("r8", "again")]
    assert W.vacuum_facts(spark, path) == ["000000000003-killed"]


def test_compaction_makes_one_batch_and_keeps_readers_and_later_writers_right(spark, tmp_path):
    path = str(tmp_path / "deps")

    def facts(*pairs):
        return spark.createDataFrame([(r, n, None, "npm", "package.json") for r, n in pairs], S.DEPENDENCIES)

    gone = spark.createDataFrame([("a",)], "repo_id string")
    W.write_facts(facts(), path, gone, buckets=2)
    assert W.read_facts(spark, path, buckets=2).count() == 0
    for step in range(3):
        W.write_facts(facts(("a", f"a{step}"), ("b", f"b{step}")), path, buckets=2)
    W.write_facts(facts(), path, gone, buckets=2)
    began = W.read_facts(spark, path, buckets=2)
    W.compact_facts(spark, path, buckets=2)
    assert len(W.fact_batches(spark, path)) == 1
    plan = W.read_facts(spark, path, buckets=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert rows(W.read_facts(spark, path, buckets=2), "repo_id", "name") == rows(began, "repo_id", "name") == [("b", "b2")]
    assert len(W.vacuum_facts(spark, path)) == 5 and W.vacuum_facts(spark, path) == []
    W.write_facts(facts(("a", "back")), path, buckets=2)
    assert rows(W.read_facts(spark, path, buckets=2), "repo_id", "name") == [("a", "back"), ("b", "b2")]


def test_land_files_allows_pruning(spark, make_files, tmp_path):
    path = str(tmp_path / "files")
    W.land_files(make_files(*PYTHON_REPO, *NODE_REPO), path, partitions=3)
    landed = R.read_files(spark, path)
    assert landed.count() == 10 and "extension" in landed.columns
    assert rows(V.file_inventory(landed), "path", "extension")[0] == ("package.json", ".json")


def test_analysis_round_trip(spark, make_files, tmp_path):
    files = make_files(*PYTHON_REPO, *NODE_REPO, *DB_REPO)
    facts = analyze_files(files)
    write_analysis(files, str(tmp_path / "facts"), buckets=4)
    for name, df in facts.items():
        stored = W.read_facts(spark, str(tmp_path / "facts" / name), buckets=4)
        assert rows(stored.select(*df.columns)) == rows(df), name


def test_plan_contributions(spark, make_files):
    files = make_files(*PYTHON_REPO)
    issues = spark.createDataFrame(
        [("shop", 3, "Cart crash in orders", "httpx fails", None, 1, "", None),
         ("shop", 4, "A pull request", "", None, 0, "", ("u",))],
        S.ISSUES,
    )
    tables = plan_contributions(files.select("repo_id").distinct(), files, issues)
    assert rows(tables["analysis"], "issue_number", "type") == [(3, "bug")]
    assert tables["issue_files"].orderBy("position").first().path == "src/orders/cart.py"
    plan = tables["plans"].first()
    assert plan.branch_name == "contrib/3-cart-crash-in-orders" and plan.test_command == "pytest"
    assert tables["plan_steps"].count() == 9


def test_incremental_equals_batch(spark, make_files, tmp_path):
    files_path, out, mark = (str(tmp_path / d) for d in ("files", "facts", "checkpoint"))

    def settle():
        query = start_incremental(spark, files_path, out, mark, buckets=4)
        query.awaitTermination()
        assert query.exception() is None

    make_files(*PYTHON_REPO[:-1]).write.parquet(files_path)
    settle()
    edges = W.read_facts(spark, os.path.join(out, "import_edges"), buckets=4)
    assert edges.count() == 1
    # The missing target arrives later, with another repository.
    make_files(PYTHON_REPO[-1], *NODE_REPO).write.mode("append").parquet(files_path)
    settle()
    expected = analyze_files(make_files(*PYTHON_REPO, *NODE_REPO))
    for name in ("import_edges", "technologies", "dependencies", "file_inventory"):
        stored = W.read_facts(spark, os.path.join(out, name), buckets=4)
        assert rows(stored.select(*expected[name].columns)) == rows(expected[name]), name


@pytest.mark.parametrize("land", [{}, {"buckets": 4}])
def test_incremental_changes_and_deletions(spark, tmp_path, land):
    files_path, out, mark = (str(tmp_path / d) for d in ("files", "facts", "checkpoint"))

    def settle(*landed):
        rows_ = [(repo, path, text, len(text or ""), version, gone) for repo, path, text, version, gone in landed]
        W.land_files(spark.createDataFrame(rows_, S.LANDED_FILES), files_path, mode="append", **land)
        query = start_incremental(spark, files_path, out, mark, tables=["dependencies", "file_inventory"], buckets=4)
        query.awaitTermination()
        assert query.exception() is None
        found = W.read_facts(spark, os.path.join(out, "dependencies"), buckets=4)
        inventory = W.read_facts(spark, os.path.join(out, "file_inventory"), buckets=4)
        return rows(found, "repo_id", "name", "version"), rows(inventory, "repo_id", "path")

    name = "requirements.txt"
    first, _ = settle(("a", name, "flask==1", None, None), ("b", name, "django==4", 5, False))
    assert [r[:2] for r in first] == [("a", "flask"), ("b", "django")]
    old = first[0][2]
    # A change, by landing time or version; an older version that arrives late; another file.
    changed, paths = settle(("a", name, "flask==2", None, None), ("b", name, "django==3", 4, False), ("a", "x.py", "", 1, None))
    assert [r[:2] for r in changed] == [r[:2] for r in first]
    assert changed[0][2] == old.replace("1", "2") and changed[1] == first[1]
    assert paths == [("a", name), ("a", "x.py"), ("b", name)]
    assert settle(("b", name, None, 6, True)) == (changed[:1], paths[:2])
    back, paths = settle(("b", name, "django==4", 7, None), ("b", name, "django==4", 7, None))
    assert back == [changed[0], first[1]] and len(paths) == 3


def test_unknown_decode_mode(make_files):
    with pytest.raises(ValueError):
        V.decode_content(make_files(("r", "a", "")), "guess")
