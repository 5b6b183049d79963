"""What grows with a table: tasks, broadcasts, written bytes, steps per character."""

import time

from pyspark.sql import functions as F

from checks import corpus as K
from checks import queries as Q
from fleetfacts.functions import text as X
from fleetfacts.operators import dbschema
from fleetfacts.operators import imports as I
from fleetfacts.sources import writers
from fleetfacts.streaming import incremental


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_row_group_is_spread(spark, tmp_path):
    """Many splits of a file with one row group are one task with rows."""
    rows = spark.range(3000).withColumn("text", F.sha2(F.col("id").cast("string"), 256))
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        table = K.table(spark, str(tmp_path), "part")
        sizes = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= spark.sparkContext.defaultParallelism and sum(sizes) == 3000
        assert max(sizes) < 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_tasks_grow_with_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "TASK_ROWS", 50)
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert K.table(spark, str(tmp_path), "part").rdd.getNumPartitions() >= 20
    spark.range(0).write.parquet(f"{tmp_path}/orders.parquet")
    assert K.table(spark, str(tmp_path), "orders").count() == 0


def test_words_are_found_as_by_contains(spark):
    words = ["a.b", "ab", "cab x", "(", "ß?", "x"]
    texts = ["", "acb", "a.b", "xab", "cab x", "f(", "aß?", "aß", "\\(", None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    expected = [None if t is None else any(w in t for w in words) for t in texts]
    assert [r[0] for r in df.select(X.contains_any(F.col("t"), words)).collect()] == expected
    for word in words:
        same = X.contains_word(F.col("t"), word).eqNullSafe(F.col("t").contains(word))
        assert df.where(~same).count() == 0


def test_long_words_in_model_bodies(spark):
    """Names are taken whole; before, each part of a word was tried again at each of its letters."""
    body = "\n    " + "w" * 150_000 + "\n    é1 = Column(Integer)\n    r2 = relationship('T')\n    d3 = models.CharField(x)"
    df = spark.createDataFrame([(body,)], "b STRING")
    b = F.col("b")
    start = time.perf_counter()
    row = df.select(
        dbschema.sqlalchemy_columns(b)["name"], dbschema.sqlalchemy_relationships(b)["from_column"],
        dbschema.django_fields(b)["name"],
    ).first()
    assert (row[0], row[1], row[2]) == (["é1"], ["r2"], ["d3"])
    assert time.perf_counter() - start < 20


def test_exports_are_compressed(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "issues")
    monkeypatch.setattr(Q, "staging_folder", lambda *_: folder)
    read = Q.read_issues(spark, "/root/testdata/sf0.001")
    assert read.count() > 0
    files = [p for p in (tmp_path / "issues").iterdir() if p.name.startswith("part-")]
    assert files and all(p.name.endswith(".json.gz") for p in files)


def test_places_and_repositories_are_not_broadcast(spark, tmp_path, monkeypatch):
    files = spark.range(500).selectExpr(
        "concat('r', id % 100) AS repo_id", "concat('f', id) AS path", "'x' AS content",
        "1L AS size_bytes", "1L AS version", "false AS deleted",
    )
    files.write.parquet(f"{tmp_path}/landed")
    landed = spark.read.parquet(f"{tmp_path}/landed")
    repos = files.select("repo_id").distinct()
    monkeypatch.setattr(incremental, "MANY_REPOS", 10)
    current = incremental.current_files(landed, repos)
    assert current.count() == 500 and "Broadcast" not in _plan(current)
    facts = files.select("repo_id", "path")
    for _ in range(2):
        writers.write_facts(facts, f"{tmp_path}/facts", buckets=4)
    found = writers.read_facts(spark, f"{tmp_path}/facts", buckets=4)
    assert found.count() == 500 and "Broadcast" not in _plan(found)


def test_gates_of_python_sources(spark):
    """A literal is looked for before the pattern; texts that hold only one of the two do not pass."""
    texts = {
        "from  sqlalchemy import x": (True, False),
        "import\u00a0sqlalchemy": (True, False),
        "sqlalchemy": (False, False),
        "x = mapped_column()": (True, False),
        "from django.db import\tmodels": (False, True),
        "django.db": (False, False),
        "from djangoxdb import models": (False, False),
    }
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    t = F.col("t")
    found = df.select(dbschema._uses_sqlalchemy(t), dbschema._uses_django(t)).collect()
    assert [tuple(r) for r in found] == list(texts.values())


def test_import_passes_test_cheap_things_first(spark, make_files):
    """Extensions before directory patterns; no extension pattern per file; outside targets are not joined."""
    files = make_files(("r", "web/a.ts", "import a from '../../x';\nimport b from './b';"), ("r", "web/b.ts", ""))
    plan = _plan(I.python_imports(files))
    assert plan.index("EndsWith(path") < plan.index("RLIKE(path")
    broken = [("a.ts",), ("x\ny.ts",), ("y.ts\n",), (".ts",), ("d/.ts",), ("..tsx",), ("a.b.js",), ("a.py",), ("",), (None,)]
    paths = spark.createDataFrame(broken, "path STRING")
    place = X.extension_place(F.col("path"), [".ts", ".tsx", ".js"])
    listed = F.array_position(X.string_array([".ts", ".tsx", ".js"]), X.file_extension(F.col("path")))
    assert paths.where("path IS NOT NULL").where(place != listed).count() == 0
    edges = I.resolve_ts_imports(I.ts_imports(files), files)
    assert "NOT (import_key" in _plan(edges)
    assert [tuple(r) for r in edges.collect()] == [("r", "web/a.ts", "web/b.ts")]


def test_statements_start_a_line(spark):
    text = "import a\nximport b\n import c\nfrom d import e\n# from f import g\nimport\nh\n\U0001f600import i\nfrom import import"
    found = spark.range(1).select(
        X.extract_all(F.lit(text), I._PY_IMPORT).alias("i"), X.extract_all(F.lit(text), I._PY_FROM).alias("f")
    ).first()
    assert (found.i, found.f) == (["a", "h"], ["d", "import"])
    assert all(p.removeprefix("(?dmU)").startswith(w) for p, w in ((I._PY_IMPORT, "import"), (I._PY_FROM, "from")))


def test_blocks_by_pattern_are_those_by_depth(spark):
    head = "CREATE TABLE a ("
    texts = [
        head + "x)", head + "(x) ((y)))" + head + "z)", head + "x", head + head + "y))", head + "x" + head + "y)",
        head + "(" * 9 + "x" + ")" * 10, head + ")", ")(" + head + "x) (", "(((" + head + "x)", "none", "", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    both = dbschema._blocks(F.col("t"), dbschema._SQL_TABLE), dbschema._blocks_by_depth(F.col("t"), dbschema._SQL_TABLE, "(", ")")
    assert df.where(~both[0].eqNullSafe(both[1])).count() == 0
    sizes = [r[0] for r in df.select(F.size(both[0])).collect()]
    assert sizes[:6] == [1, 2, 0, 2, 1, 1]


def _shuffled(plan):
    """Rows written to shuffles by an executed plan, without those read again."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _shuffled(plan.plan())
    if kind == "ReusedExchangeExec":
        return 0
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(_shuffled(plan.children().apply(k)) for k in range(plan.children().size()))


def _importing_files(make_files, n):
    """n files of either language that nobody imports; of four imports of each, one names a file."""
    modules = "import os\nimport lib.none{0}\nimport lib.p{1}\nfrom .x import y\n"
    targets = "import a from '../lib/none{0}';\nimport b from '../lib/q{1}';\nimport c from 'react';\nimport d from './../svc/x/../s{0}';\n"
    return make_files(
        *((f"r{k % 3}", f"app/o{k}.py", modules.format(k, k % 2)) for k in range(n)),
        *((f"r{k % 3}", f"web/o{k}.ts", targets.format(k, k % 2)) for k in range(n)),
        *((f"r{k}", f"lib/{name}", "") for k in range(3) for name in ("p0.py", "p1/__init__.py", "q0.js", "q1/index.tsx")),
    )


def test_unresolved_imports_and_unimported_files_are_not_shuffled(spark, make_files):
    """Before, each of n pairs of files wrote seven imports and four names to the join's shuffles."""
    n = 300
    files = _importing_files(make_files, n)
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    try:
        for key in keys:
            spark.conf.set(key, "-1")
        edges = I.import_edges(files)
        found = edges.collect()
    finally:
        for key in keys:
            spark.conf.unset(key)
    ends = {0: ("lib/p0.py", "lib/q0.js"), 1: ("lib/p1/__init__.py", "lib/q1/index.tsx")}
    expected = [(f"r{k % 3}", f"{d}/o{k}.{e}", to) for k in range(n) for d, e, to in zip(("app", "web"), ("py", "ts"), ends[k % 2])]
    assert sorted(tuple(r)[:3] for r in found) == sorted(expected)
    # One import a file; the rest is filters and the index.
    assert _shuffled(edges._jdf.queryExecution().executedPlan()) < 3 * n


def test_a_full_filter_keeps_nothing_back(make_files, monkeypatch):
    files = _importing_files(make_files, 60).unionByName(
        make_files(("r0", "lib/p0.py", "import lib.p1"), ("r0", "lib/p0.py", "import lib.p1")).selectExpr(
            "repo_id", "path", "content", "size_bytes"
        )
    )
    nulls = files.limit(6).selectExpr(
        "if(path LIKE '%0.py', null, repo_id) AS repo_id", "if(path LIKE '%1.py', null, path) AS path",
        "if(path LIKE '%2.py', null, content) AS content", "size_bytes",
    )
    edges = [sorted(map(tuple, I.import_edges(files.unionByName(nulls)).collect()))]
    monkeypatch.setattr(I, "_FILTER_WORDS", 1)
    edges.append(sorted(map(tuple, I.import_edges(files.unionByName(nulls)).collect())))
    assert edges[0] == edges[1] and len(edges[0]) > 120


def test_index_of_names_is_made_once(make_files):
    """The filter of known names and the join read one shuffle."""
    files = _importing_files(make_files, 20)
    for resolved in (
        I.resolve_ts_imports(I.ts_imports(files), files),
        I.resolve_python_imports(I.python_imports(files), files),
    ):
        resolved.collect()
        plan = _plan(resolved)
        final = plan[: plan.index("Initial Plan")]
        assert "ReusedExchange" in final and final.count("partial_min(rank") == 1
