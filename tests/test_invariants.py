"""Random repositories against independent restatements of the rules, and invariants."""

import posixpath
import random

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetfacts.functions import text as X
from fleetfacts.operators import imports as I
from fleetfacts.operators import inventory as V
from fleetfacts.operators import technologies as T

NAMES = ["a", "b", "src", "index", "lib"]
SCRIPTS = [".ts", ".tsx", ".js", ".jsx"]


def random_files(rng):
    paths = set()
    for _ in range(60):
        folder = [rng.choice(NAMES) for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.1:
            folder.insert(rng.randint(0, len(folder)), "dist")
        name = rng.choice(NAMES + ["__init__"]) + rng.choice([".py", *SCRIPTS, ".md"])
        paths.add("/".join(folder + [name]))
    out = []
    for path in sorted(paths):
        if path.endswith(".py"):
            modules = [".".join(rng.choice(NAMES) for _ in range(rng.randint(1, 3))) for _ in range(4)]
            text = "".join(f"import {m}\n" if rng.random() < 0.5 else f"from {m} import x\n" for m in modules)
        else:
            steps = ["./", "../", "../../", "./../", "x/../", ""]
            targets = [
                rng.choice(steps) + "/".join(rng.choice(NAMES) for _ in range(rng.randint(1, 2)))
                + rng.choice(["", "", ".ts", ".js"])
                for _ in range(4)
            ]
            text = "".join(f"import y from '{t}'\n" for t in targets)
        out.append(("r", path, text))
    return out


def expected_edges(files):
    seen = {p for _, p, _ in files if not set(p.split("/")) & {"dist"}}
    edges = []
    for _, path, text in files:
        if path not in seen:
            continue
        quoted = [line.split() for line in text.splitlines()]
        for target in sorted({words[-1].strip("'") if "'" in words[-1] else words[1] for words in quoted}):
            if path.endswith(".py"):
                stem = target.replace(".", "/")
                options = [f"{stem}.py", f"{stem}/__init__.py", f"src/{stem}.py", f"src/{stem}/__init__.py"]
            elif path.endswith(tuple(SCRIPTS)) and target.startswith(("./", "../")):
                full = posixpath.normpath(posixpath.join(posixpath.dirname(path), target))
                if full.startswith(".."):
                    continue
                options = [full] + [o for e in SCRIPTS for o in (full + e, posixpath.normpath(f"{full}/index{e}"))]
            else:
                continue
            found = next((o for o in options if o in seen), None)
            if found and found != path:
                edges.append((path, found))
    return sorted(edges)


def test_edges_of_random_repositories(make_files):
    for seed in range(4):
        files = random_files(random.Random(seed))
        edges = I.import_edges(make_files(*files))
        got = rows(edges, "from_component", "to_component")
        assert got == expected_edges(files), seed
        known = {p for _, p, _ in files}
        assert all(a in known and b in known and a != b for a, b in got)


def test_results_do_not_depend_on_partitions(make_files):
    files = make_files(*random_files(random.Random(11)))
    spread, single = files.repartition(9), files.coalesce(1)
    for operator in (I.import_edges, T.detect_technologies, V.file_inventory):
        assert rows(operator(spread)) == rows(operator(single))


def test_one_technology_per_name(make_files):
    found = T.detect_technologies(make_files(*random_files(random.Random(5))))
    assert found.groupBy("repo_id", "name").count().where("count > 1").count() == 0


SEGMENT = st.sampled_from(["a", "b", "..", ".", "", "c.d"])


@settings(max_examples=3, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.lists(st.sampled_from(["a", "b", "c.d"]), max_size=3).map("/".join),
            st.sampled_from(["./", "../"]),
            st.lists(SEGMENT, max_size=5).map("/".join),
        ),
        min_size=50,
        max_size=200,
    )
)
def test_relative_paths_follow_posix(spark, cases):
    df = spark.createDataFrame([(d, lead + rest) for d, lead, rest in cases], "d string, t string")
    for row in df.select("d", "t", X.resolve_relative(F.col("d"), F.col("t")).alias("got")).collect():
        # Outside once any prefix of the walk leaves the root.
        depth, outside = len([s for s in row.d.split("/") if s]), False
        for part in row.t.split("/"):
            depth += {"..": -1, ".": 0, "": 0}.get(part, 1)
            outside = outside or depth < 0
        want = posixpath.normpath(posixpath.join(row.d, row.t)) if not outside else ".."
        assert row.got == ("" if want == "." else want), row
