import pytest
from pyspark.sql import functions as F

from fleetfacts.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://github.com/owner/repo", ("owner", "repo")),
        ("https://github.com/owner/repo.git", ("owner", "repo")),
        (" https://github.com/owner/repo/ ", ("owner", "repo")),
        ("git@github.com:owner/repo.git", ("owner", "repo")),
        ("https://github.com/owner", None),
        ("https://example.org/owner/repo", None),
        ("", None),
    ],
)
def test_owner_repo(spark, url, expected):
    got = value(spark, X.owner_repo(F.lit(url)))
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(
    "title, expected",
    [
        ("Fix expired token", "contrib/42-fix-expired-token"),
        ("  [Bug]: it's -- broken! ", "contrib/42-bug-it-s-broken"),
        ("word " * 20, "contrib/42-word-word-word-word-word-word-word-word-word-word"),
        ("", "contrib/42-"),
        (None, "contrib/42-"),
    ],
)
def test_branch_name(spark, title, expected):
    assert value(spark, X.branch_name(F.lit(42), F.lit(title).cast("string"))) == expected


@pytest.mark.parametrize(
    "title, kind, expected",
    [
        ("Reject tokens", "bug", "fix: Reject tokens\n\nCloses #7"),
        ("Explain", "docs", "docs: Explain\n\nCloses #7"),
        ("Add x", "feature", "feat: Add x\n\nCloses #7"),
        ("Move", "refactor", "refactor: Move\n\nCloses #7"),
        ("Other", "unknown", "chore: Other\n\nCloses #7"),
        ("", "bug", "fix: address issue #7\n\nCloses #7"),
        (None, "bug", "fix: address issue #7\n\nCloses #7"),
        ("x" * 80, "bug", "fix: " + "x" * 64 + "...\n\nCloses #7"),
        ("x" * 67, "bug", "fix: " + "x" * 67 + "\n\nCloses #7"),
    ],
)
def test_commit_message(spark, title, kind, expected):
    column = X.commit_message(F.lit(7), F.lit(title).cast("string"), F.lit(kind))
    assert value(spark, column) == expected


@pytest.mark.parametrize(
    "size, expected",
    [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.3 KB"), (1048575, "1024.0 KB"), (1572864, "1.5 MB")],
)
def test_format_size(spark, size, expected):
    assert value(spark, X.format_size(F.lit(size))) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [("^4.19.2", "4.19.2"), (">=0.111.0,<1", "0.111.0"), ("latest", None), ("v1", "1"), ("", None)],
)
def test_version_number(spark, raw, expected):
    assert value(spark, X.version_number(F.lit(raw))) == expected


@pytest.mark.parametrize(
    "directory, target, expected",
    [
        ("src/api", "./users", "src/api/users"),
        ("src/api", "../store", "src/store"),
        ("src/api", "../../x", "x"),
        ("src/api", "../../../x", ".."),
        ("", "./x", "x"),
        ("", "../x", ".."),
        ("a/b", "./c/../d", "a/b/d"),
        ("a/b", "../", "a"),
        ("a/b", "./c//d/.", "a/b/c/d"),
        ("a", "./x/../../../y", ".."),
        ("a", "../b/../c", "c"),
    ],
)
def test_resolve_relative(spark, directory, target, expected):
    assert value(spark, X.resolve_relative(F.lit(directory), F.lit(target))) == expected


def test_diff_stat(spark):
    diff = (
        "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n-old\n+new\n+more\n"
        "diff --git a/y b/y\n--- a/y\n+++ b/y\n@@ -1 +0,0 @@\n-gone\n"
    )
    assert value(spark, X.diff_stat(F.lit(diff))) == "2 file(s) changed, 2 insertion(s), 2 deletion(s)"
    assert value(spark, X.diff_stat(F.lit(""))) == "0 file(s) changed, 0 insertion(s), 0 deletion(s)"


def test_extension_forms_agree(spark):
    paths = ["a.py", ".py", "x/.py", "x/a.b.py", "x.pyc", "py", "x.py/y", "a.", "x/.a.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for row in df.select(
        "path", (X.file_extension(F.col("path")) == ".py").alias("a"), X.has_extension(F.col("path"), ".py").alias("b")
    ).collect():
        assert row.a == row.b, row.path
