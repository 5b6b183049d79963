"""Inputs that once lost rows, characters or keywords."""

from pyspark.sql import functions as F

from fleetfacts.functions.text import decode_ignore
from fleetfacts.operators.inventory import snapshot_changes
from fleetfacts.operators.search import relevance_reason
from fleetfacts.operators.sessions import parse_test_logs


def test_decode_ignore_keeps_genuine_replacement_characters(spark):
    row = spark.createDataFrame([(b"a\xff\xef\xbf\xbdb",)], "content binary")
    assert row.select(decode_ignore(F.col("content"))).first()[0] == "a�b"


def test_unchanged_null_contents_are_no_change(spark):
    schema = "repo_id string, path string, content string"
    old = spark.createDataFrame([("r", "same", None), ("r", "filled", None), ("r", "gone", None)], schema)
    new = spark.createDataFrame([("r", "same", None), ("r", "filled", "x"), ("r", "new", None)], schema)
    assert {(r["path"], r["change"]) for r in snapshot_changes(old, new).collect()} == {
        ("filled", "modified"), ("gone", "deleted"), ("new", "added"),
    }


def test_reason_names_keywords_of_any_rank(spark):
    words = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(f"k{i}").alias("keyword")) for i in range(1, 201)])
    reason = relevance_reason(words, F.array(F.lit(33), F.lit(150)), F.lit(True))
    text = spark.range(1).select(reason).first()[0]
    assert '"k33"' in text and '"k150"' in text and '"k1"' not in text


def test_whole_outputs_and_large_counts(spark):
    output = "x" * 9_000 + " 12345678901 passed, " + "9" * 30 + " failed"
    log = spark.createDataFrame(
        [("s", 1, "pytest", output, 1.0, False)],
        "session_id string, attempt int, command string, output string, duration_seconds double, timed_out boolean",
    )
    row = parse_test_logs(log).first()
    assert (row["passed"], row["failed"], row["errors"], len(row["output"])) == (12_345_678_901, None, 0, len(output))
