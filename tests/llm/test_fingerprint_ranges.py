"""Rows without doc_id come last at every table size."""

import hashlib

from pyspark.sql import functions as F

from fleetfacts.llm import fingerprint


def test_order_of_rows_without_id_does_not_change_with_ranges(spark, monkeypatch):
    rows = [(i * 7 % 40, f"text {i} of the table") for i in range(40)] + [(None, f"no id {i} here") for i in range(20)]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    keys = {r["text"]: r["k"] for r in docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.xxhash64("text")).collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    order += sorted(((None, t) for i, t in [*rows, (None, "")] if i is None), key=lambda r: (keys[r[1]], r[1]))
    want = sorted(
        (str(i), hashlib.sha256(fingerprint.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order)
    )
    for size in (5_000, 7, 1):
        monkeypatch.setattr(fingerprint, "RANGE_ROWS", size)
        got = fingerprint.compare_with_next(docs).collect()
        assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got) == want
    no_ids = docs.where("doc_id IS NULL")
    assert fingerprint.compare_with_next(no_ids).count() == 21
