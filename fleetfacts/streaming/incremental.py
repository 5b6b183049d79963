"""Incremental analysis: new, changed and deleted files arrive as a stream, facts are replaced.

The stream only says which repositories changed. Import resolution needs all files of a
repository, so each batch re-reads the touched repositories from the file table, takes the
newest row of each of their files, and runs the batch operators on them. A replayed batch
writes the same facts again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetfacts import schemas as S
from fleetfacts.plans.analyze import write_analysis
from fleetfacts.plans.staging import cut_lineage
from fleetfacts.sources.writers import BUCKETS, bucket_column, repo_bucket


# Above so many touched repositories they are joined by a shuffle: a table of short names looks small when
# written, but one that is broadcast lies unpacked in the driver's memory.
MANY_REPOS = 50_000


def current_files(landed: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """The newest row of each file (of some repositories), without files whose newest row deletes them.

    `landed` is read from Parquet with the columns of LANDED_FILES. The highest version is the
    newest, a missing one being the lowest; among equal versions the row landed last. The choice
    is made on keys, so no content is read for rows that have been replaced. The chosen places, one
    per file, are joined by a shuffle at any number, never through the driver.
    """
    rows = landed.select(
        "repo_id",
        "path",
        "content",
        "size_bytes",
        F.coalesce("deleted", F.lit(False)).alias("deleted"),
        F.struct("_metadata.file_path", "_metadata.row_index").alias("place"),
        F.struct("version", F.col("_metadata.file_modification_time").alias("at")).alias("age"),
    )
    if repos is not None:
        many = repos.limit(MANY_REPOS + 1).count() > MANY_REPOS
        rows = rows.join(repos.hint("merge") if many else repos, "repo_id", "left_semi")
    newest = rows.groupBy("repo_id", "path").agg(F.max_by("place", F.struct("age", "place")).alias("place"))
    kept = rows.join(newest.select("place").hint("merge"), "place").where("NOT deleted")
    return kept.select("repo_id", "path", "content", "size_bytes")


def refresh_touched(
    arrived: DataFrame,
    files: DataFrame,
    out_dir: str,
    tables: list[str] | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Analyse the repositories of `arrived` again, from the newest state of their files in `files`.

    Every fact table asks for the touched repositories and their files, so both are written once.
    Of a file table that is partitioned by `buckets`, only touched buckets are read; their
    numbers, at most `buckets` integers, go through the driver.
    """
    touched = cut_lineage(arrived.select("repo_id").distinct())
    bucket = bucket_column(buckets)
    if bucket in files.columns:
        of_repo = touched.select(repo_bucket(F.col("repo_id"), buckets).alias(bucket)).distinct()
        files = files.where(F.col(bucket).isin([row[0] for row in of_repo.collect()]))
    current = cut_lineage(current_files(files, touched))
    write_analysis(current, out_dir, touched, tables, buckets)


def start_incremental(
    spark: SparkSession,
    files_path: str,
    out_dir: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    tables: list[str] | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Process what has been added to the landed file table since the last call, then stop.

    The table has the columns of LANDED_FILES; `version` and `deleted` may be missing or null.
    """
    arriving = (
        spark.readStream.schema(S.LANDED_FILES)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(files_path)
    )

    def on_batch(batch: DataFrame, _: int) -> None:
        # The caller's session, not the stream's: adaptive execution is off in the latter.
        files = spark.read.schema(S.LANDED_FILES).parquet(files_path)
        refresh_touched(batch, files, out_dir, tables, buckets)

    return (
        arriving.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
