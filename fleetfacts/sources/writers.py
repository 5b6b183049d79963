"""Parquet sinks: the landed file table and the fact tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfacts.functions import text as X

BUCKETS = 256


def land_files(
    files: DataFrame,
    path: str,
    partitions: int | None = None,
    mode: str = "overwrite",
    buckets: int | None = None,
) -> None:
    """Write the file table clustered for the operators' filters.

    Rows are spread by (repo_id, path), so a huge repository is many output files, and sorted
    by extension and path inside each, so that row-group statistics skip content that an
    operator does not ask for (root manifests, `.py`, `.sql`, …). With `buckets`, the table is
    also partitioned by a hash bucket of repo_id, so that incremental runs read only the
    buckets of changed repositories; add later rows with mode "append" and the same buckets.
    """
    keyed = files.withColumn("extension", X.file_extension(F.col("path")))
    keys = ["repo_id", "path"]
    if buckets is None:
        spread = keyed.repartition(partitions, *keys) if partitions else keyed.repartition(*keys)
        spread.sortWithinPartitions("extension", "path", "repo_id").write.mode(mode).parquet(path)
        return
    bucket = bucket_column(buckets)
    keyed = keyed.withColumn(bucket, repo_bucket(F.col("repo_id"), buckets))
    # Rebalancing splits a bucket that holds a huge repository and keeps small ones in one file.
    spread = keyed.hint("rebalance", F.col(bucket))
    ordered = spread.sortWithinPartitions(bucket, "extension", "path", "repo_id")
    ordered.write.mode(mode).partitionBy(bucket).parquet(path)


def repo_bucket(repo_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(repo_id), F.lit(buckets)).cast("int")


def bucket_column(buckets: int) -> str:
    """The partition column; it names the bucket count, so that counts cannot be mixed."""
    return f"repo_bucket_{buckets}"


# --- fact tables ---------------------------------------------------------------------

# A fact table is a folder of batches that are never changed:
#   facts/batch=<id>/repo_bucket_<n>=<b>/…   the facts of the batch's repositories
#   repos/batch=<id>/repo_bucket_<n>=<b>/…   those repositories, also the ones without facts
# An id is a number that grows, a random part and `-base` where the batch holds all repositories.
# The batch counts from the moment that Spark has marked its `repos` as written in full.
_BASE = "-base"


def _folder(spark: SparkSession, path: str):
    """The Hadoop file system of a path and the path in its terms."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop


def _subfolders(spark: SparkSession, path: str, pattern: str) -> list[str]:
    system, hadoop = _folder(spark, f"{path}/{pattern}")
    return sorted(s.getPath().getParent().getName() if pattern.endswith("_SUCCESS") else s.getPath().getName() for s in system.globStatus(hadoop) or ())


def fact_batches(spark: SparkSession, path: str) -> list[str]:
    """Ids of the batches that count, oldest first: the newest base and those after it."""
    names = _subfolders(spark, f"{path}/repos", "batch=*/_SUCCESS")
    ids = [name.removeprefix("batch=") for name in names]
    bases = [i for i, name in enumerate(ids) if name.endswith(_BASE)]
    return ids[bases[-1] :] if bases else ids


def _check_buckets(spark: SparkSession, path: str, batches: list[str], bucket: str) -> None:
    if batches:
        if not _subfolders(spark, f"{path}/repos/batch={batches[-1]}", f"{bucket}=*"):
            raise ValueError(f"{path} is not partitioned by {bucket}")


def _write_batch(facts: DataFrame, repos: DataFrame, path: str, buckets: int, base: bool) -> str:
    spark, bucket = facts.sparkSession, bucket_column(buckets)
    earlier = fact_batches(spark, path)
    _check_buckets(spark, path, earlier, bucket)
    number = int(earlier[-1].split("-")[0]) + 1 if earlier else 1
    batch = f"{number:012d}-{uuid.uuid4().hex[:12]}{_BASE if base else ''}"
    of_repo = repo_bucket(F.col("repo_id"), buckets).alias(bucket)
    for part, rows in (("facts", facts), ("repos", repos.select("repo_id").distinct())):
        # Rebalancing by bucket brings small buckets' rows together and splits a bucket that
        # holds a huge repository over many writers, from measured sizes.
        keyed = rows.where("repo_id IS NOT NULL").select("*", of_repo)
        # A row without repository, so that a batch without rows has a file and its schema.
        nothing = [F.lit(None).cast(field.dataType).alias(field.name) for field in rows.schema.fields]
        marker = spark.range(1).select(*nothing, F.lit(0).alias(bucket))
        keyed.unionByName(marker).hint("rebalance", F.col(bucket)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").partitionBy(bucket).parquet(f"{path}/{part}/batch={batch}")
    return batch


def write_facts(
    facts: DataFrame,
    path: str,
    repos: DataFrame | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Replace the facts of some repositories, keeping everyone else's.

    The facts of `repos` (default: the repositories in `facts`) are written as a new batch; no
    earlier row is read or written again. `read_facts` takes each repository from its newest
    batch, also if that has no fact of it. A writer that is killed leaves files that no reader
    looks at. One writer at a time; `compact_facts` makes one batch of many.
    """
    path = path.rstrip("/")
    _write_batch(facts, facts if repos is None else repos, path, buckets, base=False)


def compact_facts(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """Write what `read_facts` finds as one batch, the base of all later ones.

    Files of earlier batches stay until `vacuum_facts`, so that readers that began before
    go on. Killed halfway, it changes nothing.
    """
    path = path.rstrip("/")
    batches = fact_batches(spark, path)
    if len(batches) < 2:
        return
    repos = _read_part(spark, path, "repos", batches).select("repo_id")
    _write_batch(read_facts(spark, path, buckets=buckets), repos, path, buckets, base=True)


def vacuum_facts(spark: SparkSession, path: str) -> list[str]:
    """Delete batches that no reader that begins now looks at; returns their ids.

    Also those that a killed writer left. Call it while no writer is at work.
    """
    path = path.rstrip("/")
    kept = {f"batch={b}" for b in fact_batches(spark, path)}
    gone = set()
    # The repositories of a batch go first, so that a batch without its facts never counts.
    for part in ("repos", "facts"):
        for name in _subfolders(spark, f"{path}/{part}", "batch=*"):
            if name not in kept:
                system, hadoop = _folder(spark, f"{path}/{part}/{name}")
                system.delete(hadoop, True)
                gone.add(name.removeprefix("batch="))
    return sorted(gone)


def _read_part(spark: SparkSession, path: str, part: str, batches: list[str]) -> DataFrame:
    table = spark.read.option("basePath", f"{path}/{part}").parquet(*[f"{path}/{part}/batch={b}" for b in batches])
    return table.where("repo_id IS NOT NULL")


def read_facts(
    spark: SparkSession, path: str, repo_ids: list[str] | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Fact table; for named repositories only their buckets are read.

    Each repository's facts are those of its newest batch. With one batch, as after
    `compact_facts`, that is every row, and nothing is joined.
    """
    path, bucket = path.rstrip("/"), bucket_column(buckets)
    batches = fact_batches(spark, path)
    if not batches:
        raise FileNotFoundError(f"no facts in {path}")
    _check_buckets(spark, path, batches, bucket)

    def asked(table: DataFrame) -> DataFrame:
        if repo_ids is None:
            return table
        in_bucket = F.lit(False)
        for repo_id in repo_ids:
            in_bucket = in_bucket | (F.col(bucket) == repo_bucket(F.lit(repo_id), buckets))
        return table.where(in_bucket & F.col("repo_id").isin(repo_ids))

    facts = asked(_read_part(spark, path, "facts", batches))
    if len(batches) > 1:
        newest = asked(_read_part(spark, path, "repos", batches)).groupBy("repo_id").agg(F.max("batch").alias("batch"))
        # One row a repository, which is a small broadcast for named repositories only.
        newest = newest if repo_ids is not None else newest.hint("merge")
        facts = facts.join(newest, ["repo_id", "batch"], "left_semi")
    return facts.drop("batch", bucket)
