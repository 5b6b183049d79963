"""File inventory, directory rollup and snapshot comparison.

All but the rollup and the comparison are projections: one pass over the file table, no
shuffle, and `content` is not read when `size_bytes` is present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfacts.functions import text as X

KEY = ["repo_id", "path"]


def decode_content(raw_files: DataFrame, mode: str = "ignore") -> DataFrame:
    """Binary content to text. `ignore` drops bad bytes, `strict` drops the file."""
    if mode == "ignore":
        return raw_files.withColumn("content", X.decode_ignore(F.col("content")))
    if mode == "strict":
        valid = F.is_valid_utf8(F.col("content").cast("string"))
        return raw_files.where(valid).withColumn("content", X.decode_strict(F.col("content")))
    raise ValueError(f"unknown mode {mode!r}")


def undecodable_files(raw_files: DataFrame) -> DataFrame:
    """Reject rows of a strict read."""
    return raw_files.where(~F.is_valid_utf8(F.col("content").cast("string"))).select(
        *KEY, F.lit("content is not valid UTF-8").alias("reason")
    )


def exclude_vendored(files: DataFrame, match_filename: bool = True) -> DataFrame:
    return files.where(~X.is_vendored(F.col("path"), match_filename))


def _size(files: DataFrame) -> Column:
    if "size_bytes" in files.columns:
        return F.col("size_bytes")
    return F.octet_length("content").cast("bigint")


def file_inventory(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return exclude_vendored(files, match_filename=False).select(
        "repo_id",
        "path",
        _size(files).alias("size_bytes"),
        X.file_extension(path).alias("extension"),
        X.is_important(path).alias("is_important"),
    )


def repository_tree(inventory: DataFrame, repo_ids: list[str] | None = None) -> DataFrame:
    """Files of the named repositories; the filter reaches the scan."""
    if repo_ids is not None:
        inventory = inventory.where(F.col("repo_id").isin(repo_ids))
    return inventory.select("repo_id", "path", "size_bytes", "extension", "is_important")


def directory_rollup(inventory: DataFrame) -> DataFrame:
    """File count and bytes under every ancestor directory.

    The counts are combined on the map side, so a root directory holding every file of a
    huge repository costs one partial row per task.
    """
    path = F.regexp_replace("path", "^/", "")
    parts = F.split(path, "/")
    ancestors = F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
        ),
    )
    exploded = inventory.select(
        "repo_id", "size_bytes", F.explode(ancestors).alias("directory")
    )
    return (
        exploded.groupBy("repo_id", "directory")
        .agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_bytes"))
        .select(
            "repo_id",
            "directory",
            X.file_name(F.col("directory")).alias("name"),
            F.size(F.split("directory", "/")).alias("depth"),
            "file_count",
            "total_bytes",
        )
    )


def tree_nodes(inventory: DataFrame) -> DataFrame:
    """Every directory and file with its parent and its place among its siblings' order.

    `sort_key` orders siblings as a tree view does: directories first, then files, by name.
    """
    dirs = directory_rollup(inventory).select(
        "repo_id",
        F.col("directory").alias("path"),
        "name",
        F.lit(True).alias("is_dir"),
        F.col("total_bytes").alias("size_bytes"),
    )
    path = F.regexp_replace("path", "^/", "")
    leaves = inventory.select(
        "repo_id",
        path.alias("path"),
        X.file_name(path).alias("name"),
        F.lit(False).alias("is_dir"),
        "size_bytes",
    )
    return dirs.unionByName(leaves).select(
        "*",
        X.parent_dir(F.col("path")).alias("parent"),
        F.concat(F.when(F.col("is_dir"), "0").otherwise("1"), "name").alias("sort_key"),
    )


def snapshot_changes(
    old: DataFrame, new: DataFrame, chosen: DataFrame | None = None
) -> DataFrame:
    """Files added, deleted or modified between two snapshots of the file table.

    Contents are hashed before the join, so only keys and digests are shuffled; a null content
    is a content like any other. `chosen`
    (repo_id, path) keeps a selection of the changes.
    """
    before = old.select(*KEY, F.sha2("content", 256).alias("old_sha"), F.lit(True).alias("was"))
    after = new.select(*KEY, F.sha2("content", 256).alias("new_sha"), F.lit(True).alias("is"))
    joined = before.join(after, KEY, "full_outer")
    status = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("is").isNull(), "deleted")
        .when(~F.col("old_sha").eqNullSafe(F.col("new_sha")), "modified")
    )
    changes = joined.select(*KEY, status.alias("change")).where("change IS NOT NULL")
    if chosen is not None:
        changes = changes.join(chosen.select(*KEY), KEY, "left_semi")
    return changes
