"""Files of checkouts: a walk that lists paths and sizes first, then contents by path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfacts import constants as C
from fleetfacts import schemas as S
from fleetfacts.plans.staging import cut_lineage

# Entries after which a walk hands its remaining directories to the next round.
WALK_ENTRIES = 10_000
# Directories that one task of a round starts from.
TASK_DIRECTORIES = 256
# Bytes and files that one task reads, at most, but for one file; files above MAX_CONTENT have no content.
TASK_BYTES = 128 << 20
TASK_FILES = 10_000
MAX_CONTENT = 1 << 30

# `place` is the file's whole path as bytes, since names need not be text.
_WALKED = "repo_id STRING, path STRING, size_bytes BIGINT, place BINARY, directory BOOLEAN"
LISTED = "repo_id STRING, path STRING, size_bytes BIGINT, place BINARY"


def qualified(spark: SparkSession, root: str) -> str:
    """A folder's path with scheme and authority, as its file system lists it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system.makeQualified(path).toString()


def _walker(root: str, vendored: list[str], most: int):
    """A task's walk below directories. Local to this function, it is sent by value."""

    def local_entries(place):
        import os

        try:
            with os.scandir(place) as entries:
                for entry in entries:
                    # Only the repositories themselves may be links: a link to a file or folder of its
                    # repository repeats what is listed anyway, any other leaves the repository.
                    follow = place == os.fsencode(root)
                    if entry.is_dir(follow_symlinks=follow):
                        yield entry.name, entry.path, None
                    elif entry.is_file(follow_symlinks=False):
                        yield entry.name, entry.path, entry.stat(follow_symlinks=False).st_size
        except (FileNotFoundError, NotADirectoryError, PermissionError):
            return

    def remote_entries(system):
        from pyarrow import fs

        def entries(place):
            for info in system.get_file_info(fs.FileSelector(place.decode(), allow_not_found=True)):
                if info.type in (fs.FileType.Directory, fs.FileType.File):
                    size = info.size if info.type == fs.FileType.File else None
                    yield info.base_name.encode(), info.path.encode(), size

        return entries

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        if root.startswith("/"):
            entries, top = local_entries, root.encode()
        else:
            system, inner = fs.FileSystem.from_uri(root)
            entries, top = remote_entries(system), inner.encode()
        schema = pa.schema([
            ("repo_id", pa.string()), ("path", pa.string()), ("size_bytes", pa.int64()),
            ("place", pa.binary()), ("directory", pa.bool_()),
        ])
        skipped = {name.encode() for name in vendored}
        rows = []
        for batch in batches:
            for start in batch.to_pylist():
                # One directory is always listed; the root's only names the repositories.
                waiting, seen = [(start["repo_id"], start["path"], start["place"] or top)], 0
                first = True
                while waiting and (first or (seen < most and start["repo_id"] is not None)):
                    first = False
                    repo, above, place = waiting.pop()
                    for name, below, size in entries(place):
                        seen += 1
                        text = name.decode("utf-8", "replace")
                        path = text if not above else f"{above}/{text}"
                        if size is not None:
                            if repo is not None:
                                rows.append((repo, path, size, below, False))
                        elif repo is None:
                            waiting.append((text, "", below))
                        elif name not in skipped:
                            waiting.append((repo, path, below))
                        if len(rows) >= 5_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows = []
                rows += [(repo, path, None, place, True) for repo, path, place in waiting]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def list_repo_files(spark: SparkSession, root: str, walk_entries: int = WALK_ENTRIES) -> DataFrame:
    """(repo_id, path, size_bytes, place) of the files of checkouts below `root`, one directory per repository.

    Tasks walk directories; one that has met `walk_entries` entries hands the directories it has left to the next
    round, so a huge repository is dealt out over many tasks and rounds number at most the depth of the tree.
    Vendored and build directories are not entered. Links are not followed: what they show is listed in its own
    place or lies outside of the repository. Files beside the repositories belong to none. What vanishes or may not be
    read is left out. A name that isn't UTF-8 is shown with U+FFFD. Folders are local or of a file system that pyarrow
    knows by URI.
    """
    base = qualified(spark, root)
    if base.startswith("file:"):
        base = "/" + base[len("file:") :].strip("/")
    walk = _walker(base, C.VENDORED_DIRS, walk_entries)
    cores = spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(None, "", None)], "repo_id STRING, path STRING, place BINARY")
    directories, found = 1, []
    while directories:
        tasks = min(directories, max(cores, -(-directories // TASK_DIRECTORIES)))
        walked = cut_lineage(frontier.repartition(tasks).mapInArrow(walk, _WALKED), "listing")
        found.append(walked.where("NOT directory").drop("directory"))
        frontier = walked.where("directory").select("repo_id", "path", "place")
        directories = frontier.count()
    return reduce(DataFrame.unionAll, found)


def _opener(root: str, max_bytes: int):
    """A task's reading of listed files, sent by value."""

    def run(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs

        if root.startswith("/"):
            def read(place):
                # Should a link have taken the file's place since it was listed, it isn't followed.
                with open(os.open(place, os.O_RDONLY | os.O_NOFOLLOW), "rb") as stream:
                    return stream.read()
        else:
            system, _ = fs.FileSystem.from_uri(root)

            def read(place):
                with system.open_input_stream(place.decode(), compression=None) as stream:
                    return stream.read()

        types = [pa.string(), pa.string(), pa.binary(), pa.int64()]
        names = ["repo_id", "path", "content", "size_bytes"]
        rows, held = [], 0

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                size, content = row["size_bytes"], None
                if size <= max_bytes:
                    try:
                        content = read(row["place"])
                    except (FileNotFoundError, PermissionError):
                        pass
                    if content is not None:
                        size = len(content)
                if rows and held + size > 16 << 20:
                    yield packed()
                    rows, held = [], 0
                rows.append((row["repo_id"], row["path"], content, size))
                held += 0 if content is None else size
        if rows:
            yield packed()

    return run


def read_listed(listed: DataFrame, root: str, max_bytes: int = MAX_CONTENT) -> DataFrame:
    """Listed files with their contents, as raw files.

    A file above `max_bytes`, or one that is gone or may not be read, has a null content. Files are dealt out by number,
    since rows of a listing are tiny whatever the files weigh.
    """
    spark = listed.sparkSession
    base = qualified(spark, root)
    if base.startswith("file:"):
        base = "/" + base[len("file:") :].strip("/")
    n, total = listed.agg(F.count("*"), F.sum(F.least("size_bytes", F.lit(max_bytes)))).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // TASK_FILES), -(-(total or 0) // TASK_BYTES))
    return listed.repartition(tasks).mapInArrow(_opener(base, max_bytes), S.RAW_FILES)


def read_repo_files(spark: SparkSession, root: str, max_bytes: int = MAX_CONTENT) -> DataFrame:
    """Checkouts below `root`, one directory per repository, as raw files; paths are relative to the repository.

    Lists first (`list_repo_files`), so nothing in a vendored directory is opened. For a large fleet land the
    files once as Parquet (`land_files`).
    """
    return read_listed(list_repo_files(spark, root), root, max_bytes)
