"""Line search for a table of queries: grams of the needles, joined to the lines that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetfacts.operators.search import first_matches, search_scope
from fleetfacts.plans.staging import cut_lineage

# A gram is 8 bytes of a needle; 3 of a shorter one, all of one below 3. It is its own key: no two grams share one.
_SIZES = (8, 3, 2, 1, 0)
# Places of the filter: 1 MB, for any number of queries.
_PLACE_BITS = 23
# Bytes of a text that are looked at together.
_BLOCK = 1 << 20


def _helpers():
    """(grams, places) for both sides. Local to this function, they are sent by value."""
    import numpy as np

    def grams(data, size):
        """The integer spelled by the `size` bytes at each offset of a byte array."""
        n = len(data) - size + 1
        if size == 0 or n <= 0:
            return np.zeros(max(n, 0) if size else 1, dtype=np.uint64)
        out = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            out <<= np.uint64(8)
            out |= data[k : k + n]
        return out

    def places(keys, size, scope):
        """Their places in the filter; a query of one repository has a place of its own."""
        import zlib

        salt = (size << 32 | zlib.crc32(scope.encode())) * 0xD6E8FEB86659FD93 & (1 << 64) - 1
        mixed = (keys ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - _bits)

    _bits = _PLACE_BITS
    return grams, places


def _needle_grams():
    grams, places = _helpers()
    sizes = _SIZES

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data = np.frombuffer(row["needle"].encode(), dtype=np.uint8)
                size = next(s for s in sizes if s <= len(data))
                keys = np.unique(grams(data, size))
                at = places(keys, size, row["scope"])
                out += [
                    (row["scope"], row["needle"], size, k, p)
                    for k, p in zip(keys.view(np.int64).tolist(), at.astype(np.int64).tolist())
                ]
            if out:
                columns = [list(c) for c in zip(*out)]
                types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], names=["scope", "needle", "size", "key", "place"]
                )

    return run


def _line_grams(bits: bytes, sizes: list[int], block: int):
    grams, places = _helpers()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little").view(bool)
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64()]
        names = ["repo_id", "path", "line", "text", "scope", "size", "key"]

        def hits(data, size, scope):
            """(offset, key) of the grams that may be asked, in blocks that overlap by a gram less a byte."""
            for start in range(0, len(data), block):
                keys = grams(data[start : start + block + size - 1], size)
                found = np.flatnonzero(held[places(keys, size, scope)])
                if len(found):
                    yield found + start, keys[found]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        rows, weight = [], 0
        for batch in batches:
            for repo, path, text, low in zip(*(batch.column(c) for c in ("repo_id", "path", "content", "low"))):
                repo, path, text, low = repo.as_py(), path.as_py(), text.as_py(), low.as_py()
                data = np.frombuffer(low.encode(), dtype=np.uint8)
                ends = np.flatnonzero(data == 10)
                lines = None
                for scope in [""] if repo is None else ["", f"={repo}"]:
                    for size in sizes:
                        if size == 0:
                            if not held[places(grams(data, 0), 0, scope)][0]:
                                continue
                            n = len(ends) + 1 - (len(data) > 0 and data[-1] == 10)
                            pairs = [(i, 0) for i in range(n)]
                        else:
                            met = [(np.searchsorted(ends, at), keys) for at, keys in hits(data, size, scope)]
                            if not met:
                                continue
                            both = np.stack([np.concatenate([m[0] for m in met]), np.concatenate([m[1] for m in met]).view(np.int64)])
                            pairs = np.unique(both, axis=1).T.tolist()
                        lines = lines or text.split("\n")
                        for i, key in pairs:
                            rows.append((repo, path, i + 1, lines[i], scope, size, key))
                            weight += len(lines[i]) + 64
                            if weight > 8 << 20:
                                yield packed(rows)
                                rows, weight = [], 0
        if rows:
            yield packed(rows)

    return run


def needle_keys(queries: DataFrame) -> DataFrame:
    """(query_id, scope, needle, size, key, place): each needle with one of its grams.

    It is the one that the fewest needles of its scope have, so that needles alike meet few lines of each other.
    """
    scope = F.when(F.col("repo_id").isNull(), "").otherwise(F.concat(F.lit("="), "repo_id"))
    asked = queries.select("query_id", scope.alias("scope"), F.lower("needle").alias("needle")).where(
        "needle IS NOT NULL AND NOT contains(needle, '\n')"
    )
    schema = "scope STRING, needle STRING, size INT, key BIGINT, place BIGINT"
    grams = asked.select("scope", "needle").distinct().mapInArrow(_needle_grams(), schema)
    gram = ["scope", "size", "key"]
    rarest = (
        grams.join(grams.groupBy(*gram).agg(F.count("*").alias("n")), gram)
        .groupBy("scope", "needle")
        .agg(F.min(F.struct("n", "size", "key", "place")).alias("best"))
    )
    return asked.join(rarest, ["scope", "needle"]).select("query_id", "scope", "needle", "best.size", "best.key", "best.place")


def search_queries(files: DataFrame, queries: DataFrame, max_matches: int | None = None) -> DataFrame:
    """Lines containing each needle, ignoring case, for a table of queries of any length.

    `queries` is (query_id, repo_id or null for all, needle). Rows are those of `code_search`, whose
    queries are literals of the plan. Each needle is looked up by one of its grams: tasks
    pass over a text once for each gram size in use, keep the lines with a gram that a filter of 1 MB lets
    through, and those are joined to the needles on (scope, gram) and tested for all of the needle. A query of
    one repository meets lines of that repository only. Null contents and needles, and needles of more than a line, match nothing; the
    empty needle matches every line. Runs jobs when it is called: the needles' grams are written
    below `spark.checkpoint.dir`, and at most 131,072 words of the filter come to the driver.
    """
    keys = cut_lineage(needle_keys(queries), "needles")
    words = keys.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("bits")
    )
    bits = bytearray(1 << (_PLACE_BITS - 3))
    for row in words.collect():
        bits[row["word"] * 8 : row["word"] * 8 + 8] = (row["bits"] & (1 << 64) - 1).to_bytes(8, "little")
    sizes = sorted(r["size"] for r in keys.select("size").distinct().collect())
    texts = search_scope(files).where("content IS NOT NULL").select("repo_id", "path", "content", F.lower("content").alias("low"))
    lines = texts.mapInArrow(
        _line_grams(bytes(bits), sizes, _BLOCK),
        "repo_id STRING, path STRING, line INT, text STRING, scope STRING, size INT, key BIGINT",
    )
    found = (
        lines.join(keys.drop("place"), ["scope", "size", "key"])
        .where(F.contains(F.lower("text"), F.col("needle")))
        .select("repo_id", "query_id", "path", "line", "text")
    )
    return first_matches(found, max_matches)
