"""Benchmark decontamination by a broadcast hash set of normalised windows.

Method: every benchmark item is cut into windows of ten normalised words; their hashes are broadcast with the
windows themselves. Tasks hash each window of the documents' words in numpy, look the hashes up, and verify every hit on
the words. What is hit can be removed as spans or as documents.

The benchmark is broadcast in blocks of at most `block_bytes` of text (one item that is longer is a block's
excess). One block, the usual case, is one pass without a shuffle; with more, each block is a pass of its own
over the documents and the hits of a document are united by a grouping.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfacts.llm.common import WORD_BYTES, chunks, read_table, text_arrays, window_hashes, words_of

WINDOW = 10
BLOCK_BYTES = 8_000_000
_TABLE_BITS = 22

_LOWER_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _word_list(body: np.ndarray, starts, ends) -> list[bytes]:
    data = body.tobytes().translate(_LOWER_TABLE)
    return [data[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


def item_windows(items: list[tuple], size: int = WINDOW) -> dict[int, dict[bytes, set]]:
    """Windows of (item_id, text) rows: by length, the window's words joined by spaces, to its items' ids."""
    out: dict[int, dict[bytes, set]] = {}
    for item_id, text in items:
        body, offsets = text_arrays(pa.array([text], pa.string()))
        _, starts, ends, _ = words_of(body, offsets, WORD_BYTES)
        words = _word_list(body, starts, ends)
        length = min(size, len(words))
        for i in range(len(words) - length + 1 if length else 0):
            window = b" ".join(words[i : i + length])
            out.setdefault(length, {}).setdefault(window, set()).add("" if item_id is None else str(item_id))
    return out


class Matcher:
    """Looks windows of documents up among those of a block of items."""

    def __init__(self, windows: dict[int, dict[bytes, set]]):
        self.windows = windows
        self.tables = {}
        for length, known in windows.items():
            body, offsets = text_arrays(pa.array(list(known), pa.binary()))
            text, _, _, hashes = words_of(body, offsets, WORD_BYTES)
            # Every window has `length` words, so its first word stands at a multiple of it.
            keys = np.unique(window_hashes(hashes, length)[::length])
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[keys & np.uint64((1 << _TABLE_BITS) - 1)] = True
            self.tables[length] = keys, table

    def match(self, body: np.ndarray, offsets: np.ndarray):
        """For each text of a chunk: number of words, hit words' (start, end) in bytes, ids of items."""
        text, starts, ends, hashes = words_of(body, offsets, WORD_BYTES)
        n_words = np.bincount(text, minlength=len(offsets) - 1)
        change = np.zeros(len(hashes) + 1, np.int32)
        items: dict[int, set] = {}
        for length, (keys, table) in self.tables.items():
            windows = window_hashes(hashes, length)
            spots = np.flatnonzero(table[windows & np.uint64((1 << _TABLE_BITS) - 1)])
            spots = spots[text[spots] == text[spots + length - 1]]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, windows[spots]), len(keys) - 1)
                spots = spots[keys[at] == windows[spots]]
            known = self.windows[length]
            for i in spots.tolist():
                words = _word_list(body[starts[i] : ends[i + length - 1]], starts[i : i + length] - starts[i], ends[i : i + length] - starts[i])
                found = known.get(b" ".join(words))
                if found:
                    change[i] += 1
                    change[i + length] -= 1
                    items.setdefault(int(text[i]), set()).update(found)
        hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        spans: dict[int, list] = {}
        for t, s, e in zip(text[hit].tolist(), starts[hit].tolist(), ends[hit].tolist()):
            spans.setdefault(t, []).append((s, e))
        return n_words, spans, items


_FOUND = "n_words long, words array<struct<start: long, end: long>>, items array<string>"
_WORDS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _code_points(data: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Byte offsets as code points."""
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(before[s]), "end": int(before[e])} for s, e in spans]


def _match_batches(shared):
    def run(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            body, offsets = text_arrays(batch.column(1))
            counts, words, items = [], [], []
            for start, end in chunks(offsets):
                part = offsets[start : end + 1]
                block = body[part[0] : part[-1]]
                n_words, spans, found = matcher.match(block, part - part[0])
                counts += n_words.tolist()
                for t in range(end - start):
                    first = int(part[t] - part[0])
                    data = block[first : int(part[t + 1] - part[0])].tobytes() if t in spans else b""
                    words.append(_code_points(data, [(s - first, e - first) for s, e in spans.get(t, [])]))
                    items.append(sorted(found.get(t, ())))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(batch.num_columns)], pa.array(counts, pa.int64()),
                    pa.array(words, _WORDS), pa.array(items, pa.list_(pa.string())),
                ],
                names=[*batch.schema.names, "n_words", "words", "items"],
            )

    return run


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, text, the columns in `keep`, n_words, `words` (hit words' start and end in code points, in order) and `items` of every row.

    A null or empty text, or one without words, is never hit; items without words hit nothing; a null item_id counts
    as an item with the empty id; items that repeat count once by id. Repeated documents are matched each on its
    own; a null doc_id stays null. Columns other than doc_id, item_id and text are not looked at.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *keep)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in picked.dtypes) + ", " + _FOUND
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))

    def one_pass(b: int) -> DataFrame:
        rows = items.where(block == b).collect()
        shared = spark.sparkContext.broadcast(item_windows([tuple(r) for r in rows]))
        return picked.mapInArrow(_match_batches(shared), schema)

    if blocks == 1:
        return one_pass(0)
    key = F.xxhash64("text").alias("text_key")
    passes = [one_pass(b) for b in range(blocks)]
    hits = passes[0].where(F.size("items") > 0)
    for other in passes[1:]:
        hits = hits.union(other.where(F.size("items") > 0))
    merged = hits.groupBy("doc_id", key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    left = passes[0].select("doc_id", "text", *keep, "n_words", key)
    merged = merged.withColumnsRenamed({"doc_id": "hit_id", "text_key": "hit_key"})
    joined = left.join(
        merged, left["doc_id"].eqNullSafe(merged["hit_id"]) & left["text_key"].eqNullSafe(merged["hit_key"]), "left"
    )
    return joined.select(
        *[left[name] for name in ("doc_id", "text", *keep, "n_words")],
        F.coalesce(merged["words"], F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("words"),
        F.coalesce(merged["items"], F.array().cast("array<string>")).alias("items"),
    )


def without_hits(found: DataFrame) -> DataFrame:
    """`text` without its hit words (each with the separators up to the next hit word left in place)."""
    words = F.col("words")
    pieces = F.transform(
        words,
        lambda w, i: F.substring(
            "text",
            (F.when(i == 0, F.lit(0)).otherwise(F.get(words, i - 1)["end"]) + 1).cast("int"),
            (w["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(words, i - 1)["end"])).cast("int"),
        ),
    )
    tail = F.substring("text", (F.element_at(words, -1)["end"] + 1).cast("int"), F.length("text"))
    return found.withColumn(
        "text", F.when(F.size(words) == 0, F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), tail))
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = find_contamination(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    n_hit = F.size("words").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least({WINDOW}, len(w)) AS size FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS window_text
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM b)
),
dw AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS window_text
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM b) WHERE len(w) >= size)
),
hits AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, window_text)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
