"""Document fingerprints: MinHash signatures, likeness of signatures, and links by bands.

Method: a document's five-word shingles are hashed; each of `PERMUTATIONS` hash functions (a * x + b) of 64 bits, shifted to
32 (a universal family on 32-bit keys), is taken over all shingles in numpy, and its smallest value is one place of
the signature. The share of equal places estimates the Jaccard similarity. `links` joins bands of signatures in
Spark and verifies the Jaccard similarity on the shingles themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfacts.llm import near_dedup
from fleetfacts.llm.common import chunks, cut_lineage, mix, read_table, text_arrays
from fleetfacts.llm.shingles import shingle_hashes

PERMUTATIONS = 128
_SEEDS = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A = (_SEEDS[:PERMUTATIONS] | np.uint64(1))[:, None]
_B = _SEEDS[PERMUTATIONS:, None]
# Shingles that are put through all hash functions at once: a bound of memory (1 KB each).
_SLICE = 4_096
# Places of a text without shingles, apart from every value of a text with some.
_NONE = np.uint64(1 << 32)


def signatures(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, PERMUTATIONS) of 32-bit values held in 64; rows of texts without words hold _NONE."""
    owner, value = shingle_hashes(body, offsets)
    keys = value >> np.uint64(32)
    out = np.full((len(offsets) - 1, PERMUTATIONS), _NONE, np.uint64)
    for start in range(0, len(keys), _SLICE):
        part, owners = keys[start : start + _SLICE], owner[start : start + _SLICE]
        hashed = (_A * part[None, :] + _B) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
        least = np.minimum.reduceat(hashed, first, axis=1).T
        texts = owners[first]
        out[texts] = np.minimum(out[texts], least)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal places: 1 for two texts without words, 0 for one with and one without."""
    return float(np.mean(a == b))


def as_text(signature: np.ndarray) -> str:
    """Eight hex digits a place; a text without words has the word `empty`."""
    if len(signature) and signature[0] == _NONE:
        return "empty"
    return signature.astype(">u4").tobytes().hex()


def _text_array(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_arrays(pa.array(texts, pa.large_string()))


def _fingerprint_batches(batches):
    for batch in batches:
        body, offsets = text_arrays(batch.column(1))
        prints, bands = [], []
        for start, end in chunks(offsets, most=10_000):
            part = offsets[start : end + 1]
            found = signatures(body[part[0] : part[-1]], part - part[0])
            prints += [as_text(row) for row in found]
            bands.append(near_dedup.band_keys(found, PERMUTATIONS // 4))
        if prints:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints), near_dedup._rows(np.concatenate(bands))],
                names=["doc_id", "text", "fingerprint", "bands"],
            )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint and bands (32 keys of four places) of every row; a null text is an empty one."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return picked.mapInArrow(_fingerprint_batches, "doc_id long, text string, fingerprint string, bands array<long>")


def links(docs: DataFrame) -> DataFrame:
    """Verified links (a, b), a > b, of documents to the smallest doc_id of a band's bucket.

    Equal fingerprints are one class with one representative, so copies cost a row each. Every document of a bucket is
    compared with one hub, not with every other; connect them with `components` for groups.
    """
    found = cut_lineage(fingerprints(docs), "fingerprints")
    reps = found.where("fingerprint != 'empty' AND doc_id IS NOT NULL").groupBy("fingerprint").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands")
    )
    buckets = cut_lineage(reps.select("rep", F.explode("bands").alias("band")), "buckets")
    hubs = buckets.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")
    pairs = buckets.join(hubs, "band").where("rep != hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    texts = found.groupBy("doc_id").agg(F.min("text").alias("text"))
    return near_dedup.confirm(pairs, texts)


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def edited(text: str, following: str) -> str:
    """`text` with its last floor(n/2) code points replaced by the first as many (or all) of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare_batches(batches):
    """Rows sorted by range, then descending doc_id; a row marked `guest` only serves as the next of the one before."""
    waiting = None  # (range, doc_id, text, signature) of the last row seen
    for batch in batches:
        ranges, ids, guests = (batch.column(i).to_pylist() for i in range(3))
        texts = [t or "" for t in batch.column(3).to_pylist()]
        out = []
        body, offsets = _text_array(texts)
        for start, end in chunks(offsets, 500_000, most=2_000):
            part = offsets[start : end + 1]
            own = signatures(body[part[0] : part[-1]], part - part[0])
            pairs = []
            for i in range(start, end):
                if waiting is not None and waiting[0] == ranges[i]:
                    pairs.append((waiting, edited(waiting[2], texts[i]), own[i - start]))
                waiting = None if guests[i] else (ranges[i], ids[i], texts[i], own[i - start])
            if pairs:
                changed = signatures(*_text_array([p[1] for p in pairs]))
                for (_, doc_id, text, signature), new, changed_signature, after in (
                    (p[0], p[1], c, p[2]) for p, c in zip(pairs, changed)
                ):
                    out.append((
                        doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), as_text(signature),
                        as_text(changed_signature), likeness(signature, changed_signature), likeness(signature, after),
                    ))
        columns = list(zip(*out)) if out else [[] for _ in RESULT]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT)], schema=RESULT)


# Rows of one range on average; a range is one sorted run of a task.
RANGE_ROWS = 5_000
MAX_RANGES = 10_000


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row and of its edited text, and the likenesses (columns of SCHEMA).

    The next document is the next by descending doc_id, and after the last the first; rows with an equal
    doc_id follow each other in text order, rows without one come last, by a hash of the text, then the text. A null text is empty. A
    single row is its own next. Repeated rows stay.

    Rows are dealt by ranges of doc_id, from approximate quantiles of the ids; rows without one by ranges of the hash. A range ends
    with a guest, the first row of the range after it; finding those needs the ids only, where every row has one.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, n_ids = picked.agg(F.count("*"), F.count("doc_id")).first()
    if n == 0:
        return spark.createDataFrame([], SCHEMA)
    ranges_for = lambda rows: max(1, min(MAX_RANGES, rows // RANGE_ROWS))
    n_ranges = ranges_for(n_ids)
    cuts = picked.approxQuantile("doc_id", [i / n_ranges for i in range(1, n_ranges)], 0.2 / n_ranges) if n_ranges > 1 else []
    # doc_ids from 2^53 on lose their last bits as doubles; as bounds of ranges that does no harm.
    bounds = sorted({int(c) for c in cuts})
    # Ranges count downwards with doc_id: 0 holds the largest; rows without an id have ranges of their own after all others.
    position, text_key = F.lit(0), F.lit(None).cast("long")
    if bounds:
        above = F.array(*[F.lit(b).cast("long") for b in bounds])
        position = F.size(F.filter(above, lambda b: b > F.col("doc_id")))
    if n_ids < n:
        text_key = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
        # The upper 31 bits of the hash, in its order from 0 on.
        upper = F.shiftrightunsigned(text_key.bitwiseXOR(F.lit(-(1 << 63)).cast("long")), 33)
        beyond = len(bounds) + 1 + F.shiftright(upper * F.lit(ranges_for(n - n_ids)).cast("long"), 31)
        position = F.when(F.col("doc_id").isNull(), beyond).otherwise(position)
    ranged = picked.withColumn("range", position.cast("int")).withColumn("text_key", text_key)
    # The first row of each range: at most MAX_RANGES rows.
    firsts = ranged.groupBy("range").agg(F.max("doc_id").alias("top"), F.min("text_key").alias("top_key")).collect()
    present = sorted(row["range"] for row in firsts)
    before = {r: present[i - 1] for i, r in enumerate(present)}
    first = spark.createDataFrame([(r["range"], r["top"], r["top_key"], before[r["range"]]) for r in firsts], "range int, top long, top_key long, goes_to int")
    guests = (
        ranged.join(F.broadcast(first), "range")
        .where(F.col("doc_id").eqNullSafe(F.col("top")) & F.col("text_key").eqNullSafe(F.col("top_key")))
        .groupBy("goes_to", "top").agg(F.min("text").alias("text"))
        .select(F.col("goes_to").alias("range"), F.col("top").alias("doc_id"), F.lit(True).alias("guest"), F.lit(None).cast("long").alias("text_key"), "text")
    )
    rows = ranged.select("range", "doc_id", F.lit(False).alias("guest"), "text_key", "text").union(guests)
    dealt = rows.repartition(len(present), "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), "text_key", "text")
    return dealt.select("range", "doc_id", "guest", "text").mapInArrow(_compare_batches, SCHEMA)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read_table(spark, sf_dir, "documents", "doc_id", "text"))
