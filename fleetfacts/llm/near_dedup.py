"""MinHash near-deduplication with fast similarity sketching.

Method: a document's distinct five-word shingles are hashed into T bins in rounds. In each of the first T rounds every
shingle falls into one random bin with a random value; in each of the next T rounds all shingles fall into the
one bin of that round, so that every bin is filled after 2T rounds at most (most documents need one). A bin
keeps its smallest (round, value). Two sketches agree in a bin with the probability of the sets' similarity,
with concentration bounds as of independent samples. Sketches are cut into bands; documents that share a
band are candidates, and every link is confirmed on the full sets of shingles.

Documents with equal sets are one class, sketched and linked once. Within a band's bucket, members are compared with
the bucket's hub, the member with the fullest buckets (first with the hub a class shares most bands with, then, if still
apart, with its other hubs). What is left are pairs of one bucket in different components: all of them
whose sketches may be similar enough are confirmed too. So copies and near copies cost a row each, not a pair each, and no
bucket is cut short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfacts.llm.common import chunks, cut_lineage, mix, read_table, text_arrays
from fleetfacts.llm.components import components
from fleetfacts.llm.shingles import exact_shingles, linked, set_keys, shingle_hashes

BINS = 1_024
# Candidates come from bands of 4 bins over the first 128. A pair of similarity 0.75 shares none of 32 with probability 5e-6.
BANDS, BAND_BINS = 32, 4
# Two bits of each bin are kept next to the bands. At a similarity of 0.75 they agree in 1792 of 2048 places on average,
# with a deviation of about 17.9; fewer than 1694 agree with a probability of 8.6e-8 (summed exactly, bits of a bin together).
AGREEING_BITS = 1_694
# Texts sketched together, a bound of memory.
CHUNK_TEXTS = 1_000
# Up to this many pairs, the ids of their texts are broadcast (16 bytes each); beyond it, they are joined by a shuffle.
BROADCAST_PAIRS = 200_000

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(owner: np.ndarray, value: np.ndarray, n_texts: int, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches, (n_texts, bins); rows of texts without shingles stay empty."""
    slots = np.full(n_texts * bins, _EMPTY, np.uint64)
    active_owner, active_value = owner, value
    for turn in range(2 * bins):
        if not len(active_owner):
            break
        spread = mix(active_value + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        if turn < bins:
            place = (spread >> np.uint64(40)).astype(np.int64) % bins
        else:
            place = np.full(len(spread), turn - bins)
        ranked = np.uint64(turn << 40) | (spread & np.uint64((1 << 40) - 1))
        np.minimum.at(slots, active_owner * bins + place, ranked)
        # A filled sketch isn't changed by further rounds, so not every round looks which ones are filled.
        if turn < 4 or turn % 16 == 0:
            texts = np.unique(active_owner)
            unfilled = np.zeros(n_texts, bool)
            unfilled[texts] = (slots.reshape(n_texts, bins)[texts] == _EMPTY).any(axis=1)
            more = unfilled[active_owner]
            active_owner, active_value = active_owner[more], active_value[more]
    return slots.reshape(n_texts, bins)


def band_keys(sketch: np.ndarray, bands: int = BANDS, bins: int = BAND_BINS) -> np.ndarray:
    """One 64-bit key of each band, (n_texts, bands); the band's number is part of the key."""
    parts = sketch[:, : bands * bins].reshape(len(sketch), bands, bins)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out


def agreeing_bits(sketch: np.ndarray) -> np.ndarray:
    """Two bits of each bin, as 64-bit words."""
    mixed = mix(sketch.ravel()).reshape(sketch.shape)
    bits = np.concatenate([mixed & np.uint64(1), mixed >> np.uint64(63)], axis=1).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64)


SKETCH_SCHEMA = "doc_id long, n_shingles long, set_key binary, bands array<long>, bits array<long>"


def _rows(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(matrix.view(np.int64).ravel())
    )


def _sketch_batches(batches):
    for batch in batches:
        body, offsets = text_arrays(batch.column(1))
        counts, keys, bands, bits = [], [], [], []
        for start, end in chunks(offsets, most=CHUNK_TEXTS):
            part = offsets[start : end + 1]
            owner, value = shingle_hashes(body[part[0] : part[-1]], part - part[0])
            n = end - start
            sketch = sketches(owner, value, n)
            counts.append(np.bincount(owner, minlength=n))
            keys += [row.tobytes() for row in set_keys(owner, value, n)]
            bands.append(band_keys(sketch))
            bits.append(agreeing_bits(sketch))
        if counts:
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(keys, pa.binary()),
                    _rows(np.concatenate(bands)), _rows(np.concatenate(bits)),
                ],
                names=["doc_id", "n_shingles", "set_key", "bands", "bits"],
            )


def _confirm_batches(batches):
    last, known = None, set()
    for batch in batches:
        keep = []
        for text_a, b, text_b in zip(*(batch.column(i) for i in (2, 1, 3))):
            if b.as_py() != last:
                last, known = b.as_py(), exact_shingles(text_b.as_py())
            keep.append(linked(exact_shingles(text_a.as_py()), known))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"]
        )


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as a written table. `texts` has one row per doc_id."""
    pairs = cut_lineage(pairs, "pairs")
    if pairs.count() <= BROADCAST_PAIRS:
        ids = F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        texts = cut_lineage(texts.join(ids, "doc_id", "left_semi"), "texts")
    of_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    of_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "text_a", "text_b")
    return cut_lineage(both.mapInArrow(_confirm_batches, "a long, b long"), "confirmed")


def _labelled(members: DataFrame, mapping: DataFrame) -> DataFrame:
    """Members of buckets with their own and their hub's component."""
    of_rep = mapping.select(F.col("node").alias("rep"), F.col("root").alias("rep_root"))
    of_hub = mapping.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    return members.join(of_rep, "rep", "left").join(of_hub, "hub", "left").select(
        "band", "rep", "hub", F.coalesce("rep_root", "rep").alias("component"),
        F.coalesce("hub_root", "hub").alias("hub_component"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs` (columns doc_id and text are read).

    A null or empty text, or one without words, has no shingles and is linked with nothing. Rows with an equal
    doc_id each have their own row here; links through such an id are confirmed on its first text in order. A row without doc_id is its own component, null, and kept. Texts of any length are
    taken whole.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sketched = cut_lineage(picked.mapInArrow(_sketch_batches, SKETCH_SCHEMA), "sketches")
    with_words = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut_lineage(
        with_words.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("bits").alias("bits")),
        "classes",
    )
    buckets = classes.select("rep", F.explode("bands").alias("band"))
    sizes = buckets.groupBy("band").count().where("count > 1")
    crowded = cut_lineage(buckets.join(sizes, "band"), "crowded")
    # The original of many near copies shares more bands with them than they share with each other, so the member
    # whose buckets are the fullest is compared with the others.
    scores = crowded.groupBy("rep").agg(F.sum("count").alias("score"))
    scored = crowded.join(scores, "rep")
    hubs = scored.groupBy("band").agg(F.max_by("rep", F.struct("score", -F.col("rep"))).alias("hub"))
    members = cut_lineage(crowded.select("band", "rep").join(hubs, "band"), "members")

    # One row per document that shares a bucket, with its text.
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = cut_lineage(picked.join(wanted, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")), "texts")

    shared = members.where("rep != hub").groupBy("rep", "hub").count()
    best = shared.groupBy(F.col("rep").alias("a")).agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("b"))
    best = cut_lineage(best, "best")
    links = confirm(best, texts)
    labelled = cut_lineage(_labelled(members, components(links)), "labelled")
    # The other hubs of what is still apart from them.
    others = labelled.where("component != hub_component").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    others = cut_lineage(others.join(best, ["a", "b"], "left_anti"), "others")
    links = links.union(confirm(others, texts))
    labelled = _labelled(members, components(links))
    labelled = cut_lineage(labelled, "labelled")
    apart = labelled.where("component != hub_component")
    open_buckets = apart.select("band").distinct()
    open_members = cut_lineage(
        labelled.join(open_buckets, "band", "left_semi").join(classes.groupBy("rep").agg(F.first("bits").alias("bits"), F.first("bands").alias("bands")), "rep"), "open"
    )
    left = open_members.where("component != hub_component").select(
        "band", F.col("rep").alias("a"), F.col("component").alias("component_a"), F.col("bits").alias("bits_a"), F.col("bands").alias("bands_a")
    )
    right = open_members.select(
        "band", F.col("rep").alias("b"), F.col("component").alias("component_b"), F.col("bits").alias("bits_b"), F.col("bands").alias("bands_b"),
        "hub_component"
    )
    differing = sum(F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(2 * BINS // 64))
    # A pair that shares several bands comes out of the first one only.
    common = F.zip_with("bands_a", "bands_b", lambda a, b: F.when(a == b, a))
    first_common = F.get(F.filter(common, lambda band: band.isNotNull()), 0)
    pairs = left.join(right, "band").where(
        (F.col("component_a") != F.col("component_b"))
        & ((F.col("component_b") == F.col("hub_component")) | (F.col("a") < F.col("b")))
        & (2 * BINS - differing >= AGREEING_BITS)
        & (first_common == F.col("band"))
    )
    rest = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mapping = components(links.union(confirm(rest, texts)))

    own = sketched.join(classes.select("set_key", "rep"), "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "rep", "doc_id")).otherwise(F.col("doc_id"))
    result = own.join(mapping.select(F.col("node").alias("rep"), "root"), "rep", "left")
    return result.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s AS a JOIN s AS b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM pairs JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(doc_id, coalesce(min(b), doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(min(b), doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id GROUP BY doc_id
"""
