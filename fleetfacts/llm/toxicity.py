"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Method: a bounded sample of labelled documents is indexed by inverted lists. Examples are ordered so that like ones stand together, and cut into
blocks; each common term keeps its largest weight in each block. For a text, the lists of its less common terms give a part of every
cosine, and a block's bound is the largest of these parts plus the text's common terms times their block maxima. The best blocks are
scored exactly, then all blocks whose bound reaches the k-th best cosine so far, so that the k nearest are exact. They vote, weighted by
closeness; the vote is mapped to a probability by a logistic curve fitted on leave-one-out votes of the examples, and the nearest examples are the
evidence. Texts are worked through in batches, as arrays.

Terms are all words of a text. The numbers of documents of every term of the sample are counted in Spark over all documents; a word that no example
has weighs like the words of a single example do on average. Words, and for longer words their first 5, 6 and 7 letters, whose share of the label
differs on the sample by a chi-square test (counted once per preceding word, so that copies of a text count once) weigh more; such
beginnings are terms too. No word is left out of a vector or its norm.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfacts.llm.common import mix, read_table

# Bounds of what is learnt from: labelled rows and their text in bytes. Which rows: by a hash of the id.
MAX_EXAMPLES = 4_000
MAX_EXAMPLE_BYTES = 16_000_000
# Documents that are not held out are learnt from: crc32(doc_id as text) mod 3 other than 1.
FOLDS, HELD_OUT_FOLD = 3, 1
NEIGHBOURS = 15
BLOCK_EXAMPLES = 8
THRESHOLD = 0.7
# A term is telling with a chi-square of at least this (a chance of about 1e-6) and odds that differ this many times from the
# overall odds, which is possible at any share. The weight of a telling term is multiplied by the root of its chi-square, at most by this.
LEAST_CHI_SQUARE = 24.0
LEAST_ODDS = 3.0
MOST_FACTOR = 8.0
# Blocks scored before the bounds of the others are looked at.
FIRST_BLOCKS = 8
# Terms in more than one of this many examples are common: kept as rows over all examples and bounded by blocks.
COMMON_SHARE = 8
# Hashed dimensions in which the order of the examples is found.
ORDER_DIMENSIONS = 256
# Pseudo-votes of the overall share: a document without any neighbour gets just that.
PRIOR_VOTES = 0.5
BATCH_TEXTS = 128
# Entries of inverted lists that are summed at once; a bound on a worker's memory.
BATCH_ENTRIES = 250_000
CACHE_ENTRIES = 20_000

_WORDS = re.compile(r"[^\W\d_]+").findall
_STEMS = (5, 6, 7)


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in _STEMS if len(word) > n)]


def _with_stems(words: Counter) -> Counter:
    out: Counter = Counter()
    for word, n in words.items():
        for term in terms_of(word):
            out[term] += n
    return out


def telling_terms(examples: list[tuple[str, int]]) -> dict[str, float]:
    """Terms that tell the labels apart, either way, and the factors of their weights; as many as the sample tells."""
    # Pairs are kept as hashes, and terms only once, so that the driver holds no word twice.
    seen: tuple[set, set] = (set(), set())
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in examples:
        before = ""
        for word in _WORDS(text.lower()):
            pair = hash((before, word))
            if pair not in seen[label]:
                seen[label].add(pair)
                counts[label][word] += 1
            before = word
    counts = tuple(_with_stems(words) for words in counts)
    total = len(seen[0]) + len(seen[1])
    share = len(seen[1]) / total if total else 0.0
    if not 0.0 < share < 1.0:
        return {}
    scored = []
    for term in counts[0].keys() | counts[1].keys():
        hits, misses = counts[1][term], counts[0][term]
        n = hits + misses
        chi = (hits - n * share) ** 2 / (n * share * (1 - share))
        odds = (hits + 0.5) / (misses + 0.5) * (1 - share) / share
        if chi >= LEAST_CHI_SQUARE and (odds >= LEAST_ODDS or odds <= 1 / LEAST_ODDS):
            scored.append((-chi, term))
    return {term: min(MOST_FACTOR, math.sqrt(-chi)) for chi, term in sorted(scored)}


def heads_of(stems) -> frozenset:
    """The first letters that all words with one of the stems share with it; one look at them spares most words the others."""
    return frozenset(t[: _STEMS[0]] for t in stems)


def term_counts(text: str, stems, heads) -> Counter:
    """Occurrences of the words of a text, and of those of their stems that are in `stems`."""
    words = Counter(_WORDS(text.lower()))
    if heads:
        for word in [w for w in words if w[: _STEMS[0]] in heads]:
            for term in terms_of(word)[1:]:
                if term in stems:
                    words[term] += words[word]
    return words


def like_together(vectors: np.ndarray, leaf: int) -> list[int]:
    """The rows of a matrix, halved along the direction in which they differ most until no more than `leaf` are left."""
    out, todo = [], [np.arange(len(vectors))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out += rows.tolist()
            continue
        centred = vectors[rows] - vectors[rows].mean(0)
        direction = centred[np.argmax((centred**2).sum(1))]
        for _ in range(8):
            direction = centred.T @ (centred @ direction)
            direction /= np.linalg.norm(direction) + 1e-300
        rows = rows[np.argsort(centred @ direction, kind="stable")]
        half = -(-len(rows) // 2 // leaf) * leaf
        todo += [rows[half:], rows[:half]]
    return out


def _slices(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... of all slices, one after the other."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


class Index:
    """Block-max inverted index over labelled examples, and the calibration of their votes.

    A vector holds every word of its text, and so does its norm. `numbers` is asked once for the examples' terms and gives their
    numbers of documents and that of all documents. Without it, the examples are the documents.
    """

    def __init__(self, examples: list[tuple[int, str, int]], numbers: Callable[[list[str]], tuple[dict[str, int], int]] | None = None):
        self.factors = telling_terms([(text, label) for _, text, label in examples])
        self.stems = frozenset(t for t in self.factors if t.endswith("*"))
        self.heads = heads_of(self.stems)
        counts = [self.count(text) for _, text, _ in examples]
        shared: Counter = Counter()
        for c in counts:
            shared.update(c.keys())
        frequency, n_docs = numbers(list(shared)) if numbers else (shared, len(examples))
        self.terms = {t: i for i, t in enumerate(shared)}
        idf = np.array([math.log((1 + n_docs) / (1 + max(1, frequency.get(t, 0)))) + 1 for t in shared])
        alone = np.array([n == 1 for n in shared.values()], bool)
        # Weights by term; the last one is that of a word that no example has.
        self.base = np.append(idf * np.array([self.factors.get(t, 1.0) for t in shared]), idf[alone].mean() if alone.any() else 1.0)
        vectors = [self.encode(c) for c in counts]
        hashed = np.zeros((len(examples), ORDER_DIMENSIONS))
        spread = mix(np.arange(len(self.terms), dtype=np.uint64))
        bucket, sign = (spread % np.uint64(ORDER_DIMENSIONS)).astype(np.int64), np.where(spread >> np.uint64(63), 1.0, -1.0)
        for row, (rows, weight) in zip(hashed, vectors):
            np.add.at(row, bucket[rows], sign[rows] * weight)
        order = like_together(hashed, BLOCK_EXAMPLES)
        self.ids = [examples[i][0] for i in order]
        self.labels = np.array([examples[i][2] for i in order], float)
        self.n_blocks = -(-len(order) // BLOCK_EXAMPLES)
        vectors = [vectors[i] for i in order]
        sizes = np.array(list(shared.values()), np.int64)
        common = np.flatnonzero(sizes * COMMON_SHARE > len(order))
        self.row_of = np.full(len(sizes), -1)
        self.row_of[common] = np.arange(len(common))
        # Inverted lists of the less common terms, and rows over blocks of examples of the common ones.
        places = np.repeat(np.arange(len(order)), [len(v[0]) for v in vectors])
        terms = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        values = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        is_common = self.row_of[terms] >= 0
        self.dense = np.zeros((self.n_blocks, BLOCK_EXAMPLES, len(common)))
        self.dense[places[is_common] // BLOCK_EXAMPLES, places[is_common] % BLOCK_EXAMPLES, self.row_of[terms[is_common]]] = values[is_common]
        self.block_max = np.ascontiguousarray(self.dense.max(1).T)
        terms, places, values = terms[~is_common], places[~is_common], values[~is_common]
        by_term = np.argsort(terms, kind="stable")
        self.places, self.values = places[by_term], values[by_term]
        self.start = np.searchsorted(terms[by_term], np.arange(len(sizes) + 1))
        self.share = (float(self.labels.sum()) + 1) / (len(order) + 2)
        self.slope, self.offset = 1.0, 0.0
        full = [p for p, v in enumerate(vectors) if len(v[0])]
        near = self.nearest_of([vectors[p] for p in full], leave=full)
        self.slope, self.offset = fit_logistic(np.array([self._vote(n) for n in near]), self.labels[full])
        self.empty_share = self._probability([])

    def count(self, text: str) -> Counter:
        """Occurrences of the terms of a text."""
        return term_counts(text, self.stems, self.heads)

    def encode(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """(term, weight) of the terms that examples have; all terms are in the norm."""
        get = self.terms.get
        rows = np.fromiter((get(t, -1) for t in counts), np.int64, len(counts))
        weight = (1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) * self.base[rows]
        known = rows >= 0
        norm = math.sqrt(float(weight @ weight))
        return rows[known], weight[known] / norm if norm else weight[known]

    def weights(self, counts: Counter) -> list[tuple[str, float]]:
        """The same by name."""
        return list(zip([t for t in counts if t in self.terms], self.encode(counts)[1].tolist()))

    def nearest_of(self, vectors: list, k: int = NEIGHBOURS, leave: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each vector the k largest (cosine, place), ties by place, exactly; fewer if fewer share a term. `leave` has a place to pass over."""
        out, self.scored = [], 0
        entries = np.cumsum([int((self.start[rows + 1] - self.start[rows]).sum()) for rows, _ in vectors])
        low = 0
        while low < len(vectors):
            # Texts whose lists have about so many entries together, at least one text.
            limit = (entries[low - 1] if low else 0) + BATCH_ENTRIES
            high = min(max(int(np.searchsorted(entries, limit, side="right")), low + 1), low + BATCH_TEXTS)
            out += self._nearest_batch(vectors[low:high], k, leave[low:high] if leave else None)
            low = high
        return out

    def _nearest_batch(self, vectors, k, leave):
        n, width = len(vectors), self.n_blocks * BLOCK_EXAMPLES
        rows = np.concatenate([v[0] for v in vectors])
        weight = np.concatenate([v[1] for v in vectors])
        owner = np.repeat(np.arange(n), [len(v[0]) for v in vectors])
        row = self.row_of[rows]
        query = np.zeros((n, self.dense.shape[2]))
        query[owner[row >= 0], row[row >= 0]] = weight[row >= 0]
        first, size = self.start[rows], self.start[rows + 1] - self.start[rows]
        at = _slices(first, size)
        part = np.bincount(np.repeat(owner, size) * width + self.places[at], self.values[at] * np.repeat(weight, size), n * width)
        part = part.reshape(n, self.n_blocks, BLOCK_EXAMPLES)
        bounds = part.max(2) + query @ self.block_max
        out = []
        for i in range(n):
            bound = bounds[i]
            head = np.argpartition(-bound, FIRST_BLOCKS)[:FIRST_BLOCKS] if self.n_blocks > FIRST_BLOCKS else np.arange(self.n_blocks)
            left = -1 if leave is None else leave[i]
            scores, places = self._scored(head, part[i], query[i], left)
            least = np.partition(scores, -k)[-k] - 1e-12 if len(scores) >= k else 0.0
            rest = (bound >= least) & (bound > 0)
            rest[head] = False
            if rest.any():
                more, others = self._scored(np.flatnonzero(rest), part[i], query[i], left)
                scores, places = np.concatenate([scores, more]), np.concatenate([places, others])
            best = np.lexsort((places, -scores))[:k]
            out.append([(float(scores[b]), int(places[b])) for b in best if scores[b] > 0])
        return out

    def _scored(self, blocks: np.ndarray, part: np.ndarray, query: np.ndarray, leave: int):
        """(cosines, places) of the examples of some blocks."""
        self.scored += len(blocks)
        scores = part[blocks].ravel() + self.dense[blocks].reshape(len(blocks) * BLOCK_EXAMPLES, len(query)) @ query
        places = (blocks[:, None] * BLOCK_EXAMPLES + np.arange(BLOCK_EXAMPLES)).ravel()
        real = (places < len(self.ids)) & (places != leave)
        return scores[real], places[real]

    def nearest(self, vector: Counter, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        return self.nearest_of([self.encode(vector)], k)[0]

    def _vote(self, near) -> float:
        """Share of the label among the nearest, weighted by squared cosine, drawn to the overall share."""
        weight = sum(c * c for c, _ in near)
        return (sum(c * c * self.labels[p] for c, p in near) + PRIOR_VOTES * self.share) / (weight + PRIOR_VOTES)

    def _probability(self, near) -> float:
        logit = self.slope * self._vote(near) + self.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))

    def scores(self, texts: list[str]) -> list[tuple[float, list[int]]]:
        """(probability, ids of the nearest examples) of each text; without examples one half."""
        if not self.n_blocks:
            return [(0.5, [])] * len(texts)
        near = self.nearest_of([self.encode(self.count(t)) for t in texts])
        return [(self._probability(n), [self.ids[p] for _, p in n[:3]]) for n in near]

    def score(self, vector: Counter) -> tuple[float, list[int]]:
        near = self.nearest(vector)
        return self._probability(near), [self.ids[p] for _, p in near[:3]]


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a slight penalty so that separable votes stay finite."""
    slope, offset = 4.0, -2.0
    if not len(x):
        return slope, offset
    design = np.stack([x, np.ones(len(x))], axis=1)
    beta, penalty = np.array([slope, offset]), np.diag([0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - penalty @ beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.1)), float(beta[1])


def fold():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def labelled_examples(docs: DataFrame, labels: DataFrame) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of the sample: labelled rows outside the held-out fold, lowest hashes of the id first.

    At most MAX_EXAMPLES rows; of these, as many as have MAX_EXAMPLE_BYTES of text together. Rows whose label is
    null, or neither 0 nor 1, and rows without an id are not learnt from; of several labels of an id the largest counts.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold() != HELD_OUT_FOLD))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # At most MAX_EXAMPLES ids are broadcast.
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.octet_length("text").alias("bytes"), "label", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("text_key"))
    kept, left = {}, MAX_EXAMPLE_BYTES
    for row in sorted(found.dropDuplicates(["doc_id"]).collect(), key=lambda r: (r["h"], r["doc_id"])):
        if row["bytes"] <= left:
            kept[(row["doc_id"], row["text_key"])] = row["label"]
            left -= row["bytes"]
    if not kept:
        return []
    wanted = docs.sparkSession.createDataFrame([(*k, v) for k, v in kept.items()], "doc_id long, text_key long, label int")
    rows = (
        texts.withColumn("text_key", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "text_key"])
        .dropDuplicates(["doc_id"]).select("doc_id", "text", "label").collect()
    )
    return sorted((r["doc_id"], r["text"], r["label"]) for r in rows)


def _frequency_batches(shared):
    def run(batches):
        terms, stems = shared.value
        heads, counts = heads_of(stems), np.zeros(len(terms), np.int64)
        for batch in batches:
            for value in batch.column(0):
                found = [terms[t] for t in term_counts(value.as_py() or "", stems, heads) if t in terms]
                counts[found] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], names=["term", "n"])

    return run


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[dict[str, int], int]:
    """(documents by term, number of documents) over all rows of `docs`, for the given words and stems.

    A task sends one number a term, and the driver gets as many as there are terms, which the sample bounds.
    """
    place = {t: i for i, t in enumerate(terms)}
    shared = docs.sparkSession.sparkContext.broadcast((place, frozenset(t for t in terms if t.endswith("*"))))
    counted = docs.select("text").mapInArrow(_frequency_batches(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    numbers = zip(counted.column("term").to_pylist(), counted.column("n").to_pylist())
    return {terms[i]: n for i, n in numbers}, docs.count()


SCHEMA = "doc_id long, score double, nearest array<long>"


def _score_batches(shared, keep_rows: bool):
    def run(batches):
        index, known = Index.__new__(Index), {}
        vars(index).update(shared.value)
        for whole in batches:
            for low in range(0, whole.num_rows, BATCH_TEXTS):
                batch = whole.slice(low, BATCH_TEXTS)
                texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
                keys = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
                if len(known) >= CACHE_ENTRIES:
                    known.clear()
                new = {key: text for key, text in zip(keys, texts) if key not in known}
                known.update(zip(new, index.scores(list(new.values()))))
                columns = [batch.column(i) for i in range(batch.num_columns)] if keep_rows else [batch.column(0)]
                names = batch.schema.names if keep_rows else ["doc_id"]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([known[k][0] for k in keys], pa.float64()), pa.array([known[k][1] for k in keys], pa.list_(pa.int64()))],
                    names=[*names, "score", "nearest"],
                )

    return run


def score_toxicity(docs: DataFrame, labelled: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and ids of up to 3 nearest examples of every row of `docs` (and the columns in `keep`).

    `labelled` holds the texts of the labelled rows; numbers of documents are counted over all of its rows. A null or empty text, like any text
    without a word in common with an example, has no neighbours and gets the calibrated overall share of the label (one half if there are no examples at
    all). Repeated rows are scored each; a null doc_id stays null; other columns are not looked at. Whole texts are read.
    """
    examples = labelled_examples(labelled, labels)
    index = Index(examples, lambda terms: document_frequencies(labelled, terms)) if examples else Index([])
    shared = docs.sparkSession.sparkContext.broadcast(vars(index))
    names = ["doc_id", "text", *keep]
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"`{c}`") for c in names[1:]])
    kinds = dict(picked.dtypes)
    if keep:
        schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", score double, nearest array<long>"
        return picked.mapInArrow(_score_batches(shared, True), schema)
    return picked.mapInArrow(_score_batches(shared, False), SCHEMA)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    scored = score_toxicity(docs, docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return scored.select(
        "doc_id", (F.coalesce(fold(), F.lit(0)) == HELD_OUT_FOLD).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.array_join(F.col("nearest").cast("array<string>"), ",").alias("evidence"),
    )
