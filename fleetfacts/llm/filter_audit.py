"""How text filters interact: what each removes, in every order, from one count of failure masks.

Method: every document becomes a mask with one bit per failed filter, and documents are counted per part and mask. The subsets of
filters are then walked in Gray-code order, one filter toggled at a time: each mask cell keeps the number of active filters that it fails,
and the cells that come to or leave zero move the running number of survivors. All states are stored; a step of an order is the difference
of two of them. Five filters make 32 cells and 32 states a part, whatever the number of documents.
"""

from __future__ import annotations

import math
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfacts.llm.common import cut_lineage, read_table

FILTERS = "ABCDE"
# Limits of the filters: words, distinct words in percent of words, capitals in percent of code points, and marks.
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, MARKS = 200, 50, 3, "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = r"[\x20\x09-\x0D]+"

_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{name} long" for name in _COUNTS)


def own_failures(text: Column) -> Column:
    """The bits of the filters that look at one text only: A 1, B 2, C 4, D 8."""
    words = F.filter(F.split(text, _BLANKS), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    fails = [
        n < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT_PERCENT * n,
        100 * capitals > MOST_CAPITALS_PERCENT * F.length(text),
        text.rlike(MARKS),
    ]
    return sum((F.when(f, 1 << bit).otherwise(0) for bit, f in enumerate(fails)), F.lit(0))


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every row of `docs` (doc_id, text, lang).

    A null text is empty, and so is a null lang. Filter E (16) fails a row if a row with a smaller doc_id has the same text; rows without
    doc_id neither fail it nor make another fail. Rows that repeat a doc_id with the same text are alike, so that none of them is later.
    Texts don't leave the tasks that read them: what is shuffled is a SHA-256 of each.
    """
    text = F.coalesce("text", F.lit(""))
    light = cut_lineage(
        docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), own_failures(text).alias("own"), F.unhex(F.sha2(text, 256)).alias("digest")),
        "masks",
    )
    # A digest of any number of rows is one row of an aggregate; joined with its smallest doc_id, so that it is no hot key.
    firsts = light.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return light.join(firsts, ["digest", "doc_id"], "left").select(
        "doc_id", "part", (F.col("own") + F.when(later, 16).otherwise(0)).alias("mask")
    )


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: documents of every cell, those labelled quality = 1, those labelled toxic = 1.

    Of several labels of an id, any that says 1 counts.
    """
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"),
    )
    return masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )


def subset_states(cells: dict[int, tuple[int, ...]], n_filters: int) -> list[tuple[int, ...]]:
    """By set of active filters, the sums over the cells that fail none of them; `cells` has counts by mask."""
    running = [sum(column) for column in zip(*cells.values())]
    active_failures, states = dict.fromkeys(cells, 0), [()] * (1 << n_filters)
    active = 0
    states[0] = tuple(running)
    for turn in range(1, 1 << n_filters):
        # The lowest set bit of the turn is the filter that a reflected Gray code toggles.
        bit = turn & -turn
        active ^= bit
        change = 1 if active & bit else -1
        for mask, counts in cells.items():
            if mask & bit:
                active_failures[mask] += change
                if active_failures[mask] == max(change, 0):
                    running = [r - change * c for r, c in zip(running, counts)]
        states[active] = tuple(running)
    return states


def audit_rows(part: str, cells: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """One row per order of the filters and step, as in `SCHEMA`."""
    n, everything = len(filters), (1 << len(filters)) - 1
    states = subset_states(cells, n)
    fails = [sum(c[0] for mask, c in cells.items() if mask >> f & 1) for f in range(n)]
    alone = [states[everything ^ 1 << f][0] - states[everything][0] for f in range(n)]
    # A set of k filters stands before a given one in k! (n - 1 - k)! of all orders.
    shapley = [
        sum(
            math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count()) * (states[s][0] - states[s | 1 << f][0])
            for s in range(everything + 1) if not s >> f & 1
        )
        for f in range(n)
    ]
    out = []
    for order in permutations(range(n)):
        name, active = "".join(filters[f] for f in order), 0
        for step, f in enumerate(order, 1):
            before, after = states[active], states[active | 1 << f]
            active |= 1 << f
            removed, good, toxic = (b - a for b, a in zip(before, after))
            out.append((part, name, step, after[0], removed, fails[f] - removed, alone[f], good, toxic, shapley[f]))
    return out


def _audit_batches(batches):
    for batch in batches:
        for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = audit_rows(part, {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in cells})
            kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(_COUNTS)]
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *_COUNTS])


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does in each of the 120 orders, by part (see `SCHEMA`); no rows for an empty table.

    Each part has at most 32 cells, so that what is grouped by part is bounded. Other columns of either table are not looked at.
    """
    cells = mask_cells(failure_masks(docs), labels)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(_audit_batches, SCHEMA)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return audit_filters(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
),
w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    min(doc_id) OVER (PARTITION BY text) AS first_id
  FROM d
),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
),
m AS (
  SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, [
    len(words) < 200,
    100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(w.doc_id > first_id, false)
  ] AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
),
f AS (SELECT unnest(generate_series(1, 5)) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e
  WHERE a.i NOT IN (b.i, c.i, d.i, e.i) AND b.i NOT IN (c.i, d.i, e.i) AND c.i NOT IN (d.i, e.i) AND d.i <> e.i
),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
s AS (
  SELECT part, list_aggregate(list_transform(o, lambda x: 'ABCDE'[x]), 'string_agg', '') AS filter_order, i AS step, o[i] AS f, n, good, toxic, fails,
    list_bool_or(list_transform(o[1 : i - 1], lambda x: fails[x])) IS TRUE AS gone
  FROM g, o, f
),
r AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT gone AND NOT fails[f] THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND fails[f] THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fails[f] THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails[f] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fails[f] THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND fails[f] THEN toxic ELSE 0 END) AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""
