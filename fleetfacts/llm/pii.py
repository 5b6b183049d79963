"""Personal data by candidate spans and boosted trees, in DataFrame functions only.

Method: patterns of high recall propose spans, which may overlap. Validated base spans are always kept. The other candidates are
scored by gradient-boosted trees over small integer features of format (digits, separators, letters) and context (words
and characters around); those above a threshold calibrated for their generator are added. The trees learn to tell examples from the
rest: candidates that, once their writing is normalised (`[at]`, `[dot]`, missing country code), are an address or a number of the
usual form, whether or not a base pattern finds anything in them. Features are small integers, so the training set is a table of counts per combination of
features: it is counted over all documents, is bounded by the features' ranges whatever the data, and the trees are
fitted to it on the driver. Trees become column expressions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfacts.llm.common import cut_lineage, read_table

# Fixed: the base kinds, in the order in which they are listed, then those of added spans.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "email_like", "obfuscated", "number_like")

# The base patterns, in a form that Java's engine runs in linear time: runs are possessive, and a match begins at the
# first character of a run or right after the match before.
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# High-recall generators.
CANDIDATE_PATTERNS = {
    "email_like": r"""(?<![^\s@<>()\[\]"',;:])[^\s@<>()\[\]"',;:]{1,64}+@[^\s@<>()\[\]"',;:]{3,255}+""",
    "obfuscated": r"(?i)\b[a-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[a-z0-9-]{1,63}+(?: ?(?:[\[(]dot[\])]|\.) ?[a-z0-9-]{1,63}+){1,4}+",
    "number_like": r"[+(]{0,2}[0-9][0-9 ().-]{5,30}[0-9]",
}
# What a text must contain before a pattern is tried.
GATES = {
    "email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+", "email_like": "@", "obfuscated": r"[\[(][aA][tT][\])]",
    "number_like": "[0-9]",
}
CONTEXT_CHARS = 24
CONTEXT_WORDS = r"(?i)(?:mail|phone|tel|call|fax|mobile|cell|contact|card|visa|account|iban|ssn|ip|host|server|address)\b"

BLOCK = 64


PIECE = "array<struct<gap: int, size: int, value: string, before: string, after: string>>"
PLACED = "array<struct<start: int, end: int, value: string, before: string, after: string>>"


def matches(text: Column, pattern: str, gate: str) -> Column:
    """Every match with the length of the gap before it, what stands before (CONTEXT_CHARS at most) and the character after."""
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(
        gaps, values,
        lambda gap, v: F.struct(F.length(gap).alias("gap"), v.alias("value"), gap.alias("text")),
    )
    # The last gap has no match of its own; it only gives the character after the last match.
    following = F.transform(gaps, lambda g: F.left(g, F.lit(1)))
    found = F.transform(
        F.slice(pieces, F.lit(1), F.size(values)),
        lambda p, i: F.struct(
            p["gap"].alias("gap"), F.length(p["value"]).alias("size"), p["value"].alias("value"),
            F.right(p["text"], F.lit(CONTEXT_CHARS)).alias("before"), F.get(following, i + 1).alias("after"),
        ),
    )
    return F.when(text.rlike(gate), found).otherwise(F.array().cast(PIECE))


def placed(pieces: Column) -> Column:
    """Pieces with their positions: sums over blocks of BLOCK pieces first, so that long arrays cost no square."""
    advance = lambda p: p["gap"] + p["size"]
    n_blocks = F.ceil(F.size(pieces) / BLOCK).cast("int")
    numbers = F.sequence(F.lit(0), n_blocks - 1)
    block = lambda b: F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK))
    starts = F.aggregate(
        numbers,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, b: F.struct(
            (acc["at"] + F.aggregate(block(b), F.lit(0), lambda s, p: s + advance(p))).alias("at"),
            F.concat(acc["all"], F.array(acc["at"])).alias("all"),
        ),
        lambda acc: acc["all"],
    )
    all_placed = F.flatten(F.transform(
        starts,
        lambda start, b: F.aggregate(
            block(b),
            F.struct(start.alias("at"), F.array().cast(PLACED).alias("all")),
            lambda acc, p: F.struct(
                (acc["at"] + advance(p)).alias("at"),
                F.concat(acc["all"], F.array(F.struct(
                    (acc["at"] + p["gap"]).alias("start"), (acc["at"] + advance(p)).alias("end"),
                    p["value"].alias("value"), p["before"].alias("before"), p["after"].alias("after"),
                ))).alias("all"),
            ),
            lambda acc: acc["all"],
        ),
    ))
    return F.when(F.size(pieces) > 0, all_placed).otherwise(F.array().cast(PLACED))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True for digits whose Luhn sum is a multiple of ten."""
    backwards = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc + F.element_at(
            F.when(i % 2 == 1, F.array(*map(F.lit, (0, 1, 2, 3, 4, 5, 6, 7, 8, 9))))
            .otherwise(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))),
            F.substring(backwards, i, F.lit(1)).cast("int") + 1,
        ),
    )
    return (F.length(digits) > 0) & (total % 10 == 0)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(digits_of(value))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits_of(value))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


# Features of a candidate and the number of their values.
FEATURES = {"generator": 3, "digits": 8, "separators": 5, "dots": 5, "signs": 4, "context": 2, "left": 4, "right": 4}


def _step(value: Column, bounds: tuple[int, ...]) -> Column:
    """How many of the bounds a value reaches."""
    return reduce(lambda a, b: a + b, [(value >= b).cast("int") for b in bounds])


def _side(character: Column) -> Column:
    """0 at the text's end, 1 white space, 2 letter or digit, 3 other."""
    return F.when(character == "", 0).when(character.rlike(r"^\s$"), 1).when(character.rlike(r"^[\p{L}\p{N}]$"), 2).otherwise(3)


def features(generator: int, c: Column) -> Column:
    value = c["value"]
    count = lambda pattern: F.length(F.regexp_replace(value, f"[^{pattern}]", ""))
    return F.struct(
        F.lit(generator).alias("generator"),
        _step(count("0-9"), (1, 7, 10, 11, 13, 16, 17)).alias("digits"),
        _step(count(r"\x20()-"), (1, 2, 3, 5)).alias("separators"),
        _step(count("."), (1, 2, 3, 4)).alias("dots"),
        (F.contains(value, F.lit("@")).cast("int") + 2 * F.contains(value, F.lit("+")).cast("int")).alias("signs"),
        c["before"].rlike(CONTEXT_WORDS).cast("int").alias("context"),
        _side(F.right(c["before"], F.lit(1))).alias("left"),
        _side(c["after"]).alias("right"),
    )


def _base_spans(kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(
        F.filter(kind, lambda c: valid(kind, c["value"])),
        lambda c: F.struct(c["start"].alias("start"), F.lit(rank).alias("rank"), c["end"].alias("end")),
    )


# What a candidate must be once its writing is normalised to be an example of personal data: an address whose name ends in
# letters, or a national number of area and two groups (with `+` it is of the base kind) or of three, two and four digits.
PLAIN_ADDRESS = r"^[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)++\p{L}{2,}+$"
PLAIN_NUMBER = r"^(?:(?=.*[^0-9])\(?[0-9]{2,5}\)?[ .-]{0,2}[0-9]{3,4}[ .-]?[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"


def _example(kind: str, value: Column) -> Column:
    """Whether a candidate is an example of personal data, whatever the base patterns find in it."""
    if kind == "number_like":
        national = value.rlike(PLAIN_NUMBER) & F.length(digits_of(value)).between(9, 11)
        return national | (F.startswith(value, F.lit("+")) & valid("phone", value))
    plain = F.regexp_replace(F.regexp_replace(value, r"(?i) ?[\[(]at[\])] ?", "@"), r"(?i) ?[\[(]dot[\])] ?", ".")
    return F.regexp_replace(plain, r"[.!?]+$", "").rlike(PLAIN_ADDRESS)


def _candidates(kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(
        kind,
        lambda c: F.struct(
            c["start"].alias("start"), F.lit(rank).alias("rank"), c["end"].alias("end"),
            features(rank - len(BASE_KINDS), c).alias("f"), _example(kind, c["value"]).alias("holds"),
        ),
    )


def running(values: Column, widest, start: int) -> Column:
    """The greatest (or least) value up to each place; block by block, so that long arrays cost no square."""
    ints = lambda: F.array().cast("array<int>")
    blocks = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(values) / BLOCK).cast("int") - 1), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))
    )
    scanned = F.transform(blocks, lambda block: F.aggregate(
        block, ints(), lambda acc, v: F.concat(acc, F.array(widest(v, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(start)))))
    ))
    last = lambda block: F.element_at(block, -1)
    above = F.aggregate(
        scanned, F.struct(F.lit(start).alias("at"), ints().alias("all")),
        lambda acc, block: F.struct(widest(acc["at"], last(block)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
        lambda acc: acc["all"],
    )
    merged = F.flatten(F.zip_with(scanned, above, lambda block, before: F.transform(block, lambda v: widest(v, before))))
    return F.when(F.size(values) > 0, merged).otherwise(ints())


_EVENT = "array<struct<start: int, candidate: boolean, end: int, rank: int, f: struct<{}>, holds: boolean>>"


def find_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (rank, start, end of validated spans) and candidates (rank, start, end, f, holds, covered) of every row.

    `holds` says whether the candidate, its writing normalised, is an example of personal data; `covered`, whether a base span
    touches it. Spans and candidates are put in order once and swept from both ends. A null text is empty and has none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    patterns = {**BASE_PATTERNS, **CANDIDATE_PATTERNS}
    rows = rows.select("doc_id", *[matches(F.col("text"), patterns[name], GATES[name]).alias(name) for name in KINDS])
    rows = rows.select("doc_id", *[placed(F.col(name)).alias(name) for name in KINDS])
    base = F.array_sort(F.concat(*map(_base_spans, BASE_KINDS)))
    rows = rows.select("doc_id", base.alias("base"), F.concat(*map(_candidates, CANDIDATE_PATTERNS)).alias("candidates"))
    event = _EVENT.format(", ".join(f"{name}: int" for name in FEATURES))
    spans = F.transform("base", lambda b: F.struct(
        b["start"], F.lit(False), b["end"], b["rank"], F.lit(None).cast(f"struct<{', '.join(f'{n}: int' for n in FEATURES)}>"), F.lit(None).cast("boolean"),
    )).cast(event)
    tried = F.transform("candidates", lambda c: F.struct(c["start"], F.lit(True), c["end"], c["rank"], c["f"], c["holds"])).cast(event)
    rows = rows.select("doc_id", "base", F.array_sort(F.concat(spans, tried)).alias("events"))
    least = (1 << 31) - 1
    ends = F.transform("events", lambda e: F.when(e["candidate"], 0).otherwise(e["end"]))
    starts = F.transform(F.reverse("events"), lambda e: F.when(e["candidate"], least).otherwise(e["start"]))
    rows = rows.select("doc_id", "base", "events", ends.alias("ends"), starts.alias("starts"))
    rows = rows.select(
        "doc_id", "base", "events", running(F.col("ends"), F.greatest, 0).alias("reach"),
        F.reverse(running(F.col("starts"), F.least, least)).alias("next"),
    )
    around = F.zip_with("reach", "next", lambda reach, following: F.struct(reach.alias("reach"), following.alias("next")))
    swept = F.zip_with("events", around, lambda e, a: F.struct(
        e["start"].alias("start"), e["rank"].alias("rank"), e["end"].alias("end"), e["f"].alias("f"), e["holds"].alias("holds"),
        ((a["reach"] > e["start"]) | (a["next"] < e["end"])).alias("covered"), e["candidate"].alias("candidate"),
    ))
    return rows.select("doc_id", "base", F.filter(swept, lambda c: c["candidate"]).alias("candidates"))


ROUNDS, DEPTH, RATE = 24, 2, 0.3
# Added spans must come from scores at which this share of the generator's candidates are examples.
PRECISION = 0.95


def _grow(cells, depth: int):
    """A regression tree for (features, gradient, hessian): a leaf's value, or (feature, bound, low, high)."""
    gradient, hessian = sum(c[1] for c in cells), sum(c[2] for c in cells)
    gain_of = lambda g, h: g * g / (h + 1.0)
    best = None
    if depth:
        for feature, name in enumerate(FEATURES):
            for bound in range(FEATURES[name] - 1):
                low = [c for c in cells if c[0][feature] <= bound]
                if not low or len(low) == len(cells):
                    continue
                g, h = sum(c[1] for c in low), sum(c[2] for c in low)
                gain = gain_of(g, h) + gain_of(gradient - g, hessian - h) - gain_of(gradient, hessian)
                if gain > 1e-6 and (best is None or gain > best[0]):
                    best = (gain, feature, bound)
    if best is None:
        return RATE * gradient / (hessian + 1.0)
    _, feature, bound = best
    return (
        feature, bound,
        _grow([c for c in cells if c[0][feature] <= bound], depth - 1),
        _grow([c for c in cells if c[0][feature] > bound], depth - 1),
    )


def _value(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def fit(cells: list[tuple[tuple[int, ...], int, int]]):
    """(offset, trees, threshold) from cells (features, candidates that are examples, others); the threshold is that of all cells."""
    held, others = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not held:
        return 0.0, [], math.inf
    offset = math.log((held + 1.0) / (others + 1.0))
    scores, trees = [offset] * len(cells), []
    for _ in range(ROUNDS):
        rows = []
        for (x, yes, no), score in zip(cells, scores):
            p = 1 / (1 + math.exp(-score))
            rows.append((x, yes - (yes + no) * p, (yes + no) * p * (1 - p)))
        tree = _grow(rows, DEPTH)
        trees.append(tree)
        scores = [s + _value(tree, c[0]) for s, c in zip(scores, cells)]
    return offset, trees, threshold_of(cells, scores)


def threshold_of(cells, scores: list[float]) -> float:
    """The lowest score from which on, upwards, PRECISION of the candidates are examples; infinite if there is none."""
    threshold, yes, total = math.inf, 0, 0
    order = sorted(range(len(cells)), key=lambda i: -scores[i])
    for place, i in enumerate(order):
        yes += cells[i][1]
        total += cells[i][1] + cells[i][2]
        last = place + 1 == len(order) or scores[order[place + 1]] < scores[i]
        if last and yes and yes >= PRECISION * total:
            threshold = scores[i]
    return threshold


def thresholds(cells, offset: float, trees: list) -> list[float]:
    """A threshold for each generator, calibrated on its own candidates."""
    out = []
    for generator in range(FEATURES["generator"]):
        own = [c for c in cells if c[0][0] == generator]
        out.append(threshold_of(own, [offset + sum(_value(t, c[0]) for t in trees) for c in own]))
    return out


def tree_column(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, bound, low, high = tree
    return F.when(f[list(FEATURES)[feature]] <= bound, tree_column(low, f)).otherwise(tree_column(high, f))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (start, rank in KINDS, end; sorted) of every row; `spans` holds the base and added ones.

    Added spans are candidates from their generator's threshold on that no base span touches. Null and empty texts have no spans; a
    null doc_id stays null; repeated rows are searched each; columns other than doc_id and text are not looked at.
    Whole texts are searched; the time grows faster than linearly with the number of spans in one text. The candidates are a written table, read twice.
    """
    found = cut_lineage(find_candidates(docs), "candidates")
    counted = (
        found.select(F.explode("candidates").alias("c")).groupBy(*[F.col(f"c.f.{name}").alias(name) for name in FEATURES])
        .agg(F.count_if("c.holds").alias("yes"), F.count_if(~F.col("c.holds")).alias("no"))
    )
    cells = sorted((tuple(row[name] for name in FEATURES), row["yes"], row["no"]) for row in counted.collect())
    offset, trees, _ = fit(cells)
    added = F.array().cast("array<struct<start: int, rank: int, end: int>>")
    least = thresholds(cells, offset, trees)
    if any(map(math.isfinite, least)):
        score = lambda c: reduce(lambda a, t: a + tree_column(t, c["f"]), trees, F.lit(offset))
        asked = F.array(*[F.lit(t - 1e-9) for t in least])
        kept = F.filter("candidates", lambda c: ~c["covered"] & (score(c) >= F.get(asked, c["f"]["generator"])))
        added = F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def digest(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _count(rank: int) -> Column:
    return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id",
        *[_count(rank).alias(f"n_{name}") for rank, name in enumerate(BASE_KINDS)],
        F.sha2(digest("base"), 256).alias("base_sha256"), digest("spans").alias("spans"),
    )
