"""Issue triage: one projection over the issue table, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfacts import constants as C
from fleetfacts.functions import text as X


def drop_pull_requests(issues: DataFrame) -> DataFrame:
    return issues.where(F.col("pull_request").isNull())


def _label_names(labels: Column) -> Column:
    names = F.transform(labels, lambda l: F.coalesce(l["name"], F.lit("")))
    return F.coalesce(names, F.array().cast("array<string>"))


def issue_type(labels: Column, title: Column) -> Column:
    """First label with a meaning, else the first word group found in the title.

    `labels` are lower-case names, `title` is lower-case.
    """
    meaning = {label: kind for kind, names in C.TYPE_LABELS for label in names}
    by_label = F.get(
        F.array_compact(F.transform(labels, lambda l: X.lookup(meaning, l))), F.lit(0)
    )
    by_title = F.lit("unknown")
    for kind, words in reversed(C.TYPE_TITLE_WORDS):
        by_title = F.when(X.contains_any(title, words), kind).otherwise(by_title)
    return F.coalesce(by_label, by_title)


def issue_scope(labels: Column, length: Column) -> Column:
    """Size of an issue by its lower-case labels, else by the length of its body."""
    return (
        F.when(F.arrays_overlap(labels, X.string_array(C.SMALL_SCOPE_LABELS)), "small")
        .when(F.arrays_overlap(labels, X.string_array(C.LARGE_SCOPE_LABELS)), "large")
        .when(length == 0, "unknown")
        .when(length < 800, "small")
        .when(length > 2500, "large")
        .otherwise("medium")
    )


def issue_reasons(
    labels: Column, title: Column, low_body: Column, length: Column, comments: Column
) -> Column:
    """Signs that an issue is approachable, in fixed order, on lower-case texts."""
    approachable = F.filter(labels, lambda l: l.isin(C.APPROACHABLE_LABELS))
    rules = F.array(
        F.when(
            F.size(approachable) > 0,
            F.concat(F.lit("Labelled as approachable: "), F.array_join(approachable, ", ")),
        ),
        F.when(length > 0, "Issue includes a description."),
        F.when(
            X.contains_any(low_body, C.REPRODUCTION_WORDS),
            "Reproduction steps or expected vs actual behavior described.",
        ),
        F.when(
            X.contains_any(title, C.FOCUSED_TITLE_WORDS),
            "Title suggests a focused, well-scoped change.",
        ),
        F.when(length.between(200, 1500), "Description length suggests a focused scope."),
        F.when(
            comments > 0,
            F.concat(
                F.lit("Has "),
                comments.cast("string"),
                F.lit(" comment(s) — community is engaged."),
            ),
        ),
    )
    return F.array_compact(rules)


def complex_topics(low_body: Column) -> Column:
    """Words of complex topics in a lower-case body, in reporting order."""
    return F.array_compact(
        F.array(*[F.when(X.contains_word(low_body, w), F.lit(w)) for w in C.COMPLEX_BODY_WORDS])
    )


def _many_file_references(body: Column) -> Column:
    """More than 15 `name.ext` references. Each needs a dot, so bodies with few dots skip the
    pattern."""
    dots = F.octet_length(body) - F.octet_length(F.replace(body, F.lit("."), F.lit("")))
    return (dots > 15) & (F.regexp_count(body, F.lit(r"(?U)\b\w+\.\w{1,5}\b")) > 15)


def issue_concerns(
    labels: Column, body: Column, topics: Column, length: Column, comments: Column
) -> Column:
    """Signs that an issue is risky, in fixed order. `labels` are lower-case."""
    complex_labels = F.filter(labels, lambda l: l.isin(C.COMPLEX_LABELS))
    rules = F.array(
        F.when(F.ltrim(body, F.lit(X.WHITESPACE)) == "", "No description provided — scope is unclear."),
        F.when(
            F.size(complex_labels) > 0,
            F.concat(
                F.lit("Labels suggest complexity: "),
                F.array_join(complex_labels, ", "),
                F.lit("."),
            ),
        ),
        F.when(
            F.size(topics) > 0,
            F.concat(
                F.lit("Description mentions complex topics: "),
                F.array_join(F.slice(topics, 1, 3), ", "),
                F.lit("."),
            ),
        ),
        F.when(length > 3000, "Very long description — may indicate high complexity."),
        F.when(
            (comments == 0) & (length == 0),
            "No description and no comments — issue may be abandoned.",
        ),
        F.when(
            _many_file_references(body),
            "References many files/paths — may touch multiple modules.",
        ),
    )
    return F.array_compact(rules)


def analyze_issues(issues: DataFrame) -> DataFrame:
    """Type, scope, reasons and concerns per issue; missing fields count as empty."""
    empty = F.lit("")
    prepared = issues.select(
        "repo_id",
        F.coalesce("number", F.lit(0)).cast("bigint").alias("issue_number"),
        F.coalesce("title", empty).alias("title"),
        F.coalesce("body", empty).alias("body"),
        _label_names(F.col("labels")).alias("labels"),
        F.coalesce("comments", F.lit(0)).alias("comments"),
        F.coalesce("html_url", empty).alias("url"),
    )
    # Each stage is used several times by the next, so Spark keeps it as its own projection
    # and every text is lower-cased once.
    lowered = prepared.select(
        "*",
        F.transform("labels", F.lower).alias("low_labels"),
        F.lower("title").alias("low_title"),
        F.lower("body").alias("low_body"),
        F.length("body").alias("length"),
    ).withColumn("topics", complex_topics(F.col("low_body")))
    labels, title, body, low_body, topics, length, comments = (
        F.col(c)
        for c in ("low_labels", "low_title", "body", "low_body", "topics", "length", "comments")
    )
    return lowered.select(
        "repo_id",
        "issue_number",
        "title",
        issue_type(labels, title).alias("type"),
        issue_scope(labels, length).alias("scope"),
        issue_reasons(labels, title, low_body, length, comments).alias("reasons"),
        issue_concerns(labels, body, topics, length, comments).alias("concerns"),
        "labels",
        "url",
    )


def issue_board(analysis: DataFrame) -> DataFrame:
    """The card of an issue: two reasons, one concern."""
    return analysis.select(
        "repo_id",
        "issue_number",
        "title",
        "type",
        "scope",
        F.slice("reasons", 1, 2).alias("reasons"),
        F.slice("concerns", 1, 1).alias("concerns"),
        "labels",
    )
