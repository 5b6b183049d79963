"""Line search over files and ranking of files per issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfacts import constants as C
from fleetfacts.functions import text as X
from fleetfacts.operators.inventory import exclude_vendored
from fleetfacts.plans.staging import cut_lineage


def _check_limit(name: str, limit: int | None) -> None:
    if limit is not None and limit < 1:
        raise ValueError(f"{name} must be at least 1")


def search_scope(files: DataFrame) -> DataFrame:
    """Searchable files."""
    return exclude_vendored(files, match_filename=False)


def first_matches(matches: DataFrame, max_matches: int | None) -> DataFrame:
    """All matches, or the first ones per repository and query by (path, line)."""
    _check_limit("max_matches", max_matches)
    if max_matches is None:
        return matches.withColumn("truncated", F.lit(False))
    group = Window.partitionBy("repo_id", "query_id")
    kept = matches.withColumn(
        "_n", F.row_number().over(group.orderBy("path", "line"))
    ).where(F.col("_n") <= max_matches)
    truncated = F.count("*").over(group) >= max_matches
    return kept.withColumn("truncated", truncated).select(
        "repo_id", "query_id", "path", "line", "text", "truncated"
    )


def code_search(
    files: DataFrame,
    queries: list[tuple[int, str | None, str]],
    max_matches: int | None = None,
) -> DataFrame:
    """Lines containing each needle, ignoring case.

    `queries` is (query_id, repo_id or None for all, needle): a list of literals, so it is
    part of the plan instead of a joined table (`needles.search_queries` takes a table). A file is opened up into lines once, and only
    if some needle occurs in it; its lines are tried for those needles. Only matching lines
    leave the expression. All matches are returned unless `max_matches`
    asks for the first ones per repository and query by (path, line); up to
    spark.sql.optimizer.windowGroupLimitThreshold that limit is applied per task before the shuffle.
    """
    if not queries:
        raise ValueError("at least one query is expected")
    literals = F.array(
        *[
            F.struct(
                F.lit(query_id).cast("int").alias("query_id"),
                F.lit(repo).cast("string").alias("repo"),
                F.lower(F.lit(needle)).alias("needle"),
            )
            for query_id, repo, needle in queries
        ]
    )
    scope = search_scope(files)
    hits = X.let(
        F.lower("content"),
        lambda low: F.filter(
            literals,
            lambda q: (q["repo"].isNull() | (q["repo"] == F.col("repo_id")))
            & F.contains(low, q["needle"]),
        ),
    )

    def matching_lines(asked: Column) -> Column:
        def tried(text: Column, i: Column) -> Column:
            found = X.let(F.lower(text), lambda low: F.filter(asked, lambda q: F.contains(low, q["needle"])))
            return F.struct((i + 1).alias("line"), text.alias("text"), found.alias("found"))

        opened = F.transform(X.lines(F.col("content")), tried)
        return F.when(F.size(asked) > 0, F.filter(opened, lambda l: F.size(l["found"]) > 0))

    matches = (
        scope.select("repo_id", "path", F.inline(X.let(hits, matching_lines)))
        .select("repo_id", "path", "line", "text", F.explode("found").alias("q"))
        .select("repo_id", "q.query_id", "path", "line", "text")
    )
    return first_matches(matches, max_matches)


# --- keywords ------------------------------------------------------------------------


def _ranked_words(text: Column, limit: int) -> Column:
    """array<struct(negated frequency, first position, keyword)> of a text, best first.

    Words are sorted with their positions, so each keyword is one run of the sorted array and
    its frequency is the distance to the next run.
    """
    words = F.filter(
        X.extract_all(F.lower(text), "[a-z][a-z0-9_]{2,}", 0), lambda w: ~w.isin(C.STOP_WORDS)
    )
    placed = F.transform(words, lambda w, i: F.struct(w.alias("keyword"), i.alias("pos")))

    def counted(ordered: Column) -> Column:
        numbered = F.transform(ordered, lambda w, i: F.struct(w.alias("w"), i.alias("at")))
        firsts = F.filter(
            numbered,
            lambda n: (n["at"] == 0) | (F.get(ordered, n["at"] - 1)["keyword"] != n["w"]["keyword"]),
        )

        def measured(runs: Column) -> Column:
            def one(run: Column, i: Column) -> Column:
                end = F.coalesce(F.get(runs, i + 1)["at"], F.size(ordered))
                return F.struct(
                    (run["at"] - end).alias("negated"), run["w"]["pos"].alias("pos"),
                    run["w"]["keyword"].alias("keyword"),
                )

            return F.transform(runs, one)

        return F.slice(F.sort_array(X.let(firsts, measured)), 1, limit)

    return X.let(F.sort_array(placed), counted)


def extract_keywords(
    texts: DataFrame, keys: list[str], text: Column, max_keywords: int = 20
) -> DataFrame:
    """Top keywords per text: most frequent first, then first seen.

    A text is one row, so words are counted and ranked inside the row, without a shuffle.
    """
    _check_limit("max_keywords", max_keywords)
    ranked = texts.select(*keys, F.posexplode(_ranked_words(text, max_keywords)).alias("_pos", "_k"))
    return ranked.select(
        *keys,
        (F.col("_pos") + 1).alias("rank"),
        F.col("_k.keyword").alias("keyword"),
        (-F.col("_k.negated")).cast("bigint").alias("frequency"),
    )


def issue_keywords(issues: DataFrame, max_keywords: int = 20) -> DataFrame:
    empty = F.lit("")
    text = F.concat(
        F.coalesce("title", empty), F.lit(" "), F.coalesce("body", empty)
    )
    return extract_keywords(issues, ["repo_id", "number"], text, max_keywords)


# --- ranking -------------------------------------------------------------------------

# A keyword is a run of [a-z0-9_], so it occurs in a text exactly when it occurs inside one
# of the text's maximal runs. Ranking therefore works on the distinct runs of each file.
_RUN = "[a-z0-9_]{3,}"
_GRAM_MIN, _GRAM_MAX = 3, 5
# The gram filter has at least so many bits for each bit that is set, and never more than 2**_MOST_BITS (1 MB).
_BITS_PER_KEY, _LEAST_BITS, _MOST_BITS = 8, 10, 23


class GramFilter:
    """Bloom filter of what keywords begin with, per repository, as a constant of the plan.

    Holds the repositories with keywords, and of each keyword its first three characters and its
    first five (all of it, if shorter). It may let through what no keyword begins with, which
    costs rows in the join that follows, but keeps nothing back. Its size is bounded for any
    fleet; beyond some 10**5 keywords it lets more through. Runs one job, which brings at most
    131,072 numbers to the driver.
    """

    def __init__(self, keywords: DataFrame):
        repository = self._repository()
        keys = F.array(
            repository,
            self._start_key(F.substring("keyword", 1, _GRAM_MIN), repository),
            self._gram_key(F.substring("keyword", 1, _GRAM_MAX), repository),
        )
        places = F.flatten(F.transform(keys, lambda k: F.array(*self._places(k, _MOST_BITS))))
        words = keywords.select(F.explode(places).alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("bits")
        )
        rows = words.collect()
        n = sum(bin(r["bits"] & (1 << 64) - 1).count("1") for r in rows)
        self.bits = min(max((n * _BITS_PER_KEY).bit_length(), _LEAST_BITS), _MOST_BITS)
        # Places are low bits of a hash, so that the filter folds onto itself.
        folded = [0] * (1 << (self.bits - 6))
        for r in rows:
            folded[r["word"] % len(folded)] |= r["bits"]
        self.literal = F.from_json(F.lit(str(folded)), "array<bigint>")

    @staticmethod
    def _repository() -> Column:
        return F.xxhash64("repo_id")

    @staticmethod
    def _start_key(start: Column, repository: Column) -> Column:
        return F.xxhash64(start).bitwiseXOR(repository)

    @staticmethod
    def _gram_key(gram: Column, repository: Column) -> Column:
        return F.bitwise_not(F.xxhash64(gram).bitwiseXOR(repository))

    @staticmethod
    def _places(key: Column, bits: int) -> list[Column]:
        mask = (1 << bits) - 1
        return [key.bitwiseAND(mask), F.shiftright(key, 32).bitwiseAND(mask)]

    def _holds(self, key: Column) -> Column:
        def bit(place: Column) -> Column:
            return F.getbit(F.get(self.literal, F.shiftright(place, 6).cast("int")), place.bitwiseAND(63).cast("int")) == 1

        first, second = self._places(key, self.bits)
        return bit(first) & bit(second)

    def asked(self) -> Column:
        """Whether the row's repository has keywords."""
        return self._holds(self._repository())

    def grams(self, run: Column, repository: Column) -> Column:
        """The beginnings of keywords of the row's repository that occur in a run."""
        begins = F.filter(
            F.sequence(F.lit(1), F.length(run) - (_GRAM_MIN - 1)),
            lambda i: self._holds(self._start_key(F.substr(run, i, F.lit(_GRAM_MIN)), repository)),
        )
        spelled = F.flatten(F.transform(
            begins, lambda i: F.array(*[F.substr(run, i, F.lit(n)) for n in range(_GRAM_MIN, _GRAM_MAX + 1)])
        ))
        return F.filter(F.array_distinct(spelled), lambda g: self._holds(self._gram_key(g, repository)))


def keyword_candidates(files: DataFrame, grams: GramFilter) -> DataFrame:
    """(repo_id, path, in_path, run, gram): the runs of each file in which a keyword may begin.

    One pass over contents, inside the row. Files of repositories without keywords aren't cut up.
    """

    def candidates(text: Column, in_path: bool, repository: Column) -> Column:
        runs = F.array_distinct(X.extract_all(F.lower(text), _RUN, 0))
        return F.flatten(F.transform(runs, lambda r: F.transform(
            grams.grams(r, repository), lambda g: F.struct(F.lit(in_path).alias("in_path"), r.alias("run"), g.alias("gram"))
        )))

    path = F.replace("path", F.lit("\\"), F.lit("/"))
    content = F.coalesce("content", F.lit(""))
    found = X.let(GramFilter._repository(), lambda r: F.concat(candidates(path, True, r), candidates(content, False, r)))
    return files.select("repo_id", "path", F.inline(F.when(grams.asked(), found)))


def file_hits(files: DataFrame, keywords: DataFrame) -> DataFrame:
    """(repo_id, path, hits): the keywords of its repository that occur in each file, and where.

    Candidates are joined to keywords on their first characters, then tested for all of them. The
    hits of a file, (keyword, in_path) in order, are one array, as its text bounds them.
    `keywords` should be cheap to read.
    """
    vocabulary = keywords.select("repo_id", "keyword").distinct()
    keyed = vocabulary.withColumn("gram", F.substring("keyword", 1, _GRAM_MAX))
    return (
        keyword_candidates(files, GramFilter(keywords))
        .join(keyed, ["repo_id", "gram"])
        .where(F.contains("run", "keyword"))
        .groupBy("repo_id", "path")
        .agg(F.array_sort(F.collect_set(F.struct("keyword", "in_path"))).alias("hits"))
    )


def representative_files(hits: DataFrame, max_results: int) -> DataFrame:
    """Files without the surplus of those that match exactly the same keywords.

    Two files with equal hits score equally for every issue of their repository, so beyond the
    first `max_results` by path a group of copies can never be listed. The result is unchanged
    and a large group of copies no longer meets every issue.
    """
    w = Window.partitionBy("repo_id", "hits").orderBy("path")
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_results).drop("_n")


def score_files(keywords: DataFrame, files: DataFrame) -> DataFrame:
    """Score of every (issue, file) that shares a keyword: 2 per path hit, 1 per content hit.

    Pairs come from an inverted index on (repo_id, keyword) and are summed on the map side;
    matched keywords travel as arrays of keyword ranks. This is the whole score
    table; `top_files_per_issue` finds the best files without building it.
    """
    keywords = cut_lineage(keywords)
    hits = file_hits(exclude_vendored(files), keywords)
    pairs = keywords.drop("frequency").join(_terms(hits), ["repo_id", "keyword"])
    return _summed(pairs.select(*_contribution()))


# A keyword that more files than this contain (in one place, in one repository) is heavy.
HEAVY_TERM = 5_000

ISSUE = ["repo_id", "number"]
PAIR = ["repo_id", "number", "path"]
TERM = ["repo_id", "keyword", "in_path"]


def _terms(hits: DataFrame) -> DataFrame:
    """One row per file, keyword and place, with the points a hit there is worth."""
    return hits.select("repo_id", "path", F.inline("hits")).withColumn("points", F.when(F.col("in_path"), 2).otherwise(1))


def _summed(contributions: DataFrame) -> DataFrame:
    return contributions.groupBy(*PAIR).agg(
        F.sum("score").alias("score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched")))).alias("matched"),
        F.max("in_path").alias("in_path"),
    )


def _contribution() -> list[Column]:
    return [
        *map(F.col, PAIR),
        F.col("points").cast("bigint").alias("score"),
        F.array("rank").alias("matched"),
        F.col("in_path"),
    ]


def _top(scored: DataFrame, group: list[str], limit: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc("score"), "path")
    ranked = scored.withColumn("position", F.row_number().over(w))
    return ranked.where(F.col("position") <= limit)


def _last_place(top: DataFrame, limit: int) -> DataFrame:
    """Score to beat per issue: that of the last place, 0 while places are free."""
    full = F.count("*") == limit
    return top.groupBy(*ISSUE).agg(F.when(full, F.min("score")).otherwise(0).alias("to_beat"))


def best_files(
    keywords: DataFrame, hits: DataFrame, limit: int, heavy_term: int = HEAVY_TERM
) -> DataFrame:
    """The best `limit` files per issue, without pairing issues with heavy posting lists.

    1. Only light terms make candidate pairs, so an issue meets at most its number of terms
       times `heavy_term` files. Candidates that could not reach the last place even with
       every heavy hit are dropped; the others get their heavy hits by key.
    2. A file that is no candidate has heavy hits only, so it scores at most the issue's
       heavy points. Where the last place found in 1 is above that, 1 is the answer.
    3. For the remaining issues, the best files by heavy hits alone are found once per
       distinct set of heavy terms and offered to the issues with that set. Further ones
       cannot be listed: all of those before them score at least as much.

    Without any heavy term, the light ones are all terms and 2 and 3 have no rows.
    """
    terms = _terms(hits)
    heavy = cut_lineage(
        terms.groupBy(*TERM)
        .agg(F.count("*").alias("files"), F.max("points").alias("points"))
        .where(F.col("files") > heavy_term)
        .drop("files")
    )
    if heavy.isEmpty():
        pairs = keywords.drop("frequency").join(terms, ["repo_id", "keyword"])
        return _top(_summed(pairs.select(*_contribution())), ISSUE, limit)
    asked_heavy = keywords.drop("frequency").join(heavy, ["repo_id", "keyword"])
    place = F.when(F.col("in_path"), "/path").otherwise("/content")
    bounds = asked_heavy.groupBy(*ISSUE).agg(
        F.sum("points").alias("bound"),
        F.array_join(F.sort_array(F.collect_list(F.concat("keyword", place))), " ").alias("heavy_set"),
    )

    def heavy_hits(pairs: DataFrame) -> DataFrame:
        asked = asked_heavy.drop("points")
        found = pairs.select(*PAIR).join(asked, ISSUE).join(terms, ["repo_id", "path", "keyword", "in_path"])
        return found.select(*_contribution())

    light = _summed(
        keywords.drop("frequency")
        .join(terms.join(heavy, TERM, "left_anti"), ["repo_id", "keyword"])
        .select(*_contribution())
    )
    open_issues = bounds.join(_last_place(_top(light, ISSUE, limit), limit), ISSUE, "left")
    candidates = (
        light.join(open_issues, ISSUE)
        .where(F.col("score") + F.col("bound") >= F.coalesce("to_beat", F.lit(0)))
        .select(*PAIR, "score", "matched", "in_path")
    )
    settled = light.join(bounds, ISSUE, "left_anti")
    completed = _summed(candidates.unionByName(heavy_hits(candidates)))
    found = cut_lineage(_top(settled.unionByName(completed), ISSUE, limit))

    unsure = (
        bounds.join(_last_place(found, limit), ISSUE, "left")
        .where(F.col("bound") >= F.coalesce("to_beat", F.lit(0)))
        .select(*ISSUE, "heavy_set")
    )
    term = F.split("term", "/")
    wanted = (
        unsure.select("repo_id", "heavy_set")
        .distinct()
        .select("repo_id", "heavy_set", F.explode(F.split("heavy_set", " ")).alias("term"))
        .select(
            "repo_id", "heavy_set", F.get(term, F.lit(0)).alias("keyword"),
            (F.get(term, F.lit(1)) == "path").alias("in_path"),
        )
    )
    by_set = _top(
        wanted.join(terms, TERM).groupBy("repo_id", "heavy_set", "path").agg(F.sum("points").alias("score")),
        ["repo_id", "heavy_set"],
        limit,
    )
    offered = unsure.join(by_set.select("repo_id", "heavy_set", "path"), ["repo_id", "heavy_set"])
    heavy_only = _summed(heavy_hits(offered))
    # A candidate may be offered as well, with fewer hits; its full score is the larger one.
    best = F.max(F.struct("score", "matched", "in_path")).alias("b")
    merged = found.drop("position").unionByName(heavy_only).groupBy(*PAIR).agg(best).select(*PAIR, "b.*")
    return _top(merged, ISSUE, limit)


def top_files_per_issue(
    keywords: DataFrame, files: DataFrame, max_results: int = 10, heavy_term: int = HEAVY_TERM
) -> DataFrame:
    """Best files per issue by score, then path, with the reason.

    Runs jobs when called: keywords and hits are read by many steps, so their lineage is cut.
    Contents are read once, and only files of repositories with issues leave a row.
    """
    _check_limit("max_results", max_results)
    keywords = cut_lineage(keywords)
    hits = file_hits(exclude_vendored(files), keywords)
    kept = cut_lineage(representative_files(hits, max_results))
    best = best_files(keywords, kept, max_results, heavy_term)
    words = keywords.groupBy(*ISSUE).agg(
        F.sort_array(F.collect_list(F.struct("rank", "keyword"))).alias("words")
    )
    return best.join(words, ISSUE).select(
        "repo_id",
        "number",
        "position",
        "path",
        "score",
        relevance_reason(F.col("words"), F.col("matched"), F.col("in_path")).alias("reason"),
        F.lit(True).alias("inferred"),
    )


def relevance_reason(words: Column, matched: Column, in_path: Column) -> Column:
    """The first four matched keywords by rank, and where they were found."""
    hit = F.filter(
        words,
        lambda w: F.array_contains(matched, w["rank"]),
    )
    named = F.transform(
        F.slice(hit, 1, 4), lambda w: F.concat(F.lit('"'), w["keyword"], F.lit('"'))
    )
    return F.concat(
        F.lit("Matched keyword(s) "),
        F.array_join(named, ", "),
        F.lit(" in "),
        F.when(in_path, "path and content").otherwise("content"),
        F.lit("."),
    )
