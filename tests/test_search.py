import random

from conftest import rows

from fleetfacts import constants as C
from fleetfacts.operators import needles as N
from fleetfacts.operators import search as S


def test_code_search(make_files):
    files = make_files(
        ("r", "b.py", "First\nneedle ONE\n\nNeedle two\n"),
        ("r", "a.py", "no match\n"),
        ("r", "dist/c.py", "needle\n"),
        ("r", "x/dist", "needle in a file named like a directory"),
        ("s", "b.py", "needle\n"),
    )
    found = S.code_search(files, [(1, None, "Needle"), (2, "s", "need"), (3, "s", "absent")])
    assert rows(found) == [
        ("r", 1, "b.py", 2, "needle ONE", False),
        ("r", 1, "b.py", 4, "Needle two", False),
        ("r", 1, "x/dist", 1, "needle in a file named like a directory", False),
        ("s", 1, "b.py", 1, "needle", False),
        ("s", 2, "b.py", 1, "needle", False),
    ]


def test_code_search_truncates(make_files):
    files = make_files(("r", "long.txt", "hit\n" * 60), ("r", "more.txt", "hit\n"))
    found = S.code_search(files, [(1, None, "hit")], max_matches=50).collect()
    assert len(found) == 50 and all(r.truncated for r in found)
    assert {r.path for r in found} == {"long.txt"} and max(r.line for r in found) == 50
    limited = S.code_search(files, [(1, None, "hit")], max_matches=None)
    assert limited.count() == 61


def _all_lines(files, queries):
    """Every line tried for every needle."""
    return sorted(
        (repo, query_id, path, i + 1, line)
        for repo, path, text in files
        for i, line in enumerate(text.removesuffix("\n").split("\n"))
        for query_id, asked, needle in queries
        if needle is not None and asked in (None, repo) and needle.lower() in line.lower()
    )


def test_search_queries_equal_every_line_tried(spark, make_files, monkeypatch):
    draw = random.Random(5)
    alphabet = "abAB é\u0416.\n"
    texts = [("r" + str(i % 3), f"{i}.py", "".join(draw.choice(alphabet) for _ in range(draw.choice([0, 1, 5, 60, 400])))) for i in range(60)]
    texts += [("r0", "long.py", "x" * 5_000 + "abcabcabcd" + "y" * 5_000 + "\n"), ("r1", "ends.py", "ab\n\n")]
    needles = ["", "a", "é", "ж", "ab", "AB ", "abab", "aB b. a", "abcabcabcd", "xxxxxxxxxa", "zzzz", "a\nb", None]
    needles += ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 12))) for _ in range(150)]
    asked = [(i, draw.choice([None, "r0", "r1", "r9"]), n) for i, n in enumerate(needles)] + [(900, None, "ab"), (900, "r0", "ab")]
    asked.append((901, None, ""))
    queries = spark.createDataFrame(asked, "query_id int, repo_id string, needle string")
    expected = _all_lines(texts, asked)
    assert len(expected) > 1_000
    for block in (7, 1 << 20):
        monkeypatch.setattr(N, "_BLOCK", block)
        found = N.search_queries(make_files(*texts), queries)
        assert sorted(tuple(r)[:5] for r in found.collect()) == expected


def test_search_queries_hold_as_many_needles_as_there_are(spark, make_files):
    files = make_files(*[("r", f"{i}.py", f"begin\nkey_{i:06d} and_{i:06d}\nend") for i in range(300)], ("r", "dist/a.py", "key_000001"))
    queries = spark.range(100_000).selectExpr("CAST(id AS INT) AS query_id", "CAST(null AS STRING) AS repo_id", "format_string('KEY_%06d', id) AS needle")
    found = N.search_queries(files, queries)
    assert len(found._jdf.queryExecution().logical().toString()) < 20_000
    assert rows(found, "query_id", "path", "line") == sorted([(i, f"{i}.py", 2) for i in range(300)], key=lambda t: tuple(map(str, t)))
    first = N.search_queries(files, queries.limit(5).selectExpr("query_id", "repo_id", "'d' AS needle"), max_matches=3)
    assert first.count() == 15 and all(r.truncated for r in first.collect())
    for empty in (N.search_queries(files, queries.where("false")), N.search_queries(files.where("false"), queries)):
        assert empty.count() == 0


def keywords_of(text, limit=20):
    """The rule, restated: words by frequency, then first position."""
    words, word = [], ""
    for ch in text.lower() + " ":
        if ch.isascii() and (ch.isalnum() or ch == "_"):
            word += ch
        else:
            words.append(word)
            word = ""
    # A word starts at its first letter.
    cut = [w.lstrip("0123456789_") for w in words]
    kept = [w for w in cut if len(w) >= 3 and w not in C.STOP_WORDS]
    order = sorted(set(kept), key=lambda w: (-kept.count(w), kept.index(w)))
    return order[:limit]


def test_keywords(spark):
    texts = ["The parser crashes. Parser error in parse_config, error error!", "", "the and it", "9abc _x1y2 zz9"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = S.extract_keywords(df, ["id"], df.text).collect()
    assert {(r.keyword, r.frequency) for r in found if r.id == 0} >= {("parser", 2), ("error", 3), ("crashes", 1)}
    for i, text in enumerate(texts):
        got = [r.keyword for r in sorted(found, key=lambda r: r.rank) if r.id == i]
        assert got == keywords_of(text)


def test_keywords_need_no_shuffle(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 60))) for _ in range(20)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for limit in (1, 3, 200):
        found = S.extract_keywords(df, ["id"], df.text, limit)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        for i, text in enumerate(texts):
            got = [r.keyword for r in found.where(f"id = {i}").orderBy("rank").collect()] if i % 7 == 0 else None
            assert got is None or got == keywords_of(text or "", limit)


def test_code_search_tries_every_needle_per_line(make_files):
    files = make_files(("r", "a", "alpha beta\nbeta\n\ngamma"), ("r", "b", ""))
    found = S.code_search(files, [(1, None, "beta"), (2, "r", "ALPHA"), (3, "s", "beta"), (4, None, "a")])
    assert rows(found, "query_id", "path", "line") == [
        (1, "a", 1), (1, "a", 2), (2, "a", 1), (4, "a", 1), (4, "a", 2), (4, "a", 4),
    ]


def brute_force(issues, files, limit=10):
    out = []
    for repo, number, title, body in issues:
        words = keywords_of(f"{title or ''} {body or ''}")
        scored = []
        for r, path, content in files:
            if r != repo:
                continue
            in_path = [w for w in words if w in path.lower()]
            in_text = [w for w in words if w in content.lower()]
            score = 2 * len(in_path) + len(in_text)
            if score:
                hit = [w for w in words if w in in_path or w in in_text][:4]
                named = ", ".join(f'"{w}"' for w in hit)
                place = "path and content" if in_path else "content"
                scored.append((-score, path, f"Matched keyword(s) {named} in {place}."))
        for position, (score, path, reason) in enumerate(sorted(scored)[:limit], 1):
            out.append((repo, number, position, path, -score, reason))
    return sorted(out, key=lambda t: tuple(map(str, t)))


def test_ranking_equals_brute_force(spark, make_files):
    """One repository holds most files, and a third of all files are copies of one."""
    rng = random.Random(7)
    stems = ["auth", "token", "parse", "config", "render", "user_id", "cache2", "in", "reauthorize", "tokens"]

    def text(n):
        parts = [rng.choice(stems) + rng.choice(["", "er", "_x", "9", "É"]) for _ in range(n)]
        return " ".join(p.upper() if rng.random() < 0.2 else p for p in parts)

    files = [("mono", f"src/{rng.choice(stems)}/f{i}.py", text(6)) for i in range(120)]
    files += [("mono", f"copy/c{i:03}.py", "token parse config") for i in range(80)]
    files += [("small", f"f{i}.py", text(4)) for i in range(12)]
    issues = [(rng.choice(["mono", "small", "none"]), n, text(2), text(5)) for n in range(25)]
    issues.append(("mono", 99, None, None))
    raw = spark.createDataFrame(issues, "repo_id string, number bigint, title string, body string")
    keywords = S.issue_keywords(raw)
    expected = brute_force(issues, files)
    # Everything light; a mixture; nearly everything heavy.
    for heavy_term in (10**6, 30, 8, 1, 0):
        top = S.top_files_per_issue(keywords, make_files(*files), heavy_term=heavy_term)
        got = rows(top, "repo_id", "number", "position", "path", "score", "reason")
        assert got == expected, heavy_term


def test_ranking_does_not_depend_on_partitions(spark, make_files):
    files = make_files(*[("r", f"f{i}.py", f"token parse w{i % 3}") for i in range(40)])
    raw = spark.createDataFrame(
        [("r", 1, "token", "w1 w2 parse www")], "repo_id string, number bigint, title string, body string"
    )
    keywords = S.issue_keywords(raw)
    results = {tuple(rows(S.top_files_per_issue(keywords, files.repartition(n)))) for n in (1, 7)}
    assert len(results) == 1
    positions = [r[2] for r in next(iter(results))]
    assert sorted(positions) == list(range(1, 11))


def test_rare_letters_and_long_runs(spark, make_files):
    files = make_files(
        ("r", "a.txt", "x" * 5000 + "needle" + "y" * 5000), ("r", "b.txt", "préneedleé"), ("r", "c.txt", "need le")
    )
    raw = spark.createDataFrame([("r", 1, "needle", None)], "repo_id string, number bigint, title string, body string")
    top = S.top_files_per_issue(S.issue_keywords(raw), files)
    assert rows(top, "path") == [("a.txt",), ("b.txt",)]


def test_one_content_scan_and_no_rows_for_repositories_without_issues(spark, make_files, tmp_path):
    make_files(
        ("asked", "src/token.py", "reauthorize the user"), ("asked", "b.py", ""), ("silent", "token.py", "token user authorize" * 50)
    ).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    raw = spark.createDataFrame([("asked", 1, "authorize token", "users")], "repo_id string, number bigint, title string, body string")
    keywords = S.issue_keywords(raw)
    candidates = S.keyword_candidates(files, S.GramFilter(keywords))
    assert {r.repo_id for r in candidates.collect()} == {"asked"}
    hits = S.file_hits(files, keywords)
    assert [(r.path, [tuple(h) for h in r.hits]) for r in hits.collect()] == [
        ("src/token.py", [("authorize", False), ("token", True)])
    ]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("content#") and plan.count("/files") + plan.count("Relation [repo_id") == 1


def test_gram_filter_keeps_nothing_back_at_any_size(spark, make_files, monkeypatch):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcxyz_09") for _ in range(rng.randint(3, 9))) for _ in range(400)})
    words = [w for w in words if w[0].isalpha()]
    rows_ = [(f"r{i % 7}", i, i, w, 1) for i, w in enumerate(words)]
    keywords = spark.createDataFrame(rows_, "repo_id string, number bigint, rank int, keyword string, frequency bigint")
    files = make_files(*[(f"r{r}", "f", " ".join(f"z{w}0" for w in words)) for r in range(7)])
    expected = {(f"r{i % 7}", w) for i, w in enumerate(words)}
    for most in (23, 10, 6):
        monkeypatch.setattr(S, "_MOST_BITS", most)
        monkeypatch.setattr(S, "_LEAST_BITS", min(most, 10))
        found = S.file_hits(files, keywords).select("repo_id", "hits.keyword").collect()
        assert expected <= {(r.repo_id, k) for r in found for k in r.keyword}
