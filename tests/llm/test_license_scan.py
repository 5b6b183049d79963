"""License scan against a plain reading of its rules, on planted passages, nulls, repeats, long texts and clashing columns."""

import random
import re

from fleetfacts.llm import license_scan as scan

DOCS = "doc_id long, text string, base string, words string, found string, score string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(texts):
    """(n_words, base places, {(label, score)}) of each text."""
    lists = [words_of(t) for t in texts]
    number = {}
    for ws in lists:
        for w in set(ws):
            number[w] = number.get(w, 0) + 1
    out = []
    for ws in lists:
        base = [(i, label) for phrase, label in scan.BASE_PHRASES for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
        found = set()
        for label, passage in scan.TEMPLATES:
            label, template, start, phrase = scan.parse_template(label, passage)
            rare = sorted(set(template), key=lambda w: (number.get(w, 0), w))
            rare = rare[: min(scan.MOST_INDEXED, (len(rare) + 1) // 2)]
            looked_up = [w for w in rare if w in ws][: scan.PROBES]
            votes = {}
            for w in looked_up:
                for b in {i - q for i, x in enumerate(ws) if x == w for q, y in enumerate(template) if y == w}:
                    votes[b] = votes.get(b, 0) + 1
            scores = [
                sum(0 <= b + j < len(ws) and ws[b + j] == w for j, w in enumerate(template)) / len(template)
                for b, n in votes.items() if n >= scan.AGREEING and b + start >= 0 and ws[b + start : b + start + len(phrase)] == phrase
            ]
            if scores:
                found.add((label, max(scores)))
        out.append((len(ws), sorted(base), found))
    return out


def made(seed=1):
    rng = random.Random(seed)
    noise = lambda n: " ".join(rng.choice("the of software and to a lorem ipsum é漢 license copy 2 0".split()) for _ in range(n))
    passages = [re.sub(r"[\[\]]", "", p) for _, p in scan.TEMPLATES]
    texts = [None, "", "!?", "MIT", "license", "mit license", "MIT-License, Apache\nLicense; general PUBLIC license", "mit licenses", "mit " * 50 + "license"]
    for p in passages:
        texts += [p, noise(30) + ". " + p.title() + " " + noise(30), noise(9) + " " + re.sub(r" (\w+)$", r" oops \1", p)]
        ws = p.split()
        ws[rng.randrange(len(ws))] = "changed"
        texts.append(noise(5) + " " + " ".join(ws) + " " + noise(5))
    texts += [" ".join(passages) + " " + passages[0], passages[1] + " " + noise(60_000) + " " + passages[4], "warranties conditions " * 30_000]
    return texts + [noise(40) for _ in range(30)]


def test_equals_a_plain_reading(spark):
    texts = made()
    rows = [(i, t, "b", "w", "f", "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r["doc_id"]: r for r in scan.scan_licenses(docs).collect()}
    assert len(got) == len(texts)
    for i, (n_words, base, found) in enumerate(plain(texts)):
        r = got[i]
        best = {}
        for f in r["found"]:
            best.setdefault(f["label"], []).append(f["score"])
        assert (r["n_words"], [tuple(b) for b in r["base"]]) == (n_words, base), texts[i]
        assert {(f["label"], f["score"]) for f in r["found"]} == found, texts[i]
        assert r["score"] == max([s for _, s in found] + [scan.BASE_SCORE if base else 0.0])


def test_every_passage_gets_its_label_in_running_text(spark):
    texts = [f"Alpha beta gamma {i}. {re.sub(r'[][]', '', p).capitalize()}; delta epsilon." for i, (_, p) in enumerate(scan.TEMPLATES)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in scan.scan_licenses(docs).collect()}
    for i, (label, _) in enumerate(scan.TEMPLATES):
        assert (label, 1.0) in {(f["label"], f["score"]) for f in got[i]["found"]}


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, "Released under the MIT License."), (2, "mit license"), (2, "mit license")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], len(r["base"]), r["score"]) for r in scan.scan_licenses(docs).collect()), key=str)
    assert got == [(1, 0, 0, 0.0), (2, 2, 1, 0.5), (2, 2, 1, 0.5), (None, 5, 1, 1.0)]
    assert scan.scan_licenses(docs.limit(0)).count() == 0
