"""Toxicity vectors hold every word; numbers of documents are counted over all documents."""

import random

from fleetfacts.llm import toxicity

SYLLABLES = "ba de fi go hu ka le mi no pu ra se ti vo zu".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 3))) for _ in range(n))


def made(seed, n, share):
    """Texts; those with the label hold one of five words, five texts of a hundred are unlike all others and have none."""
    rng, out = random.Random(seed), []
    for i in range(n):
        label = int(rng.random() < share)
        words = sentence(rng, 40).split()
        if label and i % 20:
            words[rng.randrange(40)] = rng.choice(["scum", "moron", "trash", "vermin", "idiot"])
        out.append((i, " ".join(words), label))
    return out


def test_text_without_a_telling_word_meets_its_copy():
    rng = random.Random(1)
    examples = made(2, 300, 0.2) + [(1000, sentence(rng, 40), 1)]
    index = toxicity.Index(examples)
    score, near = index.score(index.count(examples[-1][1]))
    assert near[0] == 1000 and score != index.empty_share
    assert abs(index.nearest(index.count(examples[-1][1]))[0][0] - 1) < 1e-9


def test_long_clean_text_with_one_telling_word_is_not_a_vector_of_one_term():
    rng = random.Random(3)
    examples = made(2, 300, 0.2) + [(1000, "scum", 1)]
    index = toxicity.Index(examples)
    cosine = dict((index.ids[p], c) for c, p in index.nearest(index.count(sentence(rng, 400) + " scum"), k=len(examples)))[1000]
    assert 0 < cosine < 0.7


def test_recall_where_the_bound_of_the_sample_is_reached_and_at_any_share(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_EXAMPLES", 600)
    for share in (0.1, 0.6):
        rows = made(5, 1_800, share)
        docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
        labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
        assert len(toxicity.labelled_examples(docs, labels)) == 600
        label = {r[0]: r[2] for r in rows}
        held = docs.where(toxicity.fold() == toxicity.HELD_OUT_FOLD)
        got = toxicity.score_toxicity(held, docs, labels).collect()
        found = sum(r["score"] >= toxicity.THRESHOLD for r in got if label[r["doc_id"]])
        false = sum(r["score"] >= toxicity.THRESHOLD for r in got if not label[r["doc_id"]])
        toxic = sum(label[r["doc_id"]] for r in got)
        print("recall", share, found, toxic, false, len(got) - toxic)
        assert found >= 0.8 * toxic and false <= 0.03 * (len(got) - toxic)


def test_numbers_of_documents_are_of_all_documents(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["One two", "two TWO three", None, "", "two threefold"])], "doc_id long, text string")
    terms = ["two", "three", "three*", "none"]
    assert toxicity.document_frequencies(docs, terms) == ({"two": 3, "three": 1, "three*": 1}, 5)


def test_nearest_are_exact_and_most_blocks_are_not_scored():
    rng = random.Random(11)
    tongues = [[sentence(rng, 1) + end for _ in range(300)] for end in ("", "en", "os", "ly")]
    text = lambda t, n: " ".join(rng.choice(tongues[t]) for _ in range(n))
    examples = [(i, text(i % 4, rng.choice([3, 40, 200])), int(rng.random() < 0.2)) for i in range(1_000)] + [(2_000, "", 0), (2_001, "", 1)]
    index = toxicity.Index(examples, lambda terms: ({t: 7 for t in terms}, 5_000))
    vectors = []
    for _, body, _ in examples:
        rows, weight = index.encode(index.count(body))
        vectors.append(dict(zip(rows.tolist(), weight.tolist())))
    place = {i: p for p, i in enumerate(index.ids)}
    queries = [text(i % 4, 60) + " unseenword" for i in range(200)] + ["", "unseenword"]
    near = index.nearest_of([index.encode(index.count(q)) for q in queries])
    for query, found in zip(queries, near):
        rows, weight = index.encode(index.count(query))
        cosines = [(sum(w * v.get(r, 0.0) for r, w in zip(rows.tolist(), weight.tolist())), place[examples[i][0]]) for i, v in enumerate(vectors)]
        best = sorted((c for c in cosines if c[0] > 0), key=lambda c: (-c[0], c[1]))[: toxicity.NEIGHBOURS]
        assert len(found) == len(best) and all(abs(a[0] - b[0]) < 1e-9 for a, b in zip(found, best))
    assert near[-1] == near[-2] == []
    # Blocks of the other tongues are never scored.
    assert index.scored < 0.5 * index.n_blocks * len(queries)


def test_texts_without_words_get_the_overall_share_calibrated():
    examples = made(2, 300, 0.2) + [(1000 + i, None or "", 1) for i in range(20)]
    index = toxicity.Index(examples)
    assert {s for s, _ in index.scores(["", " 12 !", "xqzwv"])} == {index.empty_share}
    assert index.empty_share < toxicity.THRESHOLD
