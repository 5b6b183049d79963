"""Spans that the trees add, and the sweep that keeps them apart from base spans."""

import random

from fleetfacts.llm import pii


def spans_of(found, texts):
    return {
        r["doc_id"]: [(pii.KINDS[s["rank"]], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"]]
        for r in found.collect()
    }


def test_planted_spans_that_no_base_pattern_finds_are_added(spark):
    draw = random.Random(3)
    texts = []
    for i in range(300):
        name = "".join(draw.choice("abcdefgh") for _ in range(6))
        number = f"({draw.randint(200, 999)}) {draw.randint(200, 999)}-{draw.randint(1000, 9999)}"
        texts.append(
            f"In {draw.randint(1900, 2024)} we saw {draw.randint(10**6, 10**8)} of them, ratio 3.14159265, serial {draw.randint(10**19, 10**20)}. "
            f"Write to {name} [at] example [dot] org or {name}@example.org, call {number} or +1 202 555 0{draw.randint(100, 199)}."
        )
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = spans_of(pii.find_personal_data(rows), texts)
    for doc_id, spans in found.items():
        kinds = [kind for kind, _ in spans]
        assert kinds == ["obfuscated", "email", "number_like", "phone"], (spans, texts[doc_id])
        assert spans[2][1].startswith("(") and spans[0][1].endswith("[dot] org")


def test_numbers_of_no_usual_form_are_left_alone(spark):
    texts = [f"Row {i}: 12345678{i % 10} items, 3.1415926{i % 10}, 2024-01-{10 + i % 20}, 1 000 000, user [at] home" for i in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not any(spans_of(pii.find_personal_data(rows), texts).values())


def test_covered_equals_every_base_span_tried(spark):
    draw = random.Random(9)
    pieces = ["a@b.c", "ü@x.org", "+12025550143", "(555) 555-0100", "1.2.3.4", "4111 1111 1111 1111", "x [at] y [dot] org", " ", " ", "7", "x@y", ". "]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.choice([0, 1, 6, 200]))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = 0
    for r in pii.find_candidates(rows).collect():
        for c in r["candidates"]:
            assert c["covered"] == any(b["start"] < c["end"] and b["end"] > c["start"] for b in r["base"])
            seen += not c["covered"]
    assert seen > 100


def test_many_spans_in_one_text(spark):
    rows = spark.createDataFrame([(1, "call +1 202 555 0143 or (555) 555-0100, " * 300)], "doc_id long, text string")
    found = pii.find_candidates(rows).selectExpr("size(base) AS base", "size(candidates) AS candidates").first()
    assert tuple(found) == (300, 600)
