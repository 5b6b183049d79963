"""Words made to meet in polynomial hashes stay apart; many spans are redacted in linear time."""

import random
import time

from pyspark.sql import functions as F

from fleetfacts.llm import fingerprint, near_dedup, secret_scan


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_words_with_equal_polynomials_are_not_linked(spark):
    one, other = thue_morse(2_048, "a", "b"), thue_morse(2_048, "b", "a")
    tail = " ".join(f"w{i}" for i in range(3))
    texts = [one, other, f"{one} {tail}", f"{other} {tail}", one.upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {0: (0, True), 1: (1, True), 2: (2, True), 3: (3, True), 4: (0, False)}
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprint.compare_with_next(docs).collect()}
    assert len({prints[i] for i in range(4)}) == 4 and prints[4] == prints[0]


def test_redact_equals_a_plain_mask_and_is_linear(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("abc é漢🙂\n") for _ in range(rng.randint(0, 80)))
        spans = sorted((a, rng.randint(a + 1, min(a + 9, len(text)))) for a in rng.sample(range(max(len(text), 1)), rng.randint(0, min(6, len(text)))) if a < len(text))
        rows.append((i, text, [("k", a, b) for a, b in spans]))
    rows.append((99, None, []))
    kind = "doc_id long, text string, spans array<struct<kind: string, start: long, end: long>>"
    redact = lambda df: df.select("doc_id", secret_scan.redact(F.col("text"), F.col("spans")).alias("clean"))
    got = {r["doc_id"]: r["clean"] for r in redact(spark.createDataFrame(rows, kind)).collect()}
    for i, text, spans in rows:
        if text is None:
            assert got[i] is None
            continue
        hit = [any(a <= p < b for _, a, b in spans) for p in range(len(text))]
        # Spans that touch make one mask.
        want = "".join("[SECRET]" if hit[p] and not (p and hit[p - 1]) else "" if hit[p] else c for p, c in enumerate(text))
        assert got[i] == want
    many = [("k", 20 * i, 20 * i + 10) for i in range(20_000)]
    start = time.time()
    clean = secret_scan.redacted("x" * 400_000, [dict(zip(("kind", "start", "end"), s)) for s in many], "#")
    assert time.time() - start < 1 and clean == ("#" + "x" * 10) * 20_000
