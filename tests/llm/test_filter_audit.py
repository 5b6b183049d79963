"""The subset walk against filters applied one after the other, on rows with nulls, repeats, copies and clashing columns."""

import random
import re
from itertools import permutations

from fleetfacts.llm import filter_audit

DOCS = "doc_id long, text string, lang string, mask int, part string, n long, digest string, first boolean"


def made(seed, n):
    rng, out = random.Random(seed), []
    texts = [None, "", " \t\n", "Short text", "é½ 漢字 " * 120, "A" * 20_000, "word " * 30_000]
    for i in range(n):
        words = [rng.choice("abcdefghij") * rng.randint(1, 30) for _ in range(rng.choice([20, 199, 200, 260]))]
        text = rng.choice([" ", "\n", "\x0b", "\x1c "]).join(words)
        if rng.random() < 0.3:
            text = text.upper()
        if rng.random() < 0.2:
            text += " 5 % off"
        texts.append(rng.choice(texts) if rng.random() < 0.4 else text)
    rows = [(i, t, rng.choice(["en", "fr", None])) for i, t in enumerate(texts)]
    # Repeated rows, a repeated id with another text, rows without id.
    rows += [rows[10], rows[10], (3, texts[20], "en"), (None, texts[5], "en"), (None, texts[5], "en"), (None, "only here", "fr")]
    return rows


def fails(doc_id, text, rows):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (
        len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        bool(re.search(r"[#$%&*|]", text)),
        doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows),
    )


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, removed_by = {}, {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], fails(r[0], r[1], rows)) for r in rows if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                f = "ABCDE".index(name)
                gone, left = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                removed_by[part, name] = removed_by.get((part, name), 0) + len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(d[1][f] for d in mine) - len(gone), sum(d[1][f] and sum(d[1]) == 1 for d in mine),
                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), name,
                )
    return {(*k, *v[:-1], removed_by[k[0], v[-1]]) for k, v in out.items()}


def test_every_order_and_step_equals_filters_applied_in_turn(spark):
    rows = made(3, 60)
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 60, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1), (10_000, 1, 1)]
    docs = spark.createDataFrame([(*r, 7, "x", 1, "y", False) for r in rows], DOCS).repartition(3)
    marks = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = [tuple(r) for r in filter_audit.audit_filters(docs, marks).collect()]
    assert len(got) == len(set(got)) == 3 * 120 * 5
    assert set(got) == brute(rows, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs.limit(0), labels).count() == 0
    rows = filter_audit.audit_filters(docs, labels).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [tuple(r)[3:] for r in rows] == [(0, 1, 0, 1, 0, 0, 120)] + [(0, 0, 0, 0, 0, 0, 0)] * 4


def test_a_walk_toggles_one_filter_at_a_time_and_stores_every_state():
    rng = random.Random(5)
    cells = {mask: (rng.randint(0, 50), rng.randint(0, 9), rng.randint(0, 9)) for mask in rng.sample(range(32), 20)}
    states = filter_audit.subset_states(cells, 5)
    for active in range(32):
        alive = [c for mask, c in cells.items() if not mask & active]
        assert states[active] == tuple(sum(c[k] for c in alive) for k in range(3))
