"""Repair of conversations against all edits of short words, a plain dynamic program, and rows spread over many blocks and ranges."""

import hashlib
import random
import re
from itertools import product

import pytest

from fleetfacts.llm import chat_repair as repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def all_edits(word):
    """(cost, audit) of the best edits of a word of letters, by trying all with at most three inserts in a place."""
    best = None
    inserts = ["", "u", "a", "ua", "au", "uau", "aua"]
    choices = [["D"] if kind == "X" else ["D", "K", "Ru", "Ra"] for kind in word]
    for picked in product(*choices):
        for gaps in product(inserts, repeat=len(word) + 1):
            roles = gaps[0]
            for kind, edit, gap in zip(word, picked, gaps[1:]):
                roles += {"D": "", "K": kind.lower(), "Ru": "u", "Ra": "a"}[edit] + gap
            if GRAMMAR.fullmatch(roles):
                cost = 3 * sum(map(len, gaps)) + sum(
                    4 if e == "D" else 3 * (e[0] == "R") + 3 * k.isupper() for k, e in zip(word, picked) if not (k == "X" and e != "D")
                )
                audit = "I" * len(gaps[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(picked, gaps[1:]))
                best = min(best or (cost, audit), (cost, audit))
    return best


def solved(word, cut=None):
    """The same from the automaton, the word cut into blocks."""
    pieces = [word[i : i + (cut or len(word))] for i in range(0, len(word), cut or len(word))]
    nodes = {p: node for p, node, _ in repair.automaton(sorted(set(pieces), key=lambda w: w[::-1]))}
    cost, states = repair.states_along([repair.ranked(nodes[p]) for p in pieces], 0, [3 * len(t) for t in repair.TAIL])
    return cost, "".join(nodes[p][a][b][1] for p, a, b in zip(pieces, states, states[1:])) + repair.TAIL[states[-1]]


def test_equals_all_edits_of_short_words():
    letters = "suaoSUAOX"
    for word in [*letters, *map("".join, product(letters, repeat=2)), *random.Random(1).sample(["".join(w) for w in product(letters, repeat=3)], 60)]:
        assert solved(word) == all_edits(word), word


def test_a_cut_word_is_repaired_like_the_whole_and_tables_may_be_joined_in_any_order():
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("suaoSUAOX" if rng.random() < 0.5 else "uaX") for _ in range(rng.randint(1, 40)))
        assert solved(word) == solved(word, rng.randint(1, 9)), word
        tables = [repair.ranked(repair.before(k, repair.EMPTY)) for k in word]
        left = tables[0]
        for t in tables[1:]:
            left = repair.joined(left, t)
        right = tables[-1]
        for t in reversed(tables[:-1]):
            right = repair.joined(t, right)
        assert left == right == repair.ranked(list(repair.automaton([word]))[0][1])


def test_every_suffix_is_one_node():
    rng = random.Random(3)
    words = {"".join(rng.choice("uaX") for _ in range(rng.randint(1, 12))) for _ in range(2_000)}
    made = sum(n for _, _, n in repair.automaton(sorted(words, key=lambda w: w[::-1])))
    assert made == len({w[i:] for w in words for i in range(len(w))}) < sum(map(len, words)) / 2


def plain(rows):
    """conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, digest) by a dynamic program over whole conversations."""
    out, by = {}, {}
    for conv_id, turn, role, text in rows:
        by.setdefault(conv_id, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    for conv_id, found in by.items():
        found.sort(key=lambda r: (r[0], r[1], r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, word, counts = set(), "", dict(blank=0, duplicate=0, truncated=0)
        for _, _, role, text in found:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            initial = role[:1] if role[:1] in tuple("sua") else "o"
            word += "X" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        best = [(0, ""), (6, "II"), (3, "I"), (0, "")]
        for kind in reversed(word):
            taken = []
            for p in range(4):
                ways = [(best[p][0] + 4, "D" + best[p][1])]
                if kind != "X":
                    more = 3 * kind.isupper()
                    q = repair.AFTER.get((p, kind.lower()))
                    ways += [(best[q][0] + more, "K" + best[q][1])] if q is not None else []
                    q = (2, 2, 3, 2)[p]
                    ways.append((best[q][0] + 3 + more, "R" + best[q][1]))
                taken.append(min(ways))
            more = lambda p, n: (taken[p][0] + 3 * n, "I" * n + taken[p][1])
            best = [min(taken[0], more(2, 1), more(3, 2)), min(taken[1], more(2, 1), more(3, 2)), min(taken[2], more(3, 1)), min(taken[3], more(2, 1))]
        cost, audit = best[0]
        at, lines, kept = 0, [], [e for e in audit if e != "D"]
        for edit in audit:
            row = None if edit == "I" else found[at]
            at += edit != "I"
            if edit != "D":
                o = len(lines) + 1 - len(kept) % 2
                role = row[2] if edit == "K" else "user" if o % 2 else "assistant"
                lines.append(f"{role}:{row[3] if row else ''}")
        assert at == len(found)
        numbers = [r[1] for r in found if r[0]]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(found, found[1:])]
        out[conv_id] = (
            gaps, *counts.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
        )
    return out


def made(seed):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "cut off", "é漢字🙂?", "", " \n", None, "Why? ", "a\nb", "x" * 100_000 + "."]
    for conv_id in [None, *range(-1, 40)]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv_id, rng.choice([turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts)))
    # One conversation with a third of all rows, and one row many times over.
    rows += [(77, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(150)]
    rows += [(78, 5, "user", "Again.")] * 60 + [(78, 6, "assistant", "Well.")]
    rng.shuffle(rows)
    return rows


def summary(spark, found, edits):
    numbers = {r["conv_id"]: tuple(r)[1:] for r in found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost").collect()}
    out, lines = {}, {}
    for r in sorted(edits.collect(), key=lambda r: (r["part"], r["block"], r["place"])):
        out.setdefault(r["conv_id"], []).append(r["edit"])
        if r["role"] is not None:
            lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert out.keys() == numbers.keys()
    return {c: (*numbers[c], "".join(out[c]), hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest()) for c in out}


@pytest.mark.parametrize("block,copies", [(64, 4096), (3, 7)])
def test_equals_a_plain_program_over_blocks_and_ranges(spark, monkeypatch, block, copies):
    monkeypatch.setattr(repair, "BLOCK_ROWS", block)
    monkeypatch.setattr(repair, "PIECE_COPIES", copies)
    rows = made(block)
    table = spark.createDataFrame([(*r, "p", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, digest int").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found, edits = repair.repair_conversations(table)
        got = summary(spark, found, edits)
        parts = {r["part"] for r in edits.where("conv_id = 77").select("part").distinct().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(rows)
    assert len(parts) > 1


def test_empty_table_and_conversations_that_lose_all_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found, edits = repair.repair_conversations(empty)
    assert found.count() == edits.count() == 0
    # 0:9 is dropped by its hash.
    import zlib

    turn = next(t for t in range(100) if zlib.crc32(f"0:{t}".encode()) % 20 == 0)
    assert repair.damage(spark.createDataFrame([(0, turn, "user", "x")], empty.schema)).count() == 0


def test_damage_by_the_hash_of_conversation_and_turn(spark):
    import zlib

    rows = [(c, t, "assistant", "Well. Is it?! Yes") for c in (None, 0, 7) for t in (None, *range(60))]
    got = {}
    for r in repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"]))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = {
            0: None, 1: [(role, "")], 2: [(role, "Well Is it Yes")], 3: [(role, text)] * 2, 4: [("user", text)],
        }.get(kind, [(role, text)])
        assert got.get((c, t)) == want
