"""Repair of conversation structure: the cheapest edits that make every conversation follow the turn grammar.

A repaired conversation has role initials `(s?(ua)+)?`. Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert of an empty user or
assistant turn 3, and a truncated row that isn't deleted 3 more; blank and duplicate rows must be deleted. Of the cheapest edits
those whose initials in order (the audit) are ASCII-least are taken.

Method: a row becomes a letter (its role's initial and its fault), a conversation a word of letters. Words are cut into blocks of at most
`BLOCK_ROWS` letters, and the different blocks of all conversations are sorted by their reversed letters, so that words with a common suffix stand
together: each suffix is one node of a suffix-shared automaton, built once from the end, and keeps for each grammar state the cost to go and
the best audit suffix to each state at the block's end. A task holds only the nodes of one word.

An audit of a block ends with an edit that takes its last row; inserts before a row belong to that row. So two audits of one block
from one state are equal or differ before either ends, and the better of two wholes is known from costs and from the order of the audits by
end state. A conversation of any length is therefore a chain of 4 x 4 tables, put together first inside each range of sorted rows, then
over the ranges. Rows are sorted in ranges of (conv_id, turn, role, text digest), so that a conversation, a text or a repeated row of any
number is spread over tasks; texts are shuffled only to be written.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfacts.llm.common import cut_lineage, read_table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK_ROWS = 64
# Copies of one row that are sorted as one entry.
PIECE_COPIES = 4_096
BLANKS = " \t\n\x0b\x0c\r"

# States of the grammar: nothing yet, after s, after u, after a. Every state allows one role to be inserted.
STATES = range(4)
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
AFTER_INSERT = (2, 2, 3, 2)
ROLE_INTO = {2: "user", 3: "assistant"}
# Inserts at the end, by the state after the last row.
TAIL = ("", "II", "I", "")
# A letter: X a blank or duplicate row, else the role's initial (o for others), upper case if truncated.
LEGAL_PAIRS = ("su", "ua", "au")

Table = list[list]  # 4 x 4, by state before and after; None where there is no way


def rows_with_defaults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, a null role or text as one space."""
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )


def faulted_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, piece, copies, blank, ended and first of the different rows.

    Equal rows are counted before they meet. A row's role and text are new (`first`) in the conversation's first turn that has them, nulls
    first; of several copies there only one is.
    """
    bare = F.rtrim("text", F.lit(BLANKS))
    counted = cut_lineage(
        rows_with_defaults(rows)
        .select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended"))
        .groupBy("conv_id", "turn", "role", "digest", "blank", "ended").agg(F.count("*").alias("n")),
        "turns",
    )
    firsts = counted.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"))).alias("at"))
    left, right = counted.alias("l"), firsts.alias("r")
    joined = left.join(
        right, F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.role") == F.col("r.role")) & (F.col("l.digest") == F.col("r.digest"))
    )
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("l.n") - 1) / PIECE_COPIES))
    return joined.select("l.*", F.col("l.turn").eqNullSafe(F.col("r.at.turn")).alias("first"), F.explode(pieces).alias("piece")).select(
        "conv_id", "turn", "role", "digest", "piece", F.least(F.col("n") - F.col("piece") * PIECE_COPIES, F.lit(PIECE_COPIES)).alias("copies"),
        "blank", "ended", (F.col("first") & (F.col("piece") == 0)).alias("first"),
    )


def letter(role: str, blank: bool, ended: bool, first: bool) -> str:
    if blank or not first:
        return "X"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial if ended else initial.upper()


_COUNTS = ("blank", "duplicate", "truncated", "illegal")


class _Segment:
    """Consecutive rows of one conversation inside one range of sorted rows, handed on block by block."""

    def __init__(self, number: int, conv_id):
        self.number, self.conv_id, self.last = number, conv_id, None
        self.low = self.high = None

    def block(self, number: int) -> dict:
        return {
            "conv_id": self.conv_id, "segment": self.number, "block": number, "word": "", "roles": [], "digests": [], "turns": 0,
            "low": None, "high": None, "first": None, "last": None, **dict.fromkeys(_COUNTS, 0),
        }

    def add(self, out: dict, row: dict, first: bool) -> None:
        role, initial = row["role"], row["role"][:1]
        kind = letter(role, row["blank"], row["ended"], first)
        out["word"] += kind
        out["roles"].append(role)
        out["digests"].append(row["digest"])
        if kind == "X":
            out["blank" if row["blank"] else "duplicate"] += 1
        else:
            out["truncated"] += not row["ended"]
        if self.last is not None and self.last + initial not in LEGAL_PAIRS:
            out["illegal"] += 1
        if out["first"] is None:
            out["first"] = initial
        out["last"] = self.last = initial
        if (turn := row["turn"]) is not None:
            if turn != self.high:
                out["turns"] += 1
            out["low"] = turn if out["low"] is None else out["low"]
            out["high"] = self.high = turn


def blocks_of(rows, part: int):
    """Blocks, as dictionaries, of sorted rows; none has more than `BLOCK_ROWS` letters or rows of two conversations."""
    segment, out, segments, blocks = None, None, 0, 0
    for row in rows:
        if segment is None or segment.conv_id != row["conv_id"]:
            if out:
                yield out
            segment, out, segments = _Segment(segments, row["conv_id"]), None, segments + 1
        for copy in range(row["copies"]):
            if out and len(out["word"]) == BLOCK_ROWS:
                yield out
                out = None
            if not out:
                out = segment.block(blocks) | {"part": part}
                blocks += 1
            segment.add(out, row, first=row["first"] and copy == 0)
    if out:
        yield out


def _batched(rows, schema: pa.Schema, size: int = 2_000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


_ARROW = {
    "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "strings": pa.list_(pa.string()), "ints": pa.list_(pa.int32()),
    "longs": pa.list_(pa.int64()), "binaries": pa.list_(pa.binary()),
}
_DDL = {"strings": "array<string>", "ints": "array<int>", "longs": "array<bigint>", "binaries": "array<binary>"}


def _mapped(df: DataFrame, task, columns: dict[str, str]) -> DataFrame:
    """`task`, from rows to rows as dictionaries, over the partitions of `df`. conv_id keeps its type."""
    kind = dict(df.dtypes).get("conv_id", "long")
    columns = {name: kind if name == "conv_id" else k for name, k in columns.items()}
    schema = pa.schema([(name, _ARROW[k]) for name, k in columns.items()])

    def run(batches):
        yield from _batched(task(_rows(batches)), schema)

    return df.mapInArrow(run, ", ".join(f"{name} {_DDL.get(k, k)}" for name, k in columns.items()))


_BLOCK = {
    "part": "int", "segment": "long", "block": "long", "conv_id": "", "word": "string", "roles": "strings", "digests": "binaries", "turns": "long",
    "low": "long", "high": "long", "first": "string", "last": "string", **dict.fromkeys(_COUNTS, "long"),
}


def word_blocks(rows: DataFrame) -> DataFrame:
    """The blocks of all conversations, in ranges of sorted rows: part is the range, segment and block are numbers inside it."""
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest", "piece"]
    sorted_rows = faulted_rows(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    return _mapped(sorted_rows, lambda found: blocks_of(found, TaskContext.get().partitionId()), _BLOCK)


def letter_ways(kind: str) -> list[list[tuple[int, int, str]]]:
    """By state: the best (state after, cost, audit) to each state that a row with this letter can be taken to."""
    out = []
    for state in STATES:
        best: dict[int, tuple[int, str]] = {}

        def offer(after, cost, audit, best=best):
            if after not in best or (cost, audit) < best[after]:
                best[after] = cost, audit

        at, before = state, 0
        # Three inserts lead back to a state that one insert led to.
        for _ in range(3):
            inserted = "I" * before
            offer(at, INSERT * before + DELETE, inserted + "D")
            if kind != "X":
                more = TRUNCATED if kind.isupper() else 0
                if (at, kind.lower()) in AFTER:
                    offer(AFTER[at, kind.lower()], INSERT * before + more, inserted + "K")
                offer(AFTER_INSERT[at], INSERT * before + REROLE + more, inserted + "R")
            at, before = AFTER_INSERT[at], before + 1
        out.append([(after, *way) for after, way in sorted(best.items())])
    return out


WAYS = {kind: letter_ways(kind) for kind in "suaoSUAOX"}
EMPTY: Table = [[(0, "") if p == q else None for q in STATES] for p in STATES]


def before(kind: str, node: Table) -> Table:
    """The node of a letter and what follows: (cost to go, best audit suffix) by state and state at the end."""
    out = []
    for ways in WAYS[kind]:
        best = [None] * 4
        for after, cost, audit in ways:
            for q, rest in enumerate(node[after]):
                if rest is not None:
                    way = (cost + rest[0], audit + rest[1])
                    if best[q] is None or way < best[q]:
                        best[q] = way
        out.append(best)
    return out


def automaton(words):
    """(word, its node, nodes made for it) of words in the order of their reversed letters: each suffix is made once."""
    path, last = [EMPTY], ""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[-1 - common] == last[-1 - common]:
            common += 1
        del path[common + 1 :]
        for k in range(common, len(word)):
            path.append(before(word[-1 - k], path[-1]))
        last = word
        yield word, path[-1], len(word) - common


def ranked(node: Table) -> tuple[list[int], list[int]]:
    """Costs (-1: no way) and, by state before, the order of the audits by state after."""
    cost, rank = [], []
    for row in node:
        order = sorted((way[1], q) for q, way in enumerate(row) if way is not None)
        place = {q: k for k, (_, q) in enumerate(order)}
        cost += [-1 if way is None else way[0] for way in row]
        rank += [place.get(q, -1) for q in STATES]
    return cost, rank


def _node_rows(rows):
    for word, node, _ in automaton(r["word"] for r in rows):
        cost, rank = ranked(node)
        yield {"word": word, "cost": cost, "rank": rank, "audits": [way[1] if way else None for row in node for way in row]}


def suffix_nodes(words: DataFrame) -> DataFrame:
    """word, cost, rank and audits of the different words: the node of each, by 4 x 4 states.

    Words are dealt out in ranges of their reversed letters, so a suffix is made again only where a range begins.
    """
    order = F.reverse("word")
    dealt = words.select("word").distinct().repartitionByRange(order).sortWithinPartitions(order)
    return _mapped(dealt, _node_rows, {"word": "string", "cost": "longs", "rank": "ints", "audits": "strings"})


def joined(a: tuple, b: tuple) -> tuple[list[int], list[int]]:
    """(cost, rank) of two pieces one after the other."""
    (cost_a, rank_a), (cost_b, rank_b) = a, b
    cost, rank = [-1] * 16, [-1] * 16
    for p in STATES:
        keys = []
        for r in STATES:
            ways = [
                (cost_a[4 * p + q] + cost_b[4 * q + r], rank_a[4 * p + q], q)
                for q in STATES if cost_a[4 * p + q] >= 0 and cost_b[4 * q + r] >= 0
            ]
            if ways:
                cost[4 * p + r], first, q = min(ways)
                keys.append((first, rank_b[4 * q + r], r))
        for place, (_, _, r) in enumerate(sorted(keys)):
            rank[4 * p + r] = place
    return cost, rank


def states_along(pieces: list[tuple], start: int, ends: list[int | None]) -> tuple[int, list[int]]:
    """Least cost from `start` through all pieces, with what it costs to end in each state (None: not allowed), and the states between."""
    to_go, choices = ends, []
    for cost, rank in reversed(pieces):
        best = [
            min(((cost[4 * p + q] + to_go[q], rank[4 * p + q], q) for q in STATES if cost[4 * p + q] >= 0 and to_go[q] is not None), default=None)
            for p in STATES
        ]
        to_go = [None if b is None else b[0] for b in best]
        choices.append([None if b is None else b[2] for b in best])
    states = [start]
    for choice in reversed(choices):
        states.append(choice[states[-1]])
    return to_go[start], states


def _segment_tables(rows):
    for row in rows:
        chain = row.pop("chain")
        table = chain[0]["cost"], chain[0]["rank"]
        for piece in chain[1:]:
            table = joined(table, (piece["cost"], piece["rank"]))
        yield row | {"cost": table[0], "rank": table[1], "first": chain[0]["first"], "last": chain[-1]["last"]}


def _decisions(rows):
    for row in rows:
        pieces = row["pieces"]
        cost, states = states_along([(p["cost"], p["rank"]) for p in pieces], 0, [INSERT * len(t) for t in TAIL])
        turns = [(p["turns"], p["low"], p["high"]) for p in pieces if p["low"] is not None]
        different = sum(t[0] for t in turns) - sum(a[2] == b[1] for a, b in zip(turns, turns[1:]))
        out = {
            "conv_id": row["conv_id"], "cost": cost, "gaps": turns[-1][2] - turns[0][1] + 1 - different if turns else 0,
            **{name: sum(p[name] for p in pieces) for name in _COUNTS},
        }
        out["illegal"] += sum(a["last"] + b["first"] not in LEGAL_PAIRS for a, b in zip(pieces, pieces[1:]))
        yield out | {
            "parts": [p["part"] for p in pieces], "segments": [p["segment"] for p in pieces], "states": states,
            "tails": [""] * (len(pieces) - 1) + [TAIL[states[-1]]],
        }


def _block_audits(rows):
    for row in rows:
        chain = row["chain"]
        ends = [0 if q == row["leave"] else None for q in STATES]
        _, states = states_along([(p["cost"], p["rank"]) for p in chain], row["enter"], ends)
        for k, piece in enumerate(chain):
            audit = piece["audits"][4 * states[k] + states[k + 1]]
            yield {
                "conv_id": row["conv_id"], "part": row["part"], "block": piece["block"], "enter": states[k],
                "audit": audit + (row["tail"] if k == len(chain) - 1 else ""),
            }


def _edits(rows):
    for row in rows:
        state, at = row["enter"], 0
        for k, edit in enumerate(row["audit"]):
            out = {"conv_id": row["conv_id"], "part": row["part"], "block": row["block"], "place": k, "edit": edit, "given": None, "digest": None, "role": None}
            if edit != "I":
                out |= {"given": row["roles"][at], "digest": row["digests"][at]}
                at += 1
            if edit == "K":
                state = AFTER[state, out["given"][:1]]
                out["role"] = out["given"]
            elif edit != "D":
                state = AFTER_INSERT[state]
                out["role"] = ROLE_INTO[state]
            yield out


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: what was found in each conversation, and the edits of its rows.

    `rows` has conv_id, turn, role and text; other columns are not looked at. A null role or text is one space, a null turn comes first, a
    null conv_id is a conversation of its own. Rows of one turn are taken by role, then by the text's SHA-256; equal rows are copies, all but the first
    duplicates. Both tables are empty for an empty one.

    Conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost. Edits, in the order of (conv_id, part, block, place): edit (K, R, D, I),
    given (the role before), role (after, null if deleted) and text (null if deleted, empty if inserted).
    """
    blocks = cut_lineage(word_blocks(rows), "blocks")
    nodes = suffix_nodes(blocks)
    chain = F.array_sort(F.collect_list(F.struct("block", "cost", "rank", "audits", "first", "last"))).alias("chain")
    # The blocks of a segment are as many as one task has sorted, so that a chain is bounded by a range of rows.
    chains = cut_lineage(
        blocks.join(nodes, "word").groupBy("part", "segment", "conv_id").agg(
            chain, F.sum("turns").alias("turns"), F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in _COUNTS]
        ),
        "chains",
    )
    counts = {"turns": "long", "low": "long", "high": "long", **dict.fromkeys(_COUNTS, "long")}
    light = chains.withColumn("chain", F.transform("chain", lambda c: F.struct(c["cost"].alias("cost"), c["rank"].alias("rank"), c["first"].alias("first"), c["last"].alias("last"))))
    tables = _mapped(
        light, _segment_tables, {"conv_id": "", "part": "int", "segment": "long", **counts, "cost": "longs", "rank": "ints", "first": "string", "last": "string"}
    )
    # A conversation has at most one segment in each range of rows.
    pieces = F.array_sort(F.collect_list(F.struct("part", "segment", *counts, "cost", "rank", "first", "last"))).alias("pieces")
    decided = cut_lineage(
        _mapped(
            tables.groupBy("conv_id").agg(pieces), _decisions,
            {"conv_id": "", "cost": "long", "gaps": "long", **dict.fromkeys(_COUNTS, "long"), "parts": "ints", "segments": "longs", "states": "ints", "tails": "strings"},
        ),
        "decided",
    )
    ways = decided.select(F.explode(F.arrays_zip(
        "parts", "segments", F.slice("states", F.lit(1), F.size("parts")).alias("enter"), F.slice("states", F.lit(2), F.size("parts")).alias("leave"), "tails"
    )).alias("w")).select("w.parts", "w.segments", "w.enter", "w.leave", F.col("w.tails").alias("tail"))
    through = chains.join(ways, (F.col("part") == F.col("parts")) & (F.col("segment") == F.col("segments"))).select(
        "conv_id", "part", "enter", "leave", "tail", F.transform("chain", lambda c: F.struct(c["block"].alias("block"), c["cost"].alias("cost"), c["rank"].alias("rank"), c["audits"].alias("audits"))).alias("chain")
    )
    audits = _mapped(through, _block_audits, {"conv_id": "", "part": "int", "block": "long", "enter": "int", "audit": "string"})
    edits = _mapped(
        audits.join(blocks.select("part", "block", "roles", "digests"), ["part", "block"]), _edits,
        {"conv_id": "", "part": "int", "block": "long", "place": "int", "edit": "string", "given": "string", "digest": "binary", "role": "string"},
    )
    texts = rows_with_defaults(rows).select("conv_id", F.unhex(F.sha2("text", 256)).alias("digest"), "text").groupBy("conv_id", "digest").agg(F.first("text").alias("text"))
    e, t = edits.alias("e"), texts.alias("t")
    with_text = e.join(t, F.col("e.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("e.digest") == F.col("t.digest")) & F.col("e.role").isNotNull(), "left").select(
        "e.conv_id", "part", "block", "place", "edit", "given", "role", F.when(F.col("edit") == "I", "").otherwise(F.col("t.text")).alias("text")
    )
    return decided.select("conv_id", "gaps", *_COUNTS, "cost"), with_text


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of a table of conversations after damage by crc32(`conv_id:turn`) % 20 (nulls: one space).

    0 drops a row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 sets the role user.
    """
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(key("conv_id"), F.lit(":"), key("turn")).cast("binary")) % 20
    rows = rows_with_defaults(conversations).withColumn("kind", kind).where("kind != 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _digests(rows):
    """conv_id, audit and digest of the repaired rows of each conversation; rows come in order, and no conversation is held."""
    for conv_id, edits in groupby(rows, key=lambda r: r["conv_id"]):
        digest, audit, empty = hashlib.sha256(), [], True
        for row in edits:
            audit.append(row["edit"])
            if row["role"] is not None:
                digest.update((("" if empty else "\n") + row["role"] + ":" + row["text"]).encode())
                empty = False
        yield {"conv_id": conv_id, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}


def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    found, edits = repair_conversations(damage(given))
    # SHA-256 reads a conversation from its start, so that each is read by one task, as a stream.
    ordered = edits.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "place")
    repaired = _mapped(ordered.select("conv_id", "edit", "role", "text"), _digests, {"conv_id": "", "audit": "string", "repaired_sha256": "string"})
    numbers = ["gaps", *_COUNTS, "cost"]
    each = (
        given.select("conv_id").distinct()
        .unionByName(found, allowMissingColumns=True).unionByName(repaired, allowMissingColumns=True)
    )
    return each.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.max("audit").alias("audit"), F.max("repaired_sha256").alias("sha")).select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def _sql_way(cost: str, audit: str, to: str, when: str = "true") -> str:
    return f"CASE WHEN {when} THEN {{'c': {to}.c + {cost}, 'a': '{audit}' || {to}.a}} END"


def _sql_taken(state: int) -> str:
    """Cheapest way to take a row in a state, before what follows."""
    kept = [_sql_way("more", "K", f"t{q}", f"fault <> 'x' AND initial = '{i}'") for (p, i), q in AFTER.items() if p == state]
    return f"list_min([{', '.join([_sql_way(str(DELETE), 'D', f't{state}'), _sql_way(f'more + {REROLE}', 'R', f't{AFTER_INSERT[state]}', chr(39).join(['fault <> ', 'x', ''])), *kept])}])"


def _sql_open(state: int) -> str:
    """The same with inserts before."""
    ways, at, inserts = [], state, 0
    while at not in {w[0] for w in ways}:
        ways.append((at, inserts))
        at, inserts = AFTER_INSERT[at], inserts + 1
    return f"list_min([{', '.join(_sql_way(str(INSERT * n), 'I' * n, f'c{p}') for p, n in ways)}])"


SQL = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
),
keyed AS (
  SELECT *, xor(list_reduce(
    flatten(list_transform(string_split(key, ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
    lambda crc, b: xor(xor(crc, b) >> 1, 3988292384 * (xor(crc, b) & 1)), CAST(4294967295 AS BIGINT)
  ), CAST(4294967295 AS BIGINT)) % 20 AS kind
  FROM given
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM keyed WHERE kind <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare, substr(role, 1, 1) AS initial
  FROM damaged
),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous
  FROM placed
),
faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS name
  FROM seen
),
signed AS (
  SELECT conv_id, i, initial, CASE WHEN name IN ('blank', 'duplicate') THEN 'x' ELSE '' END AS fault,
    CASE WHEN name = 'truncated' THEN {TRUNCATED} ELSE 0 END AS more
  FROM faulty
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (name = 'blank') AS blank, count(*) FILTER (name = 'duplicate') AS duplicate, count(*) FILTER (name = 'truncated') AS truncated,
    count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id
),
dp AS (
  SELECT conv_id, n AS k, {", ".join(f"{{'c': CAST({INSERT * len(t)} AS BIGINT), 'a': '{t}'}} AS t{p}" for p, t in enumerate(TAIL))} FROM counts
  UNION ALL
  SELECT conv_id, k - 1, {", ".join(map(_sql_open, STATES))}
  FROM (
    SELECT dp.conv_id, dp.k, {", ".join(f"{_sql_taken(p)} AS c{p}" for p in STATES)}
    FROM dp JOIN signed s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.i = dp.k
  )
),
best AS (SELECT conv_id, t0.c AS cost, t0.a AS audit FROM dp WHERE k = 0),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(generate_series(1, length(audit))) AS place FROM best WHERE audit <> ''),
numbered AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS o,
    (count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id)) % 2 AS odd
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY place)
),
lines AS (
  SELECT n.conv_id, n.place,
    CASE WHEN n.edit = 'K' THEN p.role WHEN (n.o - n.odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN n.edit = 'I' THEN '' ELSE p.text END AS line
  FROM numbered n LEFT JOIN placed p ON p.conv_id IS NOT DISTINCT FROM n.conv_id AND p.i = n.i
  WHERE n.edit <> 'D'
),
repaired AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY place) AS body FROM lines GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
