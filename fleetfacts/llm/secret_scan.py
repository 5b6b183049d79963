"""Secret scans through a trigram inverted index.

Method: from each rule's regex a Boolean query over trigrams is derived, true for every text that the regex can
match. Blocks of texts are indexed by the trigrams those queries name (postings are bitmaps over a
block's texts); the postings are intersected and united as the query says, and only candidates are
searched with the regex. A rule without mandatory trigrams is searched in every text. The index is over lower-cased
ASCII, so rules may ignore case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfacts.llm.common import chunks, read_table, text_arrays


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose `group` has at least `least` characters; others are dropped without a retry."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False

    def compiled(self):
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


# Fixed: the base kinds, in the order in which they are listed.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=12, ignore_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}", least=16),
)
# A key block goes to its END line, whatever stands between. Where END is missing (or another block begins first), it goes to
# the end of the base64 run: optional header lines, chunks of 16 characters or more between line ends (also escaped ones),
# quotes and the like, and a shorter last chunk that fills its line.
_GAP = r"""(?:[\s"'+,>|*#]|\\+[nrt]?|<br\s*/?>)"""
_KEY_RUN = (
    rf"(?:{_GAP}*+(?:[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\\"]*+{_GAP}++)*+[A-Za-z0-9+/]{{16,}}+={{0,2}}"
    rf"(?:{_GAP}++[A-Za-z0-9+/]{{16,}}+={{0,2}})*+"
    rf"""(?:{_GAP}++[A-Za-z0-9+/]{{1,15}}+={{0,2}}(?=[\x20\t]*+(?:[\r\n\\"'<]|\Z)))?+"""
    rf"|{_GAP}*+[A-Za-z0-9+/]{{1,15}}+={{0,2}}\Z)?+"
)
_KEY_END = r"(?:[^-]++|-(?!----(?:BEGIN|END)\x20))*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
# Formats of well-known issuers.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", rf"-----BEGIN [A-Z0-9 ]{{0,40}}PRIVATE KEY(?: BLOCK)?-----(?:{_KEY_END}|{_KEY_RUN})"),
)

# Alternatives that are followed through a concatenation before the query is cut there.
MAX_STRINGS = 64
MAX_CLASS = 4

ALL = ("all",)


def _strings_query(strings: set[str]):
    """True for every text that holds one of the strings."""
    if not strings or any(len(s) < 3 for s in strings):
        return ALL
    options = []
    for s in sorted(strings):
        options.append(("and", tuple(sorted({s[i : i + 3] for i in range(len(s) - 2)}))))
    return ("or", tuple(options))


def _both(*queries):
    kept = tuple(q for q in queries if q != ALL)
    return ("and", kept) if kept else ALL


def _derive(tokens) -> tuple[set[str] | None, tuple]:
    """(all strings the tokens can match, or None if too many; a query every match satisfies)."""
    run: set[str] = {""}
    exact, found = True, []

    def cut():
        nonlocal run, exact
        found.append(_strings_query(run))
        run, exact = {""}, False

    for kind, value in tokens:
        strings: set[str] | None = None
        query = ALL
        if kind is sre.LITERAL:
            strings = {chr(value).lower()} if value < 128 else None
        elif kind is sre.IN:
            characters: set[str] | None = set()
            for item, inner in value:
                if item is sre.LITERAL and inner < 128:
                    characters.add(chr(inner).lower())
                elif item is sre.RANGE and inner[1] < 128 and inner[1] - inner[0] < 8:
                    characters |= {chr(c).lower() for c in range(inner[0], inner[1] + 1)}
                else:
                    characters = None
                    break
            if characters and len(characters) <= 8:
                strings = characters
        elif kind is sre.SUBPATTERN:
            strings, query = _derive(value[-1])
        elif kind is sre.BRANCH:
            parts = [_derive(branch) for branch in value[1]]
            if all(p[0] is not None for p in parts):
                strings = set().union(*(p[0] for p in parts))
            elif all(p[1] != ALL for p in parts):
                query = ("or", tuple(p[1] for p in parts))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = value
            part, inner_query = _derive(inner)
            if part is not None and (least, most) == (0, 1):
                strings = part | {""}
            elif part is not None and least == most and len(part) == 1:
                strings = {next(iter(part)) * least}
            elif least > 0:
                query = _both(inner_query, _strings_query(part) if part else ALL)
        elif kind is sre.AT:
            strings = {""}
        if strings is not None and len(strings) * len(run) <= MAX_STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            cut()
            if strings is not None and len(strings) <= MAX_STRINGS:
                run = set(strings)
            found.append(query)
    if exact:
        return run, _strings_query(run)
    found.append(_strings_query(run))
    return None, _both(*found)


def trigram_query(rule: Rule):
    """ALL, or nested ("and" | "or", parts) over trigrams of lower-cased text."""
    return _derive(_parser.parse(rule.pattern, re.ASCII))[1]


def _trigrams(query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set().union(*(map(_trigrams, query[1]))) if query != ALL else set()


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Scanner:
    """The rules with their queries, and the table of trigrams that are indexed."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(rule, rule.compiled(), trigram_query(rule)) for rule in rules]
        names = sorted(set().union(*(_trigrams(q) for _, _, q in self.rules)))
        self.slots = {name: i + 1 for i, name in enumerate(names)}
        self.table = np.zeros(1 << 24, np.uint16)
        for name, slot in self.slots.items():
            a, b, c = name.encode()
            self.table[a << 16 | b << 8 | c] = slot

    def postings(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One bitmap over the block's texts for each indexed trigram."""
        bitmaps = np.zeros((len(self.slots) + 1, len(offsets) - 1), bool)
        if len(body) >= 3:
            low = _LOWER[body].astype(np.uint32)
            slots = self.table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            hits = np.flatnonzero(slots)
            bitmaps[slots[hits], np.searchsorted(offsets, hits, side="right") - 1] = True
        return bitmaps

    def _select(self, query, bitmaps: np.ndarray) -> np.ndarray:
        if query == ALL:
            return np.ones(bitmaps.shape[1], bool)
        if isinstance(query, str):
            return bitmaps[self.slots[query]]
        parts = [self._select(part, bitmaps) for part in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)

    def scan(self, body: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """(start, rule index, end) in code points of every text of the block, sorted."""
        bitmaps = self.postings(body, offsets)
        chosen = [self._select(query, bitmaps) for _, _, query in self.rules]
        out = []
        for i in range(len(offsets) - 1):
            active = [r for r, texts in enumerate(chosen) if texts[i]]
            spans = []
            if active:
                text = body[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                for r in active:
                    rule, compiled, _ = self.rules[r]
                    for match in compiled.finditer(text):
                        if match.end(rule.group) - match.start(rule.group) >= rule.least:
                            spans.append((match.start(), r, match.end()))
            out.append(sorted(spans))
        return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan_batches(rules, mask):
    def run(batches):
        scanner = Scanner(rules)
        kinds = [rule.kind for rule in rules]
        for batch in batches:
            body, offsets = text_arrays(batch.column(1))
            spans = []
            for start, end in chunks(offsets):
                part = offsets[start : end + 1]
                found = scanner.scan(body[part[0] : part[-1]], part - part[0])
                spans += [[{"kind": kinds[r], "start": s, "end": e} for s, r, e in row] for row in found]
            columns = [*(batch.column(i) for i in range(batch.num_columns)), pa.array(spans, _SPANS)]
            names = [*batch.schema.names, "spans"]
            if mask is not None:
                texts = batch.column(1)
                hit = [i for i, found in enumerate(spans) if found]
                clean = pa.array([redacted(texts[i].as_py(), spans[i], mask) for i in hit], texts.type)
                columns.append(pc.replace_with_mask(texts, pa.array([bool(found) for found in spans], pa.bool_()), clean) if hit else texts)
                names.append("clean")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, keep: tuple[str, ...] = (), mask: str | None = None
) -> DataFrame:
    """doc_id, text and the columns in `keep` of every row, and `spans`: kind, start, end in code points, by start and
    order of rules. With `mask`, also `clean`: the text with every stretch covered by spans replaced by it.

    A null or empty text has no spans; a null doc_id stays null; repeated rows are scanned each on its own; other
    columns are not looked at. Texts are scanned whole. Nothing is shuffled.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *keep)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in picked.dtypes)
    return picked.mapInArrow(
        _scan_batches(tuple(rules), mask),
        schema + ", spans array<struct<kind: string, start: long, end: long>>" + (", clean string" if mask is not None else ""),
    )


def redacted(text: str | None, spans, mask: str) -> str | None:
    """One text with every stretch covered by spans, which are sorted by start, replaced."""
    if text is None or not len(spans):
        return text
    out, end = [], 0
    for span in spans:
        # A span that starts inside an earlier one, or where it ends, adds only what lies beyond.
        if span["start"] > end or not out:
            out += [text[end : span["start"]], mask]
        end = max(end, span["end"])
    return "".join([*out, text[end:]])


def redact(text, spans, mask: str = "[SECRET]"):
    """`text` with every stretch covered by spans replaced by `mask`; `spans` sorted by start. Linear in text and spans."""

    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([redacted(t, s, mask) for t, s in zip(texts, found)], dtype=object)

    return F.pandas_udf(run, "string")(text, spans)


def digest(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    base = [rule.kind for rule in BASE_RULES]
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(digest(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )
