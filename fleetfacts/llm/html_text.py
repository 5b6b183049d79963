"""Main text of web pages by block rules in two passes.

Method: a page is cut into blocks at block-level tags. The first pass classifies each block by its length, its density of
stop words and its density of link text: good, bad, or undecided where it is short. Undecided blocks then
inherit the label of their nearest decided neighbours. Elements that never hold an article's text (navigation, headers
and footers of the page, sidebars, forms, scripts, reader comments, adverts, notices) are bad whatever they
say; undecided blocks have neighbours within their own article element, or outside of all of them, only. Such an element is evidence, not a verdict.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfacts.llm.common import read_table

LONG_CHARS = 70
STOP_DENSITY = 0.2
LINK_DENSITY = 0.5

# Function words of the four languages of the pages.
STOP_WORDS = frozenset(
    """
    a about and are as at be been by for from had has have he her his i in is it its not of on or she that the their
    they this to was were which will with you
    au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous on ou par pas pour que qui sa se
    ses son sont sur un une vous été
    als am an auch auf aus bei das dass dem den der des die durch ein eine einer eines er es für hat ich im ist mit
    nach nicht noch oder sich sie sind so über um und uns von vor war wie wird zu zum zur
    al como con cual del el ella ellos era esta este fue ha han hay las lo los más mi muy no nos para pero por
    porque quien sin sobre su sus también una uno y ya
    """.split()
)
# Elements that end a block where they begin and where they end.
BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol option optgroup p pre
    section select summary table tbody td tfoot th thead title tr ul
    """.split()
)
# Elements whose text is never part of a page's text.
SILENT_TAGS = frozenset("script style noscript template head svg math canvas object iframe textarea select button".split())
# Elements that hold no article's text.
FURNITURE_TAGS = frozenset("nav aside footer form menu dialog".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())
# Names of such elements, as whole class tokens or ids; the first kind holds texts of its own, also in article elements.
_AROUND = r"(?:(?:site|main|page|global|top|bottom|left|right|post|entry)[_-])?(?:%s)(?:[_-](?:area|bar|block|box|container|content|form|inner|links?|list|menu|section|slot|thread|unit|wrap|wrapper|\d+))?"
FOREIGN_NAMES = re.compile(_AROUND % r"ads?|advert\w*|sponsor\w*|promo\w*|comments?|disqus|respond|replies|related|recommended", re.IGNORECASE)
FURNITURE_NAMES = re.compile(
    _AROUND % (
        r"banner|nav|navbar|navigation|menu|breadcrumbs?|side-?bar|widget|footer|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|"
        r"subscribe|signup|social|share|sharing|login|search|pagination|pager|toolbar|masthead|skip-?link|copyright"
    ),
    re.IGNORECASE,
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# End tags that may be left out: an element of the first kind is closed by the start of any of the second.
CLOSED_BY = {
    "p": BLOCK_TAGS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}),
    "option": frozenset({"option", "optgroup"}),
}
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
# `head` ends at the first of these even without an end tag.
BODY_TAGS = BLOCK_TAGS - {"html", "title"}


class _Blocks(HTMLParser):
    """Blocks of a page: text, characters inside links, region (0: furniture, else the article it is in, or 1)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int]] = []
        self.stack: list[tuple[str, bool, bool, int, bool]] = []  # tag, silent, furniture, article and named before it
        self.parts: list[str] = []
        self.linked = 0
        self.links = 0
        self.articles = 1
        self.silent = self.furniture = 0
        self.article = 1
        self.named = False  # inside an element of a furniture name, and no article below it

    def _cut(self):
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.blocks.append((text, self.linked, 0 if self.furniture or self.named else self.article))
        self.parts, self.linked = [], 0

    def _push(self, tag, attributes):
        names = {k: v or "" for k, v in attributes}
        silent = tag in SILENT_TAGS or "hidden" in names
        own = tag in ("article", "main") or names.get("role", "").lower() == "main"
        tokens = [] if own or tag in ("html", "body") else [*names.get("class", "").split(), names.get("id", "").strip()]
        furniture = (
            tag in FURNITURE_TAGS
            or names.get("role", "").lower() in FURNITURE_ROLES
            or any(FOREIGN_NAMES.fullmatch(t) for t in tokens)
            or (tag == "header" and self.article == 1)
        )
        self.stack.append((tag, silent, furniture, self.article, self.named))
        self.silent += silent
        self.furniture += furniture
        self.named = not own and (self.named or any(FURNITURE_NAMES.fullmatch(t) for t in tokens))
        if own:
            self.articles += 1
            self.article = self.articles
        if tag == "a":
            self.links += 1

    def _pop(self):
        tag, silent, furniture, self.article, self.named = self.stack.pop()
        self.silent -= silent
        self.furniture -= furniture
        if tag == "a":
            self.links -= 1

    def handle_starttag(self, tag, attributes):
        if tag in BODY_TAGS and any(entry[0] == "head" for entry in self.stack):
            self._close("head")
        if tag in BLOCK_TAGS:
            self._cut()
            # Open inline elements inside an element whose end tag is left out end with it.
            for depth in range(len(self.stack) - 1, -1, -1):
                open_tag = self.stack[depth][0]
                if open_tag in CLOSED_BY and tag in CLOSED_BY[open_tag]:
                    del_to = depth
                    while len(self.stack) > del_to:
                        self._pop()
                    break
                if open_tag in BLOCK_TAGS:
                    break
        elif tag == "br":
            self.parts.append(" ")
        if tag not in VOID_TAGS:
            self._push(tag, attributes)

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)

    def _close(self, tag):
        if any(entry[0] == tag for entry in self.stack):
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self._cut()
        self._close(tag)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def close(self):
        super().close()
        self._cut()


GOOD, BAD, UNDECIDED = 1, -1, 0


def first_pass(text: str, linked: int, region: int) -> int:
    """Label of a block by itself; the rules are the same in every region but furniture."""
    if region == 0:
        return BAD
    words = _WORD.findall(text.lower())
    prose = sum(w in STOP_WORDS for w in words) >= STOP_DENSITY * max(1, len(words))
    if linked > LINK_DENSITY * len(text):
        # Linked sentences, and short links, may belong to the prose around them.
        return UNDECIDED if prose or len(text) < LONG_CHARS else BAD
    if len(text) < LONG_CHARS:
        return UNDECIDED
    if prose:
        return GOOD
    return BAD if linked > 0.2 * len(text) else UNDECIDED


def second_pass(labels: list[int], regions: list[int], blocks: list[tuple[str, int, int]]) -> list[int]:
    """Undecided blocks take the label of the nearest decided neighbours in their region: good if either is good, a block that is
    mostly link only if both are (at the ends of the region, the one there is).

    The article element is evidence beforehand: without a decided neighbour a block of it is good, unless the page's good blocks outside of
    articles are longer together than those inside; then, and on pages without article, such blocks outside are good. Good
    blocks outside stay good where they are the longer part, or are twice LONG_CHARS long.
    """
    n = len(labels)
    before, after = [UNDECIDED] * n, [UNDECIDED] * n
    for place, sequence in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[int, int] = {}
        for i in sequence:
            place[i] = last.get(regions[i], UNDECIDED)
            if labels[i] != UNDECIDED:
                last[regions[i]] = labels[i]
    has_article = any(r > 1 for r in regions)
    size = lambda inside: sum(len(blocks[i][0]) for i in range(n) if labels[i] == GOOD and (regions[i] > 1) == inside)
    outside = not has_article or size(False) > size(True)
    out = []
    for i, label in enumerate(labels):
        if label == UNDECIDED:
            near = {before[i], after[i]} - {UNDECIDED}
            mostly_link = blocks[i][1] > LINK_DENSITY * len(blocks[i][0])
            prior = GOOD if (regions[i] == 1) == outside else BAD
            if not near:
                label = BAD if mostly_link and regions[i] == 1 else prior
            elif mostly_link or (regions[i] == 1 and not outside):
                label = GOOD if near == {GOOD} else BAD
            else:
                label = GOOD if GOOD in near else BAD
        elif label == GOOD and regions[i] == 1 and not outside and len(blocks[i][0]) < 2 * LONG_CHARS:
            label = BAD
        out.append(label)
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, in page order, joined by one newline; empty if there is none."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    labels = [first_pass(*block) for block in parser.blocks]
    final = second_pass(labels, [region for _, _, region in parser.blocks], parser.blocks)
    return "\n".join(text for (text, _, _), label in zip(parser.blocks, final) if label == GOOD)


SCHEMA = "page_id long, url string, text string, n_chars long"


def _extract_batches(batches):
    for batch in batches:
        texts = [main_text(html.as_py()) for html in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every row.

    A null or empty html has an empty text; null ids and urls stay null; repeated rows are extracted each on its own;
    columns other than page_id, url and html are not looked at. Whole pages are read. Nothing is shuffled.
    """
    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html"))
    return picked.mapInArrow(_extract_batches, SCHEMA)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
