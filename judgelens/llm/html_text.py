"""Main text of HTML pages from flat text blocks and a trained decision tree.

A page is cut into text blocks at block-level tags. A block knows its number of
words, the share of them inside links, the same of its neighbours, and what its
enclosing tags and their names say, if they say anything. A decision tree, grown
here on the blocks of labelled pages with and without such tags and names
(``html_training``), tells main text from the rest. Scripts, styles, markup, comments of the source and form controls are
never text.

Defined results: a null or empty page, or one without main text, gives an empty
text; broken markup is read as far as it goes (an unclosed tag at the end of the
page is dropped, an unknown closing tag ignored, a head without its closing tag
ends at the first tag or text that cannot be in one); every page is read whole, in
one pass; repeated rows are read each for itself; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from judgelens.llm.common import as_texts, field_type, map_batches, pick

BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style noscript template textarea select button iframe svg math object canvas audio video head title".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript xmp".split())  # their content holds no tags
HEAD_CONTENT = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())  # any other tag ends an open head
CHROME_TAGS = frozenset("nav header footer aside form menu dialog fieldset address".split())
MAIN_TAGS = frozenset("article main".split())
# A new one of these closes an open one of the same group.
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CHROME_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|side-?bar|rail|footer|foot|header|masthead|topbar|toolbar|cookie\w*|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search\w*|share\w*|sharing|social\w*|related|recommended|recirc\w*|teaser|widget\w*|comment\w*|disqus\w*|repl(?:y|ies)|respond|discussion|tags?|pagination|pager|copyright|legal|disclaimer|skip)(?:$|[\s_-])",
    re.I,
)
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|content|post|entry|story|main|body-?text|text|prose)(?:$|[\s_-])", re.I)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")
RAW_END = {tag: re.compile("</" + tag, re.I) for tag in RAW_TAGS}
QUOTE = re.compile(r"=\s*([\"'])")
# A closing tag of another kind does not reach out of these.
CONTAINERS = frozenset("html body div section article main table form".split()) | CHROME_TAGS
FEATURES = ("words", "link_share", "previous_words", "previous_link_share", "next_words", "next_link_share", "own_main", "outside_main", "in_chrome", "heading", "list_item")


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    in_main: bool
    in_chrome: bool
    heading: bool
    list_item: bool
    features: list[float] = field(default_factory=list)


class BlockReader:
    """Cuts a page into text blocks in one pass over its characters."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.open: list[tuple[str, bool, bool]] = []  # tag, marks main, marks chrome
        self.depth = {"main": 0, "chrome": 0, "silent": 0, "a": 0, "heading": 0, "li": 0}
        self.count: Counter[str] = Counter()  # open tags by name
        self.parts: list[str] = []
        self.link_words = 0
        self.last_quote: dict[str, int] = {}  # where the last quote of a kind stands in the page

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.blocks.append(Block(text, text.count(" ") + 1, self.link_words, self.depth["main"] > 0, self.depth["chrome"] > 0, self.depth["heading"] > 0, self.depth["li"] > 0))
        self.parts, self.link_words = [], 0

    def _leave_head(self) -> None:
        while self.count["head"]:
            self._count(self.open.pop(), -1)

    def text(self, raw: str) -> None:
        if self.count["head"] and self.open[-1][0] == "head" and raw.strip():
            self._leave_head()
        if raw and not self.depth["silent"]:
            raw = html.unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            if self.depth["a"]:
                self.link_words += len(raw.split())

    def _count(self, entry: tuple[str, bool, bool], by: int) -> None:
        tag, main, chrome = entry
        depth = self.depth
        self.count[tag] += by
        depth["main"] += by * main
        depth["chrome"] += by * chrome
        depth["silent"] += by * (tag in SILENT_TAGS)
        depth["a"] += by * (tag == "a")
        depth["li"] += by * (tag == "li")
        depth["heading"] += by * (len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())

    def start(self, tag: str, attributes: str) -> None:
        if self.count["head"] and tag not in HEAD_CONTENT and not self.count["template"]:
            self._leave_head()
        if tag in BLOCK_TAGS:
            self.flush()
        if tag in VOID_TAGS:
            if tag == "br":
                self.parts.append(" ")
            return
        closes = CLOSED_BY.get(tag)
        if closes and self.open and self.open[-1][0] in closes:
            self._count(self.open.pop(), -1)
        main, chrome = tag in MAIN_TAGS, tag in CHROME_TAGS
        if attributes and tag not in ("a", "html", "body"):
            for name, *values in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), "".join(values)
                if name in ("class", "id"):
                    # A container that is named as both is an article wrapped in page furniture names.
                    if MAIN_NAMES.search(value) and not CHROME_NAMES.search(value):
                        main = True
                    elif CHROME_NAMES.search(value) and tag not in MAIN_TAGS:
                        chrome = True
                elif name == "role":
                    chrome |= value.lower() in CHROME_ROLES
                    main |= value.lower() in ("main", "article")
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                    chrome = True
        # A heading group inside an article belongs to it; elsewhere it is page furniture.
        if tag == "header" and self.depth["main"] and not self.depth["chrome"]:
            chrome = False
        self.open.append((tag, main, chrome))
        self._count(self.open[-1], 1)

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        if not self.count[tag]:
            return  # a closing tag without an opening one
        # What was left open inside ends too, but paragraphs and inline tags do not end a container.
        k = len(self.open) - 1
        while self.open[k][0] != tag:
            if tag not in CONTAINERS and (self.open[k][0] in CONTAINERS or tag not in BLOCK_TAGS and self.open[k][0] in BLOCK_TAGS):
                return
            k -= 1
        while len(self.open) > k:
            self._count(self.open.pop(), -1)

    def read(self, page: str) -> list[Block]:
        at, size = 0, len(page)
        while at < size:
            opens = page.find("<", at)
            if opens < 0:
                self.text(page[at:])
                break
            after = page[opens + 1 : opens + 2]
            if not (after.isalpha() or after in ("/", "!", "?")) or not after:
                self.text(page[at : opens + 1])
                at = opens + 1
                continue
            self.text(page[at:opens])
            if page.startswith("<!--", opens):
                close = page.find("-->", opens + 4)
                at = size if close < 0 else close + 3
                continue
            close = self._tag_end(page, opens)
            if close < 0:
                break
            at = close + 1
            if after in "!?":
                continue
            inside = page[opens + 1 : close]
            if after == "/":
                name = inside[1:].split(None, 1)
                if name:
                    self.end(name[0].lower())
                continue
            pieces = inside.rstrip("/").split(None, 1)
            tag = pieces[0].lower()
            self.start(tag, pieces[1] if len(pieces) > 1 else "")
            if tag in RAW_TAGS:
                finish = RAW_END[tag].search(page, at)
                stop = finish.start() if finish else size
                self.text(page[at:stop])
                at = stop
        self.flush()
        return self.blocks

    def _tag_end(self, page: str, at: int) -> int:
        """Position of the > that ends a tag; one inside quotes does not, unless the quote never closes."""
        close = page.find(">", at)
        while close >= 0:
            opening = QUOTE.search(page, at, close)
            if opening is None:
                return close
            quote, at = opening.group(1), opening.end()
            if quote not in self.last_quote:
                self.last_quote[quote] = page.rfind(quote)
            if self.last_quote[quote] < at:  # no such quote: the tag ends here
                return close
            at = page.find(quote, at) + 1
            if at > close:
                close = page.find(">", at)
        return -1


def blocks_of(page: str) -> list[Block]:
    """Text blocks with their features; neighbours beyond the ends count as empty."""
    blocks = BlockReader().read(page)
    has_main = any(b.in_main for b in blocks)
    shares = [b.link_words / b.words for b in blocks]
    for k, b in enumerate(blocks):
        last, following = (blocks[k - 1], shares[k - 1]) if k else (None, 0.0), (blocks[k + 1], shares[k + 1]) if k + 1 < len(blocks) else (None, 0.0)
        b.features = [
            b.words,
            shares[k],
            last[0].words if last[0] else 0,
            last[1],
            following[0].words if following[0] else 0,
            following[1],
            b.in_main and not b.in_chrome,
            has_main and not b.in_main,
            b.in_chrome,
            b.heading,
            b.list_item,
        ]
    return blocks


@dataclass
class Node:
    share: float
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(rows: list[list[float]], labels: list[bool], depth: int = 8, least: int = 3) -> Node:
    """A binary decision tree by Gini impurity; ties go to the earlier feature and lower limit."""
    share = sum(labels) / len(labels)
    node = Node(share)
    if depth == 0 or share in (0.0, 1.0) or len(rows) < 2 * least:
        return node
    best = None
    for f in range(len(rows[0])):
        order = sorted(range(len(rows)), key=lambda k: rows[k][f])
        left = 0
        for n, k in enumerate(order[:-1], 1):
            left += labels[k]
            here, there = rows[k][f], rows[order[n]][f]
            if here == there or n < least or len(order) - n < least:
                continue
            right, m = sum(labels) - left, len(order) - n
            impurity = left * (n - left) / n + right * (m - right) / m
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, (here + there) / 2)
    if best is None or best[0] >= share * (1 - share) * len(rows) - 1e-12:
        return node
    _, node.feature, node.limit = best
    for side, name in ((True, "low"), (False, "high")):
        at = [k for k in range(len(rows)) if (rows[k][node.feature] <= node.limit) is side]
        setattr(node, name, grow([rows[k] for k in at], [labels[k] for k in at], depth - 1, least))
    return node


def predict(tree: Node, features: list[float]) -> float:
    while tree.feature >= 0:
        tree = tree.low if features[tree.feature] <= tree.limit else tree.high
    return tree.share


def train(pages: list[tuple[str, str]] | None = None) -> Node:
    """Grow the tree on pages whose main text blocks start with ``html_training.MARK``."""
    from judgelens.llm.html_training import MARK, PAGES, PLAIN_PAGES

    rows, labels = [], []
    for page in pages or PAGES + PLAIN_PAGES:
        for block in blocks_of(page):
            labels.append(block.text.startswith(MARK))
            rows.append(block.features)
    return grow(rows, labels)


_TREE: list[Node] = []


def tree() -> Node:
    """The trained tree, grown once per process."""
    if not _TREE:
        _TREE.append(train())
    return _TREE[0]


def main_blocks(page: str) -> list[str]:
    return [b.text for b in blocks_of(page) if predict(tree(), b.features) >= 0.5]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: ``page_id, url, text, n_chars, n_blocks, n_main_blocks``."""

    def extract(batch: pa.RecordBatch) -> pa.Table:
        texts, all_blocks, kept_blocks = [], [], []
        for page in as_texts(batch.column("html")):
            blocks = blocks_of(page)
            kept = [b.text for b in blocks if predict(tree(), b.features) >= 0.5]
            texts.append(" ".join(kept))
            all_blocks.append(len(blocks))
            kept_blocks.append(len(kept))
        return pa.table(
            {
                "page_id": batch.column("page_id"),
                "url": batch.column("url"),
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "n_blocks": pa.array(all_blocks, pa.int64()),
                "n_main_blocks": pa.array(kept_blocks, pa.int64()),
            }
        )

    fields = [T.StructField("page_id", field_type(pages, id_col)), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())]
    fields += [T.StructField(n, T.LongType()) for n in ("n_chars", "n_blocks", "n_main_blocks")]
    return map_batches(pick(pages, page_id=id_col, url=url_col, html=html_col), extract, T.StructType(fields))
