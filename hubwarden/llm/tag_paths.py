"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf path of block
elements.  Per path the length of its text, its links' share, its marks of
punctuation and its number of blocks are added up; length and punctuation per
block are smoothed over neighbours in page order, fused by multiplication, and
paths whose fused ratio stays below a share of the page's deviation go.  Paths
through an element that can't be content (navigation, buttons, scripts and the
like) have the ratio nought, and so have forms that hold controls rather than
text.  Elements whose class, id or role speaks against them (adverts, notices,
comments) count a quarter: the largest of them comes back only if a quarter of
its text and ratio outweighs the rest of the page.  An article or main element raises the ratios of its paths, the class
of a comment or teaser lowers them; what lies outside must outweigh the raised
ratios.

Pages are independent: one pass, no shuffle; work and memory are linear in the
page.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>?)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")

_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Kinds of HTML elements.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math object select xmp".split())
_NEVER = frozenset("nav header footer aside button dialog menu head fieldset figure-caption".split()) | _RAW
_NAMED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted "
    "related reply replies share sharing sidebar social sponsor sponsored subscribe toolbar topbar widget alert complementary contentinfo search "
    "reactions responses discussion".split()
)
_CONTENT = frozenset("article main".split())
_LESSER = _NAMED | frozenset("card cards excerpt preview teaser teasers".split())  # classes of articles that aren't the page's own
_HEAD = frozenset("head base link meta noscript script style template title".split())  # other tags end the head
_LOOSE = frozenset("svg math object noscript template select".split())  # without an end tag the page goes on after the start tag
_CONTROLS = frozenset("button input select textarea".split())
_HIDDEN = re.compile(r"\btype\s*=\s*[\"']?hidden", re.I)

_RAISE, _LOWER = 4.0, 0.25
_NAMED_TEXT = 1000  # characters that an element with a class word needs to be taken for the article
_FORM_TEXT = 100  # a form with fewer characters a control is one to fill in
_CLOSES = {  # a start tag that ends open elements, up to the barrier
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section summary table ul".split()
)


def _stuff(name: str, attributes: str) -> int:
    """2: an element that can't be content by its kind; 1: one that its class, id or role speaks against; else 0."""
    if name in _NEVER:
        return 2
    if "=" not in attributes or name in ("html", "body", "article", "main"):
        return 0
    return int(not _class_words(attributes).isdisjoint(_NAMED))


def _class_words(attributes: str) -> set[str]:
    return {w for m in _NAMES.finditer(attributes) for w in re.split(r"[\s_-]+", (m[1] or m[2] or m[3] or "").lower())}


class Page:
    """Blocks of a page in order: path, text, link characters, region, weight by articles, form.

    The region is 0, the number of the outermost element whose class, id or role
    speaks against it, or -1 within an element that can't be content.

    A path is the number of its node in the tree of tag names met so far; the
    articles of comments and teasers have nodes of their own.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[int, str, int, int, float, int]] = []
        self.headings: set[int] = set()  # paths that end in a heading
        self.forms: list[list[int]] = []  # (form around it, characters, controls)
        self._nodes: dict[tuple[int, str, float, int], int] = {}
        self._open: list[tuple[str, int, int, float, int]] = []  # elements: (name, path, within stuff, weight, form)
        self._count: Counter[str] = Counter()  # of open elements by name
        self._regions = 0  # outermost elements with a class word
        self._parts: list[str] = []
        self._links, self._in_link = 0, 0
        at, n = 0, len(source)
        unclosed: set[str] = set()
        for m in iter(lambda: _TAG.search(source, at), None):
            self._text(source[at : m.start()])
            at = m.end()
            if name := (m[2] or "").lower():
                if m[1]:
                    self._end(name)
                else:
                    self._start(name, m[3])
                    if name in _RAW and not m[3].endswith("/>"):
                        close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                        if close:
                            at = close.end()
                        elif name in _LOOSE:
                            unclosed.add(name)
                        else:
                            at = n
                        self._end(name)
            if at >= n:
                break
        self._text(source[at:])
        self._flush()

    def _text(self, text: str) -> None:
        if text:
            if self._open and self._open[-1][0] == "head" and not text.isspace():
                self._cut(len(self._open) - 1)
            self._parts.append(text)
            if self._in_link:
                self._links += len(text.strip())

    def _push(self, name: str, stuff: int, attributes: str = "") -> None:
        _, path, within, weight, form = self._open[-1] if self._open else ("", -1, 0, 1.0, -1)
        if stuff == 2:
            within = -1
        elif stuff and not within:
            self._regions += 1
            within = self._regions
        if name in _CONTENT and weight >= 1:
            weight = _LOWER if name == "article" and "=" in attributes and not _class_words(attributes).isdisjoint(_LESSER) else _RAISE
        if name == "form":
            self.forms.append([form, 0, 0])
            form = len(self.forms) - 1
        own = self._nodes.setdefault((path, name, weight, within), len(self._nodes))
        if name in _HEADINGS:
            self.headings.add(own)
        self._open.append((name, own, within, weight, form))
        self._count[name] += 1

    def _cut(self, i: int) -> None:
        for name, *_ in self._open[i:]:
            self._count[name] -= 1
        del self._open[i:]

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self._parts)).split()) if self._parts else ""
        if text:
            _, path, stuff, weight, form = self._open[-1] if self._open else ("", -1, 0, 1.0, -1)
            self.blocks.append((path, text, self._links, stuff, weight, form))
            if form >= 0 and not stuff:
                self.forms[form][1] += max(0, len(text) - self._links)
        self._parts, self._links = [], 0

    def _start(self, name: str, attributes: str) -> None:
        if self._count["head"] and name not in _HEAD:
            self._end("head")
        if name in _CONTROLS and self._open and self._open[-1][4] >= 0 and not _HIDDEN.search(attributes):
            self.forms[self._open[-1][4]][2] += 1
        if name == "br" or name in ("img", "wbr", "input"):
            self._parts.append(" " if name != "wbr" else "")
            return
        if name in _INLINE:
            self._in_link += name == "a"
            if stuff := _stuff(name, attributes):
                self._flush()
                self._push(name, stuff)
            return
        self._flush()
        if name in _ENDS_P:
            self._close({"p"}, {"button", "td", "th", "table", "div", "section", "article", "li", "blockquote"})
        if name in _CLOSES:
            self._close(*_CLOSES[name])
        self._in_link = 0
        if name not in _VOID and not attributes.endswith("/>"):
            self._push(name, _stuff(name, attributes), attributes)

    def _close(self, names: set[str], barrier: set[str]) -> None:
        if not any(self._count[x] for x in names):
            return
        for i in range(len(self._open) - 1, -1, -1):
            own = self._open[i][0]
            if own in names:
                self._cut(i)
                return
            if own in barrier:
                return

    def _end(self, name: str) -> None:
        if name in _INLINE:
            self._in_link = max(0, self._in_link - (name == "a"))
            if self._open and self._open[-1][0] == name:
                self._flush()
                self._cut(len(self._open) - 1)
            return
        self._flush()
        if self._count[name]:
            i = len(self._open) - 1
            while self._open[i][0] != name:
                i -= 1
            self._cut(i)

    def content(self, share: float = 0.5, spread: float = 1.0) -> list[str]:
        """Texts of the blocks whose path's fused ratio reaches ``share`` of the deviation."""
        forms = [list(f) for f in self.forms]
        for around, chars, controls in reversed(forms):  # a form's own counts are whole when its turn comes: those in it come later
            if around >= 0:
                forms[around][1] += chars
                forms[around][2] += controls
        filled: list[bool] = []  # forms to fill in
        for around, chars, controls in forms:
            filled.append(around >= 0 and filled[around] or chars < _FORM_TEXT * max(1, controls))
        free = [i for i, b in enumerate(self.blocks) if b[5] < 0 or not filled[b[5]]]
        able = [i for i in free if not self.blocks[i][3]]
        kept, best = self._chosen(able, share, spread)
        # below a class word: a quarter of ratio and text, which have to outweigh all that has none
        size: Counter[int] = Counter()
        for i in free:
            _, text, links, region, *_ = self.blocks[i]
            size[region] += max(0, len(text) - links)
        region = max((r for r in size if r > 0), key=lambda r: (size[r], -r), default=0)
        if region and size[region] >= _NAMED_TEXT and _LOWER * size[region] > sum(len(self.blocks[i][1]) for i in kept):
            again, ratio = self._chosen([i for i in free if self.blocks[i][3] == region], share, spread, _LOWER)
            if max(ratio.values(), default=0.0) > max(best.values(), default=0.0):
                kept = sorted(kept + again)
        return [self.blocks[i][1] for i in kept]

    def _chosen(self, able: list[int], share: float, spread: float, factor: float = 1.0) -> tuple[list[int], dict[int, float]]:
        """Places of the blocks to keep among ``able``, and the ratio of each path."""
        if not able:
            return [], {}
        blocks = [self.blocks[i] for i in able]
        sums: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(3))
        for path, text, links, *_ in blocks:
            sums[path] += (max(0, len(text) - links), len(_PUNCTUATION.findall(text)), 1)
        ratios = np.array([sums[b[0]] for b in blocks])
        kernel = np.exp(-0.5 * (np.arange(-2, 3) / spread) ** 2)
        weight = np.convolve(np.ones(len(blocks)), kernel, "same") if len(blocks) >= 5 else None

        def smooth(x: np.ndarray) -> np.ndarray:
            return np.convolve(x, kernel, "same") / weight if weight is not None else x

        own = [max(0, len(t) - k) for _, t, k, *_ in blocks]
        fused = factor * smooth(ratios[:, 0] / ratios[:, 2]) * (1 + smooth(ratios[:, 1] / ratios[:, 2]))
        least = share * float(np.std(fused))
        best: dict[int, float] = defaultdict(float)
        under = 0.0
        for b, f in zip(reversed(blocks), reversed((fused * [b[4] for b in blocks]).tolist())):
            under = max(f, under) if b[0] in self.headings else f  # a heading counts like the text below it
            best[b[0]] = max(best[b[0]], under)
        raised = max((best[b[0]] for b in blocks if b[4] > 1), default=0.0)
        # a path of links alone has no text of its own
        kept = [
            i
            for i, b, o in zip(able, blocks, own)
            if best[b[0]] > (least if b[4] > 1 else max(least, raised)) and sums[b[0]][0] > 0 and (o or b[4] > 1)
        ]
        return kept, best


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text, n_chars) per page.

    References are decoded, white space within a block is one space, blocks are
    joined by one line end.  A null or empty page, or one without content, has
    the empty text; repeated rows are extracted each.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(Page(h.as_py() or "").content()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [key, url, "text"])

    found = pages.select(key, url, source).mapInArrow(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
