"""Main text of web pages by tag-path ratios.

A page becomes a tree of elements and blocks of text. A path is the sequence of tags from
the root to a block's element. Over the blocks of one path three figures are summed:
characters, punctuation marks, and characters inside links. A path's ratio is its unlinked
characters per block times a logarithm of its punctuation per block. Class, id and role
names lower it: what names a menu, an advert or reader comments lowers it to nothing, vaguer
names (side, legal, tags, discussion) to a quarter. Ratios are smoothed along the page, fused
with the path's own figure, and paths over a threshold (a share of the mean score of the
page's characters) are content. The container is the outermost article or main that holds
more than half of the chosen text, else the deepest element that holds nine tenths of it.
Its chosen blocks are main text, and so are its short ones and headings, but for paths
without any ratio and, outside article and main, menus of links. Where only the body holds the
chosen text, the other blocks stay between the first and the last chosen one, with
the headings right before the first.

A page is read once from start to end; the work grows with its length, however deep it is.
Each page is one row, so pages are worked on in their tasks without a shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*+)>|<[!?/][^>]*>|<[a-zA-Z!?/][^<>]*\Z|[^<]+|<""", re.S)
#: Once a tag did not end: tags up to the next bracket, so that no later one looks through the rest of the page again.
SHORT_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<[!?/][^<>]*>|<[a-zA-Z!?/][^<>]*\Z|[^<]+|<""", re.S)
TAG_OPEN = re.compile(r"<[a-zA-Z/!?]")
#: Fixed values of HTML: elements whose content is no markup, elements without content.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rp rt s samp
small span strike strong sub sup time tt u var wbr img label""".split())
#: Inline elements that go on when an element around them ends.
FORMATTING = frozenset("a b big code em font i s small strike strong tt u".split())
#: Elements that an opening tag of the named kind closes.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
BLOCKS_END_P = frozenset("""address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3
h4 h5 h6 header hr main menu nav ol p pre section table ul""".split())
#: Elements whose own end, not that of an inline element around them, closes them.
CLOSED_ALONE = BLOCKS_END_P | frozenset("li dt dd td th tr tbody thead tfoot caption button center".split())
#: Elements that are never main text.
NEVER = frozenset("""head title script style noscript template nav footer aside form button select option textarea input
iframe object svg canvas audio video menu dialog map datalist noembed noframes xmp""".split())
#: Words of class, id and role that name what is no main text: a path through them has no ratio.
WORDS_OUT = re.compile(r"""(?:^|[\s_-])(?:ads?|advert\w*|adbox|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|
popup|modal|overlay|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|footer\w*|comments?|commentlist|respond|replies|
disqus|social|share|sharing|related|newsletter|subscribe|signup|login|toolbar|masthead|topbar|pagination|pager|
skip|skip-?link|complementary|contentinfo)(?=$|[\s_-]|\d)""", re.I | re.X)
#: Words that content bears as well: a path through them has a quarter of its ratio.
WORDS_LOWER = re.compile(r"""(?:^|[\s_-])(?:side|alert|reply|discussion|recommend\w*|search\w*|widget\w*|tags|copyright|legal|
disclaimer|dialog)(?=$|[\s_-]|\d)""", re.I | re.X)
HEADER_WORD = re.compile(r"(?:^|\s)(?:(?:site|page|global|top|main)[_-]?)?header(?=$|\s)", re.I)
#: Of an article, only these count; layout names such as no-sidebar never do.
ARTICLE_OUT = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|related|teaser|sponsor\w*|ads?|advert\w*|promo\w*)(?=$|[\s_-])", re.I)
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:no|has|with|without)[_-]\S+", re.I)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
MAIN = ("article", "main")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: What vaguer names leave of a ratio.
LOWERED = 0.25
#: Share of the page's mean score that a path must pass, share of the chosen text that a container holds, half width of smoothing.
THRESHOLD, HELD, SMOOTH = 0.3, 0.9, 1
#: A list of so many blocks that are links for the most part is a menu.
MENU, LISTS = 3, ("ul", "ol", "dl", "table")


def _share(name: str, attributes: str, in_main: bool) -> float:
    """What an element's names leave of the ratio of paths through it: 0, a quarter, or all."""
    if name in NEVER or name == "header" and not in_main:
        return 0.0
    if not attributes or name in ("html", "body", "main"):
        return 1.0
    words_out, share = ARTICLE_OUT if name == "article" else WORDS_OUT, 1.0
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id", "role"):
            value = LAYOUT.sub("", value)
            if words_out.search(value):
                return 0.0
            if name not in HEADINGS and HEADER_WORD.search(value):
                share = LOWERED if in_main else 0.0
                if not share:
                    return share
            if name != "article" and WORDS_LOWER.search(value):
                share = LOWERED
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return 0.0
    return share


class Page:
    """Elements in page order, each with its parent, tag and path, and blocks (text, linked characters, element).

    Element and path 0 are the page itself. A path is (path around it, tag, share), so paths
    through names that lower the ratio are paths of their own.
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.path = [0], [""], [0]
        self.path_parent, self.path_tag, self.path_share = [0], [""], [1.0]
        self.blocks: list[tuple[str, int, int]] = []
        self._path_ids: dict[tuple[int, str, float], int] = {}
        self._read(page)

    def path_name(self, path: int) -> str:
        tags = []
        while path:
            tags.append(self.path_tag[path])
            path = self.path_parent[path]
        return "/".join(reversed(tags))

    def _element(self, parent: int, name: str, share: float) -> int:
        around = self.path[parent]
        key = (around, name, share)
        path = self._path_ids.get(key)
        if path is None:
            path = self._path_ids[key] = len(self.path_parent)
            self.path_parent.append(around)
            self.path_tag.append(name)
            self.path_share.append(min(share, self.path_share[around]))
        self.parent.append(parent)
        self.tag.append(name)
        self.path.append(path)
        return len(self.parent) - 1

    def _read(self, page: str) -> None:
        stack = [0]  # open elements
        open_tags: Counter[str] = Counter()
        inline: list[tuple[str, int, bool]] = []  # open inline elements: (name, depth of the stack, unwanted); text in an unwanted one is left out
        open_inline: Counter[str] = Counter()
        piece: list[str] = []
        linked = links = at = mute = 0
        token = TOKEN

        def close_block():
            nonlocal linked
            if piece:
                text = " ".join(html.unescape("".join(piece)).split())
                if text:
                    self.blocks.append((text, linked, stack[-1]))
                piece.clear()
            linked = 0

        def pop():
            nonlocal mute
            open_tags[self.tag[stack.pop()]] -= 1
            while inline and inline[-1][1] > len(stack):
                gone = inline.pop()
                open_inline[gone[0]] -= 1
                mute -= gone[2]

        def end_inline(name):
            """Close the last open inline element of the name; formatting opened in it goes on."""
            nonlocal mute
            if not open_inline[name]:
                return
            k = max(i for i in range(len(inline)) if inline[i][0] == name) if inline[-1][0] != name else len(inline) - 1
            _, depth, unwanted = inline[k]
            if unwanted and len(stack) > depth and not any(self.tag[e] in CLOSED_ALONE for e in stack[depth:]):
                close_block()
                while len(stack) > depth:
                    pop()
            for x in inline[k:]:
                open_inline[x[0]] -= 1
                mute -= x[2]
            inline[k:] = [x for x in inline[k + 1:] if x[0] in FORMATTING]
            for x in inline[k:]:
                open_inline[x[0]] += 1
                mute += x[2]

        size = len(page)
        while at < size:
            m = token.match(page, at)
            at = m.end()
            name = m[2]
            if name is None:
                if m[0] == "<" and token is TOKEN and TAG_OPEN.match(page, at - 1):
                    token = SHORT_TOKEN  # a tag that does not end
                    at -= 1
                elif (m[0][0] != "<" or m[0] == "<") and not mute:
                    piece.append(m[0])
                    linked += len(m[0]) if links else 0
                continue
            name = name.lower()
            if m[1]:
                if name == "a":
                    links = 0
                if name in INLINE:
                    end_inline(name)
                elif name == "p" and not open_tags["p"] or name == "br":
                    close_block()
                elif open_tags[name]:
                    close_block()
                    while self.tag[stack[-1]] != name:
                        pop()
                    pop()
                continue
            attributes = m[3] or ""
            if name in RAW:
                if not mute:
                    close_block()
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
                continue
            in_main = any(open_tags[n] for n in MAIN)
            if name in INLINE and name not in VOID:
                if name == "a":  # a link ends the one before it
                    end_inline(name)
                    links = 1
                unwanted = not _share(name, attributes, in_main)
                inline.append((name, len(stack), unwanted))
                open_inline[name] += 1
                mute += unwanted
                continue
            if name in VOID:
                if name not in ("img", "input", "wbr") and not mute:
                    close_block()
                continue
            close_block()
            links = 0
            if name in BLOCKS_END_P and self.tag[stack[-1]] == "p":
                depth = len(stack)
                carried = [(n, depth - 1, u) for n, d, u in inline if d == depth and n in FORMATTING]
                pop()
                inline.extend(carried)
                open_inline.update(n for n, *_ in carried)
                mute += sum(u for *_, u in carried)
            if name in CLOSES and any(open_tags[n] for n in CLOSES[name]):
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] in CLOSES[name]:
                        while len(stack) > k:
                            pop()
                        break
                    if self.tag[stack[k]] in ("ul", "ol", "dl", "table", "select", "div", "article"):
                        break
            if attributes.rstrip().endswith("/") and name in ("svg", "path"):
                continue
            stack.append(self._element(stack[-1], name, _share(name, attributes, in_main)))
            open_tags[name] += 1
        close_block()


def path_scores(page: Page) -> np.ndarray:
    """Of each block, the smoothed and fused ratio of its tag path; below 0 where its names leave none."""
    paths, place = np.unique([page.path[e] for *_, e in page.blocks], return_inverse=True)
    sums = np.zeros((len(paths), 4))
    for k, (text, linked, _) in zip(place, page.blocks):
        sums[k] += (len(text), len(PUNCTUATION.findall(text)), min(linked, len(text)), 1)
    n, share = sums[:, 3], np.array([page.path_share[p] for p in paths])
    ratio = share * np.maximum(sums[:, 0] - sums[:, 2], 0) / n * np.log2(2 + sums[:, 1] / n)
    padded = np.pad(ratio[place], SMOOTH, mode="edge")
    smooth = np.convolve(padded, np.ones(2 * SMOOTH + 1) / (2 * SMOOTH + 1), "valid")
    # Fused: a path is judged by the mean over its blocks of the smoothed figure and its own.
    fused = np.bincount(place, smooth, len(paths)) / n
    return np.where(share > 0, fused * 0.5 + ratio * 0.5, -1.0)[place]


def _container(page: Page, chosen: np.ndarray) -> int:
    """The outermost article or main with most of the chosen text, else the deepest element that holds HELD of it; 0 for the page."""
    weight, blocks = [0] * len(page.parent), [0] * len(page.parent)
    for (text, linked, e), c in zip(page.blocks, chosen):
        weight[e] += max(len(text) - linked, 0) if c else 0
        blocks[e] += 1
    alone = [b == 1 for b in blocks]  # one block of its own and no element inside
    for e in range(len(weight) - 1, 0, -1):
        weight[page.parent[e]] += weight[e]
        blocks[page.parent[e]] += blocks[e]
    total = weight[0]
    for name in MAIN:
        for e in range(1, len(weight)):
            if page.tag[e] == name and 2 * weight[e] > total:
                return e
    return max((e for e in range(len(weight)) if weight[e] >= HELD * total and not (alone[e] and blocks[e] == 1)), default=0)


def main_text(html_page: str | None) -> str:
    """The main text of a page; '' for null, empty, or pages without text."""
    page = Page(html_page or "")
    if not page.blocks:
        return ""
    scores = path_scores(page)
    live = scores >= 0
    if not live.any():
        return ""
    mean = np.average(np.maximum(scores, 0), weights=[len(b[0]) for b in page.blocks])
    chosen = live & (scores >= THRESHOLD * mean)
    if not chosen.any():
        chosen = live
    root = _container(page, chosen)
    inside = [False] * len(page.parent)
    for e in range(len(inside)):
        inside[e] = e == root or inside[page.parent[e]]
    stay = live & np.array([inside[e] for *_, e in page.blocks])
    if page.tag[root] not in MAIN:
        stay &= chosen | ~_menus(page)
    if page.tag[root] in ("", "html", "body"):
        places = np.flatnonzero(chosen & stay)
        first, last = (places[0], places[-1]) if len(places) else (0, len(stay) - 1)
        while first and stay[first - 1] and page.tag[page.blocks[first - 1][2]] in HEADINGS:
            first -= 1
        stay[:first] = False
        stay[last + 1:] = False
    return " ".join(b[0] for b, s in zip(page.blocks, stay) if s)


def _menus(page: Page) -> np.ndarray:
    """Of each block, whether its list (its parent, outside lists) has several blocks, for the most part links."""
    around = [0] * len(page.parent)  # the innermost list, else 0
    for e in range(1, len(around)):
        around[e] = e if page.tag[e] in LISTS else around[page.parent[e]]
    _, place = np.unique([around[e] or page.parent[e] for *_, e in page.blocks], return_inverse=True)
    chars = np.bincount(place, [len(b[0]) for b in page.blocks])
    linked = np.bincount(place, [min(b[1], len(b[0])) for b in page.blocks])
    return ((2 * linked >= chars) & (np.bincount(place) >= MENU))[place]


def extract_pages(pages: DataFrame, page: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Per row: page, url, text, n_chars (code points). Null html gives '' and 0.

    Rows that repeat are extracted each; other columns are not read.
    """
    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page", "url", "text", "n_chars"])

    kind = pages.schema[page].dataType.simpleString()
    rows = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), F.col(source).alias("html"))
    return rows.mapInArrow(run, f"page {kind}, url string, text string, n_chars bigint").withColumnRenamed("page", page)
