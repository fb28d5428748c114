"""Main text of web pages by tag-path ratios.

The html becomes a sequence of text blocks, each with its root-to-leaf path of block tags. Per
path, the text outside links and its punctuation are summed and divided by the path's number of
blocks; both ratio sequences are smoothed over the page with a Gaussian, in which neighbours of
another path weigh little; their product, averaged over the path's blocks and multiplied by the
path's prior, is the path's score. Scores belong to paths, so a short paragraph shares that of
its long neighbours. Paths above a share of the page's level are content; the level is the mean
score, weighed by text and prior.

Priors: paths below an article or main count more; those of asides, which a class or id names as
menu, sidebar, advert, notice or reader comments, next to nothing. A class or id names an aside
with the first or last word of a token (not no-sidebar), and none that holds the only article or
main, or nearly all scores of the page. What can't be content by its tag or role never enters:
scripts, styles, templates, forms, navigation, asides, footers, page headers, hidden elements.

Content nodes: the innermost element that still holds nearly all text of content paths is the
article. In it stay the blocks of content paths, headings, what stands directly in elements that
hold content, and paragraphs, list items, table cells and other elements made for text unless
they are mostly links; a div or section whose path is below the threshold goes, and so do asides.

Text: character references decoded once, white space within a block one space, ends trimmed,
blocks in page order joined by one "\\n". Nothing else is dropped or cut.

Defined results: null, empty and text-less html give "" and 0, and so does a page with nothing
but asides; broken markup is read to its
end (an unclosed tag is text, an unclosed comment or script runs to the end); nesting of any
depth is read iteratively; repeated rows are read each; other columns are ignored; an empty
table gives no rows. Each page is read alone: memory is a page and its blocks.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import enter, read, ship, spread

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li td th pre dd dt".split())
#: Elements made for text: beside the leaves, what quotes or describes.
TEXTUAL = LEAVES | frozenset("blockquote figcaption caption summary".split())
NEVER = frozenset("head nav footer aside form button select option optgroup input label fieldset dialog menu svg canvas object audio video math map".split())
#: A start tag ends these open elements, unless one of the fences is met first.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar tablist toolbar".split())
#: Words in a class or id that name something beside the article.
ASIDES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr legal login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion promotions rail recommended related replies reply respond share sharing sidebar signup social sponsor sponsored sponsors subscribe subscription teaser toolbar topbar widget widgets".split()
)
#: First words that make a class a state of something else, such as no-sidebar.
STATES = frozenset("no not with without has is".split())
ROOTS = frozenset("html body main article".split())
TRUNKS = BLOCK - TEXTUAL
HARD, SOFT = 1, 2
#: Share of a page's scores from which a class can't hide an element in an article.
ONLY = 0.98
#: Priors of paths below an article or main, and of asides.
IN_ARTICLE, IN_ASIDE = 10.0, 0.001
#: Weight of a neighbour of another path in smoothing.
OTHER_PATH = 0.05

#: Quoted values are bounded here, so that a quote never closed costs no scan of the page; _end_of_tag reads longer ones.
_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^\"'>]|\"[^\"]{0,4096}\"|'[^']{0,4096}')*+)>|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)>|<[!?/][^>]*>",
    re.S,
)
_RAW_ENDS = {name: re.compile(rf"</{name}(?![A-Za-z0-9])[^>]*(?:>|\Z)", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MARKS = frozenset("class id role hidden aria-hidden style".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？\"'()«»„“”]")


class Block:
    """element: number of the innermost open element; path: number of the tag path; linked: share of the text in links."""

    __slots__ = ("element", "linked", "path", "tag", "text")

    def __init__(self, text: str, element: int, path: int, tag: str, linked: float):
        self.text, self.element, self.path, self.tag, self.linked = text, element, path, tag, linked


_STOP = re.compile("[\"'>]")


def _end_of_tag(page: str, at: int, dead: set[int]) -> int:
    """Where the ">" stands that ends a tag, its quoted values of any length; -1: a quote isn't closed, or there is none.

    dead: places outside quotes from which there is none; kept for the page, so that all calls are linear together."""
    seen = []
    while at not in dead and (m := _STOP.search(page, at)):
        if m[0] == ">":
            return m.start()
        seen.append(m.start())
        if m.start() in dead:
            break
        close = page.find(m[0], m.end())
        if close < 0:
            break
        at = close + 1
        seen.append(at)
    dead.update(seen)
    return -1


def _names_aside(value: str, whole: bool) -> bool:
    """A token of a class or id names an aside at either end (whole: in all its words)."""
    for token in value.split():
        words = [w.lower() for w in _WORD.findall(token) if not w.isdigit()]
        if words and words[0] not in STATES and (all(w in ASIDES for w in words) if whole else words[0] in ASIDES or words[-1] in ASIDES):
            return True
    return False


def _aside(name: str, rest: str, in_article: bool) -> int:
    """The element stands beside the article: HARD by its tag, role, or because it is hidden; SOFT by its class or id."""
    if name in NEVER or name == "header" and not in_article:
        return HARD
    if not rest or "=" not in rest and "hidden" not in rest.lower():
        return 0
    soft = 0
    for attribute, a, b, c in _ATTRIBUTE.findall(rest):
        attribute, value = attribute.lower(), a or b or c
        if attribute not in _MARKS:
            continue
        if attribute == "hidden" or attribute == "aria-hidden" and value.lower() == "true" or attribute == "style" and _HIDDEN.search(value):
            if name not in ("html", "body"):
                return HARD
        if attribute == "role" and value.lower() in ROLES:
            return HARD
        if attribute in ("class", "id") and name not in ROOTS - {"article"}:
            header = not in_article and name not in HEADINGS and any(w and w[-1].lower() == "header" for w in map(_WORD.findall, value.split()))
            if _names_aside(value, name == "article") and not (name in HEADINGS and in_article) or header and name != "article":
                soft = SOFT
    return soft


def blocks(page: str) -> tuple[list[Block], list[str], list[int], dict[int, bool]]:
    """The page's text blocks outside hard asides; the tags and the parents of its elements by number; block elements that are soft asides, and whether in an article."""
    tags, parents, names, numbers = ["#root"], [0], ["#root"], [0]  # all elements; the open ones; their numbers
    paths, path_numbers, block_tags = [0], {}, ["#root"]  # of the elements: number of the path of block tags, innermost block
    opened = Counter()
    hidden_from = article_from = 0  # depth of the element that hides what is below / is the article
    out: list[Block] = []
    soft: dict[int, bool] = {}
    parts: list[str] = []
    linked = total = 0
    links = 0

    def flush() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                n = numbers[-1]
                out.append(Block(text, n, paths[n], block_tags[n], linked / max(total, 1)))
            parts.clear()
        linked = total = 0

    def close_to(depth: int) -> None:
        nonlocal hidden_from, article_from, links
        while len(names) > depth:
            gone = names.pop()
            numbers.pop()
            opened[gone] -= 1
            if gone == "a" and links:
                links -= 1
        if hidden_from >= depth:
            hidden_from = 0
        if article_from >= depth:
            article_from = 0

    at, end_of_page, last_tag = 0, len(page), page.rfind(">") + 1
    dead: set[int] = set()
    while at < end_of_page:
        m = _TOKEN.search(page, at) if at < last_tag or page.find("<!--", at) >= 0 else None
        text = page[at : m.start()] if m else page[at:]
        if text and not hidden_from:
            parts.append(text)
            n = len(text.strip())
            total += n
            linked += n if links else 0
        if not m:
            break
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, rest = name.lower(), m["rest"] if m["name"] else m["rest2"]
        if m["name2"] and (end := _end_of_tag(page, m.start("rest2"), dead)) >= 0:  # a value longer than the pattern's
            rest, at = page[m.start("rest2") : end], end + 1
        if m["end"] or m["end2"]:
            if name in BLOCK:
                flush()
            for depth in range(len(names) - 1, 0, -1) if opened[name] else ():
                if names[depth] == name:
                    close_to(depth)
                    break
                if name not in BLOCK and names[depth] in BLOCK:
                    break
            continue
        if name in RAW:
            close = _RAW_ENDS[name].search(page, at)
            if not close:
                break
            at = close.end()
            continue
        if name in BLOCK:
            flush()
            if name not in ("option", "optgroup"):
                for depth in range(len(names) - 1, 0, -1) if opened["p"] else ():  # a block start ends an open paragraph
                    if names[depth] == "p":
                        close_to(depth)
                        break
                    if names[depth] in BLOCK:
                        break
            if name in CLOSES:
                ends, fences = CLOSES[name]
                for depth in range(len(names) - 1, 0, -1):
                    if names[depth] in fences:
                        break
                    if names[depth] in ends:
                        close_to(depth)
                        break
        if name == "br" and not hidden_from:
            parts.append(" ")
        if name in VOID:
            continue
        if rest.endswith("/") and name in ("svg", "path", "use", "circle", "rect", "line", "polygon", "g"):
            continue
        parent = numbers[-1]
        names.append(name)
        opened[name] += 1
        numbers.append(len(tags))
        tags.append(name)
        parents.append(parent)
        if name in BLOCK:
            paths.append(path_numbers.setdefault((paths[parent], name), len(path_numbers) + 1))
            block_tags.append(name)
        else:
            paths.append(paths[parent])
            block_tags.append(block_tags[parent])
        if not hidden_from and (aside := _aside(name, rest, bool(article_from))):
            if aside == SOFT and name in BLOCK:
                soft[numbers[-1]] = bool(article_from)
            else:
                hidden_from = len(names) - 1
        if name in ("article", "main") and not article_from:
            article_from = len(names) - 1
        links += name == "a"
    flush()
    return out, tags, parents, soft


def _asides(found: list[Block], tags: list[str], parents: list[int], soft: dict[int, bool], hold: float) -> list[bool]:
    """By element: it stands in a soft aside; not in one that holds the only article or main, or what the page is about."""
    scored = [0.0] * len(tags)
    holds = [tag in ("article", "main") and n not in soft for n, tag in enumerate(tags)]
    for b, f in zip(found, scores(found, [1.0] * len(found)), strict=True):
        scored[b.element] += f
    for n in range(len(tags) - 1, 0, -1):
        scored[parents[n]] += scored[n]
        holds[parents[n]] |= holds[n]
    gone = [False] * len(tags)
    for n in range(1, len(tags)):
        gone[n] = gone[parents[n]] or n in soft and not holds[n] and (holds[0] and not soft[n] or scored[n] < (ONLY if soft[n] else hold) * scored[0] or not scored[n])
    return gone


def _smooth(x: list[float], path: list, sigma: float = 1.0) -> list[float]:
    reach = 2
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(x)):
        weight = value = 0.0
        for j in range(max(0, i - reach), min(len(x), i + reach + 1)):
            w = kernel[j - i + reach] * (1.0 if path[i] == path[j] else OTHER_PATH)
            weight += w
            value += w * x[j]
        out.append(value / weight)
    return out


def scores(found: list[Block], prior: list[float]) -> list[float]:
    """The score of each block's path: smoothed ratios, fused, times the prior, by which paths are also told apart."""
    path = [(b.path, p) for b, p in zip(found, prior, strict=True)]
    sums: dict[tuple[int, float], list[float]] = {}
    for b, k in zip(found, path, strict=True):
        s = sums.setdefault(k, [0, 0, 0, 0.0])
        s[0] += 1
        s[1] += len(b.text) * (1 - b.linked)
        s[2] += len(_PUNCTUATION.findall(b.text)) * (1 - b.linked)
    length = _smooth([sums[k][1] / sums[k][0] for k in path], path)
    marks = _smooth([sums[k][2] / sums[k][0] for k in path], path)
    for k, a, m in zip(path, length, marks, strict=True):
        sums[k][3] += a * (1 + m)
    return [sums[k][3] / sums[k][0] * k[1] for k in path]


def extract(page: str | None, share: float = 0.2, hold: float = 0.8) -> str:
    """The main text. share: of the page's level, from which a path is content; hold: of all content, what the article's element must hold."""
    if not page:
        return ""
    found, tags, parents, soft = blocks(page)
    if not found:
        return ""
    gone = _asides(found, tags, parents, soft, hold) if soft else [False] * len(tags)
    if all(gone[b.element] for b in found):
        return ""
    below = [tag in ("article", "main") for tag in tags]
    for n in range(1, len(tags)):  # parents come before their children
        below[n] |= below[parents[n]]
    prior = [IN_ASIDE if gone[b.element] else IN_ARTICLE if below[b.element] else 1.0 for b in found]
    fused = scores(found, prior)
    weight = [(len(b.text) * (1 - b.linked) + 1e-6 * len(b.text)) * p for b, p in zip(found, prior, strict=True)]
    threshold = share * sum(w * f for w, f in zip(weight, fused, strict=True)) / sum(weight)
    content = [f >= threshold for f in fused]
    held, around = [0.0] * len(tags), [False] * len(tags)
    for b, w, c in zip(found, weight, content, strict=True):
        held[b.element] += w if c else 0.0
        around[b.element] |= c and b.tag not in HEADINGS
    for n in range(len(tags) - 1, 0, -1):
        held[parents[n]] += held[n]
        around[parents[n]] |= around[n]
    # down from the root while one child that is no leaf block holds nearly everything
    chosen, children = 0, {}
    for n in range(1, len(tags)):
        if held[n]:
            children.setdefault(parents[n], []).append(n)
    while (best := _largest(children.get(chosen, ()), held, tags, TRUNKS)) and held[best] >= hold * held[chosen]:
        chosen = best
    inside = [False] * len(tags)
    inside[chosen] = True
    for n in range(1, len(tags)):
        inside[n] |= inside[parents[n]]

    def stays(b: Block, is_content: bool) -> bool:
        if not inside[b.element] or gone[b.element] and not is_content:
            return False
        return is_content or b.tag in HEADINGS or b.linked <= 0.5 and (b.tag in TEXTUAL or around[b.element])

    return "\n".join(b.text for b, c in zip(found, content, strict=True) if stays(b, c))


def _largest(numbers, held: list[float], tags: list[str], among) -> int:
    """The element that holds most, the first of equals; 0 if none holds anything."""
    return max((n for n in numbers if held[n] and tags[n] in among), key=lambda n: (held[n], -n), default=0)


def main_text(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of pages (page_id, url, html)."""
    ship(pages.sparkSession)
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("html")
        for b in batches:
            html = b.column(2)
            texts = [extract(html[i].as_py()) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return spread(pages.select("page_id", "url", "html")).mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
