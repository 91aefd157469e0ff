"""HTML main-text extraction by tag-path ratios.

A page becomes blocks of text, each under its root-to-leaf tag path (tags with their classes).  Text
length, punctuation, link text and number of blocks are added up per path; the ratios are fused,
smoothed over the paths of one container (the whole article or main, else lists and tables with what
stands around them), and paths under the threshold are dropped with their blocks.  Containers named
like a page's other parts (sidebar, comments, ...) and forms weigh less, but where they hold the
article their names are overruled.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.common import slices

#: Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math select button object canvas audio video".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Containers that are not the article, by tag and by role; and words of class and id that speak against one.
ASIDE = set("nav aside footer head dialog menu".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar".split())
WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe signup paywall nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination sidebar side aside "
    "widget widgets footer foot masthead topbar toolbar share sharing social related recommended comment comments commentlist disqus reply replies respond "
    "reader discussion login search skip".split()
)
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile("[>\"']")
ATTR = re.compile(r"""(?i)\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
MARKS = ",.;:!?，。！？؟।"
#: Elements that belong to the text around them: their paths are smoothed with it.
PARTS = set("ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote figure hgroup".split())
NONE = -1


class Block(NamedTuple):
    path: int
    text: str
    link_chars: int
    name: int  # the innermost named container, or NONE


class Paths:
    """The page's tag paths as a tree, so that a path costs the same however deep it is.  Path 0 is the root."""

    def __init__(self):
        self.index: dict[tuple[int, str, str], int] = {}
        self.parent, self.tag, self.depth = [NONE], [""], [0]
        self.article, self.last_article = [NONE], [0]  # outermost article or main; depth of the innermost

    def child(self, parent: int, tag: str, sign: str = "") -> int:
        key = parent, tag, sign
        if key not in self.index:
            new = self.index[key] = len(self.parent)
            is_article = tag in ("article", "main")
            self.parent.append(parent)
            self.tag.append(tag)
            self.depth.append(self.depth[parent] + 1)
            self.article.append(self.article[parent] if self.article[parent] != NONE or not is_article else new)
            self.last_article.append(self.depth[new] if is_article else self.last_article[parent])
        return self.index[key]

    def around(self, path: int) -> int:
        """The container whose paths a path outside of any article is smoothed with."""
        leaf, around = self.tag[path], max(0, self.parent[path])
        while leaf != "a" and self.tag[around] in PARTS:
            around = self.parent[around]
        return around


class Named(NamedTuple):
    parent: int
    whole: bool  # some class or id consists of such words
    depth: int
    within: bool  # it lies in an article or main


#: What a name leaves of a container's weight: all its words are of the list, or only some.
WHOLE_NAME, PART_NAME = 0.02, 0.1
#: Ratio that a container needs against a whole name: that of about 40 characters with a mark.
LEAST_RATIO = 6.0
#: How many times the share a path needs that meets the heaviest container in the body only.
FAR = 2.4


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(text, "", "") and ("", tag, attributes) in page order; a closing tag starts with a slash.

    Elements of RAW are left out whole.  Linear in the page: a mark that was searched for and not found is not searched for again, and
    after one tag whose quotes don't close, quotes no longer count.
    """
    at, n, missing, quotes = 0, len(page), set(), True

    def find(mark: str, start: int) -> int:
        k = -1 if mark in missing else page.find(mark, start)
        if k < 0:
            missing.add(mark)
        return k

    while at < n:
        lt = find("<", at)
        if lt < 0 or find(">", lt) < 0 and not page.startswith("<!--", lt):
            yield page[at:], "", ""
            return
        if lt > at:
            yield page[at:lt], "", ""
        name = NAME.match(page, lt + 1)
        if page.startswith("<!--", lt):
            end = find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
        elif page.startswith("<![CDATA[", lt) and (end := find("]]>", lt + 9)) >= 0:
            at = end + 3
            yield page[lt + 9 : end].replace("&", "&amp;"), "", ""
        elif name:
            end = name.end()
            while quotes:
                stop = STOP.search(page, end)
                if stop is None:
                    quotes = False
                elif stop[0] == ">":
                    end = stop.start()
                    break
                else:
                    end = find(stop[0], stop.end()) + 1
                    quotes = end > 0
            if not quotes:
                end = page.find(">", name.end())
            at, tag, attrs = end + 1, name[2].lower(), page[name.end() : end]
            if name[1] or tag not in RAW:
                yield "", name[1] + tag, attrs
            elif not attrs.endswith("/"):
                close = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
                at = page.find(">", close.end()) + 1 or n if close else n
        elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
            at = page.find(">", lt) + 1
        else:
            at = lt + 1
            yield "<", "", ""


def _is_aside(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in ASIDE or (tag == "header" and not in_article):
        return True
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), entities.unescape(value.strip("\"'")).lower()
        if name == "role" and value in ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
    return False


def _classes(attrs: str, names: tuple[str, ...] = ("class", "id")) -> list[str]:
    return [part for name, value in ATTR.findall(attrs) if name.lower() in names for part in entities.unescape(value.strip("\"'")).lower().split()]


def _named(tag: str, attrs: str) -> bool | None:
    """Whether some class or id consists of WORDS (True), only holds one (False), or none does; a form is named."""
    found = True if tag == "form" else None
    if "=" in attrs and tag not in ("html", "body", "article", "main"):
        for part in _classes(attrs):
            words = [w for w in re.split(r"[^a-z]+", part) if w]
            listed = sum(w in WORDS for w in words)
            if listed:
                found = found or listed == len(words)
    return found


def _sign(attrs: str) -> str:
    """What tells paths of equal tags apart: the classes."""
    return " ".join(sorted(_classes(attrs, ("class",)))) if "=" in attrs else ""


class Open(NamedTuple):
    """An open block element."""

    tag: str
    path: int
    aside: bool  # it is or lies in an aside
    name: int  # its named container


def blocks(page: str, lifted: frozenset[int] = frozenset()) -> tuple[list[Block], list[Named], Paths]:
    """Text blocks in page order, without those in asides; the named containers; the paths.

    Names of the containers ``lifted`` don't count.
    """
    out: list[Block] = []
    named: list[Named] = []
    paths = Paths()
    stack = [Open("", 0, False, NONE)]
    opened: Counter[str] = Counter()  # by tag, of the stack
    inline: list[tuple[str, int, bool, int]] = []  # open inline elements that are or lie in such: also the stack's depth
    inlined: Counter[str] = Counter()
    buffer: list[str] = []
    apart: list[str] = []  # text of a named inline element, which is no part of the line around it
    links = apart_links = in_link = 0
    apart_name = NONE

    def here() -> tuple[bool, int]:
        if inline and inline[-1][1] >= len(stack):
            return inline[-1][2:]
        return stack[-1].aside, stack[-1].name

    def flush_apart() -> None:
        nonlocal apart_links
        text = " ".join(entities.unescape("".join(apart)).split())
        if text:
            out.append(Block(stack[-1].path, text, min(apart_links, len(text)), apart_name))
        apart.clear()
        apart_links = 0

    def flush() -> None:
        nonlocal links
        if apart:
            flush_apart()
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                path = stack[-1].path
                out.append(Block(paths.child(path, "a") if links >= 0.8 * len(text) else path, text, min(links, len(text)), stack[-1].name))
            buffer.clear()
        links = 0

    def say(text: str) -> None:
        nonlocal links, apart_links, apart_name
        aside, name = here()
        if aside:
            return
        if name != stack[-1].name:
            if apart and name != apart_name:
                flush_apart()
            apart_name = name
            apart.append(text)
            apart_links += len(text.strip()) if in_link else 0
            return
        buffer.append(text)
        if in_link:
            links += len(text.strip())

    def name_of(tag: str, attrs: str, parent: int) -> int:
        whole = _named(tag, attrs) if tag == "form" or "=" in attrs else None
        if whole is None:
            return parent
        named.append(Named(parent, whole, paths.depth[stack[-1].path], paths.article[stack[-1].path] != NONE))
        return parent if len(named) - 1 in lifted else len(named) - 1

    def cut(depth: int) -> None:
        """Close what is open from a depth on, inline elements too."""
        while len(stack) > depth:
            opened[stack.pop().tag] -= 1
        while inline and inline[-1][1] > len(stack):
            inlined[inline.pop()[0]] -= 1

    for text, tag, attrs in tokens(page):
        if not tag:
            say(text)
            continue
        closing, tag = tag[0] == "/", tag.removeprefix("/")
        if tag == "br" or tag == "hr":
            flush()
        elif tag in BLOCK:
            flush()
            if closing:
                if opened[tag]:
                    depth = len(stack) - 1
                    while stack[depth].tag != tag:
                        depth -= 1
                    cut(depth)
                    in_link = 0
            else:
                if stack[-1].tag == "p":
                    opened[stack.pop().tag] -= 1
                shut, within = CLOSES.get(tag, (set(), set()))
                if any(opened[t] for t in shut):
                    depth = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag in shut or stack[k].tag in within)
                    if stack[depth].tag in shut:
                        while stack[depth - 1].tag in shut:
                            depth -= 1
                        cut(depth)
                if tag == "body":
                    stack[:] = [s for s in stack if s.tag in ("", "html")]
                    opened = Counter(s.tag for s in stack)
                cut(len(stack))
                aside, name = here()
                path = stack[-1].path
                aside = aside or _is_aside(tag, attrs, paths.article[path] != NONE)
                stack.append(Open(tag, paths.child(path, tag, _sign(attrs)), aside, name if aside else name_of(tag, attrs, name)))
                opened[tag] += 1
        elif tag not in VOID:
            if closing:
                if tag == "a":
                    in_link = 0
                if inlined[tag]:
                    at_tag = len(inline) - 1
                    while inline[at_tag][0] != tag:
                        at_tag -= 1
                    if inline[at_tag][1] >= len(stack):
                        while len(inline) > at_tag:
                            inlined[inline.pop()[0]] -= 1
            else:
                if tag == "a":
                    in_link = 1
                elif "=" in attrs or inline:
                    aside, name = here()
                    now = aside or ("=" in attrs and _is_aside(tag, attrs, True))
                    new = name if now else name_of(tag, attrs, name)
                    if (now, new) != (aside, name) or inlined[tag]:
                        inline.append((tag, len(stack), now, new))
                        inlined[tag] += 1
    flush()
    return out, named, paths


def _ratio(found: list[Block]) -> tuple[float, float]:
    """The fused ratio of blocks taken together, and their weight: the ratio times their length."""
    chars = sum(len(b.text) for b in found)
    if not chars:
        return 0.0, 0.0
    marks = sum(sum(map(b.text.count, MARKS)) for b in found)
    ratio = math.log1p(chars / len(found)) * (1 + math.log1p(marks / len(found))) * (1 - sum(b.link_chars for b in found) / chars)
    return ratio, ratio * chars


def overruled_names(found: list[Block], named: list[Named], paths: Paths) -> frozenset[int]:
    """Named containers that hold the article, or a part of it, by their text.

    A name is overruled where the container holds the page's only article or main; where its text,
    weighted down for the name, outweighs all text outside of named containers; and, if it is named
    only in part, inside an article where its ratio is half of what stands around it at least.
    """
    lifted: set[int] = set()
    if all(b.name == NONE for b in found):
        return frozenset()
    while True:
        top: list[int] = []  # of each container the outermost one around it, or itself, whose name counts
        for k, n in enumerate(named):
            above = top[n.parent] if n.parent != NONE else NONE
            top.append(above if above != NONE else NONE if k in lifted else k)
        groups: dict[int, list[Block]] = defaultdict(list)
        for b in found:
            groups[top[b.name] if b.name != NONE else NONE].append(b)
        free = groups.pop(NONE, [])
        article = [b for b in free if paths.article[b.path] != NONE]
        around, outside = _ratio(article)[0], _ratio(free)[1]
        judged = sorted(((*_ratio(g), k) for k, g in groups.items()), key=lambda x: (-x[1], x[2]))
        new = {k for ratio, _, k in judged if article and named[k].within and not named[k].whole and ratio >= 0.5 * around}
        if not article:
            holds = [k for _, _, k in judged if any(paths.last_article[b.path] > named[k].depth for b in groups[k])]
            new |= set(holds[:1])
        if not new:
            heavy = [k for ratio, weight, k in judged if weight * (WHOLE_NAME if named[k].whole else PART_NAME) > outside and (ratio >= LEAST_RATIO or not named[k].whole)]
            new = set(heavy[:1])
        if not new:
            return frozenset(lifted)
        lifted |= new


def choose_paths(found: list[Block], named: list[Named], paths: Paths, share: float) -> set[tuple[int, int]]:
    """Paths (and the named container around each, if any) whose score reaches ``share`` of the page's mean, weighted by text.

    The score is the fused ratio, smoothed over the paths around; within a named container it is
    multiplied by the name's factor, and meets the same threshold.  Named text doesn't count in the mean.
    """
    every = found
    found = [b for b in every if b.name == NONE]
    chars, marks, linked, nodes = (defaultdict(int) for _ in range(4))
    for b in found:
        chars[b.path] += len(b.text)
        marks[b.path] += sum(map(b.text.count, MARKS))
        linked[b.path] += b.link_chars
        nodes[b.path] += 1
    fused, pool = {}, defaultdict(list)
    for p in chars:
        article = paths.article[p]
        plain = 1 - linked[p] / chars[p] if article == NONE else 2.0  # links are text like any other in the article
        fused[p] = math.log1p(chars[p] / nodes[p]) * (1 + math.log1p(marks[p] / nodes[p])) * plain
        pool[article if article != NONE else paths.around(p)].append(p)
    smooth = {}
    for container, members in pool.items():
        total = sum(chars[p] for p in members)
        mean = sum(fused[p] * chars[p] for p in members) / total
        for p in members:
            if paths.article[container] != NONE:
                smooth[p] = mean  # an article stands or falls as a whole
            elif paths.depth[p] <= 2 and paths.tag[p] not in HEADING:
                smooth[p] = fused[p]  # beside the article, not in it
            else:
                smooth[p] = (fused[p] + mean) / 2
    if not chars:
        return set()
    level = sum(smooth[p] * chars[p] for p in smooth) / sum(chars.values())
    heaviest = max(pool, key=lambda c: (sum(smooth[p] * chars[p] for p in pool[c]), -c))
    deep = paths.depth[heaviest] > 2
    line = set()
    while heaviest != NONE:
        line.add(heaviest)
        heaviest = paths.parent[heaviest]
    meets = []  # where a path leaves the line from the root to the heaviest container
    for p, parent in enumerate(paths.parent):
        meets.append(p if p in line else meets[parent])

    def need(path: int) -> float:
        """A path that meets the heaviest container in the body only, and is no heading, needs FAR times the share."""
        far = deep and paths.depth[meets[path]] <= 2 and paths.tag[path] not in HEADING
        return FAR * share if far else share

    keep = {(p, NONE) for p, s in smooth.items() if s >= need(p) * level}
    boxes: dict[tuple[int, int], list[Block]] = defaultdict(list)
    for b in every:
        if b.name != NONE:
            boxes[b.path, b.name].append(b)
    for (path, name), inside in boxes.items():
        if _ratio(inside)[0] * (WHOLE_NAME if named[name].whole else PART_NAME) >= need(path) * level:
            keep.add((path, name))
    return keep


def main_text(page: str | None, share: float = 0.25) -> str:
    """The article's blocks in page order, one a line; empty if there is none."""
    found, named, paths = blocks(page or "")
    lifted = overruled_names(found, named, paths)
    if lifted:
        found, named, paths = blocks(page or "", lifted)
    keep = choose_paths(found, named, paths, share)
    return "\n".join(b.text for b in found if (b.path, b.name) in keep)


def extract_pages(pages: DataFrame, share: float = 0.25, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars (code points).

    Character references are decoded, white space inside a block becomes one space, blocks are
    joined in page order by one line feed.  Null html is empty and gives an empty text, as does a
    page without an article.  Repeated rows, null ids and null urls pass through; an empty table
    gives no rows; other columns are ignored.  A map over partitions: no shuffle.  Very long pages,
    tags that never close and deep nesting take time in proportion to the page.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(h, share) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
