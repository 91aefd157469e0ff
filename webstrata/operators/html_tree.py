"""A page as the tree that a browser would build of it, written again in one canonical form.

Tokens go through the HTML standard's insertion modes: what a page leaves out (html, head, body, tbody)
is implied, what it leaves open is closed, content that has no place in a table goes before it, and
misnested formatting is parted (the adoption agency).  The stack of open elements keeps where each name and each
kind of scope boundary stands, so a question about scope takes constant time and a page linear time.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

#: Fixed values of the HTML standard.
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split())
IMPLIED = set("dd dt li optgroup option p rb rp rt rtc".split())
IN_HEAD = set("base basefont bgsound link meta noframes script style template title".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
CELLS, BODIES = {"td", "th"}, {"tbody", "tfoot", "thead"}
ROWS = {"table", "tr", *BODIES}
TABLE_PARTS = {"caption", "col", "colgroup", "tr", *CELLS, *BODIES}
SPECIAL = BLOCKS | HEADINGS | IN_HEAD | RAW | TABLE_PARTS | VOID - {"keygen"} | set("applet body button dd dt form frameset head html li listing marquee noscript object plaintext pre select table".split()) - {"dialog"}
SCOPE = set("applet caption html marquee object table td template th".split())
WALLS = {"scope": SCOPE, "button": SCOPE | {"button"}, "list": SCOPE | {"ol", "ul"}, "table": {"html", "table", "template"}, "special": SPECIAL, "item": SPECIAL - {"address", "div", "p"}}
MODES = {"select": "select", "td": "cell", "th": "cell", "tr": "row", "tbody": "bodies", "thead": "bodies", "tfoot": "bodies", "caption": "caption", "colgroup": "colgroup", "table": "table", "template": "body", "head": "body", "body": "body", "frameset": "frameset"}
#: Attributes of several values, which are written with one space between them.
SEVERAL = {"*": {"class", "accesskey", "dropzone"}, "a": {"rel", "rev"}, "link": {"rel", "rev"}, "area": {"rel"}, "td": {"headers"}, "th": {"headers"}, "form": {"accept-charset"}, "object": {"archive"}, "icon": {"sizes"}, "iframe": {"sandbox"}, "output": {"for"}}
SPACE = "\t\n\f\r "

_NAME = re.compile(r"[^\t\n\f\r />]+")
_ATTR = re.compile(r"""[\t\n\f\r /]*(?:([^\t\n\f\r />][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\t\n\f\r >]*)))?)?""")
_REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)(=?)")


def _value(text: str) -> str:
    """An attribute's value: a named reference without its semicolon counts only if nothing of a word or = follows."""
    bare = lambda m: m[1][0] != "#" and m[1][-1] != ";" and (m[2] or m[1] not in html5)
    return _REFERENCE.sub(lambda m: m[0] if bare(m) else html.unescape("&" + m[1]) + m[2], text) if "&" in text else text


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str] | bool]]:
    """("start", name, attributes), ("end", name, {}), ("text", data, raw), ("comment", data, {}) and ("doctype", name, {}).

    A tag that the page's end cuts off is dropped; a comment without its end takes the rest.
    """
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        after = page[lt + 1 : lt + 2] if lt >= 0 else ""
        while lt >= 0 and not (after in ("!", "?") or (after.isascii() and after.isalpha()) or (after == "/" and lt + 2 < n)):
            lt = page.find("<", lt + 1)
            after = page[lt + 1 : lt + 2] if lt >= 0 else ""
        text = page[at:lt] if lt >= 0 else page[at:]
        if text:
            yield "text", html.unescape(text), False
        if lt < 0:
            return
        if page.startswith("<!--", lt):
            short = 5 if page.startswith(">", lt + 4) else 6 if page.startswith("->", lt + 4) else 0
            end = lt + 4 if short else page.find("-->", lt + 4)
            yield "comment", page[lt + 4 : end if end >= 0 else n], {}
            at = lt + short if short else end + 3 if end >= 0 else n
        elif after in ("!", "?") or not page[lt + 1 + (after == "/")].isalpha() or not page[lt + 1 + (after == "/")].isascii():
            end = page.find(">", lt + 2)
            end = end if end >= 0 else n
            data = page[lt + 1 + (after != "?") : end]
            if after == "!" and data[:7].lower() == "doctype":
                yield "doctype", data[7:].strip().split(" ")[0].lower(), {}
            elif after != "/" or data:
                yield "comment", data, {}
            at = end + 1
        else:
            name = _NAME.match(page, lt + 1 + (after == "/"))
            kind, tag, at, attrs, closed = "end" if after == "/" else "start", name[0].lower(), name.end(), {}, False
            while at < n and page[at] != ">":
                m = _ATTR.match(page, at)
                at, closed = m.end(), m[1] is None and m[0].endswith("/")
                if m[1]:
                    value = next((g for g in m.groups()[1:] if g is not None), "")
                    attrs.setdefault(m[1].lower(), _value(value))
            if at >= n:
                return
            at += 1
            if closed:
                attrs["/"] = ""
            yield kind, tag, attrs if kind == "start" else {}
            if kind == "start" and tag in RAW:
                end = re.compile(f"</{tag}(?=[\t\n\f\r />])", re.I).search(page, at)
                data = page[at : end.start() if end else n]
                if data:
                    yield "text", html.unescape(data) if tag in ("textarea", "title") else data, True
                at = end.start() if end else n


class Node:
    __slots__ = ("attrs", "before", "children", "holder", "name", "open", "place")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children, self.before, self.holder = name, attrs, [], [], None
        self.open, self.place = False, -1


class TreeBuilder:
    """Open elements, active formatting elements and the insertion mode; ``nodes`` is the document."""

    def __init__(self) -> None:
        self.nodes: list = []
        self.stack: list[Node] = []
        self.at: dict[str, list[int]] = {}
        self.walls: dict[str, list[int]] = {kind: [] for kind in WALLS}
        self.active: list[Node | None] = []
        self.mode, self.templates = "before", []
        self.html = self.head = self.body = self.form = None
        self.foster, self.quirks, self.skip_line = False, True, False

    # --- the stack ---

    def push(self, node: Node) -> None:
        node.open, node.place = True, len(self.stack)
        self.at.setdefault(node.name, []).append(node.place)
        for kind, names in WALLS.items():
            if node.name in names:
                self.walls[kind].append(node.place)
        self.stack.append(node)

    def pop(self) -> Node:
        node = self.stack.pop()
        node.open = False
        self.at[node.name].pop()
        for kind, names in WALLS.items():
            if node.name in names:
                self.walls[kind].pop()
        return node

    def restack(self, start: int, nodes: list[Node]) -> None:
        while len(self.stack) > start:
            self.pop()
        for node in nodes:
            self.push(node)

    def last(self, *names: str) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def in_scope(self, kind: str, *names: str) -> bool:
        place = self.last(*names)
        return place >= 0 and place >= (self.walls[kind][-1] if self.walls[kind] else 0)

    def pop_through(self, *names: str) -> None:
        while self.pop().name not in names:
            pass

    def pop_to(self, *names: str) -> None:
        while self.stack[-1].name not in names and self.stack[-1].name != "html":
            self.pop()

    def imply(self, but: str = "") -> None:
        while self.stack[-1].name in IMPLIED and self.stack[-1].name != but:
            self.pop()

    def close_p(self) -> None:
        if self.in_scope("button", "p"):
            self.imply("p")
            self.pop_through("p")

    # --- insertion ---

    def target(self, node: Node | None = None) -> list:
        """Where the next node goes: into the current one, or before the table that can't hold it."""
        current = node or self.stack[-1]
        if (self.foster or node) and current.name in ROWS and self.at.get("table"):
            return self.stack[self.at["table"][-1]].before
        return current.children

    def insert(self, tag: str, attrs: dict[str, str], into: list | None = None) -> Node:
        closed = "/" in attrs
        node = Node(tag, {k: v for k, v in attrs.items() if k != "/"})
        node.holder = self.target() if into is None else into
        node.holder.append(node)
        if tag not in VOID and not (closed and (self.at.get("svg") or self.at.get("math") or tag in ("svg", "math"))):
            self.push(node)
        return node

    def move(self, node: Node, into: list) -> None:
        if node.holder[-1] is node:
            node.holder.pop()
        else:
            node.holder.pop(next(k for k, x in enumerate(node.holder) if x is node))
        node.holder = into
        into.append(node)

    def merge(self, node: Node | None, attrs: dict[str, str]) -> None:
        if node is not None:
            node.attrs = {k: v for k, v in attrs.items() if k != "/"} | node.attrs

    # --- active formatting ---

    def format(self, node: Node) -> None:
        same = []
        for k in range(len(self.active) - 1, -1, -1):
            if self.active[k] is None or len(same) == 3:
                break
            if self.active[k].name == node.name and self.active[k].attrs == node.attrs:
                same.append(k)
        if len(same) == 3:
            del self.active[same[-1]]
        self.active.append(node)

    def reopen(self) -> None:
        """Formatting that was cut off by what closed around it goes on."""
        k = len(self.active)
        while k > 0 and self.active[k - 1] is not None and not self.active[k - 1].open:
            k -= 1
        for j in range(k, len(self.active)):
            self.active[j] = self.insert(self.active[j].name, dict(self.active[j].attrs))

    def to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def formatting(self, tag: str) -> Node | None:
        for node in reversed(self.active):
            if node is None:
                return None
            if node.name == tag:
                return node
        return None

    def drop(self, node: Node) -> None:
        self.active = [x for x in self.active if x is not node]

    def adopt(self, tag: str) -> None:
        """The adoption agency: part misnested formatting around the block that it reaches into."""
        if self.stack[-1].name == tag and not any(x is self.stack[-1] for x in self.active):
            self.pop()
            return
        for _ in range(8):
            element = self.formatting(tag)
            if element is None:
                self.end_other(tag)
                return
            if not element.open:
                self.drop(element)
                return
            if element.place < self.walls["scope"][-1]:
                return
            furthest = next((x for x in self.stack[element.place + 1 :] if x.name in SPECIAL), None)
            if furthest is None:
                while self.pop() is not element:
                    pass
                self.drop(element)
                return
            start, common = element.place, self.stack[element.place - 1]
            inside, above = self.stack[start + 1 : furthest.place], self.stack[furthest.place + 1 :]
            mark, last, kept = next(k for k, x in enumerate(self.active) if x is element), furthest, []
            for step, node in enumerate(reversed(inside), 1):
                k = next((k for k, x in enumerate(self.active) if x is node), -1)
                if k >= 0 and step > 3:
                    del self.active[k]
                    mark -= k < mark
                    k = -1
                if k < 0:
                    continue
                copy = Node(node.name, dict(node.attrs))
                self.active[k] = copy
                if last is furthest:
                    mark = k + 1
                self.move(last, copy.children)
                kept.append(copy)
                copy.holder = copy_at = []
                copy_at.append(copy)
                last = copy
            self.move(last, self.target(common))
            copy = Node(element.name, dict(element.attrs))
            copy.children, furthest.children = furthest.children, [copy]
            copy.holder = furthest.children
            for child in copy.children:
                if isinstance(child, Node):
                    child.holder = copy.children
            self.active.insert(mark, copy)
            self.drop(element)
            element.open = False
            self.restack(start, [*reversed(kept), furthest, copy, *above])

    # --- tokens by mode ---

    def feed(self, page: str) -> TreeBuilder:
        for kind, value, more in tokens(page):
            if kind == "text":
                value = value.replace("\0", "")
                if self.skip_line and value.startswith("\n"):
                    value = value[1:]
                self.skip_line = False
                self.text(value, bool(more))
                continue
            self.skip_line = False
            if kind == "start":
                self.start("img" if value == "image" else value, more)
            elif kind == "end":
                self.end(value)
            elif kind == "comment":
                into = self.nodes if self.mode == "before" else self.html.children if self.mode in ("after head", "after") else self.target()
                into.append((value,))
            elif self.mode == "before":
                self.quirks = value != "html"
        self.need_body()
        return self

    def need_body(self) -> None:
        if self.mode == "before":
            self.start("html", {})
        if self.head is None:
            self.head = self.insert("head", {})
            self.mode = "head"
        if self.mode == "head":
            self.pop_through("head")
            self.mode = "after head"
        if self.mode == "after head":
            self.body = self.insert("body", {})
            self.mode = "body"

    def text(self, data: str, raw: bool) -> None:
        if raw and self.stack and self.stack[-1].name in RAW:
            self.stack[-1].children.append(data)
            return
        if self.mode in ("before", "head", "after head"):
            rest = data.lstrip(SPACE)
            if self.mode != "before" and self.head is not None and len(rest) < len(data):
                self.stack[-1].children.append(data[: len(data) - len(rest)])
            if not rest:
                return
            self.need_body()
            data = rest
        if self.mode == "frameset":
            data = "".join(c for c in data if c in SPACE)
        blank = not data.strip(SPACE)
        if self.mode == "after" and not blank:
            self.mode = "body"
        if self.mode == "colgroup" and not blank and self.stack[-1].name == "colgroup":
            self.pop()
            self.mode = "table"
        if self.mode in ("table", "bodies", "row") and self.stack[-1].name in ROWS:
            if blank:
                self.stack[-1].children.append(data)
                return
            self.foster = True
        if data and self.mode not in ("select", "frameset", "colgroup"):
            self.reopen()
        if data:
            self.target().append(data)
        self.foster = False

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if self.mode == "before":
            self.html = Node("html", {k: v for k, v in attrs.items() if k != "/"} if tag == "html" else {})
            self.nodes.append(self.html)
            self.push(self.html)
            self.mode = "head"
            if tag == "html":
                return
        if tag == "html":
            self.merge(self.html, attrs)
            return
        if self.mode == "head":
            if tag == "head":
                if self.head is None:
                    self.head = self.insert("head", attrs)
                return
            if self.head is None:
                self.head = self.insert("head", {})
            if self.stack[-1].name == "noscript" and tag not in ("basefont", "bgsound", "link", "meta", "noframes", "style"):
                self.pop()
            if tag in IN_HEAD or tag == "noscript":
                self.start_in_head(tag, attrs)
                return
            self.pop_through("head")
            self.mode = "after head"
        if self.mode == "after head":
            if tag in ("body", "frameset"):
                node = self.insert(tag, attrs)
                self.body, self.mode = node, tag
                return
            if tag in IN_HEAD:
                self.start_in_head(tag, attrs, self.head.children)
                return
            if tag == "head":
                return
            self.need_body()
        if self.mode == "after":
            self.mode = "body"
        getattr(self, "start_" + self.mode)(tag, attrs)

    def start_in_head(self, tag: str, attrs: dict[str, str], into: list | None = None) -> None:
        self.insert(tag, attrs, into)
        if tag == "template":
            self.active.append(None)
            self.templates.append(self.mode)
            self.mode = "body"

    def start_body(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in IN_HEAD:
            self.start_in_head(tag, attrs)
        elif tag == "body":
            self.merge(self.body, attrs)
        elif tag in ("head", "frame", "frameset") or tag in TABLE_PARTS:
            pass
        elif tag in BLOCKS or tag in HEADINGS or tag in ("pre", "listing", "hr", "xmp", "plaintext"):
            self.close_p()
            if tag in HEADINGS and self.stack[-1].name in HEADINGS:
                self.pop()
            if tag == "xmp":
                self.reopen()
            self.insert(tag, attrs)
            self.skip_line = tag in ("pre", "listing")
        elif tag == "form":
            if self.form is None or self.at.get("template"):
                self.close_p()
                node = self.insert(tag, attrs)
                self.form = self.form if self.at.get("template") else node
        elif tag in ("li", "dd", "dt"):
            near = self.stack[self.walls["item"][-1]].name if self.walls["item"] else ""
            if near == tag or (tag != "li" and near in ("dd", "dt")):
                self.imply(near)
                self.pop_through(near)
            self.close_p()
            self.insert(tag, attrs)
        elif tag == "table":
            if not self.quirks:
                self.close_p()
            self.insert(tag, attrs)
            self.mode = "table"
        elif tag in FORMATTING:
            held = self.formatting("a") if tag == "a" else None
            if held is not None:
                self.adopt("a")
                self.drop(held)
                if held.open:
                    self.restack(held.place, self.stack[held.place + 1 :])
                    held.open = False
            self.reopen()
            if tag == "nobr" and self.in_scope("scope", "nobr"):
                self.adopt("nobr")
                self.reopen()
            self.format(self.insert(tag, attrs))
        elif tag in ("param", "source", "track", "textarea", "iframe", "noembed"):
            self.insert(tag, attrs)
            self.skip_line = tag == "textarea"
        elif tag in ("rb", "rp", "rt", "rtc"):
            if self.in_scope("scope", "ruby"):
                self.imply("rtc" if tag in ("rp", "rt") else "")
            self.insert(tag, attrs)
        else:
            if tag == "button" and self.in_scope("scope", "button"):
                self.imply()
                self.pop_through("button")
            if tag in ("option", "optgroup") and self.stack[-1].name == "option":
                self.pop()
            self.reopen()
            self.insert(tag, attrs)
            if tag in ("applet", "marquee", "object"):
                self.active.append(None)
            if tag == "select":
                self.mode = "select"

    def start_table(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in TABLE_PARTS:
            self.pop_to("table", "template")
            if tag == "col":
                self.insert("colgroup", {})
                self.mode = "colgroup"
            elif tag in ("tr", *CELLS):
                self.insert("tbody", {})
                self.mode = "bodies"
            else:
                self.insert(tag, attrs)
                self.mode = MODES[tag]
                if tag == "caption":
                    self.active.append(None)
                return
            self.start(tag, attrs)
        elif tag == "table":
            if self.in_scope("table", "table"):
                self.end("table")
                self.start(tag, attrs)
        elif tag in ("style", "script", "template"):
            self.start_in_head(tag, attrs)
        elif tag == "input" and attrs.get("type", "").lower() == "hidden":
            self.insert(tag, attrs)
        elif tag == "form":
            if self.form is None:
                self.form = self.insert(tag, attrs)
                self.pop()
        else:
            self.foster = True
            self.start_body(tag, attrs)
            self.foster = False

    def start_caption(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in TABLE_PARTS:
            if self.in_scope("table", "caption"):
                self.end_caption("caption")
                self.start(tag, attrs)
        else:
            self.start_body(tag, attrs)

    def start_colgroup(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "col":
            self.insert(tag, attrs)
        elif tag == "template":
            self.start_in_head(tag, attrs)
        elif self.stack[-1].name == "colgroup":
            self.pop()
            self.mode = "table"
            self.start(tag, attrs)

    def start_bodies(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("tr", *CELLS):
            self.pop_to("template", *BODIES)
            self.insert("tr", attrs if tag == "tr" else {})
            self.mode = "row"
            if tag != "tr":
                self.start(tag, attrs)
        elif tag in TABLE_PARTS:
            if self.in_scope("table", *BODIES):
                self.leave("table", *BODIES)
                self.start(tag, attrs)
        else:
            self.start_table(tag, attrs)

    def start_row(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in CELLS:
            self.pop_to("tr", "template")
            self.insert(tag, attrs)
            self.mode = "cell"
            self.active.append(None)
        elif tag in TABLE_PARTS:
            if self.in_scope("table", "tr"):
                self.leave("bodies", "tr")
                self.start(tag, attrs)
        else:
            self.start_table(tag, attrs)

    def start_cell(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in TABLE_PARTS:
            if self.in_scope("table", *CELLS):
                self.leave_cell()
                self.start(tag, attrs)
        else:
            self.start_body(tag, attrs)

    def start_select(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("option", "optgroup", "hr"):
            for name in ("option",) if tag == "option" else ("option", "optgroup"):
                if self.stack[-1].name == name:
                    self.pop()
            self.insert(tag, attrs)
        elif tag in ("script", "template"):
            self.start_in_head(tag, attrs)
        elif tag in ("select", "input", "keygen", "textarea") or (tag in {"table", *TABLE_PARTS} - {"col", "colgroup"} and self.at.get("table")):
            self.pop_through("select")
            self.reset()
            if tag != "select":
                self.start(tag, attrs)

    def start_frameset(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("frameset", "frame", "noframes"):
            self.insert(tag, attrs)

    def leave(self, mode: str, *names: str) -> None:
        self.pop_to(*names)
        self.pop()
        self.mode = mode

    def leave_cell(self) -> None:
        self.imply()
        self.pop_through(*CELLS)
        self.to_marker()
        self.mode = "row"

    def reset(self) -> None:
        places = {self.at[name][-1]: mode for name, mode in MODES.items() if self.at.get(name)}
        self.mode = places[max(places)] if places else "body"

    def end(self, tag: str) -> None:
        if tag == "template":
            if self.at.get("template"):
                self.imply()
                self.pop_through("template")
                self.to_marker()
                self.mode = self.templates.pop()
            return
        if self.stack and self.stack[-1].name == tag and tag in RAW:
            self.pop()
            return
        if self.mode in ("before", "head", "after head"):
            if tag == "head" and self.mode == "head" and self.head is not None:
                self.pop_through("head")
                self.mode = "after head"
            elif tag == "noscript" and self.stack and self.stack[-1].name == tag:
                self.pop()
            elif tag in ("body", "html", "br"):
                self.need_body()
                self.end(tag)
            return
        if self.mode == "after":
            if tag == "html":
                return
            self.mode = "body"
        getattr(self, "end_" + self.mode)(tag)

    def end_body(self, tag: str) -> None:
        if tag in ("body", "html"):
            if self.in_scope("scope", "body"):
                self.mode = "after"
        elif tag == "p" and not self.in_scope("button", "p"):
            self.insert("p", {})
            self.pop()
        elif tag == "br":
            self.start_body("br", {})
        elif tag == "form" and not self.at.get("template"):
            node, self.form = self.form, None
            if node is not None and node.open and node.place >= self.walls["scope"][-1]:
                self.imply()
                self.restack(node.place, self.stack[node.place + 1 :])
                node.open = False
        elif tag in BLOCKS or tag in ("button", "listing", "pre", "li", "dd", "dt", "form", "applet", "marquee", "object"):
            kind = "button" if tag == "p" else "list" if tag == "li" else "scope"
            if self.in_scope(kind, tag):
                self.imply(tag)
                self.pop_through(tag)
                if tag in ("applet", "marquee", "object"):
                    self.to_marker()
        elif tag in HEADINGS:
            if self.in_scope("scope", *HEADINGS):
                self.imply()
                self.pop_through(*HEADINGS)
        elif tag in FORMATTING:
            self.adopt(tag)
        else:
            self.end_other(tag)

    def end_other(self, tag: str) -> None:
        if self.last(tag) >= self.walls["special"][-1]:
            self.imply(tag)
            self.pop_through(tag)

    def end_table(self, tag: str) -> None:
        if tag == "table":
            if self.in_scope("table", "table"):
                self.pop_through("table")
                self.reset()
        elif tag not in ("body", "html") and tag not in TABLE_PARTS:
            self.foster = True
            self.end_body(tag)
            self.foster = False

    def end_caption(self, tag: str) -> None:
        if tag in ("caption", "table"):
            if self.in_scope("table", "caption"):
                self.imply()
                self.pop_through("caption")
                self.to_marker()
                self.mode = "table"
                if tag == "table":
                    self.end(tag)
        elif tag not in ("body", "html") and tag not in TABLE_PARTS:
            self.end_body(tag)

    def end_colgroup(self, tag: str) -> None:
        if tag != "col" and self.stack[-1].name == "colgroup":
            self.pop()
            self.mode = "table"
            if tag != "colgroup":
                self.end(tag)

    def end_bodies(self, tag: str) -> None:
        if tag in BODIES:
            if self.in_scope("table", tag):
                self.leave("table", *BODIES)
        elif tag == "table":
            if self.in_scope("table", *BODIES):
                self.leave("table", *BODIES)
                self.end(tag)
        else:
            self.end_table(tag)

    def end_row(self, tag: str) -> None:
        if tag in ("tr", "table") or tag in BODIES:
            if self.in_scope("table", tag) and self.in_scope("table", "tr"):
                self.leave("bodies", "tr")
                if tag != "tr":
                    self.end(tag)
        else:
            self.end_table(tag)

    def end_cell(self, tag: str) -> None:
        if tag in CELLS:
            if self.in_scope("table", tag):
                self.imply()
                self.pop_through(tag)
                self.to_marker()
                self.mode = "row"
        elif tag in ROWS:
            if self.in_scope("table", tag):
                self.leave_cell()
                self.end(tag)
        elif tag not in ("body", "html", "caption", "col", "colgroup"):
            self.end_body(tag)

    def end_select(self, tag: str) -> None:
        if tag == "optgroup" and self.stack[-1].name == "option" and self.stack[-2].name == "optgroup":
            self.pop()
        if tag in ("option", "optgroup") and self.stack[-1].name == tag:
            self.pop()
        elif tag == "select" or (tag in {"table", *TABLE_PARTS} and self.in_scope("table", tag)):
            self.pop_through("select")
            self.reset()
            if tag != "select":
                self.end(tag)

    def end_frameset(self, tag: str) -> None:
        if tag == "frameset" and self.stack[-1].name == tag:
            self.pop()


def _squeezed(text: str) -> str:
    return html.escape(re.sub(r"\s+", " ", text), quote=False)


def _attribute(name: str, value: str) -> str:
    value = html.escape(value, quote=False)
    if '"' in value and "'" not in value:
        return f" {name}='{value}'"
    return f' {name}="{value.replace(chr(34), "&quot;")}"'


def write(nodes: list, dropped: set[str]) -> str:
    """The tree as text: sorted attributes without the ``dropped`` ones, squeezed and escaped text, a comment's text as text."""
    out: list[str] = []
    work: list = list(reversed(nodes))
    while work:
        node = work.pop()
        if isinstance(node, Node):
            if node.before:
                before, node.before = node.before, []
                work.extend([node, *reversed(before)])
                continue
            several = SEVERAL["*"] | SEVERAL.get(node.name, set())
            attrs = sorted((k, " ".join(v.split()) if k in several else v) for k, v in node.attrs.items() if k not in dropped)
            out.append("<" + node.name + "".join(_attribute(k, v) for k, v in attrs) + ("/>" if node.name in VOID else ">"))
            if node.name not in VOID:
                work.append(f"\0</{node.name}>")
                if node.name in ("script", "style"):
                    out.append(re.sub(r"\s+", " ", "".join(x for x in node.children if isinstance(x, str))))
                else:
                    work.extend(reversed(node.children))
        elif isinstance(node, tuple):
            out.append(_squeezed(node[0]))
        elif node.startswith("\0"):
            out.append(node[1:])
        else:
            run = [node]
            while work and isinstance(work[-1], str) and not work[-1].startswith("\0"):
                run.append(work.pop())
            out.append(_squeezed("".join(run)))
    return "".join(out).strip()


def rebuilt(page: str, dropped: set[str] = frozenset()) -> str:
    """A page's whole tree as canonical text; references are escaped."""
    return write(TreeBuilder().feed(page).nodes, dropped)
