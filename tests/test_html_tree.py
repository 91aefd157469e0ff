"""Trees of pages: what the HTML standard's rules make of tag soup, in linear time."""

from __future__ import annotations

import random
import time

import pytest

from webstrata.operators.html_tree import rebuilt


def _page(body, head=""):
    return f"<html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("soup", "tree"),
    [
        ("<html><head><title>Title</title></head><body>    <p>     some text</p></body></html>", _page(" <p> some text</p>", "<title>Title</title>")),
        ("<body>    <p>     some text</p></body>", _page(" <p> some text</p>")),
        ("<!DOCTYPE html>\n<html></html>\n", _page(" ")), ("", _page("")), ("1 < 2 <3", _page("1 &lt; 2 &lt;3")),
        ("<table><b>x<tr>", _page("<b>x</b><table><tbody><tr></tr></tbody></table>")),
        ("<table>a<tr>b<td>c</table>d", _page("ab<table><tbody><tr><td>c</td></tr></tbody></table>d")),
        ("<table><td>1<td>2<tr><td>3<tfoot><tr><td>4</table>", _page("<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody><tfoot><tr><td>4</td></tr></tfoot></table>")),
        ("<table><caption>c<col><tr><td>x", _page("<table><caption>c</caption><colgroup><col/></colgroup><tbody><tr><td>x</td></tr></tbody></table>")),
        ("<table><tr><td><table><tr><td>x</td></tr></table></td></tr></table>", _page("<table><tbody><tr><td><table><tbody><tr><td>x</td></tr></tbody></table></td></tr></tbody></table>")),
        ("<p><b>a<p>c", _page("<p><b>a</b></p><p><b>c</b></p>")),
        ("<p>1<b>2<i>3</b>4</i>5</p>", _page("<p>1<b>2<i>3</i></b><i>4</i>5</p>")),
        ("<b>1<p>2</b>3</p>", _page("<b>1</b><p><b>2</b>3</p>")),
        ("<a>1<div>2<div>3</a>4</div>5</div>", _page("<a>1</a><div><a>2</a><div><a>3</a>4</div>5</div>")),
        ("<a href=1>x<a href=2>y", _page('<a href="1">x</a><a href="2">y</a>')),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", _page("<ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>")),
        ("<dl><dt>a<dd>b<dt>c</dl>", _page("<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>")),
        ("<select><option>a<option>b<optgroup><option>c</select>x", _page("<select><option>a</option><option>b</option><optgroup><option>c</option></optgroup></select>x")),
        ("<script>if (a<b && c) '</p>'</script><p>x", _page("<p>x</p>", "<script>if (a<b && c) '</p>'</script>")),
        ("<textarea>\n<b>&amp;</b></textarea>", _page("<textarea>&lt;b&gt;&amp;&lt;/b&gt;</textarea>")),
        ("<p>a</div>b</p></p>c</br>", _page("<p>ab</p><p></p>c<br/>")),
        ("<h1>a<h2>b</h1>c<button>d<button>e", _page("<h1>a</h1><h2>b</h2>c<button>d</button><button>e</button>")),
        ("<!doctype html><p>a<table><tr><td>b</table>c", _page("<p>a</p><table><tbody><tr><td>b</td></tr></tbody></table>c")),
        ("<p>a<table><tr><td>b</table>c", _page("<p>a<table><tbody><tr><td>b</td></tr></tbody></table>c</p>")),
        ("<svg><path d='1'/><g/></svg>x", _page('<svg><path d="1"></path><g></g></svg>x')),
        ("<a href='?a=1&copy=2&amp;b=3&lt;' Z=1 B>x</a>", _page('<a b="" href="?a=1&amp;copy=2&amp;b=3&lt;" z="1">x</a>')),
        ("<p title='a\"b' class='  a   b '>x", _page("<p class=\"a b\" title='a\"b'>x</p>")),
        ("<title>x</title><p>y<body class=z>", '<html><head><title>x</title></head><body class="z"><p>y</p></body></html>'),
        ("a <!-- note --> b", _page("a  note  b")), ("<frameset><frame src=a>x</frameset>", '<html><head></head><frameset><frame src="a"/></frameset></html>'),
    ],
)
def test_trees(soup, tree):
    assert rebuilt(soup) == tree


def test_dropped_attributes_and_cut_tags():
    assert rebuilt("<p nonce=1 id=2>x</p><a href='never closed", {"nonce"}) == _page('<p id="2">x</p>')
    assert rebuilt("x<!-- never closed <p>y") == _page("x never closed &lt;p&gt;y")


@pytest.mark.parametrize("page", ["<div>" * 100_000, "<b>" * 100_000, "<x>" * 50_000 + "</y>" * 50_000, "<div>" * 50_000 + "<li></li>" * 50_000, "<table><tr><td>" * 30_000, "<!--" * 100_000, "<a b='" * 50_000, "<" * 100_000])
def test_deep_pages_take_linear_time(page):
    began = time.process_time()
    rebuilt(page)
    assert time.process_time() - began < 8


def test_any_soup_becomes_a_tree():
    """Every open tag is closed, in order."""
    rng, void = random.Random(1), {"br", "img", "hr", "col", "frame", "input"}
    tags = "html head body p b i a div table tr td tbody caption col colgroup ul li select option form button h1 title br img template svg font nobr frameset object span dl dt dd textarea hr".split()
    for _ in range(3000):
        soup = "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", "x", " "]) for _ in range(rng.randint(1, 25)))
        tree, stack = rebuilt(soup), []
        for part in tree.split("<")[1:]:
            name = part.split(">")[0]
            if name.startswith("/"):
                assert stack.pop() == name[1:], soup
            elif name.rstrip("/") not in void:
                stack.append(name)
        assert not stack and tree.startswith("<html><head>") and tree.endswith("</html>"), soup
