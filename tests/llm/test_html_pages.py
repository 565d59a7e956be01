"""Pages that are not well formed, deep or wide, and random pages against the words that were put in them."""

import random

import pytest

from sievework.llm.html_text import HTMLParser, extract, render

GOLDEN = {
    "<table><td>cell<td>two</table>after": "cell  two\n\nafter",
    "<table>foster<tr><td>a</table>": "foster\n\na",
    "<table><div>x</div><tr><td>a<td>b</table>y": "x\n\na  b\n\ny",
    "<table><form><tr><td>q<td>w</form></table>z": "q  w\n\nz",
    "<table><tr><form><td>x</form></table>": "x",
    "<table><colgroup><col><tbody><tr><td>1<td>2<tr><td>333<td>4</table>": "1    2\n333  4",
    "<table><tfoot><tr><td>f</tfoot><tr><td>b<thead><tr><th>h</table>": "h\nb\nf",
    "<head><title>t</title>text after <b>head</b>": "text after head",
    "<ul>loose<li>a<li>b<ul><li>c</ul>tail</ul>end": "loose\n- a\n- b\n  - c\n  tail\n\nend",
    "<table><tr><td rowspan=2>A<td>B<tr><td>C<td>D</table>": "A  B\n   C  D",
    "<table><caption>cap</caption><tr><th>h</table>": "cap\nh",
    "<p>a<p>b<div>c</div>d": "a\n\nb\n\nc\nd",
    "x<span><div>a</span>b</div>c": "x\nab\nc",
    "<details><summary>S</summary>hid</details><dialog>no</dialog><dialog open>yes</dialog>": "S\nyes",
    "<b><div>x</b>y</div>z": "xy\nz",
    "<b hidden><div>x</b>y</div>z": "y\nz",
    "<b><div hidden><p><b><table><tr><td>a</table></b>c</div>d": "d",
    "<table><tr><td>outer<table><tr><td>in<td>ner</table>": "outer\nin  ner",
}


@pytest.mark.parametrize("html", GOLDEN)
def test_golden(html):
    assert render(html) == GOLDEN[html]


def test_deep_and_wide_pages():
    hidden = "<div>" * 10_000 + "<script>var leak=1</script><style>p{}</style><i hidden>HID<b>HID</b></i>ok"
    assert render(hidden) == "ok"
    assert render("<font>" * 10_000 + "<table><td>a<td>b</table>").endswith("a  b")
    assert render("<table><td>" * 10_000 + "x") == "x"
    assert len(render("<table>" + "<tr><td colspan=1000>x<td>y" * 5_000)) < 100_000
    wide = "<table><tr><td>" + "w" * 5_000 + "<td>e" + "<tr><td>a<td>b" * 5_000 + "</table>"
    assert len(render(wide)) < 20 * len(wide)
    assert len(render("<ul><li>a" * 3_000)) < 400_000


def page(rng, words, depth, shown, out):
    """Random markup; shown words are appended to out in the order in which they stand."""
    html = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "text", "b", "span", "div", "p", "ul", "hidden", "script", "table", "a", "section", "unclosed"]) if depth < 6 else "text"
        inner = lambda s=shown: page(rng, words, depth + 1, s, out)
        if kind == "text":
            w = next(words)
            html.append(f" {w} ")
            if shown:
                out.append(w)
        elif kind == "hidden":
            html.append(f"<div {rng.choice(['hidden', 'style=display:none', 'style="visibility: hidden"'])}>{inner(False)}</div>")
        elif kind == "script":
            html.append(f"<script>var {next(words)} = '<p>';</script>")
        elif kind == "ul":
            html.append("<ul>" + "".join(f"<li>{inner()}" + rng.choice(["", "</li>"]) for _ in range(rng.randint(1, 3))) + "</ul>")
        elif kind == "table":
            n = rng.randint(1, 3)
            rows = "".join("<tr>" + "".join(f"<{c}>{cell(rng, words, shown, out)}" + rng.choice(["", f"</{c}>"]) for c in ["td", "th", "td"][:n]) for _ in range(rng.randint(1, 3)))
            html.append(rng.choice(["<table>", "<table><tbody>", "<table><colgroup><col>"]) + rows + "</table>")
        elif kind == "unclosed":
            html.append(f"<p>{cell(rng, words, shown, out)}")
        else:
            html.append(f"<{kind}>{inner()}</{kind}>")
    return "".join(html)


def cell(rng, words, shown, out):
    w = next(words)
    if shown:
        out.append(w)
    return f"{w}" if rng.random() < 0.7 else f"<i>{w}</i>"


def test_random_pages_show_all_visible_words_in_order_and_no_others():
    rng = random.Random(6)
    for _ in range(400):
        words, out = (f"w{i}w" for i in range(1_000_000)), []
        html = page(rng, words, 0, True, out)
        got = [w for w in render(html).split() if w != "-"]
        assert got == out, html


class Tags(HTMLParser):
    """Text outside of script and style, tags aside."""

    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head", "title", "noscript", "template")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head", "title", "noscript", "template")

    def handle_data(self, data):
        if self.skip <= 0:
            self.out += data.split()


def test_the_drivers_pages_keep_their_words(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        plain = Tags()
        plain.feed(html[r.page_id])
        got = [w for w in r.text.split() if w != "-"]
        assert set(got) - {f"{i}." for i in range(1, 99)} <= set(plain.out)
        if "hidden" not in html[r.page_id] and "display" not in html[r.page_id] and "<ol" not in html[r.page_id] and "<details" not in html[r.page_id]:
            assert sorted(got) == sorted(w for w in plain.out if w != "-")
