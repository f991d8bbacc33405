"""The HTML pass against text nodes found by the tokenizer of the standard library."""

import html.entities
import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import functions as F

from sievemark.functions import markup

BLOCKS = {"br", "p", "li", "h1", "h2", "h3", "h4", "h5", "h6"}
HIDDEN = {"script", "style", "template", "rt", "rp"}


class TextNodes(HTMLParser):
    """Collects visible text nodes, with a newline node before each block tag."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.nodes, self.open_text, self.hidden = [], "", []

    def cut(self, *_):
        if self.open_text and not self.hidden:
            self.nodes.append(self.open_text)
        self.open_text = ""

    handle_comment = handle_decl = handle_pi = unknown_decl = cut

    def handle_startendtag(self, tag, attrs):
        self.cut()
        if tag in BLOCKS and not self.hidden:
            self.nodes.append("\n")

    def handle_starttag(self, tag, attrs):
        self.handle_startendtag(tag, attrs)
        if tag in HIDDEN:
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        self.cut()
        if tag in self.hidden:
            self.hidden.remove(tag)

    def handle_data(self, data):
        self.open_text += data

    def handle_entityref(self, name):
        self.open_text += html.entities.html5.get(name + ";", "&" + name)

    def handle_charref(self, name):
        self.open_text += chr(int("0" + name, 16) if name[0] in "xX" else int(name))


VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class OpenElements(TextNodes):
    """Text nodes by a list of open elements; CDATA sections are text nodes."""

    def __init__(self):
        super().__init__()
        self.path = []

    def cut(self, *_):
        if self.open_text and not {"script", "style", "template", "rt", "rp"} & set(self.path):
            self.nodes.append(self.open_text)
        self.open_text = ""

    handle_comment = handle_decl = handle_pi = cut

    def unknown_decl(self, data):
        self.cut()
        if data.upper().startswith("CDATA["):
            self.open_text = data[6:]
            self.cut()

    def handle_startendtag(self, tag, attrs):
        self.cut()
        if tag in BLOCKS and not {"template", "rt", "rp"} & set(self.path):
            self.nodes.append("\n")

    def handle_starttag(self, tag, attrs):
        self.handle_startendtag(tag, attrs)
        if tag not in VOID:
            self.path.append(tag)

    def handle_endtag(self, tag):
        self.cut()
        if tag in self.path:
            while self.path.pop() != tag:
                pass


def tokenized(text, reader=TextNodes):
    if not re.search(markup.HTML_TAG, text):
        return text
    parser = reader()
    parser.feed(text)
    parser.close()
    parser.cut()
    return " ".join(parser.nodes)


def patterned(df):
    c, step = F.col("t"), F.col("step")
    out = df.withColumn("step", F.when(c.rlike(markup.HTML_TAG), markup.strip_tags(c)))
    return out.withColumn(
        "step", F.coalesce(markup.join_nodes(markup.decode_entities(step)), c)
    )


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = patterned(pages.select("page_id", F.col("html").alias("t"))).collect()
    assert rows
    wrong = [r.page_id for r in rows if r.step != tokenized(r.t)]
    assert not wrong


TOKENS = [
    "a", "b1", " ", "\n", "# ", "- ", "&amp;", "&quot;", "&eacute;", "&#8217;", "&#x41;", "&foo;",
    "& ", "&nbsp", "AT&T. ", "5 < 6", ">", "<p>", "</p>", "<br/>", "<br>", "<li class='x'>", "</li>",
    "<b>", "</b>", '<a href="x>y">', "</a>", "<h2>", "</h2>", "<!-- c <b> -->", "<!doctype html>",
    "<script>var a='<p>';</script>", "<style>p{}</style>", "<template><p>x</p></template>",
    "<ruby>x<rt>y</rt></ruby>",
]


def test_random_markup(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(TOKENS, size=rng.integers(1, 14))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    wrong = [(r.t, r.step, tokenized(r.t)) for r in patterned(df).collect() if r.step != tokenized(r.t)]
    assert not wrong, (len(wrong), wrong[:4])


def test_many_attributes_and_cdata(spark):
    many = " ".join(f'a{i}="x"' for i in range(230))
    rows = [
        (f'<p {many} title="p > q">hello</p>', "hello"),
        ("<p>a</p><![CDATA[keep me]]> z", "a keep me z"),
        ("<p>a</p><!-- <![CDATA[x]]> -->b<script><![CDATA[y]]></script>", "a b"),
        ("<b>x</b><![CDATA[line\none]]>", "x line one"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r.i: r.t for r in markup.clean_description(df, "t").collect()}
    assert got == {i: expected for i, (_, expected) in enumerate(rows)}


OPEN_TOKENS = [
    "a", "b1 ", "\n", "&amp;", "&lt;p&gt;", "5 < 6", "<p>", "</p>", "<p/>", "<div>", "</div>", "<br>", "<b>", "</b>",
    "<template>", "<TEMPLATE id='t'>", "</template>", "<ruby>", "<rt>", "</rt>", "<rp>", "</rp>", "</ruby>",
    "<rtx>", "</rtx>", "<!-- <template> -->", "<!-- a <!-- b --> c", "<script>'<template>'</script>",
    "<style><rt></style>", "<![CDATA[x <b>y</b> &amp; <template> <!-- ]]>", "<![cdata[z]]>", "<img src='a'>",
    '<a title="<rt>">', "</a>", "<template/>",
]


def test_open_elements_and_sections(spark):
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(OPEN_TOKENS, size=rng.integers(1, 16))) for _ in range(6000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    expected = {t: tokenized(t, OpenElements) for t in texts}
    wrong = [(r.t, r.step, expected[r.t]) for r in patterned(df).collect() if r.step != expected[r.t]]
    assert not wrong, (len(wrong), wrong[:4])
    assert sum(bool(re.search(markup.STATEFUL, t)) for t in texts) > 3000


def test_hidden_elements_that_never_end(spark):
    rows = [
        ("<p>a</p><template><p>b", "a"),
        ("<div>a<template>b</div>c", "a c"),
        ("<template>a<template>b</template>c</template>d", "d"),
        ("<ruby>x<rt>y</ruby> z", "x z"),
        ("a</template>b<p>", "a b"),
        ("<b>x</b><![CDATA[<i>1</i> &amp; 2]]>", "x <i>1</i> &amp; 2"),
        ("<p>a<!-- x <!-- y --> z -->b", "a z -->b"),
        ("<rt>" * 3000 + "x" + "</rt>" * 3000 + "y", "y"),
        ("<ruby>" + "k<rt>r</rt>" * 20000 + "</ruby>", " ".join(["k"] * 20000)),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r.i: r.t for r in markup.clean_description(df, "t").collect()}
    assert got == {i: expected for i, (_, expected) in enumerate(rows)}
