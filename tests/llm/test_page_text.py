import pytest

from sievemark.llm.page_text import extract, main_text

PARA = "This paragraph is long enough to be taken for running text, with commas, and a full stop."

CASES = {
    "article": (
        "<html><head><title>x</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav>"
        f"<div class='ad'>{PARA}</div><article><h1>Title</h1><p><b>One &amp; two<br><p>A\n  b&nbsp;c {PARA}</p></article>"
        f"<section id=comments><p>{PARA}</p></section><footer>(c)</footer></body></html>",
        f"Title\nOne & two\nA b c {PARA}",
    ),
    "no article": (
        f"<body class='has-sidebar'><div id=nav><a href=x>Home</a> <a href=y>More</a></div><h1>Head</h1><div><p>{PARA}<p>Short."
        f"<ul><li>one<li>two</ul></div><aside>{PARA}</aside><form>{PARA}</form></body>",
        f"Head\n{PARA}\nShort.\none\ntwo",
    ),
    "comments in the article": (
        f"<article><p>{PARA}</p><div class='reader-comments'><article class=comment><p>{PARA} Nice!</p></article></div></article>",
        PARA,
    ),
    "two sections": (
        f"<body><div><p>{PARA} 1</p><p>{PARA} 2</p></div><div class=menu>{PARA}</div><div><p>{PARA} 3</p><p>{PARA} 4</p></div></body>",
        "\n".join(f"{PARA} {i}" for i in range(1, 5)),
    ),
    "script text": ("<p>a</p><script>var t='</p>';</script><p>b</p><!-- <p>c</p> -->", "a\nb"),
    "form around all": (f"<body><form><article><p>{PARA}</p></article></form></body>", PARA),
    "plain": ("no markup < at all & done", "no markup < at all & done"),
    "cdata": ("<p>x</p><![CDATA[a <b>]]>", "x\na <b>"),
    "empty": ("", ""),
    "boilerplate": ("<body><nav>Home</nav><form>x</form></body>", ""),
    "cut off": ("<body><p>text<a href='", "text"),
    "nested deep": ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    "open quotes": ("<p>a</p>" + "<a x='" * 50, "a"),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    html, expected = CASES[name]
    assert main_text(html) == expected


def test_rows_stay(spark):
    long = "<article>" + f"<p>{PARA}</p>" * 5000 + "</article>"
    rows = [(1, "u", "<p>a", "c"), (1, "u", "<p>a", "c"), (2, None, None, "c"), (None, "v", "", "c"), (3, "w", long, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 5000 * (len(PARA) + 1) - 1)]
    assert extract(df.limit(0)).collect() == []


def test_given_pages_give_their_article(spark):
    from html import unescape
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for row in pages.collect():
        inside = row.html[row.html.index("<article>") + 9 : row.html.index("</article>")]
        inside = re.sub("</?b>|<br>", " ", inside)
        blocks = (" ".join(unescape(b).split()) for b in re.split("</?(?:p|h1)>", inside))
        assert got[row.page_id] == "\n".join(b for b in blocks if b)
