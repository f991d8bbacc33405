"""Cleaning, joining and rendering on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from sievemark.constants import STRIP_CHARS
from sievemark.functions import markup, names, strings

CLEANING = [
    ("Plain text", "Plain text"),
    ("**Bold** and _it_", "Bold and it"),
    ("R&amp;D team", "R&amp;D team"),
    ("<p>R&amp;D</p>", "R&D"),
    (r"C\+\+", "C++"),
    ("Title\n=====\nBody", "Title Body"),
    ("## Head\n- a\n- b", "Head a b"),
    ("[label](http://x)", "label"),
    ("1. one\n2. two", "one two"),
    ("snake_case_name", "snakecasename"),
    ("Dat<b>a</b>", "Dat a"),
    ("* a\n* b", "a b"),
    ("5 < 6", "5 < 6"),
    ("1.5 years", "1.5 years"),
    ("a*b", "a*b"),
    ("use `x`", "use x"),
    ("\t\n ", ""),
    (None, None),
    ("<ul><li>- one</li><li>2. two</li></ul>", "one two"),
    ("<h2># Head</h2>", "# Head"),
    ('<p>a</p><script>var t="</p>";</script><p>b</p>', "a b"),
    ("<p>&amp;lt;b&amp;gt;</p>", "&lt;b&gt;"),
    # Own cases: quoted ">", comments, unclosed script, references, first text node.
    ('<a title="x>y">z</a>', "z"),
    ("<p class=it's>a</p> b's", "a b's"),
    ("a<!-- <b> -->c", "a c"),
    ("<b>x</b><!-- open", "x <!-- open"),
    ("<p>a</p><script>b", "a"),
    ("<b>## Head</b>", "Head"),
    ("<i></i>&#8217;&#x2019;&#146;&nbsp;x", "’’’\xa0x"),
    ("<i></i>a &foo; b &#xD800; c &#99999999999; d", "a &foo b � c � d"),
    ("<i></i>&eacute;&hearts;&copy=1 & x", "\xe9♥\xa9=1 & x"),
    ("a\r\n\r\nb c\x1cd", "a b c d"),
    ("\xa0a \xa0\n\xa0 b　", "a b"),
    ("<tr>" * 20000 + "x" + "</td>" * 20000, "x"),
    ("<a " + "k=v " * 20000 + ">x</a>", "x"),
    ("*" * 7, "*"),
    ("**" + "a" * 2_000_000 + "**", "a" * 2_000_000),
    ("<script>" + "< a" * 500_000 + "</script><b>x</b>", "x"),
    ("\n" * 200000 + "- a", "a"),
]


def one_column(spark, values, name="c"):
    return spark.createDataFrame(
        [(i, v) for i, v in enumerate(values)], f"i int, {name} string"
    )


def column(df, name="c"):
    return [r[name] for r in df.orderBy("i").collect()]


def test_clean_description(spark):
    df = markup.clean_description(one_column(spark, [c for c, _ in CLEANING]), "c")
    assert df.columns == ["i", "c"]
    got = column(df)
    wrong = [(a[:60], b, g) for (a, b), g in zip([(c or "", b) for c, b in CLEANING], got) if b != g]
    assert not wrong


def test_strip_uses_all_unicode_whitespace(spark):
    assert set(STRIP_CHARS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
    values = [STRIP_CHARS + "a b" + STRIP_CHARS, STRIP_CHARS, "", None, "x"]
    df = one_column(spark, values)
    got = column(df.withColumn("c", strings.strip(F.col("c"))))
    assert got == [None if v is None else v.strip() for v in values]
    blank = column(df.withColumn("c", strings.is_not_blank(F.col("c"))))
    assert blank == [bool(v and v.strip()) for v in values]


def test_join_columns(spark):
    df = spark.createDataFrame([("A", None, "C"), (" A ", "", "C\n")], "a string, b string, c string")
    plain = [r[0] for r in df.select(strings.join_columns(["a", "b", "c"])).collect()]
    clean = [r[0] for r in df.select(strings.join_columns_clean(["a", "b", "c"])).collect()]
    assert plain == ["A  C", "A   C"]
    assert clean == ["A C", "A C"]


def test_truncate_counts_code_points(spark):
    df = one_column(spark, ["\U0001f600" * 5])
    assert column(df.withColumn("c", strings.truncate_chars(F.col("c"), 3))) == ["\U0001f600" * 3]


def test_render(spark):
    df = spark.createDataFrame([("T", "{title} {{x}}"), (None, None)], "t string, d string")
    values = {"title": F.col("t"), "description": F.col("d")}
    template = "{{a}} {title}: {description}"
    formatted = [r[0] for r in df.select(strings.render_format(template, values)).collect()]
    replaced = [r[0] for r in df.select(strings.render_replace(template, values)).collect()]
    assert formatted == ["{a} T: {title} {{x}}", "{a} : "]
    assert replaced == ["{{a}} T: {title} {{x}}", "{{a}} : "]


@pytest.mark.parametrize(
    ("path", "label"),
    [
        ("models/v1/embeddings_title_summary_1000_768d_v2.pkl", "title_summary_768d"),
        ("models/v2/small_1024d_0.6B.pkl", "small_1024d_0.6B"),
    ],
)
def test_model_name_from_path(spark, path, label):
    df = one_column(spark, [path])
    assert column(df.withColumn("c", names.model_name_from_path(F.col("c")))) == [label]


def test_normalize_model_id(spark):
    df = one_column(spark, [" Qwen/Qwen3_Embedding-8B ", None, "a/b/c"])
    got = column(df.withColumn("c", names.normalize_model_id(F.col("c"))))
    assert got == ["qwen3-embedding-8b", "", "b/c"]


def test_strip_equals(spark):
    df = spark.createDataFrame([(" a\n", "a"), (None, " "), ("a", "b")], "a string, b string")
    got = [r[0] for r in df.select(strings.strip_equals(F.col("a"), F.col("b"))).collect()]
    assert got == [True, True, False]
