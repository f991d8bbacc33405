"""HTML and markdown to flat text, with built-in expressions only.

Every pattern is written so that its cost grows linearly with the text and no
Java regex group but a possessive one repeats: other groups recurse, and one huge
table or attribute list would overflow the task's stack.
"""

from __future__ import annotations

import html.entities
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.names import unused
from sievemark.functions.strings import strip

WS = r"[\s\x1C-\x1F]"
# Line breaks below U+0100, each written singly: Java keeps such a class as one bit set
# and scans it several times faster than one with ranges or wider characters.
LINE_BREAK = r"[\n\x0B\f\r\x1C\x1D\x1E\x85]"

# One character that stands for "a tag was here". U+FDD0 is a noncharacter,
# reserved by Unicode for such internal use.
SEAM = "\ufdd0"

# Fixed value: what makes a text HTML.
HTML_TAG = r"<[a-zA-Z/][^>]*>"

# Comments, scripts, styles and declarations: no part of the page text.
# A script or style that never ends swallows the rest, as in a browser.
# Case is ignored for names only: Java finds "<" several times faster where it matters.
_RAW = (
    r"!--.*?-->"
    r"|(?i:script)(?:[\s/][^>]*)?>.*?(?:</(?i:script)\s*>|\z)"
    r"|(?i:style)(?:[\s/][^>]*)?>.*?(?:</(?i:style)\s*>|\z)"
)
_DECLARATION = r"![a-zA-Z\[][^>]*>|\?[^>]*>"
INVISIBLE = rf"(?s)<(?:{_RAW}|{_DECLARATION})"

# A tag, with quoted attribute values that may hold ">". Possessive groups repeat in a loop,
# so any number of attributes is fine; the second branch takes tags with an open quote.
TAG = (
    r"<(?:[a-zA-Z][^\s/>]*+(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>"
    r"|[a-zA-Z/][^>]*+>)"
)
# Elements whose text is hidden until they end, and CDATA sections, whose text is page text as it
# stands. A text with any of these is read token by token.
HIDDEN = ["template", "rt", "rp"]
STATEFUL = r"<(?=[!tTrR])(?:!\[(?i:CDATA)\[|(?i:" + "|".join(HIDDEN) + r")[\s/>])"
TOKEN = rf"(?s)<(?:!\[(?i:CDATA)\[.*?\]\]>|{_RAW}|{_DECLARATION})|{TAG}|[^<]++|<"
TAG_NAME = r"^</?([a-zA-Z][^\s/>]*+)"
BLOCKS = ["br", "p", "li", "h1", "h2", "h3", "h4", "h5", "h6"]
# Elements that are never open: those without content, and those that are one token.
NEVER_OPEN = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track",
    "wbr", "script", "style",
]
# Stands for "&" in the text of a CDATA section until references are decoded; a noncharacter.
AMPERSAND = "\ufdd1"
# Bytes of text that the fold over tokens appends to before they are set aside.
BLOCK_BYTES = 8192
BLOCK_TAG = r"<(?=[bBpPlLhH])(?i:br|p|li|h[1-6])(?:[\s/][^>]*)?>"

# The markdown marks in the order they are removed, as (texts of which
# one must occur, pattern, replacement). The cheap text search spares most texts the
# pattern.
MARKS = [
    # Blank lines never survive the flattening. Dropping them first keeps the
    # line-start patterns from rescanning long runs of empty lines.
    (["\n"], r"(?U)\n" + WS + r"*\n", "\n"),
    (["\\"], r"(?d)\\(.)", "$1"),
    (["==", "--", "=-", "-="], r"(?dmU)^[=\-]{2,}" + WS + r"*$", ""),
    (["#"], r"(?dmU)^#{1,6}" + WS + r"+", ""),
    (["*"], r"(?s)\*{1,3}(.+?)\*{1,3}", "$1"),
    (["_"], r"(?s)_{1,2}(.+?)_{1,2}", "$1"),
    (["]("], r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (["`"], r"`([^`]*)`", "$1"),
    (["*", "-", "+"], r"(?dmU)^" + WS + r"*+[*\-+]" + WS + r"+", ""),
    (["."], r"(?dmU)^" + WS + r"*+\d+\." + WS + r"+", ""),
    # The two wide line breaks; they start no line for the patterns above.
    (["\u2028", "\u2029"], r"[\u2028\u2029]", "\n"),
]


# What follows "&": a name, or "#" and a number that no further digit follows.
REFERENCE = (
    r"^(?:[a-zA-Z][-.a-zA-Z0-9]*|#(?:[0-9]++|[xX][0-9a-fA-F]++)(?![0-9a-fA-F]))"
)


def _entity_table() -> str:
    """Named references as a JSON object: the HTML 4 names first, then all others."""
    table = {}
    for name, text in html.entities.html5.items():
        table.setdefault(name.rstrip(";"), text)
    order = sorted(table, key=lambda n: (n not in html.entities.name2codepoint, n))
    common = ["amp", "nbsp", "lt", "gt", "quot", "apos"]
    return json.dumps({n: table[n] for n in [*common, *order]})


# Numeric references 128-159 mean the Windows-1252 characters.
_C1 = "".join(chr(c) for c in range(128, 160) if bytes([c]).decode("cp1252", "ignore"))
_C1_TARGET = "".join(bytes([ord(c)]).decode("cp1252") for c in _C1)


def _code_point_text(digits: Column) -> Column:
    """``8217`` or ``x2019`` to its character; invalid code points to U+FFFD."""
    is_hex = F.lower(F.substring(digits, 1, 1)) == "x"
    number = F.regexp_replace(digits, r"^[xX]?0*", "")
    as_hex = F.conv(number, 16, 10).cast("long")
    cp = F.when(number == "", F.lit(0).cast("long")).when(
        F.length(number) <= 8, F.when(is_hex, as_hex).otherwise(number.cast("long"))
    )
    valid = (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
    return F.when(valid, F.translate(char, _C1, _C1_TARGET)).otherwise(F.lit("\ufffd"))


def decode_entities(c: Column) -> Column:
    """Decode character references once, left to right. ``c`` must be a plain column.

    The text is cut at ``&``; each following piece is split into a reference (which may
    be empty) and the rest. Unknown names stay, without their semicolon. A reference
    that the end of the text cuts off is no reference.
    """
    table = F.from_json(F.lit(_entity_table()), "map<string,string>")

    def split_piece(piece: Column) -> Column:
        return F.struct(F.regexp_extract(piece, REFERENCE, 0).alias("ref"), piece.alias("piece"))

    def decode(part: Column) -> Column:
        ref, piece = part["ref"], part["piece"]
        rest = F.substring(piece, F.length(ref) + 1, F.length(piece))
        rest = F.when(rest.startswith(";"), F.substring(rest, F.lit(2), F.length(rest))).otherwise(
            rest
        )
        char = F.when(
            ref.startswith("#"), _code_point_text(F.substring(ref, F.lit(2), F.length(ref)))
        ).otherwise(F.coalesce(F.try_element_at(table, ref), F.concat(F.lit("&"), ref)))
        return F.when(ref == "", F.concat(F.lit("&"), piece)).otherwise(F.concat(char, rest))

    last = F.substring_index(c, "&", -1)
    tail = F.when(last.rlike(REFERENCE + r"\z"), F.concat(F.lit("&"), last)).otherwise("")
    body = F.substring(c, F.lit(1), F.length(c) - F.length(tail))
    pieces = F.slice(F.split(body, "&", -1), 2, 1 << 30)
    chars = F.transform(F.transform(pieces, split_piece), decode)
    decoded = F.concat(F.substring_index(body, "&", 1), F.array_join(chars, ""), tail)
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def visible_tokens(c: Column) -> Column:
    """Like ``strip_tags``, for texts with hidden elements or CDATA sections.

    The text is cut into tokens, and one fold over them carries the path of open elements and how
    much of it is visible. A hidden element ends with its own end tag or with that of an element
    around it, at the latest with the text; end tags that close nothing are ignored.
    """

    def named(t: Column) -> Column:
        return F.struct(t.alias("t"), F.lower(F.regexp_extract(t, TAG_NAME, 1)).alias("name"))

    def read(token: Column) -> Column:
        t, name = token["t"], token["name"]
        is_markup, is_end = t.startswith("<") & (F.length(t) > 1), t.startswith("</")
        section = F.replace(F.substring(t, F.lit(10), F.length(t) - 12), F.lit("&"), F.lit(AMPERSAND))
        shown = (
            F.when(~is_markup, t)
            .when(F.upper(F.substring(t, 1, 9)) == "<![CDATA[", F.concat(F.lit(SEAM), section, F.lit(SEAM)))
            .when(~is_end & name.isin(BLOCKS), F.lit(SEAM + "\n" + SEAM))
            .otherwise(F.lit(SEAM))
        )
        opens = (name != "") & ~is_end & ~name.isin(NEVER_OPEN) & ~t.endswith("/>")
        return F.struct(
            F.when(opens, F.concat(name, F.lit("|"))).alias("opened"),
            F.when((name != "") & is_end, F.concat(F.lit("|"), name, F.lit("|"))).alias("closed"),
            name.isin(HIDDEN).alias("hides"),
            shown.alias("shown"),
            F.when(is_markup, F.lit(SEAM)).otherwise("").alias("hidden"),
        )

    def path_after(path: Column, token: Column) -> Column:
        behind = F.call_function("substring_index", path, token["closed"], F.lit(-1))
        cut = F.substring(path, F.lit(1), F.length(path) - F.length(behind) - F.length(token["closed"]) + 1)
        return (
            F.when(token["opened"].isNotNull(), F.concat(path, token["opened"]))
            .when(F.contains(path, token["closed"]), cut)
            .otherwise(path)
        )

    def state(path, visible, block, done):
        return F.struct(path.alias("path"), visible.alias("visible"), block.alias("block"), done.alias("done"))

    def step(s: Column, token: Column) -> Column:
        """``visible``: length of the path around the outermost hidden element, -1 if there is none."""
        path = path_after(s["path"], token)
        inside = s["visible"] >= 0
        visible = (
            F.when(inside & (F.length(path) <= s["visible"]), F.lit(-1))
            .when(~inside & token["hides"] & token["opened"].isNotNull(), F.length(s["path"]))
            .otherwise(s["visible"])
        )
        # Appending copies, so long texts grow in blocks.
        full = F.octet_length(s["block"]) > BLOCK_BYTES
        piece = F.when(inside, token["hidden"]).otherwise(token["shown"])
        return state(
            path,
            visible,
            F.when(full, piece).otherwise(F.concat(s["block"], piece)),
            F.when(full, F.concat(s["done"], s["block"])).otherwise(s["done"]),
        )

    tokens = F.transform(F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), named), read)
    start = state(F.lit("|"), F.lit(-1), F.lit(""), F.lit(""))
    return F.aggregate(tokens, start, step, lambda s: F.concat(s["done"], s["block"]))


def strip_tags(c: Column) -> Column:
    """Text nodes with seams between them, a newline before br, p, li and h1-h6.

    ``c`` must be a plain column. Only texts with hidden elements or CDATA sections are folded
    token by token; patterns do for all others.
    """
    out = F.regexp_replace(c, INVISIBLE, SEAM)
    out = F.regexp_replace(out, BLOCK_TAG, SEAM + "\n" + "$0")
    out = F.regexp_replace(out, TAG, SEAM)
    return F.when(c.rlike(STATEFUL), visible_tokens(c)).otherwise(out)


def join_nodes(c: Column) -> Column:
    """One space per seam, none at the ends."""
    joined = F.regexp_replace(F.btrim(c, F.lit(SEAM)), SEAM + "+", " ")
    return F.replace(joined, F.lit(AMPERSAND), F.lit("&"))


def flatten_lines(c: Column) -> Column:
    """Lines stripped, empty ones dropped, the rest joined by one space."""
    lines = F.transform(F.split(c, LINE_BREAK), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), " ")


def clean_description(df: DataFrame, column: str) -> DataFrame:
    """Raw HTML or markdown in ``column`` to flat text; null stays null.

    The HTML pass runs only where a tag is found, so ``R&amp;D`` without a tag keeps
    its reference. The steps are separate columns because a step that names its input
    more than once would otherwise repeat all steps before it.
    """
    order = df.columns
    (name,) = unused(order, "clean_step")
    c, step = F.col(column), F.col(name)
    out = df.withColumn(name, F.when(c.rlike(HTML_TAG), strip_tags(c)))
    out = out.withColumn(name, F.coalesce(join_nodes(decode_entities(step)), c))
    out = out.drop(column)
    for texts, pattern, to in MARKS:
        occurs = reduce(Column.__or__, [F.contains(step, F.lit(t)) for t in texts])
        out = out.withColumn(
            name, F.when(occurs, F.regexp_replace(step, pattern, to)).otherwise(step)
        )
    out = out.withColumn(name, flatten_lines(step))
    # A generated column: later filters on it stay above it and do not clean twice.
    collapsed = F.when(
        F.contains(step, F.lit("  ")), F.regexp_replace(step, r" {2,}", " ")
    ).otherwise(step)
    return out.withColumn(column, F.explode(F.array(collapsed))).select(*[F.col(f"`{c}`") for c in order])
