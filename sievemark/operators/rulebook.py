"""Title rules by the hundred: each text meets only the rules that it may match.

``label_by_rules`` tries every rule on every row. Here a rule names plain texts ("needles") of which
each of its matches holds one; they are read off its pattern. One three-character gram per needle is
the key of a small table, the grams of a text are its keys on the other side, and only rules met in
that join run their patterns. The work on a row grows with its length and its matches, not with the
number of rules. Everything is built-in expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.names import unused
from sievemark.operators.joins import broadcast_if_bounded
from sievemark.operators.labels import Rule

GRAM = 3
# Characters outside ASCII that a Unicode pattern without case takes for ASCII letters; lower()
# folds the Kelvin sign itself.
ODD_CASE = ("ſıİ", "sii")
# Escapes that stand for a position or a class of characters, so that they only end a run.
PLAIN_ESCAPES = "bBdDwWsSAzZhHvV"


def _group_end(pattern: str, start: int) -> int:
    """Place behind the group or class that opens at ``start``."""
    depth, in_class, i = 0, False, start
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        i += 1
        if depth == 0 and not in_class:
            return i
    raise ValueError(f"Unbalanced pattern: {pattern}")


def _branches(pattern: str) -> list[str]:
    parts, start, i = [], 0, 0
    while i < len(pattern):
        if pattern[i] in "([":
            i = _group_end(pattern, i)
            continue
        if pattern[i] == "|":
            parts.append(pattern[start:i])
            start = i + 1
        i += 2 if pattern[i] == "\\" else 1
    return [*parts, pattern[start:]]


def _longest_run(branch: str) -> str:
    """The longest plain text, of [a-z0-9 ], that every match of a branch holds."""
    runs, run, i = [], "", 0

    def end(keep: str) -> None:
        nonlocal run
        runs.append(keep)
        run = ""

    while i < len(branch):
        ch = branch[i]
        if ch in "([":
            end(run)
            i = _group_end(branch, i)
            continue
        if ch == "\\":
            i += 1
            ch = branch[i : i + 1]
            plain = ch == " "
        else:
            plain = ch == " " or (ch.isascii() and ch.isalnum())
        if plain:
            run += ch.lower()
        elif ch in "?*{" and branch[i - 1] != "\\":
            # The character before may be missing.
            end(run[:-1])
            if ch == "{":
                i += branch[i:].index("}")
        else:
            end(run)
        i += 1
    return max([*runs, run], key=len)


def needles(pattern: str) -> list[str] | None:
    """Texts in lower case of which every match of ``pattern`` holds one, or None if that is not plain.

    Reads alternatives, also in one group between word boundaries. Patterns with spaces for layout,
    quoted or numbered characters or classes in classes have none, nor have those of which a branch
    has no plain run of three characters.
    """
    spaced = re.search(r"\(\?[a-zA-Z-]*x", pattern)
    odd = [e for e in re.findall(r"\\(.)", pattern, re.DOTALL) if e.isalnum() and e not in PLAIN_ESCAPES]
    odd_class = re.search(r"\[\^?\]|\[[^\]]*\[", pattern)
    if spaced or odd or odd_class:
        return None
    found = []
    for branch in _branches(pattern):
        inner = re.sub(r"^(?:\\b)*|(?<!\\)(?:\\b)*$", "", branch)
        group = re.match(r"\(\?:|\((?!\?)", inner)
        if group and _group_end(inner, 0) == len(inner):
            within = needles(inner[group.end() : -1])
            if within is None:
                return None
            found += within
            continue
        run = _longest_run(branch)
        if len(run) < GRAM:
            return None
        found.append(run)
    return list(dict.fromkeys(found))


def _gram_rows(rules: Sequence[Rule], needed: dict[int, list[str]]) -> list[tuple]:
    """(gram, rule, needle, needles before it, category, patterns), with the gram that fewest needles share."""
    grams = {n: [n[i : i + GRAM] for i in range(len(n) - GRAM + 1)] for ns in needed.values() for n in ns}
    shared = Counter(g for gs in grams.values() for g in set(gs))
    rows = []
    for i, texts in needed.items():
        for at, text in enumerate(texts):
            gram = min(grams[text], key=lambda g: (shared[g], g))
            rows.append((gram, text, texts[:at], rules[i].category, rules[i].include, rules[i].exclude))
    return rows


def _matches(c: Column, pattern: Column) -> Column:
    return F.coalesce(F.rlike(c, F.concat(F.lit("(?iU)"), pattern)), F.lit(False))


def label_by_rulebook(df: DataFrame, rules: Sequence[Rule], title_col: str = "title") -> DataFrame:
    """``label_by_rules`` for many rules: one row per (posting, matching rule), in any order.

    Rules without needles are tried on every row, in a second pass. Null and empty texts match no needle;
    repeated rows stay, and two rules of one category give two rows. No row leaves its task: the
    rules are broadcast if they are few enough, and a rule with several needles counts at the first
    one in the text, so nothing is made distinct afterwards. A column ``category`` is replaced.
    """
    needed, always = {}, []
    for i, rule in enumerate(rules):
        texts = needles(rule.include)
        if texts:
            needed[i] = texts
        else:
            always.append(rule)
    folded, gram, needle, before, label, include, exclude = unused(
        [*df.columns, "category"], "folded", "gram", "needle", "before", "label", "include", "exclude"
    )
    title = F.col(f"`{title_col}`")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != "category"]
    rows = _gram_rows(rules, needed)
    schema = (
        f"{gram} string, {needle} string, {before} array<string>, {label} string, {include} string, {exclude} string"
    )
    book = broadcast_if_bounded(df.sparkSession.createDataFrame(rows, schema), len(rows))
    text = F.lower(F.translate(title, *ODD_CASE))
    grams = F.regexp_extract_all(F.col(folded), F.lit(rf"(?=([a-z0-9 ]{{{GRAM}}}))"), F.lit(1))
    met = (
        df.withColumn(folded, text)
        .withColumn(gram, F.explode(F.array_distinct(grams)))
        .join(book, gram)
        .where(F.contains(F.col(folded), F.col(needle)))
        .where(~F.exists(before, lambda n: F.contains(F.col(folded), n)))
        .where(_matches(title, F.col(include)))
        .where(F.col(exclude).isNull() | ~_matches(title, F.col(exclude)))
        .select(*kept, F.col(label).alias("category"))
    )
    if not always:
        return met
    tried = F.array(*[F.when(r.matches(title), F.lit(r.category)) for r in always])
    rest = df.withColumn(label, F.explode(F.array_compact(tried))).select(*kept, F.col(label).alias("category"))
    return met.unionAll(rest)
