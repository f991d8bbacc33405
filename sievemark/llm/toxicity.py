"""Toxicity by weak supervision.

Voters are lexicons and patterns. Some lexicons are fixed, others hold words and word beginnings
that training rows marked toxic share. A generative label model estimates how often each voter
fires on either class and which voters repeat each other; a linear classifier is trained on its
posterior labels and compiled into a column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.names import unused
from sievemark.llm.common import small_side, text_digest, text_or_empty
from sievemark.llm.label_model import LabelModel, logistic
from sievemark.llm.labelled import SAMPLE_ROWS, held_out, joined, training_labels
from sievemark.session import materialize

FOLDS, FOLD_OUT = 3, 1
THRESHOLD = 0.7

# Common English insults, in two lexicons.
INSULTS = ["idiot", "moron", "imbecile", "stupid", "dumb", "fool", "clown", "loser", "jerk", "brainless"]
SCORN = ["scum", "trash", "garbage", "vermin", "filth", "worthless", "pathetic", "disgusting", "useless", "hateful"]
SHOUT = r"\p{Lu}{3,}\W*!"
ADDRESS = r"(?i)\byou(?: are|'re)?(?: such)?(?: an?)? (?:" + "|".join(INSULTS + SCORN) + r")\b"
THREAT = r"(?i)\b(?:kill|hurt|shoot|stab|hang) (?:you|him|her|them|yourself|yourselves)\b"

PREFIXES = (3, 4, 5)
MINED_LEXICONS = 8
LEAST_DOCS, LEAST_PRECISION = 5, 0.85


def words(name: str = "text") -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(text_or_empty(name)), F.lit(r"\p{L}+"), F.lit(0))


@dataclass(frozen=True)
class Lexicon:
    """Whole words, and beginnings of words."""

    name: str
    whole: tuple[str, ...] = ()
    starts: tuple[str, ...] = ()

    def matches(self, word: Column) -> Column:
        hit = word.isin(list(self.whole)) if self.whole else F.lit(False)
        for size in sorted({len(s) for s in self.starts}):
            hit = hit | F.substring(word, 1, size).isin([s for s in self.starts if len(s) == size])
        return hit


def mine_lexicons(sample: DataFrame) -> list[Lexicon]:
    """Words and word beginnings of ``sample`` (text, label) that toxic rows share.

    A cue is in at least LEAST_DOCS different toxic texts, however few of all they are, so a small
    language has its own; and at least LEAST_PRECISION of the texts with it are toxic. Of a cue
    and a longer one that it begins only the shorter stays. All cues are kept: the sample bounds
    them."""
    sample = sample.dropDuplicates(["text"])
    word = F.explode(F.array_distinct(words())).alias("word")
    found = sample.select(F.monotonically_increasing_id().alias("row"), "label", word)
    kinds = [F.struct(F.lit(0).alias("size"), F.col("word").alias("cue"))] + [
        F.struct(F.lit(k).alias("size"), F.substring("word", 1, k).alias("cue")) for k in PREFIXES
    ]
    cues = found.select("row", "label", F.inline(F.array(*kinds)))
    cues = cues.where((F.col("size") == 0) | (F.length("cue") == F.col("size"))).distinct()
    counted = cues.groupBy("size", "cue").agg(
        F.sum("label").alias("toxic"), F.count("*").alias("rows")
    )
    good = counted.where(
        (F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") >= LEAST_PRECISION * F.col("rows"))
    )
    best = good.orderBy(F.col("toxic").desc(), "size", "cue").collect()
    kept: list[tuple[int, str]] = []
    for size, cue in sorted(((r["size"] or 99, r.cue) for r in best), key=lambda c: c[0]):
        if not any(s < 99 and cue.startswith(c) for s, c in kept):
            kept.append((size, cue))
    strength = {(r["size"] or 99, r.cue): r.toxic for r in best}
    kept = sorted(kept, key=lambda c: (-strength[c], c))
    return [
        Lexicon(
            f"mined_{i}",
            tuple(c for s, c in kept[i::MINED_LEXICONS] if s == 99),
            tuple(c for s, c in kept[i::MINED_LEXICONS] if s < 99),
        )
        for i in range(min(MINED_LEXICONS, len(kept)))
    ]


def _votes(docs: DataFrame, lexicons: list[Lexicon], more: list[str]) -> tuple[DataFrame, list[str]]:
    """doc_id, columns ``more``, one 0/1 column per voter, and the measures hits and dense; each text is read once."""
    whole = Lexicon(
        "all",
        tuple(sorted({w for lex in lexicons for w in lex.whole})),
        tuple(sorted({s for lex in lexicons for s in lex.starts})),
    )
    text = text_or_empty()
    hits = docs.select(
        "doc_id",
        *more,
        words().alias("words"),
        F.regexp_like(text, F.lit(SHOUT)).alias("shout"),
        F.regexp_like(text, F.lit(ADDRESS)).alias("address"),
        F.regexp_like(text, F.lit(THREAT)).alias("threat"),
    ).select(
        "doc_id", *more, "shout", "address", "threat", F.size("words").alias("n"),
        F.filter("words", whole.matches).alias("hits"),
    )
    n_hits = F.size("hits")
    voters = {lex.name: F.exists("hits", lex.matches) for lex in lexicons} | {
        "several": n_hits >= 3,
        "dense": n_hits * 100 >= F.greatest(F.col("n"), F.lit(1)),
        "none": n_hits == 0,
        "shout": F.col("shout"),
        "address": F.col("address"),
        "threat": F.col("threat"),
    }
    columns = [F.coalesce(c, F.lit(False)).cast("int").alias(f"v_{k}") for k, c in voters.items()]
    measures = [
        F.log1p(n_hits.cast("double")).alias("m_hits"),
        F.log1p(n_hits * 100.0 / F.greatest(F.col("n"), F.lit(1))).alias("m_share"),
    ]
    return hits.select("doc_id", *more, *columns, *measures), [f"v_{k}" for k in voters]


def score(
    docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD
) -> DataFrame:
    """Toxicity of every whole text.

    Args:
        docs: ``doc_id``, ``text``; other columns are not read.
        labels: ``doc_id``, ``toxic``. Rows whose crc32(doc_id as text) mod 3 is 1 are not read
            for learning.
        sample_rows: labelled rows used to find cues and to anchor the label model, at most. Vote
            patterns are counted over all documents.

    Returns:
        doc_id, held_out boolean, score double, predicted int. One row per input row; null and
        empty texts have no votes and get the score of those. Without any label the fixed
        lexicons decide.
    """
    return _scored(docs, labels, sample_rows, threshold, [])


def _scored(
    docs: DataFrame, labels: DataFrame, sample_rows: int, threshold: float, more: list[str]
) -> DataFrame:
    """``score`` with the columns ``more`` of ``docs``."""
    taken = training_labels(labels, "toxic", FOLDS, FOLD_OUT, sample_rows)
    sample = joined(docs.select("doc_id", F.col("text").cast("string").alias("text")), taken)
    lexicons = [Lexicon("insults", tuple(INSULTS)), Lexicon("scorn", tuple(SCORN))]
    lexicons += mine_lexicons(materialize(sample.select("text", "label"), "labelled-texts"))
    rows, voters = _votes(docs, lexicons, more)
    rows = materialize(rows, "votes")
    # The number of different patterns is bounded by the number of voters.
    measures = ["m_hits", "m_share"]
    known = rows.join(F.broadcast(taken), F.col("doc_id") == F.col("labelled_id"), "left")
    patterns = (
        known.groupBy(*voters)
        .agg(
            F.count("*").alias("n"),
            F.sum((F.col("label") == 0).cast("int")).alias("n0"),
            F.sum((F.col("label") == 1).cast("int")).alias("n1"),
            *[F.avg(m).alias(m) for m in measures],
        )
        .collect()
    )
    if not patterns:
        weights = np.zeros(len(voters) + len(measures) + 1)
    else:
        weights = _fit(patterns, voters, measures)
    linear = F.lit(float(weights[-1]))
    for name, w in zip(voters + measures, weights):
        linear = linear + F.col(name) * F.lit(float(w))
    value = 1 / (1 + F.exp(-linear))
    return rows.select(
        "doc_id",
        *more,
        held_out(FOLDS, FOLD_OUT).alias("held_out"),
        value.alias("score"),
        (value >= threshold).cast("int").alias("predicted"),
    )


def _fit(patterns: list, voters: list[str], measures: list[str]) -> np.ndarray:
    """Label model over vote patterns, then linear weights on its posterior labels."""
    votes = np.array([[r[v] for v in voters] for r in patterns], int)
    known = np.array([[r.n0 or 0, r.n1 or 0] for r in patterns], float)
    counts = np.array([r.n for r in patterns], float) - known.sum(axis=1)
    lexicon = [i for i, v in enumerate(voters) if v.startswith(("v_mined", "v_insults", "v_scorn"))]
    fired = votes[:, lexicon].any(axis=1)
    start = np.where(fired, 0.9, 0.02)
    model = LabelModel().fit(votes, counts, known, start)
    posterior = model.posterior(votes)
    x = np.hstack([votes, np.array([[r[m] for m in measures] for r in patterns], float)])
    return logistic(x, posterior, counts + known.sum(axis=1))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic. Rows are told apart by their text, which alone
    decides the score, so repeated rows go or stay together; null and empty texts are scored as
    empty, very long ones whole. Columns of any name stay; an empty table stays empty."""
    (gone,) = unused(docs.columns, "gone")
    texts = docs.select("doc_id", "text", text_digest().alias("digest"))
    found = _scored(texts, labels, SAMPLE_ROWS, THRESHOLD, ["digest"])
    toxic = found.where("predicted = 1").select(F.col("digest").alias(gone))
    toxic = small_side(materialize(toxic.distinct(), "toxic-texts"))
    return docs.join(toxic, text_digest() == F.col(gone), "left_anti")
