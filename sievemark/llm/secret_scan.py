"""Secret scans: fixed patterns plus dictionary-primed zstandard novelty.

Patterns find assignments, access keys and hex strings. Beyond those, every long run of key-like
characters near a sensitive word is a candidate. Its values, that is what ``=`` separates and the
patterns leave, are measured one by one. The novelty of a value is the number of bytes that it
adds to the compressed size of the code around it, with the compressor primed on an identifier
dictionary: names and words that the code already uses cost little, a random key costs about a
byte per character.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")

# Fixed patterns of the base kinds. Only A-Z and a-z count as cases of one letter.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_LEAST = 12
# A run is matched from its first character on, so the least length can be part of the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(
    r"pass|pwd|secret|token|key|auth|credential|private|bearer|signature|salt|cookie",
    re.IGNORECASE | re.ASCII,
)
LEAST_RUN = 16
VALUE = re.compile(r"[^=]+(?:=+\Z)?")  # padding belongs to the last one
# Words of letters, with up to two digits each. The compressor takes rare names for novel.
NAME = re.compile(r"(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)[0-9]{0,2}+[_/+-]*+)++")
NAMED = re.compile(f"({NAME.pattern})=+")
NEAR, AROUND = 48, 256  # characters searched for a sensitive word on each side, and of context
LEAST_NOVELTY = 0.75  # compressed bytes per character

# Identifiers and words that code and configuration use.
IDENTIFIERS = """
access_key access_token account address admin algorithm api_key application argument array
assert async authorization await background base64 bearer boolean branch break buffer build
cache callback catch certificate character checksum class client client_id client_secret
cluster column commit compile config configuration connection const constant container content
content-type context continue controller cookie copyright count create credential database
datetime debug decode default define delete deploy description development dictionary directory
document domain double element else email enabled encode encoding endpoint environment error
event example except exception execute export expression extends false field file filename final
finally float folder format function generate github global handler hash header hostname http
https identifier implements import include index information initialize input instance int
interface internal iterator json key keyword lambda language length library license line list
local localhost location logger login machine manager mapping master memory message metadata
method module namespace network node null number object operation option organization output
package parameter parent parse password path pattern permission placeholder platform pointer
position prefix print private private_key process production profile program project property
protected protocol provider public public_key query queue random range read record reference
register release remote repository request require resource response result return role route
sample schema script secret secret_key security select sequence server service session setting
signature size source standard start state static status storage stream string struct subprocess
success suffix super switch system table target template test text thread throw time timeout
timestamp token transaction true type undefined unicode unique update upload user username uuid
valid value variable vector version virtual void volume warning webhook while window worker
workspace write yaml your_api_key_here xxxxxxxxxxxxxxxx example_token 0000000000000000
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890
"""

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the pattern matches, in code points."""
    found = [
        (m.start(), m.end(), "assign")
        for m in ASSIGN.finditer(text)
        if m.end(2) - m.start(2) >= ASSIGN_LEAST
    ]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class Novelty:
    """Marginal compressed bytes of a string in its context."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 12) -> None:
        words = zstandard.ZstdCompressionDict(
            identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
        self._compress = zstandard.ZstdCompressor(
            level=level, dict_data=words, write_content_size=False, write_dict_id=False
        ).compress

    def per_character(self, context: str, candidate: str) -> float:
        known = context.encode()
        alone = len(self._compress(known))
        return (len(self._compress(known + candidate.encode())) - alone) / len(candidate)


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The ranges that ``spans``, sorted by start, cover."""
    out: list[tuple[int, int]] = []
    for start, end, _ in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _left(start: int, end: int, taken: list[tuple[int, int]], at: int) -> Iterator[tuple[int, int]]:
    """What the ranges ``taken`` from number ``at`` on leave of start..end."""
    for a, b in itertools.islice(taken, at, None):
        if a >= end:
            break
        if a > start:
            yield start, a
        start = max(start, b)
    if start < end:
        yield start, end


def _names_end(text: str, start: int, end: int) -> int:
    """Where the names before ``=`` end that a run begins with. Long ones hold a sensitive word."""
    while (m := NAMED.match(text, start, end)) and (
        len(m[1]) < LEAST_RUN or SENSITIVE.search(m[1])
    ):
        start = m.end()
    return start


def _around_words(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Pieces of a value between sensitive words, less one separator next to each."""
    a = start
    for m in SENSITIVE.finditer(text, start, end):
        yield a, m.start() - (m.start() > a and text[m.start() - 1] in "_/+-")
        a = m.end() + (m.end() < end and text[m.end()] in "_/+-")
    yield a, end


def novel_spans(text: str, taken: list[Span], novelty: Novelty, least: float) -> list[Span]:
    """Values with a sensitive word near or in them that the context does not explain.

    A run of key-like characters behind a sensitive word is measured without the names that it
    begins with. Others are split at ``=`` and at ``taken``, so that a value is behind the words
    of its own name. A value that has the word inside or after it, one that ``taken`` cuts and one
    that stands before a ``=`` is not measured if it reads as a name. If a run behind a sensitive
    word has no novel value, it is measured with its names."""

    def is_novel(start: int, end: int) -> bool:
        if end - start < LEAST_RUN:
            return False
        context = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
        return novelty.per_character(context, text[start:end]) >= least

    def is_key(start: int, end: int) -> bool:
        return end - start >= LEAST_RUN and not NAME.fullmatch(text, start, end) and is_novel(start, end)

    def behind_word(start: int) -> bool:
        return SENSITIVE.search(text, max(0, start - NEAR), start) is not None

    def parts(start: int, end: int, whole: bool) -> list[tuple[int, int]]:
        if end - start < LEAST_RUN:
            return []
        behind = behind_word(start)
        if behind and whole and not text.startswith("=", end):
            if is_novel(start, end):
                return [(start, end)]
        elif (behind or SENSITIVE.search(text, end, end + NEAR)) and is_key(start, end):
            return [(start, end)]
        if not SENSITIVE.search(text, start, end):
            return []
        pieces = [p for p in _around_words(text, start, end) if is_key(*p)]
        return pieces or [(start, end)] * is_key(start, end)

    ranges, found, at = _merged(taken), [], 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(ranges) and ranges[at][1] <= start:
            at += 1
        if not SENSITIVE.search(text, max(0, start - NEAR), end + NEAR):
            continue
        rest = list(_left(start, end, ranges, at))
        whole = rest == [(start, end)]
        values = [v.span() for a, b in rest for v in VALUE.finditer(text, a, b)]
        new, behind = [], whole and behind_word(start)
        if behind and is_novel(first := _names_end(text, start, end), end):
            new = [(first, end)]
        new = new or [p for a, b in values for p in parts(a, b, whole)]
        if not new and behind and is_novel(start, end):
            new = [(start, end)]
        found += [(a, b, "novel") for a, b in new]
    return found


def all_spans(text: str, novelty: Novelty, least: float = LEAST_NOVELTY) -> list[Span]:
    base = base_spans(text)
    if not SENSITIVE.search(text):
        return base
    found = base + novel_spans(text, base, novelty, least)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, *, least_novelty: float = LEAST_NOVELTY) -> DataFrame:
    """Secrets of every whole text.

    Args:
        docs: ``doc_id``, ``text``; other columns are not read.
        least_novelty: compressed bytes per character from which a candidate is reported.

    Returns:
        doc_id, n_assign, n_access, n_hex, n_novel long, base_sha256 string (of the base spans),
        spans string (all spans, ``kind:start:end`` by start, then kind). One row per input row;
        null and empty texts have no spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            rows = [all_spans(t.as_py() or "", novelty, least_novelty) for t in batch.column(1)]
            base = [_joined([s for s in spans if s[2] != "novel"]) for spans in rows]
            counts = [
                pa.array([sum(s[2] == kind for s in spans) for spans in rows], pa.int64())
                for kind in KINDS
            ]
            digests = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()),
                 pa.array([_joined(s) for s in rows], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(
        run,
        f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, "
        "base_sha256 string, spans string",
    )


def redacted(text: str, spans: list[Span], mark: str) -> str:
    """``text`` with every run of overlapping or touching spans replaced by ``mark``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start > at or not at and not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, *, mark: str = "[secret]") -> DataFrame:
    """``docs`` with all secrets replaced by ``mark`` and ``n_chars``, if there, counted anew.

    All rows and columns stay; texts without a secret, null and empty ones are unchanged.
    """

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        novelty = Novelty()
        for batch in texts:
            yield batch.map(
                lambda t: t if t is None else redacted(t, all_spans(t, novelty), mark)
            ).astype(object)

    clean = F.pandas_udf(run, "string")
    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    if "n_chars" not in docs.columns:
        return out
    counted = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(counted))
