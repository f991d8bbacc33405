"""Byte-pair encoding of words with word ends, and its decoding.

A word holds its parts and, beside them, the merge ranks of adjacent parts in one contiguous array.
The array is scanned for its minimum, the boundary there goes, and the ranks on both sides are
looked up anew, until no rank is left. Words of equal length are the rows of one matrix, as each of
them loses one boundary per step. Scanning is quadratic, so it serves words of up to ``SHORT``
bytes; longer ones keep the same ranks in a heap and give the same parts.

The vocabulary file is read once, by the driver, and its size is checked; tasks get arrays of ranks or
of tokens and never parse it. Every task remembers the ids of about ``KNOWN_WORDS`` words, packed, and
takes and gives texts in slices of bounded size, whatever the size of the input.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

SHORT = 64
KNOWN_WORDS = 300_000
# Largest vocabulary file that is sent with tasks.
MOST_BYTES = 64_000_000

# Rows and bytes that are encoded or decoded at once; a larger row is alone.
ROWS = 500
BYTES = 1 << 20
# Bits of an id in the key of a pair.
PAIR_BITS = 24

NEVER = 1 << 60

# The normalizer and splitting that this reader stands for, as vocabulary files name them.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# The same words where no character is above U+02FF: nothing to compose there.
_LATIN = re.compile("[^\\x00-\u02ff]")
_LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[\d²³¹¼-¾]|(?:[^\w\s]|[_\x1c-\x1f])+")
# Elsewhere the library's tables of characters count, which differ by age from Python's.
_NORMAL = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
_SPLIT = pre_tokenizers.Split(Regex(SPLIT), "removed", invert=True)


def words_of(text: str) -> list[str]:
    """The words of a text in order, composed and in lower case; white space is dropped."""
    if not _LATIN.search(text):
        return _LATIN_WORDS.findall(text.lower())
    return [word for word, _ in _SPLIT.pre_tokenize_str(_NORMAL.normalize_str(text))]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it shows, else the next one above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    above = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(above)) for b in range(256)]


LETTERS = _byte_letters()


def merged_by_scan(parts: np.ndarray, ranks_of: Callable, merged: np.ndarray) -> list[list[int]]:
    """Ids of the parts that each row of first parts is merged to.

    Args:
        parts: one word per row, all of the same number of parts.
        ranks_of: rank of the pairs of two arrays of ids, ``NEVER`` if they do not merge.
        merged: by rank, the id of the merged part.
    """
    out: list[list[int]] = [[]] * len(parts)
    rows = np.arange(len(parts))
    ranks = ranks_of(parts[:, :-1], parts[:, 1:])
    while ranks.shape[1]:
        at = ranks.argmin(axis=1)
        lowest = ranks[np.arange(len(at)), at]
        open_ = lowest < NEVER
        if not open_.all():
            for row, ids in zip(rows[~open_].tolist(), parts[~open_].tolist()):
                out[row] = ids
            rows, parts, ranks, at, lowest = (x[open_] for x in (rows, parts, ranks, at, lowest))
        width = ranks.shape[1]
        each, columns = np.arange(len(at)), np.arange(width)
        parts = np.take_along_axis(parts, columns + (columns > at[:, None]), 1)
        parts[each, at] = merged[lowest]
        columns = columns[:-1]
        ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), 1)
        for near in (at - 1, at):
            row = each[(near >= 0) & (near < width - 1)]
            place = near[row]
            ranks[row, place] = ranks_of(parts[row, place], parts[row, place + 1])
    for row, ids in zip(rows.tolist(), parts.tolist()):
        out[row] = ids
    return out


def merged_by_heap(parts: list[int], ranks: dict[int, int], merged: np.ndarray) -> list[int]:
    """The same for one long word: ranks by pair in a heap, boundaries as a linked list."""
    n = len(parts)
    parts, after, before = list(parts), [*range(1, n + 1)], [*range(-1, n - 1)]
    heap = []

    def offer(left: int) -> None:
        right = after[left]
        if right < n:
            rank = ranks.get(parts[left] << PAIR_BITS | parts[right])
            if rank is not None:
                heapq.heappush(heap, (rank, left, right, parts[left], parts[right]))

    for left in range(n):
        offer(left)
    while heap:
        rank, left, right, *pair = heapq.heappop(heap)
        if after[left] != right or [parts[left], parts[right]] != pair:
            continue
        parts[left] = int(merged[rank])
        parts[right] = -1
        after[left] = after[right]
        after[right] = -1
        if after[left] < n:
            before[after[left]] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    out, left = [], 0
    while left < n:
        out.append(parts[left])
        left = after[left]
    return out


class WordBpe:
    """A vocabulary and the ids of words met so far."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        known = (
            model["type"] == "BPE"
            and spec["normalizer"].get("normalizers") == NORMALIZERS
            and split["pattern"] == {"Regex": SPLIT}
            and spec["decoder"] is None
            and spec["post_processor"] is None
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        if not known:
            raise ValueError("This vocabulary asks for steps that are not built here")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in LETTERS], np.int64)
        self.last = np.array([vocab[c + end] for c in LETTERS], np.int64)
        merges = [(vocab[a] << PAIR_BITS | vocab[b], vocab[a + b]) for a, b in model["merges"]]
        ranks = {pair: rank for rank, (pair, _) in enumerate(merges)}
        self.merged = np.array([m for _, m in merges], np.int64)
        self.pairs = np.array(sorted(ranks), np.int64)
        self.by_pair = np.array([ranks[p] for p in self.pairs.tolist()], np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers

    @cached_property
    def ranks(self) -> dict[int, int]:
        """Rank by pair; only long words need it."""
        return dict(zip(self.pairs.tolist(), self.by_pair.tolist()))

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left << PAIR_BITS | right
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.by_pair[at], NEVER)

    def _learn(self, words: list[str]) -> None:
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            letters = word.encode()
            by_length.setdefault(len(letters), []).append((word, letters))
        for length, group in by_length.items():
            letters = np.frombuffer(b"".join([x for _, x in group]), np.uint8).reshape(-1, length)
            parts = self.inner[letters]
            parts[:, -1] = self.last[letters[:, -1]]
            if length <= SHORT:
                ids = merged_by_scan(parts, self.ranks_of, self.merged)
            else:
                ids = [merged_by_heap(p, self.ranks, self.merged) for p in parts.tolist()]
            self.known.update((w, array("i", x).tobytes()) for (w, _), x in zip(group, ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text; the strings of added tokens are those tokens."""
        split = [self.marks.split(t) if self.added else [t] for t in texts]
        words = [[words_of(p) if i % 2 == 0 else p for i, p in enumerate(pieces)] for pieces in split]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        met = set(chain.from_iterable(chain.from_iterable(w[::2] for w in words)))
        new = [w for w in met if w not in self.known]
        self._learn(new)
        ids = self.known.__getitem__
        out = []
        for pieces in words:
            runs = (array("i", [self.added[p]]).tobytes() if isinstance(p, str) else b"".join(map(ids, p)) for p in pieces)
            out.append(np.frombuffer(b"".join(runs), np.int32))
        for word in new:
            if len(word) > SHORT:
                del self.known[word]
        return out


def tokens_of(content: bytes) -> list[str | None]:
    """The string of every id of a vocabulary; null for ids that are not in use."""
    spec = json.loads(content)
    by_id = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [by_id.get(i) for i in range(max(by_id) + 1)]


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file, which must be small enough to be sent with every task."""
    size = os.path.getsize(path)
    if size > MOST_BYTES:
        raise ValueError(f"{path} has {size} bytes, more than {MOST_BYTES}")
    with open(path, "rb") as file:
        content = file.read()
    WordBpe(content)  # a file that cannot be used stops here and not in a task
    return content


def encode(text: Column, vocabulary: bytes) -> Column:
    """Ids of every whole text, ``array<int>``. Null and empty texts, and texts of white space
    alone, have none. Equal texts have equal ids; texts of any length are taken whole."""

    words = WordBpe(vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from _encoded(words, batch)

    return F.arrow_udf(run, "array<int>")(F.coalesce(text.cast("string"), F.lit("")))


def _encoded(words: WordBpe, batch: pa.Array) -> Iterator[pa.Array]:
    """Lists of ids of a batch of texts, slice by slice."""
    for texts in _slices(batch, pc.binary_length(batch)):
        found = words.encode(texts.to_pylist())
        ends = np.cumsum([0, *map(len, found)])
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))


def _slices(batch: pa.Array, sizes: pa.Array) -> Iterator[pa.Array]:
    """``batch`` in slices of at most ``ROWS`` rows and about ``BYTES`` bytes, given the bytes of its rows."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        end = int(np.searchsorted(ends, before + BYTES, "right"))
        end = min(max(end, start + 1), start + ROWS)
        yield batch.slice(start, end - start)
        start = end


def _joined(lists: pa.Array, tokens: pa.Array) -> pa.Array:
    """The tokens of each list of ids, with spaces between."""
    flat = pc.list_flatten(lists)
    within = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens)))
    strings = tokens.take(pc.if_else(within, flat, None))
    ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()])
    found = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), strings)
    if strings.null_count:
        found = pa.array([[t for t in x if t is not None] for x in found.to_pylist()], found.type)
    texts = pc.binary_join(found, pa.scalar(" ", pa.large_string()))
    return pc.if_else(lists.is_valid(), texts, None).cast(pa.string())


def decode(ids: Column, vocabulary: bytes) -> Column:
    """The tokens of ids, special ones too, with one space between them, as a vocabulary without a
    decoder gives them. Ids that are null or not in the vocabulary are left out; no ids give the
    empty text, a null list null."""

    tokens = pa.array(tokens_of(vocabulary), pa.large_string())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for ids_of_rows in _slices(batch, pc.multiply(pc.list_value_length(batch), 8)):
                yield _joined(ids_of_rows, tokens)

    return F.arrow_udf(run, "string")(ids)
