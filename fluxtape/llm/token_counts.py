"""Numbers of tokens by byte-pair merging with a heap over a linked list; no identifiers are made.

Every merge takes one symbol away, so the number of tokens is that of the initial symbols
less the merges.  The adjacent pair of the lowest rank, leftmost among equals, is popped from a
heap; a pair whose symbols have changed meanwhile is passed over.  A merge costs one step of
the heap, so a unit of n symbols takes n log n at most, however long it is.

Texts are cut into units first, where no vocabulary entry reaches across: before a space mark
that follows another character, and beside characters that no longer entry holds.  Workers
remember the counts of units.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import slices

#: Units whose counts a worker remembers at least, and at most twice as many.
REMEMBERED = 300_000
#: Characters of the longest unit that is remembered or merged in one go where it could be cut, and of the
#: longest text whose units are listed at once.
SHORT, LISTED = 64, 1 << 20
SPACE = "▁"


def merged(symbols: list, ranks: dict, weights: list[int] | None = None) -> int:
    """Tokens that are left when adjacent symbols have been merged by rank.

    ``weights`` are the tokens that a symbol counts for while it is not merged, 1 by default.
    """
    size, rank = len(symbols), ranks.get
    left = sum(weights) if weights else size
    pairs = [rank(a + b, -1) for a, b in zip(symbols, symbols[1:])]
    heap = [r * size + i for i, r in enumerate(pairs) if r >= 0]  # ordered by rank, then place
    if not heap:
        return left
    heapify(heap)
    own, worth = list(symbols), weights and list(weights)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    pairs.append(-1)  # the last symbol has no pair
    while heap:
        r, i = divmod(heappop(heap), size)
        if pairs[i] != r:
            continue  # one of the two was merged since
        j = after[i]
        k = after[i] = after[j]
        both = own[i] = own[i] + own[j]
        pairs[j] = -1
        left -= worth[i] + worth[j] - 1 if worth else 1
        if worth:
            worth[i] = 1
        if k < size:
            before[k] = i
            pairs[i] = r = rank(both + own[k], -1)
            if r >= 0:
                heappush(heap, r * size + i)
        else:
            pairs[i] = -1
        h = before[i]
        if h >= 0:
            pairs[h] = r = rank(own[h] + both, -1)
            if r >= 0:
                heappush(heap, r * size + h)
    return left


class Counter(dict):
    """Counts of units, made on demand; ``count`` adds those of a whole text.

    There are two generations, so that frequent units stay when the older one is dropped.
    """

    older: dict[str, int]

    def __missing__(self, unit: str) -> int:
        made = self.older.get(unit)
        if made is None:
            made = self.made(unit)
        if len(unit) <= SHORT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[unit] = made
        return made

    def made(self, unit: str) -> int:
        raise NotImplementedError

    def units(self, text: str) -> Iterable[str]:
        raise NotImplementedError

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.units(text)))


class Ranked(Counter):
    """By a file of byte strings and ranks; matches of a pattern are counted each by itself."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.older = {}
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)

    def made(self, unit: str) -> int:
        data = unit.encode()
        return 1 if data in self.ranks else merged([data[i : i + 1] for i in range(len(data))], self.ranks)

    def units(self, text: str) -> Iterable[str]:
        return self.pattern.findall(text) if len(text) <= LISTED else (m.group() for m in self.pattern.finditer(text))


class Pieces(Counter):
    """By a file of scored pieces: a mark for each space and one before the text, and bytes for characters without a piece."""

    def __init__(self, path: str):
        super().__init__()
        self.older = {}
        with open(path, "rb") as f:
            self.scores, self.fallback = _pieces(f.read())
        order = {s: i for i, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.ranks = {p: order[s] for p, s in self.scores.items() if len(p) > 1}  # equal scores are equal ranks
        self.pairs = {p[i : i + 2] for p in self.ranks for i in range(len(p) - 1)}
        joined = "".join(sorted(set("".join(self.ranks)) - {SPACE}))
        inside = f"[{re.escape(joined)}]" if joined else "(?!)"
        self.whole = all(c in self.scores for c in joined + SPACE)  # so units of more than one character have no other symbols
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ranks)
        self.pattern = re.compile(f"(?s)(?:{inside}|{SPACE})+|." if inner else f"(?s){SPACE}*{inside}+|{SPACE}+|.")

    def made(self, unit: str) -> int:
        if len(unit) <= SHORT:
            return merged(list(unit), self.ranks, self._weights(unit))
        cuts = [0, *(i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in self.pairs), len(unit)]
        return sum(merged(list(part), self.ranks, self._weights(part)) for part in (unit[a:b] for a, b in zip(cuts, cuts[1:])))

    def _weights(self, part: str) -> list[int] | None:
        if self.whole and len(part) > 1 or self.scores.keys() >= set(part):
            return None
        return [1 if c in self.scores or not self.fallback else len(c.encode()) for c in part]

    def units(self, text: str) -> Iterable[str]:
        if not text:
            return ()
        text = SPACE + text.replace(" ", SPACE)
        return self.pattern.findall(text) if len(text) <= LISTED else (m.group() for m in self.pattern.finditer(text))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of an encoded message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            out, shift, at = out | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at : at + size]
            at += size


def _pieces(model: bytes) -> tuple[dict[str, float], bool]:
    """Ordinary pieces with their scores, and whether characters without a piece become bytes.

    ValueError for models that need more than this: another kind than byte pairs, rewriting of characters
    or spaces, or pieces of the user.
    """
    # Fixed values of the public model format: numbers of fields, kinds of pieces and of models.
    PIECE, TRAINER, NORMALIZER = 1, 2, 3
    NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
    MODEL_TYPE, BPE, SUFFIX, BYTE_FALLBACK, CHARSMAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 3, 2, 24, 35, 2, 3, 4, 5
    scores: dict[str, float] = {}
    trainer, normalizer = {}, {}
    for number, value in _fields(model):
        if number == PIECE:
            piece = dict(_fields(value))
            kind = piece.get(3, NORMAL)
            if kind not in (NORMAL, UNKNOWN, CONTROL, BYTE):
                raise ValueError("the model has pieces of the user or unused ones")
            if kind == NORMAL:
                scores[piece[1].decode()] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
        elif number == TRAINER:
            trainer = dict(_fields(value))
        elif number == NORMALIZER:
            normalizer = dict(_fields(value))
    plain = not normalizer.get(CHARSMAP) and normalizer.get(DUMMY_PREFIX, 1) and not normalizer.get(EXTRA_SPACES, 1) and normalizer.get(ESCAPE_SPACES, 1)
    if trainer.get(MODEL_TYPE, 1) != BPE or trainer.get(SUFFIX) or not plain:
        raise ValueError("only models of byte pairs that leave characters and spaces as they are can be counted")
    return scores, bool(trainer.get(BYTE_FALLBACK))


_counters: dict[tuple[str, str | None], Counter] = {}


def counter(path: str, pattern: str | None = None) -> Counter:
    """One counter per worker process; the vocabulary file is installed on every machine."""
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Ranked(path, pattern) if pattern is not None else Pieces(path)
    return _counters[path, pattern]


def token_counts(docs: DataFrame, path: str, limit: int = 4096, pattern: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id) with n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each text.

    ``path`` is a model of scored pieces or, with ``pattern``, a file of ranked byte strings.  Begin, end and
    added special tokens are not counted, and their strings in a text are ordinary text.  One row per row, so
    repeated rows repeat; a null or empty text has no bytes and no tokens; an empty table gives no rows.
    Columns beside ``keep`` and text are not read, and kept ones may have any names but those three.
    """
    keep = keep or ["doc_id"]
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        counts = counter(path, pattern)
        for batch in slices(batches):
            made = pa.array([counts.count(t) if t else 0 for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("n_bytes"), made], [*keep, "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    sent = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])), size)
    return sent.mapInArrow(run, f"{kept}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
