"""Byte-level BPE as a monoid: halves are encoded and neighbours joined.

An encoding is the list of its tokens.  Two neighbouring encodings are joined by
re-encoding a window around the seam.  A token list is the encoding of its bytes
exactly if every two adjacent tokens encode back to themselves, so as soon as the
window's first and last tokens are compatible with the tokens outside, all tokens
outside are proved stable; until then the window grows.  The join is associative,
with the empty list as its unit, so a long match is reduced as a balanced tree and
no step is longer than a leaf plus the window.  Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .features import slices

#: Bytes that one leaf of the tree encodes directly.
LEAF = 32
#: Matches whose encodings a worker remembers; it forgets all when there are more.
REMEMBERED = 400_000


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.fits = lru_cache(200_000)(self._fits)

    def leaf(self, data: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        parts = [data[i : i + 1] for i in range(len(data))]
        none = len(ranks) + 1
        pairs = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        return self.leaf(self.pieces[left] + self.pieces[right]) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes, from their encodings."""
        if not left or not right:
            return left or right
        if self.fits(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.reduce(b"".join(self.pieces[t] for t in [*left[len(left) - a :], *right[:b]]), False)
            ok_left = a == len(left) or self.fits(left[len(left) - a - 1], window[0])
            ok_right = b == len(right) or self.fits(window[-1], right[b])
            if ok_left and ok_right:
                return left[: len(left) - a] + window + right[b:]
            a, b = a * (1 if ok_left else 2), b * (1 if ok_right else 2)

    def reduce(self, data: bytes, split: bool = True) -> list[int]:
        """Encode one match: leaves, then joins of neighbours up a balanced tree."""
        if len(data) <= LEAF or not split:
            return self.leaf(data)
        level = [self.leaf(data[i : i + LEAF]) for i in range(0, len(data), LEAF)]
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, each match of the pattern by itself."""
        return [t for m in self.pattern.findall(text) for t in self.reduce(m.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def _known(self, match: str) -> tuple[str, int, bytes]:
        ids = self.reduce(match.encode())
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        out = (" ".join(map(str, ids)), len(ids), self.decode(ids))
        if len(match) <= 64:
            self.known[match] = out
        return out

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, hash of the ids as decimals, hash of the bytes they decode to."""
        get, n = self.known.get, 0
        ids, back = hashlib.sha256(), hashlib.sha256()
        gap = ""
        for block in _blocks(self.pattern.findall(text)):
            found = [get(m) or self._known(m) for m in block]
            ids.update((gap + " ".join([f[0] for f in found])).encode())
            back.update(b"".join([f[2] for f in found]))
            n += sum([f[1] for f in found])
            gap = " "
        return n, ids.hexdigest(), back.hexdigest()


def _blocks(items: list, size: int = 50_000):
    for i in range(0, len(items), size):
        yield items[i : i + size]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process; the rank file is installed on every machine."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def _mapped(docs: DataFrame, path: str, pattern: str, keep: list[str], names: list[str], types: str, work) -> DataFrame:
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        c = codec(path, pattern)
        for batch in slices(batches):
            rows = [work(c, t or "") for t in batch.column("text").to_pylist()]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_ARROW[t.split()[1]] for t in types.split(", "))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *made], [*keep, *names])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{kept}, {types}")


_ARROW = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}


def token_digests(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id) with n_tokens, ids_sha256 and decoded_sha256 of each text.

    One row per row; a null or empty text has no tokens and the hashes of nothing.
    Columns beside ``keep`` and text are not read.  Special tokens are never made.
    """
    return _mapped(docs, path, pattern, keep or ["doc_id"], ["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens bigint, ids_sha256 string, decoded_sha256 string", lambda c, t: c.digest(t))


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id) with ``ids`` and ``n_tokens``; null texts have no ids."""

    def work(c: Codec, text: str):
        ids = c.encode(text)
        return ids, len(ids)

    return _mapped(docs, path, pattern, keep or ["doc_id"], ["ids", "n_tokens"], "ids array<int>, n_tokens bigint", work)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``data``, the bytes of each row's ``ids``; null ids give no bytes."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        c = codec(path, pattern)
        for batch in slices(batches):
            data = [c.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, data binary")
