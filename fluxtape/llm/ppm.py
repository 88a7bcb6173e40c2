"""Language-model scoring: prediction by partial matching over bytes, and word unigrams.

The model reads a text as its lower-cased words, one blank between them and a line
feed at the end.  Its trie holds contexts of up to ORDER bytes with the counts of the
bytes that followed.  A byte is predicted by the longest known context; a byte that
was not seen there costs an escape, estimated from the number of distinct successors
(method D: half of their number as a share of all occurrences, taken from each of them
alike), and the next shorter context predicts it with the bytes already offered
excluded.  The probability of a byte depends on nothing but the counts and the byte
string of ORDER + 1 that ends in it, so the pretrained model is a table of the log
probabilities of all such strings; the adaptive model updates its trie after each byte.

Counts of words and of byte strings are gathered from all training texts and none are
dropped; those of shorter strings are the sums of the longest ones'.  The most frequent
words and strings are sent out, and the others meet their table in a join.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import chunks, slices
from .scratch import materialize

ORDER = 5
#: Byte strings of ORDER + 1 whose log probabilities are sent to the executors, at most; the others meet theirs in a join.
GRAMS = 1_000_000
#: Counts of contexts up to this order are sent out whole (2 ** 24 strings at most), and longer
#: contexts that end in the same SHARED + 1 bytes are counted together.
SHARED = 2
#: Words whose counts are sent to the executors, at most.
HEAD = 200_000
#: Different words a task counts before it passes them on, and four times as many byte strings; rows that are solved together.
HELD = 150_000

#: Bytes of text whose strings are arrays at a time.
PART = 1 << 19

START = b"\n" * ORDER


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _streams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the normal forms, each after START, and the number of scored bytes of each."""
    forms = [b" ".join(t.lower().split()) + b"\n" for t in texts]
    return np.frombuffer(START + START.join(forms), np.uint8), np.array([len(f) for f in forms], np.int64)


def _scored(sizes: np.ndarray) -> np.ndarray:
    """Positions of the scored bytes in a stream."""
    begin = np.cumsum(sizes + ORDER) - sizes
    return np.arange(sizes.sum()) + np.repeat(begin - np.r_[0, np.cumsum(sizes)[:-1]], sizes)


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The byte string of ORDER + 1 that ends in each scored byte, first byte highest, and the number of them of each text."""
    data, sizes = _streams(texts)
    at = _scored(sizes)
    code = np.zeros(len(data) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        code = (code << np.uint64(8)) | data[k : len(data) - ORDER + k]
    return code[at - ORDER], sizes


def _gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(_grams(texts)[0], return_counts=True)


def _merge(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    out, where = np.unique(keys, return_inverse=True)
    return out, *(np.bincount(where, c, len(out)).astype(np.int64) for c in counts)


def _counts(docs: DataFrame) -> DataFrame:
    """Partial counts of words (``w``) and of byte strings (``g``), ends as a null word.

    ``c`` counts in training rows, ``n`` in all rows; words and ends are of training rows alone.
    """

    def run(batches):
        words: Counter = Counter()
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        grams = none

        def out(w: list, g: np.ndarray, c, n) -> pa.RecordBatch:
            k = len(c)
            return pa.RecordBatch.from_arrays([pa.array(w or [None] * k, pa.binary()), pa.array(g, pa.int64()) if len(g) else pa.nulls(k, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], ["w", "g", "c", "n"])

        def flush():
            items = list(words.items())
            words.clear()
            for lo in range(0, len(items), 50_000):
                w, c = zip(*items[lo : lo + 50_000])
                yield out(list(w), (), c, c)

        ends = 0
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            held = batch.column("held_out").to_pylist()
            for learn in (True, False):
                some = [t for t, h in zip(texts, held) if h != learn]
                ends += len(some) if learn else 0
                for lo, hi in chunks(some, PART):
                    if learn:
                        for t in some[lo:hi]:
                            words.update(t.lower().split())
                        if len(words) > HELD:
                            yield from flush()
                    keys, counts = _gram_counts(some[lo:hi])
                    both = (keys, counts if learn else np.zeros(len(keys), np.int64), counts)
                    grams = _merge(*(np.concatenate(x) for x in zip(grams, both)))
                    if len(grams[0]) > 4 * HELD:
                        yield out([], grams[0].view(np.int64), *grams[1:])
                        grams = none
        yield from flush()
        if len(grams[0]):
            yield out([], grams[0].view(np.int64), *grams[1:])
        yield out([], (), [ends], [ends])

    return docs.select("text", held_out().alias("held_out")).mapInArrow(run, "w binary, g bigint, c bigint, n bigint")


def _above(counted: DataFrame, most: int, by: str = "c") -> int:
    """The least count such that at most ``most`` rows have it or more, on a grid of eighths of powers of two."""
    level = F.floor(F.log2(by) * 8).cast("int").alias("level")
    left = most
    lowest = None
    for row in counted.groupBy(level).count().orderBy(F.desc("level")).collect():  # 512 rows at most
        left -= row["count"]
        if left < 0:
            break
        lowest = row.level
    return max(1, math.ceil(2 ** (lowest / 8) - 1e-9)) if lowest is not None else 1 << 62


def _tail(grams: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` + 1 bytes of byte strings: a context of that order and its byte."""
    return grams & np.uint64((1 << (8 * (order + 1))) - 1)


def _find(among: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where ``keys`` are in the sorted ``among``, -1 for those that are not."""
    if not len(among):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return np.where(among[at] == keys, at, -1)


class Level:
    """Counts of the contexts of one order, from those of the order below."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int, below: Level | None):
        self.code, self.n = _merge(_tail(grams, order), counts)
        self.context, row = np.unique(self.code >> np.uint64(8), return_inverse=True)
        size = len(self.context)
        self.total, self.kinds = np.bincount(row, self.n, size), np.bincount(row, minlength=size).astype(float)
        # what the context one byte shorter counts of the bytes that this one offers itself
        self.shared = np.zeros(size) if below is None else np.bincount(row, below.n[np.searchsorted(below.code, _tail(self.code, order - 1))], size)


def log_probabilities(grams: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of the last byte of each byte string after those before it."""
    p = np.full(len(grams), 1 / 256)
    for order, level in enumerate(levels):
        code = _tail(grams, order)
        at, mine = _find(level.context, code >> np.uint64(8)), _find(level.code, code)
        known = at >= 0
        of = lambda x, i: x[i] * (i >= 0) if len(x) else np.zeros(len(i))
        total, kinds, n = of(level.total, at), of(level.kinds, at), of(level.n, mine)
        if order:
            offered = up_total - of(level.shared, at)  # noqa: F821
            whole = np.where(known, offered, 0)
            escape = np.where(whole > 0, (up_kinds - kinds) / 2 / np.maximum(whole, 1), 1.0)  # noqa: F821
            under = np.where(up_n > 0, (up_n - 0.5) / np.maximum(whole, 1), escape * under)  # noqa: F821
        else:
            under = 1 / np.maximum(256 - kinds, 1)
        bottom = np.maximum(total, 1)
        p = np.where(known, np.where(n > 0, (n - 0.5) / bottom, kinds / 2 / bottom * under), p)
        up_total, up_kinds, up_n = total, kinds, n
    return np.log10(p)


def _modelled(grams: DataFrame) -> DataFrame:
    """``g, n, p``: each byte string, how often it occurs, and the log10 probability of its last byte.

    ``grams(g, c, n)`` are all byte strings of ORDER + 1; those in no training text have a ``c`` of zero.
    """
    short = grams.where("c > 0").groupBy(F.col("g").bitwiseAND(F.lit((1 << (8 * (SHARED + 1))) - 1)).alias("k")).agg(F.sum("c").alias("c")).toArrow()
    keys, counts = short.column("k").to_numpy().astype(np.uint64), short.column("c").to_numpy()
    shared: list[Level] = []
    for order in range(SHARED + 1):
        shared.append(Level(keys, counts, order, shared[-1] if shared else None))
    sent = grams.sparkSession.sparkContext.broadcast(shared)

    def solved(part: pa.Table) -> pa.RecordBatch:
        g, c = part.column("g").to_numpy().astype(np.uint64), part.column("c").to_numpy()
        levels = list(sent.value)
        for order in range(SHARED + 1, ORDER + 1):
            levels.append(Level(g[c > 0], c[c > 0], order, levels[-1]))
        return pa.RecordBatch.from_arrays([part.column("g").combine_chunks(), part.column("n").combine_chunks(), pa.array(log_probabilities(g, levels))], ["g", "n", "p"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = batch.column("x")[-1].as_py()
            # contexts of one end stay together, so only whole ends are passed on
            if sum(b.num_rows for b in held) > HELD and held[0].column("x")[0].as_py() != last:
                every = pa.Table.from_batches(held)
                cut = int(np.searchsorted(every.column("x").to_numpy(), last))
                yield solved(every.slice(0, cut))
                held = every.slice(cut).to_batches()
        if held:
            yield solved(pa.Table.from_batches(held))

    end = F.shiftright("g", 8).bitwiseAND(F.lit((1 << (8 * (SHARED + 1))) - 1)).alias("x")
    return grams.select("g", "c", "n", end).repartition("x").sortWithinPartitions("x").mapInArrow(run, "g bigint, n bigint, p double")


class Head:
    """Log probabilities of the most frequent byte strings, found by hash."""

    MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))

    def __init__(self, grams: np.ndarray, log_p: np.ndarray):
        """``grams`` come most frequent first; the few that find no slot are left out."""
        self.grams, self.log_p = np.r_[np.uint64(1 << 63), grams], np.r_[0.0, log_p]  # place 0 is no string
        self.shift = np.uint64(64 - max(4, math.ceil(math.log2(4 * len(grams) + 1))))
        self.slots, left = [], np.arange(1, len(grams) + 1)
        for m in self.MULTIPLIERS:
            slot = np.zeros(1 << (64 - int(self.shift)), np.int32)
            at, first = np.unique((self.grams[left] * m) >> self.shift, return_index=True)
            slot[at] = left[first]
            left = np.delete(left, first)
            self.slots.append(slot)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Places of byte strings, 0 for those that are not here."""
        one, two = self.slots
        at = one[(grams * self.MULTIPLIERS[0]) >> self.shift]
        rest = np.flatnonzero(self.grams[at] != grams)
        again = two[(grams[rest] * self.MULTIPLIERS[1]) >> self.shift]
        at[rest] = np.where(self.grams[again] == grams[rest], again, 0)
        return at

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, pa.ListArray]:
        """log10 probability of each text's byte strings that are here, and the other strings."""
        out, counts, others = np.zeros(len(texts)), np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)]
        for lo, hi in chunks(texts, PART):
            grams, sizes = _grams(texts[lo:hi])
            at, begin = self.find(grams), np.r_[0, np.cumsum(sizes)[:-1]]
            out[lo:hi] = np.add.reduceat(self.log_p[at], begin)
            missing = np.flatnonzero(at == 0)
            counts[lo:hi] = np.bincount(np.searchsorted(begin, missing, side="right") - 1, minlength=hi - lo)
            others.append(grams[missing].view(np.int64))
        return out, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(np.concatenate(others)))


def adaptive_score(text: bytes, order: int = ORDER) -> float:
    """log10 probability of one text by a trie that starts empty and learns as it reads."""
    data = b" ".join(text.lower().split()) + b"\n"
    trie: dict[bytes, Counter] = {}
    total = 0.0
    for i, byte in enumerate(data):
        barred: set[int] = set()
        for k in range(min(order, i), -1, -1):
            seen = {s: c for s, c in trie.get(data[i - k : i], {}).items() if s not in barred}
            if seen:
                bottom = sum(seen.values())
                if byte in seen:
                    total += math.log10((seen[byte] - 0.5) / bottom)
                    break
                total += math.log10(len(seen) / 2 / bottom)
                barred |= seen.keys()
        else:
            total -= math.log10(256 - len(barred))
        for k in range(min(order, i) + 1):
            trie.setdefault(data[i - k : i], Counter())[byte] += 1
    return total


def language_scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Learns from rows whose crc32 of doc_id as text is not 1 modulo 5.  Tokens are the
    lower-cased words and one end, which counts as a token in training.  ``base_score``
    is the smoothed unigram log10 probability of the tokens, ``score`` that of the
    byte model; both are of the whole text.

    Null and empty texts are the end alone.  A null doc_id is in training.  Repeated
    rows train and are scored each time.  Without training rows the counts are zero
    and the byte model is uniform.  An empty table gives no rows, other columns are
    not read.
    """
    spark = docs.sparkSession
    partial = materialize(_counts(docs), "counts")
    words = materialize(partial.where("w IS NOT NULL").groupBy("w").agg(F.sum("c").alias("c")), "words")
    grams = materialize(partial.where("g IS NOT NULL").groupBy("g").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "grams")
    ends = partial.where("w IS NULL AND g IS NULL").agg(F.sum("c")).first()[0] or 0
    row = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, kinds = (row.n or 0) + ends, row.v + (1 if ends else 0)
    frequent = _above(words, HEAD)
    head = words.where(F.col("c") >= frequent).toArrow()  # HEAD rows at most
    models = materialize(_modelled(grams), "models")
    sure = models.where(F.col("n") >= _above(models, GRAMS, "n")).orderBy(F.desc("n")).toArrow()  # GRAMS rows at most
    strings = Head(sure.column("g").to_numpy().astype(np.uint64), sure.column("p").to_numpy())
    bottom = total + 0.5 * (kinds + 1)
    logs = {w: math.log10((c + 0.5) / bottom) for w, c in zip(head.column("w").to_pylist(), head.column("c").to_pylist())}
    sent = spark.sparkContext.broadcast((logs, strings))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        logs, model = sent.value
        end = math.log10((ends + 0.5) / bottom)
        number = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            rows = []
            for t in texts:
                tokens = t.lower().split()
                found = [logs.get(w) for w in tokens]
                rest = [w for w, x in zip(tokens, found) if x is None]
                hits = [x for x in found if x is not None]
                rows.append((number, len(tokens) + 1, len(hits) + (1 if ends else 0), math.fsum(hits) + end, rest))
                number += 1
            cols = list(zip(*rows)) if rows else [(), (), (), (), ()]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()))
            made = [pa.array(c, t) for c, t in zip(cols, types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *made, *(pa.array(x) if isinstance(x, np.ndarray) else x for x in model.scores(texts))], ["doc_id", "held_out", "rid", "n_tokens", "n_known", "base_score", "rest", "score", "others"])

    schema = f"doc_id {id_type}, held_out boolean, rid bigint, n_tokens bigint, n_known bigint, base_score double, rest array<binary>, score double, others array<bigint>"
    scored = materialize(docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema), "scored")
    rest = scored.select("rid", F.explode("rest").alias("w")).groupBy("rid", "w").agg(F.count("*").alias("k"))
    met = rest.join(words.where(F.col("c") < frequent), "w", "left")
    c = F.coalesce("c", F.lit(0))
    more = met.groupBy("rid").agg(F.sum(F.col("k") * F.log10((c + F.lit(0.5)) / F.lit(bottom))).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("known"))
    others = scored.select("rid", F.explode("others").alias("g")).join(models.select("g", "p"), "g").groupBy("rid").agg(F.sum("p").alias("added"))
    out = scored.drop("rest", "others").join(materialize(more, "more"), "rid", "left").join(materialize(others, "others"), "rid", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("added", F.lit(0.0))).alias("score"),
    )
