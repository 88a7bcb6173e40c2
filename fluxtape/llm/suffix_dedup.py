"""Removal of long repeated strings by suffix sorting, in shards where all copies meet.

A string of ``length`` bytes is owned by the position of the smallest hash among its
substrings of some bytes (the leftmost of equals).  The owner depends on the string
alone, so equal strings have the same owning hash, and neighbouring strings mostly
share one: a text falls into *snippets*, each all strings owned by one position.

Hashes that occur once own nothing that repeats.  Of every other one the different
snippets are cut from their texts, each once with the number of its occurrences, and
dealt by hash to shards.  Each shard is sorted by :mod:`induced`, whose queues and
arrays go to disk past a budget; a string repeats where its suffix has a common prefix
of ``length`` or more with a neighbour, or its snippet occurs again.

A hash with very many different snippets (the edges of a passage that very many
documents share) would make one shard of any size.  Its strings are
compared by 128-bit hashes instead, sixteen neighbours at a time through the bytes they have in
common first and one by one where those repeat, so that no task gets them all.

Texts are told apart by a 128-bit digest, so equal texts are worked on alike.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced import repeated
from .scratch import materialize, release, text_key

#: Different snippets of one hash that a shard takes; with more they are compared by hashes.
CROWD = 2048
#: Neighbouring strings whose common bytes are compared first, in crowded hashes.
GROUP = 16
#: Bytes of one shard, about, and shards for each shuffle partition at least.  A sort takes about 14 bytes of disk a byte.
SHARD_BYTES, SPREAD = 1 << 26, 3
#: Queue entries that a sort keeps in memory, and names that it sorts there; the rest is on disk or sorted in turn.
MEMORY, BASE = 1 << 18, 1 << 20
#: String starts that are worked on at a time in a very long text.
STRETCH = 1 << 22


def gram_size(length: int) -> int:
    """Bytes of the substrings whose smallest hash owns a string: a power of two, about a quarter of it at most."""
    return 1 << ((length // 4).bit_length() - 1)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position, by doubling."""
    padded = np.ascontiguousarray(data)
    h = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
    odd = np.uint64(0x9E3779B97F4A7C15)
    size = 8
    h = h * odd
    h ^= h >> np.uint64(29)
    while size < gram:
        h = (h[: len(h) - size] * np.uint64(0xBF58476D1CE4E5B9)) + (h[size:] ^ (h[size:] >> np.uint64(31)))
        h *= odd
        h ^= h >> np.uint64(32)
        size *= 2
    return h


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by minima from both ends of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    fore = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], fore[width - 1 : n])


def snippets(data: bytes, length: int):
    """``(owner position, first start, last start, owner hash)`` arrays of a text's snippets."""
    out = []
    starts = len(data) - length + 1
    whole, gram = np.frombuffer(data, np.uint8), gram_size(length)
    for at in range(0, max(starts, 0), STRETCH):
        part = whole[at : min(at + STRETCH, starts) + length - 1]
        h = _gram_hashes(part, gram)
        tagged = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        low = _window_min(tagged, length - gram + 1)
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        last = np.r_[first[1:], len(low)] - 1
        owner = (low[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out.append((owner + at, first + at, last + at, h[owner].view(np.int64)))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _texts(column: pa.Array):
    """The texts of a column as bytes, one at a time: a list of all would double a batch."""
    column = column.cast(pa.binary())
    for i in range(len(column)):
        yield column[i].as_py()


def _all_snippets(keyed: DataFrame, length: int) -> DataFrame:
    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for i, text in enumerate(_texts(batch.column("text"))):
                if text is not None and len(text) >= length:
                    owner, first, last, h = snippets(text, length)
                    view = memoryview(text)
                    same = [digest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist())]
                    for col, x in zip(cols, (np.full(len(h), i), _signed(same), first, last, h)):
                        col.append(x)
            if cols[0]:
                row, sh, first, last, h = (np.concatenate(c) for c in cols)
                keys = [batch.column(k).take(pa.array(row)) for k in ("k1", "k2", "did")]
                yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, (h, sh, first, last))], ["k1", "k2", "did", "h", "sh", "s0", "s1"])

    return keyed.mapInArrow(run, "k1 bigint, k2 bigint, did bigint, h bigint, sh bigint, s0 bigint, s1 bigint")


#: Bytes of snippets that go out in one batch.
OUT_BYTES = 1 << 23


def _cut(wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted snippets, from rows that hold a text and a list of them."""

    def run(batches):
        for batch in batches:
            lists = batch.column("wants")
            flat, ends = lists.flatten(), np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            begin, until = flat.field("s0").to_numpy(), flat.field("s1").to_numpy() + length
            held, size, at = [], 0, 0

            def out():
                part = flat.slice(at, len(held))
                return pa.RecordBatch.from_arrays([*(part.field(c) for c in ("h", "sh", "again", "hot")), pa.array(held, pa.binary())], ["h", "sh", "again", "hot", "data"])

            for text, lo, hi in zip(_texts(batch.column("text")), [0, *ends[:-1].tolist()], ends.tolist()):
                for a, b in zip(begin[lo:hi].tolist(), until[lo:hi].tolist()):
                    held.append(text[a:b])
                    size += len(held[-1])
                    if size > OUT_BYTES:
                        yield out()
                        at, held, size = at + len(held), [], 0
            if held:
                yield out()

    return wanted.select("text", "wants").mapInArrow(run, "h bigint, sh bigint, again boolean, hot boolean, data binary")


def _shard_text(batches, file) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Write a shard's snippets to ``file`` as symbols; their keys, sizes, and whether they occur again.

    Bytes are symbols from 2 on, each snippet ends with a 1, and the shard with its only 0.
    """
    keys, sizes, again, seen = [], [], [], set()
    for batch in batches:
        part = []
        for h, sh, more, data in zip(*(batch.column(c).to_pylist() for c in ("h", "sh", "again", "data"))):
            if (h, sh) not in seen:  # a snippet cut from two equal rows is one
                seen.add((h, sh))
                part.append(data)
                keys.append((h, sh))
                again.append(more)
        if part:
            text = np.frombuffer(b"\x00".join(part) + b"\x00", np.uint8).astype(np.int16) + 2
            own = np.array([len(x) for x in part])
            text[np.cumsum(own + 1) - 1] = 1
            text.tofile(file)
            sizes.append(own)
    np.zeros(1, np.int16).tofile(file)
    file.flush()
    return np.array(keys, np.int64).reshape(-1, 2), np.concatenate([np.zeros(0, np.int64), *sizes]), np.array(again, bool)


def _sorted_shards(snips: DataFrame, length: int, shards: int) -> DataFrame:
    """Runs of string starts in each snippet that repeat."""
    options = {"memory": MEMORY, "base": BASE}

    def run(batches):
        with tempfile.TemporaryFile() as file:  # the working memory of this task
            keys, sizes, again = _shard_text(batches, file)
            if not len(keys):
                return
            hit = repeated(np.memmap(file, np.int16, "r"), length, **options)
        begins = np.r_[0, np.cumsum(sizes + 1)]
        at = 0
        while at < len(sizes):
            to = max(int(np.searchsorted(begins, begins[at] + (1 << 20), side="right")) - 1, at + 1)
            lo, hi = begins[at], begins[to]
            inside = np.arange(hi - lo) - np.repeat(begins[at:to] - lo, sizes[at:to] + 1)
            usable = inside <= np.repeat(sizes[at:to] - length, sizes[at:to] + 1)
            mine = usable & (hit[lo:hi] | np.repeat(again[at:to], sizes[at:to] + 1))
            edge = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
            first, last = edge[::2], edge[1::2] - 1
            own = at + np.searchsorted(begins[at:to] - lo, first, side="right") - 1
            inner = begins[own] - lo
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[own, 0], keys[own, 1], first - inner, last - inner)], ["h", "sh", "lo", "hi"])
            at = to

    return snips.repartition(shards, "h").select("h", "sh", "again", "data").mapInArrow(run, "h bigint, sh bigint, lo bigint, hi bigint")


def _crowded(snips: DataFrame, length: int) -> DataFrame:
    """The same for hashes with too many different snippets, without a task that gets all of one."""

    def run(batches):
        short, long = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_intdigest
        wide, long_ = pa.list_(pa.int64()), pa.int64()
        kinds = (long_, long_, pa.bool_(), long_, long_, wide, wide)

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["h", "sh", "again", "core", "lo", "w1", "w2"])

        for batch in batches:
            rows = []
            for h, sh, more, data in zip(*(batch.column(c).to_pylist() for c in ("h", "sh", "again")), _texts(batch.column("data"))):
                starts = len(data) - length + 1
                owner = int(snippets(data, length)[0][0])
                for g in range((owner - starts + 1) // GROUP, owner // GROUP + 1):
                    lo, hi = max(owner - g * GROUP - GROUP + 1, 0), min(owner - g * GROUP, starts - 1)
                    if lo <= hi:
                        core = owner - g * GROUP
                        each = [long(data[p : p + length]) for p in range(lo, hi + 1)]
                        rows.append((h, sh, more, short(data[core : core + length - GROUP + 1]) >> 1, lo, [x >> 65 for x in each], [x & (1 << 63) - 1 for x in each]))
                if len(rows) > 2000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    times = F.sum(F.when(F.col("again"), 2).otherwise(1))
    shape = "h bigint, sh bigint, again boolean, core bigint, lo bigint, w1 array<bigint>, w2 array<bigint>"
    groups = materialize(snips.select("h", "sh", "again", "data").dropDuplicates(["h", "sh"]).mapInArrow(run, shape), "groups")
    cores = materialize(groups.groupBy("h", "core").agg(times.alias("n")).where("n > 1").select("h", "core"), "cores")
    one = groups.join(cores, ["h", "core"]).select("h", "sh", "again", "lo", F.posexplode(F.arrays_zip("w1", "w2")).alias("i", "w"))
    one = materialize(one.select("h", "sh", "again", (F.col("lo") + F.col("i")).alias("at"), "w.w1", "w.w2"), "strings")
    twice = materialize(one.groupBy("h", "w1", "w2").agg(times.alias("n")).where("n > 1").select("h", "w1", "w2"), "twice")
    out = materialize(one.join(twice, ["h", "w1", "w2"]).select("h", "sh", F.col("at").alias("lo"), F.col("at").alias("hi")), "crowded")
    for used in (groups, cores, one, twice):
        release(used)
    return out


def repeat_starts(docs: DataFrame, length: int) -> DataFrame:
    """``(k1, k2, spans)``: for each text with repeats, its runs of starts of repeated strings."""
    spark = docs.sparkSession
    k1, k2 = text_key()
    keyed = docs.select(k1, k2, F.xxhash64("doc_id").alias("did"), "text")
    all_of = materialize(_all_snippets(keyed, length), "snippets")
    often = materialize(all_of.groupBy("h").count().where("count > 1").select("h"), "often")  # a table: so a hot hash is split in the join
    kept = materialize(all_of.join(often, "h"), "kept")
    release(all_of)
    release(often)
    kinds = materialize(kept.groupBy("h", "sh").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "did", "s0", "s1")).alias("at")), "kinds")
    places = materialize(kept.select("k1", "k2", "h", "sh", "s0").distinct(), "places")
    release(kept)
    crowd = materialize(kinds.groupBy("h").count().where(F.col("count") > CROWD).select("h", F.lit(True).alias("hot")), "crowd")  # a small table: snippets are not dealt by hash to look it up
    snip = F.struct("h", "sh", "at.s0", "at.s1", (F.col("n") > 1).alias("again"), F.coalesce("hot", F.lit(False)).alias("hot"))
    wants = kinds.join(crowd, "h", "left").select("at.k1", "at.k2", "at.did", snip.alias("w")).groupBy("k1", "k2", "did").agg(F.collect_list("w").alias("wants"))
    snips = materialize(_cut(keyed.join(wants, ["k1", "k2", "did"]), length), "cut")
    release(kinds)
    release(crowd)
    sums = snips.agg(F.sum(F.when(~F.col("hot"), F.length("data"))).alias("size"), F.bool_or("hot").alias("hot")).first()
    shards = max(SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(sums.size or 0) // SHARD_BYTES))
    found = materialize(_sorted_shards(snips.where("NOT hot"), length, shards), "found")
    crowded = _crowded(snips.where("hot"), length) if sums.hot else None
    release(snips)
    runs = found.union(crowded) if crowded is not None else found
    every = places.join(runs, ["h", "sh"]).select("k1", "k2", (F.col("s0") + F.col("lo")).alias("lo"), (F.col("s0") + F.col("hi")).alias("hi")).distinct()
    spans = materialize(every.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    for used in (places, found, *([crowded] if crowded is not None else [])):
        release(used)
    return spans


def merge_spans(spans, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that start in ``spans``."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 400, as_text: bool = False) -> DataFrame:
    """``doc`` (the row as it was), ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (bytes).

    With ``as_text``, ``kept`` is a string, without the fragments of characters that
    were cut in two.

    Every byte goes that is covered by a string of ``length`` UTF-8 bytes that also
    starts anywhere else in ``docs``, the same text included.  Matches do not cross
    texts, overlaps count, and strings are judged on the input.  ``length`` is at
    least 64.

    A null text is empty, texts shorter than ``length`` are kept whole, and texts of
    any length are worked on whole.  Repeated rows and repeated doc_ids are rows like
    others, so a text of ``length`` bytes or more that occurs twice goes whole.  Null
    doc_ids are kept.  An empty table gives no rows; other columns, whatever their
    names, are only carried in ``doc``.
    """
    if length < 64:
        raise ValueError("length must be at least 64")
    spans = repeat_starts(docs, length)
    k1, k2 = text_key()
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(whole.alias("doc"), k1, k2, F.col("text").alias("own")).join(spans, ["k1", "k2"], "left").select("doc", "own", "spans")
    kind = docs.select(whole.alias("doc")).schema["doc"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, made = whole.slice(at, 500), []
                for text, found in zip(_texts(batch.column("own")), batch.column("spans").to_pylist()):
                    text = text or b""
                    gone = merge_spans([(s["lo"], s["hi"]) for s in found or ()], length)
                    ends = [0, *(b for _, b in gone)]
                    kept = b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in gone), len(text)]))
                    made.append((len(text), len(text) - len(kept), len(gone), kept.decode("utf-8", "ignore") if as_text else kept))
                cols = zip(*made)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, f"doc {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept {"string" if as_text else "binary"}")
