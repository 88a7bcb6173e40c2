"""SimHash near-duplicate classes through the generalised pigeonhole principle.

The 64 fingerprint bits are grouped into partitions so that correlated bits sit
together, and each partition i gets its own threshold t_i >= -1.  If two
fingerprints differ in at most ``max_bits`` places and the sum of (t_i + 1) is
``max_bits + 1``, some partition differs in at most t_i places, so probing every
partition with the values up to t_i away finds every pair.  A dynamic program
picks the thresholds with the smallest estimated number of probes and candidates,
from counts measured over all fingerprints.

A partition value shared by very many fingerprints would give a quadratic number
of candidates.  Those fingerprints are linked instead through the values one bit
away: two fingerprints differ in at most two bits exactly if their one-bit
neighbourhoods meet, and at most 65 fingerprints share such a value.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .features import slices
from .scratch import materialize

BITS = 64
#: A partition value held by more fingerprints than this goes the neighbourhood way.
BUCKET = 48


def shingle_hashes(text: bytes, shingle_words: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of a text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(shingle_words, len(words))
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[k - 1 :])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; zero without hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle_words: int) -> int:
    """SimHash of one text: majority bit over the hashes of its word shingles."""
    return majority(shingle_hashes(text, shingle_words))


def with_fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """``(doc_id, fp)``, one row per row of ``docs``; a null or wordless text has fingerprint zero."""
    id_type = docs.schema["doc_id"].dataType

    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", shingle_words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type.simpleString()}, fp bigint")


def _bit_counts(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits in how many both are set."""

    def run(batches):
        total, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            fps = np.ascontiguousarray(batch.column("fp").to_numpy())
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            total += len(bits)
        if total:
            i, j = np.triu_indices(BITS)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, i]), pa.array(np.r_[-1, j]), pa.array(np.r_[total, both[i, j].astype(np.int64)])], ["i", "j", "n"])

    out, n = np.zeros((BITS, BITS)), 0
    for row in classes.select("fp").mapInArrow(run, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if row.i < 0:
            n = row.n
        else:
            out[row.i, row.j] = out[row.j, row.i] = row.n
    return n, out


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near-equal width; each takes, one at a time, the bit most correlated with it."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    phi = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(left, key=lambda b: (sum(phi[b, c] for c in left), -b))]
        left.discard(group[0])
        while len(group) < size:
            group.append(best := max(left, key=lambda b: (phi[b, group].sum(), -b)))
            left.discard(best)
        out.append(sorted(group))
    return out


def _value(group: list[int]):
    """The bits of ``group``, left in their places: a mask is all the projection that is needed."""
    mask = sum(1 << b for b in group)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) = budget and the least total cost; costs[i][t + 1]."""
    best: list[tuple[float, list[int]]] = [(0.0 if b == 0 else math.inf, []) for b in range(budget + 1)]
    for row in costs:
        best = [min(((best[b - u][0] + row[u], [*best[b - u][1], u - 1]) for u in range(b + 1) if u < len(row)), key=lambda x: x[0]) for b in range(budget + 1)]
    return best[budget]


def plan(classes: DataFrame, max_bits: int) -> list[tuple[list[int], int]]:
    """``(bits, threshold)`` of each partition that is probed."""
    n, both = _bit_counts(classes)
    options = {m: group_bits(n, both, m) for m in (2, 3, 4)}
    keys = F.array(*(F.struct(F.lit(f"{m}.{i}").alias("part"), _value(g).alias("v")) for m, groups in options.items() for i, g in enumerate(groups)))
    sizes = classes.select(F.explode(keys).alias("k")).groupBy("k.part", "k.v").count()
    pairs = {r.part: float(r.pairs or 0) for r in sizes.groupBy("part").agg(F.sum(F.col("count") * F.least("count", F.lit(BUCKET)) / 2).alias("pairs")).collect()}
    p = both.diagonal() / max(n, 1)
    apart = 2 * p * (1 - p)

    def cost(m: int, i: int) -> list[float]:
        group = options[m][i]
        chance = np.array([1.0])
        for b in group:
            chance = np.convolve(chance, [1 - apart[b], apart[b]])
        out = [0.0]
        for t in range(max_bits + 1):
            probes = n * (sum(math.comb(len(group), d) for d in range(t + 1)) + 1)
            out.append(probes + pairs.get(f"{m}.{i}", 0.0) * chance[: t + 1].sum() / max(chance[0], 1e-12))
        return out

    found = {m: allocate([cost(m, i) for i in range(m)], max_bits + 1) for m in options}
    m = min(found, key=lambda k: (found[k][0], k))
    return [(g, t) for g, t in zip(options[m], found[m][1]) if t >= 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(group: list[int], distance: int) -> list[int]:
    """XOR masks of up to ``distance`` bits of ``group``."""
    return [_signed(sum(1 << b for b in c)) for d in range(distance + 1) for c in itertools.combinations(group, d)]


def _probes(part: int, group: list[int], threshold: int):
    """Every value of a partition within ``threshold`` bits of the row's own."""
    masks = F.array(*(F.lit(x) for x in _flips(group, threshold)))
    return F.transform(masks, lambda x: F.struct(F.lit(part).alias("part"), _value(group).bitwiseXOR(x).alias("v")))


def links(classes: DataFrame, max_bits: int = 2) -> DataFrame:
    """``(a, b)`` fingerprints that differ in at most ``max_bits`` of 64 bits, enough of them to connect all that are linked.

    ``classes(fp)`` holds distinct fingerprints.  ``max_bits`` is 0, 1 or 2.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits is 0, 1 or 2")
    spark = classes.sparkSession
    if max_bits == 0:
        return spark.createDataFrame([], "a bigint, b bigint")
    chosen = plan(classes, max_bits)
    home = F.array(*(F.struct(F.lit(i).alias("part"), _value(g).alias("v")) for i, (g, _) in enumerate(chosen)))
    homes = classes.select("fp", F.explode(home).alias("k")).select("fp", "k.part", "k.v")
    hot = materialize(homes.groupBy("part", "v").count().where(F.col("count") > BUCKET).select("part", "v", F.lit(True).alias("hot")), "hot")
    probe = F.flatten(F.array(*(_probes(i, g, t) for i, (g, t) in enumerate(chosen))))
    probes = classes.select("fp", F.explode(probe).alias("k")).select("fp", "k.part", "k.v")
    probes = probes.join(hot, ["part", "v"], "left")
    cool = probes.where("hot IS NULL").select("part", "v", F.col("fp").alias("a"))
    found = cool.join(homes.select("part", "v", F.col("fp").alias("b")), ["part", "v"]).where("a <> b")
    found = found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")
    crowded = probes.where("hot").select("fp").distinct()
    near = crowded.select("fp", F.explode(F.transform(F.array(*(F.lit(x) for x in _flips(list(range(BITS)), 1))), lambda x: F.col("fp").bitwiseXOR(x))).alias("z"))
    if max_bits == 2:
        met = near.groupBy("z").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
        star = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    else:
        star = near.select(F.col("fp").alias("a"), "z").join(crowded.select(F.col("fp").alias("z")), "z").where("a <> z").select("a", F.col("z").alias("b"))
    return found.union(star)


def components_of(marked: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of each row of ``marked``, from links ``(a, b)`` of fingerprints."""
    return named_by(marked, classes, materialize(connected_components(edges), "roots"))


def named_by(marked: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Each row of ``marked`` with its ``component_id``, from the ``(node, root)`` of linked classes ``fp``."""
    linked = roots.select(F.col("node").alias("fp"), "root").join(classes, "fp")
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("low"))
    lows = linked.join(lowest, "root").select("fp", "low")
    named = classes.join(lows, "fp", "left").select("fp", F.coalesce("low", "first_id").alias("component_id"))
    return marked.join(named, "fp").select(*marked.columns, "component_id")


def as_hex(name: str = "fp"):
    return F.lower(F.lpad(F.hex(name), 16, "0")).alias("fingerprint")


def near_duplicate_classes(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint``, ``component_id``.

    Text is lower-cased in A-Z, split at ASCII white space, and hashed as
    ``shingle_words``-word shingles, repeats included; a shorter text is one shingle.
    Fingerprints that differ in at most ``max_bits`` bits are linked, and component_id
    is the smallest doc_id that can be reached through links.

    Null and wordless texts have fingerprint zero and are linked like any other.  A
    null doc_id keeps its row and takes its component from the others; a component
    of null doc_ids alone has a null component_id.  Repeated rows are all returned.
    An empty table gives an empty result, and columns other than doc_id and text are
    not read.
    """
    marked = materialize(with_fingerprints(docs, shingle_words), "fp")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    return components_of(marked, classes, links(classes.select("fp"), max_bits)).select("doc_id", as_hex(), "component_id")
