"""Near-duplicate classes by a similarity of word shingles, on top of SimHash links.

Two texts whose five-word shingles have a Jaccard similarity of 0.8 differ in about
ten of 64 SimHash bits.  No allocation of pigeonhole thresholds finds that many
without comparing a fixed share of all pairs, so besides the pairs within a few bits
a min-wise sketch proposes pairs.  The shingle sets themselves confirm every pair of
either kind, and the classes are the connected components of the confirmed ones.

A fingerprint counts repeats and a set doesn't, so texts of one fingerprint can have
little in common.  What is compared are the distinct sets, named by a digest ``fp``;
equal fingerprints, and those within a few bits, are values that sets share like
those of the sketch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .features import slices
from .scratch import materialize, release, text_key
from .simhash import as_hex, links, majority, named_by, shingle_hashes

#: A pair of similarity s shares one of BANDS values of ROWS minima with 1 - (1 - s^ROWS)^BANDS: 0.998 at 0.8.
BANDS, ROWS = 16, 5
#: All pairs of a band value are compared up to this many sets.  Beyond it each is compared with LEADERS
#: of them first, and then with all those that no chain of links has joined it to.
PAIRED, LEADERS = 16, 4
#: Sets of such a value that one task compares with the others.
BLOCK = 256
#: Longs of the bitmap of a set, which bounds from above how much two sets can share.
LONGS = 16

_RANDOM = np.random.default_rng(20)
_ODD = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS values of a set of shingle hashes, the band's number mixed in; none for no hashes."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        low = np.minimum(low, ((hashes[at : at + 2048, None] ^ _FLIP) * _ODD).min(axis=0))
    value = np.arange(BANDS, dtype=np.uint64)
    for x in low.reshape(BANDS, ROWS).T:
        value = (value ^ x) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value.view(np.int64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """One bit for each value of the low bits of the hashes, as LONGS longs."""
    seen = np.zeros(LONGS * 64, bool)
    seen[hashes & np.uint64(LONGS * 64 - 1)] = True
    return np.packbits(seen).view(np.int64)


def set_key(distinct: np.ndarray) -> int:
    """A 64-bit digest of a set of shingle hashes in order."""
    return xxhash.xxh64_intdigest(distinct.tobytes(), 42)


def _sketched(docs: DataFrame, shingle_words: int) -> DataFrame:
    """``doc_id``, the row's key ``did, k1, k2``, and the sketch of each row's text."""
    keys = ["doc_id", "did", "k1", "k2"]
    kinds = ", ".join(f"{k} {t}" for k, t in zip(keys, (docs.schema["doc_id"].dataType.simpleString(), "string", "bigint", "bigint")))

    def run(batches):
        for batch in batches:
            fps, sims, sketches, sizes, maps = [], [], [], [], []
            column = batch.column("text").cast(pa.binary())
            for i in range(len(column)):
                hashes = shingle_hashes(column[i].as_py() or b"", shingle_words)
                sims.append(majority(hashes))
                hashes = np.unique(hashes)
                fps.append(set_key(hashes))
                sketches.append(bands(hashes))
                sizes.append(len(hashes))
                maps.append(bitmap(hashes))
            cuts = pa.array(np.r_[0, np.cumsum([len(x) for x in sketches])].astype(np.int32))
            lists = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([np.zeros(0, np.int64), *sketches])))
            seen = pa.ListArray.from_arrays(pa.array(np.arange(len(maps) + 1, dtype=np.int32) * LONGS), pa.array(np.concatenate([np.zeros(0, np.int64), *maps])))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, sims)), lists, pa.array(sizes, pa.int32()), seen], [*keys, "fp", "sim", "bands", "size", "map"])

    return docs.select(*keys, "text").mapInArrow(run, f"{kinds}, fp bigint, sim bigint, bands array<bigint>, size int, map array<bigint>")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, did, k1, k2, text``: did is the id as text, empty for a null one, and k1 and k2 tell texts apart."""
    k1, k2 = text_key()
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("did"), k1, k2, "text")


def _sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """``fp``, ``shingles``: the distinct shingle hashes of each row."""

    def run(batches):
        for batch in slices(batches):
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                hashes = np.unique(shingle_hashes(t or b"", shingle_words))
                one = pa.array([hashes.view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.array([set_key(hashes)], np.uint64).view(np.int64)), one], ["fp", "shingles"])

    return docs.select("text").mapInArrow(run, "fp bigint, shingles array<bigint>")


def _by_fingerprint(sims: DataFrame, max_bits: int) -> DataFrame:
    """``fp``, ``size``, ``v``: a value for each fingerprint, and one for each two that differ in at most ``max_bits`` bits.

    ``sims(fp, size, sim)`` are the fingerprints of the texts of each set.
    """
    near = links(sims.select(F.col("sim").alias("fp")).distinct(), max_bits)
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = near.select(F.xxhash64(F.lit("near"), "a", "b").alias("v"), F.explode(F.array("a", "b")).alias("sim"))
    own = sims.select("fp", "size", F.xxhash64(F.lit("same"), "sim").alias("v"))
    return own.union(sims.join(ends, "sim").select("fp", "size", "v").distinct())


def _met(classes: DataFrame, more: DataFrame) -> DataFrame:
    """``v``, ``fp``, ``size`` of the values that sets share, with their number ``n`` and ``leaders``.

    The values are the bands, and those of ``more(fp, size, v)``.
    """
    rows = classes.select("fp", "size", F.explode("bands").alias("v")).union(more.select("fp", "size", "v"))
    order = [F.min(F.struct(F.xxhash64("fp", "v", F.lit(i)).alias("o"), "fp", "size")).alias(f"l{i}") for i in range(LEADERS)]
    shared = rows.groupBy("v").agg(F.count("*").alias("n"), *order).where("n > 1")
    leaders = F.array_distinct(F.array(*(F.struct(f"l{i}.fp", f"l{i}.size") for i in range(LEADERS))))
    return materialize(rows.join(shared.select("v", "n", leaders.alias("leaders")), "v"), "met")


def _ordered(pairs: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``, a < b, of ``(fp, size, other, other_size)`` whose sizes allow the similarity."""
    fit = pairs.where("fp <> other").where(F.least("size", "other_size") >= similarity * F.greatest("size", "other_size"))
    return fit.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))


def _candidates(met: DataFrame, similarity: float) -> DataFrame:
    """All pairs of the values of few sets, and each set with the leaders of the rest."""
    star = met.where(F.col("n") > PAIRED).select("fp", "size", F.explode("leaders").alias("l")).select("fp", "size", F.col("l.fp").alias("other"), F.col("l.size").alias("other_size"))
    few = met.where(F.col("n") <= PAIRED).select("fp", "size", "v")
    pairs = few.join(few.select(F.col("fp").alias("other"), F.col("size").alias("other_size"), "v"), "v")
    return _ordered(star.union(pairs.select(*star.columns)), similarity)


def _may_be_similar(similarity: float):
    """False only for sets too different: a bit of one bitmap alone is a member of that set alone."""
    alone = lambda x, y: sum((F.bit_count(F.col(f"{x}{i}").bitwiseAND(F.bitwise_not(f"{y}{i}"))) for i in range(LONGS)), F.lit(0))
    joint = F.least(F.col("size") - alone("m", "o"), F.col("other_size") - alone("o", "m"))
    return joint * (1 + similarity) >= similarity * (F.col("size") + F.col("other_size")) - 1e-6


def _unjoined(classes: DataFrame, met: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """The pairs that share a band value of many, are in different components so far and may be similar.

    Within a value the members of its largest component are only compared with the
    others.  Members are dealt into blocks of about BLOCK, so no task meets a whole value.
    """
    crowd = met.where(F.col("n") > PAIRED).select("fp", "size", "v").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    crowd = crowd.withColumn("root", F.coalesce("root", "fp"))
    parts = crowd.groupBy("v", "root").agg(F.count("*").alias("m"))
    main = parts.groupBy("v").agg(F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("n"), F.count("*").alias("k"))
    split = main.where("k > 1").select("v", F.col("main.root").alias("main"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    maps = classes.select("fp", *(F.col("map")[i].alias(f"m{i}") for i in range(LONGS)))
    rest = materialize(crowd.join(split, "v").join(maps, "fp"), "rest")
    bits = [F.col(f"m{i}").alias(f"o{i}") for i in range(LONGS)]
    some = rest.where("root <> main").select("v", "fp", "size", "root", F.pmod(F.xxhash64("fp"), "blocks").alias("block"), *(f"m{i}" for i in range(LONGS)))
    every = rest.select("v", F.col("fp").alias("other"), F.col("size").alias("other_size"), F.col("root").alias("other_root"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), *bits)
    return _ordered(some.join(every, ["v", "block"]).where("root <> other_root").where(_may_be_similar(similarity)), similarity)


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose shingle sets are as similar as that; a written table."""
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    wanted = materialize(ends.join(classes.select("fp", "did", "k1", "k2"), "fp"), "wanted")
    texts = docs.join(wanted.select("did", "k1", "k2"), ["did", "k1", "k2"], "left_semi")
    sets = materialize(_sets(texts, shingle_words).join(wanted.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.max("shingles").alias("s")), "sets")
    one, two = (sets.select(F.col("fp").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    joint = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(one, "a").join(two, "b").where(joint >= similarity * (F.size("sa") + F.size("sb") - joint)).select("a", "b")
    found = materialize(found, "found")
    release(wanted)
    release(sets)
    return found


def similarity_roots(docs: DataFrame, classes: DataFrame, more: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """``(node, root)`` of the sets that links join: those with a Jaccard similarity of ``similarity`` or more.

    ``classes(fp, did, k1, k2, bands, size, map)`` has one row per set, which is read from the row of
    ``docs(did, k1, k2, text)`` with that key.  ``more(fp, size, v)`` are values whose sets are
    compared besides those of the sketches.
    """
    met = _met(classes, more)
    pairs = materialize(_candidates(met, similarity).distinct(), "pairs")
    found = _confirmed(docs, classes, pairs, shingle_words, similarity)
    release(pairs)
    roots = materialize(connected_components(found), "roots")
    release(found)
    rest = materialize(_unjoined(classes, met, roots, similarity).distinct(), "pairs")
    release(met)
    if rest.isEmpty():
        return roots
    found = _confirmed(docs, classes, rest, shingle_words, similarity)
    release(rest)
    if found.isEmpty():
        return roots
    return materialize(connected_components(found.union(roots.select("node", "root"))), "roots")


def _classed(docs: DataFrame, shingle_words: int, similarity: float, max_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their key and set ``fp``, sets with their first row, and the ``(node, root)`` of linked sets; written tables."""
    docs = keyed(docs)
    marked = materialize(_sketched(docs, shingle_words), "sketched")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "did", "k1", "k2", "bands", "size", "map")).alias("m")
    wide = materialize(marked.groupBy("fp").agg(first).select("fp", "m.*"), "classes")
    sims = materialize(marked.select("fp", "sim").distinct().join(wide.select("fp", "size"), "fp"), "sims")
    roots = similarity_roots(docs, wide, _by_fingerprint(sims, max_bits), shingle_words, similarity)
    rows = materialize(marked.select("doc_id", "did", "k1", "k2", "fp", "sim"), "rows")
    classes = materialize(wide.select("fp", "none", "doc_id", "did", "k1", "k2"), "narrow")
    for used in (marked, wide, sims):
        release(used)
    return rows, classes, roots


def similar_classes(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint``, ``component_id``.

    Texts are linked if the sets of their ``shingle_words``-word shingles have a Jaccard
    similarity of ``similarity`` or more.  Such pairs are found if their fingerprints
    differ in at most ``max_bits`` bits, and else with a chance of 0.998 at 0.8 and more above:
    of those that share a value of the sketch every pair is compared, however many share
    it, but for pairs that other links have joined already.
    component_id is the smallest doc_id that can be reached through links.  Texts of
    one shingle set, by a 64-bit digest of it, are one class.

    Null and wordless texts have fingerprint zero and are one class.  A
    null doc_id keeps its row and takes its component from the others; a component
    of null doc_ids alone has a null component_id.  Repeated rows are all returned.
    An empty table gives an empty result, and columns other than doc_id and text are
    not read.
    """
    rows, classes, roots = _classed(docs, shingle_words, similarity, max_bits)
    return named_by(rows.select("doc_id", "fp", "sim"), classes.select("fp", F.col("doc_id").alias("first_id")), roots).select("doc_id", as_hex("sim"), "component_id")


def one_of_each(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, max_bits: int = 2) -> DataFrame:
    """One row of ``docs``, with all its columns, of each class of :func:`similar_classes`.

    It is the row of the smallest doc_id, null ones last, and among texts of one doc_id that
    of the smallest digest; so a doc_id on several rows counts each of its texts by itself,
    and rows without one take part like others.  Of repeated rows with one doc_id and text any one
    stays.  Null and wordless texts are one class, so one of them stays.
    """
    rows, classes, roots = _classed(docs, shingle_words, similarity, max_bits)
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = joined.groupBy("root").agg(F.min(F.struct("none", "doc_id", "did", "k1", "k2")).alias("m")).select("m.did", "m.k1", "m.k2")
    times = rows.groupBy("did", "k1", "k2").agg(F.count("*").alias("times"))
    first = materialize(first.join(times, ["did", "k1", "k2"]), "first")
    k1, k2 = text_key()
    keys = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("did"), k1, k2)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), keys.alias("key")).select("doc", "key.*")
    once = whole.join(first.where("times = 1"), ["did", "k1", "k2"], "left_semi")
    several = whole.join(first.where("times > 1"), ["did", "k1", "k2"], "left_semi").dropDuplicates(["did", "k1", "k2"])
    return once.select("doc.*").union(several.select("doc.*"))
