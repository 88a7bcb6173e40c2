"""A Merkle manifest of a dataset: a root, and a proof for every row.

Rows are sorted by group and order key into an RDD of ranges.  The rows that each partition
holds of its first and last group give the offset of every group in every partition, so each row
knows its coordinate (group, level, index) in its group's tree.  A partition builds
the complete aligned subtrees that lie inside it, in chunks of bounded size.  Only their top nodes
are shuffled, by the coordinate of an ancestor a few levels up, until each group has its
subroot; subroots are the leaves of one more tree.  Proofs go down the same way: each
chunk meets the siblings above it by its own coordinate, and its leaves are unpacked with their proofs.

Nothing is sent to all tasks but three numbers for each partition, and no task takes a group whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import materialize, release

ARITY, BITS = 8, 3
#: Levels of a subtree that is one chunk (4096 leaves), and levels that later rounds climb at a time (512 nodes).
CHUNK, CLIMB = 4, 3
#: Rows of a partition of the sorted RDD, at most as expected; and at least, where there are idle cores.
ROWS, FEW = 1 << 18, 1 << 11
SIDE = 32

NODE = "g string, height int, level int, idx bigint, digest binary"
STEP = "g string, height int, level int, idx bigint, digest binary, up_level int, up_idx bigint, segment binary"


def leaf_digest(fields: Iterable[Column]) -> Column:
    """SHA-256 in hex of fields, each as its bytes in UTF-8 after their number and ``:``, or ``-`` for null."""

    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)), 256)


def _hash(digests: Iterable[bytes]) -> bytes:
    """The digest of digests, which are concatenated as hex text."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def _height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    k = 0
    while ARITY**k < leaves:
        k += 1
    return k


def fold(leaf: str, steps: Iterable[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its proof give: each step is the leaf's place among the siblings that it lists."""
    for place, siblings in steps:
        leaf = hashlib.sha256("".join([*siblings[:place], leaf, *siblings[place:]]).encode()).hexdigest()
    return leaf


def _plan(summary: list[tuple]) -> dict[int, tuple[int, int, int]]:
    """For each partition: rows of its first group in earlier ones, and all rows of its first and last group."""
    totals: dict[str, int] = {}
    before: dict[int, int] = {}
    for at, first, n, last, m, groups in sorted(summary):
        before[at] = totals.get(first, 0)
        totals[first] = totals.get(first, 0) + n
        if groups > 1:
            totals[last] = totals.get(last, 0) + m
    return {at: (before[at], totals[first], totals[last]) for at, first, _, last, _, _ in summary}


def _summary(at: int, rows: Iterable) -> Iterator[tuple]:
    first = None
    groups = 0
    for g, own in groupby(rows, itemgetter(0)):
        last, m = g, sum(1 for _ in own)
        first = first or (g, m)
        groups += 1
    if first:
        yield at, *first, last, m, groups


def _complete(level: int, idx: int, lo: int, hi: int, total: int) -> Iterator[tuple[int, int, int, int]]:
    """Largest nodes at or below one whose leaves all lie in ``[lo, hi)``, with their ranges of leaves."""
    start, end = idx * ARITY**level, min((idx + 1) * ARITY**level, total)
    if start >= end or end <= lo or hi <= start:
        return
    if lo <= start and end <= hi:
        yield level, idx, start, end
    else:
        for child in range(idx * ARITY, idx * ARITY + ARITY):
            yield from _complete(level - 1, child, lo, hi, total)


def _levels(leaves: list[bytes], height: int) -> list[list[bytes]]:
    out = [leaves]
    for _ in range(height):
        out.append([_hash(out[-1][i : i + ARITY]) for i in range(0, len(out[-1]), ARITY)])
    return out


def _chunks(at: int, rows: Iterable, plan: dict[int, tuple[int, int, int]], groups: dict[int, int], top: int) -> Iterator[tuple]:
    """Chunks of one partition: coordinate and digest of a complete subtree of ``top`` levels at most, and its leaves."""
    for number, (g, own) in enumerate(groupby(rows, itemgetter(0))):
        offset, first_total, last_total = plan[at]
        pos = offset if number == 0 else 0
        if number == 0:
            total = first_total
        elif number == groups[at] - 1:
            total = last_total
        else:  # a group between others ends here
            own = list(own)
            total = len(own)
        height, size = _height(total), ARITY**top
        held: list = []

        def packed() -> Iterator[tuple]:
            lo = pos - len(held)
            for level, idx, start, end in _complete(min(top, height), lo // size, lo, pos, total):
                part = held[start - lo : end - lo]
                leaves = [bytes(r[2]) for r in part]
                shown = b"".join(bytes(32) if r[3] is None else bytes(r[3]) for r in part)
                yield g, height, level, idx, _levels(leaves, level)[-1][0], [r[1] for r in part], b"".join(leaves), shown, bytes(r[3] is not None for r in part)

        for row in own:
            held.append(row)
            pos += 1
            if pos % size == 0:
                yield from packed()
                held = []
        if held:
            yield from packed()


def _climber(target: int):
    """Builds the nodes of one ancestor, ``target`` levels up or the group's subroot: a step for each node given, and the ancestor."""

    def climb(table: pa.Table) -> pa.Table:
        given = [(r["level"], r["idx"], bytes(r["digest"])) for r in table.to_pylist()]
        g, height = table["g"][0].as_py(), table["height"][0].as_py()
        top = min(target, height)
        nodes: dict[int, dict[int, bytes]] = {}
        for level, idx, digest in given:
            nodes.setdefault(level, {})[idx] = digest
        steps: dict[tuple[int, int], bytes] = {}
        for level in range(min(nodes), top):
            runs: dict[int, list[int]] = {}
            for idx in sorted(nodes.get(level, ())):
                runs.setdefault(idx // ARITY, []).append(idx)
            for parent, run in runs.items():
                digests = [nodes[level][i] for i in run]
                nodes.setdefault(level + 1, {})[parent] = _hash(digests)
                for place, i in enumerate(run):
                    steps[level, i] = bytes([place, len(run)]) + b"".join(digests[:place] + digests[place + 1 :])
        ((up, digest),) = nodes[top].items()
        out = []
        for level, idx, own in given:
            way, i = [], idx
            for k in range(level, top):
                way.append(steps[k, i])
                i //= ARITY
            out.append((g, height, level, idx, own, top, up, b"".join(way)))
        out.append((g, height, top, up, digest, None, None, None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()))], STEP_NAMES)

    return climb


STEP_NAMES = [c.split()[0] for c in STEP.split(", ")]


def _steps(data: bytes) -> list[tuple[int, list[str]]]:
    """Packed steps as places and siblings."""
    out, at = [], 0
    while at < len(data):
        place, size = data[at], data[at + 1]
        end = at + 2 + SIDE * (size - 1)
        out.append((place, [data[i : i + SIDE].hex() for i in range(at + 2, end, SIDE)]))
        at = end
    return out


def _forest(leaves: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Chunks of the trees of all groups, their subroots, and the tables of steps by round, lowest first.

    ``leaves`` holds g (no nulls), ord, leaf, shown and rid, a number that tells equal rows apart.
    """
    spark = leaves.sparkSession
    rows = leaves.count()
    parts = max(-(-rows // ROWS), min(2 * spark.sparkContext.defaultParallelism, rows // FEW + 1))
    order = [F.col("g"), F.col("ord").asc_nulls_first(), F.col("leaf"), F.col("rid")]
    # one RDD for both passes: its ranges are drawn once, and lost partitions are made again by them
    ranged = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("g", "ord", "leaf", "shown").rdd
    summary = ranged.mapPartitionsWithIndex(_summary).collect()  # one row for each partition
    sent = spark.sparkContext.broadcast((_plan(summary), {s[0]: s[5] for s in summary}))
    made = ranged.mapPartitionsWithIndex(lambda at, own, top=CHUNK: _chunks(at, own, *sent.value, top))
    kind = leaves.schema["ord"].dataType.simpleString()
    chunks = materialize(spark.createDataFrame(made, f"{NODE}, ords array<{kind}>, leaves binary, shown binary, differs binary", verifySchema=False), "chunks")
    tallest = chunks.agg(F.max("height").alias("h")).first().h or 0
    nodes, rounds, target = chunks.select("g", "height", "level", "idx", "digest"), [], CHUNK
    tops = [nodes.where("level = height")]
    while True:
        goal = f"least({target}, height)"
        ancestor = F.expr(f"shiftright(idx, {BITS} * ({goal} - level))")
        climbed = materialize(nodes.where(f"level < {goal}").groupBy("g", ancestor.alias("up")).applyInArrow(_climber(target), STEP), "climbed")
        rounds.append(climbed.where("up_level is not null"))
        made = climbed.where("up_level is null").select("g", "height", "level", "idx", "digest")
        tops.append(made.where("level = height"))
        if target >= tallest:
            break
        # nodes that were whole at this level before climb with the ones just made
        nodes = made.unionByName(nodes.where(f"level = {target}")).where("level < height")
        target += CLIMB
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    return chunks, subroots, rounds


def _with_ways(chunks: DataFrame, tops: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """Chunks with the packed steps from their top node to the root, and their subroot.

    ``tops`` holds g, height, level, idx, subroot and way (the steps above the subroot).
    """
    known = tops.select("g", "level", "idx", "subroot", "way")
    for climbed in reversed(rounds):
        above = known.select("g", F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), "subroot", "way")
        below = climbed.join(above, ["g", "up_level", "up_idx"]).select("g", "level", "idx", "subroot", F.concat("segment", "way").alias("way"))
        known = known.unionByName(below)
    return chunks.drop("digest").join(known, ["g", "level", "idx"])


def _schema(kind: str, proofs: bool) -> str:
    return f"g string, ord {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", proof array<struct<place:int,siblings:array<string>>>" if proofs else "")


def _unpacked(ways: DataFrame, kind: str, root: str, proofs: bool) -> DataFrame:
    """One row for each leaf of the chunks, with its proof and what folding it gives."""
    schema = _schema(kind, proofs)
    empty = ways.sparkSession.createDataFrame([], schema).schema
    types, names = [to_arrow_type(f.dataType) for f in empty.fields], empty.names

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pydict()
                data, shown, differs, level = row["leaves"][0], row["shown"][0], row["differs"][0], row["level"][0]
                leaves = [data[k : k + SIDE] for k in range(0, len(data), SIDE)]
                levels = [[d.hex() for d in nodes] for nodes in _levels(leaves, level)[:-1]]
                around = []  # what stands left and right of each node in its run
                for nodes in levels:
                    runs = [(k % ARITY, nodes[k - k % ARITY : k - k % ARITY + ARITY]) for k in range(len(nodes))]
                    around.append([("".join(run[:p]), "".join(run[p + 1 :])) for p, run in runs])
                above = _steps(row["way"][0])
                top = [("".join(s[:p]), "".join(s[p:])) for p, s in above]
                tail = "".join(a + b for a, b in top)
                out = []
                for k, leaf in enumerate(leaves):
                    own = [around[h][k // ARITY**h] for h in range(level)]
                    seen = shown[k * SIDE : k * SIDE + SIDE] if differs[k] else leaf
                    folded = seen.hex()
                    for a, b in (*own, *top):
                        folded = hashlib.sha256((a + folded + b).encode()).hexdigest()
                    proof = hashlib.sha256(("".join([a + b for a, b in own]) + tail).encode()).hexdigest()
                    made = [row["g"][0], row["ords"][0][k], leaf.hex(), row["subroot"][0].hex(), root, proof, folded, folded == root]
                    if proofs:
                        local = [(k // ARITY**h % ARITY, [a[x : x + 64] for a in own[h] for x in range(0, len(a), 64)]) for h in range(level)]
                        made.append([{"place": p, "siblings": s} for p, s in (*local, *above)])
                    out.append(made)
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return ways.select("g", "level", "ords", "leaves", "shown", "differs", "subroot", "way").mapInArrow(run, schema)


def manifest(docs: DataFrame, fields: list[str] | None = None, group: str = "lang", order: str = "doc_id", presented: dict[str, Column] | None = None, proofs: bool = False) -> DataFrame:
    """``order`` column, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` of every row.

    A leaf is the digest of ``fields`` (doc_id, source, lang, n_chars, text).  Leaves ascend by ``order`` within
    their ``group``, nulls first; equal keys ascend by their digests, and which of wholly equal rows has which
    place is not defined, the returned rows as a whole are.  Groups ascend by the bytes of their names,
    null first.  ``presented`` gives fields as somebody shows them now: ``folded_root`` is made from the leaf
    of those and the original siblings, and ``verified`` tells whether it is the root.  With
    ``proofs`` there is ``proof``, place and siblings from the leaf up, as :func:`fold` takes them.  A single row has
    an empty proof and is its own root.  Null and empty texts are told apart; long ones are hashed where they are read and
    go no further.  An empty table gives no rows.  Other columns are not read.
    """
    fields = fields or ["doc_id", "source", "lang", "n_chars", "text"]
    as_is = {c: F.col(f"`{c}`") for c in fields}
    shown = leaf_digest([(presented or {}).get(c, as_is[c]) for c in fields]) if presented else F.lit(None).cast("string")
    g = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))  # null first
    rows = docs.select(g.alias("g"), F.col(f"`{order}`").alias("ord"), F.unhex(leaf_digest(as_is.values())).alias("leaf"), F.unhex(shown).alias("shown"))
    leaves = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "leaves")
    kind = leaves.schema["ord"].dataType.simpleString()
    chunks, subroots, rounds = _forest(leaves)
    release(leaves)
    # the tree of the subroots: one group, ordered by the groups' names
    tops = subroots.select(F.lit("").alias("g"), F.col("g").alias("ord"), F.col("digest").alias("leaf"), F.lit(None).cast("binary").alias("shown"), F.lit(0).cast("bigint").alias("rid"))
    above, roots, upper = _forest(materialize(tops, "subroots"))
    root = roots.first()
    if root is None:
        return docs.sparkSession.createDataFrame([], _schema(kind, proofs)).drop("g").withColumnRenamed("ord", order)
    by_group = _group_ways(_with_ways(above, roots.select("*", F.col("digest").alias("subroot"), F.lit(b"").alias("way")), upper))
    tops = subroots.withColumnRenamed("digest", "subroot").join(by_group, "g")
    done = _unpacked(_with_ways(chunks, tops, rounds), kind, bytes(root.digest).hex(), proofs)
    return done.drop("g").withColumnRenamed("ord", order)


def _group_ways(ways: DataFrame) -> DataFrame:
    """The packed steps from each group's subroot to the root."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pydict()
                data, level = row["leaves"][0], row["level"][0]
                levels = _levels([data[k : k + SIDE] for k in range(0, len(data), SIDE)], level)[:-1]
                found = []
                for k in range(len(row["ords"][0])):
                    way = b""
                    for h, nodes in enumerate(levels):
                        at = k // ARITY**h
                        run_ = nodes[at - at % ARITY : at - at % ARITY + ARITY]
                        way += bytes([at % ARITY, len(run_)]) + b"".join(d for x, d in enumerate(run_) if x != at % ARITY)
                    found.append(way + row["way"][0])
                yield pa.RecordBatch.from_arrays([pa.array(row["ords"][0], pa.string()), pa.array(found, pa.binary())], ["g", "way"])

    return ways.select("ords", "level", "leaves", "way").mapInArrow(run, "g string, way binary")


def _sql(levels: int = 8, upper: int = 3) -> str:
    """The manifest of ``documents`` in SQL, for up to 8^levels rows of a language and 8^upper languages."""
    eight = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: xor(c >> 8, {eight.replace('xor(c, b)', 'xor(c, b) & 255')}))"
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    fields = ["doc_id", "source", "lang", "n_chars"]
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"leaves AS (SELECT *, sha256({' || '.join(map(part, [*fields, 'text']))}) AS leaf, sha256({' || '.join(map(part, [*fields, lower]))}) AS lowered, xor(4294967295, {crc}) % 3 = 0 AS tampered FROM documents)",
        "t0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS digest, count(*) OVER (PARTITION BY lang) AS left_ FROM leaves)",
        "n0 AS (SELECT lang, pos, digest, left_ FROM t0)",
    ]
    for k in range(levels):
        ctes.append(f"n{k + 1} AS (SELECT lang, pos // 8 AS pos, CASE WHEN any_value(left_) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest, (any_value(left_) + 7) // 8 AS left_ FROM n{k} GROUP BY lang, pos // 8)")
    ctes.append(f"s0 AS (SELECT lang, digest, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS left_ FROM n{levels})")
    for k in range(upper):
        ctes.append(f"s{k + 1} AS (SELECT pos // 8 AS pos, CASE WHEN any_value(left_) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest, (any_value(left_) + 7) // 8 AS left_ FROM s{k} GROUP BY pos // 8)")
    # p: proofs so far, f: what folding gives so far
    ctes.append("p0 AS (SELECT t0.doc_id, t0.lang, t0.pos, s0.pos AS lang_pos, leaf, subroot, '' AS p, CASE WHEN tampered THEN lowered ELSE leaf END AS f FROM t0 JOIN s0 ON t0.lang IS NOT DISTINCT FROM s0.lang)")
    steps = [(f"n{k}", "x.lang IS NOT DISTINCT FROM n.lang AND ", f"(x.pos // {8**k})") for k in range(levels)] + [(f"s{k}", "", f"(x.lang_pos // {8**k})") for k in range(upper)]
    for k, (table, same, pos) in enumerate(steps):
        ctes.append(f"""r{k} AS (SELECT {"n.lang, " if same else ""}pos // 8 AS run, list(digest ORDER BY pos) AS run_digests, any_value(left_) AS left_ FROM {table} n GROUP BY {"n.lang, " if same else ""}pos // 8)""")
        ctes.append(f"""p{k + 1} AS (SELECT x.* EXCLUDE (p, f),
          CASE WHEN n.left_ = 1 THEN p ELSE p || coalesce(array_to_string(list_slice(run_digests, 1, {pos} % 8), ''), '') || coalesce(array_to_string(list_slice(run_digests, {pos} % 8 + 2, 8), ''), '') END AS p,
          CASE WHEN n.left_ = 1 THEN f ELSE sha256(coalesce(array_to_string(list_slice(run_digests, 1, {pos} % 8), ''), '') || f || coalesce(array_to_string(list_slice(run_digests, {pos} % 8 + 2, 8), ''), '')) END AS f
          FROM p{k} x JOIN r{k} n ON {same}n.run = {pos} // 8)""")
    end = f"p{len(steps)}"
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, digest AS root, sha256(p) AS proof_sha256, f AS folded_root, f = digest AS verified FROM {end}, s{upper}"


SQL = _sql()
