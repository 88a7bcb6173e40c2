"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled by a seeded hash within their source and ranked; the fractional
rank (rank - 1/2) / rows of the source interleaves the sources in proportion, so
any contiguous cut of the order by fractional rank has the mixture of the whole.

No ranking is done by one task.  The hash's leading bits split each source into
buckets of bounded expected size; bucket counts give the rank before a bucket, and
only ranks inside a bucket are computed by a window.  The same is done once more
for the order by fractional rank.  Very many equal rows would share their hash and so a
bucket; each of them is given a hash of its own instead, for which is which does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize, release

#: Expected rows of one ranking window.
WINDOW_ROWS = 256


def _offsets(counted: DataFrame, within: list[str], by: str) -> DataFrame:
    order = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))


def _leading(text: Column) -> Column:
    """48 bits of a text's hash."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint")


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 7) -> None:
    """Write the rows of ``docs`` as Parquet below ``path``, one folder for each shard, its rows in order of their slots."""
    placed = stratified_shards(docs, shards, seed, carry=True).select("doc.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    # slots are cut into ranges, so no shard is one task's
    placed.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").drop("_slot").write.partitionBy("_shard").parquet(path)


def stratified_shards(docs: DataFrame, shards: int = 40, seed: int = 7, carry: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``, and with ``carry`` the row as ``doc``.

    The law is ``rows``: shards differ by one row at most.  Slots run from 0 without
    gaps in each shard.  Null texts count as empty, a null source is a source of its
    own, a null doc_id keeps its row.  Equal rows are interchangeable: which of them
    has which slot is not defined, the returned rows as a whole are.  An empty table
    gives no rows.  Columns beside doc_id, text and source are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-")).alias("src"),
        (F.octet_length(text) + F.lit(16)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if carry else []),
    )
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("crc").cast("string"), F.col("size").cast("string"))
    marked = materialize(rows.withColumn("u", _leading(key)).withColumn("rid", F.monotonically_increasing_id()), "sharding")
    many = materialize(marked.groupBy("u").count().where(F.col("count") > WINDOW_ROWS).select("u", F.lit(True).alias("many")), "many")
    own = F.when(F.col("many"), _leading(F.concat_ws(":", F.col("u").cast("string"), F.col("rid").cast("string")))).otherwise(F.col("u"))
    rows = materialize(marked.join(many, "u", "left").withColumn("u", own).drop("many", "rid"), "sharding")
    release(marked)
    release(many)
    per_source = rows.groupBy("src").agg(F.count("*").alias("rows"))
    total = per_source.agg(F.sum("rows").alias("n")).first().n or 0
    if not total:
        return rows.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["doc"] if carry else [])).limit(0)
    buckets = max(1, min(16384, total // WINDOW_ROWS))
    spread = 1 << 48
    rows = rows.withColumn("bucket", F.floor(F.col("u") * F.lit(buckets) / F.lit(spread)).cast("int"))
    counted = rows.groupBy("src", "bucket").agg(F.count("*").alias("n"))
    before = _offsets(counted, ["src"], "bucket").drop("n").join(per_source, "src")
    inside = F.row_number().over(Window.partitionBy("src", "bucket").orderBy("u", "doc_id", "crc", "size"))
    ranked = rows.withColumn("inside", inside).join(before, ["src", "bucket"])
    half = F.lit(2) * (F.col("before") + F.col("inside")) - F.lit(1)
    ranked = ranked.withColumn("frac", half / (F.lit(2) * F.col("rows"))).withColumn("cut", F.floor(F.col("frac") * F.lit(buckets)).cast("int"))
    cuts = _offsets(ranked.groupBy("cut").agg(F.count("*").alias("n")), [], "cut").select("cut", F.col("before").alias("cut_before"))
    place = F.row_number().over(Window.partitionBy("cut").orderBy("frac", "src", "u", "doc_id", "crc", "size"))
    placed = ranked.withColumn("place", place).join(cuts, "cut").withColumn("at", F.col("cut_before") + F.col("place") - 1)
    shard = F.expr(f"(at * {shards}) div {total}L")
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        (F.col("at") - first).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(["doc"] if carry else []),
    )
