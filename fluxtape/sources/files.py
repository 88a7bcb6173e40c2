"""Files of lines, of any size: read by many tasks each, and written by many tasks each.

Reading deals out byte ranges as Spark's text reader does, which begins a range at its
first whole line.  A line's number is its place within its range plus what comes before: for lines of one
length that follows from the range's first byte, else from the numbers of lines of the ranges before it.

Writing sorts lines by range into parts, which Spark's own writer commits; a part's place in its file is the
sum of the sizes of those before it.  The parts are then copied to their places by as many
tasks, which write the same bytes again if they are tried again, and a file gets its name when it is whole.
"""

from __future__ import annotations

import os
import urllib.parse
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stored import delete, fresh_path, store_of

#: Bytes that are copied at a time.
BLOCK = 1 << 22


def _placed(batches: Iterable[pa.RecordBatch]):
    """``at``, the place of each line within its range, counted over the batches of a task."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = batch.column("start").to_numpy()
        names = pa.compute.dictionary_encode(batch.column("file_id"))
        codes = names.indices.to_numpy()
        cuts = np.flatnonzero(np.r_[True, (np.diff(starts) != 0) | (np.diff(codes) != 0)])
        at = np.arange(batch.num_rows) - np.repeat(cuts, np.diff(np.r_[cuts, batch.num_rows]))
        key = lambda k: (names.dictionary[int(codes[k])].as_py(), int(starts[k]))
        if key(0) == last:  # the range goes on
            at[: cuts[1] if len(cuts) > 1 else None] += seen
        last, seen = key(-1), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "at"])


def read_lines(spark: SparkSession, paths: str | list[str], record: int | None = None) -> DataFrame:
    """``file_id, ofs, raw`` of all lines of files, ``ofs`` from 0; lines end with a line feed, or a carriage return before it.

    ``record`` is the size in bytes, with its end, that every line is known to have; then nothing is counted first,
    and a line of another size is an error.  A file that ends with its last line's end has no empty line after it.
    """
    text = spark.read.option("lineSep", "\n").text(paths)
    rows = text.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("start"), "value")
    placed = rows.mapInArrow(_placed, "file_id string, start bigint, value string, at bigint")
    raw = F.regexp_replace("value", "\r$", "").alias("raw")
    if record is not None:  # a range begins at the first line after its first byte, which is inside or ends a line of the range before
        first = F.when(F.col("start") == 0, 0).otherwise(F.floor(F.col("start") / record) + 1)
        same = F.octet_length("value") == record - 1
        ofs = F.when(same, first + F.col("at")).otherwise(F.raise_error(F.concat(F.lit("a line is not of the given size in "), "file_id")).cast("bigint"))
        return placed.select("file_id", ofs.cast("bigint").alias("ofs"), raw)
    counts = rows.select("file_id", "start").groupBy("file_id", "start").count()
    earlier = Window.partitionBy("file_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("file_id", "start", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    return placed.join(before, ["file_id", "start"]).select("file_id", (F.col("before") + F.col("at")).alias("ofs"), raw)


def _copied(rows) -> None:
    """Copies parts to their places in files of a folder that all machines see."""
    for row in rows:
        to = os.open(row.target, os.O_WRONLY)
        try:
            with open(row.part, "rb") as source:
                at = row.at
                while block := source.read(BLOCK):
                    done = 0
                    while done < len(block):
                        done += os.pwrite(to, block[done:], at + done)
                    at += len(block)
        finally:
            os.close(to)


def _local(path: str) -> str | None:
    """The path in the file system of every machine, or None for other stores."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    return "/" + rest.lstrip("/") if scheme == "file" else None


def write_files(ordered: DataFrame, path: str, suffix: str = ".endf", overwrite: bool = False, single: bool = False) -> list[str]:
    """Write lines ``(file_id, raw)`` that are dealt out and sorted by file, as :func:`fluxtape.operators.tape.ordered_lines` does.

    A file's last line has no end.  Gives the files' paths, one below ``path`` for each file_id, or with ``single`` ``path`` itself; one that exists is
    an error unless it is to be overwritten.  Files appear whole.  Elsewhere than in a shared file system
    the driver passes the bytes on, a block at a time.
    """
    spark = ordered.sparkSession
    parts_at = fresh_path(spark, "parts")
    # the rows are sorted by file_id already, so the writer leaves their order as it is
    ordered.select("file_id", "raw").write.partitionBy("file_id").option("lineSep", "\n").text(parts_at)
    store, root = store_of(spark, parts_at)
    files: dict[str, list[tuple[str, int]]] = {}
    for each in store.listStatus(root):
        if each.isDirectory():
            name = urllib.parse.unquote(each.getPath().getName().partition("=")[2]).strip("/").replace("/", "_")
            found = [(f.getPath().toString(), f.getLen()) for f in store.listStatus(each.getPath()) if f.getPath().getName().startswith("part-")]
            files[name] = sorted(found, key=lambda f: f[0].rpartition("/")[2])
    if single and len(files) != 1:
        raise ValueError(f"{len(files)} files for one path")
    folder_, _, base = path.rpartition("/")
    folder = folder_ or "." if single else path.rstrip("/")
    targets = {name: path if single else f"{folder}/{name}{suffix}" for name in files}
    to_store, _ = store_of(spark, folder)
    there = [t for t in targets.values() if to_store.exists(store_of(spark, t)[1])]
    if there and not overwrite:
        raise FileExistsError(there[0])
    to_store.mkdirs(store_of(spark, folder)[1])
    unfinished = {name: f"{folder}/.{base if single else name}.{uuid.uuid4().hex}" for name in files}
    try:
        if _local(folder) is not None and _local(parts_at) is not None:
            copies = []
            for name, parts in files.items():
                with open(_local(unfinished[name]), "wb") as f:
                    f.truncate(sum(size for _, size in parts))
                at = 0
                for part, size in parts:
                    copies.append((_local(part), _local(unfinished[name]), at))
                    at += size
            if copies:
                spark.createDataFrame(copies, "part string, target string, at bigint").repartition(len(copies)).foreachPartition(_copied)
            for name, parts in files.items():
                os.truncate(_local(unfinished[name]), sum(size for _, size in parts) - 1)
        else:
            for name, parts in files.items():
                _joined(spark, parts, unfinished[name])
        for name, target in targets.items():
            where = store_of(spark, target)[1]
            if overwrite:
                to_store.delete(where, False)
            if not to_store.rename(store_of(spark, unfinished[name])[1], where):
                raise OSError(f"{target} cannot be given its name")
    except BaseException:
        for made in unfinished.values():
            delete(spark, made)
        raise
    delete(spark, parts_at)
    return sorted(targets.values())


def _joined(spark: SparkSession, parts: list[tuple[str, int]], target: str) -> None:
    """One file of parts, in a store where tasks cannot write to places of a file."""
    jvm = spark.sparkContext._jvm
    store, where = store_of(spark, target)
    out = store.create(where)
    try:
        for k, (part, size) in enumerate(parts):
            source = store_of(spark, part)[0].open(store_of(spark, part)[1])
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, size - (k == len(parts) - 1), False)
            finally:
                source.close()
    finally:
        out.close()
