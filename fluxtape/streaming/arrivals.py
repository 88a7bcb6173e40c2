"""New files as a stream of lines and of sections; a file arrives whole, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import read_control
from ..operators.tape import split_text, with_control


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with control fields of every file that arrives in a folder."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    named = files.select(F.col("_metadata.file_path").alias("file"), "value")
    return with_control(split_text(named, "file", "value"))


def stream_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of each file that arrives with their number of data lines, counted inside the file's row."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.length(x) >= 75)
    keys = F.transform(lines, lambda x: F.struct(*(v.alias(k) for k, v in read_control(x).items())))
    data = F.filter(keys, lambda k: (k["mat"] != 0) & (k["mf"] != 0) & (k["mt"] != 0))
    each = files.select(F.col("_metadata.file_path").alias("file_id"), data.alias("data")).select("file_id", "data", F.explode(F.array_distinct("data")).alias("k"))
    return each.select("file_id", "k.*", F.size(F.filter("data", lambda x: x == F.col("k"))).alias("n_lines"))
