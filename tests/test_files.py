"""Files that are read and written by many tasks, against reading and writing them at once."""

import os
import re

import pytest
from pyspark.sql import functions as F

from fluxtape.operators import tape as tp
from fluxtape.sources import files


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def at_once(path):
    with open(path, newline="") as f:
        return re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", f.read()))


def test_lines_of_any_length_have_their_numbers(spark, tmp_path, small_ranges):
    texts = {
        "a": "".join(f"{'x' * (i * 7 % 150)}{i}\n" for i in range(3000)),
        "b": "".join(f"line {i}\r\n" for i in range(5000)),
        "c": "one line without an end",
        "d": "\n\n\nblank\n\n",
        "e": "w" * 90_000 + "\n" + "after a long line\n" * 10,
        "f": "é漢\n" * 4000 + "last",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="", encoding="utf-8")
    lines = tp.read_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 4
    got = {}
    for r in lines.collect():
        got.setdefault(os.path.basename(r.file_id), {})[r.ofs] = r.raw
    for name in texts:
        assert [got[name][i] for i in range(len(got[name]))] == at_once(tmp_path / name)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_are_numbered_by_their_places(spark, tmp_path, small_ranges, end):
    path = tmp_path / "records"
    path.write_text("".join(f"{i:80d}{end}" for i in range(4000)), newline="")
    got = tp.read_lines(spark, str(path), record=80 + len(end)).collect()
    assert sorted((r.ofs, int(r.raw)) for r in got) == [(i, i) for i in range(4000)]
    with path.open("a", newline="") as f:
        f.write("short" + end)
    with pytest.raises(Exception, match="not of the given size"):
        tp.read_lines(spark, str(path), record=80 + len(end)).collect()


def _tape(spark, n):
    ids = spark.range(n)
    key = {"mat": F.col("id") % 5 + 1, "mf": F.col("id") % 3 + 1, "mt": F.lit(1).cast("bigint")}
    text = F.concat(F.lpad(F.col("id").cast("string"), 66, " "), *(F.lpad(v.cast("string"), w, " ") for v, w in zip(key.values(), (4, 2, 3))))
    return ids.select(F.when(F.col("id") < n * 0.9, "big one").otherwise("a/small").alias("file_id"), *(v.alias(k) for k, v in key.items()), F.col("id").alias("ofs"), text.alias("raw"))


def test_a_file_is_written_by_many_tasks(spark, tmp_path):
    lines = _tape(spark, 6000)
    ordered = tp.ordered_lines(lines)
    want = {r.file_id: r.text.split("\n") for r in tp.file_texts(lines).collect()}
    out = str(tmp_path / "made")
    paths = files.write_files(ordered.repartitionByRange(7, "file_id", "mat", "mf", "mt", "ofs").sortWithinPartitions("file_id", "mat", "mf", "mt", "ofs"), out)
    assert [os.path.basename(p) for p in paths] == ["a_small.endf", "big one.endf"]
    assert at_once(paths[1]) == want["big one"] and at_once(paths[0]) == want["a/small"]
    with pytest.raises(FileExistsError):
        files.write_files(ordered, out)
    files.write_files(tp.ordered_lines(lines.where("ofs < 10")), out, overwrite=True)
    assert len(at_once(paths[1])) < 60 and sorted(os.listdir(out)) == ["a_small.endf", "big one.endf"]  # the other file stays
    single = str(tmp_path / "one.endf")
    with pytest.raises(ValueError):
        files.write_files(ordered, single, single=True)
    assert files.write_files(tp.ordered_lines(lines.where("file_id = 'a/small'")), single, single=True) == [single]
    assert at_once(single) == want["a/small"]


def test_copies_that_are_tried_again_write_the_same(tmp_path):
    parts, target = [], tmp_path / "target"
    for i, text in enumerate(("first\n", "second line\n", "third\n")):
        (tmp_path / f"p{i}").write_text(text)
        parts.append(text)
    target.write_bytes(b"\0" * sum(map(len, parts)))

    class Row:
        def __init__(self, i):
            self.part, self.target, self.at = str(tmp_path / f"p{i}"), str(target), sum(map(len, parts[:i]))

    for order in ((2, 0, 1), (1, 1), (0,)):
        files._copied(Row(i) for i in order)
    assert target.read_text() == "".join(parts)


def test_parts_are_joined_where_places_cannot_be_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_local", lambda path: None)
    (path,) = files.write_files(tp.ordered_lines(_tape(spark, 500).where("file_id = 'big one'")), str(tmp_path / "joined"))
    assert at_once(path) == tp.file_texts(_tape(spark, 500)).where("file_id = 'big one'").first().text.split("\n")


def test_no_lines_give_no_files(spark, tmp_path):
    assert files.write_files(tp.ordered_lines(_tape(spark, 10).limit(0)), str(tmp_path / "none")) == []


def test_no_task_sorts_more_as_files_grow(spark, monkeypatch):
    monkeypatch.setattr(tp, "LINES", 100)
    want = [r.raw for r in tp.ordered_lines(_tape(spark, 500)).collect()]
    few = tp.ordered_lines(_tape(spark, 500)).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    many = tp.ordered_lines(_tape(spark, 2000)).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(many) > 8 and max(r["count"] for r in many) < 2 * max(r["count"] for r in few)
    monkeypatch.setattr(tp, "LINES", 10**9)
    assert [r.raw for r in tp.ordered_lines(_tape(spark, 500)).collect()] == want
