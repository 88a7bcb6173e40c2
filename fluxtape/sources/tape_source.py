"""Files of 80-column lines as a Spark data source: ``spark.read.format("tape80")``.

Files in any store are read by :func:`fluxtape.operators.tape.read_lines`, through Spark's own
text reader; this source is for paths that Python can open on every executor, and it
drops sections by MF and MT before their lines leave the reader.
"""

from __future__ import annotations

import glob
import os
import uuid

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

SCHEMA = "file_id string, ofs int, raw string, mat int, mf int, mt int"


def _number(text: str):
    try:
        return int(text) if text.strip() else 0
    except ValueError:
        return None


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TapeReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.only = path, {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute[0] in ("mf", "mt"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[f.attribute[0]] = self.only.get(f.attribute[0], values) & values
            yield f  # Spark applies it again: correctness does not rest on the push

    def partitions(self):
        return [_File(p) for p in sorted(glob.glob(self.path)) if os.path.isfile(p)] or [_File("")]

    def read(self, partition):
        if not partition.path:
            return
        with open(partition.path, encoding="utf-8", errors="replace") as f:
            for ofs, line in enumerate(f):
                raw = line.rstrip("\r\n")
                mat, mf, mt = (_number(raw[a:b]) for a, b in ((66, 70), (70, 72), (72, 75)))
                if all(v in self.only[k] for k, v in (("mf", mf), ("mt", mt)) if k in self.only):
                    yield (partition.path, ofs, raw, mat, mf, mt)


class _Written(WriterCommitMessage):
    def __init__(self, parts: list[tuple[str, str]]):
        self.parts = parts


class TapeWriter(DataSourceWriter):
    """Writes ``file_id, text`` rows as files below a folder that all machines share; existing files are an error.

    Each task writes to names of its own, so a task that is tried again or twice at a time does not meet
    what another left; only the commit gives the files of the tasks that counted their names.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows):
        os.makedirs(self.path, exist_ok=True)
        done = []
        for row in rows:
            name = str(row.file_id).strip("/").replace("/", "_")
            to = os.path.join(self.path, f"{name}.endf")
            if not self.overwrite and os.path.exists(to):
                raise FileExistsError(to)
            part = os.path.join(self.path, f".{name}.{uuid.uuid4().hex}")
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.write(row.text)
            done.append((part, to))
        return _Written(done)

    def commit(self, messages):
        parts = [p for m in messages if m for p in m.parts]
        twice = len(parts) - len({to for _, to in parts})
        if twice or not self.overwrite and any(os.path.exists(to) for _, to in parts):
            self.abort(messages)
            raise FileExistsError(f"{twice} names are given twice" if twice else "a file is there already")
        for part, to in parts:
            os.replace(part, to)

    def abort(self, messages):
        for m in messages:
            for part, _ in m.parts if m else ():
                if os.path.exists(part):
                    os.unlink(part)


class TapeSource(DataSource):
    @classmethod
    def name(cls):
        return "tape80"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TapeReader(self.options["path"])

    def writer(self, schema, overwrite):
        return TapeWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known; its filters only arrive where this setting is on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TapeSource)
