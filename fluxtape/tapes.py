"""Files of evaluated data as one object: read, parse, query, change and write, with all options in one place.

Everything is a table over any number of files; only :meth:`Tapes.document` and :meth:`Tapes.save`
bring a file to the driver, for use with single ones.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layout import catalogue, lane
from .layout.engine import CONTROL, Options, zero_based
from .layout.notation import explain
from .operators import cells as ce
from .operators import tape as tp
from .sources.files import write_files
from .sources.stored import stored

KEYS = ["file_id", "mat", "mf", "mt"]


class TapeError(Exception):
    """A file breaks the rules, or a section does not fit its layout."""


@dataclass
class Tapes:
    """``options`` are those of fields; ``layouts`` and ``functions`` by (MF, MT) go before the dialect's layouts."""

    spark: SparkSession
    dialect: str = "endf6-ext"
    options: Options = field(default_factory=lambda: Options(check_arrays=True))
    ignore_blank_lines: bool = False
    ignore_send_records: bool = False
    ignore_missing_tpid: bool = False
    include_linenum: bool = True
    zero_as_blank: bool = False
    array_type: str = "dict"
    layouts: dict | None = None
    functions: dict | None = None

    def __post_init__(self):
        if self.dialect not in catalogue.DIALECTS:
            raise ValueError(f"unknown dialect {self.dialect!r}; there are {', '.join(sorted(catalogue.DIALECTS))}")
        if self.array_type not in ("dict", "list"):
            raise ValueError("array_type is dict or list")

    # -- reading

    def lines(self, paths: str | list[str]) -> DataFrame:
        """``file_id, ofs, raw, mat, mf, mt`` of files; each file_id is a path."""
        lines = tp.read_lines(self.spark, paths)
        return tp.with_control(lines.withColumn("file_id", F.regexp_replace("file_id", "^file:(//)?", "")))

    def text(self, text: str | list[str], name: str = "text") -> DataFrame:
        """The same for one text or its lines."""
        body = text if isinstance(text, str) else "\n".join(text)
        return tp.with_control(tp.split_text(self.spark.createDataFrame([(name, body)], "f string, t string"), "f", "t"))

    def issues(self, lines: DataFrame) -> DataFrame:
        """``file_id, ofs, code``: breaks of the control rules."""
        return tp.end_record_issues(lines.select("file_id", "ofs", "raw"), self.ignore_missing_tpid, self.ignore_send_records, self.ignore_blank_lines)

    def sections(self, lines: DataFrame, include=None, exclude=None) -> DataFrame:
        """``file_id, mat, mf, mt, lines``, the tape's head as MF 0, MT 0."""
        chosen = tp.keep_sections(lines.where(F.trim("raw") != ""), include, exclude)
        body = tp.sections(chosen).select(*KEYS, "lines")
        heads = tp.with_control(tp.tape_heads(lines.select("file_id", "ofs", "raw"))).select(*KEYS, F.array("raw").alias("lines"))
        return body.unionByName(heads)

    def parse(self, lines: DataFrame, include=None, exclude=None, nofail: bool = False) -> DataFrame:
        """``file_id, mat, mf, mt, status, code, message, at, document, lines`` of each section.

        Sections that are left out by ``include`` or ``exclude`` are verbatim.  Without ``nofail`` the first break of the
        control rules or failed section raises :class:`TapeError`.
        """
        if not nofail and (first := self.issues(lines).orderBy("file_id", "ofs").first()):
            raise TapeError(f"{first.file_id}, line {first.ofs + 1}: {first.code}")
        every = self.sections(lines)
        done = lane.parsed(tp.keep_sections(every, include, exclude), KEYS, self.dialect, self.options, self.layouts, self.functions)
        if include is not None or exclude is not None:
            wanted = tp.keep_sections(every, include, exclude).select(*KEYS)
            rest = every.join(wanted, KEYS, "left_anti")
            none = {c: F.lit(None).cast(t) for c, t in (("code", "string"), ("message", "string"), ("at", "int"), ("document", "string"))}
            done = done.unionByName(rest.withColumn("status", F.lit("verbatim")).withColumns(none))
        if nofail:
            return done
        done = stored(done, "parsed")  # the check below and every use after it read what was parsed once
        if bad := done.where("status = 'failed'").orderBy(*KEYS).first():
            raise TapeError(f"{bad.file_id}, MF {bad.mf}, MT {bad.mt}: {bad.code}: {bad.message}")
        return done

    def cells(self, parsed: DataFrame, wanted: list[list[str]] | None = None) -> DataFrame:
        """``file_id, path, i, f, s, src``: paths begin with MF and MT; with ``wanted`` paths only cells at or below them.

        In a file of several materials each is told apart as ``file_id#MAT``; the head of such a file keeps its file_id.
        """
        parsed = stored(parsed, "parsed")  # read twice: for the materials and for the cells
        several = parsed.where("mf > 0").groupBy("file_id").agg(F.count_distinct("mat").alias("_mats")).where("_mats > 1")
        made = lane.document_cells(parsed.select(*KEYS, "document", "lines"), KEYS, wanted).join(several, "file_id", "left")
        name = F.when(F.col("_mats").isNotNull() & (F.col("mf") > 0), F.concat_ws("#", F.col("file_id").cast("string"), F.col("mat").cast("string"))).otherwise(F.col("file_id"))
        return made.withColumn("file_id", name).drop("mat", "mf", "mt", "_mats")

    def document(self, path: str, include=None, exclude=None, nofail: bool = False, mat: int | None = None) -> dict:
        """One file as nested dictionaries, MF, MT and variables; sections that were not parsed are lists of lines.

        Of a file of several materials ``mat`` chooses one; without it there is a :class:`TapeError`.
        """
        out: dict = {}
        rows = self.parse(self.lines(path), include, exclude, nofail).collect()  # one file
        mats = {r.mat for r in rows if r.mf}
        if mat is None and len(mats) > 1:
            raise TapeError(f"{path} holds the materials {', '.join(map(str, sorted(mats)))}: one must be chosen")
        for row in rows:
            if mat is not None and row.mf and row.mat != mat:
                continue
            made = list(row.lines) if row.document is None else lane.decoded(json.loads(row.document))
            out.setdefault(row.mf, {})[row.mt] = zero_based(made) if self.array_type == "list" and isinstance(made, dict) else made
        return {mf: dict(sorted(out[mf].items())) for mf in sorted(out)}

    # -- writing

    def table(self, document: dict, name: str) -> DataFrame:
        """What :meth:`parse` gives, from nested dictionaries of one file."""
        rows = []
        mats = {s["MAT"] for m in document.values() for s in m.values() if isinstance(s, dict) and s.get("MAT") and s.get("MF")}
        for mf, sections in document.items():
            for mt, made in sections.items():
                if isinstance(made, dict):
                    mat = made.get("MAT", max(mats, default=0))
                    if (made.get("MF", mf), made.get("MT", mt)) != (mf, mt):
                        raise TapeError(f"the section at {mf}/{mt} says that it is {made.get('MF')}/{made.get('MT')}")
                    rows.append((name, mat, mf, mt, "parsed", json.dumps(lane.encoded(made)), None))
                else:
                    rows.append((name, int(made[0][66:70].strip() or 0), mf, mt, "verbatim", None, list(made)))
        return self.spark.createDataFrame(rows, "file_id string, mat int, mf int, mt int, status string, document string, lines array<string>")

    def write(self, parsed: DataFrame) -> DataFrame:
        """``file_id, mat, mf, mt, ofs, raw``: data lines of what :meth:`parse` gave, with line numbers if asked for."""
        made = lane.rendered(parsed, KEYS, self.dialect, self.options, self.layouts)
        if bad := made.where("code IS NOT NULL").orderBy(*KEYS).first():
            raise TapeError(f"{bad.file_id}, MF {bad.mf}, MT {bad.mt} cannot be written: {bad.code}")
        lines = made.select(*KEYS, F.posexplode("lines").alias("ofs", "raw"))
        return tp.renumbered(lines, self.include_linenum)

    def texts(self, parsed: DataFrame) -> DataFrame:
        """``file_id, text`` with end records, for files that fit a row."""
        return tp.file_texts(self.write(parsed), self.zero_as_blank, self.include_linenum)

    def save(self, parsed: DataFrame, path: str, overwrite: bool = False) -> None:
        """Write the only file of ``parsed`` to a path, by as many tasks as it takes; an existing file is an error unless told otherwise."""
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(path)
        lines = stored(self.write(parsed), "lines")
        write_files(tp.ordered_lines(lines, self.zero_as_blank, self.include_linenum), path, overwrite=overwrite, single=True)

    # -- queries

    def explain(self, path: str) -> str | None:
        """What the layouts say of a path that begins with MF and MT."""
        steps = ce.parse_path(path)
        text = (self.layouts or {}).get((int(steps[0]), int(steps[1]))) or catalogue.find(self.dialect, int(steps[0]), int(steps[1]))
        return None if text is None else explain(text, steps[2:])

    def listed(self, parsed: DataFrame) -> DataFrame:
        """``file_id, mf, mt, status`` of the sections."""
        return parsed.select("file_id", "mf", "mt", "status")


def dialects() -> list[str]:
    return sorted(catalogue.DIALECTS)


__all__ = ["CONTROL", "KEYS", "TapeError", "Tapes", "dialects"]
