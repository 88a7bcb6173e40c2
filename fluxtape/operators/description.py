"""Edits of the description and directory that a file's first section (MF 1, MT 451) holds.

The functions take a section's document and return it changed; :func:`edited` applies one to a
table of documents in JSON.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: NLIB, NVER and LREL of each library name.
LIBRARIES = {"ENDF/B-VII.0": (0, 7, 0), "ENDF/B-VII.1": (0, 7, 1), "ENDF/B-VIII.0": (0, 8, 0), "FENDL-3.2": (33, 3, 2)}
#: Lines of the section's text that are not part of its description.
FIXED_LINES = 5


def _by_place(lines: list[str]) -> dict[int, str]:
    return dict(enumerate(lines, 1))


def description(document: dict) -> str:
    """Its lines in order, without trailing blanks."""
    own = document.get("DESCRIPTION", {})
    return "\n".join(own[k].rstrip() for k in sorted(own))


def with_description(document: dict, text: str) -> dict:
    """Another description; shorter lines are filled to 66 columns, longer ones are kept as they are."""
    lines = [x.ljust(66) for x in text.split("\n")]
    return {**document, "DESCRIPTION": _by_place(lines), "NWD": len(lines) + FIXED_LINES}


def with_inserted(document: dict, text: str, after: int = 0) -> dict:
    """More lines after line ``after`` of the description."""
    own = document.get("DESCRIPTION", {})
    old = [own[k] for k in sorted(own)]
    if not 0 <= after <= len(old):
        raise ValueError(f"the description has {len(old)} lines, not {after}")
    return with_description(document, "\n".join([*old[:after], *text.split("\n"), *old[after:]]))


def with_library(document: dict, library: str) -> dict:
    """Numbers of the library, and its name in the third line, which must name one."""
    if library not in LIBRARIES:
        raise ValueError(f"unknown library {library!r}")
    line = document.get("DESCRIPTION", {}).get(3)
    if line is None or not re.match(r"---- *[A-Z]\S", line):
        raise ValueError("the description has no third line that names a library")
    numbers = dict(zip(("NLIB", "NVER", "LREL"), LIBRARIES[library]))
    return {**document, **numbers, "DESCRIPTION": {**document["DESCRIPTION"], 3: f"----{library}".ljust(22) + line[22:]}}


def with_directory(document: dict, entries: list[tuple[int, int, int]]) -> dict:
    """The directory of ``(mf, mt, lines)``, its own section's lines set right; MOD numbers stay with their sections."""
    old = {(document["MFx"][i], document["MTx"][i]): document["MOD"][i] for i in document.get("MFx", {})}
    entries = sorted({**{(1, 451): 0}, **{(mf, mt): n for mf, mt, n in entries}}.items())
    own = 4 + document["NWD"] + len(entries)
    columns = {
        "MFx": [k[0] for k, _ in entries],
        "MTx": [k[1] for k, _ in entries],
        "NCx": [own if k == (1, 451) else n for k, n in entries],
        "MOD": [old.get(k, 0) for k, _ in entries],
    }
    return {**document, "NXC": len(entries), **{k: _by_place(v) for k, v in columns.items()}}


def edited(document: Column, change: Callable[..., dict], *arguments: Column) -> Column:
    """``change(document, *arguments)`` of each document in JSON, as JSON; null where it does not apply."""
    from ..layout.lane import decoded, encoded

    @F.arrow_udf(T.StringType())
    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for text, *rest in zip(*(c.to_pylist() for c in columns)):
            try:
                out.append(None if text is None else json.dumps(encoded(change(decoded(json.loads(text)), *rest))))
            except (ValueError, KeyError):
                out.append(None)
        return pa.array(out, pa.string())

    return run(document, *arguments)
