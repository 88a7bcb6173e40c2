"""Straight layouts as Column expressions: records one after another, without loops, branches or sections.

Such a layout (cross sections, atomic data, heads of tapes) needs no Python on the executors:
each record's place follows from the counts of the records before it, so a section's values are
expressions of the array of its fields, and only those that are asked for are computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.records import every_other, line_count
from .columns import NO_WHOLE, fields_of
from .engine import Options
from .notation import Line, parse

#: Kinds of lines that have an expression.
STRAIGHT = ("cont", "tab1", "text")


def is_straight(layout: str) -> bool:
    return all(line.kind in STRAIGHT and all(_plain(s) for s in line.slots) for line in parse(layout))


def _plain(slot: str) -> bool:
    bare = slot.rstrip("?").partition("{")[0]
    return bare == "" or bare.isidentifier() or _number(bare) is not None


def _number(slot: str) -> float | None:
    try:
        return float(slot)
    except ValueError:
        return None


class _Plan:
    """Values and checks, collected record by record; ``at`` is the place of the next line, from 0."""

    def __init__(self, frame: DataFrame, options: Options):
        self.frame, self.lines, self.options, self.at = frame, F.col("lines"), options, F.lit(0)
        self.values: dict[str, Column] = {}
        self.codes: list[Column] = []
        self.numbers, self.whole = map(self._kept, fields_of(self.lines, options.accept_spaces))

    def _kept(self, value: Column) -> Column:
        """A column of its own for what is used several times, so that it is computed once."""
        name = f"_kept{len(self.frame.columns)}"
        self.frame = self.frame.withColumn(name, value)
        return F.col(name)

    def _check(self, slot: str, value: Column) -> None:
        soft, bare = slot.endswith("?"), slot.rstrip("?")
        wanted = _number(bare)
        self.codes.append(F.when(value.isNull(), "bad_number"))
        if wanted is None and bare not in self.values:
            self.values[bare] = value
            return
        o = self.options
        ignored = (wanted == 0 and o.ignore_zero_mismatch) or (soft and wanted is not None and o.ignore_number_mismatch) or (soft and wanted is None and o.ignore_varspec_mismatch)
        if not ignored and not o.ignore_all_mismatches:
            other = F.lit(wanted) if wanted is not None else self.values[bare]
            near = F.abs(value - other) <= F.lit(1e-7) + F.lit(1e-5) * F.abs(other) if o.fuzzy else value == other
            self.codes.append(F.when(~near, "mismatch"))

    def _head(self, slots: list[str]) -> None:
        line = F.get(self.lines, self.at)
        self.codes.append(F.when(line.isNull(), "missing_line"))
        for k, slot in enumerate(slots):
            self._check(slot, F.get(self.numbers, 6 * self.at + k) if k < 2 else self._integer(k))

    def _integer(self, k: int) -> Column:
        """A field of the next line as a whole number."""
        return F.nullif(F.get(self.whole, 6 * self.at + k), F.lit(NO_WHOLE))

    def cont(self, line: Line) -> None:
        self._head(line.slots)
        self.at = self.at + 1

    def tab1(self, line: Line) -> None:
        self._head(line.slots)
        ranges, points = (F.coalesce(self._integer(k), F.lit(0)).cast("int") for k in (4, 5))
        first, table = self.at + 1, line_count(2 * ranges)
        rest = line_count(2 * points)
        part = lambda fields, begin, count: F.slice(fields, 6 * begin + 1, F.greatest(count, F.lit(0)))
        pairs = self._kept(part(self.whole, first, 2 * ranges))
        numbers = self._kept(part(self.numbers, first + table, 2 * points))
        made = {"NBT": every_other(pairs, 0), "INT": every_other(pairs, 1), line.columns[0]: every_other(numbers, 0), line.columns[1]: every_other(numbers, 1)}
        self.at = first + table + rest
        self.codes += [F.when(F.size(self.lines) < self.at, "missing_line"), F.when(F.exists(numbers, lambda x: x.isNull()) | F.exists(pairs, lambda x: x == NO_WHOLE), "bad_number")]
        if line.name:
            self.values[line.name] = F.struct(*(v.alias(k) for k, v in made.items()))
        else:
            self.values |= made

    def text(self, line: Line) -> None:
        row, place = F.get(self.lines, self.at), 1
        self.codes.append(F.when(row.isNull(), "missing_line"))
        for slot in line.slots:
            name, _, size = slot.partition("{")
            width = int(size[:-1]) if size else 67 - place
            if name:
                self.values[name] = F.substring(F.rpad(row, 66, " "), place, width)
            place += width
        self.at = self.at + 1


def decoded(sections: DataFrame, keys: list[str], layout: str, options: Options | None = None) -> DataFrame:
    """``keys, code, document``: the values of sections ``(keys, lines)`` as a struct, and the code of the first defect.

    The codes are those of :func:`fluxtape.layout.lane.status`; a section with a defect has a null document.
    """
    if not is_straight(layout):
        raise ValueError("only records in a row, of plain slots, have expressions")
    plan = _Plan(sections.select(*keys, "lines"), options or Options())
    for line in parse(layout):
        getattr(plan, line.kind)(line)
    plan.codes.append(F.when(F.size("lines") > plan.at, "more_lines"))
    code = F.coalesce(*plan.codes)
    document = F.struct(*(v.alias(k) for k, v in plan.values.items()))
    return plan.frame.select(*keys, code.alias("code"), F.when(code.isNull(), document).alias("document"))
