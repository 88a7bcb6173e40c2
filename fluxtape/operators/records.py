"""Records of 66 data columns and a control part, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fields import WIDTH, counted, fort_float, fort_int, int_field

#: Values that fit a packed-integer line, by digits.
PACKED = {2: 18, 3: 14, 4: 11, 5: 9, 6: 8}


def control(mat: Column, mf: Column, mt: Column) -> Column:
    """MAT, MF and MT in columns 67-75."""
    return F.concat(int_field(mat, 4), int_field(mf, 2), int_field(mt, 3))


def numbered(body: Column, ctrl: Column, number: Column) -> Column:
    """A full line: 66 columns, control, line number in five columns."""
    return F.concat(F.rpad(body, 66, " "), ctrl, F.lpad(number.cast("string"), 5, " "))


def read_control(line: Column) -> dict[str, Column]:
    return {"mat": fort_int(F.substring(line, 67, 4)), "mf": fort_int(F.substring(line, 71, 2)), "mt": fort_int(F.substring(line, 73, 3))}


def field(line: Column, k: int) -> Column:
    """Field 1 to 6."""
    return F.substring(line, WIDTH * (k - 1) + 1, WIDTH)


def cont_body(c1: Column, c2: Column, *ints: Column) -> Column:
    """66 columns from two float fields (already text) and four whole numbers."""
    return F.concat(c1, c2, *(int_field(x) for x in ints))


def read_cont(line: Column) -> dict[str, Column]:
    floats = {n: fort_float(field(line, k)) for k, n in enumerate(("c1", "c2"), 1)}
    return floats | {n: fort_int(field(line, k)) for k, n in enumerate(("l1", "l2", "n1", "n2"), 3)}


def dir_body(*ints: Column) -> Column:
    return F.concat(F.lit(" " * 22), *(int_field(x) for x in ints))


def read_dir(line: Column) -> dict[str, Column]:
    return {n: fort_int(field(line, k)) for k, n in enumerate(("l1", "l2", "n1", "n2"), 3)}


def packed_body(ii: Column, jj: Column, values: Column, digits: int) -> Column:
    """II and JJ in five columns each, then values of ``digits`` places and a sign.

    Fourteen values of three digits take a column more than the 66 of a line's body.
    """
    if digits not in PACKED:
        raise ValueError(f"a packed line has 2 to 6 digits, not {digits}")
    text = F.array_join(F.transform(F.slice(values, 1, PACKED[digits]), lambda v: F.lpad(v.cast("string"), digits + 1, " ")), "")
    body = F.concat(int_field(ii, 5), int_field(jj, 5), F.lit("" if digits == 6 else " "), text)
    return F.when(F.length(body) > 66, body).otherwise(F.rpad(body, 66, " "))


def packed_parts(values: Column, digits: int) -> Column:
    """Values in groups that fit one packed line each; the last may be shorter."""
    wide = PACKED[digits]
    count = F.ceil(F.size(values) / F.lit(wide)).cast("int")
    return F.transform(counted(F.lit(0), count - 1), lambda i: F.slice(values, i * wide + 1, F.lit(wide)))


def read_packed(line: Column, digits: int) -> dict[str, Column]:
    if digits not in PACKED:
        raise ValueError(f"a packed line has 2 to 6 digits, not {digits}")
    wide, first = digits + 1, 11 if digits == 6 else 12
    values = F.transform(F.sequence(F.lit(0), F.lit(PACKED[digits] - 1)), lambda k: fort_int(F.substr(line, F.lit(first) + k * F.lit(wide), F.lit(wide))))
    return {"ii": fort_int(F.substring(line, 1, 5)), "jj": fort_int(F.substring(line, 6, 5)), "values": values}


def value_lines(fields: Column) -> Column:
    """Fields, six to a line of 66 columns; no fields give no lines."""
    count = F.ceil(F.size(fields) / F.lit(6)).cast("int")
    return F.transform(counted(F.lit(0), count - 1), lambda i: F.rpad(F.array_join(F.slice(fields, i * 6 + 1, F.lit(6)), ""), 66, " "))


def read_values(lines: Column, count: Column, read=fort_float) -> Column:
    """The first ``count`` fields of consecutive lines."""
    each = F.flatten(F.transform(lines, lambda x: F.array(*(read(field(x, k)) for k in range(1, 7)))))
    return F.slice(each, 1, F.greatest(count, F.lit(0)).cast("int"))


def line_count(values: Column) -> Column:
    """Lines that so many values take."""
    return F.ceil(values / F.lit(6)).cast("int")


def every_other(values: Column, first: int) -> Column:
    return F.filter(values, lambda _, i: i % 2 == first)


def interleaved(xs: Column, ys: Column) -> Column:
    return F.flatten(F.zip_with(xs, ys, lambda x, y: F.array(x, y)))


def read_list(lines: Column) -> dict[str, Column]:
    """A LIST record from its lines: header fields and N1 values."""
    head = read_cont(F.get(lines, F.lit(0)))
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return head | {"values": read_values(body, head["n1"])}


def read_tab1(lines: Column) -> dict[str, Column]:
    """A TAB1 record: header fields, interpolation table and two columns."""
    head = read_cont(F.get(lines, F.lit(0)))
    skip = line_count(2 * head["n1"])
    table = read_values(F.slice(lines, F.lit(2), skip), 2 * head["n1"], fort_int)
    rest = F.slice(lines, skip + 2, F.greatest(F.size(lines) - skip - 1, F.lit(0)))
    points = read_values(rest, 2 * head["n2"])
    return head | {"nbt": every_other(table, 0), "int": every_other(table, 1), "x": every_other(points, 0), "y": every_other(points, 1)}
