"""Files as line tables, their sections, and the rules of end records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import fort_float
from ..sources.files import read_lines
from .records import read_control

SECTION = ["file_id", "mat", "mf", "mt"]

#: Lines that one task sorts.
LINES = 250_000


def dealt(lines: DataFrame, n_lines: int, *by: str) -> DataFrame:
    """Lines dealt out by columns to as many tasks as they need; few lines are left to Spark."""
    parts = -(-n_lines // LINES)
    return lines.repartition(parts, *by) if parts > 1 else lines


def split_text(files: DataFrame, key: str, text: str) -> DataFrame:
    lines = F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")
    return files.select(F.col(key).alias("file_id"), F.posexplode(lines).alias("ofs", "raw"))


def with_control(lines: DataFrame) -> DataFrame:
    """Adds mat, mf, mt; null where the columns hold no whole number."""
    return lines.withColumns(read_control(F.col("raw")))


def data_lines(lines: DataFrame) -> DataFrame:
    return lines.where("mat <> 0 AND mf <> 0 AND mt <> 0")


def keep_sections(lines: DataFrame, include=None, exclude=None) -> DataFrame:
    """Whole MF numbers or (MF, MT) pairs; exclude wins, include counts only without it."""

    def chosen(items) -> Column:
        tests = [(F.col("mf") == i) if isinstance(i, int) else (F.col("mf") == i[0]) & (F.col("mt") == i[1]) for i in items]
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out

    if exclude is not None:
        return lines.where(~chosen(exclude))
    return lines if include is None else lines.where(chosen(include))


def sections(lines: DataFrame) -> DataFrame:
    """One row per section with its data lines in order; materials are told apart."""
    part = F.array_sort(F.collect_list(F.struct("ofs", "raw")))
    grouped = data_lines(lines).groupBy(*SECTION).agg(part.alias("parts"))
    return grouped.select(*SECTION, F.get("parts", F.lit(0))["ofs"].alias("first_ofs"), F.size("parts").alias("n_lines"), F.transform("parts", lambda p: p["raw"]).alias("lines"))


def section_sizes(lines: DataFrame) -> DataFrame:
    """One row per section with its first line and number of data lines; no lines are gathered."""
    return data_lines(lines).groupBy(*SECTION).agg(F.min("ofs").alias("first_ofs"), F.count("*").alias("n_lines"))


def line_number(position: Column, head: bool = False) -> Column:
    """NS of a section's line from its 1-based position; wraps after 99999."""
    return (position - 1) % 99999 + F.lit(0 if head else 1)


def blank_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.trim("raw") == "")


#: The end record that closes each level: the tape, a material, a file (MF) and a section (MT).
CLOSES = ("missing_tend", "missing_mend", "missing_fend", "missing_send")


def tape_heads(lines: DataFrame) -> DataFrame:
    """``file_id, ofs, raw`` of the first line of each file that is not blank, if its MF and MT are 0."""
    seen = with_control(lines.where(F.trim("raw") != ""))
    first = seen.groupBy("file_id").agg(F.min_by(F.struct("ofs", "raw", "mf", "mt"), "ofs").alias("h"))
    return first.where("h.mf = 0 AND h.mt = 0").select("file_id", "h.ofs", "h.raw")


def end_record_issues(lines: DataFrame, ignore_missing_tpid: bool = False, ignore_send_records: bool = False, ignore_blank_lines: bool = False, ascending: bool = False) -> DataFrame:
    """``file_id, ofs, code`` of each break of the control rules, in all files.

    A file begins with its tape head (MF and MT 0).  A data line opens the section MT of
    file MF of material MAT; each is closed by an end record of its own, in turn, and the
    tape by a MAT of -1.  So the level before a line is three less the end records since
    the last data line.  A data line may only differ in what is closed (``mt_change``,
    ``mf_change``, ``mat_change``), an end record must be the one that its level asks for
    (CLOSES) and hold zeros or blanks (``end_fields``), nothing but blank lines follows the tape's
    end (``after_tend``) and nothing may be left open (``open_section``, ``missing_tend``, at
    the last line).  ``no_tape_head``, ``blank_line`` and ``bad_control`` name lines that are
    not what they should be.  With ``ascending``, MF numbers of a material (``mf_order``) and MT numbers
    of a file (``mt_order``) must grow.  After a break, counting goes on as if the line were right.
    """
    order = Window.partitionBy("file_id").orderBy("ofs")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    text = with_control(lines).withColumn("blank", F.trim("raw") == "")
    text = text.withColumn("n", F.sum(F.when(~F.col("blank"), 1).otherwise(0)).over(upto))
    first = (F.col("n") == 1) & ~F.col("blank")
    known = F.col("mat").isNotNull() & F.col("mf").isNotNull() & F.col("mt").isNotNull()
    text = text.withColumn("data", ~F.col("blank") & known & (F.col("mat") != 0) & (F.col("mf") != 0) & (F.col("mt") != 0))
    text = text.withColumn("head", first & known & (F.col("mf") == 0) & (F.col("mt") == 0))
    text = text.withColumn("end", ~F.col("blank") & known & ~F.col("data") & ~F.col("head"))
    # an opened level is known by its last data line; end records are counted from there
    text = text.withColumn("ends", F.sum(F.col("end").cast("int")).over(upto))
    text = text.withColumn("open", F.max(F.when(F.col("data"), F.struct("ofs", "ends", "mat", "mf", "mt"))).over(upto))
    after = F.when(F.col("data"), 3).otherwise(F.when(F.col("open").isNull(), 0).otherwise(3) - (F.col("ends") - F.coalesce("open.ends", F.lit(0))))
    text = text.withColumn("after", F.greatest(after, F.lit(-1)))
    text = text.withColumns({"level": F.coalesce(F.lag("after").over(order), F.lit(0)), "last": F.lag("open").over(order), "final": F.lead("ofs").over(order).isNull()})
    level, last = F.col("level"), F.col("last")
    grows = F.lit(ascending) & F.col("data") & (F.col("mat") == last["mat"])
    order_code = F.when(grows & (level <= 1) & (F.col("mf") <= last["mf"]), "mf_order").when(grows & (level == 2) & (F.col("mf") == last["mf"]) & (F.col("mt") <= last["mt"]), "mt_order")
    right_end = (
        F.when(level >= 3, (F.col("mat") == last["mat"]) & (F.col("mf") == last["mf"]))
        .when(level == 2, (F.col("mat") == last["mat"]) & (F.col("mf") == 0))
        .when(level == 1, (F.col("mat") == 0) & (F.col("mf") == 0))
        .otherwise((F.col("mat") == -1) & (F.col("mf") == 0))
    )
    zeros = F.lit(True)
    for k in range(6):
        zeros = zeros & (F.coalesce(fort_float(F.substring("raw", 11 * k + 1, 11)), F.lit(1.0)) == 0)
    strict = F.lit(not ignore_send_records)
    here = (
        F.when(F.col("blank"), F.when((level > -1) & F.lit(not ignore_blank_lines), "blank_line"))
        .when(~known, "bad_control")
        .when(first & ~F.col("head") & F.lit(not ignore_missing_tpid), "no_tape_head")
        .when(strict & (level <= -1), "after_tend")
        .when(strict & F.col("data"), F.when((level >= 3) & (F.col("mt") != last["mt"]), "mt_change").when((level >= 2) & (F.col("mf") != last["mf"]), "mf_change").when((level >= 1) & (F.col("mat") != last["mat"]), "mat_change"))
        .when(strict & F.col("end"), F.when(~right_end, F.element_at(F.array(*(F.lit(c) for c in CLOSES)), (level + 1).cast("int"))).when(~zeros, "end_fields"))
    )
    left = F.when(strict & F.col("final"), F.when(F.col("after") >= 1, "open_section").when(F.col("after") == 0, "missing_tend"))
    codes = F.filter(F.array(here, order_code, left), lambda c: c.isNotNull())
    return text.select("file_id", "ofs", F.explode(codes).alias("code"))


def end_records(sections_of: DataFrame, zero_as_blank: bool = False, include_linenum: bool = True, n_lines: int = 0) -> DataFrame:
    """SEND, FEND, MEND and TEND lines for (file_id, mat, mf, mt), each with its sort place.

    Their six fields are zeros, or blanks with ``zero_as_blank``; line numbers may be left out. Where ``n_lines`` tells
    how many lines there are, no task holds more of their keys as the table grows.
    """
    zeros = F.lit(" " * 66 if zero_as_blank else "".join(("0.000000+0".rjust(11),) + ("0.000000+0".rjust(11),) + (f"{0:11d}",) * 4))

    def line(mat: Column, mf: Column, ns: int) -> Column:
        return F.concat(zeros, F.lpad(mat.cast("string"), 4, " "), F.lpad(mf.cast("string"), 2, " "), F.lit(f"{0:3d}{ns:5d}"[: 8 if include_linenum else 3]))

    # what is closed at each level, by one pass over the sections: their distinct keys, and those of what holds them
    key = dealt(sections_of.where("mf <> 0").select(*SECTION), n_lines, *SECTION).distinct()
    kind = {c: key.schema[c].dataType for c in SECTION}

    def held(level: int, n: int) -> Column:
        return F.struct(F.lit(level).alias("open"), *((F.col(c) if c in SECTION[:n] else F.lit(None).cast(kind[c])).alias(c) for c in SECTION))

    # a material has few sections, by the width of its fields, but a tape any number: those are made distinct before they are dealt out
    below = dealt(key.select(F.inline(F.array(held(0, 4), held(1, 3), held(3, 2)))), n_lines, "open", *SECTION).distinct()
    closed = below.union(key.select(F.inline(F.array(held(7, 1)))).distinct())
    top, none = F.lit(1 << 20).cast("bigint"), F.lit(0).cast("bigint")
    mat, mf = F.col("mat"), F.col("mf")
    ends = {  # MAT, MF, MT and place by which each is sorted, and its line
        0: (mat, mf, F.col("mt"), F.lit(1 << 40), line(mat, mf, 99999)),
        1: (mat, mf, top, none, line(mat, F.lit(0), 0)),
        3: (mat, top, none, none, line(F.lit(0), F.lit(0), 0)),
        7: (top, none, none, none, line(F.lit(-1), F.lit(0), 0)),
    }

    def of(k: int) -> Column:
        return F.coalesce(*(F.when(F.col("open") == level, made[k]) for level, made in ends.items()))

    return closed.select("file_id", *(of(k).alias(c) for k, c in enumerate(("mat", "mf", "mt", "ofs", "raw"))))


def renumbered(lines: DataFrame, include_linenum: bool = True) -> DataFrame:
    """Lines cut after column 75, with a line number in each section's order unless that is left out."""
    from .records import numbered

    place = F.row_number().over(Window.partitionBy(*SECTION).orderBy("ofs"))
    cut = F.rpad(F.substring("raw", 1, 75), 75, " ")
    head = (F.col("mf") == 0) & (F.col("mt") == 0)
    number = F.lpad(F.when(head, 0).otherwise(line_number(place.cast("bigint"))).cast("string"), 5, " ")
    return lines.withColumn("raw", F.concat(cut, number) if include_linenum else cut)


def _every_line(lines: DataFrame, zero_as_blank: bool, include_linenum: bool = True, n_lines: int = 0) -> DataFrame:
    """Data lines and end records with their sort places; a tape head (MF and MT 0) comes first."""
    columns = [*SECTION, F.col("ofs").cast("bigint").alias("ofs"), "raw"]
    placed = lines.withColumn("mat", F.when((F.col("mf") == 0) & (F.col("mt") == 0), -1).otherwise(F.col("mat")))
    return placed.select(*columns).union(end_records(lines, zero_as_blank, include_linenum, n_lines).select(*columns))


def ordered_lines(lines: DataFrame, zero_as_blank: bool = False, include_linenum: bool = True) -> DataFrame:
    """``file_id, mat, mf, mt, ofs, raw``: data lines and end records, dealt out and sorted as they are written.

    Files are split over tasks by range and no file is gathered into a row, so a file may
    be of any size; writing the partitions in turn gives its lines in order.  ``lines`` are counted and then read three times,
    for the end records, for the ranges and for the lines, so what is costly to make should be stored before. Tasks are as many as the lines
    need, so that none sorts more as files grow.
    """
    order = [*SECTION, "ofs"]
    n_lines = lines.count()
    every = _every_line(lines, zero_as_blank, include_linenum, n_lines)
    parts = -(-n_lines // LINES)
    ranges = every.repartitionByRange(parts, *order) if parts > 1 else every.repartitionByRange(*order)
    return ranges.sortWithinPartitions(*order)


def file_texts(lines: DataFrame, zero_as_blank: bool = False, include_linenum: bool = True) -> DataFrame:
    """``file_id, text``: each file as one string, for files that fit a row."""
    every = _every_line(lines, zero_as_blank, include_linenum)
    part = F.array_sort(F.collect_list(F.struct("mat", "mf", "mt", "ofs", "raw")))
    return every.groupBy("file_id").agg(part.alias("parts")).select("file_id", F.array_join(F.transform("parts", lambda p: p["raw"]), "\n").alias("text"))
