"""Layouts over section tables: the Arrow lane for structures that columns cannot express."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import catalogue
from .engine import Kept, Options, as_lists, cells_of, from_lists, pruned, read_section, write_section
from .notation import LayoutError, descriptions

_CELLS = "path array<string>, i bigint, f double, s string, src string"
_PATH = pa.list_(pa.string())


def _keys(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _control(row: dict) -> tuple[int, int, int] | None:
    """A section's control fields, where the row and its lines have them."""
    if all(row.get(k) is not None for k in ("mat", "mf", "mt")) and row["lines"] and len(row["lines"][0]) >= 75:
        return row["mat"], row["mf"], row["mt"]
    return None


def _layout(given: str | None, dialect: str, row: dict) -> str | None:
    return given if given is not None else catalogue.find(dialect, row["mf"], row["mt"])


def cells(sections: DataFrame, keys: list[str], layout: str | None = None, dialect: str = "endf6-ext", options: Options | None = None) -> DataFrame:
    """``keys, path, i, f, s, src``: the values of each section that its layout reads; :func:`issues` tells of the others.

    ``sections`` has ``lines`` and, without a given layout, mf and mt.  Whole numbers are
    both in i and f, texts in s, and src is a number's field where the options keep it.
    """

    def run(batches):
        for batch in batches:
            rows, at = [], []
            for i, row in enumerate(batch.to_pylist()):
                text = _layout(layout, dialect, row)
                if text is None:
                    continue
                try:
                    made = cells_of(read_section(text, row["lines"], options, _control(row)))
                except LayoutError:
                    continue
                rows += made
                at += [i] * len(made)
            cols = list(zip(*rows)) if rows else [(), (), (), (), ()]
            where = pa.array(at, pa.int64())
            made = [pa.array(c, k) for c, k in zip(cols, (_PATH, pa.int64(), pa.float64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(where) for k in keys), *made], [*keys, "path", "i", "f", "s", "src"])

    return sections.mapInArrow(run, f"{_keys(sections, keys)}, {_CELLS}")


def status(sections: DataFrame, keys: list[str], layout: str | None = None, dialect: str = "endf6-ext", options: Options | None = None) -> DataFrame:
    """``keys, status, code``: parsed, verbatim (no layout) or failed with the reason's code; a failure stays with its section."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = _layout(layout, dialect, row)
                try:
                    if text is not None:
                        read_section(text, row["lines"], options, _control(row))
                    out.append(("verbatim" if text is None else "parsed", None))
                except LayoutError as e:
                    out.append(("failed", e.code))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(a, pa.string()), pa.array(b, pa.string())], [*keys, "status", "code"])

    return sections.mapInArrow(run, f"{_keys(sections, keys)}, status string, code string")


def issues(sections: DataFrame, keys: list[str], layout: str | None = None, dialect: str = "endf6-ext", options: Options | None = None) -> DataFrame:
    """``keys, code, message, at, context``: why a section does not fit its layout, the line it was found at, and the lines up to it, 20 at most."""

    def run(batches):
        for batch in batches:
            rows, where = [], []
            for i, row in enumerate(batch.to_pylist()):
                text = _layout(layout, dialect, row)
                try:
                    if text is not None:
                        read_section(text, row["lines"], options, _control(row))
                except LayoutError as e:
                    rows.append((e.code, str(e), e.at, e.context))
                    where.append(i)
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            made = [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(where, pa.int64())) for k in keys), *made], [*keys, "code", "message", "at", "context"])

    return sections.mapInArrow(run, f"{_keys(sections, keys)}, code string, message string, at int, context array<string>")


def described(cells: DataFrame, layout: str) -> DataFrame:
    """Cells with ``about``, what the layout says of their path; an index may stand for ``*``, and lists' places are left out."""
    path = F.col("path")
    bare = F.when(F.element_at(path, -1).rlike("^[0-9]+$"), F.slice(path, F.lit(1), F.size(path) - 1)).otherwise(path)

    def fits(steps: list[str], of: Column) -> Column:
        out = F.size(of) == len(steps)
        for i, step in enumerate(steps):
            if step != "*":
                out = out & (F.get(of, F.lit(i)) == step)
        return out

    known = [(pattern.split("/"), about) for pattern, about in descriptions(layout)]
    found = [F.when(fits(steps, path) | fits(steps, bare), F.lit(about)) for steps, about in known]
    return cells.withColumn("about", F.coalesce(*found) if found else F.lit(None).cast("string"))


def written(documents: DataFrame, keys: list[str], column: str, layout: str, options: Options | None = None) -> DataFrame:
    """``keys, code, n_lines``: whether each document in JSON can be written, and the reason's code where it can't."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(column).to_pylist():
                try:
                    out.append((None, len(write_section(layout, _plain(json.loads(text)), options))))
                except LayoutError as e:
                    out.append((e.code, None))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(a, pa.string()), pa.array(b, pa.int32())], [*keys, "code", "n_lines"])

    return documents.mapInArrow(run, f"{_keys(documents, keys)}, code string, n_lines int")


#: The only key of a number in JSON that stands for the field it was read from.
FIELD = "="


def encoded(value):
    """A document for JSON: numbers with a kept field as that field."""
    if isinstance(value, dict):
        return {k: encoded(v) for k, v in value.items()}
    if isinstance(value, list):
        return [encoded(v) for v in value]
    return {FIELD: value.src} if isinstance(value, Kept) else value


def decoded(value):
    """The document that :func:`encoded` was made from, with JSON's string keys back to indices."""
    if isinstance(value, dict) and list(value) == [FIELD]:
        return Kept.read(value[FIELD], True)
    if isinstance(value, dict):
        return _plain({k: decoded(v) for k, v in value.items()})
    return [decoded(v) for v in value] if isinstance(value, list) else value


def parsed(sections: DataFrame, keys: list[str], dialect: str = "endf6-ext", options: Options | None = None, layouts: dict | None = None, functions: dict | None = None) -> DataFrame:
    """``keys, status, code, message, at, document, lines`` of sections ``(keys, mat, mf, mt, lines)``.

    ``status`` is parsed, verbatim (no layout) or failed; ``document`` is JSON, and ``lines`` are
    kept where there is none.  ``layouts`` of (MF, MT), or (MF, -1), go before those of the
    dialect, and a function of (MF, MT) that makes a document of lines before both.
    """
    own, made_by = layouts or {}, functions or {}

    def find(mf: int, mt: int) -> str | None:
        for key in ((mf, mt), (mf, -1)):
            if key in own:
                return own[key]
        return catalogue.find(dialect, mf, mt)

    def one(row: dict) -> tuple:
        control = (row["mat"], row["mf"], row["mt"])
        try:
            if control[1:] in made_by:
                return "parsed", None, None, None, json.dumps(encoded(made_by[control[1:]](row["lines"]))), None
            text = find(*control[1:])
            if text is None:
                return "verbatim", None, None, None, None, row["lines"]
            return "parsed", None, None, None, json.dumps(encoded(read_section(text, row["lines"], options, _control(row)))), None
        except LayoutError as e:
            return "failed", e.code, str(e), getattr(e, "at", None), None, row["lines"]
        except Exception as e:  # a function of the caller's
            return "failed", "function", f"{type(e).__name__}: {e}", None, None, row["lines"]

    def run(batches):
        for batch in batches:
            cols = list(zip(*map(one, batch.to_pylist()))) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(c, k) for c, k in zip(cols, kinds))], [*keys, "status", "code", "message", "at", "document", "lines"])

    return sections.mapInArrow(run, f"{_keys(sections, keys)}, status string, code string, message string, at int, document string, lines array<string>")


def rendered(sections: DataFrame, keys: list[str], dialect: str = "endf6-ext", options: Options | None = None, layouts: dict | None = None) -> DataFrame:
    """``keys, code, lines``: lines of 75 columns of what :func:`parsed` gave, verbatim lines as they are."""
    own = layouts or {}

    def one(row: dict) -> tuple:
        control = (row["mat"], row["mf"], row["mt"])
        try:
            if row["document"] is None:
                return None, row["lines"]
            text = own.get(control[1:], own.get((control[1], -1), catalogue.find(dialect, *control[1:])))
            return None, write_section(text, decoded(json.loads(row["document"])), options, control)
        except LayoutError as e:
            return e.code, None

    def run(batches):
        for batch in batches:
            a, b = zip(*map(one, batch.to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(a, pa.string()), pa.array(b, pa.list_(pa.string()))], [*keys, "code", "lines"])

    return sections.mapInArrow(run, f"{_keys(sections, keys)}, code string, lines array<string>")


def document_cells(sections: DataFrame, keys: list[str], wanted: list[list[str]] | None = None) -> DataFrame:
    """Cells of what :func:`parsed` gave, below its MF and MT; the lines of other sections are texts counted from 0.

    With ``wanted`` paths, which begin with MF and MT, only cells at or below them are made.
    """

    def document_of(row: dict):
        made = json.loads(row["document"]) if row["document"] is not None else (row["lines"] or [])
        if wanted is not None:
            made = pruned({str(row["mf"]): {str(row["mt"]): made}}, wanted)
            made = made.get(str(row["mf"]), {}).get(str(row["mt"]), {})
        return decoded(made) if row["document"] is not None else made

    def run(batches):
        for batch in batches:
            rows, where = [], []
            for i, row in enumerate(batch.to_pylist()):
                made = cells_of({str(row["mf"]): {str(row["mt"]): document_of(row)}})
                rows += made
                where += [i] * len(made)
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (_PATH, pa.int64(), pa.float64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(where, pa.int64())) for k in keys), *(pa.array(c, k) for c, k in zip(cols, kinds))], [*keys, "path", "i", "f", "s", "src"])

    return sections.mapInArrow(run, f"{_keys(sections, keys)}, {_CELLS}")


def _plain(value):
    """JSON's string keys back to indices."""
    if isinstance(value, dict):
        out = {int(k) if isinstance(k, str) and k.isdigit() else k: _plain(v) for k, v in value.items()}
        if len(out) < len(value):
            raise LayoutError("key_clash", "two keys are the same number")
        return out
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _document(text: str, lists: bool) -> dict:
    made = json.loads(text)
    return _plain(from_lists(made["document"], made["starts"]) if lists else made)


def from_json(documents: DataFrame, keys: list[str], column: str, layout: str, options: Options | None = None, lists: bool = False) -> DataFrame:
    """``keys, lines``: sections written from documents in JSON, as :func:`to_json` makes them; one that does not fit gives null lines."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(column).to_pylist():
                try:
                    out.append(write_section(layout, _document(text, lists), options))
                except (LayoutError, KeyError, ValueError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.list_(pa.string()))], [*keys, "lines"])

    return documents.mapInArrow(run, f"{_keys(documents, keys)}, lines array<string>")


def to_json(sections: DataFrame, keys: list[str], layout: str | None = None, dialect: str = "endf6-ext", options: Options | None = None, lists: bool = False) -> DataFrame:
    """``keys, document``: each section as JSON; null where its layout does not fit.

    With ``lists`` the JSON holds ``document``, with arrays as lists from 0, and their first indices as ``starts``.
    """

    def shaped(document: dict):
        return dict(zip(("document", "starts"), as_lists(document))) if lists else document

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = _layout(layout, dialect, row)
                try:
                    out.append(None if text is None else json.dumps(shaped(read_section(text, row["lines"], options, _control(row)))))
                except LayoutError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.string())], [*keys, "document"])

    return sections.mapInArrow(run, f"{_keys(sections, keys)}, document string")
