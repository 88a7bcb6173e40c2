"""The command line: ``python -m fluxtape.cli COMMAND ...`` for single files and globs of files."""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .layout import lane
from .layout.engine import Options
from .operators import cells as ce
from .operators import description as de
from .tapes import KEYS, TapeError, Tapes

#: Options of the whole tape; the others are those of fields.
TAPE_FLAGS = ("ignore_blank_lines", "ignore_send_records", "ignore_missing_tpid", "include_linenum")
FIELD_FLAGS = tuple(f.name for f in fields(Options) if f.name not in ("ignore_all_mismatches", "check_arrays", "strict_datatypes"))
#: Other names by which an option may be given.
ALIASES = {"fuzzy": "--fuzzy_matching", "keep_e": "--keep_E"}


def _session() -> SparkSession:
    spark = SparkSession.builder.master(os.environ.get("FLUXTAPE_MASTER", "local[*]")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _tapes(args: argparse.Namespace, **given) -> Tapes:
    """Options that were given; a command's own defaults are in ``given``."""
    base = {k: given.pop(k) for k in list(given) if k in FIELD_FLAGS}
    own = {k: getattr(args, k) for k in FIELD_FLAGS if getattr(args, k) is not None}
    tape = {k: getattr(args, k) for k in TAPE_FLAGS if getattr(args, k) is not None}
    options = Options(**{"check_arrays": True, **base, **own})
    return Tapes(_session(), options=options, **{"include_linenum": False, "dialect": args.endf_format, "array_type": args.array_type, **given, **tape})


def _files(patterns: list[str]) -> list[str]:
    return [f for p in patterns for f in sorted(glob.glob(p)) or [p]]


def _backed_up(path: str) -> None:
    """Rename a file to one with more and more ``.bak`` at its end that is still free."""
    for k in range(1, 11):
        to = path + ".bak" * k
        try:
            os.link(path, to)
        except FileExistsError:
            continue
        os.unlink(path)
        return
    raise OSError(f"no free name to keep {path} under")


def _only(path: str) -> list | None:
    """The sections that a path needs."""
    steps = ce.parse_path(path)
    return None if not steps else [int(steps[0])] if len(steps) == 1 else [(int(steps[0]), int(steps[1]))]


def compare(args) -> int:
    tapes = _tapes(args)
    one, two = (tapes.cells(tapes.parse(tapes.lines(f))).withColumn("file_id", F.concat(F.lit("f"), F.regexp_extract("file_id", "(#[0-9]+)$", 1))) for f in args.files)
    rows = ce.in_order(ce.compare(one, two, args.rtol, args.atol)).collect()
    for r in rows:
        print(f"at path /{'/'.join(r.path)}: {r.code}")
    return int(bool(rows))


def convert(args) -> int:
    if os.path.exists(args.destfile):
        print(f"{args.destfile} exists already", file=sys.stderr)
        return 1
    tapes = _tapes(args)
    if args.to == "json":
        with open(args.destfile, "x", encoding="utf-8") as f:
            json.dump(lane.encoded(tapes.document(args.sourcefile)), f, indent=args.indent)
    else:
        with open(args.sourcefile, encoding="utf-8") as f:
            tapes.save(tapes.table(lane.decoded(json.load(f)), args.destfile), args.destfile)
    return 0


def validate(args) -> int:
    """Strict unless options are given; every file is looked at, and its first defect is told."""
    strict = {k: False for k in ("ignore_number_mismatch", "ignore_zero_mismatch", "ignore_varspec_mismatch", "fuzzy", "accept_spaces")}
    tapes, files = _tapes(args, **strict), _files(args.files)
    lines = tapes.lines(files)
    broken = {}
    for r in tapes.issues(lines).groupBy("file_id").agg(F.min(F.struct("ofs", "code")).alias("x")).collect():  # one row a file
        broken[r.file_id] = f"line {r.x.ofs + 1}: {r.x.code}"
    failed = tapes.parse(lines, nofail=True).where("status = 'failed'")
    for r in failed.groupBy("file_id").agg(F.min(F.struct("mf", "mt", "code", "message")).alias("x")).collect():
        broken.setdefault(r.file_id, f"MF {r.x.mf}, MT {r.x.mt}: {r.x.code}: {r.x.message}")
    for f in files:
        why = broken.get(os.path.abspath(f))
        print(f"failed - {f}: {why}" if why else f"ok - {f}")
    return int(bool(broken))


def _subtree(document, steps: list[str]):
    for s in steps:
        document = document[int(s) if s.isdigit() else s]
    return document


def _put(document: dict, steps: list[str], value) -> dict:
    at = document
    for s in steps[:-1]:
        at = at.setdefault(int(s), {}) if s.isdigit() and isinstance(at, dict) else at[int(s)] if s.isdigit() else at.setdefault(s, {})
    at[int(steps[-1]) if steps[-1].isdigit() else steps[-1]] = value
    return document


def replace(args) -> int:
    """A whole MF or section is moved as it is; below that a value is put into the parsed section, whose other fields stay."""
    steps = ce.parse_path(args.endfpath)
    deep = len(steps) > 2
    tapes = _tapes(args, ignore_zero_mismatch=False, ignore_send_records=True, ignore_missing_tpid=True, **({"preserve_value_strings": True} if deep else {}))
    source = tapes.document(args.sourcefile, include=_only(args.endfpath) if deep else [])
    part = _subtree(source, steps)
    for path in _files(args.destfile):
        made = tapes.document(path, include=_only(args.endfpath) if deep else [])
        table = tapes.table(_put(made, steps, part), path)
        texts = tapes.texts(table).first()
        _replaced(path, texts.text, not args.no_backup)
    return 0


def _replaced(path: str, text: str, backup: bool) -> None:
    if backup:
        _backed_up(path)
    with open(f"{path}.part", "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(f"{path}.part", path)


def show(args) -> int:
    tapes = _tapes(args)
    steps = ce.parse_path(args.endfpath)
    cells = tapes.cells(tapes.parse(tapes.lines(args.file), include=_only(args.endfpath)))
    value = ce.get(cells, args.endfpath).first()
    if value is not None:
        print(value.s if value.s is not None else value.i if value.i is not None else value.f)
        return 0
    rows = sorted(ce.children(cells, args.endfpath).collect(), key=lambda r: (r.step.isdigit(), int(r.step) if r.step.isdigit() else 0, r.step))
    own = {r.path[-1]: r for r in ce.get(cells, f"{args.endfpath}/*").collect()}
    for r in rows:
        v = own.get(r.step)
        print(f"{r.step}: subsection or array" if v is None else f"{r.step}: {v.s if v.s is not None else v.i if v.i is not None else v.f}")
    return int(not rows and bool(steps))


def _first_section(args, change) -> int:
    """Change MF 1, MT 451 of a file and set its directory right."""
    tapes = _tapes(args)
    parsed = tapes.parse(tapes.lines(args.file), include=[(1, 451)])
    counts = [(r.mf, r.mt, r.n) for r in parsed.where("mf <> 0").select("mf", "mt", F.size("lines").alias("n"), "document").where("document IS NULL").collect()]  # one file
    head = parsed.where("mf = 1 AND mt = 451").first()
    if head is None or head.document is None:
        print(f"{args.file} has no MF 1, MT 451 that can be read", file=sys.stderr)
        return 1
    document = de.with_directory(change(lane.decoded(json.loads(head.document))), counts)
    made = tapes.spark.createDataFrame([(*(head[k] for k in KEYS), "parsed", json.dumps(lane.encoded(document)), None)], "file_id string, mat int, mf int, mt int, status string, document string, lines array<string>")
    rest = parsed.where("NOT (mf = 1 AND mt = 451)").select(*KEYS, "status", "document", "lines")
    _replaced(args.file, tapes.texts(rest.unionByName(made)).first().text, not args.no_backup)
    return 0


def update_directory(args) -> int:
    return _first_section(args, lambda document: document)


def insert_text(args) -> int:
    text = sys.stdin.read().rstrip("\n")
    return _first_section(args, lambda document: de.with_inserted(document, text, args.line))


def explain(args) -> int:
    about = _tapes(args).explain(args.endfpath)
    print(about or "not described")
    return int(about is None)


def match(args) -> int:
    tapes, files = _tapes(args), _files(args.files)
    parsed = tapes.parse(tapes.lines(files), nofail=True)
    broken = {r.file_id for r in parsed.where("status = 'failed'").select("file_id").distinct().collect()}
    cells = tapes.cells(parsed)
    bare = lambda name: name if name in files else name.rpartition("#")[0] or name  # noqa: E731, a material's file
    hits, shown = {bare(r.file_id) for r in ce.matched(cells, args.query).collect()} - broken, {}
    try:
        for r in ce.first_binding(cells, args.query).collect():
            shown[bare(r.file_id)] = "\n".join(f"  /{'/'.join(b.path)}" + ("" if b.f is None else f" = {b.f}") for b in r.binding)
    except ValueError:  # relations that have no first binding here are matched all the same
        pass
    for f in files:
        name = os.path.abspath(f)
        if name in broken:
            print(f"parsing failed: {f}")
        elif name in hits:
            print(f"match: {f}")
            if shown.get(name):
                print(shown[name])
    return int(bool(broken))


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fluxtape")
    commands = top.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    for name in (*FIELD_FLAGS, *TAPE_FLAGS):
        common.add_argument(f"--{name}", *([ALIASES[name]] if name in ALIASES else []), dest=name, action="store_const", const=True, default=None)
    common.add_argument("--endf_format", default="endf6-ext")
    common.add_argument("--array_type", default="dict", choices=["dict", "list"])
    backup = argparse.ArgumentParser(add_help=False)
    backup.add_argument("-n", "--no-backup", action="store_true")

    def add(name: str, run, *parents):
        made = commands.add_parser(name, parents=[common, *parents], help=run.__doc__)
        made.set_defaults(run=run)
        return made

    p = add("compare", compare)
    p.add_argument("--atol", type=float, default=1e-8)
    p.add_argument("--rtol", type=float, default=1e-6)
    p.add_argument("files", nargs=2)
    p = add("convert", convert)
    p.add_argument("--to", choices=["json", "endf"], required=True)
    p.add_argument("--indent", type=int)
    p.add_argument("sourcefile")
    p.add_argument("destfile")
    add("validate", validate).add_argument("files", nargs="+")
    p = add("replace", replace, backup)
    p.add_argument("endfpath")
    p.add_argument("sourcefile")
    p.add_argument("destfile", nargs="+")
    for name, run in (("show", show), ("explain", explain)):
        p = add(name, run)
        p.add_argument("endfpath")
        p.add_argument("file")
    add("update-directory", update_directory, backup).add_argument("file")
    p = add("insert-text", insert_text, backup)
    p.add_argument("-l", "--line", type=int, default=0)
    p.add_argument("file")
    p = add("match", match)
    p.add_argument("--query", "-q", required=True)
    p.add_argument("files", nargs="+")
    return top


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        return args.run(args)
    except (TapeError, FileNotFoundError, FileExistsError, ValueError, KeyError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
