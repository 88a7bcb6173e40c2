"""Whole files through the facade and the command line."""

import io
import json

import pytest
from pyspark.sql import functions as F

from fluxtape import cli
from fluxtape.layout.engine import Options
from fluxtape.operators import cells as ce
from fluxtape.operators import description as de
from fluxtape.sources import tape_source
from fluxtape.streaming import arrivals
from fluxtape.tapes import TapeError, Tapes, dialects

HEAD = {"ZA": 1001.0, "AWR": 0.9991673}
FIRST = {
    **HEAD, "LRP": 0, "LFI": 0, "NLIB": 0, "NMOD": 1, "ELIS": 0.0, "STA": 0.0, "LIS": 0, "LISO": 0, "NFOR": 6, "AWI": 1.0, "EMAX": 2e7, "LREL": 0, "NSUB": 10, "NVER": 8,
    "TEMP": 0.0, "LDRV": 0, "NWD": 8, "NXC": 1, "ZSYMAM": "  1-H -  1 ", "ALAB": "LAB        ", "EDATE": "EVAL-JAN26", "AUTH": "SOMEONE".ljust(33), "REF": "REF".ljust(21),
    "DDATE": "DIST-JAN26", "RDATE": " " * 10, "ENDATE": "20260101", "HSUB": {1: "----ENDF/B-VIII.0     MATERIAL  125".ljust(66), 2: "-----INCIDENT NEUTRON DATA".ljust(66), 3: "------ENDF-6 FORMAT".ljust(66)},
    "DESCRIPTION": {i: t.ljust(66) for i, t in enumerate(("one", "two", "----ENDF/B-VII.0      MATERIAL  125"), 1)}, "MFx": {1: 3}, "MTx": {1: 1}, "NCx": {1: 99}, "MOD": {1: 1},
}


def table(scale=1.0):
    return {**HEAD, "QM": 0.0, "QI": 0.0, "LR": 0, "xstable": {"NBT": [3], "INT": [2], "E": [1e-5, 1.0, 2e7], "xs": [20.0 * scale, 10.0, 0.5]}}


def tape(scale=1.0):
    verbatim = ["anything at all".ljust(66) + " 12599  1"] * 2
    return {0: {0: ["a tape".ljust(66) + "   1 0  0"]}, 1: {451: {**FIRST, "MAT": 125, "MF": 1, "MT": 451}}, 3: {1: {**table(scale), "MAT": 125, "MF": 3, "MT": 1}, 2: {**table(), "MAT": 125, "MF": 3, "MT": 2}}, 99: {1: verbatim}}


@pytest.fixture
def file(spark, tmp_path):
    path = str(tmp_path / "a.endf")
    tapes = Tapes(spark)
    tapes.save(tapes.table(tape(), path), path)
    return path


def test_files_go_both_ways(spark, file):
    tapes = Tapes(spark)
    made = tapes.document(file)
    assert {mf: sorted(m) for mf, m in made.items()} == {0: [0], 1: [451], 3: [1, 2], 99: [1]}
    assert {k: v for k, v in made[3][1].items() if k not in ("MAT", "MF", "MT")} == table()
    text = open(file).read().split("\n")
    assert text[0][66:] == "   1 0  0    0" and text[-1][66:] == "  -1 0  0    0" and {len(x) for x in text} == {80}
    assert tapes.issues(tapes.lines(file)).count() == 0
    again = tapes.texts(tapes.parse(tapes.lines(file))).first().text
    assert again.split("\n") == text
    with pytest.raises(FileExistsError):
        tapes.save(tapes.parse(tapes.lines(file)), file)
    bare = Tapes(spark, include_linenum=False, zero_as_blank=True).texts(tapes.parse(tapes.lines(file))).first().text.split("\n")
    assert {len(x) for x in bare} == {75} and bare[-1] == " " * 66 + "  -1 0  0"


def test_parts_of_files(spark, file):
    tapes = Tapes(spark)
    rows = tapes.parse(tapes.lines(file), include=[(3, 1), 1]).collect()
    assert {(r.mf, r.mt): r.status for r in rows} == {(0, 0): "verbatim", (1, 451): "parsed", (3, 1): "parsed", (3, 2): "verbatim", (99, 1): "verbatim"}
    assert {(r.mf, r.mt) for r in tapes.listed(tapes.parse(tapes.lines(file), exclude=[3])).where("status = 'parsed'").collect()} == {(0, 0), (1, 451)}
    assert tapes.explain("3/1/xstable/xs") == "cross sections in barn" and tapes.explain("1/451/MFx/7") and tapes.explain("3/1/nothing") is None
    listed = Tapes(spark, array_type="list").document(file)[1][451]
    assert listed["MFx"] == [3] and listed["DESCRIPTION"][1].startswith("two")


def test_own_layouts_and_functions(spark, file):
    tapes = Tapes(spark, layouts={(3, 2): "cont A B 0 0 0 0\ntab1 0 0 0 0 -> t X Y"}, functions={(99, 1): lambda lines: {"n": len(lines)}, (3, 1): lambda lines: {}["missing"]})
    rows = {(r.mf, r.mt): r for r in tapes.parse(tapes.lines(file), nofail=True).collect()}
    assert json.loads(rows[3, 2].document)["t"]["Y"][1] == 10.0 and json.loads(rows[99, 1].document) == {"n": 2}
    assert (rows[3, 1].status, rows[3, 1].code) == ("failed", "function")
    with pytest.raises(ValueError):
        Tapes(spark, dialect="none")
    assert "pendf" in dialects()


def test_defects_are_told(spark, file, tmp_path):
    text = open(file).read().split("\n")
    at = next(i for i, x in enumerate(text) if x[70:75] == " 3  1")
    text[at + 1] = "x".rjust(11) + text[at + 1][11:]
    bad = tmp_path / "bad.endf"
    bad.write_text("\n".join(text))
    tapes = Tapes(spark)
    with pytest.raises(TapeError, match="MF 3, MT 1: bad_number"):
        tapes.document(str(bad))
    assert isinstance(tapes.document(str(bad), nofail=True)[3][1], list)
    assert cli.main(["validate", file, str(bad)]) == 1 and cli.main(["validate", file]) == 0
    (tmp_path / "open.endf").write_text("\n".join(text[:-1]))
    with pytest.raises(TapeError, match="missing_tend"):
        tapes.document(str(tmp_path / "open.endf"))


def test_kept_fields(spark, file):
    text = open(file).read().replace(" 9.991673-1", "   .9991673")
    open(file, "w").write(text)
    tapes = Tapes(spark, options=Options(preserve_value_strings=True))
    assert tapes.texts(tapes.parse(tapes.lines(file))).first().text == text
    assert ce.get(tapes.cells(tapes.parse(tapes.lines(file))), "3/1/AWR").first().src == "   .9991673"


def test_compare_and_match(spark, file, tmp_path, capsys):
    other = str(tmp_path / "b.endf")
    tapes = Tapes(spark)
    tapes.save(tapes.table(tape(1.5), other), other)
    assert cli.main(["compare", file, file]) == 0
    assert cli.main(["compare", file, other]) == 1
    assert capsys.readouterr().out.strip().split("\n")[-1] == "at path /3/1/xstable/xs/0: value"
    assert cli.main(["match", "-q", "/3/1/xstable/xs/* > 25", f"{tmp_path}/*.endf"]) == 0
    assert capsys.readouterr().out.split("\n")[:2] == [f"match: {other}", "  /3/1/xstable/xs/0 = 30.0"]
    assert cli.main(["match", "-q", "exists(/3/1/xstable) & !exists(/3/5)", file]) == 0
    assert capsys.readouterr().out.startswith("match")


def test_convert_and_show(spark, file, tmp_path, capsys):
    made, back = str(tmp_path / "a.json"), str(tmp_path / "back.endf")
    assert cli.main(["convert", "--to", "json", "--indent", "1", file, made]) == 0
    assert cli.main(["convert", "--to", "json", file, made]) == 1
    assert cli.main(["convert", "--to", "endf", "--include_linenum", made, back]) == 0
    assert open(back).read() == open(file).read()
    capsys.readouterr()
    assert cli.main(["show", "3/1/xstable", file]) == 0
    assert capsys.readouterr().out.split("\n")[:4] == ["E: subsection or array", "INT: subsection or array", "NBT: subsection or array", "xs: subsection or array"]
    assert cli.main(["show", "3/1/AWR", file]) == 0 and capsys.readouterr().out.strip() == "0.9991673"
    assert cli.main(["explain", "3/1/xstable/E", file]) == 0 and "eV" in capsys.readouterr().out


def test_edits(spark, file, tmp_path, monkeypatch):
    other = str(tmp_path / "b.endf")
    tapes = Tapes(spark)
    tapes.save(tapes.table(tape(2.0), other), other)
    assert cli.main(["replace", "3/1/xstable/xs", other, file]) == 0
    assert tapes.document(file)[3][1]["xstable"]["xs"] == [40.0, 10.0, 0.5]
    assert (tmp_path / "a.endf.bak").exists()
    assert cli.main(["replace", "-n", "3", other, file]) == 0 and not (tmp_path / "a.endf.bak.bak").exists()
    monkeypatch.setattr("sys.stdin", io.StringIO("new line\n"))
    assert cli.main(["insert-text", "-l", "1", file]) == 0 and (tmp_path / "a.endf.bak.bak").exists()
    first = tapes.document(file)[1][451]
    assert de.description(first).split("\n")[:3] == ["one", "new line", "two"] and first["NWD"] == 9
    assert [(first["MFx"][i], first["MTx"][i], first["NCx"][i], first["MOD"][i]) for i in sorted(first["MFx"])] == [(1, 451, 4 + 9 + 4, 0), (3, 1, 4, 1), (3, 2, 4, 0), (99, 1, 2, 0)]
    assert cli.main(["update-directory", "-n", file]) == 0 and tapes.document(file)[1][451] == first


def test_library_and_description(spark):
    done = de.with_library(FIRST, "FENDL-3.2")
    assert (done["NLIB"], done["NVER"], done["LREL"]) == (33, 3, 2) and done["DESCRIPTION"][3].startswith("----FENDL-3.2         MATERIAL")
    with pytest.raises(ValueError):
        de.with_library({**FIRST, "DESCRIPTION": {}}, "FENDL-3.2")
    frame = spark.createDataFrame([(json.dumps(FIRST), "x\ny"), (None, "x"), (json.dumps({"NWD": 5}), "only")], "d string, t string")
    got = [None if r.n is None else json.loads(r.n) for r in frame.select(de.edited(F.col("d"), de.with_inserted, F.col("t"), F.lit(0)).alias("n")).collect()]
    assert got[1] is None and got[0]["NWD"] == 10 and got[2]["DESCRIPTION"] == {"1": "only".ljust(66)}


def test_files_that_arrive(spark, file, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.endf").write_text(open(file).read())
    for stream, name, want in ((arrivals.stream_lines(spark, str(folder)), "arrived", len(open(file).read().split("\n"))), (arrivals.stream_sizes(spark, str(folder)), "sized", 4)):
        query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert spark.table(name).count() == want
    assert {(r.mf, r.mt): r.n_lines for r in spark.table("sized").collect()} == {(1, 451): 13, (3, 1): 4, (3, 2): 4, (99, 1): 2}


def test_the_source_writes_whole_files_or_none(spark, tmp_path):
    tape_source.register(spark)
    out = str(tmp_path / "out")
    files = spark.createDataFrame([("x/1", "one"), ("2", "two")], "file_id string, text string").repartition(2)
    files.write.format("tape80").mode("append").option("path", out).save()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["2.endf", "x_1.endf"]
    with pytest.raises(Exception, match="FileExistsError"):
        files.write.format("tape80").mode("append").option("path", out).save()
    with pytest.raises(Exception, match="twice"):
        files.union(files).write.format("tape80").mode("overwrite").option("path", out).save()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["2.endf", "x_1.endf"]


def test_views(spark):
    cells = spark.createDataFrame([("f", ["a", "1", "x"], 1.0, None), ("f", ["a", "2", "x"], 2.0, None), ("f", ["b"], None, "t")], "file_id string, path array<string>, f double, s string")
    view = ce.View(cells).at("a")
    assert view.name == "a" and view.at("1").parent.path == ["a"] and view.at("2/x").exists().count() == 1
    assert [r.f for r in view.at("2").at("x").get().collect()] == [2.0]
    changed = view.at("1/x").put(5.0).at("b").put("u").at("a[2]").remove()
    assert sorted((tuple(r.path), r.f, r.s) for r in changed.cells.collect()) == [(("a", "1", "x"), 5.0, None), (("b",), None, "u")]
    assert [r.equal for r in ce.equal_files(cells, cells).collect()] == [True] and [r.equal for r in ce.equal_files(cells, changed.cells).collect()] == [False]
    assert ce.get_many(cells, spark.createDataFrame([(["b"],), (["a", "1", "x"],)], "path array<string>")).count() == 2


def test_materials_of_one_file_are_told_apart(spark, tmp_path):
    from fluxtape.tapes import TapeError

    tapes, paths = Tapes(spark, dialect="endf6"), []
    parsed = None
    for mat in (9, 8):
        document = {3: {1: {"MAT": mat, "MF": 3, "MT": 1, "ZA": 1000.0 + mat, "AWR": 1.0, "QM": 0.0, "QI": 0.0, "LR": 0, "xstable": {"NBT": [2], "INT": [2], "E": [1.0, 2.0], "xs": [3.0, 4.0]}}}}
        made = tapes.table({**({0: {0: ["a tape".ljust(66) + "   1 0  0    0"]}} if mat == 9 else {}), **document}, "two")
        parsed = made if parsed is None else parsed.unionByName(made)
    tapes.save(parsed, str(tmp_path / "two"))
    again = tapes.parse(tapes.lines(str(tmp_path / "two")))
    got = ce.get(tapes.cells(again), "/3/1/ZA").collect()
    assert sorted((r.file_id.rpartition("#")[2], r.f) for r in got) == [("8", 1008.0), ("9", 1009.0)]
    assert len({(r.file_id, tuple(r.path)) for r in tapes.cells(again).collect()}) == tapes.cells(again).count()
    with pytest.raises(TapeError, match="8, 9"):
        tapes.document(str(tmp_path / "two"))
    assert tapes.document(str(tmp_path / "two"), mat=8)[3][1]["ZA"] == 1008.0


def test_cells_are_made_of_sections_that_were_parsed_once(spark):
    from fluxtape.layout import lane
    from fluxtape.tapes import KEYS

    document = {3: {1: {"MAT": 9, "MF": 3, "MT": 1, "ZA": 1009.0, "AWR": 1.0, "QM": 0.0, "QI": 0.0, "LR": 0, "xstable": {"NBT": [2], "INT": [2], "E": [1.0, 2.0], "xs": [3.0, 4.0]}}}}
    tapes, seen = Tapes(spark, dialect="endf6"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    sections = lane.rendered(tapes.table(document, "one"), KEYS, "endf6", tapes.options).select(*KEYS, "lines")
    parsed = lane.parsed(sections, KEYS, "endf6", tapes.options)
    cells = tapes.cells(parsed.mapInArrow(counted, parsed.schema))
    every = {(tuple(r.path), r.f) for r in cells.collect()}
    assert seen.value == 1
    for wanted in ([["3", "1", "ZA"]], [["3", "*", "xstable", "xs"], ["3", "1", "MAT"]], [["4"]]):
        some = {(tuple(r.path), r.f) for r in tapes.cells(parsed, wanted).collect()}
        assert some == {x for x in every if any(len(x[0]) >= len(w) and all(a in ("*", b) for a, b in zip(w, x[0])) for w in wanted)}
