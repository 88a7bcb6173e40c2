from fluxtape.operators import tape as tp
from fluxtape.sources import tape_source


def _line(mat, mf, mt):
    return " " * 66 + f"{mat:4d}{mf:2d}{mt:3d}"


def test_sections_and_texts_round_trip(spark, tmp_path):
    rows = [("f", i, _line(*k)) for i, k in enumerate([(9, 3, 2), (9, 3, 2), (9, 3, 1), (8, 1, 451)])]
    lines = tp.with_control(spark.createDataFrame(rows, "file_id string, ofs int, raw string"))
    got = {(r.mat, r.mf, r.mt): r.n_lines for r in tp.sections(lines).collect()}
    assert got == {(9, 3, 2): 2, (9, 3, 1): 1, (8, 1, 451): 1}
    texts = tp.file_texts(lines)
    text = texts.first().text.split("\n")
    assert [x[66:75] for x in text] == [_line(*k)[66:] for k in [(8, 1, 451), (8, 1, 0), (8, 0, 0), (0, 0, 0), (9, 3, 1), (9, 3, 0), (9, 3, 2), (9, 3, 2), (9, 3, 0), (9, 0, 0), (0, 0, 0), (-1, 0, 0)]]
    assert [r.code for r in tp.end_record_issues(tp.split_text(texts, "file_id", "text")).collect()] == ["no_tape_head"]
    assert tp.end_record_issues(tp.split_text(texts, "file_id", "text"), ignore_missing_tpid=True).count() == 0
    headed = lines.unionByName(spark.createDataFrame([("f", -1, _line(1, 0, 0), 1, 0, 0)], "file_id string, ofs int, raw string, mat int, mf int, mt int"))
    full = tp.file_texts(headed)
    assert tp.end_record_issues(tp.split_text(full, "file_id", "text")).count() == 0
    assert [r.raw for r in tp.ordered_lines(headed).collect()] == full.first().text.split("\n")
    assert tp.tape_heads(tp.split_text(full, "file_id", "text")).first().raw == _line(1, 0, 0)
    assert [r.raw[75:] for r in tp.renumbered(lines).orderBy("mat", "mt", "ofs").collect()] == ["    1", "    1", "    1", "    2"]
    tape_source.register(spark)
    out = str(tmp_path / "out")
    texts.write.format("tape80").mode("append").option("path", out).save()
    back = spark.read.format("tape80").option("path", f"{out}/*.endf").load()
    assert back.where("mf = 3 AND mt = 2").count() == 2
    assert tp.read_lines(spark, out).count() == len(text)


def test_include_and_exclude(spark):
    lines = tp.with_control(spark.createDataFrame([("f", i, _line(1, mf, mt)) for i, (mf, mt) in enumerate([(3, 1), (3, 2), (4, 2)])], "file_id string, ofs int, raw string"))
    assert tp.keep_sections(lines, include=[(3, 2), 4]).count() == 2
    assert tp.keep_sections(lines, include=[4], exclude=[3]).count() == 1


def test_numbers_grow(spark):
    keys = [(9, 3, 2), (9, 3, 0), (9, 3, 1), (9, 3, 0), (9, 0, 0), (9, 1, 5), (9, 1, 0), (9, 0, 0), (0, 0, 0), (8, 1, 1), (8, 1, 0), (8, 0, 0), (0, 0, 0), (-1, 0, 0)]
    lines = spark.createDataFrame([("f", i, _line(*k)) for i, k in enumerate([(1, 0, 0), *keys])], "file_id string, ofs int, raw string")
    assert tp.end_record_issues(lines).count() == 0
    assert sorted((r.ofs, r.code) for r in tp.end_record_issues(lines, ascending=True).collect()) == [(3, "mt_order"), (6, "mf_order")]
