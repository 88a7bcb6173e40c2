import pytest

from fluxtape.layout import catalogue, lane, native
from fluxtape.layout.engine import Options, Writer, as_lists, cells_of, from_lists, read_section, write_section, zero_based
from fluxtape.layout.notation import LayoutError, descriptions, explain, parse


def trip(layout, document, **options):
    return read_section(layout, write_section(layout, document), Options(**options) if options else None)


def test_every_layout_parses():
    for dialect in catalogue.DIALECTS.values():
        for text in dialect.values():
            parse(text)


def test_cross_section_both_ways():
    doc = {"ZA": 1001.0, "AWR": 0.9991, "QM": 0.0, "QI": -1.5, "LR": 0, "xstable": {"NBT": [5], "INT": [2], "E": [1.0, 2.0, 3.0, 4.0, 5.0], "xs": [0.5, 0.25, 0.0, 1e-9, 7.0]}}
    assert trip(catalogue.find("endf6", 3, 1), doc) == doc


def test_triangle_and_directory():
    doc = {"ZA": 1.0, "AWR": 1.0, "NK": 1, "subsection": {1: {"E1": 0.0, "E2": 1.0, "LB": 7, "NT": 6, "NE": 3, "Ek": {1: 1.0, 2: 2.0, 3: 3.0}, "F": {1: {1: 1.0, 2: 2.0}, 2: {2: 3.0}}}}}
    assert trip(catalogue.find("endf6", 35, 18), doc) == doc
    doc = {"MFx": {1: 3}, "MTx": {1: 18}, "NCx": {1: 7}, "MOD": {1: 0}}
    assert trip("dir MFx[1] MTx[1] NCx[1] MOD[1]", doc) == doc


def test_repeat_and_lookahead():
    text = catalogue.find("errorr", 33, 1)
    doc = {"ZA": 1.0, "AWR": 2.0, "NMT": 1, "reaction": {1: {"MAT1": 0, "MT1": 2, "NG": 2, "NG2": {1: 2, 2: 1}, "IG2LO": {1: 1, 2: 2}, "IG": {1: 1, 2: 2}, "C": {1: {1: 0.5, 2: 0.25}, 2: {2: 1.0}}}}}
    assert trip(text, doc) == doc
    look = "if LF == 1 ~1\n    cont 0 0 LF A 0 0\nelse\n    cont 0 0 LF B 0 0"
    assert read_section(look, [f"{0:11d}{0:11d}{1:11d}{5:11d}{0:11d}{0:11d}"]) == {"LF": 1, "A": 5}


@pytest.mark.parametrize("options, fails", [({}, True), ({"ignore_number_mismatch": True}, False)])
def test_tolerated_number(options, fails):
    line = [f"{0:11d}{0:11d}{3:11d}{0:11d}{0:11d}{0:11d}"]
    if fails:
        with pytest.raises(LayoutError):
            read_section("cont 0 0 2? 0 0 0", line, Options(**options))
    else:
        read_section("cont 0 0 2? 0 0 0", line, Options(**options))


def test_linear_solve_loops_and_errors():
    line = f"{0:11d}{0:11d}{9:11d}{0:11d}{0:11d}{0:11d}"
    assert read_section("cont 0 0 2*N+1 0 0 0", [line]) == {"N": 4}
    with pytest.raises(LayoutError, match="expected"):
        read_section("cont 0 0 N 0 0 0\ncont 0 0 N+1 0 0 0", [line, line])
    with pytest.raises(LayoutError):
        read_section("stop no", [])
    with pytest.raises(LayoutError, match="whole"):
        write_section("cont 0 0 N 0 0 0", {"N": 1.5})
    assert read_section("for i = 1..0\n    cont 0 0 N 0 0 0", []) == {}


def test_packed_lines():
    for digits, count in ((2, 18), (3, 14), (4, 11), (6, 8)):
        doc = {"ND": digits, "II": 2, "JJ": 1, "K": {2: {k: k - 7 for k in range(1, count + 1)}}}
        lines = write_section("cont 0 0 ND 0 0 0\npacked ND II JJ K", doc)
        assert len(lines[1]) == (67 if digits == 3 else 66)
        assert read_section("cont 0 0 ND 0 0 0\npacked ND II JJ K", lines) == doc


def test_views_and_completeness():
    assert cells_of({"a": {1: 2.0}, "b": [3], "c": "x"}) == [(["a", "1"], None, 2.0, None, None), (["b", "0"], 3, 3.0, None, None), (["c"], None, None, "x", None)]
    assert zero_based({"a": {2: 1, 4: 3}}) == {"a": [1, None, 3]}
    nested = {"a": {0: {1: 2.0, 2: 3.0}, 1: {1: 4.0}}, "s": {1: {"X": [1.0], "v": {5: 1}}}}
    assert from_lists(*as_lists(nested)) == nested
    layout = "list 0 0 0 0 N 0\n    for i = 1..N\n        vals v[i]\nfor i = 1..M\n    section s[i]\n        cont x 0 0 0 0 0"
    document = {"N": 1, "v": {1: 1.0, 2: 2.0}, "M": 1, "s": {1: {"x": 1.0}, 2: {"x": 2.0}}}
    run = Writer(document)
    run.block(parse(layout))
    assert run.unused() == ["/v/2", "/s/2"]
    with pytest.raises(LayoutError, match="/v/2") as e:
        write_section(layout, document, Options(check_arrays=True))
    assert e.value.code == "unused_elements" and len(e.value.context) == 3


def test_abbreviations_in_loops():
    """One may be made in each turn of a loop, is seen in sections within, and goes with its own section."""
    layout = "cont 0 0 N 0 0 0\nfor i = 1..N\n    section r[i]\n        cont 0 0 A 0 0 0\n        let B = A+1\n        section q\n            cont 0 0 B 0 0 0\nlet B = 7\ncont 0 0 B 0 0 0"
    document = {"N": 2, "r": {1: {"A": 4, "q": {}}, 2: {"A": 9, "q": {}}}}
    lines = write_section(layout, document)
    assert [x[22:33].strip() for x in lines] == ["2", "4", "5", "9", "10", "7"]
    assert read_section(layout, lines) == document
    with pytest.raises(LayoutError) as e:
        read_section("cont 0 0 A 0 0 0\nlet A = 1", lines[:1])
    assert e.value.code == "abbreviation" and e.value.at == 1


def test_looking_ahead_counts_records():
    """The head and the body of a list are two: one record ahead sees only the head."""
    layout = "if L == 5 ~{0}\n    list 0 0 0 0 N 0\n        for i = 1..N\n            vals v[i]\n    cont 0 0 L 0 0 0\nelse\n    list 0 0 0 0 M 0\n        for i = 1..M\n            vals w[i]\n    cont 0 0 K 0 0 0"
    lines = write_section("list 0 0 0 0 N 0\n    for i = 1..N\n        vals v[i]\ncont 0 0 L 0 0 0", {"N": 14, "v": {i: 1.0 for i in range(1, 15)}, "L": 5})
    assert "v" in read_section(layout.format(3), lines) and "w" in read_section(layout.format(2), lines)


def test_kept_fields_and_strict_types():
    document = read_section("cont A B C D 0 0", ["  1.50000+0   2.50              3          4          0          0"], Options(preserve_value_strings=True))
    assert write_section("cont A B C D 0 0", document)[0][:22] == "  1.50000+0   2.50    "
    assert document["A"] == 1.5 and cells_of(document)[0][4] == "  1.50000+0"
    with pytest.raises(LayoutError):
        write_section("cont A B C D 0 0", {"A": 1.0, "B": 2.0, "C": 3.0, "D": 4}, Options(strict_datatypes=True))


def test_control_fields():
    lines = write_section("cont ZA AWR 0 0 0 0", {"ZA": 1.0, "AWR": 1.0}, control=(125, 3, 1))
    assert lines[0][66:] == " 125 3  1"
    assert read_section("cont ZA AWR 0 0 0 0", lines, control=(125, 3, 1)) == {"MAT": 125, "MF": 3, "MT": 1, "ZA": 1.0, "AWR": 1.0}
    for bad in (lambda: read_section("cont ZA AWR 0 0 0 0", lines, control=(125, 3, 2)), lambda: write_section("cont ZA AWR 0 0 0 0", {"MF": 4, "ZA": 1.0, "AWR": 1.0}, control=(125, 3, 1))):
        with pytest.raises(LayoutError) as e:
            bad()
        assert e.value.code == "control"


def test_descriptions():
    text = "#: ZA a number\ncont ZA AWR 0 0 N 0\nfor i = 1..N\n    section part[i]\n        #: Q an energy\n        cont Q 0 0 0 0 0\n#: v[i,j] values"
    assert descriptions(text) == (("ZA", "a number"), ("part/*/Q", "an energy"), ("v/*/*", "values"))
    assert explain(text, ["part", "3", "Q"]) == "an energy" and explain(text, ["part", "Q"]) is None
    assert [len(catalogue.find("endf6", mf, mt)) > 0 for mf, mt in ((1, 451), (3, 1))] == [True, True]


def test_straight_layouts_as_expressions(spark):
    """Column expressions and the section reader agree on documents and on the codes of defects."""
    layout = "cont ZA AWR 0 LRP 0 0\ntab1 QM ZA? 0 LR -> t E xs\ntext A{11} {5} B"
    document = {"ZA": 1.0, "AWR": 2.5, "LRP": 3, "QM": 0.5, "LR": 0, "t": {"NBT": [4], "INT": [2], "E": [1.0, 2.0, 3.0, 4.0], "xs": [1.5, 2.5, 3.5, 4.5]}, "A": "abc".ljust(11), "B": "x".ljust(50)}
    good = write_section(layout, document)
    assert native.is_straight(layout) and not native.is_straight("for i = 1..2\n    cont 0 0 0 0 0 0") and not native.is_straight("cont 2*N 0 0 0 0 0")
    zero = good[0][:22] + "          7" + good[0][33:]
    other = good[1][:11] + " 9.000000+0" + good[1][22:]
    bad = good[0][:11] + "     x     " + good[0][22:]
    cases = {"good": good, "short": good[:3], "none": [], "long": [*good, good[0]], "zero": [zero, *good[1:]], "other": [good[0], other, *good[2:]], "bad": [bad, *good[1:]]}
    frame = spark.createDataFrame(list(cases.items()), "k string, lines array<string>")
    for options in (Options(), Options.strict(), Options(ignore_varspec_mismatch=False), Options(fuzzy=True)):
        want = {r.k: r.code for r in lane.status(frame, ["k"], layout, options=options).collect()}
        got = {r.k: r for r in native.decoded(frame, ["k"], layout, options).collect()}
        assert {k: r.code for k, r in got.items()} == want
        assert got["good"].document.asDict(recursive=True) == document
