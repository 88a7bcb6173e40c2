"""The registered queries over evaluated-data sections, with their SQL.

Each query renders driver columns as fields, records or sections, and decodes,
validates, matches, compares or edits those; its SQL states the expected answer on
the original columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fields as fd
from ..layout import catalogue as layouts
from ..layout import columns, lane, native
from ..layout.engine import Options
from ..operators import cells as ce
from ..operators import description as de
from ..operators import records as rc
from ..operators import tape as tp
from ..sources.files import write_files
from ..sources.stored import fresh_path, stored
from ..tapes import KEYS, Tapes

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str = ""):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = " ".join(sql.split())
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


C, L = F.col, F.lit


def _blank():
    """An empty field; made when a query is, because it needs a session."""
    return L(" " * 11)


# -- number fields


@_query("SELECT l_orderkey, l_linenumber, l_extendedprice AS v FROM lineitem")
def q01_fort_float_parse(spark, sf):
    text = fd.float_field(C("l_extendedprice"), prefer_noexp=True)
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fd.fort_float(text).alias("v"))


@_query("SELECT o_orderkey, CAST(format('{:.6e}', o_totalprice) AS DOUBLE) AS v FROM orders")
def q02_fort_float_spaces(spark, sf):
    text = fd.float_field(C("o_totalprice"))
    spaced = F.concat(F.substring(text, 1, 4), L(" "), F.substring(text, 5, 20), L("  "))
    return _t(spark, sf, "orders").select("o_orderkey", fd.fort_float(spaced).alias("v"))


@_query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_nationkey END::BIGINT AS v FROM customer")
def q03_fort_int_blank(spark, sf):
    text = F.when(C("c_custkey") % 7 == 0, _blank()).otherwise(fd.int_field(C("c_nationkey")))
    return _t(spark, sf, "customer").select("c_custkey", fd.fort_int(text).alias("v"))


@_query(r"SELECT o_orderkey, lpad(regexp_replace(format('{:.6e}', o_totalprice), 'e([+-])0*([0-9]+)$', '\1\2'), 11, ' ') AS v FROM orders")
def q04_float_to_exp(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", fd.float_field(C("o_totalprice")).alias("v"))


@_query(r"SELECT o_orderkey, lpad(regexp_replace(format('{:.5e}', o_totalprice), 'e([+-])0*([0-9]+)$', 'e\1\2'), 11, ' ') AS v FROM orders")
def q05_float_to_exp_keep_e(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", fd.float_field(C("o_totalprice"), keep_e=True).alias("v"))


@_query(r"SELECT p_partkey, lpad(regexp_replace(regexp_replace(format('{:.2f}', p_retailprice), '0+$', ''), '\.$', ''), 11, ' ') AS v FROM part")
def q06_float_noexp(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", fd.float_field(F.round("p_retailprice", 2), prefer_noexp=True).alias("v"))


@_query("SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 11, '0') AS src, CAST(o_custkey AS DOUBLE) AS v FROM orders")
def q07_source_string(spark, sf):
    src = F.lpad(C("o_custkey").cast("string"), 11, "0")
    kept = F.struct(fd.fort_float(src).alias("v"), src.alias("src"))
    return _t(spark, sf, "orders").select("o_orderkey", kept.alias("k")).select("o_orderkey", "k.src", "k.v")


@_query("SELECT l_orderkey, l_linenumber, abs(l_extendedprice - round(l_extendedprice, 0)) <= 1e-8 + 1e-5 * abs(round(l_extendedprice, 0)) AS v FROM lineitem")
def q08_isclose(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fd.is_close(C("l_extendedprice"), F.round("l_extendedprice", 0)).alias("v"))


@_query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: 3 * CAST(x AS DOUBLE))), 6) AS v, true AS close FROM embeddings")
def q09_vector_ops(spark, sf):
    xs = F.transform("embedding", lambda x: x.cast("double"))
    triple = fd.vector_op(fd.vector_op(xs, xs, lambda a, b: a + b), xs, lambda a, b: a + b)
    total = F.aggregate(triple, L(0.0), lambda a, x: a + x)
    return _t(spark, sf, "embeddings").select("vec_id", F.round(total, 6).alias("v"), fd.all_close(triple, F.transform(xs, lambda x: x * 3)).alias("close"))


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 4 = 0 THEN l_orderkey // 4 END AS v FROM lineitem")
def q10_exact_div(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fd.try_exact_div(C("l_orderkey"), L(4)).alias("v"))


@_query("SELECT event_id, ((3 - event_id) % 6 + 6) % 6 AS v FROM events")
def q11_floor_mod(spark, sf):
    return _t(spark, sf, "events").select("event_id", fd.floor_mod(L(3) - C("event_id"), L(6)).alias("v"))


# -- records


def _order_lines(spark, sf) -> DataFrame:
    """One HEAD line per order with 1/2/3 as control, files of one order each."""
    body = rc.cont_body(fd.float_field(C("o_totalprice"), prefer_noexp=True), _blank(), C("o_custkey"), L(0), F.length("o_orderpriority"), L(0))
    ctrl = rc.control(C("o_custkey") % 9999 + 1, C("o_orderkey") % 40 + 1, C("o_orderkey") % 900 + 1)
    return _t(spark, sf, "orders").select("*", rc.numbered(body, ctrl, L(1)).alias("line"))


@_query("SELECT o_orderkey, o_totalprice AS c1, 0.0::DOUBLE AS c2, o_custkey AS l1, length(o_orderpriority)::BIGINT AS n1 FROM orders")
def q12_cont_roundtrip(spark, sf):
    got = rc.read_cont(C("line"))
    return _order_lines(spark, sf).select("o_orderkey", *(got[k].alias(k) for k in ("c1", "c2", "l1", "n1")))


@_query("SELECT c_custkey, substring(c_name, 1, 22) AS name, c_mktsegment AS segment FROM customer")
def q13_text_roundtrip(spark, sf):
    line = F.concat(F.rpad("c_name", 22, " "), F.rpad("c_mktsegment", 44, " "))
    cells = lane.cells(_t(spark, sf, "customer").select("c_custkey", F.array(line).alias("lines")), ["c_custkey"], "text NAME{22} SEGMENT{44}")
    one = lambda name: F.max(F.when(ce.matches(C("path"), [name]), F.rtrim("s"))).alias(name.lower())
    return cells.groupBy("c_custkey").agg(one("NAME"), one("SEGMENT"))


@_query("SELECT n_nationkey::BIGINT AS l1, n_regionkey::BIGINT AS l2, length(n_name)::BIGINT AS n1 FROM nation")
def q14_dir_roundtrip(spark, sf):
    got = rc.read_dir(rc.dir_body(C("n_nationkey"), C("n_regionkey"), F.length("n_name"), L(0)))
    return _t(spark, sf, "nation").select(*(got[k].alias(k) for k in ("l1", "l2", "n1")))


@_query("""SELECT vec_id, k, (vec_id % 90000)::BIGINT AS ii, k AS jj, list_concat(v[(k - 1) * 18 + 1:k * 18], list_transform(range(greatest(0, k * 18 - len(v))::BIGINT), lambda x: 0)) AS v
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 50) AS BIGINT)) AS v, unnest(range(1, (len(embedding) + 17) // 18 + 1)) AS k FROM embeddings)""")
def q15_intg_roundtrip(spark, sf):
    """Whole vectors over as many packed lines as they need."""
    values = F.transform("embedding", lambda x: F.floor(x.cast("double") * 50).cast("bigint"))
    parts = F.posexplode(rc.packed_parts(values, 2)).alias("k", "part")
    packed = _t(spark, sf, "embeddings").select("vec_id", parts).withColumn("k", (C("k") + 1).cast("bigint"))
    got = rc.read_packed(rc.packed_body(C("vec_id") % 90000, C("k"), C("part"), 2), 2)
    return packed.select("vec_id", "k", got["ii"].alias("ii"), got["jj"].alias("jj"), got["values"].alias("v"))


def _list_sections(spark, sf) -> DataFrame:
    """``file_id, lines`` of a LIST per order: quantities and prices interleaved, in line order."""
    part = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice")))
    orders = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(part.alias("p"))
    values = F.flatten(F.transform("p", lambda x: F.array(x["l_quantity"], x["l_extendedprice"])))
    orders = orders.select(C("l_orderkey").alias("file_id"), fd.float_fields(values, prefer_noexp=True).alias("fields"))
    head = F.rpad(rc.cont_body(_blank(), _blank(), L(0), L(0), F.size("fields"), F.size("fields") / 2), 66, " ")
    return orders.select("file_id", F.concat(F.array(head), rc.value_lines(C("fields"))).alias("lines"))


ITEMS = "list 0 0 0 0 2*N N\n    for i = 1..N\n        section item[i]\n            vals q p"


@_query("SELECT l_orderkey AS file_id, count(*) * 2 AS n1, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY l_orderkey")
def q16_list_roundtrip(spark, sf):
    got = rc.read_list(C("lines"))
    return _list_sections(spark, sf).select("file_id", got["n1"].alias("n1"), rc.every_other(got["values"], 0).alias("q"))


def _tab1_sections(spark, sf) -> DataFrame:
    """``file_id, lines`` of a TAB1 per user: event rank and value."""
    part = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.round("value", 2).alias("v"))))
    users = _t(spark, sf, "events").groupBy("user_id").agg(part.alias("p"))
    points = F.flatten(F.transform("p", lambda x, i: F.array((i + 1).cast("double"), x["v"])))
    users = users.select("user_id", F.size("p").alias("n"), fd.float_fields(points, prefer_noexp=True).alias("fields"))
    head = F.rpad(rc.cont_body(_blank(), _blank(), L(0), L(0), L(1), C("n")), 66, " ")
    table = rc.value_lines(F.array(fd.int_field(C("n")), fd.int_field(L(2))))
    return users.select(C("user_id").alias("file_id"), F.concat(F.array(head), table, rc.value_lines(C("fields"))).alias("lines"))


@_query("SELECT user_id AS file_id, count(*) AS np, count(*) AS nbt, list(round(value, 2) ORDER BY ts, event_id) AS y FROM events GROUP BY user_id")
def q17_tab1_roundtrip(spark, sf):
    got = rc.read_tab1(C("lines"))
    return _tab1_sections(spark, sf).select("file_id", got["n2"].alias("np"), F.get(got["nbt"], L(0)).alias("nbt"), got["y"].alias("y"))


NESTED = "tab2 0 0 0 0 NS\nfor s = 1..NS\n    section segment[s]\n        tab1 0 0 0 0 -> t X Y"


@_query("""SELECT c_nationkey::BIGINT AS file_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment)::VARCHAR AS segment, count(*) AS n,
  round(sum(round(c_acctbal, 2)), 2) AS total FROM customer GROUP BY c_nationkey, c_mktsegment""")
def q18_tab2_nested(spark, sf):
    part = F.array_sort(F.collect_list(F.struct("c_custkey", F.round("c_acctbal", 2).alias("b"))))
    segs = _t(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(part.alias("p"))
    points = F.flatten(F.transform("p", lambda x, i: F.array((i + 1).cast("double"), x["b"])))
    segs = segs.select("c_nationkey", "c_mktsegment", F.size("p").alias("n"), fd.float_fields(points, prefer_noexp=True).alias("fields"))
    head = F.rpad(rc.cont_body(_blank(), _blank(), L(0), L(0), L(1), C("n")), 66, " ")
    segs = segs.select("c_nationkey", "c_mktsegment", F.concat(F.array(head), rc.value_lines(F.array(fd.int_field(C("n")), fd.int_field(L(2)))), rc.value_lines(C("fields"))).alias("lines"))
    nations = segs.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_mktsegment", "lines"))).alias("p"))
    top = F.rpad(rc.cont_body(_blank(), _blank(), L(0), L(0), L(1), F.size("p")), 66, " ")
    lines = F.concat(F.array(top), rc.value_lines(F.array(fd.int_field(F.size("p")), fd.int_field(L(1)))), F.flatten(F.transform("p", lambda x: x["lines"])))
    got = columns.cells(nations.select(C("c_nationkey").cast("bigint").alias("file_id"), lines.alias("lines")), ["file_id"], NESTED)
    ys = got.where(ce.matches(C("path"), ["segment", "*", "t", "Y", "*"]))
    return ys.groupBy("file_id", F.get("path", L(1)).alias("segment")).agg(F.count("*").alias("n"), F.round(F.sum("f"), 2).alias("total"))


@_query("SELECT o_orderkey, o_custkey % 9999 + 1 AS mat, o_orderkey % 40 + 1 AS mf, o_orderkey % 900 + 1 AS mt FROM orders")
def q19_ctrl_decode(spark, sf):
    got = rc.read_control(C("line"))
    return _order_lines(spark, sf).select("o_orderkey", *(got[k].alias(k) for k in ("mat", "mf", "mt")))


@_query("SELECT event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 99999 + 1)::BIGINT AS ns FROM events")
def q20_line_numbers(spark, sf):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    line = rc.numbered(F.rpad(fd.float_field(C("value")), 66, " "), rc.control(L(1), L(3), L(1)), tp.line_number(place))
    return _t(spark, sf, "events").select("event_id", line.alias("line")).select("event_id", fd.fort_int(F.substring("line", 76, 5)).alias("ns"))


def _item_tape(spark, sf) -> DataFrame:
    """``file_id, ofs, raw``: a line per item; file = customer block, MAT = order, MF = linenumber, MT = quantity."""
    body = rc.cont_body(fd.float_field(C("l_extendedprice"), prefer_noexp=True), _blank(), C("l_partkey"), C("l_suppkey"), L(0), L(0))
    ctrl = rc.control(C("l_orderkey") % 9999 + 1, C("l_linenumber"), C("l_quantity").cast("int"))
    items = _t(spark, sf, "lineitem")
    line = F.explode(F.array(F.concat(F.rpad(body, 66, " "), ctrl)))  # rendered once, as conditions on its columns stay behind it
    return items.select((C("l_orderkey") / 9999).cast("bigint").alias("file_id"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("ofs"), line.alias("raw"))


@_query("""SELECT CAST(floor(l_orderkey / 9999) AS BIGINT) AS file_id, l_orderkey % 9999 + 1 AS mat, l_linenumber::BIGINT AS mf, CAST(l_quantity AS BIGINT) AS mt, count(*) AS n_lines FROM lineitem GROUP BY ALL""")
def q21_section_split(spark, sf):
    return tp.section_sizes(tp.with_control(_item_tape(spark, sf))).select(*tp.SECTION, "n_lines")


@_query("""SELECT 'include' AS rule, l_orderkey * 10 + l_linenumber AS ofs, l_linenumber::BIGINT AS mf, CAST(l_quantity AS BIGINT) AS mt FROM lineitem WHERE l_linenumber = 3 OR (l_linenumber = 1 AND CAST(l_quantity AS BIGINT) = 5)
  UNION ALL SELECT 'exclude', l_orderkey * 10 + l_linenumber, l_linenumber, CAST(l_quantity AS BIGINT) FROM lineitem WHERE NOT (l_linenumber = 2 OR (l_linenumber = 4 AND CAST(l_quantity AS BIGINT) = 7))""")
def q22_include_exclude(spark, sf):
    """The lines that are kept by each rule; with both, the exclusion counts."""
    lines = tp.with_control(_item_tape(spark, sf))
    kept = tp.keep_sections(lines, include=[3, (1, 5)]).withColumn("rule", L("include"))
    left = tp.keep_sections(lines, include=[3], exclude=[2, (4, 7)]).withColumn("rule", L("exclude"))
    return kept.unionByName(left).select("rule", "ofs", "mf", "mt")


# -- validation


def _dirty(spark, sf) -> DataFrame:
    """One-line sections per order with a defect by o_orderkey % 5: none, non-zero in a zero slot, bad digit, missing line, wrong constant."""
    kind = C("o_orderkey") % 5
    l2 = F.when(kind == 1, 7).otherwise(0)
    n2 = F.when(kind == 4, 9).otherwise(2)
    good = rc.cont_body(fd.float_field(C("o_totalprice"), prefer_noexp=True), _blank(), C("o_custkey"), l2, L(1), n2)
    bad = F.concat(F.substring(good, 1, 22), F.rpad(L("  1x"), 11, " "), F.substring(good, 34, 33))
    lines = F.when(kind == 2, F.array(bad)).when(kind == 3, F.array().cast("array<string>")).otherwise(F.array(good))
    return _t(spark, sf, "orders").select(C("o_orderkey").alias("file_id"), lines.alias("lines"))


DIRTY = "cont P 0 K 0 1 2"
_CODES = "CASE o_orderkey % 5 WHEN 1 THEN {1} WHEN 2 THEN 'bad_number' WHEN 3 THEN 'missing_line' WHEN 4 THEN {4} END"


@_query(f"SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 5 = 0 THEN 'parsed' ELSE 'failed' END AS status, {_CODES.replace('{1}', chr(39) + 'mismatch' + chr(39)).replace('{4}', chr(39) + 'mismatch' + chr(39))} AS code FROM orders")
def q23_strict_validate(spark, sf):
    return columns.status(_dirty(spark, sf), ["file_id"], DIRTY, options=Options(ignore_zero_mismatch=False, ignore_varspec_mismatch=False))


@_query("SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'parsed' ELSE 'failed' END AS status FROM orders")
def q24_zero_slot_policy(spark, sf):
    return columns.status(_dirty(spark, sf), ["file_id"], DIRTY).select("file_id", "status")


@_query("SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 5 IN (0, 1, 4) THEN 'parsed' ELSE 'failed' END AS status FROM orders")
def q25_desired_number_policy(spark, sf):
    return columns.status(_dirty(spark, sf), ["file_id"], "cont P 0 K 0 1 2?", options=Options(ignore_number_mismatch=True)).select("file_id", "status")


@_query("SELECT l_orderkey, l_linenumber, abs(round(l_extendedprice, 1) - l_extendedprice) <= 1e-7 + 1e-5 * abs(l_extendedprice) AS ok FROM lineitem")
def q26_fuzzy_match(spark, sf):
    """A variable that is met again with fewer digits: read with the option of fuzzy matching, each line a section."""
    lines = [F.rpad(rc.cont_body(fd.float_field(x, prefer_noexp=True), _blank(), L(0), L(0), L(0), L(0)), 66, " ") for x in (C("l_extendedprice"), F.round("l_extendedprice", 1))]
    made = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array(*lines).alias("lines"))
    done = columns.status(made, ["l_orderkey", "l_linenumber"], "cont P 0 0 0 0 0\ncont P 0 0 0 0 0", options=Options(fuzzy=True, ignore_varspec_mismatch=False))
    return done.select("l_orderkey", "l_linenumber", (C("status") == "parsed").alias("ok"))


#: Files by o_orderkey % 16 as (MAT, MF, MT) of their lines, and the break that each has: its line and code.
TAPES = [
    ([(9, 3, 1), (9, 3, 0), (9, 0, 0), (0, 0, 0), (-1, 0, 0)], None),
    ([(9, 3, 1), (9, 0, 0), (9, 0, 0), (0, 0, 0), (-1, 0, 0)], (2, "missing_send")),
    ([(9, 3, 1), (9, 3, 0), (9, 0, 0), (0, 0, 0)], (4, "missing_tend")),
    ([(9, 3, 1), (9, 3, 2), (9, 3, 0), (9, 0, 0), (0, 0, 0), (-1, 0, 0)], (2, "mt_change")),
    ([(9, 3, 1), (9, 3, 0), (9, 4, 2), (9, 4, 0), (9, 0, 0), (0, 0, 0), (-1, 0, 0)], (3, "mf_change")),
    ([(9, 3, 1), (9, 3, 0), (9, 0, 0), (8, 3, 1), (8, 3, 0), (8, 0, 0), (0, 0, 0), (-1, 0, 0)], (4, "mat_change")),
    ([(9, 3, 1), (9, 3, 0), (0, 0, 0), (0, 0, 0), (-1, 0, 0)], (3, "missing_fend")),
    ([(9, 3, 1), (9, 3, 0), (9, 0, 0), (-1, 0, 0), (-1, 0, 0)], (4, "missing_mend")),
    ([(9, 3, 1), (9, 3, 0), (9, 0, 0), (0, 0, 0), (-1, 0, 0), (9, 3, 1), (9, 3, 0), (9, 0, 0), (0, 0, 0)], None),
    ([(9, 3, 1), (9, 3, 0)], (2, "open_section")),
    ([(9, 3, 1), (9, 3, 0), (9, 3, 2), (9, 3, 0), (9, 0, 0), (8, 0, 0), (-1, 0, 0)], (6, "missing_mend")),
]


def _tape_sql() -> str:
    each = [f"WHEN {i} THEN '{code[1]}'" for i, (_, code) in enumerate(TAPES) if code]
    at = [f"WHEN {i} THEN {code[0]}" for i, (_, code) in enumerate(TAPES) if code]
    kind = f"o_orderkey % {len(TAPES) + 4}"
    n = len(TAPES)
    return f"""SELECT * FROM (SELECT o_orderkey AS file_id, CASE {kind} {" ".join(at)} WHEN 8 THEN 6 WHEN {n} THEN 0 WHEN {n + 1} THEN 3 WHEN {n + 2} THEN 2 WHEN {n + 3} THEN 1 END::INTEGER AS ofs,
      CASE {kind} {" ".join(each)} WHEN 8 THEN 'after_tend' WHEN {n} THEN 'no_tape_head' WHEN {n + 1} THEN 'end_fields' WHEN {n + 2} THEN 'blank_line' WHEN {n + 3} THEN 'bad_control' END AS code FROM orders)
      WHERE code IS NOT NULL"""


def _line(mat: int, mf: int, mt: int, body: str = "") -> str:
    return f"{body:66s}{mat:4d}{mf:2d}{mt:3d}"


@_query(_tape_sql())
def q27_end_record_rules(spark, sf):
    """The first break of each file; besides TAPES a missing head, fields in an end record, a blank line and letters for a MAT."""
    head, good = _line(1, 0, 0, "a tape"), [_line(*k) for k in TAPES[0][0]]
    made = [[head, *(_line(*k) for k in keys)] for keys, _ in TAPES]
    made += [good, [head, good[0], good[1], _line(9, 0, 0, " 1.000000+0"), *good[3:]], [head, good[0], " ", *good[1:]], [head, good[0][:66] + " x9 3  1", *good]]
    kind = (C("o_orderkey") % len(made) + 1).cast("int")
    text = F.element_at(F.array(*(F.array(*(L(x) for x in m)) for m in made)), kind)
    lines = _t(spark, sf, "orders").select(C("o_orderkey").alias("file_id"), F.posexplode(text).alias("ofs", "raw"))
    return tp.end_record_issues(lines).groupBy("file_id").agg(F.min(F.struct("ofs", "code")).alias("first")).select("file_id", "first.*")


@_query("SELECT o_orderkey AS file_id, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1")
def q28_blank_lines(spark, sf):
    text = F.when(C("o_orderkey") % 3 == 0, F.concat(C("line"), L("\n"), L("   \n"), C("line"))).otherwise(F.concat(C("line"), L("\r\n"), C("line")))
    files = _order_lines(spark, sf).select("o_orderkey", text.alias("t"))
    return tp.blank_lines(tp.split_text(files, "o_orderkey", "t")).groupBy("file_id").agg(F.count("*").alias("n"))


@_query("SELECT l_orderkey AS file_id, CASE WHEN l_orderkey % 3 = 0 THEN 'list_too_long' END AS code FROM lineitem GROUP BY l_orderkey")
def q29_list_length_guard(spark, sf):
    layout = "list 0 0 0 0 N1 N\n    let M = N\n    for i = 1..M\n        vals q[i] p[i]"
    lists = _list_sections(spark, sf)
    head = F.get("lines", L(0))
    fewer = F.concat(F.substring(head, 1, 55), fd.int_field(fd.fort_int(F.substring(head, 56, 11)) - 1))
    lines = F.when(C("file_id") % 3 == 0, F.concat(F.array(fewer), F.slice("lines", L(2), F.size("lines")))).otherwise(C("lines"))
    return columns.status(lists.select("file_id", lines.alias("lines")), ["file_id"], layout).select("file_id", "code")


# -- paths


def _props(spark, sf) -> DataFrame:
    """Cells of events: props/k and meta/user/<n>."""
    ev = _t(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    made = F.array(F.struct(F.array(L("props"), L("k")).alias("path"), k.alias("f"), L(None).cast("string").alias("s")), F.struct(F.array(L("meta"), L("type")).alias("path"), L(None).cast("double").alias("f"), C("event_type").alias("s")))
    return ev.select(C("event_id").alias("file_id"), F.explode(made).alias("c")).select("file_id", "c.*").where("f IS NOT NULL OR s IS NOT NULL")


@_query("SELECT event_id AS file_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS v FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def q30_path_get(spark, sf):
    return ce.get(_props(spark, sf), "/props/k").select("file_id", C("f").alias("v"))


@_query("SELECT event_id AS file_id FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def q31_path_exists(spark, sf):
    return ce.exists(_props(spark, sf), "props")


@_query("SELECT event_id AS file_id, CASE WHEN event_id % 2 = 0 THEN event_id::DOUBLE ELSE CAST(json_extract(props, '$.k') AS DOUBLE) END AS v FROM events WHERE event_id % 2 = 0 OR json_extract(props, '$.k') IS NOT NULL")
def q32_path_set(spark, sf):
    new = _t(spark, sf, "events").where("event_id % 2 = 0").select(C("event_id").alias("file_id"), F.array(L("props"), L("k")).alias("path"), C("event_id").cast("double").alias("f"), L(None).cast("string").alias("s"))
    return ce.get(ce.put(_props(spark, sf), new), "props[k]").select("file_id", C("f").alias("v"))


@_query("SELECT event_id AS file_id, event_type AS s FROM events WHERE event_type IS NOT NULL")
def q33_path_remove(spark, sf):
    return ce.remove(_props(spark, sf), "/props").select("file_id", "s")


@_query("SELECT conv_id AS file_id, 'turn/' || turn || '/text' AS path FROM conversations WHERE text IS NOT NULL")
def q34_locate(spark, sf):
    conv = _t(spark, sf, "conversations")
    made = F.array(*(F.struct(F.array(L("turn"), C("turn").cast("string"), L(n)).alias("path"), C(n).alias("s")) for n in ("role", "text")))
    table = conv.select(C("conv_id").alias("file_id"), F.explode(made).alias("c")).select("file_id", "c.path", "c.s").where("s IS NOT NULL")
    return ce.locate(table, "text").select("file_id", F.array_join("path", "/").alias("path"))


def _items(spark, sf, wanted=None) -> DataFrame:
    """Cells of the LIST sections by their layout: item/<i>/q and item/<i>/p; those that are wanted, if that is told."""
    return columns.cells(_list_sections(spark, sf), ["file_id"], ITEMS, wanted=wanted)


@_query("SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::VARCHAR AS step, 2::BIGINT AS n_cells, false AS is_value FROM lineitem")
def q35_show_children(spark, sf):
    return ce.children(_items(spark, sf), "/item")


def _matched(cells: DataFrame, query: str) -> DataFrame:
    return ce.matched(cells, query)


def _items_matched(spark, sf, query: str) -> DataFrame:
    """Orders whose items match; only cells that the query looks at are made."""
    return _matched(_items(spark, sf, ce.paths_of(query)), query)


@_query("SELECT l_orderkey AS file_id FROM lineitem GROUP BY 1 HAVING count(*) >= 5")
def q36_match_relation(spark, sf):
    return _items_matched(spark, sf, "/N >= 5")


@_query("SELECT DISTINCT l_orderkey AS file_id FROM lineitem WHERE l_extendedprice > 60000")
def q37_match_wildcard(spark, sf):
    return _items_matched(spark, sf, "/item/*/p > 60000")


@_query("""SELECT l_orderkey AS file_id FROM lineitem GROUP BY 1
  HAVING (bool_or(l_quantity < 5) AND count(*) > 2) OR bool_or(NOT l_extendedprice > 5000)""")
def q38_match_and_or_not(spark, sf):
    return _items_matched(spark, sf, "(/item/*/q < 5 & /N > 2) | ! /item/*/p > 5000")


@_query("SELECT DISTINCT l_orderkey AS file_id FROM lineitem WHERE l_quantity < 10 AND l_extendedprice > 15000")
def q39_match_prefix(spark, sf):
    return _items_matched(spark, sf, "/item/*(/q < 10 & /p > 15000)")


@_query("SELECT l_orderkey AS file_id FROM lineitem GROUP BY 1 HAVING max(l_quantity) > 7 * min(l_quantity) / 7 AND count(DISTINCT l_quantity) > 1")
def q40_match_path_vs_path(spark, sf):
    return _items_matched(spark, sf, "/item/*/q > /item/*/q")


# -- differences and edits


def _price_cells(spark, sf, price) -> DataFrame:
    return _t(spark, sf, "lineitem").select(C("l_orderkey").alias("file_id"), F.array(L("item"), *(C(f"l_{k}").cast("string") for k in ("linenumber", "partkey", "suppkey"))).alias("path"), fd.fort_float(fd.float_field(price, prefer_noexp=True)).alias("f"), L(None).cast("string").alias("s"))


@_query("SELECT l_orderkey AS file_id, concat_ws('/', 'item', l_linenumber, l_partkey, l_suppkey) AS path, 'value' AS code FROM lineitem WHERE l_orderkey % 11 = 0")
def q41_diff_values(spark, sf):
    right = _price_cells(spark, sf, F.when(C("l_orderkey") % 11 == 0, C("l_extendedprice") + 1).otherwise(C("l_extendedprice")))
    return ce.compare(_price_cells(spark, sf, C("l_extendedprice")), right).select("file_id", F.array_join("path", "/").alias("path"), "code")


@_query("SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 3 = 0 THEN 'only_right' ELSE 'only_left' END AS code FROM orders WHERE (o_orderkey % 3 = 0) <> (o_orderkey % 4 = 0)")
def q42_diff_keys(spark, sf):
    base = _t(spark, sf, "orders").select(C("o_orderkey").alias("file_id"), F.array(L("p")).alias("path"), C("o_totalprice").alias("f"), C("o_orderstatus").alias("s"))
    return ce.compare(base.where("file_id % 4 = 0"), base.where("file_id % 3 = 0")).select("file_id", "code")


@_query("SELECT doc_id AS file_id, 'length' AS code FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL")
def q43_diff_strings(spark, sf):
    docs = _t(spark, sf, "documents").select(C("doc_id").alias("file_id"), F.array(L("text")).alias("path"), L(None).cast("double").alias("f"), C("text").alias("s"))
    padded = docs.withColumn("s", F.when(C("file_id") % 5 == 0, F.concat("s", L("  "))).otherwise(C("s")))
    return ce.compare(docs, padded).select("file_id", "code")


@_query("""SELECT l_orderkey AS file_id, round(sum(CASE WHEN l_linenumber = 1 THEN l_extendedprice + 1 ELSE l_extendedprice END), 2) AS total FROM lineitem GROUP BY 1""")
def q44_replace_subtree(spark, sf):
    done = ce.replace_subtree(_price_cells(spark, sf, C("l_extendedprice")), _price_cells(spark, sf, C("l_extendedprice") + 1), "/item/1")
    return done.groupBy("file_id").agg(F.round(F.sum("f"), 2).alias("total"))


@_query("""WITH c AS (SELECT CAST(floor(l_orderkey / 9999) AS BIGINT) AS file_id, l_linenumber::BIGINT AS mf, CAST(l_quantity AS BIGINT) AS mt, count(*) AS n FROM lineitem GROUP BY ALL
  UNION ALL SELECT DISTINCT CAST(floor(l_orderkey / 9999) AS BIGINT), 1, 451, 0 FROM lineitem), k AS (SELECT *, count(*) OVER (PARTITION BY file_id) AS k FROM c)
  SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY mf, mt) AS i, mf, mt, CASE WHEN mf = 1 AND mt = 451 THEN 4 + 6 + k ELSE n END::BIGINT AS nc, CASE WHEN mt % 2 = 0 THEN mt ELSE 0 END::BIGINT AS mod FROM k""")
def q45_update_directory(spark, sf):
    counted = tp.with_control(_item_tape(spark, sf)).groupBy("file_id", "mf", "mt").agg(F.count("*").alias("n"))
    files = counted.select("file_id").distinct()
    every = counted.union(files.select("file_id", L(1).cast("bigint"), L(451).cast("bigint"), L(0).cast("bigint")))
    old = counted.where("mt % 2 = 0").select("file_id", "mf", "mt", C("mt").alias("mod"))
    return ce.updated_directory(every, old, files.withColumn("nwd", L(6))).withColumn("mod", C("mod").cast("bigint"))


@_query("SELECT doc_id AS file_id, len(string_split(coalesce(text, ''), chr(10))) + 1 + 5 AS nwd, 'inserted' AS second FROM documents")
def q46_description_edit(spark, sf):
    lines = F.split(F.coalesce("text", L("")), "\n", -1)
    numbered = F.map_from_arrays(F.transform(lines, lambda x, i: (i + 1).cast("string")), lines)
    first = _t(spark, sf, "documents").select("doc_id", F.to_json(F.struct(numbered.alias("DESCRIPTION"))).alias("d"))
    done = first.select("doc_id", de.edited(C("d"), de.with_inserted, L("inserted"), L(1)).alias("d"))
    return done.select(C("doc_id").alias("file_id"), F.get_json_object("d", "$.NWD").cast("bigint").alias("nwd"), F.rtrim(F.get_json_object("d", "$.DESCRIPTION.2")).alias("second"))


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 33 ELSE 0 END AS nlib, CASE o_orderkey % 4 WHEN 3 THEN 3 WHEN 2 THEN 8 ELSE 7 END AS nver, CASE o_orderkey % 4 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS lrel,
  rpad('----' || CASE o_orderkey % 4 WHEN 0 THEN 'ENDF/B-VII.0' WHEN 1 THEN 'ENDF/B-VII.1' WHEN 2 THEN 'ENDF/B-VIII.0' ELSE 'FENDL-3.2' END, 22, ' ') || o_orderkey AS line FROM orders""")
def q47_set_library(spark, sf):
    """Numbers of the library and its name in the third line of the description, whose rest stays."""
    name = F.element_at(F.array(*(L(x) for x in de.LIBRARIES)), (C("o_orderkey") % 4 + 1).cast("int"))
    third = F.concat(F.rpad(L("----OLD"), 22, " "), C("o_orderkey").cast("string"))
    first = F.to_json(F.struct(F.create_map(L("3"), third).alias("DESCRIPTION")))
    done = _t(spark, sf, "orders").select("o_orderkey", de.edited(first, de.with_library, name).alias("d"))
    number = lambda k: F.get_json_object("d", f"$.{k}").cast("int").alias(k.lower())
    return done.select("o_orderkey", *(number(k) for k in ("NLIB", "NVER", "LREL")), F.get_json_object("d", "$.DESCRIPTION.3").alias("line"))


@_query("""SELECT o_orderkey AS file_id, o_orderstatus || '/price' AS path, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS f FROM orders WHERE o_orderstatus <> 'F'""")
def q48_delete_merge(spark, sf):
    """Even files merged with odd ones, and what both hold taken from the second; then a section is deleted."""
    def cells(price):
        return _t(spark, sf, "orders").select(C("o_orderkey").alias("file_id"), F.array(C("o_orderstatus"), L("price")).alias("path"), price.alias("f"))

    merged = ce.merge(cells(C("o_totalprice")), cells(C("o_totalprice") + 1).where("file_id % 2 = 1"))
    return ce.remove(merged, "/F").select("file_id", F.array_join("path", "/").alias("path"), "f")


@_query("SELECT l_orderkey AS file_id, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def q49_json_roundtrip(spark, sf):
    documents = lane.to_json(_list_sections(spark, sf), ["file_id"], ITEMS)
    again = columns.cells(lane.from_json(documents, ["file_id"], "document", ITEMS), ["file_id"], ITEMS, wanted=[["item", "*", "p"]])
    return ce.get(again, "/item/*/p").groupBy("file_id").agg(F.count("*").alias("n"), F.round(F.sum("f"), 2).alias("total"))


@_query("""WITH d AS (SELECT CAST(floor(l_orderkey / 9999) AS BIGINT) AS file_id, l_orderkey % 9999 + 1 AS mat, l_linenumber::BIGINT AS mf, CAST(l_quantity AS BIGINT) AS mt, l_orderkey * 10 + l_linenumber AS ofs FROM lineitem),
  c AS (SELECT *, lpad(mat::VARCHAR, 4, ' ') AS m, lpad(mf::VARCHAR, 2, ' ') AS f, lpad('0', 2, ' ') || lpad('0', 3, ' ') || lpad('0', 5, ' ') AS z FROM d)
  SELECT file_id, mat, mf, mt, ofs, m || f || lpad(mt::VARCHAR, 3, ' ') AS control FROM c
  UNION ALL SELECT DISTINCT file_id, mat, mf, mt, 1099511627776, m || f || lpad('0', 3, ' ') || '99999' FROM c
  UNION ALL SELECT DISTINCT file_id, mat, mf, 1048576, 0, m || z FROM c
  UNION ALL SELECT DISTINCT file_id, mat, 1048576, 0, 0, lpad('0', 4, ' ') || z FROM c
  UNION ALL SELECT DISTINCT file_id, 1048576, 0, 0, 0, lpad('-1', 4, ' ') || z FROM c""")
def q50_write_sort(spark, sf):
    """Every line as it is written, data and end records, with its sort place."""
    done = tp.ordered_lines(stored(tp.with_control(_item_tape(spark, sf)), "items"))
    return done.select("file_id", *(C(c).cast("bigint").alias(c) for c in ("mat", "mf", "mt", "ofs")), F.substring("raw", 67, 14).alias("control"))


# -- layouts


@_query("SELECT l_orderkey AS file_id, count(*) FILTER (WHERE l_quantity > 25) AS n FROM lineitem GROUP BY 1")
def q51_layout_for_loop(spark, sf):
    part = F.collect_list(F.when(C("l_quantity") > 25, C("l_extendedprice")))
    orders = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(part.alias("v")).select(C("l_orderkey").alias("file_id"), fd.float_fields(C("v"), prefer_noexp=True).alias("fields"))
    head = F.rpad(rc.cont_body(_blank(), _blank(), L(0), L(0), F.size("fields"), L(0)), 66, " ")
    lists = orders.select("file_id", F.concat(F.array(head), rc.value_lines(C("fields"))).alias("lines"))
    got = columns.cells(lists, ["file_id"], "list 0 0 0 0 N 0\n    for i = 1..N\n        vals v[i]")
    return got.groupBy("file_id").agg(F.count(F.when(ce.matches(C("path"), ["v", "*"]), 1)).alias("n"))


@_query("""WITH b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT p_brand AS file_id, (n * (n + 1)) // 2 AS cells FROM b""")
def q52_layout_triangle(spark, sf):
    """Sections that grow with the square of their brands, dealt out by pieces of 2048 lines, and made and read by 64 lines."""
    size, cut = 2048, 64
    brands = _t(spark, sf, "part").groupBy(C("p_brand").alias("file_id")).agg(F.count("*").alias("n")).withColumn("nt", F.expr("n * (n + 1) div 2")).withColumn("last", F.ceil(C("nt") / (6 * size)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (brands.agg(F.sum("last")).first()[0] or 0) // 1024)
    pieces = brands.withColumn("piece", F.explode(F.sequence(L(0).cast("bigint"), C("last")))).repartition(tasks, "file_id", "piece")

    def rendered(some):
        before = 6 * C("line")
        values = F.when((C("piece") > 0) & (before < C("nt")), F.sequence(before + 1, F.least(before + 6 * cut, C("nt")))).otherwise(F.array().cast("array<bigint>"))
        head = F.rpad(rc.cont_body(_blank(), _blank(), L(0), L(0), C("nt"), C("n")), 66, " ")
        some = some.withColumn("fields", fd.float_fields(values, prefer_noexp=True))
        return some.withColumn("lines", F.when(C("piece") == 0, F.array(head)).otherwise(rc.value_lines(C("fields"))))

    got = columns.long_read(pieces, ["file_id"], "list 0 0 0 0 NT N\n    for i = 1..N\n        for j = i..N\n            vals F[i,j]", size, rendered, cut)
    each = got.groupBy("file_id").agg(F.count_if(ce.matches(C("path"), ["F", "*", "*"])).alias("cells"), F.count_if(C("path").isNull()).alias("wrong"))
    return each.where("wrong = 0 AND cells > 0").select("file_id", "cells")


@_query("SELECT o_orderkey AS file_id, CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'B' END AS branch, o_custkey::DOUBLE AS f FROM orders")
def q53_layout_if_lookahead(spark, sf):
    flag = F.when(C("o_orderstatus") == "F", 1).otherwise(2)
    line = F.rpad(rc.cont_body(_blank(), _blank(), flag, C("o_custkey"), L(0), L(0)), 66, " ")
    made = _t(spark, sf, "orders").select(C("o_orderkey").alias("file_id"), F.array(line).alias("lines"))
    got = columns.cells(made, ["file_id"], "if LF == 1 ~1\n    cont 0 0 LF A 0 0\nelse\n    cont 0 0 LF B 0 0")
    return got.where(F.get("path", L(0)) != "LF").select("file_id", F.get("path", L(0)).alias("branch"), "f")


@_query("SELECT c_nationkey::BIGINT AS file_id, count(*) AS n FROM customer GROUP BY 1")
def q54_layout_repeat_until(spark, sf):
    nations = _t(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    lines = F.transform(fd.counted(L(1), C("n")), lambda i: F.rpad(rc.cont_body(_blank(), _blank(), C("n"), i, L(0), L(0)), 66, " "))
    got = columns.cells(nations.select(C("c_nationkey").cast("bigint").alias("file_id"), lines.alias("lines")), ["file_id"], "repeat i = 1 until IG[i] == NG\n    cont 0 0 NG IG[i] 0 0")
    return ce.get(got, "/IG/*").groupBy("file_id").agg(F.count("*").alias("n"))


@_query("SELECT o_orderkey AS file_id, o_custkey::DOUBLE AS n FROM orders")
def q55_layout_linear_solve(spark, sf):
    line = F.rpad(rc.cont_body(_blank(), _blank(), C("o_custkey") * 2 + 1, C("o_custkey"), L(0), L(0)), 66, " ")
    got = columns.cells(_t(spark, sf, "orders").select(C("o_orderkey").alias("file_id"), F.array(line).alias("lines")), ["file_id"], "cont 0 0 2*N+1 N 0 0")
    return ce.get(got, "/N").select("file_id", C("f").alias("n"))


@_query("SELECT l_orderkey AS file_id, count(*)::DOUBLE AS n, ((5 - count(*)) % 6 + 6) % 6 AS spare FROM lineitem GROUP BY 1")
def q56_layout_abbreviation(spark, sf):
    orders = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.collect_list("l_quantity").alias("v"))
    spare = fd.floor_mod(L(5) - C("n"), L(6))
    values = F.concat(C("v"), F.array_repeat(L(0.0), spare.cast("int")))
    orders = orders.select(C("l_orderkey").alias("file_id"), "n", fd.float_fields(values, prefer_noexp=True).alias("fields"))
    head = F.rpad(rc.cont_body(_blank(), _blank(), L(0), L(0), F.size("fields"), C("n")), 66, " ")
    got = columns.cells(orders.select("file_id", F.concat(F.array(head), rc.value_lines(C("fields"))).alias("lines")), ["file_id"], "let SP = (5-N)%6\nlist 0 0 0 0 NT N\n    for i = 1..N\n        vals q[i]\n    for i = 1..SP\n        vals z[i]")
    return got.groupBy("file_id").agg(F.max(F.when(ce.matches(C("path"), ["N"]), C("f"))).alias("n"), F.count(F.when(ce.matches(C("path"), ["z", "*"]), 1)).alias("spare"))


@_query("SELECT l_orderkey AS file_id, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def q57_padline(spark, sf):
    part = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice")))
    orders = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(part.alias("p"), F.count("*").alias("n"))

    def padded(name):
        v = F.transform("p", lambda x: x[name])
        return F.concat(v, F.array_repeat(L(0.0), ((6 - C("n") % 6) % 6).cast("int")))

    orders = orders.select(C("l_orderkey").alias("file_id"), "n", fd.float_fields(F.concat(padded("l_quantity"), padded("l_extendedprice")), prefer_noexp=True).alias("fields"))
    head = F.rpad(rc.cont_body(_blank(), _blank(), L(0), L(0), F.size("fields"), C("n")), 66, " ")
    got = columns.cells(orders.select("file_id", F.concat(F.array(head), rc.value_lines(C("fields"))).alias("lines")), ["file_id"], "list 0 0 0 0 NT N\n    for i = 1..N\n        vals q[i]\n    pad\n    for i = 1..N\n        vals p[i]\n    pad")
    return ce.get(got, "/p/*").groupBy("file_id").agg(F.count("*").alias("n"), F.round(F.sum("f"), 2).alias("total"))


@_query("SELECT o_orderkey AS file_id, o_custkey::DOUBLE AS f FROM orders")
def q58_nested_index(spark, sf):
    first = F.rpad(rc.cont_body(_blank(), _blank(), L(10), L(3), L(0), L(0)), 66, " ")
    second = F.rpad(rc.cont_body(_blank(), _blank(), C("o_custkey"), L(0), L(0), L(0)), 66, " ")
    got = columns.cells(_t(spark, sf, "orders").select(C("o_orderkey").alias("file_id"), F.array(first, second).alias("lines")), ["file_id"], "cont 0 0 A[1] A[2] 0 0\ncont 0 0 B[A[1]-A[2]] 0 0 0")
    return ce.get(got, "/B/7").select("file_id", "f")


@_query("SELECT l_orderkey AS file_id, max(l_extendedprice) AS top FROM lineitem GROUP BY 1")
def q59_layout_sections(spark, sf):
    return ce.get(_items(spark, sf, [["item", "*", "p"]]), "/item/*/p").groupBy("file_id").agg(F.max("f").alias("top"))


@_query("SELECT l_orderkey AS file_id, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def q60_array_list_mode(spark, sf):
    """Documents with arrays as lists from 0, back to sections by their first indices."""
    documents = lane.to_json(_list_sections(spark, sf), ["file_id"], ITEMS, lists=True)
    again = columns.cells(lane.from_json(documents, ["file_id"], "document", ITEMS, lists=True), ["file_id"], ITEMS, wanted=[["item", "*", "q"]])
    return ce.get(again, "/item/*/q").groupBy("file_id").agg(F.count("*").alias("n"), F.round(F.sum("f"), 2).alias("total"))


@_query("SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 5 = 0 THEN 'parsed' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 5 = 3 THEN 0 ELSE 1 END AS kept_lines FROM orders")
def q61_nofail_status(spark, sf):
    """A section that fails keeps its lines, and the others are parsed all the same."""
    sections = _dirty(spark, sf).withColumns({"mat": L(1), "mf": L(3), "mt": L(1)})
    done = lane.parsed(sections, ["file_id"], options=Options(ignore_zero_mismatch=False), layouts={(3, 1): DIRTY})
    return done.select("file_id", "status", F.coalesce(F.size("lines"), L(0)).alias("kept_lines"))


@_query("SELECT o_orderkey AS file_id, CASE o_orderkey % 3 WHEN 1 THEN 'unused_elements' WHEN 2 THEN 'missing_variable' END AS code, CASE WHEN o_orderkey % 3 = 0 THEN 2 END::INTEGER AS n_lines FROM orders")
def q62_array_completeness(spark, sf):
    """Documents of orders with all, one too many or one too few elements of an array."""
    kind = C("o_orderkey") % 3
    n = F.when(kind == 1, 4).when(kind == 2, 2).otherwise(3)
    values = F.map_from_arrays(F.transform(F.sequence(L(1), n), lambda i: i.cast("string")), F.transform(F.sequence(L(1), n), lambda i: C("o_totalprice") + i))
    documents = _t(spark, sf, "orders").select(C("o_orderkey").alias("file_id"), F.to_json(F.struct(L(3).alias("N"), values.alias("v"))).alias("document"))
    return lane.written(documents, ["file_id"], "document", "list 0 0 0 0 N 0\n    for i = 1..N\n        vals v[i]", Options(prefer_noexp=True, check_arrays=True))


def _tables(spark, sf) -> DataFrame:
    """Sections of MF 3 as ``file_id, mat, mf, mt, lines``, one for each order: prices by line number."""
    part = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice")))
    orders = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(part.alias("p"))
    points = F.flatten(F.transform("p", lambda x: F.array(x["l_linenumber"].cast("double"), x["l_extendedprice"])))
    orders = orders.select("l_orderkey", F.size("p").alias("n"), fd.float_fields(points, prefer_noexp=True).alias("fields"))
    key = {"mat": C("l_orderkey") % 9999 + 1, "mf": L(3), "mt": C("l_orderkey") % 90 + 1}
    ctrl = rc.control(*key.values())
    head = rc.cont_body(fd.float_field(C("l_orderkey"), prefer_noexp=True), _blank(), L(0), L(0), L(0), L(0))
    top = rc.cont_body(_blank(), _blank(), L(0), L(0), L(1), C("n"))
    lines = F.concat(F.array(head, top), rc.value_lines(F.array(fd.int_field(C("n")), fd.int_field(L(2)))), rc.value_lines(C("fields")))
    return orders.select(C("l_orderkey").alias("file_id"), *(v.cast("int").alias(k) for k, v in key.items()), F.transform(lines, lambda x: F.concat(F.rpad(x, 66, " "), ctrl)).alias("lines"))


@_query("""SELECT l_orderkey AS file_id, path, about, f FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) - 1 AS i FROM lineitem)
  , LATERAL (VALUES ('xstable/E/' || i, 'energies of the incident particle in eV', l_linenumber::DOUBLE), ('xstable/xs/' || i, 'cross sections in barn', p)) t(path, about, f)
  UNION ALL SELECT DISTINCT l_orderkey, 'ZA', 'charge and mass number of the material as 1000 Z + A', l_orderkey::DOUBLE FROM lineitem""")
def q63_explain_path(spark, sf):
    """What the layout says of the cells of a section."""
    cells = lane.described(columns.cells(_tables(spark, sf), ["file_id"], dialect="endf6", mf=3, mt=1), layouts.find("endf6", 3, 1))
    wanted = ce.matches(C("path"), ["ZA"]) | ce.matches(C("path"), ["xstable", "E", "*"]) | ce.matches(C("path"), ["xstable", "xs", "*"])
    return cells.where(wanted).select("file_id", F.array_join("path", "/").alias("path"), "about", "f")


@_query("SELECT c_nationkey::BIGINT + 1 AS mat, count(*) AS n_lines FROM customer GROUP BY 1")
def q64_multi_material(spark, sf):
    body = F.rpad(fd.float_field(C("c_acctbal"), prefer_noexp=True), 66, " ")
    lines = _t(spark, sf, "customer").select(L("one").alias("file_id"), (C("c_nationkey") + 1).cast("bigint").alias("mat"), L(3).cast("bigint").alias("mf"), L(1).cast("bigint").alias("mt"), C("c_custkey").alias("ofs"), F.concat(body, rc.control(C("c_nationkey") + 1, L(3), L(1))).alias("raw"))
    (path,) = write_files(tp.ordered_lines(stored(lines, "customers")), fresh_path(spark, "files"))
    return tp.section_sizes(tp.with_control(tp.read_lines(spark, path))).select("mat", "n_lines")


# -- sections by the catalogue's layouts


@_query("""SELECT l_orderkey AS file_id, l_orderkey % 9999 + 1 AS mat, 3::BIGINT AS mf, l_orderkey % 90 + 1 AS mt, count(*) AS np, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_orderkey""")
def q65_catalogue_cross_sections(spark, sf):
    """MF 3 by its layout, with the control fields as part of the document."""
    cells = columns.cells(_tables(spark, sf), ["file_id"], dialect="endf6", mf=3, mt=1)
    key = lambda name: F.max(F.when(ce.matches(C("path"), [name]), C("i"))).alias(name.lower())
    y = F.when(ce.matches(C("path"), ["xstable", "xs", "*"]), C("f"))
    return cells.groupBy("file_id").agg(*(key(k) for k in ("MAT", "MF", "MT")), F.count(y).alias("np"), F.round(F.sum(y), 2).alias("total"))


@_query("""SELECT c_nationkey::BIGINT AS file_id, count(*) + 5 AS nwd, count(DISTINCT c_mktsegment) AS nxc, count(*) AS described, max(c_name) AS last FROM customer GROUP BY 1""")
def q66_catalogue_description(spark, sf):
    """MF 1, MT 451: customers are the lines of a nation's description, segments its directory."""
    names = F.array_sort(F.collect_list("c_name"))
    nations = _t(spark, sf, "customer").groupBy("c_nationkey").agg(names.alias("p"), F.count_distinct("c_mktsegment").alias("k"))
    blank = rc.cont_body(_blank(), _blank(), L(0), L(0), L(0), L(0))
    counts = rc.cont_body(_blank(), _blank(), L(0), L(0), F.size("p") + 5, C("k"))
    text = F.transform("p", lambda x: F.rpad(x, 66, " "))
    entries = F.transform(fd.counted(L(1), C("k")), lambda i: rc.dir_body(L(3), i, L(1), L(0)))
    lines = F.concat(F.array(blank, blank, blank, counts), F.array_repeat(F.rpad(L("head"), 66, " "), 5), text, entries)
    sections = nations.select(C("c_nationkey").cast("bigint").alias("file_id"), L(1).alias("mf"), L(451).alias("mt"), F.transform(lines, lambda x: F.rpad(x, 66, " ")).alias("lines"))
    cells = columns.cells(sections, ["file_id"], dialect="endf6", mf=1, mt=451)
    one = lambda name: F.max(F.when(ce.matches(C("path"), [name]), C("i"))).alias(name.lower())
    said = F.when(ce.matches(C("path"), ["DESCRIPTION", "*"]), F.rtrim("s"))
    return cells.groupBy("file_id").agg(one("NWD"), one("NXC"), F.count(said).alias("described"), F.max(said).alias("last"))


@_query("""SELECT vec_id AS file_id, round(list_sum(list_transform(embedding[1:6], lambda x: round(CAST(x AS DOUBLE), 4))), 3) AS total, round(CAST(embedding[6] AS DOUBLE), 4) AS corner FROM embeddings""")
def q67_catalogue_covariances(spark, sf):
    """MF 33: a symmetric matrix (LB 5) over four energies from the first six components."""
    values = F.concat(F.array(*(L(float(e)) for e in (1, 2, 3, 4))), F.transform(F.slice("embedding", 1, 6), lambda x: F.round(x.cast("double"), 4)))
    made = _t(spark, sf, "embeddings").select("vec_id", fd.float_fields(values, prefer_noexp=True).alias("fields"))
    none = [_blank(), _blank()]
    heads = F.array(rc.cont_body(*none, L(0), L(0), L(0), L(1)), rc.cont_body(*none, L(0), L(2), L(0), L(1)), rc.cont_body(*none, L(1), L(5), L(10), L(4)))
    sections = made.select(C("vec_id").alias("file_id"), L(33).alias("mf"), L(2).alias("mt"), F.transform(F.concat(heads, rc.value_lines(C("fields"))), lambda x: F.rpad(x, 66, " ")).alias("lines"))
    found = ce.get(columns.cells(sections, ["file_id"], dialect="endf6", mf=33, mt=2), "/subsection/1/ni_part/1/F/*/*")
    corner = F.max(F.when(F.slice("path", L(6), L(2)) == F.array(L("3"), L("3")), C("f")))
    return found.groupBy("file_id").agg(F.round(F.sum("f"), 3).alias("total"), corner.alias("corner"))


# -- kinds of values, subtrees and bindings


@_query("""SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 3 = 1 THEN 'value' ELSE 'type' END AS code FROM orders WHERE o_orderkey % 3 <> 0""")
def q68_diff_kinds(spark, sf):
    """Large whole numbers that differ by one, and a whole number against another of the same value."""
    orders, far = _t(spark, sf, "orders").select(C("o_orderkey").alias("file_id"), F.array(L("n")).alias("path")), C("file_id") + 10_000_000
    left = orders.withColumns({"i": far, "f": far.cast("double"), "s": L(None).cast("string")})
    kind = C("file_id") % 3
    right = orders.withColumns({"i": F.when(kind != 2, far + (kind == 1).cast("bigint")), "f": (far + (kind == 1).cast("bigint")).cast("double"), "s": L(None).cast("string")})
    return ce.compare(left, right).select("file_id", "code")


@_query("SELECT l_orderkey AS file_id FROM lineitem GROUP BY 1 HAVING count(*) >= 3")
def q69_match_exists_subtree(spark, sf):
    """A path to a subsection exists although it is no value itself."""
    return _items_matched(spark, sf, "exists(/item/3) & !exists(/item/0)")


@_query("""SELECT file_id, 'item/' || i || '/p' AS path, p AS f FROM (SELECT l_orderkey AS file_id, l_extendedprice AS p,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) AS i FROM lineitem) WHERE p > 60000 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY i) = 1""")
def q70_match_first_binding(spark, sf):
    """The first cell of each file that makes a relation true."""
    query = "/item/*/p > 60000"
    return ce.first_binding(_items(spark, sf, ce.paths_of(query)), query).select("file_id", F.array_join("path", "/").alias("path"), "f")


@_query("""SELECT l_orderkey AS file_id, l_orderkey::DOUBLE AS za, count(*) AS np, round(sum(l_extendedprice), 2) AS total, NULL::VARCHAR AS code FROM lineitem GROUP BY l_orderkey""")
def q71_native_cross_sections(spark, sf):
    """MF 3 by its layout as column expressions, without Python for the reading."""
    done = native.decoded(_tables(spark, sf), ["file_id"], layouts.find("endf6", 3, 1))
    total = F.round(F.aggregate("document.xstable.xs", L(0.0), lambda a, x: a + x), 2)
    return done.select("file_id", C("document.ZA").alias("za"), F.size("document.xstable.E").cast("bigint").alias("np"), total.alias("total"), "code")


# -- files of any size


_WHOLE_FILE = """WITH d AS (SELECT l_orderkey % 9999 + 1 AS mat, l_linenumber::BIGINT AS mf, CAST(l_quantity AS BIGINT) AS mt, row_number() OVER (PARTITION BY l_orderkey % 9999, l_linenumber, CAST(l_quantity AS BIGINT) ORDER BY l_orderkey, l_partkey, l_suppkey) AS k,
    lpad('', 22, ' ') || lpad(l_partkey::VARCHAR, 11, ' ') || lpad(l_suppkey::VARCHAR, 11, ' ') || lpad(l_orderkey::VARCHAR, 11, ' ') || lpad('0', 11, ' ') AS body FROM lineitem),
  c AS (SELECT mat, mf, mt, k, body || lpad(mat::VARCHAR, 4, ' ') || lpad(mf::VARCHAR, 2, ' ') || lpad(mt::VARCHAR, 3, ' ') || lpad(((row_number() OVER (PARTITION BY mat, mf, mt ORDER BY k) - 1) % 99999 + 1)::VARCHAR, 5, ' ') AS raw FROM d),
  z AS (SELECT ' 0.000000+0 0.000000+0' || repeat(lpad('0', 11, ' '), 4) AS zeros, lpad('0', 2, ' ') || lpad('0', 3, ' ') || lpad('0', 5, ' ') AS none),
  e AS (SELECT mat, mf, mt, k, raw FROM c
    UNION ALL SELECT DISTINCT mat, mf, mt, 9223372036854775807, zeros || lpad(mat::VARCHAR, 4, ' ') || lpad(mf::VARCHAR, 2, ' ') || lpad('0', 3, ' ') || '99999' FROM c, z
    UNION ALL SELECT DISTINCT mat, mf, 1048576, 0, zeros || lpad(mat::VARCHAR, 4, ' ') || none FROM c, z
    UNION ALL SELECT DISTINCT mat, 1048576, 0, 0, zeros || lpad('0', 4, ' ') || none FROM c, z
    UNION ALL SELECT 1048576, 0, 0, 0, zeros || lpad('-1', 4, ' ') || none FROM z WHERE EXISTS (SELECT 1 FROM c))
  SELECT row_number() OVER (ORDER BY mat, mf, mt, k, raw) - 1 AS ofs, raw FROM e"""


def _whole_file(spark, sf) -> str:
    """The path of one file of all items: MAT of the order, MF of the line, MT of the quantity."""
    body = rc.cont_body(_blank(), _blank(), C("l_partkey"), C("l_suppkey"), C("l_orderkey"), L(0))
    key = {"mat": C("l_orderkey") % 9999 + 1, "mf": C("l_linenumber").cast("bigint"), "mt": C("l_quantity").cast("bigint")}
    place = F.row_number().over(Window.partitionBy(*key).orderBy("l_orderkey", "l_partkey", "l_suppkey"))
    items = _t(spark, sf, "lineitem")
    items = tp.dealt(items.withColumns(key), items.count(), *key)  # both windows sort what a task has
    items = items.select(L("items").alias("file_id"), *key, place.alias("ofs"), F.concat(body, rc.control(*map(C, key))).alias("raw"))
    lines = stored(tp.renumbered(items), "items")
    return write_files(tp.ordered_lines(lines), fresh_path(spark, "files"))[0]


@_query(_WHOLE_FILE)
def q72_file_by_many_tasks(spark, sf):
    """One file, written and read again by many tasks: every line with its number."""
    return tp.read_lines(spark, _whole_file(spark, sf)).select("ofs", "raw")


@_query(_WHOLE_FILE)
def q73_file_of_records(spark, sf):
    """The same, with line numbers from the places of ranges, as all lines have 81 bytes."""
    return tp.read_lines(spark, _whole_file(spark, sf), record=81).select("ofs", "raw")


@_query("""WITH t AS (SELECT DISTINCT CAST(floor(l_orderkey / 9999) AS BIGINT) AS block, l_orderkey FROM lineitem)
  SELECT CASE WHEN count(*) OVER (PARTITION BY block) > 1 THEN block || '#' || (l_orderkey % 9999 + 1) ELSE block::VARCHAR END AS file_id, l_orderkey::DOUBLE AS za FROM t""")
def q74_materials_apart(spark, sf):
    """Files of many materials, each with a section of the same MF and MT: no value takes another's place."""
    sections = _tables(spark, sf).withColumns({"file_id": F.floor(C("file_id") / 9999).cast("string"), "mt": L(1)})
    ctrl = rc.control(C("mat"), C("mf"), C("mt"))
    sections = sections.withColumn("lines", F.transform("lines", lambda x: F.concat(F.substring(x, 1, 66), ctrl)))
    tapes = Tapes(spark, dialect="endf6")
    cells = tapes.cells(lane.parsed(sections, KEYS, tapes.dialect, tapes.options), [["3", "1", "ZA"]])
    return ce.get(cells, "/3/1/ZA").select("file_id", C("f").alias("za"))


@_query("""WITH i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) AS i, l_quantity AS q, l_extendedprice AS p FROM lineitem)
  SELECT l_orderkey AS file_id FROM i GROUP BY 1 HAVING bool_or(NOT coalesce(CASE WHEN i % 3 <> 0 THEN p END > 2000, false))""")
def q75_match_missing_tail(spark, sf):
    """A wildcard before a tail that every third item lacks: a negation is true where the tail is missing."""
    third = ce.matches(C("path"), ["item", "*", "p"]) & (F.get("path", L(1)).cast("int") % 3 == 0)
    return _matched(_items(spark, sf).where(~F.coalesce(third, L(False))), "! /item/*/p > 2000")


@_query("""SELECT l_orderkey AS file_id, max(l_quantity) > 10 AS matched, min(l_quantity) <= 10 AS unmatched FROM lineitem GROUP BY 1""")
def q76_match_bindings(spark, sf):
    """Whether a true and whether a false binding exists: of each item's quantity, as any order has items."""
    return ce.match(_items(spark, sf), "/item/*/q > 10").select("file_id", "matched", "unmatched")


@_query("SELECT DISTINCT l_orderkey AS file_id FROM lineitem")
def q77_match_nodes_that_are_no_values(spark, sf):
    """A wildcard that meets subsections has a false binding for each, so a negated relation to them holds."""
    return _items_matched(spark, sf, "! /item/* > 0 & ! exists(/item/*/none) & ! /N == /item/*/none")


_NUMBERED = "SELECT l_orderkey, l_quantity AS q, l_extendedprice AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem"


def _first_bindings(spark, sf, query: str) -> DataFrame:
    """The paths and numbers of the first binding that makes a query true of each order."""
    found = ce.first_binding(_items(spark, sf, ce.paths_of(query, unmatched=True)), query)
    return found.select("file_id", F.array_join(F.transform("binding", lambda b: F.array_join(b["path"], "/")), " ").alias("paths"), F.aggregate("binding", L(0.0), lambda x, b: x + b["f"]).alias("total"))


@_query(f"SELECT l_orderkey AS file_id, 'item/' || i || '/q item/' || i || '/p' AS paths, q + p AS total FROM ({_NUMBERED}) WHERE q < 10 AND p > 15000 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY i) = 1")
def q78_first_binding_of_prefix(spark, sf):
    """Of a conjunction below a prefix: both paths of the first item that it is true of."""
    return _first_bindings(spark, sf, "/item/*(/q < 10 & /p > 15000)")


@_query(f"SELECT l_orderkey AS file_id, 'item/' || i || '/p N' AS paths, p + n AS total FROM ({_NUMBERED}) WHERE p > 60000 OR (i = 1 AND n > 5) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY i) = 1")
def q79_first_binding_of_either(spark, sf):
    """Of a disjunction: the first price with a number that makes either side true."""
    return _first_bindings(spark, sf, "/item/*/p > 60000 | /N > 5")
