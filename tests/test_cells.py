import itertools
import random

import pytest

from fluxtape.operators import cells as ce


def test_paths():
    assert ce.parse_path("/a[1,02]//b/*") == ["a", "1", "2", "b", "*"]
    with pytest.raises(ValueError):
        ce.parse_path("/a b")


def brute(doc, node, at=()):
    """All truth values of an expression over all bindings."""
    def bind(steps):
        spots = [(at, doc)]
        out = [at]
        for s in steps:
            if s == "*":
                out = [p + (k,) for p in out for k in sorted({q[len(p)] for q in doc if q[: len(p)] == p and len(q) > len(p)})]
            else:
                out = [p + (s,) for p in out]
        return out

    kind, args = node.kind, node.args
    if kind in ("and", "or"):
        return [(a and b) if kind == "and" else (a or b) for a, b in itertools.product(brute(doc, args[0], at), brute(doc, args[1], at))]
    if kind == "not":
        return [not a for a in brute(doc, args[0], at)]
    if kind == "exists":
        return [any(q[: len(p)] == p for q in doc) for p in bind(args[0])]
    if kind == "in":
        return [x for p in bind(args[0]) for x in (brute(doc, args[1], p) if any(q[: len(p)] == p for q in doc) else [False])]
    sides = [[a] if isinstance(a, float) else [doc.get(p) for p in bind(a)] for a in args]
    return [a is not None and b is not None and eval(f"a {kind} b") for a, b in itertools.product(*sides)]


QUERIES = ["/a > 1", "/x/* > 2", "! /x/* > 2", "/x/* == 3 & /a < 5", "/x/* != 3 | /b > 0", "/x/* < /y/*", "/x/* == /y/*", "exists(/b)", "(/a > 1 | /b > 1) & ! /c == 2", "/z/*(/p > 1 & /q < 3)", "! /z/*(/p > 1)", "2 < /a"]


def test_match_equals_all_bindings(spark):
    random.seed(4)
    docs = {}
    for i in range(150):
        doc = {(k,): float(random.randint(0, 4)) for k in "abc" if random.random() < 0.7}
        for k in "xy":
            doc |= {(k, str(j)): float(random.randint(0, 5)) for j in range(random.randint(0, 3))}
        doc |= {("z", str(j), k): float(random.randint(0, 4)) for j in range(random.randint(0, 3)) for k in "pq"}
        docs[i] = doc | {("always",): 1.0}
    table = spark.createDataFrame([(i, list(p), v, None) for i, d in docs.items() for p, v in d.items()], "file_id int, path array<string>, f double, s string").cache()
    for query in QUERIES:
        got = {r.file_id: r.matched for r in ce.match(table, query).collect()}
        tree = ce.parse_match(query)
        assert got == {i: any(brute(d, tree)) for i, d in docs.items()}, query


def test_put_remove_and_compare(spark):
    schema = "file_id int, path array<string>, f double, s string"
    a = spark.createDataFrame([(1, ["a", "1"], 1.0, None), (1, ["a", "2"], 2.0, None), (1, ["b"], None, "x")], schema)
    new = spark.createDataFrame([(1, ["a"], 9.0, None)], schema)
    assert sorted((r.path, r.f) for r in ce.put(a, new).collect() if r.f) == [(["a"], 9.0)]
    assert [r.path for r in ce.remove(a, "/a").collect()] == [["b"]]
    b = spark.createDataFrame([(1, ["a", "1"], 1.0 + 1e-9, None), (1, ["a", "2"], None, "2"), (1, ["c"], None, "x")], schema)
    assert sorted((r.path, r.code) for r in ce.compare(a, b).collect()) == [(["a", "2"], "type"), (["b"], "only_left"), (["c"], "only_right")]
