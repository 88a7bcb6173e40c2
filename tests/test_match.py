"""The match language against trying every way of binding its wildcards."""

import itertools
import operator
import random
import re

from pyspark.sql import functions as F

from fluxtape.layout.engine import cells_of
from fluxtape.operators import cells as ce

SIGNS = {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}


def nodes(document, steps, met=()):
    """Paths that a path with wildcards stands for; each wildcard meets every child of what is before it."""
    if "*" not in steps:
        yield (*met, *steps)
        return
    at = steps.index("*")
    here = find(document, steps[:at])
    if isinstance(here, dict):
        for k, below in here.items():
            for rest in nodes(below, steps[at + 1 :]):
                yield (*met, *steps[:at], k, *rest)


def find(document, steps):
    for s in steps:
        if not isinstance(document, dict) or s not in document:
            return None
        document = document[s]
    return document


def truths(node, document):
    """The truth of each binding."""
    if node.kind in ("and", "or"):
        yield from ((a and b) if node.kind == "and" else (a or b) for a, b in itertools.product(*(list(truths(x, document)) for x in node.args)))
    elif node.kind == "not":
        yield from (not x for x in truths(node.args[0], document))
    elif node.kind == "exists":
        yield from (find(document, p) is not None for p in nodes(document, node.args[0]))
    elif node.kind == "in":
        for p in nodes(document, node.args[0]):
            inner = find(document, p)
            yield from [False] if inner is None else truths(node.args[1], inner)
    else:
        values = [[a] if isinstance(a, float) else [find(document, p) for p in nodes(document, a)] for a in node.args]
        for x, y in itertools.product(*values):
            yield all(isinstance(v, float) for v in (x, y)) and SIGNS[node.kind](x, y)


def made(rng, depth=0):
    if depth == 3 or depth and rng.random() < 0.4:
        return "text" if rng.random() < 0.1 else float(rng.randint(0, 3))
    return {k: made(rng, depth + 1) for k in rng.sample(["a", "b", "1", "2"], rng.randint(1, 3))}


def path(rng):
    return "/" + "/".join(rng.choices(["a", "b", "1", "2"], k=1) + rng.choices(["a", "b", "1", "2", "*"], k=rng.randint(0, 2)))


def expression(rng, depth=0):
    kind = rng.random()
    if depth < 2 and kind < 0.3:
        return f"({expression(rng, depth + 1)} {rng.choice('&|')} {expression(rng, depth + 1)})"
    if depth < 2 and kind < 0.45:
        return f"! {expression(rng, depth + 1)}"
    if depth < 2 and kind < 0.6:
        return f"{path(rng)}({expression(rng, depth + 1)})"
    if kind < 0.7:
        return f"exists({path(rng)})"
    return f"{path(rng)} {rng.choice(list(SIGNS))} {path(rng) if rng.random() < 0.3 else rng.randint(0, 3)}"


def test_every_binding(spark):
    rng = random.Random(11)
    documents = [made(rng) for _ in range(60)]
    rows = [(i, list(p), f, s) for i, d in enumerate(documents) for p, _, f, s, _ in cells_of(d)]
    cells = spark.createDataFrame(rows, "file_id int, path array<string>, f double, s string").cache()
    every = cells.select("file_id", F.array(F.lit("other")).alias("path"), F.lit(0.0).alias("f"), F.lit(None).cast("string").alias("s")).distinct()
    fixed = ["! /a/*/1 > 1", "/a/* > 1", "! /a/* > 1", "!exists(/a/*/b)", "/a/*(! /a > 1)", "! /a == /b/*/b", "! /a/*(/b > 1)", "/a/*/1(/2 > 1) | !/b > 2"]
    for text in [*fixed, *(expression(rng) for _ in range(12))]:
        tree = ce.parse_match(text)
        want = {i: {bool(x) for x in truths(tree, d)} for i, d in enumerate(documents)}
        got = {r.file_id: {x for x, there in ((True, r.matched), (False, r.unmatched)) if there} for r in ce.match(cells, text).collect()}
        assert got == want, text
        true = {i for i, t in want.items() if True in t}
        assert {r.file_id for r in ce.matched(cells, text).collect()} == true, text
        # cells that the expression doesn't look at may be left out; a file that keeps none is known by its other cells
        asked = F.lit(False)
        for steps in ce.paths_of(text):
            asked = asked | ce.below(F.col("path"), steps)
        assert {r.file_id for r in ce.matched(cells.where(asked).union(every), text).collect()} == true, text


def bindings(node, document, order):
    """Truth and bound paths of each binding, in their order."""
    children = lambda d: {k: d[k] for k in sorted(d, key=order)}
    if node.kind in ("and", "or"):
        for (a, p), (b, q) in itertools.product(*(list(bindings(x, document, order)) for x in node.args)):
            yield (a and b) if node.kind == "and" else (a or b), p + q
    elif node.kind == "not":
        yield from ((not t, p) for t, p in bindings(node.args[0], document, order))
    elif node.kind == "exists":
        yield from ((find(document, p) is not None, [p]) for p in nodes(ordered(document, children), node.args[0]))
    elif node.kind == "in":
        for p in nodes(ordered(document, children), node.args[0]):
            inner = find(document, p)
            yield from [(False, [p])] if inner is None else ((t, [(*p, *x) for x in q]) for t, q in bindings(node.args[1], inner, order))
    else:
        sides = [[(a, [])] if isinstance(a, float) else [(find(document, p), [p]) for p in nodes(ordered(document, children), a)] for a in node.args]
        for (x, p), (y, q) in itertools.product(*sides):
            yield all(isinstance(v, float) for v in (x, y)) and SIGNS[node.kind](x, y), p + q


def ordered(document, children):
    return {k: ordered(v, children) for k, v in children(document).items()} if isinstance(document, dict) else document


def test_the_first_true_binding(spark):
    rng = random.Random(5)
    documents = [made(rng) for _ in range(60)]
    rows = [(i, list(p), f, s) for i, d in enumerate(documents) for p, _, f, s, _ in cells_of(d)]
    cells = spark.createDataFrame(rows, "file_id int, path array<string>, f double, s string").cache()
    order = lambda k: (k.isdigit(), int(k) if k.isdigit() else 0, k)
    fixed = ["/a/* > 1 & /b/* > 0", "/a/* > 1 | /b/* > 0", "! (/a/* > 1 & /b/* > 0)", "! (/a/* > 1 | exists(/b/*/1))", "/a/*(/b > 0 | ! /1 > 1)", "/a < /b/*", "/a/*/1 >= /b & ! /1 > 1", "2 > 1 & /a/* > 0"]
    for text in [*fixed, *(x for x in (expression(rng) for _ in range(40)) if not re.search(r"\*\S* (<|>|<=|>=|==|!=) \S*\*", x))][:18]:
        tree = ce.parse_match(text)
        want = {}
        for i, d in enumerate(documents):
            first = next((p for t, p in bindings(tree, d, order) if t), None)
            if first is not None:
                want[i] = first
        got = {r.file_id: [tuple(b.path) for b in r.binding] for r in ce.first_binding(cells, text).collect()}
        assert got == want, text


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_first_bindings_are_found_in_one_pass(spark):
    cells = spark.range(100).selectExpr("id div 10 AS file_id", "array('a', cast(id % 10 AS string), 'q') AS path", "cast(id AS double) AS f", "cast(null AS string) AS s")
    for text in ("/a/*/q > 5", "/a/*(/q > 5 & /q < 9)", "/a/*/q > 50 | /N > 5", "/a/*/q > 50 & ! (/N > 5 | /a/*/q > 80)"):
        plan = _plan(ce.first_binding(cells, text))
        assert plan.count("Range (") == 1 and "Join" not in plan, text


def test_expressions_are_evaluated_in_one_pass(spark):
    cells = spark.range(100).selectExpr("id div 10 AS file_id", "array('a', cast(id % 10 AS string), 'q') AS path", "cast(id AS double) AS f", "cast(null AS string) AS s")
    for text in ("/a/*(/q > 5 & /q < 9)", "! /a/*/q > 50", "(/a/*/q < 5 & /N > 2) | ! /a/*/q > 50", "! /a/* > 0 & ! exists(/a/*/none) & ! /N == /a/*/none"):
        plan = _plan(ce.matched(cells, text))
        assert plan.count("Range (") == 1 and "Join" not in plan, text
    plan = _plan(ce.match(cells, "/a/*/q > 50"))
    assert plan.count("Range (") == 1 and "Join" not in plan
