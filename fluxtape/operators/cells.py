"""Documents as tables of addressed cells: paths, the match language, differences and edits.

A cell is ``(file_id, path array<string>, f double, s string)``, and ``i bigint`` too where
whole numbers are told from others.  Steps of digits only are indices and are kept
without leading zeros.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import is_close


def parse_path(text: str) -> list[str]:
    """Steps of a path: slashes separate, ``a[1,2]`` is ``a/1/2``, ``*`` stands for any step."""
    flat = re.sub(r"\[([^\]]*)\]", lambda m: "/" + m[1].replace(",", "/"), text)
    steps = [s.strip() for s in flat.split("/") if s.strip()]
    for s in steps:
        if not re.fullmatch(r"\*|[0-9]+|[A-Za-z_][A-Za-z0-9_]*", s):
            raise ValueError(f"bad path step {s!r}")
    return [s.lstrip("0") or "0" if s.isdigit() else s for s in steps]


def path_column(text: Column) -> Column:
    """The same for a column without brackets' contents to check."""
    flat = F.replace(F.replace(F.replace(text, F.lit("["), F.lit("/")), F.lit("]"), F.lit("")), F.lit(","), F.lit("/"))
    return F.transform(F.filter(F.split(flat, "/"), lambda s: F.trim(s) != ""), lambda s: F.regexp_replace(F.trim(s), "^0+(?=[0-9])", ""))


def matches(path: Column, steps: list[str]) -> Column:
    """Whether a cell's path is one of a pattern's."""
    out = F.size(path) == len(steps)
    for i, s in enumerate(steps):
        if s != "*":
            out = out & (F.get(path, F.lit(i)) == s)
    return out


def below(path: Column, steps: list[str]) -> Column:
    """Whether a path is at or below a pattern."""
    out = F.size(path) >= len(steps)
    for i, s in enumerate(steps):
        if s != "*":
            out = out & (F.get(path, F.lit(i)) == s)
    return out


def get(cells: DataFrame, path: str) -> DataFrame:
    return cells.where(matches(F.col("path"), parse_path(path)))


def exists(cells: DataFrame, path: str) -> DataFrame:
    """Files that hold something at or below a path."""
    return cells.where(below(F.col("path"), parse_path(path))).select("file_id").distinct()


def remove(cells: DataFrame, path: str) -> DataFrame:
    return cells.where(~below(F.col("path"), parse_path(path)))


def put(cells: DataFrame, new: DataFrame) -> DataFrame:
    """Cells with those of ``new`` in place of what was at or below their paths."""
    ahead = new.select("file_id", "path")
    at = cells.withColumn("up", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))))
    gone = at.join(ahead.select("file_id", F.col("path").alias("up")), ["file_id", "up"], "left_semi").select("file_id", "path")
    return cells.join(gone, ["file_id", "path"], "left_anti").unionByName(new)


def locate(cells: DataFrame, name: str) -> DataFrame:
    """Paths down to the first step of a name."""
    found = cells.where(F.array_contains("path", name))
    return found.select("file_id", F.slice("path", F.lit(1), F.array_position("path", F.lit(name)).cast("int")).alias("path")).distinct()


def children(cells: DataFrame, path: str) -> DataFrame:
    """Steps below a path, whether each is a value, and how many cells it holds."""
    steps = parse_path(path)
    under = cells.where(below(F.col("path"), steps) & (F.size("path") > len(steps)))
    return under.groupBy("file_id", F.get("path", F.lit(len(steps))).alias("step")).agg(F.count("*").alias("n_cells"), F.bool_and(F.size("path") == len(steps) + 1).alias("is_value"))


@dataclass(frozen=True)
class View:
    """A place in the documents of cells: a path with what can be done there; changes give new views of the same place."""

    cells: DataFrame
    path: tuple[str, ...] | list[str] = ()

    def at(self, path: str) -> View:
        return View(self.cells, [*self.path, *parse_path(path)])

    @property
    def parent(self) -> View:
        return View(self.cells, list(self.path[:-1]))

    @property
    def root(self) -> View:
        return View(self.cells)

    @property
    def name(self) -> str:
        return self.path[-1] if self.path else ""

    def _text(self) -> str:
        return "/".join(self.path)

    def get(self) -> DataFrame:
        return get(self.cells, self._text())

    def exists(self) -> DataFrame:
        return exists(self.cells, self._text())

    def children(self) -> DataFrame:
        return children(self.cells, self._text())

    def put(self, value: float | str) -> View:
        """One value at the place in every file, instead of what was there; the view of the root."""
        files = self.cells.select("file_id").distinct()
        made = files.select("file_id", F.array(*(F.lit(s) for s in self.path)).alias("path"), F.lit(None if isinstance(value, str) else float(value)).cast("double").alias("f"), F.lit(value if isinstance(value, str) else None).cast("string").alias("s"))
        if "i" in self.cells.columns:
            made = made.withColumn("i", F.lit(value if isinstance(value, int) else None).cast("bigint"))
        if "src" in self.cells.columns:
            made = made.withColumn("src", F.lit(None).cast("string"))
        return View(put(self.cells, made.select(*self.cells.columns)))

    def remove(self) -> View:
        return View(remove(self.cells, self._text()))


# -- the match language

_TOKEN = re.compile(r"\s*(==|!=|<=|>=|[<>!&|()]|exists\b|/(?:[A-Za-z0-9_*]+/*)+|[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)")


@dataclass
class Node:
    """kind: or, and, not, in (a prefix), exists, or a relation's sign."""

    kind: str
    args: list


def parse_match(text: str) -> Node:
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        tokens.append(m[1])
        at = m.end()
    place = 0

    def peek() -> str:
        return tokens[place] if place < len(tokens) else ""

    def take(want: str = "") -> str:
        nonlocal place
        token = peek()
        if want and token != want or not token:
            raise ValueError(f"expected {want or 'more'} but found {token or 'the end'}")
        place += 1
        return token

    def disjunction() -> Node:
        left = conjunction()
        while peek() == "|":
            take()
            left = Node("or", [left, conjunction()])
        return left

    def conjunction() -> Node:
        left = atom()
        while peek() == "&":
            take()
            left = Node("and", [left, atom()])
        return left

    def operand():
        token = take()
        return parse_path(token) if token[0] == "/" else float(token)

    def inside() -> Node:
        take("(")
        node = disjunction()
        take(")")
        return node

    def atom() -> Node:
        if peek() == "!":
            take()
            return Node("not", [atom()])
        if peek() == "(":
            return inside()
        if peek() == "exists":
            take()
            take("(")
            path = operand()
            take(")")
            return Node("exists", [path])
        left = operand()
        if isinstance(left, list) and peek() == "(":
            return Node("in", [left, inside()])
        sign = take()
        return Node(sign, [left, operand()])

    out = disjunction()
    if place < len(tokens):
        raise ValueError(f"cannot read on at {peek()!r}")
    return out


MIRROR = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "==": "==", "!=": "!="}


def match(cells: DataFrame, query: str) -> DataFrame:
    """``file_id, matched, unmatched`` of each file of ``cells``.

    An expression is true for a file if one way of binding its wildcards is, so all
    that is carried up the expression is whether a true and whether a false binding
    exists.  A path without a wildcard always has one binding.  A wildcard has one for each node that it meets,
    a value or not, and none where it meets nothing; what follows the last one may be missing there.
    A binding is false where its cell is missing or no number.  All
    relations are aggregates of one grouping, before which the false bindings of a wildcard before a path's
    end group by its nodes; only a prefix groups its cells by itself.
    """
    return _evaluate(cells, parse_match(query), ["file_id"], 0, "tf").select("file_id", F.col("ct").alias("matched"), F.col("cf").alias("unmatched"))


def paths_of(query: str, unmatched: bool = False) -> list[list[str]]:
    """The paths at or below which an expression looks: of :func:`matched`, or with ``unmatched`` of :func:`match`.

    Where a false binding counts, a wildcard meets every node, so all below the last one is looked at.  A file that
    has none of them is known by other cells, if an expression may be true of what is missing.
    """
    found: list[list[str]] = []

    def look(path: list[str], need: str) -> None:
        whole = "f" not in need or "*" not in path
        found.append(path if whole else path[: len(path) - path[::-1].index("*")])

    def walk(node: Node, before: list[str], need: str) -> None:
        if node.kind in ("and", "or"):
            both = need if node.kind == "and" and need == "t" or node.kind == "or" and need == "f" else "tf"
            for x in node.args:
                walk(x, before, both)
        elif node.kind == "not":
            walk(node.args[0], before, need.translate(str.maketrans("tf", "ft")))
        elif node.kind == "exists":
            look(before + node.args[0], need)
        elif node.kind == "in":
            # an inner expression may be true of what is missing, so its scope must be known to be there
            look(before + node.args[0], "tf")
            walk(node.args[1], before + node.args[0], need)
        else:
            for path in (a for a in node.args if isinstance(a, list)):
                look(before + path, need)

    walk(parse_match(query), [], "tf" if unmatched else "t")
    return [p for k, p in enumerate(found) if p not in found[:k]]


def matched(cells: DataFrame, query: str) -> DataFrame:
    """``file_id`` of each file that an expression is true for; false bindings are only looked for where it takes them."""
    return _evaluate(cells, parse_match(query), ["file_id"], 0, "t").where("ct").select("file_id")


def _evaluate(cells: DataFrame, tree: Node, keys: list[str], depth: int, need: str) -> DataFrame:
    """``keys, ct, cf``: whether a true and a false binding exist; ``need`` names those that are asked for, the other is false."""
    aggregates: dict[str, tuple[str, Column]] = {}
    joined: list[tuple[str, DataFrame]] = []
    nodes_of: list[tuple[str, list[str], Column]] = []  # a pattern's nodes, and what each of them may lack

    def bindings(steps: list[str]) -> Column:
        return matches(F.slice("path", F.lit(depth + 1), F.greatest(F.size("path") - depth, F.lit(0))), steps)

    def leaf(kind: str, value: Column) -> str:
        name = f"a{len(aggregates)}"
        aggregates[name] = kind, value
        return name

    def truth(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    part = F.slice("path", F.lit(depth + 1), F.greatest(F.size("path") - depth, F.lit(0)))

    def missing(steps: list[str], subtree: bool = False) -> Column:
        """Whether a binding of a path lacks its number, or with ``subtree`` anything at or below it."""
        if "*" not in steps:
            return ~truth(leaf("or", (below(part, steps) if subtree else matches(part, steps) & F.col("f").isNotNull())))
        nodes = len(steps) - steps[::-1].index("*")
        if nodes == len(steps):
            return F.lit(False) if subtree else truth(leaf("or", (below(part, steps) & ((F.size(part) > nodes) | F.col("f").isNull()))))
        rest, name = F.slice(part, F.lit(nodes + 1), F.greatest(F.size(part) - nodes, F.lit(0))), f"m{depth}_{len(nodes_of)}"
        there = below(rest, steps[nodes:]) if subtree else matches(rest, steps[nodes:]) & F.col("f").isNotNull()
        nodes_of.append((name, steps[:nodes], there))
        return truth(name)

    def met(steps: list[str]) -> Column:
        """Whether a path has a binding."""
        return truth(leaf("or", (below(part, steps[: len(steps) - steps[::-1].index("*")])))) if "*" in steps else F.lit(True)

    def one(steps: list[str], test: Column, need: str) -> tuple[Column, Column]:
        hit = bindings(steps)
        yes = truth(leaf("or", (hit & F.coalesce(test, F.lit(False))))) if "t" in need else F.lit(False)
        if "f" not in need:
            return yes, F.lit(False)
        return yes, truth(leaf("or", (hit & ~F.coalesce(test, F.lit(False))))) | missing(steps)

    def relation(sign: str, a, b, need: str) -> tuple[Column, Column]:
        signs = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y, "==": lambda x, y: x == y, "!=": lambda x, y: x != y}
        if isinstance(a, float) and isinstance(b, float):
            return F.lit(signs[sign](a, b)), F.lit(not signs[sign](a, b))
        if isinstance(a, float):
            return relation(MIRROR[sign], b, a, need)
        if isinstance(b, float):
            return one(a, signs[sign](F.col("f"), F.lit(b)), need)
        x, y = (F.when(bindings(p), F.col("f")) for p in (a, b))
        lo_x, hi_x, lo_y, hi_y = (F.col(leaf(*v)) for v in (("min", x), ("max", x), ("min", y), ("max", y)))
        if sign in "<=" and sign != "==":
            yes, no = signs[sign](lo_x, hi_y), ~signs[sign](hi_x, lo_y)
        elif sign in ">=":
            yes, no = signs[sign](hi_x, lo_y), ~signs[sign](lo_x, hi_y)
        else:
            xs, ys = F.col(leaf("set", x)), F.col(leaf("set", y))
            same, other = F.arrays_overlap(xs, ys), (F.size(xs) > 0) & (F.size(ys) > 0) & (F.size(F.array_union(xs, ys)) > 1)
            yes, no = (same, other) if sign == "==" else (other, same)
        yes, no = F.coalesce(yes, F.lit(False)), F.coalesce(no, F.lit(False))
        if "f" in need:
            no = no | (missing(a) & met(b)) | (missing(b) & met(a))
        return yes, no

    def walk(node: Node, need: str) -> tuple[Column, Column]:
        if node.kind in ("and", "or"):
            both = need if node.kind == "and" and need == "t" or node.kind == "or" and need == "f" else "tf"
            (ta, fa), (tb, fb) = walk(node.args[0], both), walk(node.args[1], both)
            na, nb = ta | fa, tb | fb
            if node.kind == "and":
                return ta & tb, (fa & nb) | (fb & na)
            return (ta & nb) | (tb & na), fa & fb
        if node.kind == "not":
            t, f = walk(node.args[0], need.translate(str.maketrans("tf", "ft")))
            return f, t
        if node.kind == "exists":
            steps = node.args[0]
            return truth(leaf("or", (below(part, steps)))), missing(steps, subtree=True) if "f" in need else F.lit(False)
        if node.kind == "in":
            steps, inner = node.args
            scope = f"scope{depth}_{len(joined)}"
            under = cells.where(below(part, steps)).withColumn(scope, F.slice("path", depth + 1, len(steps)))
            each = _evaluate(under, inner, [*keys, scope], depth + len(steps), need)
            name = f"p{depth}_{len(joined)}"
            joined.append((name, each.groupBy(*keys).agg(F.bool_or("ct").alias(f"{name}t"), F.bool_or("cf").alias(f"{name}f"))))
            rest = steps[len(steps) - steps[::-1].index("*") :] if "*" in steps else steps
            none = missing(steps, subtree=True) if "f" in need and rest else F.lit(False)
            return truth(f"{name}t"), truth(f"{name}f") | none
        return relation(node.kind, *node.args, need)

    ct, cf = walk(tree, need)
    if tree.kind == "in" and need == "t" and not depth:  # nothing is true of a file without the prefix
        return joined[0][1].select(*keys, ct.alias("ct"), cf.alias("cf"))
    first = {"or": F.bool_or, "min": F.min, "max": F.max, "set": F.collect_set}
    again = first | {"set": lambda c: F.array_distinct(F.flatten(F.collect_list(c)))}
    if not nodes_of:
        out = cells.groupBy(*keys).agg(*([first[kind](v).alias(n) for n, (kind, v) in aggregates.items()] or [F.count("*").alias("a0")]))
    else:  # each cell goes to the nodes that it is at or below, nodes to their keys: what is found per node is put together once more
        role = lambda k, node: F.struct(F.lit(k).alias("k"), node.alias("node"))
        patterns = [p for k, (_, p, _) in enumerate(nodes_of) if p not in [q for _, q, _ in nodes_of[:k]]]
        to = F.filter(F.array(*(F.when(below(part, p), role(k, F.slice(part, 1, len(p)))) for k, p in enumerate(patterns))), lambda r: r.isNotNull())
        none = F.array(role(-1, F.lit(None).cast("array<string>")))
        values = {n: v for n, (_, v) in aggregates.items()} | {n: (F.col("_r.k") == patterns.index(p)) & there for n, p, there in nodes_of}
        kinds = {n: kind for n, (kind, _) in aggregates.items()} | {n: "or" for n, _, _ in nodes_of}
        seen = cells.withColumn("_r", F.explode_outer(F.when(F.size(to) > 0, to).otherwise(none)))
        each = seen.groupBy(*keys, F.col("_r.k").alias("_k"), F.col("_r.node").alias("_node")).agg(*(first[kinds[n]](v).alias(n) for n, v in values.items()))
        lacking = {n: F.bool_or((F.col("_k") == patterns.index(p)) & ~truth(n)).alias(n) for n, p, _ in nodes_of}
        out = each.groupBy(*keys).agg(*(lacking[n] if n in lacking else again[kind](F.col(n)).alias(n) for n, kind in kinds.items()))
    for _, frame in joined:
        out = out.join(frame, keys, "left")
    return out.select(*keys, ct.alias("ct"), cf.alias("cf"))


# -- differences and edits


def compare(left: DataFrame, right: DataFrame, rtol: float = 1e-6, atol: float = 1e-8, strip: bool = False, first: int | None = None, lengths_only: bool = False) -> DataFrame:
    """``file_id, path, code``: cells on one side only, and values that differ.

    Numbers are compared within a tolerance relative to the right side, whole numbers
    (where both sides have a column ``i``) exactly, and a whole number and another one
    differ in ``type``.  Texts are compared without trailing blanks with ``strip``, up
    to the ``first`` characters, or by their lengths only.
    """
    typed = "i" in left.columns and "i" in right.columns
    whole = lambda side: (F.col("i") if typed else F.lit(None).cast("bigint")).alias(f"{side}i")
    a = left.select("file_id", "path", whole("l"), F.col("f").alias("lf"), F.col("s").alias("ls"), F.lit(True).alias("l"))
    b = right.select("file_id", "path", whole("r"), F.col("f").alias("rf"), F.col("s").alias("rs"), F.lit(True).alias("r"))
    both = a.join(b, ["file_id", "path"], "full_outer")
    one, two = F.col("ls"), F.col("rs")
    if strip:
        one, two = F.rtrim(one), F.rtrim(two)
    if first is not None:
        one, two = F.substring(one, 1, first), F.substring(two, 1, first)
    text = F.when(F.length(one) != F.length(two), "length")
    numbers = F.col("lf").isNotNull() & F.col("rf").isNotNull()
    code = (
        F.when(F.col("r").isNull(), "only_left")
        .when(F.col("l").isNull(), "only_right")
        .when(numbers & F.lit(typed) & (F.col("li").isNull() != F.col("ri").isNull()), "type")
        .when(numbers & F.col("li").isNotNull() & F.col("ri").isNotNull(), F.when(F.col("li") != F.col("ri"), "value"))
        .when(numbers, F.when(~is_close(F.col("lf"), F.col("rf"), rtol, atol), "value"))
        .when(F.col("lf").isNotNull() | F.col("rf").isNotNull(), "type")
        .otherwise(text if lengths_only else text.when(one != two, "string"))
    )
    return both.withColumn("code", code).where("code IS NOT NULL").select("file_id", "path", "code")


def equal_files(left: DataFrame, right: DataFrame) -> DataFrame:
    """``file_id, equal``: whether both sides hold the same cells with the same values."""
    every = left.select("file_id").union(right.select("file_id")).distinct()
    differ = compare(left, right, 0.0, 0.0).groupBy("file_id").agg(F.count("*").alias("n"))
    return every.join(differ, "file_id", "left").select("file_id", F.col("n").isNull().alias("equal"))


def in_order(differences: DataFrame) -> DataFrame:
    """Sorted by file and path: at each step names before numbers, each in its own order."""
    key = F.transform("path", lambda s: F.struct(s.rlike("^[0-9]+$").alias("n"), s.try_cast("bigint").alias("k"), s.alias("s")))
    return differences.withColumn("_o", key).orderBy("file_id", "_o").drop("_o")


def get_many(cells: DataFrame, paths: DataFrame) -> DataFrame:
    """Cells at the paths of ``paths(path array<string>)``, in all files."""
    return cells.join(paths.select("path").distinct(), "path", "left_semi").select(*cells.columns)


def _place(path: Column) -> Column:
    """Order of paths: at each step names before numbers, each in its own order."""
    return F.transform(path, lambda s: F.struct(s.rlike("^[0-9]+$").alias("n"), s.try_cast("bigint").alias("k"), s.alias("s")))


def first_binding(cells: DataFrame, query: str) -> DataFrame:
    """``file_id, path, f, binding`` of the first binding that makes an expression true in each file that it is true for.

    ``binding`` holds the path and number that each path of the expression is bound to, in their order, ``path`` and ``f`` the
    first of them.  Bindings are tried with the last path turning fastest, each in the order of :func:`in_order`.  Up the expression only
    the first true and the first false binding of each part are carried, from which those of the whole follow; one that no
    part above asks for is not looked for, and what only takes true bindings of cells is found by one pass over those cells.
    A relation of two paths may have wildcards in one of them.
    """
    done = _first(cells, parse_match(query), ["file_id"], 0, "t").where("t IS NOT NULL")
    head = F.get("t", F.lit(0))
    return done.select("file_id", head["path"].alias("path"), head["f"].alias("f"), F.transform("t", lambda b: F.struct(b["path"].alias("path"), b["f"].alias("f"))).alias("binding"))


def _leaves(tree: Node, kinds: tuple[str, ...] = ("and", "or", "not")) -> list[Node] | None:
    """Relations of paths to numbers, in their order, that an expression puts together by these kinds of nodes alone; else None."""
    if tree.kind in kinds:
        parts = [_leaves(x, kinds) for x in tree.args]
        return None if any(x is None for x in parts) else [y for x in parts for y in x]
    if tree.kind in MIRROR and sum(isinstance(x, float) for x in tree.args) == 1:
        return [tree if isinstance(tree.args[1], float) else Node(MIRROR[tree.kind], tree.args[::-1])]
    return None


def _first(cells: DataFrame, tree: Node, keys: list[str], depth: int, need: str = "tn") -> DataFrame:
    """``keys, t, n``: the first true and the first false binding, each a list of place, path and number, or null.

    ``need`` names those that are asked for; the other may be null, and rows without any may be left out if only true ones are.
    """
    part = F.slice("path", F.lit(depth + 1), F.greatest(F.size("path") - depth, F.lit(0)))
    whole = cells.groupBy(*keys).agg(F.count("*").alias("_all"))
    tests = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y, "==": lambda x, y: x == y, "!=": lambda x, y: x != y}

    def bound(path: Column, f: Column) -> Column:
        return F.struct(_place(path).alias("k"), path.alias("path"), f.cast("double").alias("f"))

    def nodes(steps: list[str], subtree: bool) -> DataFrame:
        """``keys, path, f, there``: every binding of a path, its number, and whether anything is at or below it."""
        cut = len(steps) - steps[::-1].index("*") if "*" in steps else 0
        rest = F.slice(part, F.lit(cut + 1), F.greatest(F.size(part) - cut, F.lit(0)))
        value = F.max(F.when(matches(rest, steps[cut:]), F.col("f"))).alias("f")
        there = F.bool_or(below(rest, steps[cut:]) if subtree else matches(rest, steps[cut:])).alias("there")
        tail = F.array(*(F.lit(x) for x in steps[cut:])).cast("array<string>")
        if not cut:
            return cells.groupBy(*keys).agg(value, there).select(*keys, tail.alias("path"), "f", "there")
        met = cells.where(below(part, steps[:cut])).groupBy(*keys, F.slice(part, 1, cut).alias("_node")).agg(value, there)
        return met.select(*keys, F.concat("_node", tail).alias("path"), "f", "there")

    def chosen(rows: DataFrame, true: Column, binding: Column) -> DataFrame:
        """The first true and the first false of rows that are bindings."""
        order = F.transform(binding, lambda b: b["k"])
        marked = rows.select(*keys, F.coalesce(true, F.lit(False)).alias("_true"), binding.alias("_b"), order.alias("_o"))
        pick = lambda cond, name: F.min_by(F.when(cond, F.col("_b")), F.when(cond, F.col("_o"))).alias(name)
        return marked.groupBy(*keys).agg(pick(F.col("_true"), "t"), pick(~F.col("_true"), "n"))

    def true_only(leaves: list[Node]) -> DataFrame:
        """The first true binding of relations of paths to numbers that all have one, by one grouping of the cells that make one true."""
        hits = [matches(part, steps) & F.coalesce(tests[sign](F.col("f"), F.lit(number)), F.lit(False)) for sign, (steps, number) in ((x.kind, x.args) for x in leaves)]
        met = cells.where(reduce(or_, hits)).select(*keys, bound(part, F.col("f")).alias("_b"), *(h.alias(f"_h{k}") for k, h in enumerate(hits)))
        firsts = [F.min(F.when(F.col(f"_h{k}"), F.col("_b"))).alias(f"_t{k}") for k in range(len(hits))]
        found = met.groupBy(*keys).agg(*firsts).where(reduce(and_, (F.col(f"_t{k}").isNotNull() for k in range(len(hits)))))
        every = F.array(*(F.col(f"_t{k}") for k in range(len(hits))))
        return found.select(*keys, every.alias("t"), F.when(F.lit(False), every).alias("n"))

    if need == "t" and (leaves := _leaves(tree, ("and",))):
        return true_only(leaves)
    if tree.kind == "in" and need == "t" and _leaves(tree.args[1], ("and",)):
        scope = tree.args[0]
        inner = _first(cells.where(below(part, scope)).withColumn(f"_scope{depth}", F.slice("path", depth + 1, len(scope))), tree.args[1], [*keys, f"_scope{depth}"], depth + len(scope), "t")
        absolute = F.transform("t", lambda x: bound(F.concat(F.col(f"_scope{depth}"), x["path"]), x["f"]))
        each = inner.select(*keys, _place(F.col(f"_scope{depth}")).alias("_o"), absolute.alias("_t"))
        first = each.groupBy(*keys).agg(F.min_by("_t", "_o").alias("t"))
        return first.select(*keys, "t", F.when(F.lit(False), F.col("t")).alias("n"))
    if tree.kind == "not":
        return _first(cells, tree.args[0], keys, depth, need.translate(str.maketrans("tn", "nt"))).select(*keys, F.col("n").alias("t"), F.col("t").alias("n"))
    def joint(kind: str, t0: Column, n0: Column, t1: Column, n1: Column) -> tuple[Column, Column]:
        """The first true and the first false binding of two parts together."""
        key = lambda b: F.transform(b, lambda x: x["k"])
        starts_true = lambda t, n: t.isNotNull() & (n.isNull() | F.coalesce(key(t) < key(n), F.lit(True)))
        any1 = F.when(starts_true(t1, n1), t1).otherwise(n1)
        if kind == "and":
            return F.concat(t0, t1), F.when(starts_true(t0, n0), F.coalesce(F.concat(t0, n1), F.concat(n0, any1))).otherwise(F.concat(n0, any1))
        return F.when(starts_true(t0, n0), F.concat(t0, any1)).otherwise(F.coalesce(F.concat(n0, t1), F.concat(t0, any1))), F.concat(n0, n1)

    def one_pass(leaves: list[Node]) -> DataFrame:
        """``keys, t0, n0, t1, ...`` of relations of paths to numbers: a cell goes to the nodes that wildcards meet in it, then nodes to their keys."""
        cuts = [len(x.args[0]) - x.args[0][::-1].index("*") if "*" in x.args[0] else 0 for x in leaves]
        role = lambda k, node: F.struct(F.lit(k).alias("k"), node.alias("node"))
        roles = [F.when(below(part, x.args[0][:cut]), role(k, F.slice(part, 1, cut))) for k, (x, cut) in enumerate(zip(leaves, cuts)) if cut]
        none = F.array(role(-1, F.lit(None).cast("array<string>")))
        to = F.filter(F.array(*roles), lambda r: r.isNotNull()) if roles else none
        values = [F.max(F.when(matches(part, x.args[0]), F.col("f"))).alias(f"_v{k}") for k, x in enumerate(leaves)]
        seen = cells.select(*keys, "path", "f", F.explode_outer(F.when(F.size(to) > 0, to).otherwise(none)).alias("_r"))
        each = seen.groupBy(*keys, F.col("_r.k").alias("_k"), F.col("_r.node").alias("_node")).agg(*values)
        firsts = []
        for k, (x, cut) in enumerate(zip(leaves, cuts)):
            tail = F.array(*(F.lit(step) for step in x.args[0][cut:])).cast("array<string>")
            value = F.col(f"_v{k}")
            if not cut:
                firsts.append(F.max(value).alias(f"_v{k}"))
                continue
            true = F.coalesce(tests[x.kind](value, F.lit(x.args[1])), F.lit(False))
            firsts += [F.min(F.when((F.col("_k") == k) & cond, bound(F.concat("_node", tail), value))).alias(f"{c}{k}") for c, cond in (("t", true), ("n", ~true))]
        found = each.groupBy(*keys).agg(*firsts)
        for k, (x, cut) in enumerate(zip(leaves, cuts)):
            if not cut:
                value = F.col(f"_v{k}")
                true = F.coalesce(tests[x.kind](value, F.lit(x.args[1])), F.lit(False))
                made = bound(F.array(*(F.lit(step) for step in x.args[0])).cast("array<string>"), value)
                found = found.withColumns({f"t{k}": F.when(true, made), f"n{k}": F.when(~true, made)})
        as_list = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).alias(c)
        return found.select(*keys, *(as_list(f"{c}{k}") for k in range(len(leaves)) for c in "tn"))

    if tree.kind in ("and", "or") and (leaves := _leaves(tree)):
        found = one_pass(leaves)
        place = iter(range(len(leaves)))

        def walk(node: Node) -> tuple[str, str]:
            nonlocal found
            if node.kind == "not":
                return walk(node.args[0])[::-1]
            if node.kind not in ("and", "or"):
                k = next(place)
                return f"t{k}", f"n{k}"
            (t0, n0), (t1, n1) = walk(node.args[0]), walk(node.args[1])
            made = [f"_{len(found.columns)}t", f"_{len(found.columns)}n"]
            found = found.withColumns(dict(zip(made, joint(node.kind, *map(F.col, (t0, n0, t1, n1))))))
            return made[0], made[1]

        t, n = walk(tree)
        return found.select(*keys, F.col(t).alias("t"), F.col(n).alias("n"))
    if tree.kind in ("and", "or"):
        one, two = (_first(cells, x, keys, depth).select(*keys, F.col("t").alias(f"t{k}"), F.col("n").alias(f"n{k}")) for k, x in enumerate(tree.args))
        t, n = joint(tree.kind, *(F.col(c) for c in ("t0", "n0", "t1", "n1")))
        return one.join(two, keys).select(*keys, t.alias("t"), n.alias("n"))
    if tree.kind == "exists":
        return chosen(nodes(tree.args[0], True), F.col("there"), F.array(bound(F.col("path"), F.col("f"))))
    if tree.kind == "in":
        steps, inner = tree.args
        known = nodes(steps, True).select(*keys, F.col("path").alias("_scope"), "there")
        under = cells.where(below(part, steps)).withColumn("_scope", F.slice("path", depth + 1, len(steps)))
        scope = f"_scope{depth}"
        each = _first(under.withColumnRenamed("_scope", scope), inner, [*keys, scope], depth + len(steps)).withColumnRenamed(scope, "_scope")
        absolute = lambda b: F.transform(b, lambda x: bound(F.concat("_scope", x["path"]), x["f"]))
        inside = each.select(*keys, "_scope", absolute(F.col("t")).alias("t"), absolute(F.col("n")).alias("n"))
        every = known.join(inside, [*keys, "_scope"], "left")
        lost = F.when(~F.col("there"), F.array(bound(F.col("_scope"), F.lit(None))))
        every = every.select(*keys, "t", F.coalesce("n", lost).alias("n"), _place(F.col("_scope")).alias("_o"))
        pick = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c)
        return every.groupBy(*keys).agg(pick("t"), pick("n"))
    a, b = tree.args
    test = tests[tree.kind]
    if isinstance(a, float) and isinstance(b, float):
        none = F.array().cast("array<struct<k:array<struct<n:boolean,k:bigint,s:string>>,path:array<string>,f:double>>")
        holds = test(a, b)
        return whole.select(*keys, F.when(F.lit(holds), none).alias("t"), F.when(F.lit(not holds), none).alias("n"))
    if isinstance(a, float) or isinstance(b, float):
        steps, number = (b, a) if isinstance(a, float) else (a, b)
        true = test(F.lit(number), F.col("f")) if isinstance(a, float) else test(F.col("f"), F.lit(number))
        return chosen(nodes(steps, False), true, F.array(bound(F.col("path"), F.col("f"))))
    if "*" in a and "*" in b:
        raise ValueError("a relation of two paths may have wildcards in one of them")
    left, right = (nodes(x, False).select(*keys, F.col("path").alias(f"_p{k}"), F.col("f").alias(f"_f{k}")) for k, x in enumerate((a, b)))
    return chosen(left.join(right, keys), test(F.col("_f0"), F.col("_f1")), F.array(bound(F.col("_p0"), F.col("_f0")), bound(F.col("_p1"), F.col("_f1"))))


def replace_subtree(target: DataFrame, source: DataFrame, path: str) -> DataFrame:
    """Target with everything at or below a path taken from the source."""
    return remove(target, path).unionByName(source.where(below(F.col("path"), parse_path(path))).select(*target.columns))


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Cells of both; where both hold a path, that of the second."""
    ours = first.join(second.select("file_id", "path"), ["file_id", "path"], "left_anti")
    return ours.select(*first.columns).unionByName(second.select(*first.columns))


def updated_directory(line_counts: DataFrame, old: DataFrame, nwd: DataFrame) -> DataFrame:
    """``file_id, i, mf, mt, nc, mod`` from counted lines of sections.

    ``line_counts(file_id, mf, mt, n)``, ``old(file_id, mf, mt, mod)`` and
    ``nwd(file_id, nwd)``: the directory's own section counts four lines, its
    description and one line for each section; unknown MOD numbers are 0.
    """
    from pyspark.sql import Window

    per_file = line_counts.groupBy("file_id").agg(F.count("*").alias("k"))
    own = (F.col("mf") == 1) & (F.col("mt") == 451)
    known = line_counts.join(per_file, "file_id").join(nwd, "file_id").join(old, ["file_id", "mf", "mt"], "left")
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("mf", "mt"))
    return known.select("file_id", place.alias("i"), "mf", "mt", F.when(own, 4 + F.col("nwd") + F.col("k")).otherwise(F.col("n")).cast("bigint").alias("nc"), F.coalesce("mod", F.lit(0)).alias("mod"))
