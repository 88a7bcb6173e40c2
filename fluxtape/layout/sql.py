"""SQL text built by operators and functions, for expressions of many parts: Spark parses them once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

_names = count()


def restart() -> None:
    """Count lambda variables from 0 again, so that an expression's text is always the same."""
    global _names
    _names = count()


class Text:
    """An expression as SQL."""

    __slots__ = ("base", "more", "sql")

    def __init__(self, sql: str, base: str | None = None, more: int = 0):
        self.sql, self.base, self.more = sql, sql if base is None else base, more  # ``more`` is a whole number that was added to ``base``

    def _with(self, op: str, other) -> Text:
        return Text(f"({self.sql} {op} {lit(other).sql})")

    def _plus(self, n: int) -> Text:
        if self.base.isdigit():
            return Text(str(int(self.base) + self.more + n))
        more = self.more + n
        return Text(f"({self.base} {'+' if more >= 0 else '-'} {abs(more)})", self.base, more) if more else Text(self.base)

    def __add__(self, other):
        if isinstance(other, Text) and other.sql.isdigit():
            other = int(other.sql)
        if isinstance(other, int):
            return self._plus(other)
        return other._plus(int(self.sql)) if self.sql.isdigit() else self._with("+", other)

    def __radd__(self, other):
        return lit(other) + self

    def __sub__(self, other):
        return self._with("-", other)

    def __mul__(self, other):
        return self._with("*", other)

    def __rmul__(self, other):
        return Text(str(other * int(self.sql))) if self.sql.isdigit() else lit(other)._with("*", self)

    def __truediv__(self, other):
        return Text(f"try_divide({self.sql}, {lit(other).sql})")

    def __neg__(self):
        return Text(f"(- {self.sql})")

    def __lt__(self, other):
        return self._with("<", other)

    def __le__(self, other):
        return self._with("<=", other)

    def __gt__(self, other):
        return self._with(">", other)

    def __ge__(self, other):
        return self._with(">=", other)

    def __and__(self, other):
        return self._with("AND", other)

    def __or__(self, other):
        return self._with("OR", other)

    def __invert__(self):
        return Text(f"(NOT {self.sql})")

    def __getitem__(self, name: str) -> Text:
        return Text(f"{self.sql}.{name}")

    def equals(self, other) -> Text:
        return self._with("=", other)

    def differs(self, other) -> Text:
        return self._with("<>", other)

    def is_null(self) -> Text:
        return Text(f"({self.sql} IS NULL)")

    def cast(self, kind: str) -> Text:
        return Text(f"CAST({self.sql} AS {kind})")

    def named(self, name: str) -> Text:
        return Text(f"{self.sql} AS {name}")


def lit(value) -> Text:
    """A value as SQL; an expression is itself."""
    if isinstance(value, Text):
        return value
    if value is None:
        return Text("NULL")
    if isinstance(value, bool):
        return Text(str(value).lower())
    if isinstance(value, str):
        return Text("'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'")
    return Text(f"{value!r}D" if isinstance(value, float) else f"({value})" if value < 0 else str(value))


def call(name: str, *given) -> Text:
    return Text(f"{name}({', '.join(lit(x).sql for x in given)})")


def when(*pairs: tuple[Text | None, Text], otherwise=None) -> Text:
    """The first value whose condition holds; a condition of None always does."""
    parts = [f"WHEN {c.sql} THEN {lit(v).sql}" for c, v in pairs if c is not None]
    last = next((v for c, v in pairs if c is None), otherwise)
    return Text(f"CASE {' '.join(parts)} ELSE {lit(last).sql} END") if parts else lit(last)


def lamb(arity: int, body: Callable[..., Text]) -> Text:
    names = [f"x{next(_names)}" for _ in range(arity)]
    return Text(f"{names[0] if arity == 1 else '(' + ', '.join(names) + ')'} -> {body(*map(Text, names)).sql}")


def transform(array: Text, body: Callable[..., Text], arity: int = 1) -> Text:
    return call("transform", array, lamb(arity, body))


def select(array: Text, body: Callable[..., Text], arity: int = 1) -> Text:
    return call("filter", array, lamb(arity, body))


def exists(array: Text, body: Callable[[Text], Text]) -> Text:
    return call("exists", array, lamb(1, body))


def fold(array: Text, start: Text, body: Callable[[Text, Text], Text]) -> Text:
    return call("aggregate", array, start, lamb(2, body))


def struct(**fields: Text) -> Text:
    return Text("named_struct(" + ", ".join(f"'{k}', {lit(v).sql}" for k, v in fields.items()) + ")")


def whole(field: Text) -> Text:
    """A field as a whole number: blank is 0, and what is none is null."""
    bare = call("trim", field)
    return when((bare.equals(""), Text("0L")), (Text(f"{bare.sql} RLIKE '^[+-]?[0-9]+$'"), Text(f"try_cast({bare.sql} AS bigint)")), otherwise=Text("CAST(NULL AS bigint)"))


def counted(start: Text, stop: Text) -> Text:
    """The whole numbers from start to stop; none if start is larger."""
    return when((stop < start, Text("CAST(array() AS array<int>)")), otherwise=call("sequence", start, call("greatest", start, stop)))
