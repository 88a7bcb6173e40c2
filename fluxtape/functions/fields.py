"""Fixed-width number and text fields, read as Column expressions and written by Arrow functions.

Reading stays in generated JVM code.  Writing a number needs the rounding of its exact
binary value, which the JVM's formatter does not do, so that part is an Arrow function.
It works on whole arrays: a number is scaled by a power of ten and rounded to a whole
number, whose digits are laid out as bytes.  Only numbers whose scaled value lies next
to a tie, or is out of reach of exact powers of ten, are formatted one by one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 11
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def fort_int(text: Column) -> Column:
    """Blank is 0, a whole number is itself, anything else is null."""
    bare = F.trim(text)
    return F.when(bare == "", F.lit(0).cast("bigint")).otherwise(bare.try_cast("bigint"))


def fort_float(text: Column, accept_spaces: bool = True) -> Column:
    """Blank is 0.0; the exponent's letter may be missing; bad text is null."""
    bare = F.replace(text, F.lit(" "), F.lit("")) if accept_spaces else F.trim(text)
    full = F.regexp_replace(bare, r"(?<=[0-9.])([+-])", "E$1")
    return F.when(bare == "", F.lit(0.0)).when(full.rlike(_NUMBER), full.try_cast("double"))


def read_float(text: str, accept_spaces: bool = True) -> float:
    """The same for one string; raises ValueError for bad text."""
    bare = text.replace(" ", "") if accept_spaces else text.strip()
    if not bare:
        return 0.0
    cut = max(bare.rfind("+"), bare.rfind("-"))
    if cut > 0 and bare[cut - 1] not in "eE":
        bare = f"{bare[:cut]}E{bare[cut:]}"
    return float(bare)


def read_int(text: str) -> int:
    return int(text) if text.strip() else 0


# -- writing one number: the longest rendering that fits its room


def _room(value: float, width: int, abuse_signpos: bool) -> int:
    """Columns for digits: the first one is a sign's, which a number without one may only use if told so."""
    return width if abuse_signpos and not np.signbit(value) else width - 1


def exponent_form(value: float, width: int = WIDTH, keep_e: bool = False, abuse_signpos: bool = False) -> str:
    """Scientific notation with the most digits that fit; the exponent has a sign and no leading zeros."""
    room = _room(value, width, abuse_signpos)
    for digits in range(max(room - 3 - keep_e, 1), 0, -1):  # a point and an exponent of two characters go with more than one digit
        mantissa, _, power = f"{abs(value):.{digits - 1}e}".partition("e")
        tail = f"{'e' if keep_e else ''}{int(power):+d}"
        if len(mantissa) + len(tail) <= room or digits == 1:
            break
    return f"{'-' if np.signbit(value) else ''}{mantissa}{tail}".rjust(width)


def plain_form(value: float, width: int = WIDTH, abuse_signpos: bool = False, skip_intzero: bool = False) -> str:
    """Decimal notation with the most decimals that fit, without trailing zeros; longer than the field if its whole part is."""
    room = _room(value, width, abuse_signpos)
    x = abs(value)
    bare = skip_intzero and x < 1
    ahead = 0 if bare else len(str(int(x)))
    body = f"{x:.{max(room - ahead - 1, 0)}f}"  # rounded from the exact value, ties to even
    if "." in body:
        body = body.rstrip("0").rstrip(".")
    if bare and len(body) > 1:
        body = body.removeprefix("0")
    minus = "-" if value < 0 and body != "0" else ""
    return (minus + body).rjust(len(body) + width - room).rjust(width)


def write_float(value: float, width: int = WIDTH, prefer_noexp: bool = False, keep_e: bool = False, abuse_signpos: bool = False, skip_intzero: bool = False) -> str:
    """Exponent form, or decimal notation where that is preferred, fits, and is no less exact."""
    plain = plain_form(value, width, abuse_signpos, skip_intzero) if prefer_noexp else ""
    if prefer_noexp and len(plain) <= width and read_float(plain) == value:
        return plain
    short = exponent_form(value, width, keep_e, abuse_signpos)
    if not prefer_noexp:
        return short
    if len(plain) > width or abs(read_float(short) - value) < abs(read_float(plain) - value):
        return short
    return plain


# -- writing arrays of numbers

_TENS = 10.0 ** np.arange(23)  # exact as doubles
_WHOLE = 10 ** np.arange(19, dtype=np.int64)


def _scaled(x: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x * 10**power rounded to whole numbers, and where that is certain to be the exact value's rounding."""
    reach = np.abs(power) <= 22
    p = np.clip(power, -22, 22)
    made = np.where(p >= 0, x * _TENS[np.maximum(p, 0)], x / _TENS[np.maximum(-p, 0)])
    sure = reach & (made < 1e12)
    low = np.floor(np.where(sure, made, 0.0))
    rest = made - low
    sure &= np.abs(rest - 0.5) > 1e-3  # products are off by under 2**-12 below 10**12
    return np.where(sure, low + (rest > 0.5), 0).astype(np.int64), sure


def _lay(out: np.ndarray, rows: np.ndarray, numbers: np.ndarray, count: int, at: int) -> None:
    """Write ``count`` digits of the numbers into columns from ``at`` of the rows."""
    out[rows[:, None], np.arange(at, at + count)] = (numbers[:, None] // _WHOLE[count - 1 :: -1][:count]) % 10 + 48


def _kinds(*columns: np.ndarray):
    """Places of each distinct combination of small whole numbers."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        code = code * 64 + c
    order = np.argsort(code, kind="stable")
    cut = np.flatnonzero(np.diff(code[order], prepend=-1))
    for lo, hi in zip(cut, [*cut[1:], len(order)]):
        yield order[lo:hi]


def _exponent_digits(x: np.ndarray, room: np.ndarray, keep_e: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole number of the digits, their count and the exponent of each x > 0; and where all is certain."""
    base = np.floor(np.log10(x)).astype(np.int64)
    near = np.clip(base, -22, 22)
    over = np.where(near >= 0, x >= _TENS[np.minimum(near + 1, 22)], x * _TENS[np.maximum(-near - 1, 0)] >= 1) & (np.abs(base) < 22)
    under = np.where(near >= 0, x < _TENS[np.maximum(near, 0)], x * _TENS[np.maximum(-near, 0)] < 1) & (np.abs(base) < 22)
    base = base + over - under
    whole, count, power, sure = (np.zeros(len(x), np.int64) for _ in range(4))
    left = np.arange(len(x))
    for digits in range(int(room.max()) - 3 - keep_e, 0, -1):
        m, ok = _scaled(x[left], digits - 1 - base[left])
        carried = m >= _WHOLE[digits]
        e = base[left] + carried
        size = digits + (digits > 1) + keep_e + 1 + np.maximum(np.floor(np.log10(np.maximum(np.abs(e), 1))).astype(np.int64) + 1, 1)
        done = (size <= room[left]) | (digits == 1) | ~ok
        here = left[done]
        whole[here], count[here], power[here], sure[here] = np.where(carried, _WHOLE[digits - 1], m)[done], digits, e[done], ok[done]
        left = left[~done]
        if not len(left):
            break
    sure[np.abs(base) > 20] = 0
    return whole, count, power, sure.astype(bool)


#: Numbers that are written at a time; each takes about 350 bytes meanwhile.
TURN = 1 << 16


def write_floats(values: np.ndarray, width: int = WIDTH, **options) -> pa.Array:
    """:func:`write_float` of each value; what is not finite gives null."""
    values = np.asarray(values, np.float64)
    return pa.concat_arrays([_written(values[k : k + TURN], width, **options) for k in range(0, max(len(values), 1), TURN)])


def _lay_whole(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Write whole numbers that fit, other than 0, at the right of the rows."""
    made, left, at = np.full((len(rows), out.shape[1]), 32, np.uint8), np.abs(values).astype(np.int64), out.shape[1]
    signs = np.flatnonzero(values < 0)
    while (more := left > 0).any():
        at -= 1
        rest = left // 10
        made[:, at] = np.where(more, left - rest * 10 + 48, 32)
        left = rest
    if len(signs):
        made[signs, out.shape[1] - 1 - (made[signs] != 32).sum(axis=1)] = 45
    out[rows] = made


def _written(values: np.ndarray, width: int, prefer_noexp: bool = False, keep_e: bool = False, abuse_signpos: bool = False, skip_intzero: bool = False) -> pa.Array:
    options = {"prefer_noexp": prefer_noexp, "keep_e": keep_e, "abuse_signpos": abuse_signpos, "skip_intzero": skip_intzero}
    finite = np.isfinite(values)
    out = np.full((len(values), width), 32, np.uint8)
    slow = finite & (values == 0) if 6 <= width <= 15 else finite
    easy = np.zeros(len(values), bool)
    if prefer_noexp and 6 <= width <= 15:  # most numbers that are whole have their digits alone
        easy = finite & ~slow & (np.abs(values) < _TENS[width - 1]) & (np.floor(values) == values)
        _lay_whole(out, np.flatnonzero(easy), values[easy])
    todo = np.flatnonzero(finite & ~slow & ~easy)
    if len(todo):
        v = values[todo]
        x, minus = np.abs(v), v < 0
        room = np.where(abuse_signpos & ~minus, width, width - 1)
        whole, count, power, sure = _exponent_digits(x, room, keep_e)
        plain = np.zeros(len(x), bool)
        if prefer_noexp:
            ahead = np.where((x < 1) & skip_intzero, 0, np.maximum(np.floor(np.log10(np.maximum(x, 1))).astype(np.int64) + 1, 1))
            ahead = np.where(x >= 1, np.searchsorted(_WHOLE[1:], np.minimum(x, 9e17).astype(np.int64), side="right") + 1, ahead)
            decimals = np.maximum(room - ahead - 1, 0)
            q, ok = _scaled(x, decimals)
            sure &= ok | (x >= _TENS[12])
            far_plain = np.abs(q / _TENS[np.minimum(decimals, 22)] - x)
            shift = np.clip(power - count + 1, -22, 22)
            short = np.where(shift >= 0, whole * _TENS[np.maximum(shift, 0)], whole / _TENS[np.maximum(-shift, 0)])
            left = np.flatnonzero(decimals > 0)
            while len(left):
                left = left[(decimals[left] > 0) & (q[left] % 10 == 0)]
                q[left] //= 10
                decimals[left] -= 1
            tail = q % _WHOLE[decimals]
            front = q // _WHOLE[decimals]
            digits = np.searchsorted(_WHOLE[1:], front, side="right") + 1
            digits[(front == 0) & (skip_intzero & (x < 1)) & (decimals > 0)] = 0
            plain = sure & (x < _TENS[12]) & (digits + decimals + (decimals > 0) <= room) & (far_plain <= np.abs(short - x))
            for k in _kinds(digits[plain], decimals[plain]):
                rows = np.flatnonzero(plain)[k]
                d, f = int(digits[rows[0]]), int(decimals[rows[0]])
                start = width - d - f - (f > 0)
                if d:
                    _lay(out, todo[rows], front[rows], d, start)
                if f:
                    out[todo[rows], start + d] = 46
                    _lay(out, todo[rows], tail[rows], f, start + d + 1)
                signed = rows[minus[rows] & (q[rows] > 0)]
                out[todo[signed], start - 1] = 45
        use = np.flatnonzero(sure & ~plain)
        places = np.floor(np.log10(np.maximum(np.abs(power), 1))).astype(np.int64) + 1
        for k in _kinds(count[use], places[use]):
            rows = use[k]
            c, p = int(count[rows[0]]), int(places[rows[0]])
            start = width - p - 1 - keep_e - c - (c > 1)
            _lay(out, todo[rows], whole[rows] // _WHOLE[c - 1], 1, start)
            if c > 1:
                out[todo[rows], start + 1] = 46
                _lay(out, todo[rows], whole[rows] % _WHOLE[c - 1], c - 1, start + 2)
            if keep_e:
                out[todo[rows], width - p - 2] = 101
            out[todo[rows], width - p - 1] = np.where(power[rows] < 0, 45, 43)
            _lay(out, todo[rows], np.abs(power[rows]), p, width - p)
            signed = rows[minus[rows]]
            out[todo[signed], start - 1] = 45
        slow[todo[~sure]] = True
    made = out.view(f"S{width}").ravel()
    one_by_one = np.flatnonzero(slow)
    if len(one_by_one):
        texts = {x: write_float(x, width, **options) for x in set(values[one_by_one].tolist())}
        texts[0.0] = write_float(0.0, width, **options)
        wide = np.array([len(t) for t in texts.values()]).max()
        if wide > width or (np.signbit(values[one_by_one]) & (values[one_by_one] == 0)).any():  # a field may overflow; a zero may have a sign
            strings = [t.decode() for t in made.tolist()]
            for i in one_by_one:
                strings[i] = write_float(float(values[i]), width, **options)
            return pa.array(strings, pa.string(), mask=~finite)
        made[one_by_one] = [texts[x].encode() for x in values[one_by_one].tolist()]
    offsets = np.arange(len(values) + 1, dtype=np.int32) * width
    text = pa.StringArray.from_buffers(len(values), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(made)))
    return text if finite.all() else pa.compute.if_else(pa.array(finite), text, pa.scalar(None, pa.string()))


def float_field(value: Column, **options) -> Column:
    """A number as a field; null and what is not finite give null."""

    @F.arrow_udf(T.StringType())
    def render(values: pa.Array) -> pa.Array:
        return write_floats(values.to_numpy(zero_copy_only=False), **options)

    return render(value.cast("double"))


def float_fields(values: Column, **options) -> Column:
    """Each number of an array as a field."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def render(rows: pa.Array) -> pa.Array:
        fields = write_floats(rows.flatten().to_numpy(zero_copy_only=False), **options)
        sizes = pa.compute.fill_null(pa.compute.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        return pa.ListArray.from_arrays(offsets, fields, mask=rows.is_null() if rows.null_count else None)

    return render(values.cast("array<double>"))


def int_field(value: Column, width: int = WIDTH) -> Column:
    return F.lpad(value.cast("bigint").cast("string"), width, " ")


def is_close(x: Column, y: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether x is within atol + rtol * abs(y) of y; the second operand sets the scale."""
    return F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)


def all_close(xs: Column, ys: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return (F.size(xs) == F.size(ys)) & F.forall(F.arrays_zip(xs.alias("x"), ys.alias("y")), lambda p: is_close(p["x"], p["y"], rtol, atol))


def vector_op(xs: Column, ys: Column, op) -> Column:
    """``op`` on each pair of two arrays; arrays of different lengths are an error."""
    wrong = F.raise_error(F.lit("vectors of different lengths"))
    return F.when(F.size(xs) == F.size(ys), F.zip_with(xs, ys, op)).otherwise(F.when(xs.isNotNull() & ys.isNotNull(), wrong))


def scalar_op(xs: Column, y: Column, op) -> Column:
    """``op`` on each element of an array and one number."""
    return F.transform(xs, lambda x: op(x, y))


def exact_div(x: Column, y: Column) -> Column:
    """Quotient of whole numbers; an error where it leaves a rest."""
    return F.when(floor_mod(x, y) == 0, F.call_function("div", x, y)).otherwise(F.raise_error(F.concat(x.cast("string"), F.lit(" / "), y.cast("string"), F.lit(" is not whole"))).cast("bigint"))


def try_exact_div(x: Column, y: Column) -> Column:
    """The same, null where it leaves a rest or divides by zero."""
    return F.when((y != 0) & (x % y == 0), F.call_function("div", x, F.when(y != 0, y)))


def floor_mod(x: Column, y: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return ((x % y) + y) % y


def counted(start: Column, stop: Column) -> Column:
    """The whole numbers from start to stop; none if start is larger."""
    return F.when(stop < start, F.array().cast("array<int>")).otherwise(F.sequence(start.cast("int"), F.greatest(start, stop).cast("int")))
