import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxtape.functions import fields as fd


@pytest.mark.parametrize("value, text", [(1.0, " 1.000000+0"), (-2.0000015e15, "-2.00000+15"), (9.9999999e-10, " 1.000000-9"), (0.0, " 0.000000+0"), (1e-100, " 1.0000-100")])
def test_exponent_form(value, text):
    assert fd.exponent_form(value) == text


def test_written_numbers_fit_and_come_back():
    random.seed(3)
    for _ in range(3000):
        x = random.uniform(-10, 10) * 10.0 ** random.randint(-12, 12)
        for options in ({}, {"keep_e": True}, {"abuse_signpos": True}, {"prefer_noexp": True}, {"prefer_noexp": True, "skip_intzero": True}):
            text = fd.write_float(x, **options)
            assert len(text) == 11
            assert fd.read_float(text) == pytest.approx(x, rel=2e-4)


def test_columns_read_like_the_scalar_functions(spark):
    texts = [" 1.23+4", "1.5d", "", "  ", "-.5E-3", "1 2.5", "+7", "nan", "1.e5", "9.99-310"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fd.fort_float(F.col("t")).alias("v")).collect()
    for row in rows:
        try:
            want = None if row.t == "nan" else fd.read_float(row.t)
        except ValueError:
            want = None
        assert row.v == want, row.t


def test_ints_and_empty_range(spark):
    row = spark.range(1).select(fd.fort_int(F.lit("  ")).alias("a"), fd.fort_int(F.lit("12345678901")).alias("b"), fd.fort_int(F.lit("1x")).alias("c"), fd.counted(F.lit(1), F.lit(0)).alias("d"), fd.floor_mod(F.lit(-7), F.lit(3)).alias("e")).first()
    assert tuple(row) == (0, 12345678901, None, [], 2)


def _sweep() -> np.ndarray:
    rng = np.random.default_rng(3)
    tens = 10.0 ** np.arange(-25, 25)
    return np.concatenate([
        rng.uniform(-1e5, 1e5, 500).round(2), rng.uniform(0, 1, 300), 10.0 ** rng.uniform(-30, 30, 800) * rng.choice([-1, 1], 800),
        (rng.integers(0, 10**8, 500) + 0.5) / 10.0 ** rng.integers(0, 8, 500), tens, tens * (1 - 1e-12), np.nextafter(tens, 0),
        [0.0, -0.0, 9.9999999e9, 9.99996e-10, 99999999.96, 0.99999999999, 1e-300, 1e300, 1234567.5, 123456789012.0],
    ])


@pytest.mark.parametrize("options", list(itertools.product([False, True], repeat=4)))
def test_arrays_are_written_like_single_numbers(options):
    """All combinations of options: the array way equals the one-by-one way, fits, and reads back closely."""
    named = dict(zip(("prefer_noexp", "keep_e", "abuse_signpos", "skip_intzero"), options))
    values = _sweep()
    fields = fd.write_floats(values, **named).to_pylist()
    assert fields == [fd.write_float(float(v), **named) for v in values]
    assert {len(f) for f in fields} == {11}
    back = np.array([fd.read_float(f) for f in fields])
    assert (np.abs(back - values) <= 5.1e-5 * np.abs(values)).all()


def test_rendering_is_the_longest_that_fits():
    assert fd.write_float(9.9999999e9) == " 1.00000+10"
    assert fd.write_float(9.9999999e-10) == " 1.000000-9"
    assert fd.write_float(0.123456789123, prefer_noexp=True) == " 0.12345679"
    assert fd.write_float(0.123456789123, prefer_noexp=True, skip_intzero=True) == " .123456789"
    assert fd.write_float(0.123456789123, prefer_noexp=True, skip_intzero=True, abuse_signpos=True) == ".1234567891"
    assert fd.write_float(-12345678.96, prefer_noexp=True) == "-12345679.0".replace(".0", "").rjust(11)


def test_what_is_not_finite_gives_null():
    assert fd.write_floats(np.array([1.0, np.nan, np.inf])).to_pylist() == [" 1.000000+0", None, None]


def test_whole_digits_of_large_numbers_are_exact():
    assert fd.plain_form(1.7e308) == " " + str(int(1.7e308))
    assert fd.plain_form(-(2.0**100)) == str(-(2**100))


def test_many_numbers_are_written_in_little_memory():
    """A batch of long arrays is some million numbers."""
    import tracemalloc

    values = np.arange(1.0, 600_001.0) / 7
    tracemalloc.start()
    try:
        made = fd.write_floats(values, prefer_noexp=True)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(made) == len(values) and peak < 60e6, peak
    some = [0, 1, fd.TURN - 1, fd.TURN, fd.TURN + 1, len(values) - 1]
    assert [made[i].as_py() for i in some] == [fd.write_float(values[i], prefer_noexp=True) for i in some]
    assert len(fd.write_floats(np.array([]))) == 0


def test_whole_numbers_are_written_as_their_digits():
    values = [s * (10**k + d) for k in range(17) for d in (-1, 0, 1, 3) for s in (1, -1)] + [0.0, -0.0, 0.5, 12.25, 1e300, float("nan"), float("inf")]
    for options in ({}, {"width": 8}, {"width": 15}, {"width": 4}, {"abuse_signpos": True}, {"skip_intzero": True}, {"keep_e": True}):
        got = fd.write_floats(np.array(values, float), prefer_noexp=True, **options).to_pylist()
        assert got == [fd.write_float(float(v), prefer_noexp=True, **options) if np.isfinite(v) else None for v in values], options
