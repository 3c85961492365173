"""Fourier transforms of whole series, and what is made with them: analytic signals, envelopes, resampling.

Series of up to ``WHOLE`` samples are transformed in one task.  A longer one goes through two passes that are shuffles:
with n = n1 n2, sample r + n1 c goes to line r, lines are transformed over c and turned by exp(-2 pi i r q / n), and
value q of every line goes to column q, which is transformed over r and gives the frequencies n2 p + q.  A task holds a
line of about sqrt(n) samples.  A length without a fitting divisor (a prime, say) is a convolution with a chirp, whose
length can be chosen: a power of two.  All of it is exact but for rounding.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.operators.blocks import by_group, numbered, per_series, starts, types_of
from voltlake.storage import written

#: Samples of a series that one task transforms at once, and of the longest line of a longer series.
WHOLE = 1 << 20
#: Numbers that one row is exploded to at once.
_STRETCH = 1 << 14
VALUES = "n long, k long, re double, im double"


@lru_cache(maxsize=4096)
def lines(n: int) -> int:
    """The largest divisor of n that is at most its root."""
    return next(d for d in range(math.isqrt(n), 0, -1) if n % d == 0) if n > 0 else 1


def _lines_of(longest: int) -> Callable[[Column], Column]:
    """lines(n), or 0 where that leaves lines of more than ``longest``."""

    @F.pandas_udf("long")
    def f(n: pd.Series) -> pd.Series:
        known = {v: lines(int(v)) if v // lines(int(v)) <= longest else 0 for v in n.unique()}
        return n.map(known)

    return f


def _transformed(rows: DataFrame, group: Sequence[str], place: Column, length: Column, turn: bool) -> DataFrame:
    """Each group's values at their places (absent ones 0) through an FFT of its length: (group, n, _at, re, im).

    turn: then value q is turned by exp(-2 pi i r q / n), r being the last of the group's columns.
    """
    names = list(group)

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        cut = starts(pdf, names)
        size = pdf["_length"].to_numpy()[cut[:-1]]
        of = np.repeat(np.arange(len(size)), np.diff(cut))
        z, at = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy(), pdf["_place"].to_numpy()
        parts, order = [], []
        for length in np.unique(size):
            mine = np.flatnonzero(size == length)
            number = np.full(len(size), -1)
            number[mine] = np.arange(len(mine))
            here = number[of] >= 0
            grid = np.zeros((len(mine), length), complex)
            grid[number[of[here]], at[here]] = z[here]
            grid = np.fft.fft(grid, axis=1)
            if turn:
                head = pdf.iloc[cut[:-1][mine]]
                r, n = head[names[-1]].to_numpy()[:, None], head["n"].to_numpy()[:, None]
                grid *= np.exp(-2j * np.pi * (r * np.arange(length)[None, :] / n))
            parts.append(grid.ravel())
            order.append(np.repeat(mine, length))
        flat, owner = np.concatenate(parts), np.concatenate(order)
        out = pdf[[*names, "n"]].iloc[cut[:-1][owner]].reset_index(drop=True)
        q = np.concatenate([np.tile(np.arange(length), int((size == length).sum())) for length in np.unique(size)])
        return out.assign(_at=q, re=flat.real, im=flat.imag)

    rows = rows.select(*names, "n", place.alias("_place"), length.alias("_length"), "re", "im")
    return rows.repartition(*names).sortWithinPartitions(*names).mapInPandas(by_group(names, done), f"{types_of(rows, names)}, n long, _at long, re double, im double")


def _two_passes(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with _n1, a divisor of n."""
    at = rows.withColumn("_r", F.col("k") % F.col("_n1"))
    first = _transformed(at, [*names, "_n1", "_r"], F.floor(F.col("k") / F.col("_n1")), F.floor(F.col("n") / F.col("_n1")), turn=True)
    columns = first.withColumnRenamed("_at", "_q")
    second = _transformed(columns, [*names, "_n1", "_q"], F.col("_r"), F.col("_n1"), turn=False)
    return second.select(*names, "n", (F.floor(F.col("n") / F.col("_n1")) * F.col("_at") + F.col("_q")).alias("k"), "re", "im")


def _times(rows: DataFrame, re: Column, im: Column) -> DataFrame:
    return rows.withColumns({"re": F.col("re") * re - F.col("im") * im, "im": F.col("re") * im + F.col("im") * re})


def _by_chirp(rows: DataFrame, names: list[str]) -> DataFrame:
    """X[k] = w[k] sum over t of (x[t] w[t]) / w[k - t] with w[t] = exp(-pi i t^2 / n): the sum is a convolution of a chosen length."""

    def angle(t: Column, n: Column) -> Column:
        return math.pi * F.pmod(t * t, 2 * n) / n

    n, k = F.col("n"), F.col("k")
    size = F.expr("shiftleft(1L, length(bin(2 * n - 2)))")
    sent = _times(rows, F.cos(angle(k, n)), -F.sin(angle(k, n))).withColumn("_of", n).withColumn("n", size).drop("_n1")
    own = [*names, "_of"]
    lengths = rows.select(n.alias("_of"), size.alias("n")).distinct()
    stretches = lengths.withColumn("_stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_of") - 1) / _STRETCH)))).repartition("_of", "_stretch")
    first = F.col("_stretch") * _STRETCH
    numbers = stretches.withColumn("m", F.explode(F.sequence(first, F.least(first + _STRETCH, F.col("_of")) - 1)))
    places = F.array_distinct(F.array(F.col("m"), F.pmod(-F.col("m"), F.col("n"))))
    kernel = numbers.select("_of", "n", F.explode(places).alias("k"), F.cos(angle(F.col("m"), F.col("_of"))).alias("re"), F.sin(angle(F.col("m"), F.col("_of"))).alias("im"))
    a = _two_passes(sent.withColumn("_n1", _power_lines(F.col("n"))), own)
    b = _two_passes(kernel.withColumn("_n1", _power_lines(F.col("n"))), ["_of"]).select("_of", "k", F.col("re").alias("_b_re"), F.col("im").alias("_b_im"))
    product = _times(a.join(b, ["_of", "k"]), F.col("_b_re"), F.col("_b_im")).drop("_b_re", "_b_im")
    back = _two_passes(product.withColumn("im", -F.col("im")).withColumn("_n1", _power_lines(F.col("n"))), own).where("k < _of")
    back = back.withColumns({"re": F.col("re") / F.col("n"), "im": -F.col("im") / F.col("n"), "n": F.col("_of")}).drop("_of")
    return _times(back, F.cos(angle(k, n)), -F.sin(angle(k, n))).select(*names, "n", "k", "re", "im")


def _power_lines(n: Column) -> Column:
    """For a power of two: the power of two at most at its root."""
    return F.expr("shiftleft(1L, cast((length(bin(n)) - 1) div 2 as int))")


def dft(rows: DataFrame, keys: Sequence[str] = ("recording",), inverse: bool = False, whole: int = WHOLE, longest: int | None = None) -> DataFrame:
    """(keys, n, k, re, im) -> the same, transformed: n is a series' length, k runs from 0, values that are absent are 0.

    The inverse divides by n.  longest: a bound on n where it is known; else one aggregate finds it.  Where series are
    longer than ``whole`` the input is written to the shared folder first.
    """
    names = list(keys)
    rows = rows.select(*names, *(F.col(c).cast(t).alias(c) for c, t in (f.split() for f in VALUES.split(", "))))
    rows = rows.withColumn("im", -F.col("im")) if inverse else rows
    longest = rows.agg(F.max("n")).first()[0] or 0 if longest is None else longest
    if longest > whole:
        rows = written(rows, "values").withColumn("_n1", _lines_of(whole)(F.col("n")))
        long = F.col("n") > whole
        parts = {k: rows.where(w) for k, w in (("whole", ~long), ("even", long & (F.col("_n1") > 0)), ("rough", long & (F.col("_n1") == 0)))}
        there = rows.select("n", "_n1").distinct().agg(*[F.max(w).alias(k) for k, w in (("whole", ~long), ("even", long & (F.col("_n1") > 0)), ("rough", long & (F.col("_n1") == 0)))]).first()
    else:
        parts, there = {"whole": rows}, {"whole": True, "even": False, "rough": False}
    made = [f(parts[k]) for k, f in (("whole", lambda r: _in_a_task(r, names)), ("even", lambda r: _two_passes(r, names)), ("rough", lambda r: _by_chirp(r, names))) if there[k]]
    out = made[0] if made else _in_a_task(rows, names)
    for more in made[1:]:
        out = out.unionByName(more)
    return out.withColumns({"re": F.col("re") / F.col("n"), "im": -F.col("im") / F.col("n")}) if inverse else out


def _in_a_task(rows: DataFrame, names: list[str]) -> DataFrame:
    return _transformed(rows, names, F.col("k"), F.col("n"), turn=False).withColumnRenamed("_at", "k")


def by_length(signal: DataFrame, keys: Sequence[str], whole: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of series of up to ``whole`` samples, and those of longer ones (None: there are none; one aggregate tells)."""
    names = list(keys)
    big = signal.groupBy(*[F.col(k).alias(f"_{k}") for k in names]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > whole)
    if big.isEmpty():
        return signal, None
    big, same = written(big, "long"), F.lit(True)
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return signal.join(big, same, "left_anti"), written(signal.join(big, same, "left_semi"), "long")


def _real(signal: DataFrame, keys: Sequence[str]) -> DataFrame:
    return numbered(signal, keys, count=True).select(*keys, F.col("_n").alias("n"), F.col("t").alias("k"), F.col("x").alias("re"), F.lit(0.0).alias("im"))


def analytic_rows(signal: DataFrame, keys: Sequence[str] = ("recording",), whole: int = WHOLE) -> DataFrame:
    """(keys, t, re, im): the analytic signal, the frequencies below 0 left out and those above 0 doubled."""
    rows = _real(signal, keys)
    longest = rows.agg(F.max("n")).first()[0] or 0
    gain = F.when((F.col("k") == 0) | (2 * F.col("k") == F.col("n")), 1.0).otherwise(2.0)
    kept = dft(rows, keys, whole=whole, longest=longest).where(2 * F.col("k") <= F.col("n")).withColumns({"re": F.col("re") * gain, "im": F.col("im") * gain})
    return dft(kept, keys, inverse=True, whole=whole, longest=longest).select(*keys, F.col("k").alias("t"), "re", "im")


def envelope_rows(signal: DataFrame, keys: Sequence[str] = ("recording",), whole: int = WHOLE) -> DataFrame:
    """(keys, t, x): the analytic signal's magnitude."""
    return analytic_rows(signal, keys, whole).select(*keys, "t", F.hypot("re", "im").alias("x"))


def fourier_resampled(signal: DataFrame, new: float, old: float, keys: Sequence[str] = ("recording",), whole: int = WHOLE) -> DataFrame:
    """(keys, t, x): each series at another rate, its spectrum cut or continued by zeros; length round(n new / old)."""
    from voltlake.operators.filters import fft_resample

    if abs(new - old) < 1e-6:
        return numbered(signal, keys)
    short, long = by_length(signal, keys, whole)
    out = per_series(short, lambda x: fft_resample(x, new, old), keys)
    if long is None:
        return out
    m = F.bround(F.col("n") * F.lit(new) / F.lit(old)).cast("long")
    rows = _real(long, keys)
    longest = rows.agg(F.max("n")).first()[0]
    kept = dft(rows, keys, whole=whole, longest=longest).withColumn("_m", m).where((2 * F.col("k") <= F.col("n")) & (2 * F.col("k") <= F.col("_m")))
    gain = F.when((F.col("k") == 0) | (2 * F.col("k") == F.col("_m")), 1.0).otherwise(2.0) * F.col("_m") / F.col("n")
    kept = kept.withColumns({"re": F.col("re") * gain, "im": F.col("im") * gain, "n": F.col("_m")}).where("n > 0")
    back = dft(kept, keys, inverse=True, whole=whole, longest=math.ceil(longest * new / old))
    return out.unionByName(back.select(*keys, F.col("k").alias("t"), F.col("re").alias("x")))
