"""Recursive (IIR) filters without a loop over samples and without a task that holds a long series.

A filter is a linear system: state' = A state + B x, y = C state + D x.  Over any stretch of samples the state at its end
is an affine map of the state at its start, and such maps compose.  In a worker a stretch is cut into spans whose
zero-state responses are one matrix product, and the spans' states come from a scan of doubling steps.  Over a long
series the same is done with blocks: each block gives its own part of the end state, forward and backward, one small row
a block is scanned in order, and each block then runs from its exact state.  Nothing is cut off and nothing overlaps.

The backward run of a block starts from a state that depends on the forward state before the block as well:
u' = A^n u + sum_k A^k B y_k, and y_k holds C A^k s; so M_n = sum_k A^k B C A^k, found by doubling like A^n.
"""

from __future__ import annotations

import cmath
import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.operators.blocks import BLOCK, by_group, numbered, per_series, starts, types_of

#: Samples of a span inside a worker.
SPAN = 64
Section = tuple[float, float, float, float, float]


def butterworth(order: int, cut: float, rate: float, high: bool = False) -> list[Section]:
    """Second-order sections (b0, b1, b2, a1, a2) of a Butterworth low- or high-pass, by the bilinear transform."""
    w = math.tan(math.pi * cut / rate)
    sections: list[Section] = []
    for k in range(order // 2):
        q = 2 * math.sin(math.pi * (2 * k + 1) / (2 * order))
        a0 = 1 + q * w + w * w
        b = (1 / a0, -2 / a0, 1 / a0) if high else (w * w / a0, 2 * w * w / a0, w * w / a0)
        sections.append((*b, 2 * (w * w - 1) / a0, (1 - q * w + w * w) / a0))
    if order % 2:
        a0 = 1 + w
        b = (1 / a0, -1 / a0, 0.0) if high else (w / a0, w / a0, 0.0)
        sections.append((*b, (w - 1) / a0, 0.0))
    return sections


def butterworth_band(order: int, low: float, high: float, rate: float) -> list[Section]:
    """``order`` second-order sections of a Butterworth band-pass.

    Each pole p of the low-pass prototype becomes the two roots of s^2 - p (w2 - w1) s + w1 w2; half of the zeros lie at
    0 Hz and half at half the rate.  The gain is 1 at the band's (warped) middle.
    """
    if not 0 < low < high < rate / 2:
        raise ValueError(f"band edges {low}, {high} must ascend between 0 and {rate / 2}")
    w1, w2 = math.tan(math.pi * low / rate), math.tan(math.pi * high / rate)
    poles = []
    for k in range(order):
        p = -cmath.exp(1j * math.pi * (2 * k + 1 - order) / (2 * order))
        half = p * (w2 - w1) / 2
        root = cmath.sqrt(half * half - w1 * w2)
        poles += [(1 + s) / (1 - s) for s in (half + root, half - root)]
    real = sorted((z.real for z in poles if abs(z.imag) < 1e-12), key=abs)
    pairs = [(-2 * z.real, abs(z) ** 2) for z in poles if z.imag >= 1e-12] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2])]
    pairs.sort(key=lambda a: a[1])  # the most damped first
    z = cmath.exp(-2j * math.atan(math.sqrt(w1 * w2)))
    gains = [(1 - z * z) / (1 + a1 * z + a2 * z * z) for a1, a2 in pairs]
    sign = math.copysign(1.0, np.prod([g / abs(g) for g in gains]).real)
    sections = [(1 / abs(g), 0.0, -1 / abs(g), a1, a2) for g, (a1, a2) in zip(gains, pairs)]
    first = sections[0]
    return [(first[0] * sign, 0.0, first[2] * sign, *first[3:]), *sections[1:]]


class System:
    """A recursive filter as matrices of its state."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: float):
        self.a, self.b, self.c, self.d = a, b, c, d
        self.size = len(b)
        powers = [np.eye(self.size)]
        for _ in range(SPAN):
            powers.append(powers[-1] @ a)
        self.observe = np.array([c @ p for p in powers[:SPAN]]).reshape(SPAN, self.size)
        self.gather = np.array([powers[SPAN - 1 - k] @ b for k in range(SPAN)]).reshape(SPAN, self.size)
        impulse = np.r_[d, self.observe[: SPAN - 1] @ b]
        lag = np.subtract.outer(np.arange(SPAN), np.arange(SPAN))
        self.response = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
        self.powers = powers

    @classmethod
    def of_sections(cls, sections: Sequence[Section]) -> System:
        """Sections one after the other, each with two delayed values."""
        a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
        for b0, b1, b2, a1, a2 in sections:
            own = np.array([[-a1, 1.0], [-a2, 0.0]])
            entry = np.array([b1 - a1 * b0, b2 - a2 * b0])
            n = len(b)
            a = np.block([[a, np.zeros((n, 2))], [np.outer(entry, c), own]])
            b, c, d = np.r_[b, entry * d], np.r_[b0 * c, 1.0, 0.0], b0 * d
        return cls(a, b, c, d)

    @classmethod
    def of_rc(cls, tau: float, rate: float) -> System:
        """y = (1 - r) x + r y before, with r = exp(-1 / (tau rate))."""
        r = math.exp(-1 / (tau * rate))
        return cls(np.array([[r]]), np.array([r * (1 - r)]), np.array([1.0]), 1 - r)

    @lru_cache(maxsize=64)  # noqa: B019
    def over(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """A^n and M_n."""
        if n == 0:
            return np.eye(self.size), np.zeros((self.size, self.size))
        if n % 2:
            a, m = self.over(n - 1)
            return self.a @ a, m + a @ np.outer(self.b, self.c) @ a
        a, m = self.over(n // 2)
        return a @ a, m + a @ m @ a

    def steady(self) -> np.ndarray:
        """The state that an endless run of ones leaves."""
        return np.linalg.solve(np.eye(self.size) - self.a, self.b)

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Outputs, and the state after the last sample."""
        state = np.zeros(self.size) if state is None else state
        m, rest = divmod(len(x), SPAN)
        whole, tail = x[: m * SPAN].reshape(m, SPAN), x[m * SPAN :]
        s = np.vstack([state, whole @ self.gather])
        step, power = 1, self.powers[SPAN]
        while step <= m:
            s[step:] += s[:-step] @ power.T  # the right side is made before the left changes
            step, power = 2 * step, power @ power
        y = np.r_[(whole @ self.response.T + s[:m] @ self.observe.T).ravel(), self.response[:rest, :rest] @ tail + self.observe[:rest] @ s[m]]
        return y, self.powers[rest] @ s[m] + tail @ self.gather[SPAN - rest :]


def odd_ends(x: np.ndarray, pad: int, first: bool = True, last: bool = True) -> np.ndarray:
    """x with its ends continued by their mirror image through the end point."""
    return np.concatenate([2 * x[0] - x[pad:0:-1] if first else x[:0], x, 2 * x[-1] - x[-2 : -pad - 2 : -1] if last else x[:0]])


def both_ways(x: np.ndarray, system: System, pad: int = 0, steady: bool = True) -> np.ndarray:
    """Forward, then backward, from the steady state of the end values (or from rest), the ends continued oddly by pad samples."""
    if not len(x) or (steady and len(x) < 2):
        return x
    pad = min(pad, len(x) - 1)
    wide = odd_ends(x, pad)
    at = system.steady() if steady else np.zeros(system.size)
    y, _ = system.run(wide, at * wide[0])
    z, _ = system.run(y[::-1], at * y[-1])
    return z[::-1][pad : pad + len(x)]


def padding(sections: Sequence[Section]) -> int:
    """Samples by which the ends are continued for these sections."""
    return 3 * (2 * len(sections) + 1)


def recursive(signal: DataFrame, system: System, keys: Sequence[str] = ("recording",), pad: int = 0, steady: bool = True, backward: bool = True, block: int = BLOCK) -> DataFrame:
    """(keys, t, x): each series through the system, forward and (unless backward is False) backward.

    Equals ``both_ways`` (or ``System.run`` from rest or the first value's steady state) on the whole series.  A series
    below two blocks is one task's; of a longer one a task holds a block, two at most, and the scan a few numbers a block.
    A series of one sample is left as it is, values that are null count as NaN, keys may be null.
    """
    names, block = list(keys), max(block, pad + 1)
    rest = system.steady() if steady else np.zeros(system.size)
    rows = numbered(signal, names, block, count=True)
    last = F.greatest(F.floor(F.col("_n") / block), F.lit(1)) - 1
    rows = rows.withColumn("_last", last).withColumn("_block", F.least(F.floor(F.col("t") / block), F.col("_last"))).drop("_n")

    def whole(x: np.ndarray) -> np.ndarray:
        return both_ways(x, system, pad, steady) if backward else system.run(x, rest * x[0])[0] if len(x) else x

    short = per_series(rows.where("_last = 0"), whole, names)
    long = rows.where("_last > 0").repartition(*names, "_block").sortWithinPartitions(*names, "_block", "t")
    ends = long.mapInPandas(_ends(system, rest, names, pad if backward else 0, backward), f"{types_of(rows, names)}, _block long, n long, forward array<double>, back array<double>, tail double, x array<double>")
    scanned = ends.drop("x").repartition(*names).sortWithinPartitions(*names, "_block").mapInPandas(by_group(names, _scan(system, rest, names)), f"{types_of(rows, names)}, _block long, s array<double>, u array<double>, last boolean")
    same = F.col("a._block") == F.col("b._block")
    for k in names:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    met = ends.select(*names, "_block", "x").alias("a").join(scanned.alias("b"), same).select(*[F.col(f"a.{k}").alias(k) for k in names], F.col("a._block").alias("_block"), "x", "s", "u", "last")
    return short.unionByName(met.mapInPandas(_blocks(system, rest, names, pad if backward else 0, backward, block), f"{types_of(rows, names)}, t long, x double"))


def _ends(system: System, rest: np.ndarray, names: list[str], pad: int, backward: bool):
    """A row a block: its samples (the series' ends continued), and the end states that they alone leave."""

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        cut, out = starts(pdf, [*names, "_block"]), []
        values, block, last = pdf["x"].to_numpy(float), pdf["_block"].to_numpy(), pdf["_last"].to_numpy()
        for p, q in zip(cut[:-1], cut[1:]):
            x = odd_ends(values[p:q], pad, first=block[p] == 0, last=block[p] == last[p]) if pad else values[p:q]
            y, s = system.run(x, rest * x[0] if block[p] == 0 else None)
            u = system.run(y[::-1])[1] if backward else rest
            out.append((block[p], len(x), s, u, y[-1], x))
        heads = pdf[names].iloc[cut[:-1]].reset_index(drop=True)
        made = pd.DataFrame(out, columns=["_block", "n", "forward", "back", "tail", "x"])
        return pd.concat([heads, made], axis=1)

    return by_group([*names, "_block"], done)


def _scan(system: System, rest: np.ndarray, names: list[str]):
    """The states that each block of a series begins with, forward and backward: one step a block."""

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        cut, s_of, u_of, is_last = starts(pdf, names), [], [], np.zeros(len(pdf), bool)
        n, forward, back, tail = (pdf[c].tolist() for c in ("n", "forward", "back", "tail"))
        for p, q in zip(cut[:-1], cut[1:]):
            s = [np.zeros(system.size)]  # the first block holds its own start
            for k in range(p, q):
                s.append(system.over(n[k])[0] @ s[-1] + np.asarray(forward[k]))
            k = q - 1
            u = [rest * (tail[k] + system.c @ system.over(n[k] - 1)[0] @ s[k - p])]
            for k in range(q - 1, p, -1):
                a, m = system.over(n[k])
                u.append(a @ u[-1] + np.asarray(back[k]) + m @ s[k - p])
            s_of, u_of = s_of + s[:-1], u_of + u[::-1]
            is_last[q - 1] = True
        return pdf[[*names, "_block"]].assign(s=s_of, u=u_of, last=is_last)

    return done


def _blocks(system: System, rest: np.ndarray, names: list[str], pad: int, backward: bool, block: int):
    """Each block from its states; the continued ends go."""

    def run(batches):
        for pdf in batches:
            for k in range(len(pdf)):
                row = pdf.iloc[k]
                x, first = np.asarray(row["x"]), row["_block"] == 0
                y = system.run(x, rest * x[0] if first else np.asarray(row["s"]))[0]
                y = system.run(y[::-1], np.asarray(row["u"]))[0][::-1] if backward else y
                y = y[pad if first else 0 : len(y) - (pad if row["last"] else 0)]
                out = pdf[names].iloc[[k] * len(y)].reset_index(drop=True)
                yield out.assign(t=row["_block"] * block + np.arange(len(y)), x=y)

    return run


def band_passed(signal: DataFrame, low: float, high: float, rate: float, order: int = 4, keys: Sequence[str] = ("recording",), block: int = BLOCK) -> DataFrame:
    """Zero-phase Butterworth band-pass."""
    sections = butterworth_band(order, low, high, rate)
    return recursive(signal, System.of_sections(sections), keys, padding(sections), block=block)


def low_passed(signal: DataFrame, cut: float, rate: float, order: int = 4, keys: Sequence[str] = ("recording",), block: int = BLOCK) -> DataFrame:
    """Zero-phase Butterworth low-pass."""
    if not 0 < cut < rate / 2:
        raise ValueError(f"the cut {cut} must lie between 0 and {rate / 2}")
    sections = butterworth(order, cut, rate)
    return recursive(signal, System.of_sections(sections), keys, padding(sections), block=block)


def rc_smoothed(signal: DataFrame, tau: float, rate: float, keys: Sequence[str] = ("recording",), block: int = BLOCK) -> DataFrame:
    """First-order low-pass from rest, forward and backward."""
    return recursive(signal, System.of_rc(tau, rate), keys, steady=False, block=block)
