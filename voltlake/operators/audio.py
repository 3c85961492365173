"""Features of audio as they are composed: specific loudness, envelopes on a grid, spectrograms.

Series of up to ``WHOLE`` samples take one task each; longer ones go through the transforms in two passes, the recursive
filters in blocks and the blocks with neighbours of the modules beside this one.  Both give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions.scalars import rate_ratio
from voltlake.operators.blocks import by_group, numbered, per_block, per_series, starts, types_of
from voltlake.operators.filters import derivative, rectified_envelope, register_feature, resampled
from voltlake.operators.fourier import WHOLE, by_length, dft
from voltlake.operators.recursive import System, both_ways, odd_ends, rc_smoothed
from voltlake.storage import written

#: Fixed values of specific loudness: centres in Bark, first and last centre that count with 1 and -1, smoothing time, least power, passes.
CENTRES, ADDED, TAKEN, TAU, LEAST, PASSES = range(1, 23), range(3, 20), range(20, 23), 0.0013, 1e-20, 13


def bark(f: np.ndarray) -> np.ndarray:
    return 13 * np.arctan(0.76 * f / 1000) + 3.5 * np.arctan(f / 7500) ** 2


def band_weight(z: np.ndarray, centre: float) -> np.ndarray:
    """How much of a frequency at z Bark a band hears."""
    d = z - centre - 0.215
    return 10 ** (0.7 - 0.75 * d - 1.75 * (0.196 + d * d))


def three_point(x: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """A mean of three points, forward and backward, again and again; each time the ends are continued oddly by nine samples."""
    for _ in range(passes if len(x) > 1 else 0):
        pad = min(9, len(x) - 1)
        wide = odd_ends(x, pad)
        for _ in range(2):  # the second time from the other end
            wide = np.convolve(np.r_[wide[:1], wide[:1], wide], np.ones(3) / 3, mode="valid")[::-1]
        x = wide[pad : pad + len(x)]
    return x


def loudness_of(x: np.ndarray, rate: float, new: float) -> np.ndarray:
    """Specific loudness of a whole series at a new rate; length floor(n new / rate)."""
    n, m = len(x), int(len(x) * new / rate)
    if not m:
        return x[:0]
    spectrum, inner = np.fft.fft(x), np.arange(1, n // 2)
    z, rc = bark(inner * rate / n), System.of_rc(TAU, rate)
    out = np.zeros(m)
    for c in [*ADDED, *TAKEN]:
        shaped = np.zeros(n, complex)
        shaped[inner] = spectrum[inner] * band_weight(z, c)
        power = both_ways(np.fft.ifft(shaped).real ** 2, rc, steady=False)
        level = np.interp(np.arange(m) / new, np.arange(n) / rate, np.exp(0.5 * np.log(np.maximum(power, LEAST))))
        out += np.maximum(level, 0) * (1 if c in ADDED else -1)
    return three_point(out)


def specific_loudness(signal: DataFrame, rate: float, new: float, keys: Sequence[str] = ("recording",), whole: int = WHOLE) -> DataFrame:
    """(keys, t, x): bands of the spectrum in Bark, squared, smoothed, compressed to their root, brought to the new rate, summed with sign and smoothed.

    Bands see the frequencies between 0 and half the rate only, and of their transform the real part counts.
    """
    names = list(keys)
    short, long = by_length(signal, names, whole)
    out = per_series(short, lambda x: loudness_of(x, rate, new), names)
    if long is None:
        return out
    rows = numbered(long, names, count=True).select(*names, F.col("_n").alias("n"), F.col("t").alias("k"), F.col("x").alias("re"), F.lit(0.0).alias("im"))
    longest = rows.agg(F.max("n")).first()[0]
    lengths = written(rows.groupBy(*names).agg(F.floor(F.max("n") * F.lit(new) / F.lit(rate)).alias("_m")), "lengths")
    spectrum = dft(rows, names, whole=whole, longest=longest).where((F.col("k") >= 1) & (F.col("k") < F.floor(F.col("n") / 2)))
    f = F.col("k") * rate / F.col("n")
    z = 13 * F.atan(0.76 * f / 1000) + 3.5 * F.pow(F.atan(f / 7500), 2)
    spread = spectrum.withColumn("_z", z).withColumn("band", F.explode(F.array(*[F.lit(c) for c in [*ADDED, *TAKEN]])))  # a fixed list of bands
    d = F.col("_z") - F.col("band") - 0.215
    weight = F.pow(F.lit(10.0), 0.7 - 0.75 * d - 1.75 * (0.196 + d * d))
    by = [*names, "band"]
    shaped = spread.withColumns({"re": F.col("re") * weight, "im": F.col("im") * weight})
    power = dft(shaped, by, inverse=True, whole=whole, longest=longest).select(*by, F.col("k").alias("t"), (F.col("re") * F.col("re")).alias("x"))
    smooth = rc_smoothed(power, TAU, rate, by)
    level = smooth.withColumn("x", F.exp(0.5 * F.log(F.greatest("x", F.lit(LEAST)))))
    level = interpolated(level, new, rate, by)
    total = level.groupBy(*names, "t").agg(F.sum(F.greatest("x", F.lit(0.0)) * F.when(F.col("band") < TAKEN[0], 1).otherwise(-1)).alias("x"))
    same = F.lit(True)
    for k in names:
        same = same & total[k].eqNullSafe(lengths[k])
    total = total.join(lengths, same).where(total["t"] < lengths["_m"]).select(*[total[k] for k in names], "t", "x")
    return out.unionByName(per_block(total, three_point, 2 * PASSES, names))


def interpolated(signal: DataFrame, new: float, rate: float, keys: Sequence[str]) -> DataFrame:
    """Straight lines between samples, taken at the new rate from the first sample on; beyond the last sample its value."""
    up, down = rate_ratio(new, rate)

    def f(x: np.ndarray) -> np.ndarray:
        return np.interp(np.arange(-(-len(x) * up // down)) * down / up, np.arange(len(x)), x)

    return per_block(signal, f, 1, keys, up, down)


def on_grid(rows: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """t from 0 to n - 1 of each series: later rows go, missing ones are 0."""
    heads = rows.select(*keys).distinct().withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    met = heads.alias("a").join(rows.alias("b"), _same("a", "b", [*keys, "t"]), "left")
    return met.select(*[F.col(f"a.{k}").alias(k) for k in [*keys, "t"]], F.coalesce(F.col("b.x"), F.lit(0.0)).alias("x"))


def _same(a: str, b: str, names: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in names:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def envelope_feature(signal: DataFrame, kind: str, rate: float, grid_rate: float, n_times: int, envelope_rate: float | None = None, cut: float = 10.0, change: str = "none", keys: Sequence[str] = ("recording",)) -> DataFrame:
    """One envelope (broadband or loudness) on a grid of n_times samples, then its derivative.

    The envelope is taken at envelope_rate (the grid's where it is not given), brought to the grid's rate, cut or filled.
    """
    if kind not in ("broadband", "loudness"):
        raise ValueError(f"envelopes are broadband or loudness, not {kind}")
    if n_times <= 0:
        raise ValueError("n_times must be positive")
    at = envelope_rate or grid_rate
    if kind == "broadband":
        if not 0 < cut < rate / 2:
            raise ValueError(f"the cut {cut} must lie between 0 and {rate / 2}")
        y = rectified_envelope(signal, rate, cut, at, keys)
    else:
        y = specific_loudness(signal, rate, at, keys)
    y = y if math.isclose(at, grid_rate) else resampled(y, grid_rate, at, keys)
    return derivative(on_grid(y, n_times, keys), change, grid_rate, keys=keys)


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(n) / n)


#: What a bin of a frame becomes.
OUTPUTS = {"magnitude": np.abs, "power": lambda z: np.abs(z) ** 2}


def spectrogram(signal: DataFrame, n_fft: int, hop: int, rate: float, window: int | None = None, boundary: str | None = "reflect", output: str = "power", least: float = 1e-12, low: float | None = None, high: float | None = None, keys: Sequence[str] = ("recording",), block: int = 1 << 16) -> DataFrame:
    """(keys, frame, bin, freq, value): a real FFT of each frame under a Hann window, many frames at once.

    boundary: reflect (half a frame mirrored beyond each end, unscaled), zeros (half a frame of zeros, scaled by the window's
    sum, as is None) or None.  window: its length, n_fft at most; then frames are that long under zeros and None, and under reflect the rest
    of a frame weighs 0.  output: magnitude, power or log_power (base 10, not below least).  low, high: frequencies kept.
    Series shorter than a frame are filled with zeros to one.  A task holds the samples of some frames, not a series.
    """
    width = window or n_fft
    if not 0 < width <= n_fft or hop <= 0 or boundary not in ("reflect", "zeros", None) or output not in (*OUTPUTS, "log_power"):
        raise ValueError(f"window {width} of {n_fft}, hop {hop}, boundary {boundary}, output {output}")
    names, length = list(keys), n_fft if boundary == "reflect" else width
    taper = np.pad(hann(width), (0, length - width)) / (1 if boundary == "reflect" else hann(width).sum())
    pad = length // 2 if boundary else 0
    freqs = np.arange(n_fft // 2 + 1) * rate / n_fft
    kept = np.flatnonzero((freqs >= (freqs[0] if low is None else low)) & (freqs <= (freqs[-1] if high is None else high)))
    each = max(block // hop, -(-4 * length // hop))  # frames of a block
    rows = numbered(signal, names, count=True)
    frames = F.greatest(F.floor((F.col("_n") + 2 * pad - length) / hop), F.lit(0))  # the last frame's number

    def blocks(place: Column) -> Column:
        """The blocks whose frames hold a place of the padded series."""
        first = F.greatest(F.ceil((place - length + 1) / hop), F.lit(0))
        last = F.least(F.floor(place / hop), frames)
        return F.when(first <= last, F.sequence(F.floor(first / each), F.floor(last / each))).otherwise(F.array().cast("array<bigint>"))

    t, n = F.col("t"), F.col("_n")
    where = [blocks(t + pad)]
    if boundary == "reflect":
        where += [F.when((t >= 1) & (t <= pad), blocks(pad - t)), F.when((t < n - 1) & (t >= n - 1 - pad), blocks(pad + 2 * (n - 1) - t))]
    none = F.array().cast("array<bigint>")
    spread = rows.withColumn("_block", F.explode(F.array_distinct(F.concat(*[F.coalesce(w, none) for w in where]))))

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        cut, parts, heads, number = starts(pdf, [*names, "_block"]), [], [], []
        x, at, n, of = pdf["x"].to_numpy(float), pdf["t"].to_numpy(), pdf["_n"].to_numpy(), pdf["_block"].to_numpy()
        for p, q in zip(cut[:-1], cut[1:]):
            all_frames = max((n[p] + 2 * pad - length) // hop, 0) + 1
            first, last = of[p] * each, min((of[p] + 1) * each, all_frames)
            begin, size = first * hop, (last - first - 1) * hop + length
            if all_frames <= each:  # the whole series is here
                wide = np.pad(x[p:q], pad, mode="reflect") if boundary == "reflect" and n[p] > 1 else np.pad(x[p:q], pad, mode="edge" if boundary == "reflect" else "constant")
                wide = np.pad(wide, (0, max(size - len(wide), 0)))[:size]
            else:
                wide, v, m = np.zeros(size), x[p:q], n[p]
                for place, mine in ((at[p:q] + pad, np.ones(q - p, bool)), (pad - at[p:q], (at[p:q] >= 1) & (at[p:q] <= pad)), (pad + 2 * (m - 1) - at[p:q], (at[p:q] < m - 1) & (at[p:q] >= m - 1 - pad))):
                    mine = mine & (place >= begin) & (place < begin + size)
                    wide[place[mine] - begin] = v[mine]
                    if boundary != "reflect":
                        break
            z = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(wide, length)[::hop] * taper, n=n_fft, axis=1)[:, kept]
            parts.append(np.log10(np.maximum(np.abs(z) ** 2, least)) if output == "log_power" else OUTPUTS[output](z))
            heads.append(np.full(len(z), p))
            number.append(np.arange(first, last))
        out = pdf[names].iloc[np.concatenate(heads)].reset_index(drop=True)
        return out.assign(frame=np.concatenate(number), values=list(np.concatenate(parts)))

    dealt = spread.repartition(*names, "_block").sortWithinPartitions(*names, "_block", "t")
    made = dealt.mapInPandas(by_group([*names, "_block"], done), f"{types_of(rows, names)}, frame long, values array<double>")
    bins = F.array(*[F.struct(F.lit(int(k)).alias("bin"), F.lit(float(freqs[k])).alias("freq")) for k in kept])
    zipped = F.explode(F.arrays_zip(bins.alias("b"), F.col("values").alias("value")))
    return made.select(*names, "frame", zipped.alias("_v")).select(*names, "frame", F.col("_v.b.bin").alias("bin"), F.col("_v.b.freq").alias("freq"), F.col("_v.value").alias("value"))


def spectrogram_on_grid(spectra: DataFrame, frame_rate: float, grid_rate: float, n_times: int, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """(keys, bin, freq, t, x): each bin's values brought to a grid's rate and length."""
    by = [*keys, "bin", "freq"]
    rows = spectra.select(*by, F.col("frame").alias("t"), F.col("value").alias("x"))
    rows = rows if math.isclose(frame_rate, grid_rate) else resampled(rows, grid_rate, frame_rate, by)
    return on_grid(rows, n_times, by)


register_feature("specific_loudness", specific_loudness)
register_feature("envelope_feature", envelope_feature)
register_feature("spectrogram", spectrogram)
