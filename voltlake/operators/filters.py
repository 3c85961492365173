"""Filters run in numpy, on blocks of a series where a sample depends on near ones only, else on one series a group.

``per_block`` deals a series over tasks, however long it is: each block carries as many samples of its neighbours as
the filter reaches.  Recurrences forget: their reach is where an earlier sample weighs less than rounding.
``per_series`` holds a whole series (one channel of one recording, or one band of it) for transforms over all of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from voltlake.functions.scalars import rate_ratio
from voltlake.operators.blocks import BLOCK, numbered, per_block, per_series, types_of  # noqa: F401
from voltlake.operators.fourier import WHOLE, by_length, envelope_rows
from voltlake.operators.recursive import System, both_ways, butterworth, low_passed, padding


#: The weight below which a recurrence has forgotten a sample.
FORGOTTEN = 1e-17


def rc_reach(tau: float, rate: float) -> int:
    return math.ceil(-math.log(FORGOTTEN) * tau * rate) + 1


def sections_reach(sections: Sequence[tuple[float, ...]]) -> int:
    """Samples after which the slowest pole of second-order sections has decayed, for each section once, and the padded ends."""
    slowest = max(float(np.abs(np.roots([1.0, a1, a2])).max()) for *_, a1, a2 in sections)
    return math.ceil(len(sections) * math.log(FORGOTTEN) / math.log(max(slowest, 1e-3))) + 3 * (2 * len(sections) + 1) + 1


def resample_reach(new: float, old: float) -> int:
    up, down = rate_ratio(new, old)
    return -(-10 * max(up, down) // up) + 1


def resampled(signal: DataFrame, new: float, old: float, keys: Sequence[str] = ("recording",), block: int = BLOCK) -> DataFrame:
    """``resample`` by blocks."""
    up, down = rate_ratio(new, old)
    return per_block(signal, lambda x: resample(x, new, old), resample_reach(new, old), keys, up, down, block)


def analytic(x: np.ndarray) -> np.ndarray:
    n = len(x)
    if not n:
        return x.astype(complex)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def envelope(x: np.ndarray) -> np.ndarray:
    return np.abs(analytic(x))


def lowpass_taps(cut: float, rate: float, n: int) -> np.ndarray:
    """Windowed-sinc (Hamming) taps of unit gain at 0; n is made odd."""
    n |= 1
    k = np.arange(n) - n // 2
    h = 2 * cut / rate * np.sinc(2 * cut / rate * k) * np.hamming(n)
    return h / h.sum()


def centred(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Convolution with the middle tap on each sample, zeros beyond the ends; also where x is shorter than taps."""
    return np.convolve(x, taps)[len(taps) // 2 : len(taps) // 2 + len(x)] if len(x) else x


def fir_zero_phase(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Centred convolution with edges mirrored as far as x goes, so nothing is delayed."""
    pad = min(len(taps) // 2, max(len(x) - 1, 0))
    wide = np.pad(x, pad, mode="reflect") if pad else x
    return centred(wide, taps)[pad : pad + len(x)]


def highpass(x: np.ndarray, cut: float, rate: float, n: int = 101) -> np.ndarray:
    return x - fir_zero_phase(x, lowpass_taps(cut, rate, n))


def bandpass(x: np.ndarray, low: float, high: float, rate: float, n: int = 101) -> np.ndarray:
    return fir_zero_phase(x, lowpass_taps(high, rate, n) - lowpass_taps(low, rate, n))


@lru_cache(maxsize=32)
def _minimum_phase(taps: tuple[float, ...], points: int) -> np.ndarray:
    size = np.abs(np.fft.fft(np.array(taps), points))
    cepstrum = np.fft.ifft(np.log(np.maximum(size, size.max() * 1e-12))).real
    half = points // 2
    cepstrum[1:half] *= 2  # what stands before 0 is folded behind it
    cepstrum[half + 1 :] = 0
    return np.fft.ifft(np.exp(np.fft.fft(cepstrum))).real[: len(taps)]


def minimum_phase(taps: np.ndarray, points: int = 1 << 20) -> np.ndarray:
    """Taps of the same magnitude whose energy comes as early as it can: the cepstrum of the magnitude, folded.

    points: those of the transform; the magnitude is off by about their inverse, through the aliased cepstrum.
    """
    return _minimum_phase(tuple(map(float, taps)), points)


def causal(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Each output from samples up to its own; zeros before the start."""
    return np.convolve(x, taps)[: len(x)]


def fir_filtered(signal: DataFrame, taps: np.ndarray, phase: str = "zero", keys: Sequence[str] = ("recording",), block: int = BLOCK) -> DataFrame:
    """(keys, t, x) through taps: zero phase (centred, edges mirrored), or their minimum-phase form, causal, by blocks."""
    if phase not in ("zero", "minimum"):
        raise ValueError(phase)
    if phase == "zero":
        return per_block(signal, lambda x: fir_zero_phase(x, taps), len(taps), keys, block=block)
    early = minimum_phase(taps)
    return per_block(signal, lambda x: causal(x, early), len(taps), keys, block=block)


def highpass_taps(cut: float, rate: float, n: int = 101) -> np.ndarray:
    """What a low-pass of these taps takes away is left."""
    n |= 1
    return np.where(np.arange(n) == n // 2, 1.0, 0.0) - lowpass_taps(cut, rate, n)


def run_sections(x: np.ndarray, sections: Sequence[tuple[float, ...]]) -> np.ndarray:
    """The sections one after the other, starting from the steady state of the first value."""
    system = System.of_sections(sections)
    return system.run(x, system.steady() * x[0])[0] if len(x) else x


def zero_phase(x: np.ndarray, sections: Sequence[tuple[float, ...]]) -> np.ndarray:
    """Forward and backward with the ends continued oddly."""
    return both_ways(x, System.of_sections(sections), padding(sections))


def resample(x: np.ndarray, new: float, old: float) -> np.ndarray:
    """Polyphase by the rational ratio: zeros between samples, one low-pass, every down-th kept.  Length ceil(n * up / down)."""
    up, down = rate_ratio(new, old)
    if up == down or not len(x):
        return x
    half = 10 * max(up, down)
    k = np.arange(-half, half + 1)
    h = np.sinc(k / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    h *= up / h.sum()
    sparse = np.zeros(len(x) * up)
    sparse[::up] = x
    y = np.convolve(sparse, h)[half : half + len(sparse)]
    return y[::down]


def fft_resample(x: np.ndarray, new: float, old: float) -> np.ndarray:
    if abs(new - old) < 1e-6 or not len(x):
        return x
    n = int(round(len(x) * new / old))
    if not n:
        return x[:0]
    spectrum = np.fft.rfft(x)
    return np.fft.irfft(spectrum[: n // 2 + 1] if n < len(x) else np.pad(spectrum, (0, n // 2 + 1 - len(spectrum))), n) * n / len(x)


def rc_smooth(x: np.ndarray, tau: float, rate: float) -> np.ndarray:
    """First-order low-pass forward, then backward."""
    return both_ways(x, System.of_rc(tau, rate), steady=False)


def derivative(signal: DataFrame, mode: str, rate: float, factor: int = 1, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """none, diff, absdiff (0 at the start), or hr and hr_absdiff: taken at factor times the rate and brought back."""
    if mode not in ("none", "diff", "absdiff", "hr", "hr_absdiff"):
        raise ValueError(mode)

    def f(x: np.ndarray) -> np.ndarray:
        if mode == "none" or not len(x):
            return x
        k = factor if mode.startswith("hr") else 1
        y = resample(x, rate * k, rate)
        y = np.diff(y, prepend=y[:1]) * rate * k
        y = np.abs(y) if mode.endswith("absdiff") else y
        y = resample(y, rate, rate * k)[: len(x)]
        return np.pad(y, (0, len(x) - len(y)))

    return per_block(signal, f, 2 * resample_reach(factor, 1) + 1, keys)  # to the higher rate and back, and the difference


def moving_average(x: np.ndarray, smooth: int) -> np.ndarray:
    return np.convolve(x, np.ones(smooth) / smooth, mode="same")[: len(x)] if smooth > 1 and len(x) >= smooth else x


def gamma_envelope(signal: DataFrame, low: float, high: float, rate: float, smooth: int = 0, rectify: bool = False, keys: Sequence[str] = ("recording", "channel"), whole: int = WHOLE) -> DataFrame:
    """Band-pass, then magnitude (or rectified), then an optional moving average; channel names get a suffix.

    Series of over ``whole`` samples go by blocks and by a transform in two passes.
    """

    def f(x: np.ndarray) -> np.ndarray:
        y = bandpass(x, low, high, rate)
        return moving_average(np.abs(y) if rectify else envelope(y), smooth)

    short, long = by_length(signal, keys, whole)
    out = per_series(short, f, keys)
    if long is not None:
        y = per_block(long, lambda x: bandpass(x, low, high, rate), 101, keys)
        y = y.withColumn("x", F.abs("x")) if rectify else envelope_rows(y, keys, whole)
        out = out.unionByName(per_block(y, lambda x: moving_average(x, smooth), smooth, keys) if smooth > 1 else y)
    return out.withColumn("channel", F.concat("channel", F.lit("_HFAenv"))) if "channel" in keys else out


def hilbert_envelope(signal: DataFrame, rate: float, new_rate: float, cut: float | None = None, power: float = 1.0, keys: Sequence[str] = ("recording",), whole: int = WHOLE) -> DataFrame:
    """The analytic signal's magnitude to a power, an optional low-pass, the new rate; long series as in ``gamma_envelope``."""
    taps = lowpass_taps(cut, rate, 101) if cut else None

    def f(x: np.ndarray) -> np.ndarray:
        y = envelope(x) ** power
        return resample(fir_zero_phase(y, taps) if cut else y, new_rate, rate)

    short, long = by_length(signal, keys, whole)
    out = per_series(short, f, keys)
    if long is None:
        return out
    y = envelope_rows(long, keys, whole).withColumn("x", F.pow("x", F.lit(power)))
    y = per_block(y, lambda x: fir_zero_phase(x, taps), 101, keys) if cut else y
    return out.unionByName(resampled(y, new_rate, rate, keys))


def speech_envelope(signal: DataFrame, rate: float, new_rate: float, cut: float, order: int = 4, keys: Sequence[str] = ("recording",), whole: int = WHOLE) -> DataFrame:
    """The mean removed, analytic magnitude, zero-phase Butterworth low-pass, the new rate: one channel's envelope as an encoding model takes it."""
    if not 0 < cut < rate / 2 or new_rate <= 0:
        raise ValueError(f"the cut {cut} must lie between 0 and {rate / 2}, the new rate {new_rate} above 0")
    sections = butterworth(order, cut, rate)

    def f(x: np.ndarray) -> np.ndarray:
        return resample(zero_phase(envelope(x - x.mean()), sections), new_rate, rate)

    short, long = by_length(signal, keys, whole)
    out = per_series(short, f, keys)
    if long is None:
        return out
    mean = long.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.avg("x").alias("_mean"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    about = long.join(mean, same).select(*keys, "t", (F.col("x") - F.col("_mean")).alias("x"))
    y = low_passed(envelope_rows(about, keys, whole), cut, rate, order, keys)
    return out.unionByName(resampled(y, new_rate, rate, keys))


def channel_envelopes(audio: DataFrame, mode: str, rate: float, new_rate: float, cut: float, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """(keys, feature, t, x) of audio (keys, channel numbered from 0, t, x): mean, self (channel 0), other (channel 1) or all three.

    A recording without the channel that the mode needs raises.
    """
    if mode not in ("mean", "self", "other", "all"):
        raise ValueError(mode)
    names = list(keys)
    if mode in ("other", "all"):
        least = F.max(F.when(F.col("channel") == 1, 1).otherwise(0))
        missing = audio.groupBy(*names).agg(least.alias("has")).where("has = 0").limit(1).collect()
        if missing:
            raise ValueError(f"mode {mode} needs two channels: {missing[0]}")
    mixed = audio.groupBy(*names, "t").agg(F.avg("x").alias("x")).withColumn("feature", F.lit("mean"))
    one = {n: audio.where(F.col("channel") == c).select(*names, "t", "x", F.lit(n).alias("feature")) for n, c in (("self", 0), ("other", 1))}
    parts = {"mean": [mixed], "self": [one["self"]], "other": [one["other"]], "all": [mixed, one["self"], one["other"]]}[mode]
    rows = parts[0].select(*names, "feature", "t", "x")
    for p in parts[1:]:
        rows = rows.unionByName(p.select(*names, "feature", "t", "x"))
    return speech_envelope(rows, rate, new_rate, cut, 4, [*names, "feature"])


def rectified_envelope(signal: DataFrame, rate: float, cut: float, new_rate: float, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Rectified, Butterworth of order 2 without phase, resampled, not below 0."""
    smooth = low_passed(signal.withColumn("x", F.abs("x")), cut, rate, 2, keys)
    return resampled(smooth, new_rate, rate, keys).withColumn("x", F.greatest("x", F.lit(0.0)))


def band_envelopes(signal: DataFrame, bands: Sequence[tuple[float, float]], rate: float, cut: float, keys: Sequence[str] = ("recording",), whole: int = WHOLE) -> DataFrame:
    """(keys, band, t, x): each band's envelope after a low-pass, not below 0.  A group is one band of one series."""
    numbers = F.array(*[F.lit(k) for k in range(len(bands))])
    spread = signal.select(*keys, "t", "x", F.explode(numbers).alias("band"))  # a fixed list of bands
    sections, by = butterworth(2, cut, rate), [*keys, "band"]

    def passed(x: np.ndarray, key: tuple) -> np.ndarray:
        return bandpass(x, *bands[key[-1]], rate)

    def one(x: np.ndarray, key: tuple) -> np.ndarray:
        return np.maximum(zero_phase(envelope(passed(x, key)), sections), 0)

    short, long = by_length(spread, by, whole)
    out = per_series(short, one, by, keyed=True)
    if long is None:
        return out
    y = envelope_rows(per_block(long, passed, 101, by, keyed=True), by, whole)
    y = low_passed(y, cut, rate, 2, by).withColumn("x", F.greatest("x", F.lit(0.0)))
    return out.unionByName(y)


#: Taps of a spectral filter, half of them to each side.
ACROSS = 9


def temporal_taps(rate: float, frame_rate: float) -> np.ndarray:
    """A decaying turn at the rate, two of its periods long, causal."""
    t = np.arange(max(int(2 * frame_rate / rate), 3)) / frame_rate
    return np.exp(-rate * t) * np.exp(2j * math.pi * rate * t)


def spectral_taps(scale: float) -> np.ndarray:
    """A ripple across neighbouring bands."""
    k = np.arange(ACROSS) - ACROSS // 2
    return np.exp(-((scale * k) ** 2)) * np.cos(2 * math.pi * scale * k)


def modulations(bands: DataFrame, rates: Sequence[float], scales: Sequence[float], frame_rate: float, keys: Sequence[str] = ("recording",), block: int = BLOCK) -> DataFrame:
    """(keys, band, rate, scale, t, x): power of band envelopes through separable temporal and spectral filters.

    In time by blocks of each band with their neighbours' samples, across bands by sample: a task holds a block, or all
    bands of some samples, never a recording.  A band without a sample at some t counts 0 there as long as another has one.
    With fewer than ACROSS bands only the temporal filter applies.
    """
    names, taps = list(keys), [temporal_taps(r, frame_rate) for r in rates]
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("r"), F.lit(p).alias("p")) for k in range(len(rates)) for p in (0, 1)]))
    spread = bands.select(*names, "band", "t", "x", parts.alias("_f")).select(*names, "band", F.col("_f.r").alias("_rate"), F.col("_f.p").alias("_part"), "t", "x")

    def slow(x: np.ndarray, key: tuple) -> np.ndarray:
        tap = taps[key[-2]]
        return causal(x, tap.imag if key[-1] else tap.real)

    by = [*names, "band", "_rate", "_part"]
    moved = per_block(spread, slow, max(map(len, taps)), by, block=block, keyed=True)
    listed = bands.select(*names, "band").distinct().groupBy(*[F.col(k).alias(f"_{k}") for k in names]).agg(F.array_sort(F.collect_list("band")).alias("_bands"))
    same = F.lit(True)
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    column = moved.groupBy(*names, "_rate", "t").agg(F.collect_list(F.struct("band", "_part", "x")).alias("_z")).join(listed, same)
    schema = f"{types_of(bands, names)}, band {bands.schema['band'].dataType.simpleString()}, rate double, scale double, t long, x double"
    across = [spectral_taps(s) for s in scales]

    def power(batches):
        for pdf in batches:
            sizes = pdf["listed"].map(len).to_numpy()
            for n in np.unique(sizes):  # all samples of a batch with as many bands at once
                some = pdf[sizes == n]
                own = np.stack(some["listed"].to_list())
                z = np.zeros((len(some), n), complex)
                for k, (place, part, x) in enumerate(zip(some["place"], some["part"], some["x"])):
                    np.add.at(z[k], np.asarray(place) - 1, np.where(np.asarray(part) == 1, 1j, 1) * np.asarray(x))
                wide = np.pad(z, ((0, 0), (ACROSS // 2, ACROSS // 2)))
                heads = some[names].iloc[np.repeat(np.arange(len(some)), n)]
                fixed = heads.assign(band=own.ravel(), rate=np.repeat(np.asarray(rates, float)[some["r"]], n), t=np.repeat(some["t"].to_numpy(), n))
                for s, tap in zip(scales, across):
                    y = np.lib.stride_tricks.sliding_window_view(wide, ACROSS, axis=1) @ tap[::-1] if n >= ACROSS else z
                    yield fixed.assign(scale=float(s), x=(np.abs(y) ** 2).ravel())[[*names, "band", "rate", "scale", "t", "x"]]

    each = lambda f: F.transform("_z", f)
    rows = column.select(*names, F.col("_rate").alias("r"), "t", F.col("_bands").alias("listed"), each(lambda z: F.array_position("_bands", z["band"]).cast("int")).alias("place"), each(lambda z: z["_part"]).alias("part"), each(lambda z: z["x"]).alias("x"))
    return rows.mapInPandas(power, schema)


def loudness(signal: DataFrame, rate: float, n_fft: int = 256, hop: int = 128, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """A loudness contour a frame: Bark-band powers, compressed and summed, smoothed by three-point passes."""
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    bark = 13 * np.arctan(0.00076 * f) + 3.5 * np.arctan((f / 7500) ** 2)
    band = np.floor(bark).astype(int)

    def g(x: np.ndarray) -> np.ndarray:
        if len(x) < n_fft:
            x = np.pad(x, (0, n_fft - len(x)))
        at = np.arange(0, len(x) - n_fft + 1, hop)
        p = np.abs(np.fft.rfft(np.stack([x[a : a + n_fft] for a in at]) * np.hanning(n_fft), axis=1)) ** 2
        s = np.stack([p[:, band == b].sum(1) for b in range(band.max() + 1)], axis=1) ** 0.23
        y = s.sum(1)
        for _ in range(13):
            y = np.convolve(np.pad(y, 1, mode="edge"), [0.25, 0.5, 0.25], mode="valid")
        return y

    return per_series(signal, g, keys)


def intensity_db(signal: DataFrame, rate: float, window: int, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Kaiser-weighted local power in dB, the mean removed first."""
    k = np.kaiser(window | 1, 20.0)
    k /= k.sum()
    mean = signal.groupBy(*[F.col(n).alias(f"_{n}") for n in keys]).agg(F.avg("x").alias("_mean"))
    same = F.lit(True)
    for n in keys:
        same = same & F.col(n).eqNullSafe(F.col(f"_{n}"))
    about = signal.join(mean, same).select(*keys, "t", (F.col("x") - F.col("_mean")).alias("x"))
    return per_block(about, lambda x: 10 * np.log10(np.maximum(centred(x**2, k), 1e-30)), len(k), keys)


def remove_line(signal: DataFrame, freq: float, rate: float, chunk: int, keep: int = 1) -> DataFrame:
    """Spatial line-noise removal: of each chunk's channels, the components of most power at the line's harmonics are projected out.

    A group is a chunk of a recording with all its channels, of bounded length.
    """
    schema = f"recording {signal.schema['recording'].dataType.simpleString()}, channel string, t long, x double"

    def clean(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="t", columns="channel", values="x").fillna(0.0)
        x = grid.to_numpy()
        mean = x.mean(0)
        z = x - mean
        spectrum, f = np.fft.rfft(z, axis=0), np.fft.rfftfreq(len(z), 1 / rate)
        near = np.zeros(len(f), bool)
        for h in range(1, int(rate / 2 // freq) + 1):
            near[np.argmin(np.abs(f - h * freq))] = True
        line = np.fft.irfft(spectrum * near[:, None], len(z), axis=0)
        total, noise = z.T @ z, line.T @ line
        values, vectors = np.linalg.eigh(total)
        ok = values > values.max(initial=0) * 1e-9
        white = vectors[:, ok] / np.sqrt(np.maximum(values[ok], 1e-30))
        _, turn = np.linalg.eigh(white.T @ noise @ white)
        unmix = white @ turn[:, ::-1][:, :keep]
        source = line @ unmix
        back = np.linalg.lstsq(source, line, rcond=None)[0] if unmix.shape[1] else np.zeros((0, x.shape[1]))
        out = pd.DataFrame(z - source @ back + mean, index=grid.index, columns=grid.columns).stack().rename("x").reset_index()
        return out.assign(recording=pdf["recording"].iloc[0])[["recording", "channel", "t", "x"]]

    return signal.withColumn("_chunk", F.floor(F.col("t") / chunk)).groupBy("recording", "_chunk").applyInPandas(clean, schema)


def peak_normalised(signal: DataFrame, headroom_db: float = 1.0, keys: Sequence[str] = ("recording",)) -> DataFrame:
    peak = F.max(F.abs("x")).over(Window.partitionBy(*keys))
    return signal.withColumn("x", F.when(peak > 0, F.col("x") * (10 ** (-headroom_db / 20)) / peak).otherwise(F.col("x")))


#: Feature plug-ins by name: (signal, settings) -> DataFrame.
FEATURES: dict[str, Callable[..., DataFrame]] = {}


def register_feature(name: str, f: Callable[..., DataFrame]) -> None:
    if name in FEATURES:
        raise ValueError(f"feature {name} is registered already")
    FEATURES[name] = f


for _name, _f in {"hilbert_envelope": hilbert_envelope, "rectified_envelope": rectified_envelope, "band_envelopes": band_envelopes, "modulations": modulations, "loudness": loudness, "intensity_db": intensity_db, "gamma_envelope": gamma_envelope, "speech_envelope": speech_envelope}.items():
    register_feature(_name, _f)
