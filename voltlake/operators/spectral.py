"""Short-time spectra, mel bands and cepstra as joins with small constant tables (windows, bins, weights)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frames(signal: DataFrame, n_fft: int, hop: int, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Each sample once in every frame [f * hop, f * hop + n_fft) that is full: frame, k (place in it), x.  No shuffle beyond the length."""
    n = signal.groupBy(*keys).agg((F.max("t") + 1).alias("_n"))
    hi = F.floor(F.col("t") / hop)
    lo = F.greatest(F.ceil((F.col("t") - n_fft + 1) / hop), F.lit(0))
    last = F.floor((F.col("_n") - n_fft) / hop)
    got = signal.join(n, list(keys)).where(F.col("_n") >= n_fft).withColumns({"_lo": lo, "_hi": F.least(hi, last)}).where("_lo <= _hi")
    return got.withColumn("frame", F.explode(F.sequence("_lo", "_hi"))).select(*keys, "frame", (F.col("t") - F.col("frame") * hop).alias("k"), "x")


def reflect_padded(signal: DataFrame, pad: int, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """pad samples mirrored at both ends without repeating the edge; t starts at 0 again."""
    n = signal.groupBy(*keys).agg((F.max("t") + 1).alias("_n"))
    got = signal.join(n, list(keys))
    last = F.col("_n") - 1
    places = F.array(F.col("t"), F.when((F.col("t") >= 1) & (F.col("t") <= pad), -F.col("t")), F.when((F.col("t") < last) & (F.col("t") >= last - pad), 2 * last - F.col("t")))
    return got.withColumn("_p", F.explode(places)).where("_p is not null").select(*keys, (F.col("_p") + pad).alias("t"), "x")


def stft_power(framed: DataFrame, n_fft: int, rate: float = 1.0, keys: Sequence[str] = ("recording",), bins: Sequence[int] | None = None) -> DataFrame:
    """(keys, frame, bin, freq, power) with a Hann window: each bin is two sums over the frame's samples, in one aggregate."""
    bins = list(range(n_fft // 2 + 1)) if bins is None else list(bins)
    hann = 0.5 - 0.5 * F.cos(2 * math.pi * F.col("k") / n_fft)
    sums = []
    for b in bins:
        angle = 2 * math.pi * b * F.col("k") / n_fft
        sums += [F.sum(F.col("x") * hann * F.cos(angle)).alias(f"c{b}"), F.sum(F.col("x") * hann * F.sin(angle)).alias(f"s{b}")]
    wide = framed.groupBy(*keys, "frame").agg(*sums)
    rows = F.array(*[F.struct(F.lit(b).alias("bin"), (F.col(f"c{b}") ** 2 + F.col(f"s{b}") ** 2).alias("power")) for b in bins])
    return wide.select(*keys, "frame", F.explode(rows).alias("r")).select(*keys, "frame", "r.bin", (F.col("r.bin") * rate / n_fft).alias("freq"), "r.power")


def mel_weights(n_fft: int, rate: float, bands: int, low: float = 0.0, high: float | None = None) -> list[tuple[int, int, float]]:
    """(band, bin, weight): triangles on floor bins of equal mel steps, scaled to equal area."""
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [hz(m) for m in np.linspace(mel(low), mel(high or rate / 2), bands + 2)]
    at = [int(math.floor((n_fft + 1) * f / rate)) for f in edges]
    out = []
    for b in range(bands):
        left, mid, right = at[b : b + 3]
        mid = max(mid, left + 1)  # bands narrower than a bin have one bin all the same
        right = min(max(right, mid + 1), n_fft // 2)
        area = 2.0 / (edges[b + 2] - edges[b])
        out += [(b, k, area * (k - left) / (mid - left)) for k in range(left, mid)] + [(b, k, area * (right - k) / (right - mid)) for k in range(mid, right)]
    return [(b, k, float(w)) for b, k, w in out if w > 0 and k <= n_fft // 2]


def weighted_bands(power: DataFrame, weights: Sequence[tuple[int, int, float]], keys: Sequence[str] = ("recording",)) -> DataFrame:
    """power (bin) -> (band, power); weights is a constant table."""
    table = power.sparkSession.createDataFrame(list(weights), "band int, bin int, w double")
    return power.join(F.broadcast(table), "bin").groupBy(*keys, "frame", "band").agg(F.sum(F.col("power") * F.col("w")).alias("power"))


def log_power(c: str = "power", floor: float = 1e-10):
    return F.log10(F.greatest(F.col(c), F.lit(floor)))


def cepstra(bands: DataFrame, n_bands: int, n_out: int, lifter: int = 0, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Orthonormal DCT-II of the natural log of the bands: (coef, value), optionally liftered."""
    rows = []
    for c in range(n_out):
        lift = 1 + lifter / 2 * math.sin(math.pi * c / lifter) if lifter else 1.0
        scale = math.sqrt((1 if c == 0 else 2) / n_bands) * lift
        rows += [(c, b, scale * math.cos(math.pi * c * (b + 0.5) / n_bands)) for b in range(n_bands)]
    table = bands.sparkSession.createDataFrame(rows, "coef int, band int, w double")
    logged = bands.withColumn("l", F.log(F.greatest(F.col("power"), F.lit(1e-10))))
    return logged.join(F.broadcast(table), "band").groupBy(*keys, "frame", "coef").agg(F.sum(F.col("l") * F.col("w")).alias("value"))


def convolve(signal: DataFrame, taps: Sequence[float], keys: Sequence[str] = ("recording",), delay: int = 0) -> DataFrame:
    """y[t] = sum of taps[k] * x[t + delay - k]; one window over each series, no join.  delay centres a symmetric filter."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("t")
    total = F.lit(0.0)
    for k, h in enumerate(taps):
        shift = k - delay
        moved = F.col("x") if shift == 0 else F.lag("x", shift).over(w) if shift > 0 else F.lead("x", -shift).over(w)
        total = total + F.coalesce(moved, F.lit(0.0)) * float(h)
    return signal.withColumn("x", total)


def gammatone_taps(centre: float, rate: float, length: int, order: int = 4) -> list[float]:
    """Gammatone impulse response of one ERB (times 1.019), unit energy."""
    t = np.arange(length) / rate
    width = 2 * math.pi * 1.019 * 24.7 * (4.37 * centre / 1000 + 1)
    h = t ** (order - 1) * np.exp(-width * t) * np.cos(2 * math.pi * centre * t)
    return (h / max(float(np.sqrt((h**2).sum())), 1e-12)).tolist()


def centre_frequencies(low: float, high: float, octaves: float) -> list[float]:
    """log2-spaced from low, octaves apart, up to high."""
    return [low * 2 ** (octaves * k) for k in range(int(math.floor(math.log2(high / low) / octaves)) + 1)]


def erb_bands(low: float, high: float) -> list[tuple[float, float]]:
    """Edges one ERB-rate step apart."""
    rate = lambda f: 21.4 * math.log10(4.37 * f / 1000 + 1)
    back = lambda e: (10 ** (e / 21.4) - 1) * 1000 / 4.37
    steps = np.arange(rate(low), rate(high) + 1e-9)
    edges = [back(float(e)) for e in steps]
    return list(zip(edges[:-1], edges[1:], strict=True))


def line_power(signal: DataFrame, freq: float, rate: float, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """((sum x sin)^2 + (sum x cos)^2) / n at the frequency."""
    angle = 2 * math.pi * freq * F.col("t") / rate
    s = signal.groupBy(*keys).agg(F.sum(F.col("x") * F.sin(angle)).alias("_s"), F.sum(F.col("x") * F.cos(angle)).alias("_c"), F.count(F.lit(1)).alias("_n"))
    return s.select(*keys, ((F.col("_s") ** 2 + F.col("_c") ** 2) / F.col("_n")).alias("line_power"))


def notch(signal: DataFrame, freqs: Sequence[float], rate: float, chunk: int, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Removes the fitted sinusoid of each frequency, chunk by chunk (sums of x sin and x cos, then subtracted)."""
    out = signal.withColumn("_chunk", F.floor(F.col("t") / chunk))
    for f in freqs:
        angle = 2 * math.pi * f * F.col("t") / rate
        from pyspark.sql import Window

        w = Window.partitionBy(*keys, "_chunk")
        a = F.sum(F.col("x") * F.sin(angle)).over(w) / F.greatest(F.sum(F.sin(angle) ** 2).over(w), F.lit(1e-12))
        b = F.sum(F.col("x") * F.cos(angle)).over(w) / F.greatest(F.sum(F.cos(angle) ** 2).over(w), F.lit(1e-12))
        out = out.withColumn("x", F.col("x") - a * F.sin(angle) - b * F.cos(angle))
    return out.drop("_chunk")


def welch_db(framed: DataFrame, n_fft: int, rate: float, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Power averaged over frames, in dB."""
    p = stft_power(framed, n_fft, rate, keys).groupBy(*keys, "bin", "freq").agg(F.avg("power").alias("p"))
    return p.select(*keys, "bin", "freq", (10 * F.log10(F.greatest("p", F.lit(1e-30)))).alias("db"))


def combine_bands(bands: DataFrame, how: str, keys: Sequence[str] = ("recording", "t")) -> DataFrame:
    """mean, sum or rms over bands."""
    v = {"mean": F.avg("x"), "sum": F.sum("x"), "rms": F.sqrt(F.avg(F.col("x") ** 2))}[how]
    return bands.groupBy(*keys).agg(v.alias("x"))
