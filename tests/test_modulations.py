"""Modulation power in tiles against one convolution of the whole grid, written out."""

import math

import numpy as np
import pandas as pd
import pytest

from voltlake.operators import filters as D
from voltlake.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def whole(grid, rate, scale, frame_rate):
    """grid: bands by time."""
    n = max(int(2 * frame_rate / rate), 3)
    tap = [math.exp(-rate * k / frame_rate) * np.exp(2j * math.pi * rate * k / frame_rate) for k in range(n)]
    slow = np.array([[sum(tap[k] * row[t - k] for k in range(min(t, n - 1) + 1)) for t in range(grid.shape[1])] for row in grid])
    if len(grid) >= 9:
        w = {k: math.exp(-((scale * k) ** 2)) * math.cos(2 * math.pi * scale * k) for k in range(-4, 5)}
        slow = np.array([sum(w[k] * slow[b - k] for k in w if 0 <= b - k < len(grid)) for b in range(len(grid))])
    return abs(slow) ** 2


@pytest.mark.parametrize("block", [40, 1 << 16])
@pytest.mark.parametrize("n_bands", [4, 12])
def test_tiles_equal_the_whole(spark, block, n_bands):
    rng = np.random.default_rng(1)
    grids = {"a": rng.normal(size=(n_bands, 230)), None: rng.normal(size=(n_bands, 90)), "one": rng.normal(size=(n_bands, 1))}
    rows = [(k, b, t, float(g[b, t])) for k, g in grids.items() for b in range(n_bands) for t in range(g.shape[1])]
    got = D.modulations(spark.createDataFrame(rows, "recording string, band int, t long, x double").repartition(4), [2.0, 8.0], [0.5, 0.1], 50.0, block=block).toPandas()
    assert len(got) == 4 * len(rows)
    for k, g in grids.items():
        mine = got[got["recording"].isna() if k is None else got["recording"] == k]
        for (rate, scale), part in mine.groupby(["rate", "scale"]):
            table = part.pivot(index="band", columns="t", values="x").to_numpy()
            np.testing.assert_allclose(table, whole(g, rate, scale, 50.0), atol=1e-9)
    assert D.modulations(spark.createDataFrame([], "recording string, band int, t long, x double"), [2.0], [0.5], 50.0).count() == 0


def test_midbrain_query(spark):
    bands, got = (QUERIES[q](spark, SF).toPandas() for q in ("cochleogram", "midbrain"))
    for recording, g in list(bands.groupby("recording"))[:5]:
        grid = g.pivot(index="band", columns="t", values="x").to_numpy()
        for (rate, scale), part in got[got["recording"] == recording].groupby(["rate", "scale"]):
            want = whole(grid, rate, scale, 100.0)
            np.testing.assert_allclose(part.pivot(index="band", columns="t", values="x").to_numpy(), want, rtol=1e-5, atol=1e-4)
