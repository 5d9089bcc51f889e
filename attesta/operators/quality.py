"""Capture quality of grayscale rasters: rasters(capture_id, width, height, gray ARRAY<INT>, row by row)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sharpness_of(g: np.ndarray) -> float:
    """Population variance of the four-neighbour Laplacian over inner pixels."""
    if min(g.shape) < 3:
        return 0.0
    around = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:]
    return float((around - 4.0 * g[1:-1, 1:-1]).var())


def glare_of(g: np.ndarray, grid: int = 6, level: int = 250) -> float:
    """Share of bright pixels in the brightest block, less the median block; blocks overlap by half."""
    if min(g.shape) < grid:
        return 0.0
    high, wide = g.shape[0] // grid, g.shape[1] // grid
    blocks = np.lib.stride_tricks.sliding_window_view(g >= level, (high, wide))[:: max(1, high // 2), :: max(1, wide // 2)]
    shares = blocks.mean(axis=(2, 3))
    return float(shares.max() - np.median(shares))


def bright_share(gray: Column, level: int = 250) -> Column:
    return F.size(F.filter(gray, lambda x: x >= level)) / F.size(gray)


def mean_brightness(gray: Column) -> Column:
    return F.aggregate(gray, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(gray)


def measures(rasters: DataFrame) -> DataFrame:
    """capture_id, sharpness, glare, bright_share, mean_brightness."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            images = [np.asarray(g, np.float64).reshape(h, w) for g, h, w in zip(f.gray, f.height, f.width, strict=True)]
            yield pd.DataFrame({"capture_id": f.capture_id, "sharpness": [sharpness_of(g) for g in images], "glare": [glare_of(g) for g in images], "bright_share": f.bright_share, "mean_brightness": f.mean_brightness})

    df = rasters.select("capture_id", "width", "height", "gray", bright_share(F.col("gray")).alias("bright_share"), mean_brightness(F.col("gray")).alias("mean_brightness"))
    return df.mapInPandas(run, f"capture_id {df.schema['capture_id'].dataType.simpleString()}, sharpness double, glare double, bright_share double, mean_brightness double")
