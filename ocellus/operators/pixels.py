"""Pixel filters over windows held as bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _neighbours(image: np.ndarray, radius: int = 1) -> np.ndarray:
    """The square around each pixel, borders mirrored: (k, k, h, w)."""
    padded = np.pad(image.astype(np.float64), radius, mode="reflect")
    k = 2 * radius + 1
    h, w = image.shape
    return np.stack([np.stack([padded[i : i + h, j : j + w] for j in range(k)]) for i in range(k)])


def _weighted(image: np.ndarray, kernel) -> np.ndarray:
    kernel = np.asarray(kernel, dtype=np.float64)
    return np.einsum("ij,ijhw->hw", kernel, _neighbours(image, kernel.shape[0] // 2))


def invert(image: np.ndarray) -> np.ndarray:
    return 255 - image


def sobel(image: np.ndarray, overflow: str = "wrap") -> np.ndarray:
    """Gradient magnitude; values beyond 255 wrap around or are clipped."""
    x = _weighted(image, [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    y = _weighted(image, [[-1, -2, -1], [0, 0, 0], [1, 2, 1]])
    size = np.hypot(x, y)
    return (np.minimum(size, 255) if overflow == "clip" else np.floor(size) % 256).astype(np.uint8)


def gaussian(image: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    radius = max(1, int(round(3 * sigma)))
    line = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    line /= line.sum()
    return np.clip(np.rint(_weighted(image, np.outer(line, line))), 0, 255).astype(np.uint8)


def median(image: np.ndarray, radius: int = 1) -> np.ndarray:
    around = _neighbours(image, radius)
    return np.median(around.reshape(-1, *image.shape), axis=0).astype(np.uint8)


def laplacian(image: np.ndarray) -> np.ndarray:
    return np.clip(np.abs(_weighted(image, [[0, 1, 0], [1, -4, 1], [0, 1, 0]])), 0, 255).astype(np.uint8)


def black_share(image: np.ndarray) -> float:
    return float((image == 0).mean()) if image.size else 1.0


FILTERS = {"invert": invert, "sobel": sobel, "gaussian": gaussian, "median": median, "laplacian": laplacian}


def apply_filters(windows: DataFrame, names: list[str], max_black: float = 0.95) -> DataFrame:
    """Grey windows (h, w, pixels) after the named filters in turn; mostly black windows are dropped before any work."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                image = np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w)
                if black_share(image) >= max_black:
                    continue
                for name in names:
                    image = FILTERS[name](image)
                out.append(r._replace(pixels=image.tobytes()))
            yield pd.DataFrame(out, columns=b.columns)

    return windows.mapInPandas(run, windows.schema)


def stitch(windows: DataFrame, on: str = "slide_id") -> DataFrame:
    """(on, y, x, value) of a canvas from windows placed at x, y; where they overlap the later one in (y, x) order shows."""
    from pyspark.sql import functions as F

    schema = f"{on} long, y long, x long, value int, wy long, wx long"

    def spread(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                image = np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w)
                yy, xx = np.mgrid[0 : r.h, 0 : r.w]
                yield pd.DataFrame({on: getattr(r, on), "y": yy.ravel() + r.y, "x": xx.ravel() + r.x, "value": image.ravel().astype(int), "wy": r.y, "wx": r.x})

    pixels = windows.mapInPandas(spread, schema)
    return pixels.groupBy(on, "y", "x").agg(F.max_by("value", F.struct("wy", "wx")).alias("value"))
