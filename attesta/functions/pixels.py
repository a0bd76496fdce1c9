"""Pixel work that has no column expression: features, windows and corner runs, vectorised with NumPy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Image bytes to (width, height, grey or RGB values row by row); None where they do not decode.
Decoder = Callable[[bytes], tuple[int, int, np.ndarray] | None]


def pgm(content: bytes) -> tuple[int, int, np.ndarray] | None:
    """A decoder of binary PGM, which needs no image library."""
    parts = content.split(maxsplit=4)
    if len(parts) < 4 or parts[0] != b"P5" or not all(p.isdigit() for p in parts[1:4]):
        return None
    w, h = int(parts[1]), int(parts[2])
    body = content[len(content) - w * h :]
    return (w, h, np.frombuffer(body, np.uint8).astype(float)) if len(body) == w * h > 0 else None


def decode(files: DataFrame, decoder: Decoder, key: str = "path", content: str = "content") -> DataFrame:
    """Pixel planes of files: key, width, height, px, status (OK or UNDECODABLE). Content that does not decode gives a row, never an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, c in zip(pdf[key], pdf[content], strict=True):
                try:
                    got = decoder(bytes(c)) if c is not None else None
                except (ValueError, IndexError, OSError):
                    got = None
                out.append((k, *((got[0], got[1], got[2].tolist(), "OK") if got else (None, None, None, "UNDECODABLE"))))
            yield pd.DataFrame(out, columns=[key, "width", "height", "px", "status"])

    return files.select(key, content).mapInPandas(run, f"{key} string, width int, height int, px array<double>, status string")


def _features(px: np.ndarray) -> dict[str, float]:
    """Features of one grey plane or of three colour planes, on the last two axes."""
    planes = px if px.ndim == 3 else np.stack([px] * 3)
    grey = px if px.ndim == 2 else 0.2989 * planes[0] + 0.5870 * planes[1] + 0.1140 * planes[2]
    sharp = 0.0
    if min(grey.shape) >= 3:
        e = np.pad(grey, 1, mode="edge")
        sharp = float((e[:-2, 1:-1] + e[2:, 1:-1] + e[1:-1, :-2] + e[1:-1, 2:] - 4 * grey).var())
    n = np.bincount(np.clip(grey, 0, 255).astype(int).ravel(), minlength=256)
    p = n[n > 0] / grey.size
    mean = planes.mean(axis=(1, 2))
    std = planes.std(axis=(1, 2))
    h, w = grey.shape
    named = {"brightness": grey.mean(), "contrast": grey.std(), "sharpness": sharp, "color_temperature": mean[0] / (mean[2] + 1e-6), "entropy": float(-(p * np.log2(p)).sum()), "width": w, "height": h, "aspect_ratio": w / h}
    return named | {f"{c}_{k}": v for k, vs in (("mean", mean), ("std", std)) for c, v in zip(("red", "green", "blue"), vs, strict=True)}


def image_features(images: DataFrame, key: str, px: str, width: int, height: int) -> DataFrame:
    """The fourteen features of each grey image, as a long table: key, feature, value (rounded to four digits)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, f, float(np.floor(v * 1e4 + 0.5) / 1e4)) for k, x in zip(pdf[key], pdf[px], strict=True) for f, v in _features(np.asarray(x, float).reshape(height, width)).items()]
            yield pd.DataFrame(rows, columns=[key, "feature", "value"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, px).mapInPandas(run, f"{key} {kind}, feature string, value double")


def window_signatures(images: DataFrame, key: str, px: str, width: int, height: int, *, patch: int = 4) -> DataFrame:
    """Signatures of sliding windows: key, x, y, signature, ones (set bits; null for solid windows).

    Windows at outer corners are left out, as are those of little contrast and those with a degenerate hash.
    """

    def signature(w: np.ndarray, mean: float) -> tuple[str, int | None] | None:
        v, m = w.var(), w.mean()
        if v < 10 and m < 5 and mean > 20:
            return "SOLID_BLACK", None
        if v < 10 and m > 250 and mean < 235:
            return "SOLID_WHITE", None
        if v < 80:
            return None
        bits = (w[:, :-1] > w[:, 1:]).ravel()
        ones = int(bits.sum())
        low = max(1, len(bits) // 10)
        return None if ones < low or ones > len(bits) - low else (np.packbits(bits).tobytes().hex(), ones)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, patch // 4)
        xs = sorted({*range(0, width - patch + 1, step), width - patch})
        ys = sorted({*range(0, height - patch + 1, step), height - patch})
        corners = {(x, y) for x in (0, width - patch) for y in (0, height - patch)}
        for pdf in batches:
            rows = []
            for k, v in zip(pdf[key], pdf[px], strict=True):
                grid = np.asarray(v, float).reshape(height, width)
                mean = grid.mean()
                for y in ys:
                    for x in xs:
                        if (x, y) not in corners and (got := signature(grid[y : y + patch, x : x + patch], mean)):
                            rows.append((k, x, y, *got))
            yield pd.DataFrame(rows, columns=[key, "x", "y", "signature", "ones"]).astype({"ones": "Int32"})

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, px).mapInPandas(run, f"{key} {kind}, x int, y int, signature string, ones int")


def corner_run(px: np.ndarray, least: int = 12, most: int = 80, spread: float = 35.0) -> tuple[str, int, int] | None:
    """The first corner (TL, TR, BL, BR) that begins a solid bright or dark block: its name, width and height."""
    h, w = px.shape
    for name, y, x in (("TL", 0, 0), ("TR", 0, w - 1), ("BL", h - 1, 0), ("BR", h - 1, w - 1)):
        v = px[y, x]
        if not (v > 220 or v < 35):
            continue
        row = px[y, :: 1 if x == 0 else -1][: most + 1]
        col = px[:: 1 if y == 0 else -1, x][: most + 1]
        length = lambda line: int(np.argmax(np.abs(line - v) > spread)) if (np.abs(line - v) > spread).any() else len(line)  # noqa: B023, E731
        a, b = length(row), length(col)
        if least <= a <= most and least <= b <= most:
            return name, a, b
    return None


def corner_runs(images: DataFrame, key: str, px: str, width: int, height: int, *, least: int = 12) -> DataFrame:
    """``images`` with corner, corner_width and corner_height (null where no corner stands out)."""

    @F.pandas_udf("corner string, corner_width int, corner_height int")
    def find(values: pd.Series) -> pd.DataFrame:
        got = [corner_run(np.asarray(v, float).reshape(height, width), least) or (None, None, None) for v in values]
        return pd.DataFrame(got, columns=["corner", "corner_width", "corner_height"]).astype({"corner_width": "Int32", "corner_height": "Int32"})

    return images.withColumn("_c", find(F.col(px).cast("array<double>"))).select(*images.columns, "_c.*")


def corner_boxes(found: DataFrame, px: str, width: int, height: int) -> DataFrame:
    """``found`` (see :func:`corner_runs`) with box (x, y, w, h), box_mean and box_std of the values inside it; null without a corner."""
    w, h = F.least("corner_width", F.lit(width)), F.least("corner_height", F.lit(height))
    x = F.when(F.col("corner").endswith("R"), width - w).otherwise(0)
    y = F.when(F.col("corner").startswith("B"), height - h).otherwise(0)
    inside = F.filter(px, lambda v, i: (i % width >= x) & (i % width < x + w) & (F.floor(i / width) >= y) & (F.floor(i / width) < y + h))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v.cast("double"))) / F.size(a)
    mean = total(F.col("_box"), lambda v: v)
    boxed = found.withColumn("_box", F.when(F.col("corner").isNotNull(), inside)).withColumn("_mean", mean)
    deviation = F.sqrt(total(F.col("_box"), lambda v: (v - F.col("_mean")) * (v - F.col("_mean"))))
    there = F.col("corner").isNotNull()
    return boxed.select(*found.columns, F.when(there, F.array(x.cast("int"), y.cast("int"), w, h)).alias("box"), F.round("_mean", 2).alias("box_mean"), F.round(deviation, 4).alias("box_std"))


def planes(frames: DataFrame, decoder: Decoder, content: str = "content") -> DataFrame:
    """``frames``, a table or a stream, with px: decoded once; null where the content does not decode."""

    @F.pandas_udf("array<double>")
    def values(data: pd.Series) -> pd.Series:
        got = [decoder(bytes(c)) if c is not None else None for c in data]
        return pd.Series([g[2].tolist() if g else None for g in got], dtype=object)

    return frames.withColumn("px", values(content))


def variance(px: str) -> Column:
    """The population variance of an array of values."""
    mean = F.aggregate(px, F.lit(0.0), lambda s, v: s + v) / F.size(px)
    return F.aggregate(F.transform(px, lambda v: v * v), F.lit(0.0), lambda s, v: s + v) / F.size(px) - mean * mean
