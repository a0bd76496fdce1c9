"""Scoring of feature batches and perturbed probes, in Arrow batches with the model held by the worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A model: a matrix of rows to a matrix of outputs.
Model = Callable[[np.ndarray], np.ndarray]


def score(rows: DataFrame, key: str, features: str, load: Callable[[], Model], *, keep: list[str] | None = None) -> DataFrame:
    """key, kept columns and ``output``: the model's output for each row. ``load`` runs once a task; rows pass in Arrow batches."""
    kept = [key, *(keep or [])]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            if len(pdf):
                out = model(np.stack([np.asarray(v, float) for v in pdf[features]]))
                yield pdf[kept].assign(output=list(out))

    return rows.select(*kept, features).mapInPandas(run, f"{kinds}, output array<double>")


def onnx(content: bytes) -> Callable[[], Model]:
    """Loads an ONNX model of one input on the worker; onnxruntime is needed only there."""

    def load() -> Model:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        session = onnxruntime.InferenceSession(content, options, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda x: np.asarray(session.run(None, {name: x.astype(np.float32)})[0], float)

    return load


def _bytes(g: np.ndarray) -> np.ndarray:
    """Pixel values: within 0 and 255, fractions cut off."""
    return np.floor(np.clip(g, 0, 255))


def _noisy(g: np.ndarray, sigma: float, shape: tuple[int, int]) -> np.ndarray:
    """Noise for each square, seeded by the sum of its pixels, so that it is the same on every run."""
    return np.stack([np.random.default_rng(int(x.sum()) % ((1 << 31) - 1)).normal(0, sigma, shape) for x in g])


def _blur(g: np.ndarray, sigma: float) -> np.ndarray:
    x = np.arange(-4, 5)
    k = np.exp(-(x**2) / (2 * sigma**2))
    k /= k.sum()
    for axis in (1, 2):
        lines = np.pad(np.moveaxis(g, axis, 2), ((0, 0), (0, 0), (4, 4)), mode="edge")
        # All lines in one convolution; what reaches from a line into the next is left out.
        whole = np.append(np.convolve(lines.ravel(), k, mode="valid"), np.zeros(8)).reshape(lines.shape)
        g = np.moveaxis(whole[:, :, :-8], 2, axis)
    return _bytes(g + 0.5)


def _occluded(g: np.ndarray, share: int = 4) -> np.ndarray:
    out = g.copy()
    out[:, : max(1, g.shape[1] // share), : max(1, g.shape[2] // share)] = 0
    return out


def _corner(g: np.ndarray, patch: int) -> tuple[slice, ...]:
    return (slice(None), *(slice(max(0, n - patch), n) for n in g.shape[1:]))


def _corner_trigger(g: np.ndarray, patch: int = 4) -> np.ndarray:
    """A checkerboard, white first, in the lower right corner."""
    out, at = g.copy(), _corner(g, patch)
    rows, cols = np.indices(out[at].shape[1:])
    out[at] = np.where((rows + cols) % 2 == 0, 255, 0)
    return out


def _matched_noise(g: np.ndarray, patch: int = 4, sigma: float = 50.0) -> np.ndarray:
    """Noise over the area that the corner trigger takes."""
    out, at = g.copy(), _corner(g, patch)
    out[at] = _bytes(g[at] + _noisy(g, sigma, (patch, patch))[:, : out[at].shape[1], : out[at].shape[2]])
    return out


#: The perturbations of probes, on a stack of squares of values from 0 to 255.
BATTERY: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "identity": lambda g: g,
    "noise": lambda g: _bytes(g + _noisy(g, 20.0, g.shape[1:])),
    "blur": lambda g: _blur(g, 1.5),
    "contrast": lambda g: _bytes(g * 1.3),
    "brightness": lambda g: _bytes(g + 40),
    "rotation": lambda g: np.rot90(g, axes=(1, 2)),
    "occlusion": _occluded,
    "corner_trigger": _corner_trigger,
    "matched_noise": _matched_noise,
}


#: Rows that a worker holds as squares at a time, whatever the size of Arrow batches.
_STEP = 512


def _stacks(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys (first column), which of the rows have pixels (second column), and the squares of those that do."""
    for batch in batches:
        for at in range(0, batch.num_rows, _STEP):
            keys, px = batch.slice(at, _STEP).columns
            there = px.is_valid().to_numpy(zero_copy_only=False)
            if pc.any(pc.not_equal(pc.list_value_length(px), side * side)).as_py():
                raise ValueError(f"pixels that are no square of {side}")
            if there.any():
                yield keys, there, np.asarray(px.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, side, side)
            else:
                yield keys, there, np.empty((0, side, side))


def _lists(values: np.ndarray, there: np.ndarray) -> pa.Array:
    """A list for each row of a matrix, null where ``there`` is false."""
    flat = np.ascontiguousarray(values, float).reshape(len(values), -1)
    out = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
    return out if there.all() else out.take(pa.array(np.cumsum(there) - 1, pa.int64(), mask=~there))


def _squares(probes: DataFrame, key: str, pixels: str) -> DataFrame:
    return probes.select(key, F.col(pixels).cast("array<double>").alias("_px"))


def perturb(probes: DataFrame, key: str, pixels: str, side: int, kinds: list[str]) -> DataFrame:
    """key, perturbation, px: every probe in every listed form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, there, g in _stacks(batches, side):
            for k in kinds:
                made = BATTERY[k](g) if len(g) else g
                yield pa.RecordBatch.from_arrays([keys, pa.array([k] * len(keys), pa.string()), _lists(made, there)], [key, "perturbation", "px"])

    return _squares(probes, key, pixels).mapInArrow(run, f"`{key}` {probes.schema[key].dataType.simpleString()}, perturbation string, px array<double>")


def score_perturbed(probes: DataFrame, key: str, pixels: str, side: int, kinds: list[str], load: Callable[[], Model]) -> DataFrame:
    """key, and for each listed form a column of that name: the model's output for the probe in that form; null where it has no pixels.

    Forms are made and scored in one worker, a few hundred probes at a time; only outputs leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for keys, there, g in _stacks(batches, side):
            outputs = [model(BATTERY[k](g).reshape(len(g), -1)) if len(g) else g for k in kinds]
            yield pa.RecordBatch.from_arrays([keys, *[_lists(out, there) for out in outputs]], [key, *kinds])

    shown = ", ".join(f"`{k}` array<double>" for k in kinds)
    return _squares(probes, key, pixels).mapInArrow(run, f"`{key}` {probes.schema[key].dataType.simpleString()}, {shown}")
