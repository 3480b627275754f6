"""Frame kernels that numpy alone can express, as batches of frames.

Input rows hold a frame as its bytes (height x width x 3, blue green red).
Optical flow, edge maps and face detection need an image library and are not
provided; their figures enter through the frame table instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = (
    "brightness double, brightness_std double, contrast double, overexposed_pct double, underexposed_pct double, saturation double, top_brightness double, bottom_brightness double, "
    "variance double, texture_score double, sharpness double, center_sharpness double, edge_sharpness double, focus_ratio double"
)


def _convolved(x: np.ndarray, kernel: tuple[tuple[int, ...], ...]) -> np.ndarray:
    """3x3 correlation with mirrored borders."""
    p = np.pad(x, 1, mode="reflect")
    h, w = x.shape
    return sum((k * p[i : i + h, j : j + w] for i, row in enumerate(kernel) for j, k in enumerate(row) if k), np.zeros_like(x))


def laplacian_variance(x: np.ndarray) -> float:
    return float(_convolved(x, ((0, 1, 0), (1, -4, 1), (0, 1, 0))).var()) if min(x.shape) > 1 else 0.0


def texture(gray: np.ndarray) -> float:
    """How even the gradient of a picture is: 1 / (1 + cv); a flat one is halfway."""
    step = max(1, min(gray.shape) // 64)
    small = gray[::step, ::step]
    dx, dy = _convolved(small, ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))), _convolved(small, ((-1, -2, -1), (0, 0, 0), (1, 2, 1)))
    size = np.hypot(dx, dy)
    return 0.5 if size.std() < 1 else float(1 / (1 + size.std() / (size.mean() + 1e-3)))


def frame_figures(frame: np.ndarray) -> tuple[float, ...]:
    """The figures of COLUMNS for one frame."""
    bgr = frame.astype(np.float64)
    value, low = bgr.max(axis=2), bgr.min(axis=2)
    gray = bgr @ np.array([0.114, 0.587, 0.299])
    h, w = gray.shape
    mean, std = value.mean() / 255, value.std() / 255
    saturation = np.divide(value - low, value, out=np.zeros_like(value), where=value > 0).mean()
    middle = gray[h // 4 : h - h // 4, w // 4 : w - w // 4]
    borders = (gray[: h // 4], gray[h - h // 4 :], gray[:, : w // 4], gray[:, w - w // 4 :])
    centre, edge = laplacian_variance(middle), float(np.mean([laplacian_variance(b) for b in borders if b.size]))
    return (
        mean, std, std / (mean + 0.001), float((value > 250).mean()), float((value < 5).mean()), float(saturation), gray[: h // 3].mean() / 255, gray[h - h // 3 :].mean() / 255,
        float(gray.var()), texture(gray), laplacian_variance(gray), centre, edge, centre / (edge + 0.001),
    )


def measure_frames(frames: DataFrame) -> DataFrame:
    """(video_id, frame_idx, figures) of rows (video_id, frame_idx, height, width, pixels binary)."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [frame_figures(np.frombuffer(p, dtype=np.uint8).reshape(h, w, 3)) for p, h, w in zip(batch.pixels, batch.height, batch.width, strict=True)]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "video_id", batch.video_id.to_numpy())
            out.insert(1, "frame_idx", batch.frame_idx.to_numpy())
            yield out

    return frames.mapInPandas(run, f"video_id string, frame_idx int, {COLUMNS}")


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("dominant_frequency", "frequency_power", "tremor_power")]))
def _spectrum(histories: pd.Series, fps: pd.Series) -> pd.DataFrame:
    out = []
    for values, rate in zip(histories, fps, strict=True):
        if values is None or len(values) < 10:
            out.append((None, None, None))
            continue
        x = np.asarray(values, dtype=np.float64)
        power, bins = np.abs(np.fft.fft(x - x.mean())), np.fft.fftfreq(len(x), 1 / rate)
        power, bins = power[bins > 0], bins[bins > 0]
        top = int(power.argmax())
        out.append((float(bins[top]), float(power[top]), float(power[(bins >= 5) & (bins <= 15)].sum() / (power.sum() + 0.001))))
    return pd.DataFrame(out, columns=["dominant_frequency", "frequency_power", "tremor_power"])


def motion_spectrum(history: Column, fps: float = 10.0) -> Column:
    """struct of the leading frequency, its power and the share of tremor in a history of motion; null below ten values."""
    return _spectrum(history, F.lit(float(fps)))
