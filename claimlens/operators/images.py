"""Image statistics and forensic signals on decoded pixels, in numpy; decoding is an adapter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clip01(x: float) -> float:
    return float(min(1.0, max(0.0, x)))


def laplacian_variance(gray: np.ndarray) -> float:
    g = np.pad(gray.astype(np.float64), 1, mode="reflect")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def quality(gray: np.ndarray, blur_at: float = 80.0, least: int = 200) -> tuple[float, str]:
    """Score of focus, contrast, brightness and size, and its verdict."""
    h, w = gray.shape
    focus = min(1.0, laplacian_variance(gray) / (4 * blur_at))
    bright = 1.0 - abs(float(gray.mean()) - 127.5) / 127.5
    contrast = min(1.0, float(gray.std()) / 80.0)
    size = min(1.0, min(h, w) / least)
    score = clip01(0.45 * focus + 0.25 * contrast + 0.20 * bright + 0.10 * size)
    names = ((0.30, "REJECTED"), (0.50, "POOR"), (0.70, "ACCEPTABLE"), (0.85, "GOOD"))
    return score, next((n for at, n in names if score < at), "EXCELLENT")


def flags(gray: np.ndarray) -> dict:
    mean, glare = float(gray.mean()), float((gray >= 250).mean())
    return {"blurry": laplacian_variance(gray) < 80.0, "glare": glare > 0.08, "blank": mean < 15.0 or mean > 245.0, "too_small": min(gray.shape) < 300}


def is_blank(gray: np.ndarray, least: float = 3.0) -> bool:
    return float(gray.std()) < least


def gray_of(rgb: np.ndarray) -> np.ndarray:
    return rgb if rgb.ndim == 2 else np.rint(rgb @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _resampled(pixels: np.ndarray, size: int) -> np.ndarray:
    """Rows averaged over size equal stretches; a row that two stretches share counts in each by its part."""
    total = np.concatenate([np.zeros((1, *pixels.shape[1:])), np.cumsum(pixels, axis=0, dtype=np.float64)])
    at = np.linspace(0, len(pixels), size + 1)
    low = np.minimum(at.astype(np.int64), len(pixels) - 1)
    part = (at - low).reshape(-1, *[1] * (pixels.ndim - 1))
    upto = total[low] + part * (total[low + 1] - total[low])
    return np.diff(upto, axis=0) * size / len(pixels)


def resized(pixels: np.ndarray, edge: int = 1600, whole: bool = True) -> np.ndarray:
    """Downscaled by area until the long edge is edge; never up.  whole: sizes are rounded, otherwise cut off."""
    h, w = pixels.shape[:2]
    if max(h, w) <= edge:
        return pixels
    fit = (lambda n: max(1, round(n * edge / max(h, w)))) if whole else (lambda n: max(1, int(n * edge / max(h, w))))
    rows = _resampled(pixels, fit(h))
    out = _resampled(rows.swapaxes(0, 1), fit(w)).swapaxes(0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def spectrum(gray: np.ndarray) -> float:
    """How much flatter than a natural image's the radial amplitude spectrum falls in its middle band."""
    gray = resized(gray, 1024, whole=False)
    h, w = gray.shape
    amplitude = np.abs(np.fft.fftshift(np.fft.fft2(gray.astype(np.float32)))) + 1e-8
    r = np.hypot(*np.ogrid[-(h // 2) : h - h // 2, -(w // 2) : w - w // 2]).astype(np.int64).ravel()
    mean = np.bincount(r, amplitude.ravel()) / np.maximum(np.bincount(r), 1)
    band = np.arange(4, min(len(mean), max(8, min(h, w) // 4)))
    if len(band) < 8 or (mean[band] <= 0).any():
        return 0.0
    return clip01((np.polyfit(np.log(band), np.log(mean[band]), 1)[0] + 2.2) / 1.2)


def noise(gray: np.ndarray) -> float:
    """Residual behind a 3x3 median: too smooth or too rough."""
    g = np.pad(gray, 1, mode="edge")
    h, w = gray.shape
    stack = np.stack([g[i : i + h, j : j + w] for i in range(3) for j in range(3)])
    std = float((gray.astype(np.float32) - np.partition(stack, 4, axis=0)[4]).std())
    return clip01((1.5 - std) / 1.5) if std < 1.5 else clip01((std - 14) / 10) if std > 14 else 0.0


def colour_entropy(rgb: np.ndarray) -> float:
    """Bits of the joint histogram of 16 levels a channel (of 200,000 drawn pixels of a larger image)."""
    pixels = rgb.reshape(-1, 3)
    if len(pixels) > 200_000:
        pixels = pixels[np.random.default_rng(0).choice(len(pixels), 200_000, replace=False)]
    q = np.minimum(pixels.astype(np.int64) * 16 // 255, 15)
    n = np.bincount(q @ np.array([256, 16, 1]), minlength=4096)
    p = n[n > 0] / n.sum()
    return clip01((8 + float((p * np.log2(p)).sum())) / 3)


def saturation(rgb: np.ndarray) -> float:
    high, low = rgb.max(axis=2).astype(np.float64), rgb.min(axis=2).astype(np.float64)
    mean = float(np.rint(255 * (high - low) / np.maximum(high, 1)).mean())
    return clip01((mean - 160) / 60) if mean > 160 else 0.6 * clip01((15 - mean) / 15) if mean < 15 else 0.0


def edges(gray: np.ndarray, low: int = 60, high: int = 160) -> np.ndarray:
    """Canny edges: ridges of the gradient above low that reach one above high."""
    g = np.pad(gray.astype(np.int64), 1, mode="edge")
    smooth_y, smooth_x = g[:-2] + 2 * g[1:-1] + g[2:], g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    dx, dy = smooth_y[:, 2:] - smooth_y[:, :-2], smooth_x[2:] - smooth_x[:-2]
    strength = np.abs(dx) + np.abs(dy)
    h, w = gray.shape
    framed = np.pad(strength, 1)
    near = lambda y, x: framed[1 + y : 1 + y + h, 1 + x : 1 + x + w]
    slope = np.tan(np.pi / 8)
    flat, steep = np.abs(dy) < slope * np.abs(dx), np.abs(dy) * slope > np.abs(dx)
    along = np.where((dx < 0) == (dy < 0), (strength > near(-1, -1)) & (strength > near(1, 1)), (strength > near(-1, 1)) & (strength > near(1, -1)))
    along = np.where(flat, (strength > near(0, -1)) & (strength >= near(0, 1)), along)
    ridge = np.where(steep, (strength > near(-1, 0)) & (strength >= near(1, 0)), along) & (strength > low)
    open_ = np.pad(ridge, 1).ravel()
    found = np.pad(ridge & (strength > high), 1).ravel()
    around = np.array([y * (w + 2) + x for y in (-1, 0, 1) for x in (-1, 0, 1) if y or x])
    front = np.flatnonzero(found)
    while len(front):
        reach = np.unique(front[:, None] + around)
        front = reach[open_[reach] & ~found[reach]]
        found[front] = True
    return found.reshape(h + 2, w + 2)[1:-1, 1:-1]


def edge_density(share: float) -> float:
    return clip01((0.02 - share) / 0.02) if share < 0.02 else clip01((share - 0.28) / 0.15) if share > 0.28 else 0.0


# The JPEG standard's example quantisation tables for luminance and chrominance.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
_COSINE = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])


def _quantised(plane: np.ndarray, table: tuple[int, ...], quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    q = np.clip((np.array(table) * scale + 50) // 100, 1, 255).reshape(8, 8)
    h, w = plane.shape
    p = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    blocks = p.reshape(p.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
    kept = np.rint(_COSINE @ blocks @ _COSINE.T / q) * q
    back = (_COSINE.T @ kept @ _COSINE).swapaxes(1, 2).reshape(p.shape)
    return np.clip(np.rint(back + 128), 0, 255)[:h, :w]


def _doubled(plane: np.ndarray, size: int) -> np.ndarray:
    """Twice the rows, each a quarter of the way to its neighbour."""
    p = np.pad(plane, ((1, 1), (0, 0)), mode="edge")
    return np.stack([0.75 * plane + 0.25 * p[:-2], 0.75 * plane + 0.25 * p[2:]], axis=1).reshape(-1, plane.shape[1])[:size]


def recompressed(rgb: np.ndarray, quality: int = 90) -> np.ndarray:
    """The pixels after a pass through JPEG with halved chroma: what its lossy steps change, without its coding."""
    r, g, b = np.moveaxis(rgb.astype(np.float64), 2, 0)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    h, w = y.shape
    planes = [_quantised(np.rint(y), LUMA, quality)]
    for c in ((b - y) / 1.772 + 128, (r - y) / 1.402 + 128):
        c = np.pad(np.rint(c), ((0, h % 2), (0, w % 2)), mode="edge")
        small = _quantised(np.rint((c[::2, ::2] + c[1::2, ::2] + c[::2, 1::2] + c[1::2, 1::2]) / 4), CHROMA, quality)
        planes.append(np.rint(_doubled(_doubled(small, h).T, w).T) - 128)
    y, cb, cr = planes
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def error_level(rgb: np.ndarray) -> float:
    """How even the error of another JPEG pass is: that of photographs varies with their edges."""
    off = np.abs(rgb.astype(np.float64) - recompressed(rgb))
    return clip01((1.2 - float(off.std()) / max(float(off.mean()), 1e-3)) / 0.8)


def layout_anchor(rgb: np.ndarray, code_at: tuple[float, float] | None) -> float:
    """The worst of three checks of a card: its square code's place, its aspect, and edges in its top quarter.

    code_at is the code's centre in pixels, as an adapter found it; None: no code.
    """
    h, w = rgb.shape[:2]
    if min(h, w) < 100:
        return 0.5
    placed = 1.0 if code_at is None else 0.0 if code_at[0] >= 0.55 * w and code_at[1] >= 0.35 * h else 0.6
    off = abs(w / h - 1.59) / 1.59
    aspect = clip01((off - 0.20) / 0.30 + 0.5) if off > 0.20 else 0.0
    top = float(edges(gray_of(rgb[: max(1, h // 4)])).mean())
    return max(placed, aspect, 1.0 if top < 0.04 else 0.6 if top < 0.08 else 0.0)


def jpeg_tables(content: bytes) -> int:
    """Quantisation tables of a JPEG, read from its markers."""
    at, tables = 2, 0
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        if content[at + 1] == 0xDB:
            k, end = at + 4, at + 2 + size
            while k < end:
                k += 1 + (128 if content[k] >> 4 else 64)
                tables += 1
        at += 2 + size
    return tables


def jpeg_history(extension: str, content: bytes) -> float:
    if extension == "png":
        return 0.55
    if extension == "webp":
        return 0.45
    if extension not in ("jpg", "jpeg"):
        return 0.0
    n = jpeg_tables(content)
    return 0.45 if n == 0 else 0.30 if n == 1 else 0.0


Decoder = Callable[[bytes], np.ndarray | None]


def signals(files: DataFrame, decode: Decoder, find_code: Callable[[np.ndarray], tuple[float, float] | None] | None = None) -> DataFrame:
    """(path, document_type, code, score) of binaryFile rows, for the signals that pixels give.

    decode turns bytes into RGB, None if it cannot: such a file has no row, and its
    verdict is INSUFFICIENT_DATA.  find_code gives the centre of a square code.
    document_type is null where files have none; the card layout is checked for AADHAAR only.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content, kind in zip(frame["path"], frame["content"], frame["document_type"]):
                rgb = None if content is None else decode(bytes(content))
                if rgb is None or not rgb.size:
                    continue
                rgb = rgb if rgb.ndim == 3 else np.repeat(rgb[:, :, None], 3, axis=2)
                gray = gray_of(rgb)
                scores = {
                    "FFT_SPECTRUM": spectrum(gray), "ELA": error_level(rgb), "NOISE_RESIDUAL": noise(gray), "COLOR_ENTROPY": colour_entropy(rgb), "SATURATION": saturation(rgb),
                    "JPEG_HISTORY": jpeg_history(path.rpartition(".")[2].lower(), bytes(content)), "EDGE_DENSITY": edge_density(float(edges(gray).mean())),
                }
                if kind and kind.upper() == "AADHAAR":
                    scores["LAYOUT_ANCHOR"] = layout_anchor(rgb, find_code(rgb) if find_code else None)
                out += [(path, kind, code, score) for code, score in scores.items()]
            yield pd.DataFrame(out, columns=["path", "document_type", "code", "score"])

    kind = F.col("document_type") if "document_type" in files.columns else F.lit(None)
    return files.select("path", "content", kind.cast("string").alias("document_type")).mapInPandas(run, "path string, document_type string, code string, score double")
