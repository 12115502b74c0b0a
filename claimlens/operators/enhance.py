"""Enhancement of decoded pixels before recognition, in numpy: skew, shadow, glare, exposure, colour, noise, contrast."""

from __future__ import annotations

import numpy as np

from .images import gray_of, resized


def _by_channel(pixels: np.ndarray, f) -> np.ndarray:
    return f(pixels) if pixels.ndim == 2 else np.stack([f(pixels[:, :, k]) for k in range(pixels.shape[2])], axis=2)


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (x, y), by their order in x."""
    points = np.unique(points, axis=0)
    sides = []
    for run in (points, points[::-1]):
        side: list[np.ndarray] = []
        for p in run:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                side.pop()
            side.append(p)
        sides += side[:-1]
    return np.array(sides, float).reshape(-1, 2)


def threshold(gray: np.ndarray) -> int:
    """The level that parts a histogram best (largest variance between the parts)."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    apart = (mass[-1] * below / below[-1] - mass) ** 2 / np.maximum(below * above, 1e-9)
    return int(np.where((below > 0) & (above > 0), apart, -1).argmax())


def skew(gray: np.ndarray) -> float:
    """Degrees, -45 to 45, by which the smallest rectangle around the dark pixels is turned."""
    dark = 255 - gray
    rows, cols = np.nonzero(dark > threshold(dark))
    if not len(rows):
        return 0.0
    # only a row's ends can be corners of the hull
    first = np.r_[True, rows[1:] != rows[:-1]]
    ends = first | np.r_[first[1:], True]
    corners = _hull(np.stack([cols[ends], rows[ends]], axis=1))
    if len(corners) < 3:
        return 0.0
    side = np.roll(corners, -1, axis=0) - corners
    turn = np.arctan2(side[:, 1], side[:, 0])
    x = np.cos(turn)[:, None] * corners[:, 0] + np.sin(turn)[:, None] * corners[:, 1]
    y = np.cos(turn)[:, None] * corners[:, 1] - np.sin(turn)[:, None] * corners[:, 0]
    best = turn[(np.ptp(x, axis=1) * np.ptp(y, axis=1)).argmin()]
    return float((np.degrees(best) + 45) % 90 - 45)


def rotated(pixels: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the centre so that a slope of degrees becomes level; edges are continued outwards."""
    h, w = pixels.shape[:2]
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    y, x = np.ogrid[:h, :w]
    fx, fy = c * (x - w / 2) - s * (y - h / 2) + w / 2, s * (x - w / 2) + c * (y - h / 2) + h / 2
    fx, fy = np.clip(fx, 0, w - 1), np.clip(fy, 0, h - 1)
    x0, y0 = np.minimum(fx.astype(int), max(w - 2, 0)), np.minimum(fy.astype(int), max(h - 2, 0))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)

    def one(p: np.ndarray) -> np.ndarray:
        top = p[y0, x0] * (1 - fx + x0) + p[y0, x1] * (fx - x0)
        return np.rint(top * (1 - fy + y0) + (p[y1, x0] * (1 - fx + x0) + p[y1, x1] * (fx - x0)) * (fy - y0)).astype(np.uint8)

    return _by_channel(pixels, one)


def deskewed(pixels: np.ndarray, least: float = 0.5) -> np.ndarray:
    off = skew(gray_of(pixels))
    return pixels if abs(off) < least else rotated(pixels, off)


def dilated(plane: np.ndarray, size: int) -> np.ndarray:
    """The largest value of each size x size window."""
    for axis in (0, 1):
        p = np.pad(plane, [(size // 2, size // 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        plane = np.lib.stride_tricks.sliding_window_view(p, size, axis=axis).max(axis=-1)
    return plane


def _box_sum(plane: np.ndarray, size: int) -> np.ndarray:
    p = np.pad(plane, size // 2, mode="edge").astype(np.int32)
    total = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]


def median(plane: np.ndarray, size: int) -> np.ndarray:
    """The median of each size x size window, level by level: memory does not grow with the window."""
    out, open_ = np.zeros_like(plane), np.ones(plane.shape, bool)
    for level in np.unique(plane):
        reached = open_ & (_box_sum(plane <= level, size) > size * size // 2)
        out[reached] = level
        open_ &= ~reached
        if not open_.any():
            break
    return out


def unshadowed(pixels: np.ndarray) -> np.ndarray:
    """Each channel divided by its background: the median of its dilation."""

    def one(plane: np.ndarray) -> np.ndarray:
        ground = median(dilated(plane, 7), 21).astype(np.float64)
        return np.where(ground > 0, np.clip(np.rint(255.0 * plane / np.maximum(ground, 1)), 0, 255), 0).astype(np.uint8)

    return _by_channel(pixels, one)


def deglared(pixels: np.ndarray, above: int = 245, radius: int = 3) -> np.ndarray:
    """Spots brighter than above, and two pixels around, filled from their rims inwards by means of what is known within radius."""
    hole = dilated((gray_of(pixels) > above).astype(np.uint8), 5) > 0
    if not hole.any() or hole.all():
        return pixels
    out = (pixels if pixels.ndim == 3 else pixels[:, :, None]).astype(np.float64)
    h, w = hole.shape
    reach = np.array([(y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if 0 < y * y + x * x <= radius * radius])
    weight = 1 / (reach**2).sum(axis=1)
    while hole.any():
        known = np.pad(~hole, 1)
        rim = hole & (known[:-2, 1:-1] | known[2:, 1:-1] | known[1:-1, :-2] | known[1:-1, 2:])
        at = np.argwhere(rim)
        near = at[:, None, :] + reach
        inside = ((near >= 0) & (near < (h, w))).all(axis=2)
        y, x = np.clip(near[..., 0], 0, h - 1), np.clip(near[..., 1], 0, w - 1)
        by = np.where(inside & ~hole[y, x], weight, 0.0)
        out[rim] = (out[y, x] * by[..., None]).sum(axis=1) / by.sum(axis=1)[:, None]
        hole &= ~rim
    return np.rint(out).astype(np.uint8).reshape(pixels.shape)


def exposed(pixels: np.ndarray, target: float = 140.0) -> np.ndarray:
    """Gamma towards a mean of target; within eight of it nothing changes."""
    mean = float(gray_of(pixels).mean()) or 1.0
    if abs(mean - target) < 8 or mean >= 255:
        return pixels
    gamma = float(np.clip(np.log(target / 255) / np.log(mean / 255), 0.45, 2.2))
    return (255 * (np.arange(256) / 255.0) ** gamma).astype(np.uint8)[pixels]


def balanced(rgb: np.ndarray) -> np.ndarray:
    """Channels scaled to one mean."""
    if rgb.ndim != 3:
        return rgb
    means = rgb.reshape(-1, 3).mean(axis=0)
    return np.clip(rgb * ((float(means.mean()) or 1.0) / np.where(means == 0, 1.0, means)), 0, 255).astype(np.uint8)


def denoised(pixels: np.ndarray, sigma: float = 35.0, radius: int = 2) -> np.ndarray:
    """Means over a disc, by nearness in place and colour."""
    p = (pixels if pixels.ndim == 3 else pixels[:, :, None]).astype(np.float64)
    h, w = p.shape[:2]
    wide = np.pad(p, ((radius, radius), (radius, radius), (0, 0)), mode="reflect")
    total, mass = np.zeros_like(p), np.zeros((h, w, 1))
    for y in range(-radius, radius + 1):
        for x in range(-radius, radius + 1):
            if y * y + x * x <= radius * radius:
                q = wide[radius + y : radius + y + h, radius + x : radius + x + w]
                by = np.exp(-(y * y + x * x + np.abs(q - p).sum(axis=2, keepdims=True) ** 2) / (2 * sigma * sigma))
                total += by * q
                mass += by
    return np.rint(total / mass).astype(np.uint8).reshape(pixels.shape)


def blurred(plane: np.ndarray, sigma: float, size: int, border: str = "reflect") -> np.ndarray:
    kernel = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    out = np.pad(plane.astype(np.float64), size // 2, mode=border)
    for axis in (0, 1):
        out = np.lib.stride_tricks.sliding_window_view(out, size, axis=axis) @ kernel
    return out


def sharpened(pixels: np.ndarray, amount: float = 0.8) -> np.ndarray:
    """Unsharp mask."""
    soft = _by_channel(pixels, lambda p: np.rint(blurred(p, 1.2, 9)))
    return np.clip(np.rint((1 + amount) * pixels - amount * soft), 0, 255).astype(np.uint8)


def binarised(gray: np.ndarray, size: int = 31, below: float = 15) -> np.ndarray:
    """White where a pixel is above its Gaussian neighbourhood less below."""
    mean = np.rint(blurred(gray, 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size, "edge"))
    return np.where(gray > mean - below, 255, 0).astype(np.uint8)


def equalised(plane: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Histograms evened tile by tile, what is above clip times the mean count spread over all levels, and blended between tiles."""
    h, w = plane.shape
    p = np.pad(plane, ((0, -h % tiles), (0, -w % tiles)), mode="symmetric" if min(h, w) >= tiles else "edge")
    th, tw = p.shape[0] // tiles, p.shape[1] // tiles
    tile = np.repeat(np.arange(tiles), th)[:, None] * tiles + np.repeat(np.arange(tiles), tw)
    n = np.bincount((tile * 256 + p).ravel(), minlength=tiles * tiles * 256).reshape(-1, 256).astype(np.float64)
    limit = max(1.0, clip * th * tw // 256)
    n = np.minimum(n, limit) + np.maximum(n - limit, 0).sum(axis=1, keepdims=True) / 256
    table = np.rint(np.cumsum(n, axis=1) * 255 / (th * tw)).reshape(tiles, tiles, 256)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], x - x0
    at = lambda a, b: table[np.clip(a, 0, tiles - 1)[:, None], np.clip(b, 0, tiles - 1), plane]
    out = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


# sRGB to CIE XYZ, relative to the D65 white.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def contrasted(pixels: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """equalised on lightness; the two colour axes of CIE Lab stay."""
    if pixels.ndim == 2:
        return equalised(pixels, clip, tiles)
    v = pixels / 255.0
    linear = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    t = linear @ _XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    lightness = np.clip(np.rint((116 * f[..., 1] - 16) * 2.55), 0, 255).astype(np.uint8)
    mid = (equalised(lightness, clip, tiles) / 2.55 + 16) / 116
    f = np.stack([mid + f[..., 0] - f[..., 1], mid, mid - f[..., 1] + f[..., 2]], axis=2)
    t = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787) * _WHITE
    linear = np.clip(t @ np.linalg.inv(_XYZ).T, 0, 1)
    return np.rint(255 * np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)).astype(np.uint8)


def prepared(pixels: np.ndarray, deskew: bool = True, denoise: bool = True, contrast: bool = True) -> tuple[np.ndarray, list[str]]:
    """All stages in order, and the names of those applied; glare, exposure and colour only where the pixels call for them."""
    out, applied = resized(pixels), ["resize"]
    if deskew:
        out = deskewed(out)
        applied.append("deskew")
    glare = float((gray_of(out) >= 250).mean())
    out = unshadowed(out)
    applied.append("shadow-remove")
    if glare > 0.03:
        out = deglared(out)
        applied.append(f"glare-reduce({glare:.2%})")
    mean = float(gray_of(out).mean())
    if not 110 <= mean <= 170:
        out = exposed(out)
        applied.append(f"auto-exposure(mean={mean:.0f})")
    if out.ndim == 3 and float(np.ptp(out.reshape(-1, 3).mean(axis=0))) > 10:
        out = balanced(out)
        applied.append("white-balance")
    if denoise:
        out = denoised(out)
        applied.append("bilateral-denoise")
    if contrast:
        out = contrasted(out)
        applied.append("clahe-lab")
    return sharpened(out, 0.6), [*applied, "unsharp"]
