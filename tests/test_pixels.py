"""Pixel signals and enhancement against hand-made pictures and plain loops."""

import numpy as np
import pytest

from claimlens.operators import enhance, images

NOISE = np.random.default_rng(5).integers(0, 256, (40, 57)).astype(np.uint8)


def windows(plane, size):
    p = np.pad(plane, size // 2, mode="edge")
    return np.lib.stride_tricks.sliding_window_view(p, (size, size)).reshape(*plane.shape, -1)


def test_window_filters():
    assert (enhance.median(NOISE, 21) == np.median(windows(NOISE, 21), axis=2)).all()
    assert (enhance.dilated(NOISE, 7) == windows(NOISE, 7).max(axis=2)).all()


def test_area_resize():
    assert images.resized(NOISE, 100) is NOISE
    half = NOISE[:, :56].reshape(20, 2, 28, 2).mean(axis=(1, 3))
    assert (images.resized(NOISE[:, :56], 28) == np.rint(half)).all()


def test_edges_are_thin_and_follow_weak_parts():
    p = np.zeros((60, 60), np.uint8)
    p[:, 30:] = np.linspace(20, 120, 60).astype(np.uint8)[:, None]
    e = images.edges(p)
    assert (e.sum(axis=1)[5:55] == 1).all()  # the whole side, though its start is weak
    assert not images.edges(np.where(np.arange(60) < 30, 0, 20).astype(np.uint8)[None].repeat(60, 0)).any()


def test_scores():
    flat = np.full((128, 128, 3), (10, 200, 90), np.uint8)
    assert images.error_level(flat) == 1.0 and (images.recompressed(flat) == flat).all()
    assert images.saturation(flat) == 1.0 and images.colour_entropy(flat) == 1.0
    assert images.edge_density(0.01) == pytest.approx(0.5) and images.edge_density(0.355) == pytest.approx(0.5) and images.edge_density(0.1) == 0
    loud = np.where(np.random.default_rng(2).random((200, 200)) < 0.5, 100, 140).astype(np.uint8)
    assert 0 < images.noise(loud) <= 1
    card = np.random.default_rng(3).integers(0, 256, (200, 318, 3)).astype(np.uint8)
    assert images.layout_anchor(card, (250, 120)) == 0.0 and images.layout_anchor(card, (20, 120)) == 0.6 and images.layout_anchor(card, None) == 1.0
    assert images.layout_anchor(card[:50], None) == 0.5


def test_skew_is_found_and_undone():
    p = np.full((200, 300), 255, np.uint8)
    p[80:120, 60:240] = 0
    tilted = enhance.rotated(p, -7.0)
    assert enhance.skew(p) == pytest.approx(0, abs=0.3) and enhance.skew(tilted) == pytest.approx(7.0, abs=0.5)
    assert abs(enhance.skew(enhance.deskewed(tilted))) < 0.6


def test_light():
    p = np.full((60, 60), 120, np.uint8)
    p[:, 30:] = 240
    p[30, 15], p[30, 45] = 30, 60
    out = enhance.unshadowed(p)
    assert out[5, 5] == out[5, 55] == 255 and out[30, 15] == out[30, 45] == 64
    spot = np.full((40, 40, 3), 100, np.uint8)
    spot[18:22, 18:22] = 255
    assert (enhance.deglared(spot) == 100).all()
    assert abs(enhance.exposed(np.full((9, 9), 90, np.uint8)).mean() - 140) <= 1 and enhance.exposed(p[:5, :5] + 15).mean() == 135
    assert (enhance.balanced(np.full((4, 4, 3), (60, 90, 120), np.uint8)) == 90).all()


def test_colour_and_contrast():
    flat = np.full((64, 64, 3), (70, 120, 180), np.uint8)
    assert (enhance.denoised(flat) == flat).all() and (enhance.sharpened(flat) == flat).all()
    ramp = np.tile(np.arange(100, 164, dtype=np.uint8), (64, 1))
    assert np.ptp(enhance.equalised(ramp)) > np.ptp(ramp)
    page = np.full((80, 80), 200, np.uint8)
    page[40, 20:60] = 20
    assert (enhance.binarised(page)[40, 20:60] == 0).all() and (enhance.binarised(page)[:20] == 255).all()


@pytest.mark.parametrize("shape", [(90, 140, 3), (90, 140)])
def test_all_stages(shape):
    p = np.random.default_rng(7).integers(30, 90, shape).astype(np.uint8)
    out, applied = enhance.prepared(p)
    assert out.shape == p.shape and out.dtype == np.uint8
    assert applied[:3] == ["resize", "deskew", "shadow-remove"] and applied[-3:] == ["bilateral-denoise", "clahe-lab", "unsharp"]


def test_signals_of_files(spark):
    pixels = np.random.default_rng(3).integers(0, 256, (120, 190, 3)).astype(np.uint8)
    files = spark.createDataFrame([("a.png", b"x", "AADHAAR"), ("b.png", b"", None), ("c.png", b"x", "PAN")], "path string, content binary, document_type string")
    got = images.signals(files, lambda b: pixels if b else None).collect()
    assert sum(r["code"] == "LAYOUT_ANCHOR" for r in got) == 1 and {r["path"] for r in got} == {"a.png", "c.png"} and len(got) == 15
