"""Drawn images whose densities are known."""

import struct
import zlib

import numpy as np
import pytest

from folioflow.operators import images


def png(path, pixels):
    """Writes rows x columns (gray) or rows x columns x 3 (red, green, blue)."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    height, width = pixels.shape[:2]
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    body = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b""))


def by_loop(image):
    """Dark spots pixel by pixel."""
    weights, out = images.bell(11, 2.0), np.zeros(image.shape, bool)
    for r in range(image.shape[0]):
        for c in range(image.shape[1]):
            rows, columns = np.clip(np.arange(r - 5, r + 6), 0, image.shape[0] - 1), np.clip(np.arange(c - 5, c + 6), 0, image.shape[1] - 1)
            mean = weights @ image[np.ix_(rows, columns)] @ weights
            out[r, c] = image[r, c] <= np.floor(mean + 0.5) - 2
    return out


def test_dark_spots_like_a_loop():
    image = np.random.default_rng(1).integers(0, 256, (30, 24))
    image[:, 12:] = 200
    assert (images.dark_spots(image) == by_loop(image)).all()


def test_edges_of_a_square():
    image = np.full((100, 100), 255)
    image[20:80, 20:80] = 0
    found = images.edges(image)
    rows, columns = np.nonzero(found)
    # a line of one pixel around the square, closed
    assert 4 * 58 <= found.sum() <= 4 * 62 and rows.min() in (19, 20) and rows.max() in (79, 80) and columns.min() in (19, 20) and columns.max() in (79, 80)
    assert not found[25:75, 25:75].any() and not images.edges(np.full((60, 60), 7)).any()
    faint = np.full((40, 40), 100)
    faint[:, 20:] = 120  # 4 * 20 is under the lower limit
    assert not images.edges(faint).any()
    faint[:, 20:] = 135  # between the limits: only with a stronger one
    assert not images.edges(faint).any()
    faint[:3, 20:] = 255
    assert images.edges(faint)[30:].any()


def test_prepared_images_are_black_and_white():
    image = np.full((60, 60), 180)
    image[10:50, 28:32] = 90
    white = images.prepared(image)
    assert not white[20:40, 29:31].any() and white[:, :20].all()


def test_measures_of_files(spark, tmp_path):
    blank, lines = np.full((80, 120), 255), np.full((80, 120), 255)
    lines[60::4, :] = 0  # rows of text in the bottom quarter
    colours = np.zeros((60, 60, 3), int)
    colours[:, :30, 0], colours[:, 30:, 2] = 255, 255
    for name, pixels in (("blank", blank), ("lines", lines), ("colours", colours), ("small", np.zeros((20, 200)))):
        png(tmp_path / f"{name}.png", pixels)
    (tmp_path / "bad.png").write_bytes(b"no image")
    found = images.images(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1].split(".")[0]: r for r in images.measured(found).collect()}
    assert set(got) == {"blank", "lines", "colours", "small", "bad"}
    assert got["blank"].text_density == got["blank"].edge_density == got["blank"].variance == 0 and got["blank"].empty and got["blank"].value == "low"
    assert got["lines"].top == 0 and got["lines"].middle == 0 and got["lines"].bottom == pytest.approx(0.25) and got["lines"].text_density == pytest.approx(5 / 80)
    assert got["lines"].edge_density > 0.05 and got["lines"].value == "medium" and got["lines"].complex
    assert got["colours"].variance == pytest.approx(255**2 * 2 / 9) and got["colours"].complex and got["colours"].edge_density == 0  # 4 * (76 - 29) is under the upper limit
    assert got["small"].small and not got["lines"].small and got["bad"].height is None and got["bad"].value is None
    ready = {r.path.rsplit("/", 1)[1]: r for r in images.ready(found).collect()}
    assert set(ready) == {"blank.png", "lines.png", "colours.png"} and ready["blank.png"].white == 1 and len(ready["lines.png"].data) == 80 * 120
