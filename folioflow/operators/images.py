"""What images show without being recognised: how dense text and edges are, and images made ready for recognition.

Images come from Spark's own image source, which decodes them; measures are taken in numpy, image by image within Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.pages import image_value

#: Images of fewer rows or columns are ornaments.
LEAST_SIDE = 50
#: Side of the neighbourhood of a pixel, and how much darker than its mean a pixel of text is.
SIDE, DARKER = 11, 2
#: Gradients from which an edge goes on, and begins.
EDGE_LOW, EDGE_HIGH = 100, 200
#: From these on an image is complex; under the last it is mostly empty.
COMPLEX_EDGES, COMPLEX_VARIANCE, EMPTY = 0.1, 1000.0, 0.01
MEASURES = "path string, height int, width int, text_density double, top double, middle double, bottom double, edge_density double, variance double"


def gray(pixels: np.ndarray) -> np.ndarray:
    """Rows x columns of 0 to 255 from rows x columns x channels in the order blue, green, red."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0].astype(np.int64)
    blue, green, red = (pixels[:, :, c].astype(np.float64) for c in range(3))
    return np.floor(0.114 * blue + 0.587 * green + 0.299 * red + 0.5).astype(np.int64)


def smoothed(image: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted means of neighbours along both axes; beyond the border its pixels go on."""
    half = len(weights) // 2
    for axis in (0, 1):
        wide = np.pad(image.astype(np.float64), [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        image = sum(w * np.take(wide, np.arange(i, i + image.shape[axis]), axis=axis) for i, w in enumerate(weights))
    return image


def bell(side: int, spread: float) -> np.ndarray:
    at = np.arange(side) - side // 2
    weights = np.exp(-(at**2) / (2 * spread**2))
    return weights / weights.sum()


def dark_spots(image: np.ndarray) -> np.ndarray:
    """Pixels that are darker than their neighbourhood, as text is."""
    mean = np.floor(smoothed(image, bell(SIDE, 0.3 * ((SIDE - 1) * 0.5 - 1) + 0.8)) + 0.5)
    return image <= mean - DARKER


def edges(image: np.ndarray, low: int = EDGE_LOW, high: int = EDGE_HIGH) -> np.ndarray:
    """Canny: gradients, thinned to their ridges; ridges over `high`, and those over `low` that hang together with one."""
    wide = np.pad(image, 1, mode="edge")
    row = wide[:-2] + 2 * wide[1:-1] + wide[2:]
    column = wide[:, :-2] + 2 * wide[:, 1:-1] + wide[:, 2:]
    dx, dy = row[:, 2:] - row[:, :-2], column[2:] - column[:-2]
    size = np.abs(dx) + np.abs(dy)
    around = np.pad(size, 1)
    at = lambda i, j: around[1 + i : around.shape[0] - 1 + i, 1 + j : around.shape[1] - 1 + j]
    flat, steep = np.abs(dy) < 0.4142 * np.abs(dx), np.abs(dy) > 2.4142 * np.abs(dx)
    rising = dx * dy < 0
    before = np.select([flat, steep, rising], [at(0, -1), at(-1, 0), at(1, -1)], at(-1, -1))
    behind = np.select([flat, steep, rising], [at(0, 1), at(1, 0), at(-1, 1)], at(1, 1))
    ridge = (size > before) & (size >= behind) & (size > low)
    found = ridge & (size > high)
    while True:  # along the ridges, a step at once
        padded = np.pad(found, 1)
        near = np.zeros_like(found)
        for i in (0, 1, 2):
            for j in (0, 1, 2):
                near |= padded[i : i + found.shape[0], j : j + found.shape[1]]
        grown = ridge & near
        if (grown == found).all():
            return found
        found = grown


def prepared(image: np.ndarray, contrast: float = 2.0, blur: float = 0.5, threshold: int = 128) -> np.ndarray:
    """Black (False) and white of a gray image with more contrast about its mean, a little smoothed."""
    mean = np.floor(image.mean() + 0.5)
    strong = np.clip(np.floor(mean + contrast * (image - mean)), 0, 255)
    return np.floor(smoothed(strong, bell(3, blur)) + 0.5) > threshold


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, channels, data) of the images under a path; what can't be decoded has a height of -1."""
    read = spark.read.format("image").option("dropInvalid", False).load(path)
    return read.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def _pixels(batch: pa.RecordBatch, i: int) -> np.ndarray | None:
    height, width, channels = (batch[c][i].as_py() for c in ("height", "width", "channels"))
    if height is None or height <= 0 or width <= 0:
        return None
    return np.frombuffer(batch["data"][i].as_py(), np.uint8).reshape(height, width, channels)


def measured(found: DataFrame) -> DataFrame:
    """Of images(): text_density, of the whole and of its top quarter, middle half and bottom quarter; edge_density; variance of all
    channels; small, empty, complex; value as by image_value(). What can't be decoded, or has no such part, has nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = lambda x: float(x.mean()) if x.size else None
        for batch in batches:
            rows = []
            for i, path in enumerate(batch["path"].to_pylist()):
                pixels = _pixels(batch, i)
                if pixels is None:
                    rows.append((path, None, None, *[None] * 6))
                    continue
                image = gray(pixels)
                text, quarter = dark_spots(image), len(image) // 4
                parts = text[:quarter], text[quarter : 3 * len(image) // 4], text[3 * len(image) // 4 :]
                rows.append((path, *image.shape, share(text), *map(share, parts), share(edges(image)), float(pixels[:, :, :3].astype(np.float64).var())))
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 9, kinds, strict=True)], [x.split()[0] for x in MEASURES.split(", ")])

    out = found.mapInArrow(run, MEASURES)
    small = (F.col("height") < LEAST_SIDE) | (F.col("width") < LEAST_SIDE)
    busy = (F.col("edge_density") > COMPLEX_EDGES) | (F.col("variance") > COMPLEX_VARIANCE)
    value = F.when(F.col("height").isNotNull(), image_value(F.col("edge_density"), F.col("text_density")))
    return out.withColumns({"small": small, "empty": F.col("text_density") < EMPTY, "complex": busy, "value": value})


def ready(found: DataFrame) -> DataFrame:
    """(path, height, width, data, white): images of images() that are large enough, as one byte a pixel, 0 or 255, made ready to be
    recognised; white: the share of white pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, path in enumerate(batch["path"].to_pylist()):
                white = prepared(gray(_pixels(batch, i)))
                rows.append((path, *white.shape, (white * np.uint8(255)).tobytes(), float(white.mean())))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], ["path", "height", "width", "data", "white"])

    large = found.where((F.col("height") >= LEAST_SIDE) & (F.col("width") >= LEAST_SIDE))
    return large.mapInArrow(run, "path string, height int, width int, data binary, white double")
